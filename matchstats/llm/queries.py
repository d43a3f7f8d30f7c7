"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import addressable_codes, fingerprints, host_reputation, language_gru, lsm_dedup, near_dedup, periodic_runs, poisson_mix, pu_quality, quality_cascade, unigram, warc_segments, whitening
from .common import table


def _docs(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_reputation": host_reputation.op1,
    "op2_warc_segments": warc_segments.op2,
    "op3_language_gru": _docs(language_gru.op3),
    "op4_addressable_codes": _docs(addressable_codes.op4),
    "op5_poisson_mix": _docs(poisson_mix.op5),
    "op6_quality_cascade": _docs(quality_cascade.op6),
    "op7_unigram": _docs(unigram.op7),
    "op8_near_dedup": _docs(near_dedup.op8),
    "op9_pu_quality": lambda spark, sf_dir: pu_quality.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_lsm_dedup": _docs(lsm_dedup.op10),
    "op11_periodic_runs": _docs(periodic_runs.op11),
    "op12_whitening": lambda spark, sf_dir: whitening.op12(table(spark, sf_dir, "embeddings")),
    "op13_fingerprints": _docs(fingerprints.op13),
}

ORACLES: dict[str, str] = {
    "op1_host_reputation": host_reputation.ORACLE,
    "op2_warc_segments": warc_segments.ORACLE,
    "op5_poisson_mix": poisson_mix.ORACLE,
    "op6_quality_cascade": quality_cascade.ORACLE,
    "op10_lsm_dedup": lsm_dedup.ORACLE,
    "op13_fingerprints": fingerprints.ORACLE,
}
