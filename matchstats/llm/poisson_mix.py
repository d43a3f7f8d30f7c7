"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share of the wanted rows over the rows it has. Each
document draws its count by inverting the Poisson distribution at a uniform number that is a hash of
seed and doc_id (so a rerun, or a lost executor, draws the same), is exploded by that count, and the
copies are shuffled globally by a hash of seed, doc_id and copy number.

Counts by source are pre-aggregated. The rates meet the documents in a broadcast join only if their
table is small, rows and elements of the distributions counted, else in a shuffled join, which AQE splits for a hot source. The last shuffle is by a
hash of each copy, so no source, however large, meets in one task.

Cases: a null source is a source of its own; a null doc_id hashes as 'null'; rows that repeat a doc_id
draw the same count each; sources without a target weight (where weights are given) have rate 0; an
empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, materialise, unit_hash

#: Half the distance of two numbers that can be drawn.
LEAST = 2.0**-53
#: So many elements of all distributions may be broadcast (8 bytes each).
BROADCAST_ELEMENTS = 2_000_000


def with_cdf(rates: DataFrame) -> DataFrame:
    """source, rate, cdf: cumulative probabilities of 0, 1, 2, ... in double precision, until what is left is below 2^-53.

    A row for each count, added up in windows: linear in the rate. Terms are made from their logarithms, so a
    large rate does not underflow to zero throughout.
    """
    most = (F.ceil(F.col("rate") + 12 * F.sqrt("rate")) + 40).cast("int")
    d = rates.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    d = d.withColumn("j", F.explode(F.when(F.col("rate") > 0, F.sequence(F.lit(0), most)).otherwise(F.array(F.lit(0)))))
    ahead = Window.partitionBy("key").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("j") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.greatest("j", F.lit(1)).cast("double")))
    d = d.withColumn("log", F.sum(F.when(F.col("rate") > 0, step).otherwise(F.lit(0.0))).over(ahead))
    d = d.withColumn("sum", F.sum(F.exp("log")).over(ahead))
    d = d.groupBy("key").agg(F.first("source").alias("source"), F.first("rate").alias("rate"), F.sort_array(F.collect_list(F.struct("j", "sum"))).alias("cdf"))
    return d.select("source", "rate", F.transform("cdf", lambda x: x["sum"]).alias("cdf"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, rows: int | None = None) -> DataFrame:
    """Written table of source, rate and cdf.

    Without ``weights`` the target share of a source is its row count to the power ``temperature``, normalised.
    ``rows`` is the expected size of the mixture; as many rows as there are by default.
    """
    by = docs.groupBy(docs["source"].alias("source")).agg(F.count("*").cast("double").alias("n"))
    by = materialise(by, "source-rows")
    if weights is None:
        want = F.pow("n", F.lit(temperature))
    else:
        want = F.lit(0.0)
        for k, w in weights.items():
            want = F.when(F.col("source") == k, F.lit(float(w))).otherwise(want)
    total = by.agg(F.sum("n").alias("n"), F.sum(want).alias("w")).first()
    size = total["n"] or 0.0 if rows is None else float(rows)
    scale = size / total["w"] if total["w"] else 0.0
    if not math.isfinite(scale):
        raise ValueError("weights must be finite")
    d = by.withColumn("rate", F.lit(scale) * want / F.col("n"))
    return materialise(searchable(with_cdf(d.select("source", "rate"))), "source-rates")


def searchable(d: DataFrame) -> DataFrame:
    """``d`` (source, rate, cdf) with what a draw searches: cdf without what no drawn number tells apart, below (number in ``skipped``; in ``zeros``, of those that are 0) and above, and every ``width``-th element of it.

    Numbers are multiples of 2^-52 below 1. What is left has some 17 standard deviations: at a rate of a million, 17,000 elements.
    """
    d = d.withColumns({"skipped": F.size(F.filter("cdf", lambda c: c <= LEAST)), "zeros": F.size(F.filter("cdf", lambda c: c <= 0))})
    d = d.withColumn("cdf", F.filter("cdf", lambda c: (c > LEAST) & (c <= 1 - LEAST)))
    d = d.withColumn("width", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("cdf").cast("double"))).cast("int")))
    return d.withColumn("coarse", F.filter("cdf", lambda _, i: i % F.col("width") == F.col("width") - 1))


def drawn(u: Column, r: Column) -> Column:
    """How many elements of the cdf of ``r`` (a row of ``searchable``) are at most ``u``: the coarse elements first, then those between two of them."""
    coarse = F.size(F.filter(r["coarse"], lambda c: c <= u)) * r["width"]
    fine = F.size(F.filter(F.slice(r["cdf"], coarse + 1, r["width"]), lambda c: c <= u))
    return F.when(u <= 0, r["zeros"]).otherwise(r["skipped"] + coarse + fine)


def mixed_sources(docs: DataFrame, seed: int = 41, **target) -> DataFrame:
    """The columns of ``docs`` and copy_no, shuffle_key (names prefixed by _ if taken), one row a copy, in shuffled order."""
    rate = rates(docs, **target)
    size = rate.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("cdf")), F.lit(0)).alias("elements")).first()
    small = size["rows"] <= BROADCAST_ROWS // 20 and size["elements"] <= BROADCAST_ELEMENTS
    src, row, copy, key = (fresh(n, docs) for n in ("rate_source", "rate_row", "copy_no", "shuffle_key"))
    rate = rate.select(F.col("source").alias(src), F.struct("cdf", "skipped", "zeros", "width", "coarse").alias(row))
    d = docs.join(F.broadcast(rate) if small else rate, docs["source"].eqNullSafe(F.col(src)), "left")
    name = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    u = unit_hash(name, seed)
    d = d.withColumn(copy, F.explode(F.sequence(F.lit(0), drawn(u, F.col(row)))))
    # sequence(0, n) has one element more than the count: copy numbers start at 1
    d = d.where(F.col(copy) > 0)
    d = d.withColumn(key, F.md5(F.concat(F.lit(f"{seed}/"), name, F.lit("/"), F.col(copy).cast("string"))))
    return d.select(*(F.col(c) for c in docs.columns), copy, key).repartition(F.col(key)).sortWithinPartitions(key)


def op5(docs: DataFrame) -> DataFrame:
    return mixed_sources(docs.select("doc_id", "text", "lang", "source", "n_chars"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The mixture with the columns of ``docs``."""
    return mixed_sources(docs).select(*docs.columns)


def oracle(docs: str = "documents", columns: str = "doc_id, text, lang, source, n_chars, copy_no, shuffle_key", seed: int = 41) -> str:
    return f"""
WITH s AS (SELECT source, count(*)::DOUBLE AS n FROM {docs} GROUP BY source),
r AS (SELECT source, (sum(n) OVER ()) / (sum(pow(n, 0.7)) OVER ()) * pow(n, 0.7) / n AS rate FROM s),
j AS (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate)) + 41)::BIGINT)) AS j FROM r),
c AS (SELECT source, list(cdf ORDER BY j) AS cdf FROM
      (SELECT source, j, sum(exp(j * ln(rate) - rate - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS cdf FROM j) GROUP BY source),
u AS (SELECT d.*, ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(2, 52) AS u, c.cdf
      FROM {docs} d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
e AS (SELECT *, unnest(range(1, len(list_filter(cdf, lambda x: x <= u)) + 1))::INTEGER AS copy_no FROM u),
k AS (SELECT *, md5('{seed}/' || coalesce(doc_id::VARCHAR, 'null') || '/' || copy_no::VARCHAR) AS shuffle_key FROM e)
SELECT {columns} FROM k
"""


ORACLE = oracle()
