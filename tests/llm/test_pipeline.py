"""The pipeline against the stages done by hand."""

import hashlib
import math
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_ops import brute_components, docs, extended, prose

from matchstats.llm import quality_cascade, unigram


def test_stages(spark):
    clean = [prose(k, 60) for k in range(30)]
    texts = clean + [clean[0], clean[1].replace(" ", "\n "), clean[2] + " tail", "### $$$ " * 40, "short", None]
    d = extended(docs(spark, texts))
    out, seen = d, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "/root/testdata/sf0.001")
        seen.append((name, sorted(r.doc_id for r in out.collect())))
        if name != "encode":
            assert out.columns == d.columns
    ids = dict(seen)
    kept = [r.doc_id for r in quality_cascade.op6(d).where("kept").collect()]
    assert ids["quality_rules"] == sorted(kept) and not {33, 34, 35} & set(kept)
    assert ids["exact_dedup"] == [i for i in sorted(kept) if i not in (30, 31)]
    _, low = brute_components({i: texts[i] for i in ids["exact_dedup"]}, 5)
    assert ids["near_duplicates"] == [i for i in ids["exact_dedup"] if low[i] == i] and 32 not in ids["near_duplicates"]
    near = d.where(d.doc_id.isin(ids["near_duplicates"]))
    # one source: its rate is 1
    assert near.select("source").distinct().count() == 1
    assert ids["mix_sources"] == sorted(i for i in ids["near_duplicates"] for _ in range(copies(i, 1.0))) == ids["encode"]
    model = unigram.Unigram(*unigram.load(public_tokenizers.path("piece_bpe_32k.model")))
    for r in out.collect():
        assert model.decode(np.array(r.ids)).decode() == texts[r.doc_id] and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<i4").tobytes()) and r.n_pieces == len(r.ids)
        assert r.round_trip and abs(sum(model.score[i] for i in r.ids) - best(model, texts[r.doc_id])) < 1e-6


def copies(doc_id, rate, seed=41):
    """Count of a document: its uniform number inverted."""
    u, k, term, below = int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate), math.exp(-rate)
    while below <= u:
        k += 1
        term *= rate / k
        below += term
    return k


def best(model, text):
    """Greatest score of any cut of a text into pieces; the texts here need no byte pieces."""
    skip = set(model.byte_ids.tolist())
    pieces = {p: s for i, (p, s) in enumerate(zip(model.bytes_of, model.score, strict=True)) if p and i not in skip}
    data, most = (" " + text).encode(), max(map(len, pieces))
    top = [0.0] + [-math.inf] * len(data)
    for end in range(1, len(data) + 1):
        top[end] = max((top[a] + pieces[data[a:end]] for a in range(max(0, end - most), end) if data[a:end] in pieces), default=-math.inf)
    return top[-1]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("NOT round_trip").count() == 0


def test_stages_on_an_empty_table(spark):
    d = extended(docs(spark, []))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.collect() == [] and (name == "encode" or out.columns == d.columns)
