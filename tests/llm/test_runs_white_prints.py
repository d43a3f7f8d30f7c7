"""Periodic runs, whitening and fingerprints against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import ODD, docs, extended, prose, rows

from matchstats.llm import fingerprints, periodic_runs, queries, whitening

SF = "/root/testdata/sf0.001"

# ---- 11


def brute_runs(w, least_words=24, least_periods=3):
    found = {}
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_words, least_periods * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, rest)))


OP11 = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(800):
        w = [str(rng.randrange(rng.choice([1, 2, 3, 5]))) for _ in range(rng.randint(0, 110))]
        for _ in range(rng.randint(0, 3)):
            if len(w) > 4:
                a, b = sorted(rng.sample(range(len(w)), 2))
                p = rng.randint(1, max(1, (b - a) // 2))
                for i in range(a + p, b):
                    w[i] = w[i - p]
        least = rng.choice([24, 9, 6]), rng.choice([3, 4])
        assert periodic_runs.runs_of(w, *least) == brute_runs(w, *least)


def test_work_stays_near_linear():
    """One word throughout, a frequent passage between distinct words, and nested periods: pairs stay as few as positions."""
    fib = ["a", "ab"]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    for w in (["a"] * 20_000, [x for k in range(1000) for x in (f"u{k}", *(f"b{i}" for i in range(20)))], list(fib[-1])):
        number = {}
        x = np.array([number.setdefault(v, len(number)) for v in w])
        assert len(periodic_runs.maximal_pairs(x, 16, 3)) <= len(w)
    assert periodic_runs.runs_of(["a"] * 20_000) == [(0, 20_000, 1)]


def test_op11_rows(spark):
    some = docs(spark, [*ODD, "a b c " * 20 + "tail", "x y " * 30, "a b " * 12 + "a c"], ids=[*range(len(ODD)), 50, 51, 52])
    again = some.where("doc_id >= 12").unionByName(some.where("doc_id = 50").withColumn("doc_id", F.lit(None).cast("long")))
    d = extended(some.unionByName(again))
    want = sorted((brute_row(r.doc_id, r.text) for r in d.collect()), key=str)
    assert sorted(map(tuple, periodic_runs.op11(d).select(*OP11).collect()), key=str) == want
    assert {r[0] for r in want if r[1] and r[0] is not None} >= {50, 51, 52}
    assert periodic_runs.op11(docs(spark, [])).collect() == []


def test_op11_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in table.collect()}
    assert {r.doc_id: tuple(r[c] for c in OP11) for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()} == want


def test_runs_keep_other_columns(spark):
    d = docs(spark, ["w " * 30]).withColumns({"runs": F.array(F.struct(F.lit(1).alias("Text"))), "N_Words": F.lit("x")})
    r = periodic_runs.periodic_runs(d).first()
    assert r["_n_words"] == 30 and [tuple(x) for x in r["_runs"]] == [(0, 30, 1)] and r["collapsed_text"] == "w" and r["N_Words"] == "x" and r["runs"][0]["Text"] == 1


# ---- 12


def whitened_by_hand(v):
    x = np.floor(1024 * np.array(v, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0).astype(object)
    c = [[(n * int((x[:, j].astype(object) * x[:, k]).sum()) - s[j] * s[k]) / n**2 for k in range(x.shape[1])] for j in range(x.shape[1])]
    e, u = np.linalg.eigh(np.array(c, dtype=np.float64))
    e, u = e[::-1], u[:, ::-1]
    k = min(8, int((e > e.sum() * 1e-12).sum()))
    deviation = [int(sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    return n, deviation, (x - x.mean(axis=0)) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare_whitened(spark, v, ids, got):
    n, deviation, w, explained = whitened_by_hand(v)
    assert len(got) == w.size
    found = np.zeros_like(w)
    for r in got:
        k = ids.index(r.vec_id)
        found[k, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[k] and abs(r.explained - explained[r.component - 1]) < 1e-9 and 0 <= r.identity_error < 1e-9
    found *= np.sign((found * w).sum(axis=0))
    assert np.abs(found - w).max() < 1e-7


def vectors(spark, v, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], None if x is None else [None if y is None else float(y) for y in x], 0) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int")


def test_scatter_is_exact():
    rng = np.random.default_rng(2)
    for rows_, scale in ((1, 5), (63, 100), (64, 1 << 20), (200, 1 << 40)):
        x = rng.integers(-scale, scale, (rows_, 5))
        x[:, 2] = 7  # no planes
        sums, pairs = whitening.scatter(x)
        o = x.astype(object)
        assert sums == list(o.sum(axis=0)) and pairs == [int((o[:, j] * o[:, k]).sum()) for j in range(5) for k in range(j, 5)]


def test_op12_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(0, 1, (300, 12)).astype(np.float32)
    good[100:200] = good[100]  # a third of the rows are one vector
    odd = [None, [], [None] * 12, [float("nan")] + [0] * 11, [float("inf")] + [1] * 11, [1.0] * 5]
    d = extended(vectors(spark, [*good.tolist(), *odd])).repartition(7)
    compare_whitened(spark, good, list(range(300)), whitening.op12(d).collect())
    assert whitening.op12(vectors(spark, [])).collect() == [] and whitening.op12(vectors(spark, odd[:1])).collect() == []
    # one row, and equal rows, have no component with a scale
    assert whitening.op12(vectors(spark, [[1, 2, 3]])).collect() == [] and whitening.op12(vectors(spark, [[1, 2, 3]] * 4)).collect() == []
    # fewer dimensions than components, one of them constant; repeated and null ids
    few = rng.normal(0, 3, (40, 3)).astype(np.float32)
    few[:, 1] = 2.5
    got = whitening.op12(vectors(spark, few.tolist(), ids=[*range(38), None, 5])).collect()
    assert Counter(r.component for r in got) == {1: 40, 2: 40} and sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 5 for r in got) == 4


def test_op12_far_entries(spark):
    far = np.random.default_rng(4).normal(0, 1e6, (50, 4)).astype(np.float32)
    got = whitening.op12(vectors(spark, far.tolist())).collect()
    assert {r.deviation for r in got} == {None if v >= 1 << 63 else v for v in whitened_by_hand(far)[1]}
    d, _ = whitening.whitened(vectors(spark, far.tolist()))
    assert {int(r.deviation) for r in d.collect()} == set(whitened_by_hand(far)[1])
    with pytest.raises(Exception, match="2.50"):
        whitening.op12(vectors(spark, [[1e30], [2.0]])).collect()


def test_op12_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    compare_whitened(spark, [r.embedding for r in table], [r.vec_id for r in table], queries.QUERIES["op12_whitening"](spark, SF).collect())


# ---- 13


def by_hand(text):
    return Counter(p for p in re.sub(r"([.!?])[\x20\x09-\x0D]+", r"\1\n", text or "").split("\n") if p)


def vector_by_hand(text):
    parts, lanes = [0] * 4, Counter()
    for p, n in by_hand(text).items():
        h = hashlib.md5(p.encode()).hexdigest()
        for k in range(4):
            parts[k] = (parts[k] + n * int(h[8 * k : 8 * k + 8], 16)) % 2**32
        lanes[int(h[:8], 16) % 2048] += n
    return parts, lanes


def form(text):
    parts, lanes = vector_by_hand(text)
    return "".join(f"{p:08x}" for p in parts) + "".join(f"{k:03x}{n:08x}" for k, n in sorted(lanes.items()))


def near(a, b):
    a, b = vector_by_hand(a)[1], vector_by_hand(b)[1]
    na, nb = a.total(), b.total()
    size = sum(v * v for v in a.values()) - na * na / 2048 + sum(v * v for v in b.values()) - nb * nb / 2048
    return 1.0 if size == 0 else max(0.0, min(1.0, 2 * (sum(n * b[k] for k, n in a.items()) - na * nb / 2048) / size))


def op13_by_hand(table):
    d = sorted(((i, t or "") for i, t in table), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(d):
        follows = d[(k + 1) % len(d)][1]
        edited = t[: len(t) - len(t) // 2] + follows[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), form(t), form(edited), round(near(t, edited), 9), round(near(t, follows), 9)))
    return sorted(out, key=str)


def op13_rows(d):
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    return sorted(((*(r[c] for c in cols), round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.op13(d).collect()), key=str)


TEXTS = [*ODD, "One. Two! Three?", "Three?\nTwo!\nOne.", "\n\n", "\U0001f600 wide. code points é", "same. " * 400, "One.\tTwo!  Three?"]


def test_op13_rows(spark):
    ids = [*range(5, 5 + len(TEXTS) - 4), None, None, -3, 2**63 - 1]
    d = docs(spark, TEXTS, ids=ids)
    d = d.unionByName(d.where("doc_id IN (6, 9)")).unionByName(docs(spark, ["other"], ids=[9])).unionByName(docs(spark, ["least"], ids=[-(2**63)]))
    want = op13_by_hand([(r.doc_id, r.text) for r in d.collect()])
    assert op13_rows(extended(d).repartition(5)) == want
    assert op13_rows(docs(spark, [])) == [] and op13_rows(docs(spark, ["A. B."])) == op13_by_hand([(0, "A. B.")])


def test_next_with_many_pieces(spark):
    rng = np.random.default_rng(6)
    ids = [int(x) for x in rng.choice(10**6, 700, replace=False)] + [42] * 300  # an id that a third of the rows share
    d = docs(spark, [f"t{k}" for k in range(1000)], ids=ids)
    want = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda r: (-r[0], r[1]))
    want = sorted((*row, want[(k + 1) % len(want)][1]) for k, row in enumerate(want))
    for pieces in (1, 2, 7, 64, 500):
        assert rows(fingerprints.with_next(d.select("doc_id", "text"), ["text"], pieces), "doc_id", "text", "next_text") == want


def test_fingerprints_are_homomorphic(spark):
    a, b = "One. Two! " + prose(4, 30), "Three?\nOne."
    d = spark.createDataFrame([(a, b, a + "\n" + b, 1), (b, "", b, 2)], "a string, b string, both string, k int")
    for c in ("a", "b", "both"):
        d = fingerprints.with_vector(d, c, f"v_{c}")
    v = {c: F.col(f"v_{c}") for c in ("a", "b", "both")}
    text = fingerprints.text_form
    r = d.select(
        (text(fingerprints.plus(v["a"], v["b"])) == text(v["both"])).alias("plus"), (text(fingerprints.minus(v["both"], v["b"])) == text(v["a"])).alias("minus"),
        (text(fingerprints.plus(fingerprints.minus(v["a"], v["b"]), v["b"])) == text(v["a"])).alias("back"), fingerprints.likeness(v["both"], v["both"]).alias("same"),
    )
    assert [tuple(x) for x in r.collect()] == [(True, True, True, 1.0)] * 2
    all_rows = fingerprints.combined(d, [], "v_both").select(text(F.col("v_both")).alias("f")).first()["f"]
    assert all_rows == form(a + "\n" + b + "\n" + b)


def test_likeness_follows_shared_paragraphs(spark):
    """The estimate is near the share of paragraphs in common, and 0 to a few hundredths where there are none."""
    rng = random.Random(7)
    pairs = []
    for k in range(60):
        own = [f"{k} own {i}" for i in range(80)]
        other = rng.sample(own, k) + [f"{k} other {i}" for i in range(80 - k)]
        pairs.append((k, "\n".join(own), "\n".join(other)))
    d = spark.createDataFrame(pairs, "k int, a string, b string")
    d = fingerprints.with_vector(fingerprints.with_vector(d, "a", "va"), "b", "vb")
    got = d.select("k", fingerprints.likeness(F.col("va"), F.col("vb")).alias("x")).collect()
    assert max(abs(r.x - r.k / 80) for r in got) < 0.12 and np.mean([abs(r.x - r.k / 80) for r in got]) < 0.03
