"""Operators against plain code: damaged archives, the classifier's risk and scores, tokenizers of other kinds, plans, keys."""

import gzip
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import ODD, docs, prose

from matchstats.llm import addressable_codes, host_reputation, pu_quality, quality_cascade, unigram, warc_segments

# ---- 2


def pages_in(spark, folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    manifest = spark.createDataFrame([(str(folder / name), 0)], "path string, records long")
    return sorted(((r.page_id, r.record_type, r.intact, r.payload) for r in warc_segments.read(manifest, str(folder)).collect()), key=str)


def members(page, payload):
    return list(warc_segments.page_records(page, "http://a/", payload, None, f"<urn:uuid:{page}>"))


def edited(member, old, new):
    text = gzip.decompress(member)
    assert re.search(old, text)
    return gzip.compress(re.sub(old, new, text, count=1))


LONG = np.random.default_rng(3).integers(0, 256, 50_000, dtype=np.uint8).tobytes()


def test_damage_costs_what_it_falls_on(spark, tmp_path):
    broken = bytearray(members(5, LONG[:9000])[0])
    broken[6000] ^= 0xFF
    total = members(3, LONG)
    parts = [
        b"foreign bytes \x1f\x8b\x08 in front",
        *members(1, b"one"),
        *(m for k, m in enumerate(members(2, LONG)) if k != 1),  # a gap
        *total[:-1], edited(total[-1], rb"Total-Length: [0-9]+", b"Total-Length: 7"),
        edited(members(4, b"four")[0], rb"sha1:[A-Z2-7]{4}", b"sha1:AAAA"),
        bytes(broken),
        edited(members(6, b"six")[0], rb"Content-Length: [0-9]+\r\n", b""),
        b"\x00\x01 between \x1f\x8b\x08\x00",
        *members(7, LONG),
        gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"),
        edited(members(8, b"eight")[0], rb"X-Page-ID: 8", b"X-Page-ID: eight"),
        members(9, LONG[:9000])[0][:-4000],  # cut
    ]
    got = pages_in(spark, tmp_path, "a.warc.gz", b"".join(parts))
    state = {page: intact for page, _, intact, _ in got}
    assert state == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True, None: True, 9: False}
    whole = {page: payload for page, _, intact, payload in got if intact}
    assert whole == {1: b"one", 7: LONG, None: b"eight"}


def test_no_archive_is_too_odd(spark, tmp_path):
    one = members(1, b"one")[0]
    for k, data in enumerate([b"", b"no archive at all", b"\x1f\x8b", one[:30], gzip.compress(b"text"), gzip.compress(b"WARC/1.1\r\n"), b"\x1f\x8b\x08" * 1000]):
        assert not [x for x in pages_in(spark, tmp_path, f"{k}.warc.gz", data) if x[2]]
    both = gzip.compress(gzip.decompress(one) + gzip.decompress(members(2, b"two")[0]))  # two records in one member
    assert [(p, ok) for p, _, ok, _ in pages_in(spark, tmp_path, "both.warc.gz", both)] == [(1, True), (2, True)]


# ---- 9


def test_risk_and_its_gradient():
    rng = np.random.default_rng(4)

    def risk(fp, fu, prior):
        loss = lambda z: math.log1p(math.exp(-z))
        mean = lambda f: sum(f) / len(f)
        return prior * mean([loss(z) for z in fp]), mean([loss(-z) for z in fu]) - prior * mean([loss(-z) for z in fp])

    for prior, shift in ((0.3, 0.0), (0.9, 3.0)):
        fp, fu = rng.normal(shift, 1, 5), rng.normal(-shift, 1, 7)
        plus, minus, dp, du = pu_quality.risk_gradient(fp, fu, prior)
        assert np.allclose(risk(fp, fu, prior), (plus, minus)) and (minus < 0) == (prior == 0.9)
        own = lambda a, b: -risk(a, b, prior)[1] if minus < 0 else sum(risk(a, b, prior))  # noqa: B023, E731
        for values, found, at in ((fp, dp, 0), (fu, du, 1)):
            for k in range(len(values)):
                up, down = ([fp.copy(), fu.copy()] for _ in range(2))
                up[at][k] += 1e-5
                down[at][k] -= 1e-5
                assert abs((own(*up) - own(*down)) / 2e-5 - found[k]) < 1e-6


def plain_features(text):
    data = text.encode()
    kind = lambda c: next((k for k, s in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:'\"()-", b"!?", b"#*$%&|<>"], 1) if c in s), 8 if c > 127 else 0)
    words = re.findall(rb"[^ \t-\r]+", data)
    n, kinds = max(len(words), 1), Counter(kind(c) for c in data)
    length, count = [len(w) for w in words], Counter(words)
    mean = sum(length) / n
    full = [x for x in data.split(b"\n") if x.strip()]
    first, last = Counter(kind(w[0]) for w in words), Counter(kind(w[-1]) for w in words)
    letters = max(kinds[1] + kinds[2], 1)
    out = [
        math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in length) / n - mean * mean, 0)), kinds[2] / letters, kinds[3] / len(data), kinds[5] / n, kinds[6] / n, kinds[7] / n,
        kinds[8] / len(data), kinds[0] / len(data), len(count) / n, math.log1p(len(count)) - 0.8 * math.log1p(len(words)), max(count.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(full)) / max(len(full), 1), len(full) / n, first[2] / n, last[5] / n, last[6] / n, last[7] / n,
    ]
    pairs = Counter((kind(a) * 9 + kind(b)) % 64 for a, b in zip(data, data[1:]))
    return out + [math.sqrt(pairs[k] / len(data)) for k in range(64)]


def test_scores_by_hand(spark):
    rng = np.random.default_rng(5)
    texts = [t for t in ODD if t] + [prose(k, 40) for k in range(20)]
    d = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int")
    net = pu_quality.fit(d, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in pu_quality.scored(d, net).collect()}
    for k, text in enumerate([*texts, None, ""]):
        x = plain_features(text) if text else [0.0] * pu_quality.N_FEATURES
        x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, net.mean, net.scale)]
        h = [math.tanh(sum(a * b for a, b in zip(x, net.w1[:, j])) + net.b1[j]) for j in range(len(net.b1))]
        z = sum(a * b for a, b in zip(h, net.w2)) + net.b2[0]
        want = 1 / (1 + math.exp(-z))
        assert abs(got[k][0] - want) < 1e-6 and got[k][1] == (got[k][0] >= 0.5)
    assert 0 < net.prior < 1 and rng is not None


# ---- 4


def test_other_tokenizers_take_whole_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        known = f.read()
    assert addressable_codes.takes_units(known) and not addressable_codes.takes_units(known.replace("Lowercase", "NFKC"))
    t = Tokenizer(models.WordLevel({"one": 5, "One": 6, "[UNK]": 7, "a": 1 << 20}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    texts = ["one One a", "a b", None, "One"]
    manifest = addressable_codes.write(docs(spark, texts), t.to_str(), f"file://{tmp_path}/dac")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in addressable_codes.read(manifest, f"file://{tmp_path}/dac").collect()}
    at = 0
    for k, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[k] == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


# ---- 6


def test_order_is_stable(spark):
    """Of two rules that reject the same rows the cheap one comes first, in every plan."""
    d = docs(spark, [prose(k, 300) + (" odd" if k % 3 == 0 else "") for k in range(60)])
    odd = F.col("text").endswith("odd")
    dear = F.length(F.regexp_replace(F.regexp_replace("text", r"(\\w+)(\\d+)", "$2$1"), r"[aeiou]+", "")) >= 0
    rules = [quality_cascade.Rule("a_dear", dear & odd), quality_cascade.Rule("z_cheap", odd), quality_cascade.Rule("none", F.lit(False))]
    plans = [[(r.name, share) for r, share, _ in quality_cascade.planned(d, rules)] for _ in range(5)]
    assert all(p == [("z_cheap", pytest.approx(1 / 3)), ("a_dear", pytest.approx(1 / 3)), ("none", 0.0)] for p in plans)


def test_sql_judges_long_texts(spark, tmp_path):
    rng = np.random.default_rng(9)
    few = lambda n, words: " ".join(f"w{x}" for x in rng.integers(0, words, n))
    texts = [few(n, words) for n in (500, 1999, 2000, 2001, 4100, 30_000) for words in (40, 290, 310, 900)]
    docs(spark, texts).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[-1] for r in con.execute(quality_cascade.ORACLE).fetchall()}
    got = {r.doc_id: r.kept for r in quality_cascade.op6(docs(spark, texts)).collect()}
    assert got == want and not got[20] and got[23] and {got[k] for k in (4, 8, 12, 16)} == {False}


# ---- 7


def test_models_of_other_scores_are_others():
    pieces = [("<unk>", 0.0), *((f"<0x{c:02X}>", 0.0) for c in range(256)), ("ab", -1.0), ("a", -2.0), ("b", -2.5)]
    make = lambda extra: unigram.Unigram([(p, s + extra * (p == "ab")) for p, s in pieces], list(range(1, 257)), set(range(257)), False)
    a, b = make(0.0), make(-9.0)
    assert a.digest() == make(0.0).digest() != b.digest() and a.bytes_of == b.bytes_of


# ---- 1


def test_domains(spark):
    want = {"a.b.com": ("b.com", "com"), "com": ("com", "com"), "x.shop.co.uk:8080": ("shop.co.uk", "co.uk"), "me:pw@a.b.org:1": ("b.org", "org"), "10.0.0.7:80": ("10.0.0.7", "ip"), "[::1]:80": ("[::1]", "ip"), "": ("", "")}
    d = spark.createDataFrame([(h,) for h in want], "host string")
    got = {r.host: (r.domain, r.suffix) for r in d.select("host", *(c.alias(n) for c, n in zip(host_reputation.domain_and_suffix(F.col("host")), ("domain", "suffix")))).collect()}
    assert got == want


def test_sql_of_odd_hosts(spark, tmp_path):
    rng = np.random.default_rng(11)
    hosts = ["a.x.com", "b.x.com", "a.y.co.uk", "b.y.co.uk:81", "z.org.uk", "u@q.net", "10.1.1.1", "10.1.1.2:9", "[::1]", "example.org", "com", "q.example.org:1"]
    pages = [(k, f"http://{hosts[k % len(hosts)]}/en/{k}", "") for k in range(600)]
    labels = [(k, int(rng.random() < 0.15 + 0.07 * (k % len(hosts))), 0) for k in range(600) if k % 3]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(host_reputation.ORACLE).fetchall())
    got = sorted(tuple(r) for r in host_reputation.op1(spark, str(tmp_path)).collect())
    assert got == want and len({r[4] for r in got}) == 2


# ---- samples for fitting, large rates, empty tables


def test_samples_are_bounded_where_ids_repeat(spark):
    """A language whose rows have no id is learned; one id on most rows does not draw them all."""
    from matchstats.llm import language_gru

    one = docs(spark, [f"der die und {k} das" for k in range(300)], lang="xx").withColumn("doc_id", F.lit(None).cast("long"))
    two = docs(spark, [f"the of and {k}" for k in range(150)], ids=[3 * k + 1 for k in range(150)], lang="en")
    hot = docs(spark, ["same text"], lang="hot").withColumn("doc_id", F.lit(12).cast("long")).join(spark.range(5000).select()).select(*one.columns)
    model, seen = None, []
    train = language_gru.ByteGRU.train
    language_gru.ByteGRU.train = lambda self, texts, labels: seen.extend(labels.tolist())
    try:
        model = language_gru.fit(one.unionByName(two).unionByName(hot), train_docs=40)
    finally:
        language_gru.ByteGRU.train = train
    assert model.languages == ["en", "hot", "xx"]
    counts = Counter(model.languages[k] for k in seen)
    assert 10 < counts["xx"] <= 80 and 10 < counts["en"] <= 80 and counts["hot"] <= 80


def test_classifier_samples_are_bounded(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(pu_quality, "non_negative_pu", lambda p, u, prior: sizes.append((len(p), len(u))))
    monkeypatch.setattr(pu_quality, "estimated_prior", lambda p, u: 0.5)
    d = docs(spark, ["same"]).withColumn("doc_id", F.lit(12).cast("long")).join(spark.range(3000).select()).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(12, 1, 0)], "doc_id long, quality int, toxic int")
    pu_quality.fit(d, labels, positives=50, unlabelled=70)
    assert not sizes or (sizes[0][0] <= 100 and sizes[0][1] <= 140)


def test_draws_at_large_rates(spark):
    """The search gives the place of a number in the whole distribution, at any rate."""
    from matchstats.llm import poisson_mix

    us = [0.0, 2.0**-52, 2.0**-51, 1e-9, 0.1, 0.5, 0.75, 0.999999, 1 - 2.0**-40, 1 - 2.0**-52]
    for rate in (0.0, 0.3, 7.0, 900.0, 100_000.0):
        cdf = poisson_mix.with_cdf(spark.createDataFrame([("a", rate)], "source string, rate double"))
        d = poisson_mix.searchable(cdf).select(F.struct("cdf", "skipped", "zeros", "width", "coarse").alias("r")).withColumn("u", F.explode(F.array(*map(F.lit, us))))
        full = cdf.first()["cdf"]
        assert [r.x for r in d.select(poisson_mix.drawn(F.col("u"), F.col("r")).alias("x")).collect()] == [sum(c <= u for c in full) for u in us]
        assert d.select(F.size("r.cdf").alias("n")).first()["n"] <= 18 * math.sqrt(rate) + 40


def test_large_rate_in_the_mixture(spark):
    """A source of one row that is wanted 3,000 times."""
    from matchstats.llm import poisson_mix

    d = docs(spark, ["a", "b"], source="big").unionByName(docs(spark, ["c"], ids=[7], source="small"))
    got = poisson_mix.mixed_sources(d, weights={"small": 1.0, "big": 0.001}, rows=3000).groupBy("doc_id").count().collect()
    n = {r.doc_id: r["count"] for r in got}
    assert 2700 < n[7] < 3300 and sum(n.values()) - n[7] < 30
