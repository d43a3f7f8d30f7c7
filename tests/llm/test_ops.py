"""The operators on hand-made rows, against brute force, round trips and SQL."""

import json
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from matchstats.llm import addressable_codes, host_reputation, language_gru, lsm_dedup, near_dedup, poisson_mix, pu_quality, quality_cascade, queries, unigram, warc_segments

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["digest", "text_sha256", "keep_id", "rate_cdf", "copy_no", "gone_id", "words", "row", "v", "component", "norm"]


def docs(spark, texts, ids=None, lang="en", source="s"):
    rows = [(k if ids is None else ids[k], t, lang, source, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def extended(df):
    """The frame with columns whose names operators may want for themselves."""
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(int(j)) for i, j in zip(rng.integers(0, 10, n), rng.integers(0, 50, n)))


ODD = [None, "", "   \n\t", "one", "One", "a b", "A  b", "x " * 30, "é" * 3000, prose(1, 5000), "\u2581 tab\t\u00a0nbsp", "!!! ### $$$", prose(2, 60), prose(2, 60), prose(2, 59) + " other"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD + ["again", "again"], ids=[*range(len(ODD)), 90, 90])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    out = con.execute(queries.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in out.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


# ---- 1


def test_hosts(spark):
    urls = [None, "no scheme", "HTTP://Ünder.ORG/a?b#c", "x://h", "x://h?q/", "a://b://c/d", "http://m.example.org/en/1x", "http://example.orgx/en/1", "http://x.com/de/"]
    p = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, html string")
    d = host_reputation.judged(extended(p), spark.createDataFrame([], "page_id long, outcome int"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in d.collect()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("Ünder.org", "/a", "org/"), 3: ("h", "", None), 4: ("h", "", None), 5: ("b:", "//c/d", None),
        6: ("m.example.org", "/en/1x", "example.org/en/1"), 7: ("example.orgx", "/en/1", None), 8: ("x.com", "/de/", "com/de/"),
    }
    assert {r.verdict for r in d.collect()} <= {"allow", "block"}
    assert host_reputation.judged(p.limit(0), spark.createDataFrame([], "page_id long, outcome int")).count() == 0


def test_reputation_shrinks(spark):
    many = [("good.a.net", 1)] * 40 + [("bad.b.net", 0)] * 40 + [("c.a.net", None), ("c.b.net", None)]
    r = {x.host: x for x in host_reputation.reputations(spark.createDataFrame(many, "host string, outcome int")).collect()}
    assert r["good.a.net"].reputable and not r["bad.b.net"].reputable
    assert r["c.a.net"].posterior_mean > r["c.b.net"].posterior_mean


# ---- 2


def test_warc(spark):
    big = "q" * 100_000 + "é"
    p = spark.createDataFrame([(5, "http://a b/\r\nc", big), (3, None, big), (7, "u", None), (2, "u", ""), (9, "u", "only"), (None, "u", big), (9, "u", "only")], "page_id long, url string, html string")
    folder = str(spark.conf.get("spark.checkpoint.dir")) + "/warc-test"
    d = warc_segments.read(warc_segments.write(extended(p), folder), folder)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.intact, None if r.payload is None else len(r.payload)) for r in d.collect())
    assert got == [(0, "revisit", 3, True, None), (2, "response", None, True, 0), (3, "response", None, True, 100_002), (5, "revisit", 3, True, None), (7, "revisit", 2, True, None), (9, "response", None, True, 4), (9, "response", None, True, 4)]
    assert warc_segments.read(warc_segments.write(p.limit(0), folder), folder).count() == 0


def test_chunks():
    for n in (0, 1, 4096, 4097, 20_000):
        data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        assert warc_segments.from_chunked(warc_segments.to_chunked(data)) == data
    for broken in (b"", b"5\r\nab", b"5\r\nabcde\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc_segments.from_chunked(broken)
    assert warc_segments.from_chunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


# ---- 3


def test_gradients_through_time():
    m = language_gru.ByteGRU(["a", "b"], 3)
    rng = np.random.default_rng(0)
    m.out = rng.normal(0, 1, m.out.shape)
    for layer in (m.ahead, m.behind):
        for name in layer.NAMES:
            setattr(layer, name, getattr(layer, name).astype(np.float64))
    x, y, w = rng.integers(97, 101, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), rng.integers(0, 3, (6, 4)).astype(float)
    for owner, name, g in m.gradients(x, y, w)[1]:
        a = getattr(owner, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        a[at] += 1e-3
        up = m.gradients(x, y, w)[0]
        a[at] -= 2e-3
        down = m.gradients(x, y, w)[0]
        a[at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 1e-4


def test_language(spark, odd, none):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_gru.fit(train)
    d = language_gru.predicted(train, model).join(train.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (d.lang == d.lang_pred).mean() >= 0.98
    got = {r.doc_id: r for r in language_gru.predicted(extended(odd), model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[11].lang_pred == "und" and got[0].score == 0
    assert [k for k, _ in model.position_labels("La mañana")] == [0, 1, *range(3, 3 + len("mañana".encode()))]
    # a whole text scores as the mean over its positions, of which each window labels its own
    text = prose(3, 400).encode()
    core, side, sums = language_gru.CORE, language_gru.CONTEXT, []
    for at in range(0, len(text), core):
        end = min(at + core, len(text))
        whole = (b" " * side + text + b" " * 400)[at : at + side * 2 + -(-(end - at) // language_gru.STEP) * language_gru.STEP]
        p = model.probabilities(np.frombuffer(whole, dtype=np.uint8)[:, None])[side : side + end - at, 0]
        sums.append(p[[c != 32 for c in text[at:end]]])
    want = np.concatenate(sums).mean(axis=0)
    found = language_gru.pooled(model, [text, b"", text, text * 700])
    assert np.allclose(found[0], want, atol=1e-4) and np.allclose(found[2], want, atol=1e-4) and not found[1].any() and np.allclose(found[3].sum(), 1)
    assert language_gru.predicted(none, model).count() == 0
    assert {r.lang_pred for r in language_gru.predicted(odd, language_gru.fit(none)).collect()} == {"und"}


def test_neighbours_tell_apart():
    """A word of two languages gets the label of what stands around it, over white space."""
    rng = np.random.default_rng(1)
    own, shared = {"a": [b"aba", b"abba", b"bab"], "z": [b"zyz", b"zyyz", b"yzy"]}, [b"kin", b"mon", b"tol"]
    texts = [b" ".join(x for _ in range(30) for x in (own[lang][rng.integers(3)], shared[rng.integers(3)])) for lang in "az" for _ in range(60)]
    m = language_gru.ByteGRU(["a", "z"])
    m.train(texts, np.repeat([0, 1], 60))
    for lang, text in (("a", "bab mon abba"), ("z", "yzy mon zyyz")):
        labels = dict(m.position_labels(text))
        assert {labels[k] for k in (4, 5, 6)} == {lang}


def test_rare_language_is_learnt(spark):
    texts = [f"aba abba bab {i}" for i in range(400)] + [f"zyz yzy zzy {i}" for i in range(4)]
    d = docs(spark, texts[:400], lang="a").unionByName(docs(spark, texts[400:], ids=range(400, 404), lang="z"))
    model = language_gru.fit(d, train_docs=20)
    assert model.languages == ["a", "z"]
    assert {r.lang_pred for r in language_gru.predicted(docs(spark, ["zyz yzy"]), model).collect()} == {"z"}


# ---- 4


def test_codes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        ids = rng.integers(0, 1 << 24, n).astype(np.uint32)
        ids[::2] %= 300
        data = addressable_codes.pack([1, None], np.array([0, n // 2, n]), ids)
        names, starts, codes = addressable_codes.unpack(data)
        assert names == [1, None] and starts.tolist() == [0, n // 2, n] and len(codes) == n
        assert [codes[i] for i in range(0, n, 11)] == ids[::11].tolist()
        assert codes.range(n // 3, n).tolist() == ids[n // 3 :].tolist()


def test_token_files(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = docs(spark, ["don't <|endoftext|>x I'LL", "foo\u2014!bar 123 \u0130\u212a e\u0301", None], ids=[-5, 1000, None])
    d = extended(odd.unionByName(more))
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in addressable_codes.op4(d).collect()), key=lambda x: x[2])
    source = {r.doc_id: r.text for r in d.collect()}
    at = 0
    for _, doc_id, start, n, crc in got:
        ids = np.array([*t.encode(source[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert [x[:2] for x in got] == sorted(x[:2] for x in got if x[1] is None) + sorted(x[:2] for x in got if x[1] is not None)
    assert addressable_codes.op4(none).count() == 0


# ---- 5


def test_poisson(spark, odd, none):
    d = docs(spark, ["t"] * 4000, source="a").unionByName(docs(spark, ["t"] * 1000, ids=range(9000, 10000), source="b")).unionByName(docs(spark, ["n"], ids=[None], source=None))
    m = poisson_mix.mixed_sources(extended(d), weights={"a": 1.0, "b": 3.0}, rows=4000)
    n = Counter(r.source for r in m.collect())
    assert n["a"] == pytest.approx(1000, rel=0.15) and n["b"] == pytest.approx(3000, rel=0.1) and None not in n
    assert rows(m, "doc_id", "_copy_no") == rows(poisson_mix.mixed_sources(extended(d), weights={"a": 1.0, "b": 3.0}, rows=4000), "doc_id", "_copy_no")
    assert set(d.columns) <= set(m.columns)
    big = poisson_mix.with_cdf(spark.createDataFrame([(None, 900.0)], "source string, rate double")).first()["cdf"]
    assert big[0] == 0 and 0.49 < big[900] < 0.52 and big[-1] == pytest.approx(1)
    assert poisson_mix.mixed_sources(none).count() == 0 and poisson_mix.kept_documents(extended(odd)).columns == extended(odd).columns


# ---- 6


def brute_repeats(words):
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_cascade(spark, odd, none):
    lines = prose(4, 30)
    d = odd.unionByName(docs(spark, [f"{lines}\n{lines}\nx", lines + " " + " ".join(lines.split()[3:20])], ids=[500, 501]))
    got = quality_cascade.op6(extended(d)).collect()
    source = {r.doc_id: r.text or "" for r in d.collect()}
    assert len(got) == d.count()
    for r in got:
        w = source[r.doc_id].encode().split()
        assert (r.n_words, r.n_repeat_words) == (len(w), brute_repeats(w))
    assert {r.doc_id: r.n_dup_lines for r in got}[500] == 1
    # a filter on a measure is not pushed into it, and keeps the same rows as the pipeline's stage
    kept = quality_cascade.op6(d).where("kept")
    assert rows(kept, "doc_id") == rows(quality_cascade.kept_documents(extended(d)), "doc_id")
    assert quality_cascade.kept_documents(extended(d)).columns == extended(d).columns
    assert quality_cascade.op6(none).count() == 0


def test_rules_go_by_rejection_per_cost(spark):
    d = docs(spark, [prose(k, 40) for k in range(50)])
    rules = [quality_cascade.Rule("never", F.lit(False)), quality_cascade.Rule("always", F.col("n_words") > 0)]
    assert [r.name for r, _, _ in quality_cascade.planned(d, rules)] == ["always", "never"]


# ---- 7


def test_unigram(spark, odd, none):
    import public_tokenizers

    m = unigram.Unigram(*unigram.load(public_tokenizers.path("piece_bpe_32k.model")))
    texts = [(t or "").encode() for t in ODD] + ["  two  spaces ".encode(), "日本 🙂\n\n\r".encode(), b" "]
    ids = m.encode(texts)
    assert [m.decode(i) for i in ids] == texts

    pieces = {m.bytes_of[i].replace(b" ", b"\xff"): i for i in range(len(m.bytes_of)) if i not in set(m.byte_ids.tolist()) and m.bytes_of[i]}
    for text, own in zip(texts, ids):
        if len(text) > 400 or not text:
            continue
        b = b"\xff" + text.replace(b" ", b"\xff")
        best = [0.0] + [-1e18] * len(b)
        for i in range(len(b)):
            if b[i] & 0xC0 == 0x80:
                continue
            n = 1 if b[i] < 0xC0 or b[i] == 0xFF else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
            best[i + n] = max(best[i + n], best[i] + m.unknown)
            for j in range(i + 1, min(len(b), i + 60) + 1):
                if b[i:j] in pieces:
                    best[j] = max(best[j], best[i] + m.score[pieces[b[i:j]]])
        is_byte = set(m.byte_ids.tolist())
        found = sum(m.score[i] if i not in is_byte else m.unknown * (m.bytes_of[i][0] & 0xC0 != 0x80) for i in own.tolist())
        assert found == pytest.approx(best[-1])
    got = unigram.encoded(extended(odd)).collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got) and len(got) == odd.count()
    assert unigram.encoded(none).count() == 0


# ---- 8


def brute_components(texts, size, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return sets, low


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, none, size, monkeypatch):
    monkeypatch.setattr(near_dedup, "LONG_LIST", 8)  # so that a small group goes through the rounds for large ones
    rng = np.random.default_rng(8)
    texts = [t for t in ODD]
    base = prose(50, 120).split()
    for k in range(40):  # near copies of all degrees
        w = list(base)
        for i in rng.choice(120, rng.integers(0, 14), replace=False):
            w[i] = f"edit{rng.integers(0, 60)}"
        texts.append(" ".join(w))
    texts += [prose(60 + k // 3, 30) + (" tail" if k % 3 else "") for k in range(12)]
    by_id = dict(enumerate(texts))
    d = extended(docs(spark, texts))
    sets, low = brute_components(by_id, size)
    got = near_dedup.near_duplicates(d, size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), low[i], low[i] == i) for i in by_id}
    kept = near_dedup.kept_documents(d) if size == 5 else None
    if kept is not None:
        assert rows(kept, "doc_id") == sorted((i,) for i in low if low[i] == i) and kept.columns == d.columns
    assert near_dedup.near_duplicates(none, size=size).count() == 0


def test_near_duplicates_odd_ids(spark):
    d = docs(spark, ["a b c", "a b c", "z y x", "", ""], ids=[None, 4, None, 7, 7])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_dedup.near_duplicates(d, size=2).collect())
    # rows are linked by their texts alone, whatever their doc_id
    assert got == [("4", "4"), ("7", "7"), ("7", "7"), ("None", "4"), ("None", "None")]


# ---- 9


def test_risk_is_never_negative_for_long():
    rng = np.random.default_rng(2)
    p = rng.normal(1, 1, (6000, pu_quality.N_FEATURES))
    u = np.concatenate([rng.normal(1, 1, (6000, pu_quality.N_FEATURES)), rng.normal(-1, 1, (4000, pu_quality.N_FEATURES))])
    prior = pu_quality.estimated_prior(p, u)
    assert 0.45 < prior < 0.75  # 0.6
    net = pu_quality.non_negative_pu(p, u, prior, steps=400)
    fresh_p, fresh_n = rng.normal(1, 1, (300, pu_quality.N_FEATURES)), rng.normal(-1, 1, (300, pu_quality.N_FEATURES))
    assert (net.score(fresh_p) >= 0.5).mean() > 0.95 and (net.score(fresh_n) < 0.5).mean() > 0.95


def test_quality(spark, odd, none):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = pu_quality.fit(d, labels)
    x = pu_quality.scored(d, net).join(labels, "doc_id").where("held_out").toPandas()
    assert (x.predicted == x.quality).mean() > 0.93
    got = pu_quality.scored(extended(odd), net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in pu_quality.scored(odd, pu_quality.fit(none, labels)).collect()} == {0.5}
    assert pu_quality.scored(none, net).count() == 0


# ---- 10


def test_exact(spark, odd, none):
    got = {r.doc_id: r for r in lsm_dedup.op10(extended(odd)).collect()}
    assert got[0].keep_id == got[1].keep_id == 0 and got[0].group_size == 2
    assert got[6].keep_id == 6 and got[5].keep_id == 5  # case matters
    assert got[13].keep_id == 12 and not got[13].kept and got[90].group_size == 2
    kept = lsm_dedup.kept_documents(extended(odd))
    assert kept.columns == extended(odd).columns
    assert rows(kept, "doc_id") == sorted((i,) for i in got if got[i].kept)
    assert lsm_dedup.op10(none).count() == 0
    d = docs(spark, ["x", "x", "y"], ids=[None, 3, None])
    assert sorted(str((r.doc_id, r.keep_id, r.kept)) for r in lsm_dedup.op10(d).collect()) == ["(3, 3, True)", "(None, 3, False)", "(None, None, True)"]


def test_shared_digest_is_split(spark):
    d = docs(spark, ["one", "two", "one"])
    digests = d.select("doc_id", F.lit("same").alias("digest"))
    index = lsm_dedup.DigestIndex(spark, fanout=2)
    for k in range(3):
        index.flush(lsm_dedup.materialise(digests.where(F.col("doc_id") == k), "memtable"))
    index.compact()
    assert rows(index.entries(), "digest", "keep_id", "group_size") == [("same", 0, 3)]
    entries = lsm_dedup.materialise(index.entries(), "entries")
    split = lsm_dedup.verified(d, digests, entries, digest_of=lambda text: F.lit("same"))
    assert rows(split, "doc_id", "keep_id", "group_size") == [(0, 0, 2), (1, 1, 1), (2, 0, 2)]
    # rows without doc_id are verified too
    d = docs(spark, ["one", "two"], ids=[None, 5])
    split = lsm_dedup.verified(d, d.select("doc_id", F.lit("same").alias("digest")), entries, digest_of=lambda text: F.lit("same"))
    assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in split.collect()) == ["(5, 5, 1)", "(None, None, 1)"]


def test_index_is_probed_through_filters(spark, monkeypatch):
    table = lambda texts, ids: docs(spark, texts, ids=ids)
    index = lsm_dedup.DigestIndex(spark, fanout=3)
    slices = [range(0, 400), range(300, 700), range(1000, 1100), range(650, 660)]
    for k, part in enumerate(slices):
        found = index.flush(lsm_dedup.digests_of(table([f"text  {i}" for i in part], [1000 * k + i for i in part])))
        assert found.distinct().count() == (0, 100, 0, 10)[k]
    assert [len(x) for x in index.levels] == [1, 1]  # three runs were merged when the third came
    want = {i: min(1000 * k + i for k, part in enumerate(slices) if i in part) for part in slices for i in part}
    opened, read = [], index.read
    monkeypatch.setattr(index, "read", lambda *paths: opened.extend(paths) or read(*paths))
    asked = table([f"text {i}" for i in range(600, 720)], range(120))
    answer = lambda: sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in lsm_dedup.dedup_against(index, asked).collect())
    before = answer()
    size = lambda i: sum(i in part for part in slices)
    assert before == sorted(str((i - 600, want.get(i), size(i) or None)) for i in range(600, 720))
    assert len(opened) == 2
    opened.clear()
    absent = table([f"absent {i}" for i in range(40)], range(40))
    assert lsm_dedup.dedup_against(index, absent).where("keep_id IS NOT NULL").count() == 0
    passed = sum(run.filter.passed(lsm_dedup.digests_of(absent)).where("passed").count() for run in index._runs())
    assert passed <= 2 and len(opened) <= passed  # a run is read only if its filter passes a probe
    index.compact()
    opened.clear()
    assert answer() == before and len(opened) == 1


def test_filters_rule_out_nothing_that_is_there(spark):
    own = lsm_dedup.digests_of(docs(spark, [f"in {i}" for i in range(3000)]))
    other = lsm_dedup.digests_of(docs(spark, [f"out {i}" for i in range(3000)]))
    f = lsm_dedup.Filter(own.select("digest"), 3000)
    assert f.passed(own).where("passed").count() == 3000
    assert f.passed(other).where("passed").count() <= 60
    assert lsm_dedup.Filter(own.select("digest").limit(0), 0).passed(other).where("passed").count() == 0


def test_hot_digests_and_small_memtables(spark, monkeypatch):
    monkeypatch.setattr(lsm_dedup, "HOT_ROWS", 5)
    texts = ["hot"] * 40 + ["warm"] * 3 + [f"cold {i}" for i in range(20)] + [None, "", "hot "]
    d = docs(spark, texts, ids=[*range(1, len(texts)), None]).repartition(8)
    got = {str(r.doc_id): (r.keep_id, r.group_size, r.kept) for r in lsm_dedup.dedup(d, memtable_rows=10).collect()}
    norm = [(t or "").rstrip() + (" " if t == "hot " else "") for t in texts]
    for i, t in zip([*range(1, len(texts)), None], norm, strict=True):
        same = [j + 1 for j, x in enumerate(norm[:-1]) if x == t]
        assert got[str(i)] == ((min(same), len(same), i == min(same)) if same else (None, 1, True))


def test_one_of_repeated_rows_stays(spark):
    """Rows of one doc_id that differ in white space or other columns: the same one whatever their order."""
    d = spark.createDataFrame([(7, "a  b", "x"), (7, "a b", "z"), (7, "a b", "y"), (8, "c", "q")], "doc_id long, text string, source string")
    want = sorted(map(str, [(7, "a  b", "x"), (8, "c", "q")]))
    for order in ("source", F.desc("source")):
        assert sorted(str(tuple(r)) for r in lsm_dedup.kept_documents(d.orderBy(order).coalesce(1)).collect()) == want


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    json.dumps(sorted(names))
