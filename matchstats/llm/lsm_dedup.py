"""Exact deduplication over a log-structured merge index of text digests.

Each memtable (a slice of the input, of a bounded number of rows) is aggregated to one entry (digest, smallest id,
rows) a text and flushed as a run: Parquet, sorted by digest, beside a blocked Bloom filter of its digests, which
is a table too. Compaction merges runs level by level (``fanout`` at a time), keeps the smallest identifier of a
digest and adds up its rows. A look-up goes through the runs level by level: probes that a run's filter rules out
never meet the run, and a run that no probe is left for is not read.

Deduplication of a table builds the index and looks up its own rows in the entries of more than one row: the filter
of these keeps most rows, which are unique, out of the join. A document that hits such an entry is verified on its
bytes: hits are grouped by digest and whole normalised text, so a digest that two texts share is split into its texts.
``dedup_against`` looks up the rows of another table in an index, which it leaves as it is.

Hot groups: entries are pre-aggregated before any shuffle, verification too (copies collapse in their own task). Of
digests of very many rows there are few, so these meet the rows in a broadcast join, the others in a shuffled one.
No group is gathered in one place.

Cases: null text counts as empty; a null doc_id never stays before another one (it sorts last), and
a group of null ids alone has a null keep_id and is kept; rows that repeat a doc_id with an equal text
are the same document, count each in group_size and share its verdict; an empty table gives an empty
result; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, first_rows, fresh, joined, materialise, new_path


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


#: Entries in one file of a run, about, and rows of a memtable at most, about.
RUN_FILE_ROWS, MEMTABLE_ROWS = 250_000, 50_000_000
#: Memtables that a table is cut into at least, if it has so many files.
LEAST_MEMTABLES = 4
#: Blocks of a filter (72 bytes each) that may be broadcast, entries that a block is made for, and bits set by an entry.
FILTER_BLOCKS, BLOCK_ENTRIES, BITS = 1 << 17, 32, 4
#: A digest of more rows than this is hot; there are at most a ``HOT_ROWS``-th of the rows.
HOT_ROWS = 100_000
_ENTRY = "digest string, keep_id long, group_size long"
_WORDS = [f"w{i}" for i in range(8)]


# ---- blocked Bloom filters as tables: a block of 512 bits by hash


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int")


def _bits(digest: Column) -> list[Column]:
    """The words of a block with the bits of a digest set."""
    h = F.xxhash64(digest, F.lit(1))
    at = [F.shiftrightunsigned(h, 9 * k).bitwiseAND(F.lit(511)).cast("int") for k in range(BITS)]
    one = F.lit(1).cast("long")
    bit = [F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63))) for x in at]
    out = []
    for i in range(len(_WORDS)):
        word = F.lit(0).cast("long")
        for x, b in zip(at, bit, strict=True):
            word = word.bitwiseOR(F.when(F.shiftright(x, 6) == i, b).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


class Filter:
    """A filter of the digests of ``entries``, about ``rows`` of them; it may pass others (under 1 in 100), never rule out one of them."""

    def __init__(self, entries: DataFrame, rows: int):
        self.blocks = 1 << max(0, (max(1, rows) // BLOCK_ENTRIES).bit_length())
        d = entries.select(_block(F.col("digest"), self.blocks).alias("block"), *(w.alias(n) for w, n in zip(_bits(F.col("digest")), _WORDS, strict=True)))
        self.table = materialise(d.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in _WORDS)), "digest-filter")

    def passed(self, probes: DataFrame) -> DataFrame:
        """``probes`` (digest, ...) with ``passed``; the filter is broadcast if its blocks are few, else both sides are dealt out by block."""
        own = self.table.select(F.col("block").alias("_block"), *(F.col(n).alias(f"_{n}") for n in _WORDS))
        own = F.broadcast(own) if self.blocks <= FILTER_BLOCKS else own
        d = probes.join(own, _block(F.col("digest"), self.blocks) == F.col("_block"), "left")
        hit = F.col("_block").isNotNull()
        for n, word in zip(_WORDS, _bits(F.col("digest")), strict=True):
            hit = hit & (F.col(f"_{n}").bitwiseAND(word) == word)
        return d.select(*probes.columns, F.coalesce(hit, F.lit(False)).alias("passed"))


@dataclass
class Run:
    path: str
    rows: int
    filter: Filter


class DigestIndex:
    """Runs of (digest, keep_id, group_size) by level; level 0 is the newest."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _run(self, entries: DataFrame, rows: int) -> Run:
        """A written run of at most ``rows`` entries, in files of about RUN_FILE_ROWS, each sorted."""
        path, files = new_path(self.spark, "digest-run"), max(1, -(-rows // RUN_FILE_ROWS))
        entries.coalesce(files).sortWithinPartitions("digest").write.parquet(path)
        own = self.read(path)
        return Run(path, n := own.count(), Filter(own, n))

    def read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], _ENTRY)

    def _runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _in(self, run: Run, digests: DataFrame) -> DataFrame | None:
        """The entries of a run for digests (a written table); None, without reading the run, if its filter passes none."""
        probes = materialise(run.filter.passed(digests).where("passed").select("digest"), "digest-probes")
        n = probes.count()
        return joined(self.read(run.path), probes, ["digest"], "left_semi", n) if n else None

    def flush(self, memtable: DataFrame) -> DataFrame:
        """A memtable (doc_id, digest) becomes a sorted run of level 0; a full level is compacted into the next.

        Returns the digests that the memtable has more than once, or that an older run has.
        """
        entries = memtable.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        run = self._run(entries, memtable.count())
        own = self.read(run.path)
        found = [own.where("group_size > 1").select("digest")]
        found += [hits.select("digest") for old in self._runs() if (hits := self._in(old, own.select("digest"))) is not None]
        found = materialise(reduce(DataFrame.unionByName, found), "digest-repeats")
        self.levels[0].insert(0, run)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._merge(level)
        return found

    def _merge(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].insert(0, self._run(_added(self.read(*(r.path for r in runs))), sum(r.rows for r in runs)))

    def compact(self) -> None:
        """Merge all runs into one of the last level."""
        runs = self._runs()
        if len(runs) > 1:
            self.levels = [runs]
            self._merge(0)

    def entries(self) -> DataFrame:
        """One entry a digest, over all runs."""
        paths = [run.path for run in self._runs()]
        return self.read(*paths) if len(paths) == 1 else _added(self.read(*paths))

    def look_up(self, digests: DataFrame) -> DataFrame:
        """The entries that the index has for digests (distinct, a written table)."""
        found = [hits for run in self._runs() if (hits := self._in(run, digests)) is not None]
        return _added(reduce(DataFrame.unionByName, found)) if found else self.read()


def _added(entries: DataFrame) -> DataFrame:
    return entries.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _matched(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (digest, ...) with keep_id and group_size of a written table of entries, null without one. Hot digests, of which there are few, are looked up in a broadcast join."""
    hot = entries.where(F.col("group_size") > HOT_ROWS)
    n = hot.count()
    if not n:
        return joined(rows, entries, ["digest"], "left")
    d = joined(rows, hot, ["digest"], "left", n)
    cool = materialise(entries.where(F.col("group_size") <= HOT_ROWS), "digest-cool")
    rest = joined(d.where("group_size IS NULL").select(*rows.columns), cool, ["digest"], "left")
    return d.where("group_size IS NOT NULL").unionByName(rest)


def verified(docs: DataFrame, digests: DataFrame, repeats: DataFrame, digest_of: Callable[[Column], Column] = digest) -> DataFrame:
    """Rows of ``digests`` (doc_id, digest) with keep_id and group_size, from a written table of the entries of repeated digests; their texts are checked byte for byte."""
    rows = materialise(Filter(repeats, repeats.count()).passed(digests), "digest-passed")
    hits = materialise(_matched(rows.where("passed").drop("passed"), repeats), "digest-hits")
    alone = rows.where("NOT passed").drop("passed").unionByName(hits.where("group_size IS NULL").select("doc_id", "digest"))
    alone = alone.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    hits = hits.where("group_size IS NOT NULL")
    ids = materialise(hits.select(F.col("doc_id").alias("hit_id")).distinct(), "digest-hit-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    docs = docs.select(docs["doc_id"], docs["text"])
    norm = normalised(F.col("text")).alias("norm")
    # null-safe: rows without doc_id are verified too
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["hit_id"]), "left_semi").select("doc_id", norm, digest_of(F.col("text")).alias("digest"))
    # equal texts collapse where they are read: what is shuffled has each text once a task
    groups = texts.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    clashing = materialise(groups.groupBy("digest").count().where("count > 1").select("digest"), "digest-clashes")
    if clashing.isEmpty():
        return alone.unionByName(hits.select(*alone.columns))
    bad = joined(docs.select("doc_id", norm, digest_of(F.col("text")).alias("digest")), clashing, ["digest"], "left_semi")
    split = bad.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    good = joined(hits, clashing, ["digest"], "left_anti").select(*alone.columns)
    return alone.unionByName(good).unionByName(bad.join(split, ["digest", "norm"]).select(*alone.columns))


def indexed(digests: DataFrame, index: DigestIndex, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Flush a written table of (doc_id, digest) into the index, some of its files a memtable; a written table of the entries of digests that repeat, in it or in the index."""
    files = digests.inputFiles()
    n = min(len(files), max(LEAST_MEMTABLES, -(-digests.count() // memtable_rows)))
    read = digests.sparkSession.read.schema(digests.schema).parquet
    found = [index.flush(read(*files[k::n])) for k in range(n)]
    if not found:
        return materialise(index.read(), "digest-entries")
    repeats = materialise(reduce(DataFrame.unionByName, found).distinct(), "digest-repeats")
    return materialise(index.look_up(repeats), "digest-entries")


def digests_of(docs: DataFrame) -> DataFrame:
    return materialise(docs.select(docs["doc_id"], digest(docs["text"]).alias("digest")), "digests")


def dedup(docs: DataFrame, index: DigestIndex | None = None, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs`` (doc_id, text); ``index`` is a new one, and has their digests afterwards."""
    digests = digests_of(docs)
    index = DigestIndex(docs.sparkSession) if index is None else index
    d = verified(docs, digests, indexed(digests, index, memtable_rows))
    return d.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup_against(index: DigestIndex, docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of each row of ``docs``, and of the entry that the index has for it keep_id and group_size, null if it has none."""
    digests = digests_of(docs)
    known = materialise(index.look_up(materialise(digests.select("digest").distinct(), "digest-asked")), "digest-known")
    return _matched(digests, known).select("doc_id", F.col("digest").alias("text_sha256"), "keep_id", "group_size")


def op10(docs: DataFrame) -> DataFrame:
    return dedup(docs)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows go by (doc_id, digest). Where repeated rows of one doc_id stay together, the first of them by text and other columns is kept.
    """
    verdict = materialise(dedup(docs), "dedup-verdict")
    gone = materialise(verdict.where(~F.col("kept")).select("doc_id", "text_sha256").distinct(), "dedup-gone")
    twice = materialise(verdict.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").drop("count"), "dedup-twice")
    sha, mark = fresh("sha", docs), fresh("is_marked", docs)
    d = docs.withColumn(sha, digest(docs["text"]))

    def marked(pairs: DataFrame, how: str) -> DataFrame:
        own = pairs.select(F.col("doc_id").alias(mark), F.col("text_sha256").alias(f"{mark}_sha"))
        own = F.broadcast(own) if pairs.count() <= BROADCAST_ROWS else own
        return d.join(own, d["doc_id"].eqNullSafe(own[mark]) & (d[sha] == own[f"{mark}_sha"]), how)

    d = marked(gone, "left_anti")
    if not twice.isEmpty():
        again = first_rows(marked(twice, "left_semi"), ["doc_id", sha], docs.columns)
        return marked(twice, "left_anti").select(*docs.columns).unionByName(again)
    return d.select(*docs.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
