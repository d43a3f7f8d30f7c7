"""Periodic runs of words, found as maximal pairs.

A run is a stretch of words with smallest period q, as long as ``least_words`` and ``least_periods`` periods at
least, that no neighbouring word extends keeping q. It shows as a maximal pair: the stretches that start at its first
word and q words later are equal up to its end, the words before them differ, and so do the words after them.

Suffixes of the words are sorted by prefix doubling, and common prefixes of neighbours are read off the ranks of the
doubling steps. The tree of LCP intervals is walked bottom-up. A node keeps the positions of its suffixes in lists by
the word on their left (class lists); when children meet, each position of the smaller one looks for positions of
other classes no farther away than the node's common prefix allows. Occurrences of a word sequence that are within half
its length of each other all lie one period apart, so all but the first have the same word on their left: a window has two
classes at most, and what is listed are maximal pairs alone, in all no more than a few per run and period. Of
pairs with the same stretch the one of least distance is the run; nothing is extended.

Documents are apart: there is no shuffle. Memory is linear in the longest text (its words, and a rank for each word and
doubling step). Only intervals with a long enough common prefix are walked, so texts without long repeats cost no more
than hashing their words.

Cases: null, empty or blank text has no words and no runs; a text of any length is taken whole; rows that repeat a
doc_id, or have none, are judged one by one; an empty table gives an empty result; other columns pass through, and
added names that they have already are prefixed by _.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, SPACE, fresh, mixed, python_workers

LEAST_WORDS, LEAST_PERIODS = 24, 3
_WORD = re.compile(NOT_SPACE + "+")
_RUN = ("start", "length", "period")


def suffixes(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of ``x``, and the ranks of all windows of 1, 2, 4, ... values (shorter ones at the end), until they are distinct."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while True:
        key = rank * (n + 1)
        key[: max(n - width, 0)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ahead = key[order]
        new = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order, ranks
        ranks.append(rank)
        width *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the next one in order."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    total = np.zeros(n - 1, dtype=np.int64)
    for step in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[step][a[inside]] == ranks[step][b[inside]]]
        for at in (a, b, total):
            at[same] += 1 << step
    return total


class _Node:
    """Positions of the suffixes below a node: all, and by the word on their left."""

    __slots__ = ("all", "classes")

    def __init__(self, at: int, left: int):
        self.all, self.classes = [at], {left: [at]}

    def pairs(self, other: _Node, prefix: int, periods: int, left: list[int], out: list[tuple[int, int, int]]) -> None:
        """Maximal pairs (first, distance, prefix) of a position here and one of ``other``, no farther away than prefix / (periods - 1)."""
        far = prefix // (periods - 1)
        for at in other.all:
            low, high = bisect_left(self.all, at - far), bisect_right(self.all, at + far)
            if low == high:
                continue
            own = left[at]
            for c in {left[self.all[low]], left[self.all[high - 1]]}:
                if c != own:
                    there = self.classes[c]
                    for k in range(bisect_left(there, at - far), bisect_right(there, at + far)):
                        out.append((min(at, there[k]), abs(at - there[k]), prefix))

    def take(self, other: _Node) -> None:
        for at in other.all:
            insort(self.all, at)
        for c, there in other.classes.items():
            mine = self.classes.setdefault(c, there)
            if mine is not there:
                for at in there:
                    insort(mine, at)


def maximal_pairs(x: np.ndarray, least_prefix: int, periods: int) -> list[tuple[int, int, int]]:
    """Maximal pairs (first position, distance, common prefix) with a prefix of ``least_prefix`` and periods - 1 distances at least."""
    order, ranks = suffixes(x)
    prefixes = common_prefixes(order, ranks).tolist()
    left = [-1, *x[:-1].tolist()]
    order, out = order.tolist(), []
    stack: list[tuple[int, _Node]] = []  # intervals that are open, each with the prefix that it has in common with the next one
    for k, at in enumerate(order):
        node, ahead = _Node(at, left[at]), prefixes[k] if k < len(prefixes) else 0
        # what is open with a longer common prefix than the next suffix has is closed: it meets the interval before it
        while stack and stack[-1][0] > ahead:
            prefix, before = stack.pop()
            if len(before.all) < len(node.all):
                before, node = node, before
            before.pairs(node, prefix, periods, left, out)
            before.take(node)
            node = before
        if ahead >= least_prefix:
            if stack and stack[-1][0] == ahead:  # another child of the same interval
                before = stack.pop()[1]
                if len(before.all) < len(node.all):
                    before, node = node, before
                before.pairs(node, ahead, periods, left, out)
                before.take(node)
                node = before
            stack.append((ahead, node))
        else:
            stack.clear()
    return out


def repeats(x: np.ndarray, width: int) -> bool:
    """Whether two windows of ``width`` values may be equal (by a 64-bit hash)."""
    if len(x) <= width:
        return False
    h = mixed(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = 1
    while step < width:  # windows of step values, then of twice as many, the last time overlapping
        more = min(step, width - step)
        h = mixed(h[: len(h) - more] * np.uint64(0xD1342543DE82EF95) + h[more:])
        step += more
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def runs_of(words: list[str], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    if len(words) < max(least_words, least_periods):
        return []
    number: dict[str, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    # length = prefix + distance and prefix >= (periods - 1) * distance
    least_prefix = max(least_periods - 1, -(-least_words * (least_periods - 1) // least_periods))
    if not repeats(x, least_prefix):
        return []
    best: dict[tuple[int, int], int] = {}
    for first, distance, prefix in maximal_pairs(x, least_prefix, least_periods):
        stretch = first, prefix + distance
        if stretch[1] >= least_words:
            best[stretch] = min(distance, best.get(stretch, distance))
    return sorted(((start, length, period) for (start, length), period in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that are not in a run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _finder(at: int, least_words: int, least_periods: int):
    """Adds the runs and the collapsed text of column ``at`` to each batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.int64()) for c in _RUN]))
        for batch in batches:
            counts, found, rest = [], [], []
            for text in batch.column(at):
                words = _WORD.findall(text.as_py() or "")
                runs = runs_of(words, least_words, least_periods)
                counts.append(len(words))
                found.append([dict(zip(_RUN, r, strict=True)) for r in runs])
                rest.append(" ".join(collapsed(words, runs)))
            arrays = [*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[str(k) for k in range(len(arrays))])

    return run


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period, by start, then period) and collapsed_text (the words that no run repeats, joined by spaces)."""
    if least_periods < 3:
        raise ValueError("a run has three periods at least")
    python_workers(docs.sparkSession)
    names = [fresh(n, docs) for n in ("n_words", "runs", "collapsed_text")]
    by_place = docs.toDF(*(str(k) for k in range(len(docs.columns))))  # names may clash in case
    added = T.StructType().add("n", "long").add("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _RUN]))).add("rest", "string")
    kinds = T.StructType([T.StructField(str(k), f.dataType) for k, f in enumerate([*docs.schema, *added])])
    found = by_place.mapInArrow(_finder([c.lower() for c in docs.columns].index("text"), least_words, least_periods), kinds)
    return found.toDF(*docs.columns, *names)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten, by the checksum of its id, has a tail of 3 to 10 repetitions of its words instead of its own.

    With h = crc32(doc_id), g = floor(h / 10), for h % 10 = 0: word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    # white space in front gives an empty first word, behind an empty last one
    words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    d = d.withColumn("chosen", F.coalesce(F.col("h") % 10 == 0, F.lit(False))).withColumn("g", F.expr("h div 10"))
    d = d.withColumn("words", F.when(F.col("chosen"), words)).withColumn("n", F.size("words"))
    d = d.withColumn("a", F.col("g") % F.when(F.col("n") > 0, F.col("n")))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("words", at(i).cast("int")))
    return d.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    d = periodic_runs(repeated_tails(docs))

    def better(a, b):  # the greater length / period
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        key = lambda s: F.struct(s["start"], s["period"])
        return F.when(x > y, a).when(x < y, b).otherwise(F.when(key(a) <= key(b), a).otherwise(b))

    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    d = d.withColumn("best", best)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in _RUN),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
