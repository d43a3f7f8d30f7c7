"""Quality rules as a short-circuit cascade.

Each rule is a boolean column over the measures of a text. On a bounded sample the cost of a rule
(seconds a row, less the cost of reading the sample) and its selectivity (share of rows that it
rejects) are estimated; rules then run in descending order of rejection per cost, and a row stops
at the first rule that rejects it (CASE WHEN evaluates no later branch). The order changes which
rule is named and what the cascade costs, never the verdict. A cost is the least of several timings, in turns
with those of the other rules, over the sample repeated so often that reading it takes longer than starting a
job; it is rounded to a power of two, below which timings do not tell rules apart.

Everything is DataFrame expressions. Each text is measured in its own row: nothing is shuffled.

Cases: null text counts as empty (no words: the base rule rejects it); empty tables give empty
results; repeated rows are judged each by itself; a text of any length is taken whole; other
columns of the input do not matter.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, hash_sample, materialise

WINDOW = 8
#: Timings of each rule, and characters that each of them reads, about.
TURNS, WORK = 3, 1 << 23
#: Distinct words are counted in each block of so many words, so that their share does not fall with the length of a text.
BLOCK = 2000


@dataclass(frozen=True)
class Rule:
    """``rejects`` is over the columns that ``measured`` gives (and ``text``)."""

    name: str
    rejects: Column


def _same(a: Column, b: Column, words: Column) -> Column:
    """Two (hash, position) windows hold the same words; the words are compared, not only their hash."""
    return F.coalesce(
        (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, F.lit(WINDOW)) == F.slice(words, b["i"] + 1, F.lit(WINDOW))), F.lit(False)
    )


def _settled(d: DataFrame) -> DataFrame:
    """The same rows and columns as the output of a generator, below which the optimizer pushes no filter.

    Else a filter on a measure is rewritten over the arrays that it comes from, inside functions of their elements.
    """
    return d.select(F.inline_outer(F.array(F.struct(*d.columns))))


def measured(docs: DataFrame, keep: list[str], only: Column | None = None) -> DataFrame:
    """``keep`` columns plus text, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    ``n_repeat_words`` counts words in 8-word windows found twice or more in the text. Window hashes
    are compared first; only a text with two equal hashes is sorted and its words compared. With ``only``
    (over the other measures; it comes back as ``wanted``) the windows of other rows are not made, and
    their count is 0.
    """
    d = docs.select(*keep, F.coalesce(docs["text"], F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", f"{SPACE}+", -1), ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NOT_SPACE)))
    d = d.select(
        *keep,
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    if only is not None:
        d = d.withColumn("wanted", F.coalesce(only, F.lit(False)))
        hashes = F.when(F.col("wanted"), hashes)
    d = _settled(d.withColumn("hashes", hashes))
    windows = F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0)))
    d = d.withColumn("windows", F.transform(windows, lambda h, i: F.xxhash64(h, *(F.get("hashes", i + k) for k in range(1, WINDOW)))))
    d = d.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    d = _settled(d.drop("hashes", "windows"))
    again = F.transform(
        "ordered",
        lambda s, k: F.when(_same(s, F.get("ordered", k - 1), F.col("words")) | _same(s, F.get("ordered", k + 1), F.col("words")), s["i"]),
    )
    d = _settled(d.withColumn("found", F.sort_array(F.filter(again, lambda i: i.isNotNull()))).drop("ordered"))
    covered = F.aggregate(
        F.transform("found", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("found", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("found")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Shares are compared as integers, so that any engine gives the same verdict."""
    text, words = F.col("text"), F.col("n_words")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[!?]+", ""))
    no_letter = F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}")))
    starts = F.transform(F.sequence(F.lit(0), F.greatest((words - 1).cast("int"), F.lit(0)), F.lit(BLOCK)), lambda i: i + 1)
    distinct = F.aggregate(starts, F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice("words", i, F.lit(BLOCK)))))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 40 * words),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 14 * words)),
        Rule("dup_lines", 100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
        Rule("marks", 100 * marks > 40 * words),
        Rule("capitals", 100 * capitals > 60 * letters),
        Rule("no_letter", 100 * no_letter > 40 * words),
        Rule("few_distinct", 100 * distinct < 15 * words),
    ]


def planned(docs: DataFrame, rules: list[Rule], sample_rows: int = 512, seed: int = 17, total: int | None = None) -> list[tuple[Rule, float, float]]:
    """Rules in order of rejection per cost, each with its estimated selectivity and seconds a row.

    The sample has ``sample_rows`` rows on average whatever the size of the input. It is measured and
    written once; each rule is then timed ``TURNS`` times over ``WORK`` characters of it.
    """
    total = docs.count() if total is None else total
    key = F.coalesce(F.col("text"), F.lit(""))
    sample = materialise(measured(hash_sample(docs.select("text"), key, sample_rows, total, seed), []).coalesce(2), "cascade-sample")
    n, size = sample.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    times = max(1, min(WORK // max(size, 1), 1 << 16))
    rows = max(1, n * times)
    work = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times)))) if n else sample

    def timed(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        hit = work.agg(F.count_if(F.coalesce(rejects, F.lit(False)))).first()[0]
        return hit / rows, time.perf_counter() - began

    # the measures that a rule reads are read for the bare scan too
    tests = {"": F.length("text") + F.size("words") < 0} | {r.name: r.rejects for r in rules}
    turns = [{name: timed(test) for name, test in tests.items()} for _ in range(TURNS)]
    seconds = {name: min(t[name][1] for t in turns) for name in tests}
    # a difference of a few hundredths of the scan is noise
    cost = {r.name: max(seconds[r.name] - seconds[""], seconds[""] / 16) / rows for r in rules}
    found = [(r, turns[0][r.name][0], 2.0 ** round(math.log2(cost[r.name]))) for r in rules]
    return sorted(found, key=lambda x: (-(x[1] / x[2]), x[2], x[0].name))


def rejected_by(rules: list[Rule]) -> Column:
    """Name of the first rule, in the order given, that rejects the row; null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return out


def cascade(docs: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None, **sampling) -> DataFrame:
    """``keep`` columns, the measures, base_failed, rejected_by and kept of each row."""
    order = [r for r, _, _ in planned(docs, default_rules() if rules is None else rules, **sampling)]
    d = measured(docs, ["doc_id"] if keep is None else keep).withColumn("base_failed", base_failed())
    d = d.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(rejected_by(order)))
    return d.withColumn("kept", F.col("rejected_by").isNull())


def op6(docs: DataFrame) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return cascade(docs).select(*cols)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the cascade keeps, with their own columns; cheap rules run before the 8-word windows are made."""
    order = [r for r, _, _ in planned(docs, default_rules())]
    names = docs.columns
    d = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), docs["text"].alias("text"))
    d = measured(d, ["row"], only=(F.col("n_words") >= 20) & rejected_by(order).isNull())
    return d.where(F.col("wanted") & ~base_failed()).select("row.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (SELECT doc_id, text, words, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines,
             length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
p AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g
      FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words >= 8)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals,
             length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS marks,
             len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) AS no_letter,
             coalesce(list_sum(list_transform(range(0, n_words, 2000), lambda k: len(list_distinct(words[k + 1:k + 2000])))), 0) AS n_distinct
      FROM m LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 40 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 100 * n_dup_lines > 60 * n_lines OR 100 * marks > 40 * n_words OR 100 * capitals > 60 * letters
            OR 100 * no_letter > 40 * n_words OR 100 * n_distinct < 15 * n_words) AS kept
FROM b
"""
