"""Document fingerprints by a homomorphic multiset hash [native].

A text is the multiset of its paragraphs. Each paragraph has a vector of 4 + 2048 components, hashed from it by md5: the
four parts of the digest, and 1 in one of 2048 lanes. The fingerprint is the sum of the vectors, each component modulo
2^32. So it does not depend on the order of paragraphs, and a paragraph that comes or goes is added or subtracted without
reading the others. The parts of the digests tell multisets apart, by a chance of 2^-128 that two are confused. The
lanes, less their mean, are a sketch: scalar products there are, on average, those of the paragraph counts themselves, so
``likeness`` estimates 2 |A and B| / (|A| + |B|), with a standard error of about 0.02 where nothing is shared. Most
lanes of most texts are 0: lanes are kept as a map of the others.

A paragraph ends at a line break, or where a full stop, question or exclamation mark is followed by white space. Empty
ones do not count.

Neighbours in the order of ids are found without sorting in one task: a sample of the keys, of a bounded size, gives
cut points; each row goes to the piece that its key lies in, and the first rows of each piece visit the piece
before it too, as whose last neighbour they serve. Texts move once.

Cases: null counts as empty; a text without paragraphs has the fingerprint zero, and two such texts are alike (1); a text
of any length is taken whole; rows that repeat a doc_id follow each other by their texts, null ids come last; a single
row is its own neighbour; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Lanes of a vector, and parts of a digest.
LANES, WORDS = 2048, 4
_MODULUS, _HALF = 1 << 32, 1 << 31
#: Pieces for each shuffle partition, and sampled keys for each piece.
PIECES, SAMPLED = 4, 50
#: Characters of the text that a key has, to tell rows that share an id apart.
_KEY_CHARS = 64
_BREAK = r"([.!?])[\x20\x09-\x0D]+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, _BREAK, "$1\n"), "\n"), lambda p: p != "")


def _centred(x: Column) -> Column:
    """The whole number in [-2^31, 2^31) that is equal modulo 2^32."""
    return F.pmod(x + F.lit(_HALF), F.lit(_MODULUS)) - F.lit(_HALF)


def _word(k: int) -> Callable[[Column], Column]:
    """The k-th 32 bits of a digest."""
    return lambda h: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")


def with_vector(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint of a text column: parts (array of long) and lanes (map of int to long)."""
    digests, order, codes, at, *words = (fresh(c, docs) for c in ("digests", "order", "codes", "at", *(f"word{k}" for k in range(WORDS))))
    d = docs.withColumn(digests, F.transform(paragraphs(F.coalesce(text, F.lit(""))), lambda p: F.md5(p.cast("binary"))))
    d = d.withColumns({w: F.transform(digests, _word(k)) for k, w in enumerate(words)})
    # lanes in order: how often one occurs is how far the first place of the next one is from its own
    d = d.withColumn(order, F.array_sort(F.transform(words[0], lambda w: w.bitwiseAND(F.lit(LANES - 1)).cast("int"))))
    d = d.withColumn(codes, F.array_distinct(order))
    d = d.withColumn(at, F.concat(F.transform(codes, lambda c: F.array_position(order, c)), F.array(F.size(order).cast("long") + 1)))
    lanes = F.map_from_arrays(codes, F.transform(codes, lambda c, i: F.get(at, i + 1) - F.get(at, i)))
    sums = [F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + x) for w in words]  # an array has fewer elements than 2^31
    d = d.withColumn(name, F.struct(F.array(*(_centred(x) for x in sums)).alias("parts"), lanes.alias("lanes")))
    return d.drop(digests, order, codes, at, *words)


def _added(a: Column, b: Column, sign: int) -> Column:
    zero = F.lit(0).cast("long")
    both = lambda x, y: _centred(F.coalesce(x, zero) + sign * F.coalesce(y, zero))
    lanes = F.map_filter(F.map_zip_with(a["lanes"], b["lanes"], lambda _, x, y: both(x, y)), lambda _, n: n != 0)
    return F.struct(F.zip_with(a["parts"], b["parts"], both).alias("parts"), lanes.alias("lanes"))


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both: inserts b into a."""
    return _added(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """Deletes the paragraphs of b from a."""
    return _added(a, b, -1)


def _hex(x: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(F.pmod(x, F.lit(_MODULUS))), digits, "0"))


def text_form(vector: Column) -> Column:
    """Eight hexadecimal digits a part, and eleven a lane that is not 0: three of its number, eight of its value. Two vectors are equal if their texts are."""
    entries = F.transform(F.array_sort(F.map_entries(vector["lanes"])), lambda e: F.concat(_hex(e["key"], 3), _hex(e["value"], 8)))
    return F.array_join(F.concat(F.transform(vector["parts"], lambda x: _hex(x, 8)), entries), "")


def likeness(a: Column, b: Column) -> Column:
    """From 0 (no paragraph in common, on average) to 1 (equal)."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))
    count = lambda x: total(F.map_values(x["lanes"]))
    size = lambda x: total(F.transform(F.map_values(x["lanes"]), lambda n: n.cast("double") * n)) - count(x) * count(x) / LANES
    shared = F.map_values(F.map_zip_with(a["lanes"], b["lanes"], lambda _, x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))))
    product, both = total(shared) - count(a) * count(b) / LANES, size(a) + size(b)
    return F.when(both == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * product / both)))


def combined(table: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Fingerprint of all rows of each key, as if their texts were one: partial sums by component, so a hot key is no trouble."""
    parts = F.map_from_entries(F.transform(f"{vector}.parts", lambda x, i: F.struct((-1 - i).alias("lane"), x.alias("x"))))
    each = table.select(*keys, F.explode(F.map_concat(parts, f"{vector}.lanes")).alias("lane", "x")).groupBy(*keys, "lane")
    whole = "decimal(38,0)"
    each = each.agg(_centred(F.pmod(F.sum(F.col("x").cast(whole)), F.lit(_MODULUS).cast(whole)).cast("long")).alias("x")).where("lane < 0 OR x <> 0")
    entry = F.struct("lane", "x")
    own = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("lane") < 0, entry)), asc=False).alias("p"), F.sort_array(F.collect_list(F.when(F.col("lane") >= 0, entry))).alias("l"))
    return own.select(*keys, F.struct(F.transform("p", lambda e: e["x"]).alias("parts"), F.map_from_entries("l").alias("lanes")).alias(vector))


def _key() -> Column:
    """Order by falling doc_id, null last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("id"), F.substring("text", 1, _KEY_CHARS).alias("head"))


def _cuts(keyed: DataFrame, pieces: int) -> DataFrame:
    """One row: sorted cut points of about ``pieces`` equal pieces, and every ``width``-th of them, from a bounded sample of the distinct keys."""
    keys = keyed.select(F.xxhash64("key").alias("h"), "key")
    total, expected = keyed.count(), SAMPLED * pieces
    if total > expected:
        keys = keys.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * expected / total))
    sample = keys.groupBy("key").agg(F.lit(1)).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    places = F.transform(F.sequence(F.lit(1), F.lit(pieces)), lambda i: F.floor(i * F.size("keys") / (pieces + 1)).cast("int"))
    return sample.select(F.filter(F.array_distinct(F.transform(places, lambda p: F.get("keys", p))), lambda c: c.isNotNull()).alias("cuts"))


def with_next(docs: DataFrame, columns: list[str], pieces: int | None = None) -> DataFrame:
    """``docs`` (doc_id long, text and others) with next_<column> for some columns: those of the row with the next smaller doc_id; after the last comes the first."""
    pieces = pieces or PIECES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, math.isqrt(pieces))
    keyed = docs.withColumn("key", _key())
    cuts = _cuts(docs.select("doc_id", "text").select(_key().alias("key")), pieces)
    cuts = materialise(cuts.select("cuts", F.filter("cuts", lambda _, i: i % width == width - 1).alias("coarse")), "piece-cuts")

    def placed(d: DataFrame) -> DataFrame:
        d = d.join(F.broadcast(cuts), how="cross")  # one row, of at most ``pieces`` keys
        d = d.withColumn("at", F.size(F.filter("coarse", lambda c: c <= F.col("key"))) * width)
        inside = F.slice("cuts", F.col("at") + 1, F.lit(width))
        return d.withColumn("piece", F.col("at") + F.size(F.filter(inside, lambda c: c <= F.col("key")))).drop("cuts", "coarse", "at")

    # at most pieces + 1 rows; the piece before the first one is the last
    firsts = placed(docs.select("doc_id", "text").select(_key().alias("key"))).groupBy("piece").agg(F.min("key").alias("first"))
    ahead = Window.orderBy("piece")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("piece").over(ahead), F.max("piece").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    firsts = materialise(firsts.withColumnRenamed("piece", "of"), "piece-firsts")
    d = placed(keyed)
    d = d.join(F.broadcast(firsts), F.col("piece") == F.col("of"))
    own = F.struct("piece", F.lit(0).alias("guest"))
    d = d.withColumn("e", F.explode(F.when(F.col("key") == F.col("first"), F.array(own, F.struct(F.col("before").alias("piece"), F.lit(1).alias("guest")))).otherwise(F.array(own))))
    w = Window.partitionBy("e.piece").orderBy("e.guest", "key", "text")
    d = d.select(*docs.columns, "key", "e", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return d.where("e.guest = 0").select(*docs.columns, *(f"next_{c}" for c in columns))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, text (empty for null), vector."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return with_vector(d, "text", "vector")


def op13(docs: DataFrame) -> DataFrame:
    d = with_next(fingerprinted(docs), ["text", "vector"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "edited", "vector", "next_vector")
    d = with_vector(d, "edited", "edited_vector")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text_form(F.col("vector")).alias("fingerprint"), text_form(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def oracle(docs: str = "documents") -> str:
    words = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS w{k}" for k in range(WORDS))
    digests = lambda column: f"""
 (SELECT row, {words} FROM (SELECT row, md5(p) AS h FROM
   (SELECT row, unnest(string_split(regexp_replace({column}, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10))) AS p FROM e) WHERE p <> ''))"""  # noqa: E731
    lanes = lambda of: f"(SELECT row, w0 & {LANES - 1} AS lane, count(*) AS n FROM {of} GROUP BY ALL)"
    parts = " || ".join(f"printf('%08x', (sum(w{k}) % {_MODULUS})::BIGINT)" for k in range(WORDS))
    form = lambda d, of: f"""
 (SELECT row, parts || own AS form, n, size FROM (SELECT row, {parts} AS parts FROM {d} GROUP BY row) JOIN
   (SELECT row, string_agg(printf('%03x%08x', lane, n), '' ORDER BY lane) AS own, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS size FROM {of} GROUP BY row) USING (row))"""  # noqa: E731
    like = lambda a, b, dot: f"""
 CASE WHEN coalesce({a}.n, 0) + coalesce({b}.n, 0) = 0 THEN 1.0 WHEN {a}.n IS NULL OR {b}.n IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 2 * (coalesce({dot}, 0) - {a}.n * {b}.n / {LANES})
  / (({a}.size - {a}.n * {a}.n / {LANES}) + ({b}.size - {b}.n * {b}.n / {LANES})))) END::DOUBLE"""  # noqa: E731
    empty = "0" * 8 * WORDS
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS row FROM {docs}),
n AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, coalesce(lead(row) OVER o, 1) AS next_row FROM d WINDOW o AS (ORDER BY row)),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
da AS {digests("text")}, db AS {digests("edited")}, la AS {lanes("da")}, lb AS {lanes("db")}, a AS {form("da", "la")}, b AS {form("db", "lb")},
xb AS (SELECT la.row, sum(la.n * lb.n)::DOUBLE AS x FROM la JOIN lb USING (row, lane) GROUP BY ALL),
xc AS (SELECT e.row, sum(la.n * lc.n)::DOUBLE AS x FROM e JOIN la ON la.row = e.row JOIN la AS lc ON lc.row = e.next_row AND lc.lane = la.lane GROUP BY ALL)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, coalesce(a.form, '{empty}') AS fingerprint, coalesce(b.form, '{empty}') AS edited_fingerprint,
       {like("a", "b", "xb.x")} AS near_edited, {like("a", "c", "xc.x")} AS near_next
FROM e LEFT JOIN a ON a.row = e.row LEFT JOIN b ON b.row = e.row LEFT JOIN a AS c ON c.row = e.next_row LEFT JOIN xb ON xb.row = e.row LEFT JOIN xc ON xc.row = e.row
"""


ORACLE = oracle()
