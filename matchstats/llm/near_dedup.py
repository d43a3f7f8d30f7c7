"""Near duplicates by bottom-k sketches from one hash function.

1. Sets. Each text becomes the set of its distinct word shingles, hashed to 63 bits; the ``k`` smallest
   values are its sketch. Rows with equal sets are one node, which has a number of its own; the smallest
   doc_id of its rows is only an attribute.
2. Inverted lists. Two sets of Jaccard ``t`` share at least ``m`` sketch values (all but one in a million
   such pairs, and all where both sketches are whole sets); so, with values ordered from the rarest to
   the most frequent, the first ``len - m + 1`` values of both have one in common. Only those are kept
   in inverted lists, so very frequent values hardly ever are.
3. Overlaps. Each list names a random member as its hub and pairs the others with it: as many pairs as
   rows. A 256-bit parity signature of the sketch bounds the overlap of a pair from above and drops
   most pairs inside the join (it never drops a pair of m shared values). The Jaccard estimate from
   the union sketch filters the rest; exact Jaccard of the whole sets verifies what is left.
4. Groups. Components of the verified links are found. A list whose members are now all in one
   component is done. In the other short lists, pairs of different components are tested in the same
   way, so no link between different components is missed.
5. Long lists. Lists that have members in common form a neighbourhood. Its sets are compared with its majority set
   M (shingles of more than half of its members), of which near copies differ in few shingles: let D(x)
   be the symmetric difference of x and M. Then x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
   shingles, and with ``excess(x) = (100 + percent) |D(x)| - (100 - percent) |x|`` they are linked
   exactly if ``excess(x) + excess(y) <= 2 (100 + percent) |D(x) & D(y)|``. Where the left side is not
   above zero, the member of least excess is linked with both: one pair a member settles all of those.
   Other partners share so many elements of D that one is among the first few of both, in order of
   rarity; lists of these elements first pair each member with one hub, and only what is then in
   different components meets again, the members outside a neighbourhood's largest component with all.
   A parity signature bounds the difference of a pair from below inside the join, so hardly any pair
   that is not a link is written; what is written is verified exactly.

Cases: null, empty or blank text has an empty set and is linked with nothing; a text of fewer words than
a shingle is one shingle; a null doc_id sorts last and comes back as null; rows that repeat a doc_id, or
have none, are linked by their texts alone; a verdict goes by doc_id and text, so that only rows equal in
both share it; a group of null ids alone has a null component_id and one text that is kept; an empty table
gives an empty result; a text of any length is taken whole; other columns of the input do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NOT_SPACE, first_rows, fresh, joined, materialise, shingle_hashes, python_workers, texts_of, word_hashes
from .components import components

#: Sketch size, and the odds against a pair at the threshold sharing fewer than ``least_shared`` values.
K, MISSED = 48, 1e-6
#: Lists with more members than this are settled in step 5.
LONG_LIST = 64
#: Elements that more than one in OFTEN members have come last in every member's order; so many of all places may be broadcast (8 bytes each).
OFTEN, OFTEN_SHINGLES = 32, 1_000_000
_SIG = ["s0", "s1", "s2", "s3"]
#: Parity signature of a member's difference from the majority set.
_PAR = [f"p{i}" for i in range(16)]


def least_shared(k: int, percent: int, missed: float = MISSED) -> int:
    """Largest m with P(Binomial(k, percent / 100) < m) <= missed."""
    p, total, m = percent / 100, 0.0, 0
    while m < k:
        total += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if total > missed:
            break
        m += 1
    return max(m, 1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a whole text."""
    return np.unique(shingle_hashes(word_hashes(text), size) >> np.uint64(1)).astype(np.int64)


def set_key(s: np.ndarray) -> bytes | None:
    """128-bit digest of a set, None if it is empty."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _sketcher(size: int, k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, key, sketch, sig = [], [], [], []
            for text in texts_of(batch.column(2)):
                s = shingle_set(text, size)
                n.append(len(s))
                key.append(set_key(s))
                sketch.append(s[:k])
                odd = np.bincount(s[:k] & 255, minlength=256).astype(np.uint8) & 1
                sig.append(np.packbits(odd).view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
            flat = np.concatenate(sketch) if sketch else np.zeros(0, dtype=np.int64)
            bits = np.array(sig, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), *(pa.array(bits[:, i]) for i in range(4))],
                names=["id", "th", "n", "key", "sketch", *_SIG],
            )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """id, th (hash of the text), text of each row: id and th together say which text it is, also where ids are null or repeat."""
    return docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("text"))


def _place(*more: str) -> Column:
    """Order by id, null last, then by ``more``."""
    return F.struct(F.col("id").isNull().alias("none"), "id", *more)


def sketches(docs: DataFrame, size: int, k: int = K) -> DataFrame:
    """id, th, n, key (128-bit digest of the set, null if empty), sketch, parity signature of each row."""
    python_workers(docs.sparkSession)
    return _texts(docs).mapInArrow(_sketcher(size, k), "id long, th long, n long, key binary, sketch array<long>, s0 long, s1 long, s2 long, s3 long")


class _Search:
    """Candidate search and verification for one threshold."""

    def __init__(self, docs: DataFrame, size: int, percent: int, k: int):
        self.docs, self.size, self.percent, self.k = docs, size, percent, k
        self.m = least_shared(k, percent)

    def shared(self, n: Column) -> Column:
        """Sketch values that a set of n shingles shares at least with any partner."""
        whole = n <= self.k * self.percent // 100
        return F.when(whole, F.ceil(n * self.percent / 100)).otherwise(F.lit(self.m)).cast("int")

    def sized(self, n: Column, o: Column) -> Column:
        return (100 * n >= self.percent * o) & (100 * o >= self.percent * n)

    def likely(self, a: str, b: str) -> Column:
        """Sizes allow the threshold, and the parity signatures allow the shared values."""
        n, o = F.col(f"{a}.n"), F.col(f"{b}.n")
        differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SIG), F.lit(0))
        most = F.least(n, F.lit(self.k)) + F.least(o, F.lit(self.k)) - 2 * F.greatest(self.shared(n), self.shared(o))
        return self.sized(n, o) & (differ <= most)

    def ranked(self, nodes: DataFrame) -> DataFrame:
        """node, id, n, signature, vs: the rarest shared values of each node."""
        values = nodes.select("node", F.explode("sketch").alias("v"))
        often = materialise(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "value-counts")
        by_node = values.join(often, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
        d = by_node.join(nodes.select("node", "id", "n", *_SIG), "node")
        # values that only one document has come first in its order and pair with nothing
        base = F.size("vs") - self.shared(F.col("n")) + 1
        d = d.where(base > 0).withColumn("base", base)
        return d.withColumn("vs", F.transform(F.slice("vs", F.lit(1), F.col("base")), lambda e: e["v"])).drop("base")

    def links(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the threshold: union-sketch estimate first, exact Jaccard after."""
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        own = nodes.select("node", "n", "sketch")
        d = pairs.join(own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        d = d.join(own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.k)
        both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
        whole = F.greatest("na", "nb") <= self.k * self.percent // 100
        d = d.where(both >= F.when(whole, F.ceil(F.greatest("na", "nb") * self.percent / 100)).otherwise(F.least(F.lit(self.m), F.col("na"), F.col("nb"))))
        d = materialise(d.select("a", "b"), "likely-pairs")
        ids = materialise(d.select(F.col("a").alias("node")).unionByName(d.select(F.col("b").alias("node"))).distinct(), "likely-nodes")
        sets = self.sets(ids, nodes)
        d = d.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
        same = F.size(F.array_intersect("ha", "hb"))
        return d.where(100 * same >= self.percent * (F.size("ha") + F.size("hb") - same)).select("a", "b").distinct()

    def sets(self, ids: DataFrame, nodes: DataFrame) -> DataFrame:
        """Written table of node, hashes (the whole set) of the nodes in a written table of them, one row each.

        The text of a node is found by the id and the text hash of one of its rows; its set has to have the node's key.
        """
        size = self.size
        of = materialise(joined(nodes.select("node", F.col("id").alias("of_id"), F.col("th").alias("of_th"), "key"), ids, ["node"], "left_semi"), "set-nodes")

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                node, own = [], []
                for at, key, text in zip(batch.column(0), batch.column(1), texts_of(batch.column(2))):
                    found = shingle_set(text, size)
                    if set_key(found) == key.as_py():
                        node.append(at.as_py())
                        own.append(found)
                at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "hashes"])

        n = of.count()
        here = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))
        texts = _texts(self.docs).join(F.broadcast(of) if n <= BROADCAST_ROWS else of, here).select("node", "key", "text")
        found = materialise(texts.mapInArrow(run, "node long, hashes array<long>"), "whole-sets")
        # rows that repeat both doc_id and text give the same set
        return found if found.count() == n else materialise(found.groupBy("node").agg(F.first("hashes").alias("hashes")), "whole-sets")


def _hub_pairs(s: _Search, lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's hub, a random member: as many pairs as rows."""
    first = F.struct(F.xxhash64("id", "v").alias("at"), "node")
    hubs = lists.groupBy("v").agg(F.min_by(F.struct("node", "n", *_SIG), first).alias("member"), F.count("*").alias("size")).where("size > 1")
    hubs = materialise(hubs.select("v", "member.*"), "hubs")
    at = (F.col("x.v") == F.col("h.v")) & (F.col("x.node") != F.col("h.node")) & s.likely("x", "h")
    return lists.alias("x").join(hubs.alias("h"), at).select(F.col("x.node").alias("a"), F.col("h.node").alias("b"))


def _cross_pairs(s: _Search, lists: DataFrame) -> DataFrame:
    """Pairs of different components that share a list."""
    at = (F.col("x.v") == F.col("y.v")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & s.likely("x", "y")
    return lists.alias("x").join(lists.alias("y"), at).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (node) with the component of each node, itself if it is linked with none."""
    d = rows.drop("component").join(known, "node", "left")
    return d.withColumn("component", F.coalesce("component", "node"))


def _open_lists(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Written table of the lists with the components of their members; each row says how many members its list has, and whether they are of two components or more."""
    lists = materialise(_placed(lists, known), "placed-lists")
    stats = materialise(lists.groupBy("v").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")), "list-sizes")
    return materialise(lists.join(stats, "v").withColumn("open", F.col("low") < F.col("high")).drop("high"), "open-lists")


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component that a written table (component, label) gives in its place, its own if it gives none."""
    return joined(rows, labels, ["component"], "left").withColumn("component", F.coalesce("label", "component")).drop("label")


class _Neighbourhoods:
    """Step 5: the links that the members of long lists have beyond known ones.

    ``long``: rows (v, node, component, low) of the long lists, ``low`` the smallest component of the list. Components of one
    label are connected, never the other way round: labels save pairs, the components of all links are found at the end.
    """

    def __init__(self, s: _Search, nodes: DataFrame, long: DataFrame):
        self.s, self.unit, self.free = s, 100 + s.percent, 100 - s.percent
        spread = components(materialise(long.select(F.col("component").alias("a"), F.col("low").alias("b")).distinct(), "list-links"))
        own = materialise(long.select("node", "component").distinct(), "long-nodes")
        own = joined(own, materialise(spread.select(F.col("node").alias("component"), F.col("component").alias("place")), "places"), ["component"], "inner")
        own = materialise(own, "long-places")
        sets = joined(s.sets(own.select("node"), nodes), own, ["node"], "inner")
        self.parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.differing(materialise(sets, "place-sets"))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The rows dealt out evenly before their arrays are exploded: the members of a place, or its long ones, may lie together."""
        return rows.repartition(self.parts)

    def counted(self, sets: DataFrame) -> DataFrame:
        """Written table of place, u, df, members: how many of the place's sets have a shingle, where more than one has it."""
        sizes = materialise(sets.groupBy("place").agg(F.count("*").alias("members")), "place-sizes")
        each = self.dealt(sets.select("place", "hashes")).select("place", F.explode("hashes").alias("u"))
        each = each.groupBy("place", "u").agg(F.count("*").alias("df")).where("df > 1")
        return materialise(joined(each, sizes, ["place"], "inner"), "place-shingles")

    def often(self, counts: DataFrame) -> DataFrame:
        """Written table of place and ``often``: the elements in ``counts`` (place, u, df), the rarest first."""
        d = counts.groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "u"))), lambda x: x["u"]).alias("often"))
        return materialise(d, "often-shingles")

    def often_differing(self, able: DataFrame) -> DataFrame:
        """``often`` of the elements that are in the differences of more than one in OFTEN as many members as the place has in ``able``.

        Counted over all members of the place, which the counts of the sets tell: nothing is exploded again. Any one order of a
        place's elements finds the same pairs; this one keeps the lists short. All arrays beside the members that are able have at most OFTEN times the elements of all differences.
        """
        sizes = materialise(able.groupBy("place").agg(F.count("*").alias("able")), "able-sizes")
        most = 2 * F.col("df") > F.col("members")
        d = self.counts.withColumn("df", F.when(most, F.col("members") - F.col("df")).otherwise(F.col("df"))).where("df > 1")
        return self.often(joined(d, sizes, ["place"], "inner").where(OFTEN * F.col("df") > F.col("able")))

    def beside(self, rows: DataFrame, often: DataFrame) -> DataFrame:
        """``rows`` with the array of their place, broadcast if all are small."""
        size = often.agg(F.coalesce(F.sum(F.size("often")), F.lit(0))).first()[0]
        d = rows.join(F.broadcast(often) if size <= OFTEN_SHINGLES else often, "place", "left")
        return d.withColumn("often", F.coalesce("often", F.array().cast("array<long>")))

    def differing(self, sets: DataFrame) -> None:
        """Written tables ``self.counts`` and ``self.members``: node, place, component, n, delta (difference from the majority set), excess."""
        self.counts = self.counted(sets)
        d = self.beside(sets, self.often(self.counts.where("2 * df > members")))
        d = d.withColumn("delta", F.concat(F.array_except("hashes", "often"), F.array_except("often", "hashes"))).withColumn("n", F.size("hashes"))
        d = d.withColumn("excess", (self.unit * F.size("delta") - self.free * F.col("n")).cast("long"))
        self.members = materialise(d.select("node", "place", "component", "n", "delta", "excess"), "place-members")

    def centre_links(self) -> tuple[DataFrame, DataFrame]:
        """The member of least excess of each place with those that it is linked with, whatever they share; and the labels of their components, the centre's."""
        d = self.members.select("node", "place", "component", "excess")
        least = materialise(d.groupBy("place").agg(F.min(F.struct("excess", "node", F.col("component").alias("label"))).alias("c")), "centres")
        d = joined(d, least, ["place"], "inner").where((F.col("excess") + F.col("c.excess") <= 0) & (F.col("node") != F.col("c.node")))
        d = materialise(d.select(F.col("node").alias("a"), F.col("c.node").alias("b"), "component", "c.label"), "centre-links")
        return d.select("a", "b"), materialise(d.groupBy("component").agg(F.min("label").alias("label")), "centre-labels")

    def entries(self, labels: DataFrame) -> DataFrame:
        """Written table of the lists of elements: place, u, node, component, n, excess, signature.

        A member has a row for each element of its prefix: so many of D, those that many have last, that it shares one with every partner.
        """
        d = materialise(_relabelled(self.members, labels), "placed-members")
        # the least excess of a partner: of the other components of the place
        each = materialise(d.groupBy("place", "component").agg(F.min("excess").alias("e")), "component-excess")
        first = each.groupBy("place").agg(F.min(F.struct("e", "component")).alias("first"), F.count("*").alias("components")).where("components > 1")
        first = materialise(first.select("place", "first.*").withColumnsRenamed({"e": "first", "component": "holder"}), "first-excess")
        second = joined(each, first, ["place"], "inner").where("component <> holder").groupBy("place", "first", "holder").agg(F.min("e").alias("second"))
        second = materialise(second, "second-excess")
        d = joined(d, second, ["place"], "inner")
        partner = F.when(F.col("component") == F.col("holder"), F.col("second")).otherwise(F.col("first"))
        by_excess = F.ceil((F.col("excess") + partner) / (2 * self.unit) - 1e-9)
        by_size = F.ceil(F.size("delta") - F.col("n") * self.free / self.s.percent - 1e-9)
        prefix = F.size("delta") - F.greatest(F.lit(1), by_excess, by_size) + 1
        d = materialise(d.withColumn("prefix", prefix.cast("int")).where("prefix > 0").select("place", "node", "component", "n", "excess", "prefix", "delta"), "able-members")
        d = self.beside(d, self.often_differing(d))
        us = F.concat(F.sort_array(F.array_except("delta", "often")), F.array_intersect("often", "delta"))
        d = d.select("place", "node", "component", "n", "excess", F.slice(us, F.lit(1), F.col("prefix")).alias("us"), "delta")
        kinds = "place long, node long, component long, n int, excess long, us array<long>"
        signed = d.mapInArrow(_parities, ", ".join([kinds, *(f"{c} long" for c in _PAR)]))
        return materialise(signed.select("place", "node", "component", "n", "excess", *_PAR, F.explode("us").alias("u")), "element-lists")

    def near(self, a: str, b: str) -> Column:
        """Different components, and the signatures do not show that the two differ in too many shingles."""
        x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        differ = sum((F.bit_count(x(p).bitwiseXOR(y(p))) for p in _PAR), F.lit(0))
        return (x("component") != y("component")) & self.s.sized(x("n"), y("n")) & (self.unit * differ <= self.free * (x("n") + y("n")))

    def hub_pairs(self, entries: DataFrame) -> DataFrame:
        """Each entry with its list's member of least excess."""
        hubs = entries.groupBy("place", "u").agg(F.min_by(F.struct("node", "component", "n", *_PAR), F.struct("excess", "node")).alias("member"))
        hubs = materialise(hubs.select("place", "u", "member.*"), "element-hubs")
        at = (F.col("x.place") == F.col("h.place")) & (F.col("x.u") == F.col("h.u")) & self.near("x", "h")
        return entries.alias("x").join(hubs.alias("h"), at).select(*_pair("x", "h"))

    def rest_pairs(self, entries: DataFrame) -> DataFrame:
        """Entries outside the largest component of their place with all of their list."""
        most = entries.groupBy("place", "component").agg(F.count("*").alias("c")).groupBy("place").agg(F.max_by("component", "c").alias("largest"))
        d = joined(entries, materialise(most, "largest-components"), ["place"], "inner")
        few = d.where(F.col("component") != F.col("largest"))
        once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
        at = (F.col("x.place") == F.col("y.place")) & (F.col("x.u") == F.col("y.u")) & once & self.near("x", "y")
        return few.alias("x").join(d.alias("y"), at).select(*_pair("x", "y"))

    def exact(self, pairs: DataFrame) -> DataFrame:
        """Written table of the pairs that reach the threshold, by their whole differences."""
        pairs = materialise(pairs.distinct(), "place-pairs")
        side = lambda c: self.members.select(F.col("node").alias(c), F.col("delta").alias(f"d{c}"), F.col("excess").alias(f"e{c}"))
        d = pairs.join(side("a"), "a").join(side("b"), "b")
        return materialise(d.where(F.col("ea") + F.col("eb") <= 2 * self.unit * F.size(F.array_intersect("da", "db"))).select(*pairs.columns), "place-links")

    def links(self) -> DataFrame:
        """The links (a, b) that are found."""
        found, labels = self.centre_links()
        entries = self.entries(labels)
        linked = self.exact(self.hub_pairs(entries))
        found = found.unionByName(linked.select("a", "b"))
        # a component takes the least label beside it
        both = linked.select(F.col("ca").alias("component"), F.col("cb").alias("label")).unionByName(linked.select(F.col("cb").alias("component"), F.col("ca").alias("label")))
        labels = materialise(both.groupBy("component").agg(F.min("label").alias("label")).select("component", F.least("label", "component").alias("label")), "hub-labels")
        linked = self.exact(self.rest_pairs(materialise(_relabelled(entries, labels), "labelled-entries")))
        return found.unionByName(linked.select("a", "b"))


def _pair(x: str, y: str) -> list[Column]:
    """a, b, ca, cb: the nodes of a pair, the smaller first, and their components."""
    swap = F.col(f"{x}.node") > F.col(f"{y}.node")
    pick = lambda c, p, q: F.when(swap, F.col(f"{q}.{c}")).otherwise(F.col(f"{p}.{c}"))
    return [pick("node", x, y).alias("a"), pick("node", y, x).alias("b"), pick("component", x, y).alias("ca"), pick("component", y, x).alias("cb")]


def _parities(batches: Iterator) -> Iterator:
    """Puts the parity signature of each row's ``delta`` in its place."""
    import pyarrow as pa

    bits = 64 * len(_PAR)
    for batch in batches:
        sig = np.zeros((batch.num_rows, len(_PAR)), dtype=np.int64)
        for k, d in enumerate(batch.column("delta")):
            odd = np.bincount(d.values.to_numpy() & (bits - 1), minlength=bits).astype(np.uint8) & 1
            sig[k] = np.packbits(odd).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(sig[:, i]) for i in range(len(_PAR)))], names=[*batch.schema.names[:-1], *_PAR])


def clusters(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """id, th (hash of the text), n (set size), component (smallest id of the group), kept of each row of ``docs`` (doc_id, text)."""
    s = _Search(docs, size, percent, k)
    rows = materialise(sketches(docs, size, k), "sketches")
    nodes = rows.where("n > 0").groupBy("key").agg(F.min(_place("th")).alias("first"), *(F.first(c).alias(c) for c in ("n", "sketch", *_SIG)))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "first.id", "first.th", "key", "n", "sketch", *_SIG)
    nodes = materialise(nodes, "nodes")
    ranked = materialise(s.ranked(nodes), "ranked-values")
    lists = materialise(ranked.select("node", "id", "n", *_SIG, F.explode("vs").alias("v")), "lists")
    found = materialise(s.links(_hub_pairs(s, lists), nodes), "hub-links")
    known = components(found)

    lists = _open_lists(lists, known).where("open")
    new = materialise(s.links(_cross_pairs(s, lists.where(F.col("size").between(3, LONG_LIST))), nodes), "cross-links")
    long = lists.where(F.col("size") > LONG_LIST)
    more = [new]
    if not long.isEmpty():
        more.append(materialise(_Neighbourhoods(s, nodes, long).links(), "long-links"))
    if not all(x.isEmpty() for x in more):
        known = components(reduce(DataFrame.unionByName, more, found))
    first = nodes.select("node", "id", "th").join(known, "node").groupBy("component").agg(F.min(_place("th")).alias("first"))
    first = materialise(first.select("component", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th")), "group-firsts")
    linked = materialise(joined(known, first, ["component"], "inner").select("node", "first_id", "first_th"), "linked-nodes")
    alone = F.col("first_th").isNull()
    of_key = nodes.select("key", "node", "id", "th").join(linked, "node", "left")
    of_key = of_key.select("key", F.when(alone, F.col("id")).otherwise(F.col("first_id")).alias("first_id"), F.coalesce("first_th", "th").alias("first_th"))
    of_key = materialise(of_key, "key-components")
    blank = F.col("n") == 0
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    return rows.select("id", "th", "n", "key").join(of_key, "key", "left").select("id", "th", "n", F.when(blank, F.col("id")).otherwise(F.col("first_id")).alias("component"), (blank | same).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    d = clusters(docs, size, percent, k)
    return d.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, size=2)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one row of each group.

    Rows go by (doc_id, text). Where repeated rows of one doc_id and text stay together, the first of them by other columns is kept, unless they are blank.
    """
    verdict = materialise(clusters(docs).where("n > 0").select("id", "th", "kept"), "near-verdict")
    gone = materialise(verdict.where(~F.col("kept")).select("id", "th").distinct(), "near-gone")
    twice = verdict.where("kept").groupBy("id", "th").count().where("count > 1")
    a, b = fresh("text_hash", docs), fresh("near_id", docs)
    d = docs.withColumn(a, F.xxhash64(docs["text"])).withColumn(b, docs["doc_id"].cast("long"))
    drop = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    d = d.join(drop, d[b].eqNullSafe(drop["id"]) & (d[a] == drop["th"]), "left_anti")
    if not twice.isEmpty():
        worded = F.coalesce(d["text"].rlike(NOT_SPACE), F.lit(False))
        return first_rows(d.where(worded), [a, b], docs.columns).unionByName(d.where(~worded).select(*docs.columns))
    return d.select(*docs.columns)
