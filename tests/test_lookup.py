"""Ids of a micro-batch are looked up by digest; matchups are kept up by deltas."""

import pytest
from pyspark.sql import functions as F
from test_rules import rows
from test_streams import check, decoded, record
from test_transactions import ids

from matchstats.operators import players
from matchstats.streaming import ingest as stream
from matchstats.streaming import ledger


def rows_read(df):
    """Rows that the scans of a plan without a shuffle put out."""
    df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(scans.apply(k).metrics().apply("numOutputRows").value() for k in range(scans.size()))


def digests(spark, names):
    return sorted(r[0] for r in spark.createDataFrame([(n,) for n in names], "battle_id string").select(stream._digest()).collect())


def test_a_lookup_reads_as_much_from_a_larger_table(spark, tmp_path):
    tables, read = stream.Tables(str(tmp_path)), {}
    wanted = digests(spark, [*(f"new{k}" for k in range(20)), "7", "8"])
    for n in (100_000, 200_000, 400_000):
        stream._write_ids(spark.range(n).select(F.col("id").cast("string").alias("battle_id")).select(stream._digest().alias("digest"), "battle_id"), f"{tmp_path}/ids/{n}")
        view = ledger.View(ids=[[f"ids/{n}", 0, n]], ranked=n)
        with stream._exact_filters(spark):
            found = stream.stored_ids(spark, tables, view, wanted)
            read[n] = rows_read(found)
        assert {r.battle_id for r in found.collect()} == {"7", "8"}
    assert max(read.values()) <= 22 * stream.PAGE, read
    # a filter that is not exact reads (nearly) all
    assert rows_read(stream.stored_ids(spark, tables, view, wanted)) > 300_000


@pytest.mark.parametrize("lookup", [0, 3, 5000])
def test_lookups_of_every_kind_store_the_same(spark, tmp_path, monkeypatch, lookup):
    """Batches below and above the bound of a lookup, filters of several lists, ids that differ in spelling."""
    monkeypatch.setattr(stream, "LOOKUP", lookup)
    monkeypatch.setattr(stream, "FILTER", 2)
    tables = stream.Tables(str(tmp_path / "tables"))
    batches = [["a", "b", "c", "d", "e"], ["b", "f"], [], ["a", "A", "f", "f"], ["c", "g", "h", "i", "j"], ["h"]]
    for k, names in enumerate(batches):
        # a repeated battle counts as stored whatever its time is
        stream.ingest_batch(decoded(spark, [record(n, 100 + k * 100_000) for n in names] or [record("x", 1, battle_type=9)]), k, tables)
        if k in (1, 4):
            stream.refresh(spark, tables, now=k, cooldown=0)
            stream.compact(spark, tables)
    assert ids(spark, tables) == sorted({n for b in batches for n in b})
    stream.refresh(spark, tables, now=9, cooldown=0)
    check(spark, tables)


def test_battles_without_listed_ids(spark, tmp_path, monkeypatch):
    """Tables that an earlier form wrote: ids are looked up among the battles themselves."""
    tables = stream.Tables(str(tmp_path / "tables"))
    with monkeypatch.context() as m:
        real = ledger.Ledger.commit
        m.setattr(ledger.Ledger, "commit", lambda self, entry, *rest: real(self, {k: v for k, v in entry.items() if k not in ("ids", "matchups")}, *rest))
        stream.ingest_batch(decoded(spark, [record("a", 100), record("b", 110)]), 0, tables)
    assert stream.stored_ids(spark, tables, tables.view(spark)) is None
    for k in (1, 2):
        stream.ingest_batch(decoded(spark, [record("a", 100), record(f"c{k}", 120)]), k, tables)
    assert ids(spark, tables) == ["a", "b", "c1", "c2"]


def test_folding_leaves_few_folders():
    """Each id is folded a logarithmic number of times."""
    held, moved = [], 0
    for batch in range(1, 513):
        held.append([f"b{batch}", batch, 100])
        if batch % 4 == 0:
            folded = stream._folding(held)
            moved += sum(i[2] for i in folded)
            held = [*(i for i in held if i not in folded), [f"f{batch}", 0, sum(i[2] for i in folded)]]
            assert len(held) <= 10
    assert sum(i[2] for i in held) == 51_200 and moved <= 10 * 51_200
    assert stream._folding([["a", 0, 5]]) == [] == stream._folding([["a", 3, 5]])


def test_matchups_of_some_players(spark, tmp_path):
    tables = stream.Tables(str(tmp_path / "tables"))
    made = [record(f"a{k}", 100 + k, p1=k % 5, p2=k + 1000, winner=k % 3) for k in range(60)]
    stream.ingest_batch(decoded(spark, made[:40]), 0, tables)
    stream.refresh(spark, tables, now=0, cooldown=0)
    stream.compact(spark, tables)
    stream.ingest_batch(decoded(spark, made[40:]), 1, tables)
    stream.refresh(spark, tables, now=1, cooldown=0)
    check(spark, tables)
    some = stream.some_players(spark.createDataFrame([(f"{1:018d}",), (f"{3:018d}",), ("nobody",)], "player_id string"))
    got = players.rated(stream.current_matchups(spark, tables, players=some))
    assert {(r.player_id[-1], r.wins + r.losses, r.total) for r in got.collect()} == {("1", 12, 12), ("3", 12, 12)}
    assert "PartitionFilters: [part#" in " ".join(got._jdf.queryExecution().executedPlan().toString().split())
    assert rows(stream.current_matchups(spark, tables), "player_id") and stream.current_matchups(spark, stream.Tables(str(tmp_path / "none"))) is None
