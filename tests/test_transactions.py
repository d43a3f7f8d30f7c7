"""The ingest as one transaction, cells by signed deltas, rejected rows."""

import random

import pytest
from pyspark.sql import functions as F
from test_rules import rows
from test_streams import check, decoded, pages, record

from matchstats.operators import ingest
from matchstats.sources import replays
from matchstats.streaming import ingest as stream
from matchstats.streaming import ledger


def ids(spark, tables):
    d = tables.battles(spark)
    return [] if d is None else sorted(r.battle_id for r in d.collect())


def run(spark, tmp_path, name, lists, tables, checkpoint):
    folder = tmp_path / name
    folder.mkdir()
    stream.start_ingest(replays.read_battle_stream(spark, pages(folder, lists)), tables, str(tmp_path / checkpoint)).awaitTermination()


def test_new_checkpoints_replace_nothing(spark, tmp_path):
    """Batch numbers start at 0 with each checkpoint, and with each query."""
    tables = stream.Tables(str(tmp_path / "tables"))
    run(spark, tmp_path, "one", [[record("a", 100)], [record("b", 110)]], tables, "c1")
    run(spark, tmp_path, "two", [[record("c", 120)], [record("b", 110)]], tables, "c2")
    assert ids(spark, tables) == ["a", "b", "c"]
    stream.refresh(spark, tables, now=0, cooldown=0)
    check(spark, tables)
    stream.compact(spark, tables)
    assert tables.view(spark).state and len(tables.view(spark).battles) == 1
    run(spark, tmp_path, "three", [[record("d", 130, p1=7)], [record("a", 100)]], tables, "c3")
    assert ids(spark, tables) == ["a", "b", "c", "d"]
    stream.refresh(spark, tables, now=1, cooldown=0)
    check(spark, tables)
    stream.compact(spark, tables)
    check(spark, tables)
    # each stream is known by its own id
    assert sorted(tables.view(spark).done.values()) == [[[0, 1]]] * 3


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", range(7))
def test_a_crash_between_writes_leaves_nothing(spark, tmp_path, monkeypatch, step):
    """A batch that dies at any write is not there at all; done again, it is there once."""
    tables = stream.Tables(str(tmp_path / "tables"))
    stream.ingest_batch(decoded(spark, [record("a", 100)]), 0, tables)
    stream.refresh(spark, tables, now=0, cooldown=0)
    before, at = rows(stream.summary(spark, tables), "total_ranked_replays", "total_players"), [0]

    def crashing(call):
        def run_(*args, **kw):
            if at[0] == step:
                raise Crash
            at[0] += 1
            return call(*args, **kw)

        return run_

    batch = decoded(spark, [record("b", 110, p1=9), record("c", 90, battle_type=9)])
    with monkeypatch.context() as m:
        # folders of battles, ids, state, matchups and rejected rows; the record itself, before and after it is there
        m.setattr(ledger.Ledger, "new_folder", crashing(ledger.Ledger.new_folder))
        m.setattr(ledger.Ledger, "commit", crashing(ledger.Ledger.commit) if step == 5 else ledger.Ledger.commit)
        if step == 6:
            m.setattr(ledger.Ledger, "commit", lambda *a: (_ for _ in ()).throw(Crash))
        with pytest.raises(Crash):
            stream.ingest_batch(batch, 1, tables)
    assert ids(spark, tables) == ["a"] and rows(stream.summary(spark, tables), "total_ranked_replays", "total_players") == before and tables.rejects(spark) is None
    check(spark, tables)
    for _ in range(2):
        stream.ingest_batch(batch, 1, tables)
    assert ids(spark, tables) == ["a", "b"] and tables.rejects(spark).count() == 1
    stream.refresh(spark, tables, now=0, cooldown=0)
    check(spark, tables)
    # what the dead batch wrote is removed, and nothing else
    named = tables.view(spark).folders()
    gone = stream.vacuum(spark, tables, grace=0, now=4e9)
    assert gone and not named & set(gone)
    check(spark, tables)


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """A batch that was prepared while another one came in is prepared again: a battle of both is stored once."""
    tables, real, first = stream.Tables(str(tmp_path / "tables")), stream._written, []

    def slow(batch, batch_id, *rest):
        out = real(batch, batch_id, *rest)
        if not first:
            first.append(True)
            stream.ingest_batch(decoded(spark, [record("a", 100), record("b", 110)]), 0, tables, stream="other")
        return out

    monkeypatch.setattr(stream, "_written", slow)
    stream.ingest_batch(decoded(spark, [record("b", 110), record("c", 120)]), 0, tables, stream="one")
    assert [r.battle_id for r in tables.battles(spark).orderBy("battle_id").collect()] == ["a", "b", "c"]
    stream.refresh(spark, tables, now=0, cooldown=0)
    check(spark, tables)


def test_compaction_beside_ingest(spark, tmp_path, monkeypatch):
    """A batch that comes in while a snapshot is made is merged after it."""
    tables = stream.Tables(str(tmp_path / "tables"))
    for k in range(3):
        stream.ingest_batch(decoded(spark, [record(f"a{k}", 100 + k)]), k, tables)
    stream.refresh(spark, tables, now=0, cooldown=0)
    real = ledger.Ledger.commit

    def late(self, entry, *rest):
        if entry["kind"] == "compact" and not tables.view(spark).has("", 9):
            stream.ingest_batch(decoded(spark, [record("late", 500, p1=4, gv=10101)]), 9, tables)
        return real(self, entry, *rest)

    monkeypatch.setattr(ledger.Ledger, "commit", late)
    stream.compact(spark, tables)
    assert len(tables.view(spark).deltas) == 1
    assert stream.refresh(spark, tables, now=1, cooldown=0) == [10101]
    check(spark, tables)


def player(n, at, p, region, gv, chara=21, rank=16, winner=1):
    return record(n, at, winner=winner, p1=p, p2=900, gv=gv, p1_region_id=region, p1_chara_id=chara, p1_rank=rank)


def test_cells_follow_a_player(spark, tmp_path):
    """A move of region reaches the cells of all versions; a change of rank or main character the right ones; late battles too."""
    tables = stream.Tables(str(tmp_path / "tables"))
    batches = [
        [player("a", 100, 1, 3, 10101), player("b", 110, 1, 3, 20001), player("c", 120, 2, 3, 10101)],
        [player("d", 200, 1, 4, 20001)],  # player 1 moves: both versions
        [player("e", 210, 1, 4, 20001, chara=30, rank=25)],  # another main character in 20001
        [player("f", 50, 1, 3, 20001, chara=21, rank=29)],  # late: counts only
        [player("g", 220, 2, None, 10101, rank=12)],  # another rank; an unknown region does not replace a known one
        [player("h", 300, 3, None, 20002)],  # no region: in no cell
        [player("i", 310, 3, 1, 10101)],  # now known: 20002 gets it too
    ]
    want = [[10101, 20001], [10101, 20001], [20001], [20001], [10101], [20002], [10101, 20002]]
    for k, batch in enumerate(batches):
        stream.ingest_batch(decoded(spark, batch), k, tables)
        assert set(stream.refresh(spark, tables, now=k, cooldown=0)) == set(want[k])
        check(spark, tables)
        if k in (2, 5):
            stream.compact(spark, tables)


def test_random_batches(spark, tmp_path):
    rng, tables = random.Random(3), stream.Tables(str(tmp_path / "tables"))
    made = [player(f"m{k}", rng.randrange(1000), rng.randrange(8), rng.choice([None, 1, 2, 3]), rng.choice([10101, 20001, 20002]), rng.choice([20, 21, 22]), rng.randrange(10, 30), rng.randrange(3)) for k in range(60)]
    rng.shuffle(made)
    for k in range(5):
        stream.ingest_batch(decoded(spark, made[12 * k : 12 * k + 12] + made[:3]), k, tables)
        if k != 1:  # two batches wait for one refresh
            stream.refresh(spark, tables, now=k, cooldown=0)
            check(spark, tables)
        if k % 2:
            stream.compact(spark, tables)
    assert len(ids(spark, tables)) == 60


def test_a_refresh_reads_players_that_changed(spark, tmp_path):
    tables = stream.Tables(str(tmp_path / "tables"))
    stream.ingest_batch(decoded(spark, [record(f"a{p}", 100 + p, p1=p, p2=p + 1000) for p in range(200)]), 0, tables)
    stream.refresh(spark, tables, now=0, cooldown=0)
    stream.compact(spark, tables)
    stream.ingest_batch(decoded(spark, [record("z", 999, p1=5, p2=6)]), 1, tables)
    view = tables.view(spark)
    moved = stream.moved_players(spark, tables, view)
    assert {r.player_id[-1] for r in moved.ids.collect()} == {"5", "6"}
    now = stream.current_state(spark, tables, view, players=moved)
    assert {r.player_id for r in now.collect()} == {f"{p:018d}" for p in (5, 6)}
    # of the snapshot, only parts of these players are read
    assert len(moved.parts) <= 2 and "PartitionFilters: [part#" in " ".join(now._jdf.queryExecution().executedPlan().toString().split())


def test_rejected_rows(spark, tmp_path):
    tables = stream.Tables(str(tmp_path / "tables"))
    bad = [record("x", 1, battle_type=9), record("y", 2, p1_user_id=None), record(" ", None), record("z", 3, p2_user_id="  ", battle_type=77)]
    batch = decoded(spark, [record("a", 100), *bad, record("n", 4, battle_type=None)])
    stream.ingest_batch(batch, 0, tables)
    assert ids(spark, tables) == ["a", "n"]
    got = {r.battle_id: r.failed for r in tables.rejects(spark).collect()}
    assert got == {"x": ["known(battle_type)"], "y": ["not_null(player1_id)"], " ": ["not_null(battle_id)", "not_null(battle_at)"], "z": ["not_null(player2_id)", "known(battle_type)"]}
    # as the report over the raw rows counts them, blank ids being nulls
    plain = batch.select(*(F.when(F.trim(c) != "", F.col(c)).alias(c) if c.endswith("_id") and "character" not in c else F.col(c) for c in stream.REQUIRED), "battle_type")
    report = {r.constraint_name: r.violations for r in ingest.constraint_report([("b", plain, "not_null", stream.REQUIRED)]).collect()}
    report["known(battle_type)"] = ingest.known_battle_types(plain.where("battle_type IS NOT NULL"))[1].count()
    assert {r.constraint_name: r.violations for r in stream.rejected_counts(spark, tables).collect()} == report
    # the stream's own progress tells them too
    made = stream.start_ingest(replays.read_battle_stream(spark, pages(tmp_path, [[record("b", 5), *bad]])), tables, str(tmp_path / "c"))
    made.awaitTermination()
    assert made.lastProgress["observedMetrics"]["ingest"]["rejected"] % 4 == 0 and ids(spark, tables) == ["a", "b", "n"]


def test_lookup_reads_folders_of_its_days(spark, tmp_path):
    """With a horizon, what a batch is compared with does not grow with the days that are stored."""
    tables, day = stream.Tables(str(tmp_path / "tables")), 86400
    for k in range(6):
        stream.ingest_batch(decoded(spark, [record(f"a{k}", 1000 + k * day)]), k, tables, horizon=3600)
    view = tables.view(spark)
    assert len(stream._near(view, (5, 5))) == 1 and len(view.battles) == 6
    stream.ingest_batch(decoded(spark, [record("a5", 1000 + 5 * day), record("b", 1010 + 5 * day)]), 6, tables, horizon=3600)
    assert ids(spark, tables) == ["a0", "a1", "a2", "a3", "a4", "a5", "b"]


def test_refresh_on_a_trigger(spark, tmp_path):
    tables = stream.Tables(str(tmp_path / "tables"))
    stream.ingest_batch(decoded(spark, [record("a", 100)]), 0, tables)
    q = stream.start_refresh(spark, tables, every="1 second")
    try:
        for _ in range(120):
            if tables.view(spark).fresh:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    check(spark, tables)
    assert stream.pending_versions(spark, tables)[0] == []


def test_records_come_once(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path))
    entry = {"kind": "refresh", "cells": {}, "fresh": 0, "at": None}
    assert book.commit(entry, 0, set()) == 1 and book.commit(entry, 0, {"ingest"}) == 2
    with pytest.raises(ledger.Conflict):
        book.commit(entry, 1, {"refresh"})
    book.store_view()
    assert book.commit(entry, 2, {"refresh"}) == 3 and book.view().number == 3
    book.vacuum(now=4e9, grace=0)
    assert book._numbers("records") == [2, 3] and book.view().number == 3
