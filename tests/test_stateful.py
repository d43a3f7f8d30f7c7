"""Streams with state: running statistics, users that leave, pages in both directions."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_rules import rows
from test_streams import STATE, record

from matchstats.operators import backfill, ingest, state
from matchstats.sources import replays
from matchstats.streaming import ingest as stream
from matchstats.streaming import stateful


@pytest.fixture
def state_store(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def message(folder, k, records):
    folder.mkdir(exist_ok=True)
    (folder / f"{k:03d}.json").write_text(json.dumps({"fetched_for": k, "value": json.dumps(records)}))


def test_running_stats(spark, tmp_path, state_store):
    """Rank, latest battle and counters are those of a batch, for shuffled batches and across a restart."""
    rng, out = random.Random(4), tmp_path / "out"
    made = [record(f"b{k}", rng.randrange(40), winner=rng.randrange(3), p1=rng.randrange(3), p2=7, gv=rng.choice([10101, 20001]), p1_rank=rng.randrange(30)) for k in range(60)]

    def run():
        s = replays.read_battle_stream(spark, str(tmp_path / "in"))
        write = lambda d, n: d.withColumn("n", F.lit(n)).write.mode("append").parquet(str(out))
        stateful.running_stats(s).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    for k in range(4):
        message(tmp_path / "in", k, made[15 * k : 15 * k + 15])
        if k % 2:
            run()
    everything = spark.createDataFrame([(json.dumps(made),)], "value string")
    sides = ingest.to_sides(ingest.ranked(replays.decoded_stream(everything)), state.STATE_SIDE)
    got = spark.read.parquet(str(out)).groupBy("player_id", "character_id", "game_version").agg(F.max_by(F.struct("dan_rank", "latest_battle", "wins", "losses"), "n").alias("s")).select("player_id", "character_id", "game_version", "s.*")
    assert rows(got, *STATE) == rows(state.character_stats(state.character_state(sides)), *STATE)


def test_users_leave(spark, tmp_path, state_store):
    seen = []

    def batch(d, _):
        seen.append(sorted((r.user_id, r.at, r.active) for r in d.select("user_id", F.unix_seconds("last_seen").alias("at"), "active").collect()))

    def run(k, events):
        spark.createDataFrame([(u, t) for u, t in events], "user_id long, t long").select("user_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
        s = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(str(tmp_path / "in"))
        q = stateful.active_users(s).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [x for b in seen for x in b], [p for p in q.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]

    first, _ = run(0, [(1, 100), (2, 150), (1, 120), (None, 1)])
    assert first == [(1, 120, True), (2, 150, True)]
    seen.clear()
    # user 2 stays, user 1 leaves when event time has passed them by 600 seconds; a restart in between
    second, _ = run(1, [(2, 700), (3, 760)])
    assert set(second) == {(2, 700, True), (3, 760, True), (1, 120, False)}
    seen.clear()
    third, kept = run(2, [(1, 5000)])  # and returns
    assert set(third) == {(1, 5000, True), (2, 700, False), (3, 760, False)}
    seen.clear()
    fourth, kept = run(3, [(9, 90_000)])
    assert set(fourth) == {(9, 90_000, True), (1, 5000, False)}
    assert kept <= 6  # value and timers of the users of the last ten minutes


def page(folder, end, records):
    (folder / f"{end}.json").write_text(json.dumps(records) if isinstance(records, list) else records)


def test_pages_in_both_directions(spark, tmp_path):
    """Forward to the present and back to the horizon over several starts; a failed page is fetched again until it comes."""
    src, tables = tmp_path / "src", stream.Tables(str(tmp_path / "tables"))
    src.mkdir()
    for end in range(1000, 20_000, 640):
        page(src, end, [record(f"b{end}", end - 5), record(f"x{end - 650}", end - 650)])
    broken = {1000 + 640 * k for k in (3, 12, 20)}
    kept = {end: (src / f"{end}.json").read_text() for end in broken}
    for end in broken:
        page(src, end, "broken")
    start = 1000 + 640 * 10
    marks = spark.createDataFrame([(start, start)], "oldest_at long, newest_at long")

    def run(now):
        plan = backfill.resume_plan(marks, now - 1000, now)
        s = replays.read_page_stream(plan, str(src), str(tmp_path / "notes"), now=now, pages=6)
        before = tables.view(spark).number
        stream.start_ingest(s, tables, str(tmp_path / "checkpoint")).awaitTermination()
        return tables.view(spark).number - before

    def stored():
        return {r.battle_id for r in tables.battles(spark).collect() if r.battle_id[0] == "b"}

    now = 1000 + 640 * 22
    for _ in range(6):
        run(now)
    every = {f"b{e}" for e in range(1000 + 640, now + 1, 640)}
    assert stored() == every - {f"b{e}" for e in broken}
    for end, text in kept.items():
        page(src, end, text)
    run(now)
    assert stored() == every
    assert run(now) == 0  # nothing left
    page(src, now + 640, [record("new", now + 1), record(f"b{now + 640}", now + 2)])
    run(now + 700)
    assert "new" in {r.battle_id for r in tables.battles(spark).collect()} and stored() == every | {f"b{now + 640}"}


def test_a_page_is_tried_so_often(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    plan = backfill.resume_plan(spark.createDataFrame([(1000, 1000)], "oldest_at long, newest_at long"), 10, 1010)
    for _ in range(6):
        s = replays.read_page_stream(plan, str(src), str(tmp_path / "notes"), now=1700, tries=3)
        s.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {p.name for p in (tmp_path / "notes").glob("*.failed")} == {"1640.3.3.failed"}
