"""Files, pages and streams."""

import json

from pyspark.sql import functions as F
from test_rules import battle, rows

from matchstats.operators import cells, ingest, players, state
from matchstats.sources import replays
from matchstats.streaming import ingest as stream


def record(n, at, winner=1, p1=1, p2=2, gv=20001, **more):
    r = {"battle_id": n, "battle_at": at, "battle_type": 2, "game_version": gv, "winner": winner, "stage_id": 900}
    for k, p in ((1, p1), (2, p2)):
        r |= {f"p{k}_chara_id": 20 + k, f"p{k}_name": f"n{p}", f"p{k}_polaris_id": f"P{p}", f"p{k}_power": 5, f"p{k}_rank": 16, f"p{k}_rounds": 2, f"p{k}_user_id": p, f"p{k}_region_id": 3}
    return r | more


def test_read_battles(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([record("x", 1727976179, p1=554946220922080960)]))
    row = replays.read_battles(spark, str(tmp_path)).first()
    assert row["player1_id"] == "554946220922080960" and row["date"] == "10/03/2024 17:22:59 UTC" and row["player2_rating_before"] is None


def test_pages_source(spark, tmp_path):
    (tmp_path / "2000.json").write_text(json.dumps([record("a", 1990), record("b", 1400)]))
    (tmp_path / "1360.json").write_text("broken")
    d = replays.read_pages(spark, str(tmp_path), 700, 2000)
    assert rows(d, "battle_id", "player1_id") == [("a", "1"), ("b", "1")]


def pages(tmp_path, lists):
    folder = tmp_path / "pages"
    folder.mkdir()
    for k, records in enumerate(lists):
        (folder / f"{k}.json").write_text(json.dumps({"fetched_for": k, "value": json.dumps(records)}))
    return str(folder)


LISTS = [
    [record("a", 100), record("b", 110, winner=2), record("a", 100)],
    [record("b", 110, winner=2), record("c", 120, p1=3, gv=10101)],
    [record("c", 120, p1=3, gv=10101), record("d", 90, winner=0)],
]


STATE = ("player_id", "character_id", "game_version", "dan_rank", "latest_battle", "wins", "losses")
CELL = ("game_version", "character_id", "category", "total_wins", "total_losses", "total_players")


def check(spark, tables):
    """What is kept up batch by batch is what the stored battles give."""
    stored = tables.battles(spark)
    sides = ingest.to_sides(ingest.ranked(stored))
    now = stream.current_state(spark, tables)
    people, stats = state.players(state.player_state(sides)), state.rebuild_character_stats(stored)
    own = ("player_id", "polaris_id", "name", "power", "latest_battle", "region_id")
    assert rows(state.players(state.merge_players(now)), *own) == rows(people, *own)
    assert rows(state.character_stats(now), *STATE) == rows(stats, *STATE)
    counts = players.matchup_state(ingest.to_sides(ingest.ranked(stored), stream.MATCHUP_SIDE))
    assert rows(stream.current_matchups(spark, tables), *counts.columns) == rows(counts, *counts.columns)
    assert rows(stream.stored_ids(spark, tables, tables.view(spark)), "battle_id") == rows(stored, "battle_id")
    total = ("total_ranked_replays", "total_unranked_replays", "total_players")
    assert rows(stream.summary(spark, tables), *total) == rows(state.summary_counters(stored, people), *total)
    want = cells.build_cells(cells.stats_with_region(stats, people))
    assert rows(tables.cells(spark), *CELL) == rows(want, *CELL)


def decoded(spark, records):
    return replays.decoded_stream(spark.createDataFrame([(json.dumps(records),)], "value string"))


def test_stream_equals_batch(spark, tmp_path):
    path = pages(tmp_path, [*LISTS, [record("e", 95, battle_type=1)]])
    tables = stream.Tables(str(tmp_path / "tables"))
    for _ in range(2):  # the second start finds nothing new
        stream.start_ingest(replays.read_battle_stream(spark, path), tables, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(tables.battles(spark), "battle_id") == [("a",), ("b",), ("c",), ("d",), ("e",)]
    assert stream.refresh(spark, tables, now=1000) == [10101, 20001] and stream.refresh(spark, tables, now=2000) == []
    check(spark, tables)
    # a message that is delivered again, as a new batch or under the same id, changes nothing
    for batch_id in (99, 99):
        stream.ingest_batch(decoded(spark, LISTS[1]), batch_id, tables)
        check(spark, tables)
    assert stream.refresh(spark, tables, now=3000) == []


def test_versions_wait_for_their_cells(spark, tmp_path):
    tables = stream.Tables(str(tmp_path / "tables"))
    assert stream.refresh(spark, tables) == [] and stream.current_state(spark, tables) is None and stream.summary(spark, tables) is None
    stream.ingest_batch(decoded(spark, LISTS[0]), 0, tables)
    assert stream.refresh(spark, tables, now=1000) == [20001]
    stream.compact(spark, tables)
    stream.ingest_batch(decoded(spark, LISTS[1]), 1, tables)
    stream.ingest_batch(decoded(spark, LISTS[1]), 1, tables)  # the same id: it is there already
    assert stream.refresh(spark, tables, now=1060) == []  # too soon
    # another driver, which has only the tables
    tables = stream.Tables(tables.root)
    assert stream.pending_versions(spark, tables)[0] == [10101]
    assert stream.refresh(spark, tables, now=1130) == [10101]
    check(spark, tables)
    stream.compact(spark, tables)
    stream.ingest_batch(decoded(spark, LISTS[2]), 2, tables, horizon=0)
    assert stream.pending_versions(spark, tables)[0] == [20001]
    stream.refresh_versions(spark, tables, None)
    check(spark, tables)


def test_dedupe_and_running_stats(spark, tmp_path):
    s = replays.read_battle_stream(spark, pages(tmp_path, LISTS))
    q = stream.running_stats(stream.dedupe_stream(s)).writeStream.outputMode("update").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    d = spark.table("running").groupBy("player_id", "character_id", "game_version").agg(F.max("wins").alias("wins"), F.max("losses").alias("losses"))
    got = rows(d.where(F.col("player_id").endswith("1")), "wins", "losses")
    assert got == [(1, 2)]


def test_message_round_trip(spark, tmp_path):
    from pyspark.sql import types as T

    from matchstats import schema

    kinds = {name: kind for _, name, kind in schema.WIRE}
    b = spark.createDataFrame([tuple(battle("a", 5)[n] for n in schema.BATTLE_COLUMNS)], T.StructType([T.StructField(n, kinds[n]) for n in schema.BATTLE_COLUMNS]))
    replays.write_battle_pages(b, str(tmp_path / "out"), F.lit(700).cast("long"))
    back = replays.decoded_stream(spark.read.schema(replays.MESSAGE_SCHEMA).json(str(tmp_path / "out")))
    assert rows(back, "battle_id", "player1_id", "player1_power") == [("a", "1", 105)]


def test_activity(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:10", 7), (2, "2024-01-01 00:03:00", 8), (3, "2024-01-01 00:20:00", 7)], "event_id long, t string, user_id long").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id")
    e.write.parquet(str(tmp_path / "events"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    stream.live_active(s).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert [str(r.last_seen) for r in spark.table("seen").orderBy("user_id").collect()] == ["2024-01-01 00:20:00", "2024-01-01 00:03:00"]
    seen, now = spark.table("seen"), F.lit("2024-01-01 00:21:00").cast("timestamp")
    assert [r.user_id for r in stream.active_now(seen, now).collect()] == [7]
    assert [r.user_id for r in stream.active_now(seen, now, seconds=3600).collect()] == [7, 8]
    assert stream.active_now(seen.union(seen.withColumn("last_seen", F.lit("2024-01-01 00:20:30").cast("timestamp_ntz"))), now).count() == 2
    stream.active_windows(s).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    assert [(r.events, r.users_approx) for r in spark.table("windows").orderBy("start").collect()] == [(2, 2)]
