"""Hand-made rows for the decisions that the operators take."""

import json
import random

import pytest
from pyspark.sql import functions as F

from matchstats import schema
from matchstats.functions import scalars
from matchstats.operators import backfill, cells, ingest, players, rollups, state


def battle(n, at, winner=1, p1="1", p2="2", kind=2, gv=20001, r1=10, r2=10, c1=0, c2=1, region1=3, region2=None, name1="A", **more):
    row = {c: None for c in schema.BATTLE_COLUMNS}
    row |= {"battle_id": n, "battle_at": at, "battle_type": kind, "game_version": gv, "winner": winner, "stageid": 100}
    for k, (p, r, c, g) in {1: (p1, r1, c1, region1), 2: (p2, r2, c2, region2)}.items():
        row |= {f"player{k}_id": p, f"player{k}_dan_rank": r, f"player{k}_character_id": c, f"player{k}_region": g, f"player{k}_power": 100 + at, f"player{k}_polaris_id": f"P{p}", f"player{k}_name": name1 if k == 1 else "B"}
    return row | more


@pytest.fixture(scope="module")
def make(spark):
    from pyspark.sql import types as T

    fields = {name: kind for _, name, kind in schema.WIRE}
    kind = T.StructType([T.StructField(n, fields[n]) for n in schema.BATTLE_COLUMNS])
    return lambda rows: spark.createDataFrame([tuple(r[n] for n in schema.BATTLE_COLUMNS) for r in rows], kind)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_draw_is_a_loss_for_both(make):
    d = state.rebuild_character_stats(make([battle("a", 5, winner=0), battle("b", 6, winner=2)]))
    assert rows(d, "player_id", "wins", "losses") == [("1".zfill(18), 0, 2), ("2".zfill(18), 1, 1)]


def test_pad18_keeps_long_ids(spark):
    d = spark.createDataFrame([("7" * 17,), ("7" * 18,), ("7" * 20,), (None,)], "id string").select(scalars.pad18(F.col("id")).alias("p"))
    assert [r.p for r in d.collect()] == ["0" + "7" * 17, "7" * 18, "7" * 20, None]


def test_tiers(spark):
    ranks = [-1, 0, 14, 15, 20, 21, 26, 27, 107, 765, None]
    d = spark.createDataFrame([(r,) for r in ranks], "r int").select(scalars.tier(F.col("r")).alias("t"), scalars.tier(F.col("r"), "beginner").alias("u"))
    assert [r.t for r in d.collect()] == [None, "beginner", "beginner", "intermediate", "intermediate", "advanced", "advanced", "master", "master", "master", None]
    assert [r.u for r in d.collect()][0] == "beginner" and [r.u for r in d.collect()][-1] == "beginner"


def test_null_region_never_overwrites(make):
    sides = ingest.to_sides(make([battle("a", 5, region1=3), battle("b", 9, region1=None), battle("c", 2, region1=1)]))
    p = state.players(state.player_state(sides))
    assert rows(p.where(F.col("player_id").endswith("1")), "region_id", "latest_battle", "power") == [(3, 9, 109)]


def test_state_does_not_depend_on_arrival(make):
    all_rows = [battle(str(n), n % 7, winner=n % 3, p1=str(n % 4), p2=str(4 + n % 3), region1=n % 5 or None, name1=f"n{n}", c1=n % 3, gv=20000 + n % 2) for n in range(40)]
    want_p = rows(state.players(state.player_state(ingest.to_sides(make(all_rows)))), "player_id", "name", "region_id", "polaris_id", "power")
    want_s = rows(state.rebuild_character_stats(make(all_rows)), "player_id", "character_id", "game_version", "dan_rank", "latest_battle", "wins", "losses")
    random.Random(1).shuffle(all_rows)
    p = s = None
    for k in range(0, 40, 13):
        sides = ingest.to_sides(make(all_rows[k : k + 13]))
        p = state.player_state(sides) if p is None else state.upsert_players(p, state.player_state(sides))
        s = state.stats_delta(sides) if s is None else state.upsert_character_stats(s, state.stats_delta(sides))
    assert rows(state.players(p), "player_id", "name", "region_id", "polaris_id", "power") == want_p
    assert rows(state.character_stats(s), "player_id", "character_id", "game_version", "dan_rank", "latest_battle", "wins", "losses") == want_s


def test_insert_once(make):
    stored = make([battle("a", 1)])
    new = ingest.insert_new(stored, make([battle("a", 9), battle("b", 3), battle("b", 2)]), ["battle_id"], ["battle_at"])
    assert rows(new, "battle_id", "battle_at") == [("b", 2)]


def test_main_character_ties(spark):
    s = spark.createDataFrame([("p", "10", 20001, 5, 3, 1, 3, 4), ("p", "9", 20001, 5, 2, 2, 3, 4), ("p", "1", 20001, 4, 50, 2, 3, 52)], "player_id string, character_id string, game_version int, dan_rank int, wins long, losses long, region_id int, total_plays long")
    assert rows(cells.main_character(s), "character_id") == [("9",)]
    c = cells.build_cells(s)
    assert rows(c, "category", "character_id") == [("overall", "1"), ("overall", "10"), ("overall", "9"), ("standard", "9")]


def test_cells_replace_versions_only(spark, tmp_path):
    cols = "player_id string, character_id string, game_version int, dan_rank int, wins long, losses long, region_id int, total_plays long"
    path = str(tmp_path / "cells")
    cells.refresh_cells(spark.createDataFrame([("p", "1", 1, 5, 3, 1, 3, 4), ("p", "1", 2, 5, 3, 1, 3, 4)], cols), path, None)
    cells.refresh_cells(spark.createDataFrame([("q", "2", 2, 6, 1, 1, 3, 2)], cols), path, [2])
    got = rows(spark.read.parquet(path).where("category = 'standard'"), "game_version", "character_id")
    assert got == [(1, "1"), (2, "2")]


def test_names(spark):
    d = spark.createDataFrame([(43,), (99,), (None,)], "c int")
    want = ["Fahkumram", "Undefined Character ID: 99", None]
    assert [r.n for r in d.select(schema.name_of("character", F.col("c")).alias("n")).collect()] == want
    assert sorted(str(r.n) for r in schema.with_names(d, "character", "c", "n").collect()) == sorted(map(str, want))


def test_ids(spark):
    d = spark.createDataFrame([("ABCDEFGHIJKL",), ("ABCDEFGHIJKLM",), ("short",), ("AB-D",), ("  ",), (None,)], "i string")
    got = d.select(scalars.format_id(F.col("i")).alias("f"), scalars.valid_player_id(F.col("i")).alias("v")).collect()
    assert [r.f for r in got] == ["ABCD-EFGH-IJKL", "ABCD-EFGH-IJKLM", "short", "AB-D", "  ", None]
    assert [r.v for r in got] == [True, False, True, False, False, False]


def test_unknown_type_is_rejected(make):
    known, rejected = ingest.known_battle_types(make([battle("a", 1), battle("b", 1, kind=9)]))
    assert rows(known, "battle_id", "battle_type_name") == [("a", "ranked")] and rows(rejected, "battle_id") == [("b",)]


def test_matchups_need_three_games(make):
    games = [battle(str(n), n, winner=1, c2=5) for n in range(2)] + [battle(f"x{n}", n, winner=2, c2=6) for n in range(3)]
    m = players.player_matchups(ingest.to_sides(make(games)))
    b = players.best_worst_matchups(m).where(F.col("player_id").endswith("1"))
    assert rows(b, "best_opponent", "worst_opponent", "best_winrate") == [("Jin", "Jin", 0.0)]


def test_players_without_statistics(spark, make):
    p = state.players(state.player_state(ingest.to_sides(make([battle("a", 1)]))))
    none = state.rebuild_character_stats(make([]))
    assert rows(players.player_metadata(p, none), "main_character", "main_rank") == [("No Character Data", "N/A")] * 2


def test_pages(spark, make):
    marks = ingest.water_marks(make([battle("a", 100), battle("b", 2000)]))
    pages = backfill.backfill_pages(marks)
    assert rows(pages, "page_end") == [(720,), (1360,), (2000,)]
    b = make([battle("a", 100), battle("b", 2000), battle("c", 1330), battle("d", 1300)])
    assert rows(backfill.assign_pages(b, pages), "battle_id", "page_no") == [("a", 2), ("b", 0), ("c", 0), ("c", 1), ("d", 1)]
    assert rows(backfill.in_page(b, 1360), "battle_id") == [("c",), ("d",)]  # from 660 to 1360, its end included


def test_resume(make):
    """Marks are 100 and 2000: before the horizon, or after it."""
    marks = ingest.water_marks(make([battle("a", 100), battle("b", 2000)]))
    plan = lambda m, horizon: tuple(backfill.resume_plan(m, horizon, 2100).first())
    assert plan(marks, 1000) == ("preloaded", 2000, None, None)
    assert plan(marks, 2000) == ("preloaded", 2000, None, None)  # the oldest is the limit itself
    assert plan(marks, 2050) == ("partial", 2000, 100, 50)
    assert plan(ingest.water_marks(make([])), 1000) == ("empty", 2100, 2100, 1100)


def test_filters(make, spark):
    b = make([battle("a", 1), battle("b", 1, kind=1), battle("c", 1, kind=None)])
    assert rows(ingest.ranked(b), "battle_id") == [("a",)] and rows(ingest.unranked(b), "battle_id") == [("b",), ("c",)]
    ids = spark.createDataFrame([("ABCDEFGHIJKL",), ("AB-D",), (None,)], "i string")
    good, bad = ingest.known_player_ids(ids, "i")
    assert [r.i for r in good.collect()] == ["ABCDEFGHIJKL"] and {r.i for r in bad.collect()} == {"AB-D", None}
    same = spark.createDataFrame([("7", "7".zfill(18)), ("007", "7"), ("7", "8")], "a string, b string").select(scalars.same_id(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in same.collect()] == [True, True, False]


def test_sides_of_some_columns(make):
    b = make([battle("a", 5)])
    whole, part = ingest.to_sides(b), ingest.to_sides(b, ["battle_id", "player_id", "is_win"])
    assert part.columns == ["battle_id", "player_id", "is_win"]
    assert rows(part, "player_id", "is_win") == rows(whole, "player_id", "is_win")


def test_state_in_one_pass(make):
    """Statistics, players and regions from the combined state are those of the separate ones."""
    all_rows = [battle(str(n), n % 7, winner=n % 3, p1=str(n % 4), p2=str(4 + n % 3), region1=n % 5 or None, name1=f"n{n}", c1=n % 3, gv=20000 + n % 2) for n in range(40)]
    sides = ingest.to_sides(make(all_rows))
    both = state.merge_states(state.character_state(ingest.to_sides(make(all_rows[:11]))).unionByName(state.character_state(ingest.to_sides(make(all_rows[11:])))))
    cols = ("player_id", "character_id", "game_version", "dan_rank", "latest_battle", "wins", "losses")
    stats, people = state.character_stats(state.stats_delta(sides)), state.players(state.player_state(sides))
    assert rows(state.character_stats(both), *cols) == rows(stats, *cols)
    own = ("player_id", "name", "region_id", "polaris_id", "power", "latest_battle")
    assert [tuple(map(str, r)) for r in rows(state.players(state.merge_players(both)), *own)] == [tuple(map(str, r)) for r in rows(people, *own)]
    more = (*cols, "region_id", "total_plays")
    got, want = (sorted(tuple(map(str, (r[c] for c in more))) for r in d.collect()) for d in (state.with_region(both), cells.stats_with_region(stats, people)))
    assert got == want


def test_with_stats(spark):
    p = spark.createDataFrame([("1", "a"), ("2", "b")], "player_id string, name string")
    s = spark.createDataFrame([("1", "5", 20001, 7, 9, 2, 1), ("1", "4", 20000, 6, 8, 0, 1)], "player_id string, character_id string, game_version int, dan_rank int, latest_battle long, wins long, losses long")
    got = {r.player_id: [(x.game_version, x.character_id, x.wins) for x in r.character_stats] for r in players.with_stats(p, s).collect()}
    assert got == {"1": [(20000, "4", 0), (20001, "5", 2)], "2": []}


def test_nested_json(spark):
    d = spark.createDataFrame([(1, {"b": 2.5}, [3])], "a int, m map<string,double>, l array<int>")
    assert [json.loads(r.value) for r in rollups.to_nested_json(d).collect()] == [{"a": 1, "m": {"b": 2.5}, "l": [3]}]


def test_search_order_and_limit(spark):
    """Equal first, then those that start with it, then shorter names, names and ids in order; no more than the limit."""
    names = ["zzkazzz", "Kaz", "kaz", "kazuya", "KAZAMA", "akaz", "xkaz", *(f"bkaz{n:02d}" for n in range(30))]
    p = spark.createDataFrame([(f"{n:02d}", f"P{n}", x, None, None, 5, 9) for n, x in enumerate(names)], "player_id string, polaris_id string, name string, region_id int, language string, latest_battle long, power long")
    found = players.rank_search(p.where(players.search_predicate("kaz", F.col("name"), F.col("polaris_id"))), "kaz")
    low = lambda x: x.lower()
    key = lambda x: (0 if low(x) == "kaz" else 1 if low(x).startswith("kaz") else 20, len(x), x)
    assert [r.name for r in found.collect()] == sorted(names, key=key)[:20] and len(names) > 20
    s = spark.createDataFrame([], "player_id string, character_id string, game_version int, dan_rank int, latest_battle long, wins long, losses long")
    assert {r.name for r in players.player_search(p, s, "kaz").collect()} == set(sorted(names, key=key)[:20])


def test_empty(make):
    none = make([])
    stats = state.rebuild_character_stats(none)
    c = cells.build_cells(cells.stats_with_region(stats, state.players(state.player_state(ingest.to_sides(none)))))
    for d in (c, rollups.winrate_levels(c), rollups.popularity_levels(c), rollups.winrate_changes(c), rollups.top_winrates(c), rollups.rank_distribution(c)):
        assert d.collect() == []


def test_search_takes_no_wildcards(spark):
    p = spark.createDataFrame([("1", "PA_B", "ax%y", 1, None, 5, 9), ("2", "PB", "axzy", 1, None, 5, 9)], "player_id string, polaris_id string, name string, region_id int, language string, latest_battle long, power long")
    s = spark.createDataFrame([], "player_id string, character_id string, game_version int, dan_rank int, latest_battle long, wins long, losses long")
    assert rows(players.player_search(p, s, "X%Y"), "player_id") == [("1",)]
    with pytest.raises(ValueError):
        players.player_search(p, s, "   ")
