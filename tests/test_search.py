"""Search by index against a scan; order; what is read."""

import random

import pytest
from pyspark.sql import functions as F

from matchstats.operators import players, search
from matchstats.plans.queries import QUERIES
from matchstats.plans.store import Store

SF = "/root/testdata/sf0.001"
PLAYER = "player_id string, polaris_id string, name string, region_id int, language string, latest_battle long, power long"
STATS = "player_id string, character_id string, game_version int, dan_rank int, latest_battle long, wins long, losses long"


def people(spark, named, seen=0):
    """Players of (name, polaris id)."""
    return spark.createDataFrame([(f"{k:018d}", p, n, None if k % 3 else 2, None, seen + k, 5) for k, (n, p) in enumerate(named)], PLAYER)


def stats_of(spark, n):
    return spark.createDataFrame([(f"{k:018d}", str(k % 12 * 4), 20001, k % 30, k, 1, 2) for k in range(n) if k % 5], STATS)


@pytest.fixture(params=["default", "-1"])
def joins(spark, request):
    """With and without broadcast joins."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    if request.param != "default":
        spark.conf.set(key, request.param)
    yield
    spark.conf.unset(key)


def test_search_in_order(spark, joins, tmp_path):
    names = ["akaz", "xkaz", "Kaz", "KAZAMA", "kaz", "kazuya", *(f"bkaz{k:02d}" for k in range(30)), "none"]
    d, stats = people(spark, [(n, f"P{k}") for k, n in enumerate(names)]).repartition(7), stats_of(spark, 37)
    index = search.SearchIndex.build(d, str(tmp_path / "index"))
    want = ["Kaz", "kaz", "KAZAMA", "kazuya", "akaz", "xkaz", *(f"bkaz{k:02d}" for k in range(14))]
    assert [r.name for r in players.player_search(d, stats, "kaz").collect()] == want == [r.name for r in index.search(stats, "kaz").collect()]


def test_recent_in_order(spark, joins):
    d, stats = people(spark, [(f"n{k}", f"P{k}") for k in range(60)], seen=1000).repartition(7), stats_of(spark, 60)
    got = players.recently_active(d, stats, F.lit(1059), seconds=50).collect()
    assert [r.last_seen for r in got] == list(range(1059, 1019, -1))


def test_index_equals_scan(spark, tmp_path):
    """Random queries: parts of names and ids, short ones, dashes, other letters, no hit."""
    rng = random.Random(8)
    letters = "aabbKk_%- Éßx1"
    named = [("".join(rng.choices(letters, k=rng.randint(0, 9))), "".join(rng.choices("ab12", k=rng.randint(0, 6)))) for _ in range(300)] + [(None, "ab1"), ("x", None), (None, None)]
    d, stats = people(spark, named).cache(), stats_of(spark, len(named)).cache()
    index = search.SearchIndex.build(d, str(tmp_path / "index"))
    texts = [t for pair in named for t in pair if t]
    asked = {"-", "--", "ab-12", "a", "K", "zzz", "É"}
    while len(asked) < 60:
        t = rng.choice(texts)
        at = rng.randrange(len(t))
        asked.add(t[at : at + rng.randint(1, 6)])
    for q in sorted(q for q in asked if q.strip()):
        hits = d.where(players.search_predicate(q, F.col("name"), F.col("polaris_id")))
        assert {r.player_id for r in index.candidates(q).collect()} == {r.player_id for r in hits.collect()}, q
        if q in ("a", "-", "zzz", "K"):
            assert index.search(stats, q).collect() == players.player_search(d, stats, q).collect()
    with pytest.raises(ValueError):
        index.candidates("  ")


def test_search_reads_its_partitions(spark):
    store = Store.of(spark, SF)
    for q in ("customer#00000001", "P000-0000-0001", "cu"):
        plan = " ".join(store.search.candidates(q)._jdf.queryExecution().executedPlan().toString().split())
        assert "PartitionFilters: [" in plan and "head#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
        assert store.search.search(store.stats, q).collect() == players.player_search(store.players, store.stats, q).collect()
    # of the state, one bucket
    one = store.stats.where(F.col("player_id").isin(["0" * 18]))
    assert "SelectedBucketsCount: 1 out of" in players.main_character_overall(one)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["player_profile", "best_worst_matchups", "season_ranks", "player_metadata", "player_matchups"])
def test_joins_by_player_need_no_exchange(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "matchstats_battles" not in plan
