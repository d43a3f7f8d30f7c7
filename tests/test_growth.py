"""What is shuffled and sorted on the way to the written tables and the histories: nothing before it is dealt out, nothing twice."""

import pytest

from matchstats import fixtures, storage
from matchstats.operators import ingest, state
from matchstats.plans.queries import QUERIES
from matchstats.plans.store import Store

SF = "/root/testdata/sf0.001"


def plan_of(df) -> list[str]:
    """Operators of the first physical plan, the result's first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.strip(" +-:*()0123456789") for x in plan.split("== Initial Plan ==")[-1].splitlines()]


def below_exchange(df) -> list[str]:
    """What is done before rows are dealt out for the last time."""
    ops = plan_of(df)
    return ops[next(k for k, x in enumerate(ops) if x.startswith("Exchange")) + 1 :]


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return Store(spark, SF)


def test_tables_are_written_when_asked_for(store):
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in store.paths] == ["battles"]
    store.state.count()
    assert len(store.paths) == 2


def test_sides_are_sorted_in_their_buckets_alone(store):
    d = state.character_state(store._sides(state.STATE_SIDE)).repartition(store.buckets, "player_id")
    assert sum(x.startswith("Exchange") for x in plan_of(d)) == 1
    assert not [x for x in below_exchange(d) if x.startswith("Sort")]


def test_battles_are_dealt_out_once(spark):
    ops = plan_of(fixtures.battles(spark, SF))
    dealt = [k for k, x in enumerate(ops) if x.startswith("Exchange hashpartitioning(l_orderkey")]
    assert len(dealt) == 1 and max(k for k, x in enumerate(ops) if x.startswith(("Sort", "Window"))) < dealt[0]


@pytest.mark.parametrize("name", ["battle_history", "battle_history_pages"])
def test_histories_are_dealt_out_once(spark, name):
    d = QUERIES[name](spark, SF)
    ops = plan_of(d)
    assert sum(x.startswith("Exchange") for x in ops) == 1 and not [x for x in ops if "Join" in x]
    assert not [x for x in below_exchange(d) if x.startswith(("Sort", "ObjectHashAggregate"))]


def test_history_of_some_players(spark, store):
    every = [r for r in QUERIES["battle_history"](spark, SF).collect() if int(r.player_id) in (3, 7)]
    asked = spark.createDataFrame([("3",), ("000000000000000007",), ("7",)], "player_id string")
    assert ingest.battles_of(store.battles, asked).collect() == every and every


def test_parts_grow_with_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert storage.parts(spark, 0) == least
    assert storage.parts(spark, 40 * storage.TASK_ROWS + 1) == 41
