"""Pages of a backfill under skew."""

from pyspark.sql import functions as F

from matchstats.operators import backfill


def test_a_hot_hour(spark):
    """A third of all battles in one hour: counts are right, and what meets the pages is a row a second."""
    quiet = spark.range(20_000).select(F.concat(F.lit("q"), "id").alias("battle_id"), (F.col("id") * 97 % 500_000).alias("battle_at"))
    hot = spark.range(10_000).select(F.concat(F.lit("h"), "id").alias("battle_id"), (250_000 + F.col("id") % 60).alias("battle_at"))
    battles = quiet.unionByName(hot)
    pages = backfill.backfill_pages(spark.createDataFrame([(0, 499_999)], "oldest_at long, newest_at long"))
    got = {r.page_no: (r.page_start, r.page_end, r.battles) for r in backfill.page_coverage(battles, pages).collect()}
    at = [r.battle_at for r in battles.collect()]
    for low, high, n in list(got.values())[::40] + [v for v in got.values() if v[0] < 250_030 <= v[1]]:
        assert n == sum(low < t <= high for t in at)
    pairs = backfill.assign_pages(battles, pages).groupBy("page_no").count().collect()
    assert {r.page_no: r["count"] for r in pairs} == {k: n for k, (_, _, n) in got.items() if n}
    # the plan: one aggregate below the join with the pages
    plan = backfill.page_coverage(battles, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate [battle_at") > plan.index("slot")
