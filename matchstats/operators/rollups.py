"""Rollups over cells: levels, distributions, top lists, changes between versions, nested forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hundredths, share, tier, tier_order, winrate
from ..schema import name_of

W, L, R = "total_wins", "total_losses", "total_replays"


def standard(cells: DataFrame, category: str = "standard") -> DataFrame:
    return cells.where(F.col("category") == category)


def _levels(cells: DataFrame, null_tier: str) -> DataFrame:
    """Sums at (version, character) with and without tier and region, labelled by grouping(), as a tier may be NULL itself."""
    d = standard(cells).select("game_version", "character_id", "region_id", tier(F.col("dan_rank"), null_tier).alias("tier"), W, L, R)
    gv, ch, tr, rg = (F.col(c) for c in ("game_version", "character_id", "tier", "region_id"))
    sets = [[gv, ch], [gv, ch, rg], [gv, ch, tr], [gv, ch, tr, rg]]
    all_ranks, everywhere = F.grouping("tier"), F.grouping("region_id")
    out = d.groupingSets(sets, gv, ch, tr, rg).agg(*(F.sum(c).alias(c) for c in (W, L, R)), all_ranks.alias("g_tier"), everywhere.alias("g_region"))
    return out.select(
        "game_version",
        "character_id",
        F.when(F.col("g_tier") == 1, "allRanks").otherwise(F.col("tier")).alias("rank_category"),
        F.when(F.col("g_region") == 1, "Global").otherwise(F.col("region_id").cast("string")).alias("region"),
        (F.col("g_region") == 1).alias("is_global"),
        W,
        L,
        R,
    )


def order_levels(df: DataFrame, by: str) -> DataFrame:
    """Newest version first, all ranks and Global first, then by ``by`` descending."""
    return df.orderBy(
        F.desc("game_version"), F.when(F.col("rank_category") == "allRanks", 0).otherwise(1), F.asc_nulls_last("rank_category"), F.when(F.col("region") == "Global", 0).otherwise(1), "region", F.desc_nulls_last(by), "character_id"
    )


def popularity_levels(cells: DataFrame) -> DataFrame:
    """Regional levels without replays are left out; global ones are not."""
    d = _levels(cells, "null").where(F.col("is_global") | (F.col(R) > 0)).drop("is_global")
    return order_levels(d, R)


def winrate_levels(cells: DataFrame) -> DataFrame:
    d = _levels(cells, "beginner").where(F.col(W) + F.col(L) > 0).drop("is_global", R)
    return order_levels(d.withColumn("winrate", winrate(F.col(W), F.col(L))), "winrate")


def rank_distribution(cells: DataFrame, versions: list[int] | None = None) -> DataFrame:
    """Share of players in each rank of a (version, category)."""
    d = cells if versions is None else cells.where(F.col("game_version").isin(versions))
    d = d.where(F.col("category").isin("overall", "standard")).groupBy("game_version", "category", "dan_rank").agg(F.sum("total_players").alias("players"))
    total = F.sum("players").over(Window.partitionBy("game_version", "category"))
    return d.withColumn("percentage", share(F.col("players"), total)).drop("players").orderBy("game_version", "category", "dan_rank")


def latest_version(cells: DataFrame) -> DataFrame:
    """Cells of the greatest version of any category."""
    last = cells.agg(F.max("game_version").alias("game_version"))
    return cells.join(F.broadcast(last), "game_version", "left_semi")  # one row


def latest_versions(cells: DataFrame, n: int = 2) -> DataFrame:
    return cells.select("game_version").distinct().orderBy(F.desc("game_version")).limit(n)


def _by_tier(cells: DataFrame) -> DataFrame:
    d = standard(latest_version(cells)).select("character_id", tier(F.col("dan_rank")).alias("rank_category"), W, L, R)
    return d.groupBy("rank_category", "character_id").agg(*(F.sum(c).alias(c) for c in (W, L, R)))


def _top(d: DataFrame, by: Column, k: int) -> DataFrame:
    w = Window.partitionBy("rank_category").orderBy(by.desc(), F.col("character_id").cast("int"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_popularity(cells: DataFrame, k: int = 5) -> DataFrame:
    d = _top(_by_tier(cells).where(F.col(R) > 0), F.col(R), k)
    return d.select("rank_category", "character_id", R, "rank").orderBy("rank_category", "rank")


def top_winrates(cells: DataFrame, k: int = 5, min_games: int = 1) -> DataFrame:
    """Ordered by the unrounded rate; the output has two digits."""
    d = _by_tier(cells).where(F.col(W) + F.col(L) >= min_games)
    d = _top(d, share(F.col(W), F.col(W) + F.col(L)), k)
    return d.select("rank_category", "character_id", W, L, winrate(F.col(W), F.col(L), 2).alias("winrate"), "rank").orderBy("rank_category", "rank")


def version_winrates(cells: DataFrame, with_global: bool = False, n_versions: int | None = 2) -> DataFrame:
    """Win rate (two digits, and in hundredths) by version, character and tier, and over all tiers as ``global``."""
    if n_versions is not None:
        cells = cells.join(F.broadcast(latest_versions(cells, n_versions)), "game_version", "left_semi")  # n rows
    d = standard(cells).select("game_version", "character_id", tier(F.col("dan_rank")).alias("tier"), W, L)
    gv, ch, tr = F.col("game_version"), F.col("character_id"), F.col("tier")
    sets = [[gv, ch, tr], [gv, ch]] if with_global else [[gv, ch, tr]]
    d = d.groupingSets(sets, gv, ch, tr).agg(F.sum(W).alias(W), F.sum(L).alias(L), F.grouping("tier").alias("g"))
    d = d.withColumn("rank_category", F.when(F.col("g") == 1, "global").otherwise(F.col("tier")))
    rate = hundredths(F.col(W), F.col(W) + F.col(L))
    return d.select("game_version", "character_id", "rank_category", rate.alias("rate"), (rate / F.lit(100.0)).alias("winrate"))


def version_delta(rates: DataFrame) -> DataFrame:
    """Change of each (character, tier) from the older to the newer of two versions: difference of the rounded rates. ``rates`` has two versions at most."""
    d = rates.where("rate IS NOT NULL AND rank_category IS NOT NULL").groupBy("character_id", "rank_category")
    d = d.agg((F.max_by("rate", "game_version") - F.min_by("rate", "game_version")).alias("delta"), F.count("*").alias("n"))
    return d.where("n = 2").drop("n")


def winrate_changes(cells: DataFrame, k: int | None = 2, with_global: bool = False) -> DataFrame:
    """Rises and falls between the last two versions, the ``k`` largest of each in a tier or all of them."""
    d = version_delta(version_winrates(cells, with_global)).where("delta <> 0").withColumn("trend", F.when(F.col("delta") > 0, "increase").otherwise("decrease"))
    if k is not None:
        w = Window.partitionBy("rank_category", "trend").orderBy(F.desc(F.abs("delta")), F.col("character_id").cast("int"))
        d = d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return d.select("character_id", "rank_category", (F.abs("delta") / F.lit(100.0)).alias("change"), "trend").orderBy(
        tier_order(F.col("rank_category")), F.desc("trend"), F.desc("change"), F.col("character_id").cast("int")
    )


# ---- nested forms


def nest_levels(levels: DataFrame, value: str) -> DataFrame:
    """By version and tier: a map of character names for Global, and one of such maps by region. Rows without tier are left out."""
    d = levels.where(F.col("rank_category").isNotNull()).withColumn("character", name_of("character", F.col("character_id")))
    one = d.groupBy("game_version", "rank_category", "region").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("character", value)))).alias("m"))
    return one.groupBy("game_version", "rank_category").agg(
        F.max_by("m", F.when(F.col("region") == "Global", 1)).alias("global_stats"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("region") != "Global", F.struct("region", "m"))), lambda a, b: F.when(a["region"] < b["region"], -1).when(a["region"] > b["region"], 1).otherwise(0))).alias("regional_stats"),
    )


def group_by_tier(changes: DataFrame) -> DataFrame:
    entry = F.struct((-F.col("change")).alias("o"), name_of("character", F.col("character_id")).alias("character"), "change", "trend")
    d = changes.groupBy("rank_category").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return d.select("rank_category", F.transform("e", lambda x: F.struct(x["character"].alias("character"), x["change"].alias("change"), x["trend"].alias("trend"))).alias("changes"))


def nest_distribution(distribution: DataFrame) -> DataFrame:
    """Lists of (rank, percentage) by version, a column for each category."""
    entry = F.struct("dan_rank", "percentage")
    own = lambda c: F.array_sort(F.collect_list(F.when(F.col("category") == c, entry))).alias(c)
    return distribution.groupBy("game_version").agg(own("overall"), own("standard"))


def to_nested_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
