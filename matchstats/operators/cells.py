"""Statistic cells by version, character, rank, category and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest import with_region

CELL = ["game_version", "character_id", "dan_rank", "category", "region_id"]
_TOTALS = ["total_wins", "total_losses", "total_players", "total_replays"]
_KINDS = "character_id string, dan_rank int, category string, region_id int, total_wins long, total_losses long, total_players long, total_replays long, game_version int"


def stats_with_region(stats: DataFrame, players: DataFrame) -> DataFrame:
    return stats.join(players.select("player_id", "region_id"), "player_id").withColumn("total_plays", F.col("wins") + F.col("losses"))


def flagged_main(stats: DataFrame) -> DataFrame:
    """``is_main``: the row of highest rank of each (player, version), then of most plays, then of lowest character."""
    w = Window.partitionBy("player_id", "game_version").orderBy(F.desc("dan_rank"), F.desc("total_plays"), F.col("character_id").cast("int"))
    return stats.withColumn("is_main", F.row_number().over(w) == 1)


def main_character(stats: DataFrame) -> DataFrame:
    return flagged_main(stats).where("is_main").drop("is_main")


def _sums(d: DataFrame) -> DataFrame:
    # a player has one row a (character, version), so rows of a cell are players
    return d.groupBy(*CELL).agg(F.sum("wins").alias("total_wins"), F.sum("losses").alias("total_losses"), F.count("player_id").alias("total_players"), F.sum("total_plays").alias("total_replays"))


def build_cells(stats: DataFrame, categories: tuple[str, ...] = ("standard", "overall")) -> DataFrame:
    """Cells of both categories in one pass; rows without region are left out before the main character is found."""
    d = flagged_main(with_region(stats))
    every = [F.lit(c) for c in categories if c == "overall"]
    kinds = F.array(*every)
    if "standard" in categories:
        kinds = F.when(F.col("is_main"), F.array(*every, F.lit("standard"))).otherwise(kinds)
    return _sums(d.withColumn("category", F.explode(kinds)))


def cells_standard(stats: DataFrame) -> DataFrame:
    return build_cells(stats, ("standard",))


def cells_overall(stats: DataFrame) -> DataFrame:
    return _sums(with_region(stats).withColumn("category", F.lit("overall")))


def write_cells(cells: DataFrame, path: str) -> None:
    """Replace the partitions of the versions that ``cells`` has, and no other."""
    d = cells.withColumn("computed_at", F.localtimestamp())
    d.repartition("game_version").write.partitionBy("game_version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells as ``build_cells`` gives them; a filter on the version reads its partitions alone."""
    return spark.read.schema(_KINDS).parquet(path).select(*CELL, *_TOTALS)


def cell_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed totals that lead from one set of cells to another; cells that stay as they are are not in it."""
    gone = before.select(*CELL, *((-F.col(c)).alias(c) for c in _TOTALS))
    d = after.select(*CELL, *_TOTALS).unionByName(gone).groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in _TOTALS))
    return d.where(" OR ".join(f"{c} <> 0" for c in _TOTALS))


def merge_cells(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells with signed changes added; a cell whose last player has left is gone."""
    d = cells.select(*CELL, *_TOTALS).unionByName(changes.select(*CELL, *_TOTALS)).groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in _TOTALS))
    return d.where("total_players <> 0")


def version_folder(path: str, version: int) -> str:
    return f"{path}/v={version}"


def write_versions(cells: DataFrame, path: str) -> None:
    """Cells in a folder for each version, whose files have all columns."""
    cells.withColumn("v", F.col("game_version")).repartition("v").write.partitionBy("v").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_KINDS).parquet(path)


def refresh_cells(stats: DataFrame, path: str, versions: list[int] | None) -> None:
    """Recompute the cells of some versions, or of all."""
    write_cells(build_cells(stats if versions is None else stats.where(F.col("game_version").isin(versions))), path)
