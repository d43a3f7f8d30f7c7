"""Pages of a backfill, and which pages cover a battle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, OVERLAP = 700, 60


def backfill_pages(marks: DataFrame, width: int = WIDTH, step: int = WIDTH - OVERLAP) -> DataFrame:
    """Pages of ``width`` seconds, newest first, ``step`` apart, from the newest to the oldest mark (one row with oldest_at, newest_at)."""
    ends = F.sequence("newest_at", F.col("oldest_at"), F.lit(-step).cast("long"))
    d = marks.where("newest_at IS NOT NULL").select(F.posexplode(ends).alias("page_no", "page_end"))
    return d.withColumn("page_start", F.col("page_end") - width)


def resume_plan(marks: DataFrame, horizon: int, now: int) -> DataFrame:
    """Mode and backfill range: nothing stored, partly filled back to the horizon, or preloaded."""
    oldest, newest = F.col("oldest_at"), F.col("newest_at")
    limit = F.lit(now - horizon).cast("long")
    mode = F.when(newest.isNull(), "empty").when(oldest > limit, "partial").otherwise("preloaded")
    return marks.select(mode.alias("mode"), F.coalesce(newest, F.lit(now)).alias("forward_from"), F.when(mode != "preloaded", F.coalesce(oldest, F.lit(now))).alias("back_from"), F.when(mode != "preloaded", limit).alias("back_to"))


def in_page(df: DataFrame, end: int, width: int = WIDTH) -> DataFrame:
    return df.where((F.col("battle_at") > end - width) & (F.col("battle_at") <= end))


def _in_pages(rows: DataFrame, pages: DataFrame, width: int) -> DataFrame:
    """``rows`` (with battle_at) with page_no for each page with page_start < battle_at <= page_end.

    A range join as an equi-join on time slots of ``width``: a page lies in two slots at most.
    """
    slots = F.array_distinct(F.array(F.floor((F.col("page_start") + 1) / width), F.floor(F.col("page_end") / width)))
    p = pages.select("page_no", "page_start", "page_end", F.explode(slots).alias("slot"))
    d = rows.withColumn("slot", F.floor(F.col("battle_at") / width)).join(p, "slot")
    return d.where((F.col("battle_at") > F.col("page_start")) & (F.col("battle_at") <= F.col("page_end")))


def assign_pages(battles: DataFrame, pages: DataFrame, width: int = WIDTH) -> DataFrame:
    """battle_id, page_no for each page that covers a battle."""
    return _in_pages(battles.select("battle_id", "battle_at"), pages, width).select("battle_id", "page_no")


def page_coverage(battles: DataFrame, pages: DataFrame, width: int = WIDTH) -> DataFrame:
    """Battles in each page; pages without any have 0.

    Battles are counted by second before they meet pages, partly where they are read: however many of them an hour has, it
    comes to the join as 3,600 rows at most.
    """
    by_second = battles.groupBy("battle_at").agg(F.count("*").alias("battles"))
    n = _in_pages(by_second, pages, width).groupBy("page_no").agg(F.sum("battles").alias("battles"))
    return pages.join(n, "page_no", "left").select("page_no", "page_start", "page_end", F.coalesce("battles", F.lit(0)).alias("battles"))
