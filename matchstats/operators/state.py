"""Running state of players and characters.

A state row carries, beside each last-writer-wins attribute, the (time, battle) it comes from, so merging
states is associative and commutative: batches may arrive late, in any order, or in pieces. Times are
stored negated (``t = -battle_at``), so the smallest key is the latest battle, and of equal times the
lowest battle_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import ranked, to_sides

_KEY = ["player_id", "character_id", "game_version"]


def _latest() -> Column:
    return F.struct((-F.col("battle_at")).alias("t"), F.col("battle_id").alias("id"))


def latest_by(df: DataFrame, key: list[str], ts: str, tie: str, cols: list[str]) -> DataFrame:
    """``cols`` of the row of greatest ``ts`` of each key; of equal ones, the row of lowest ``tie``."""
    order = F.struct((-F.col(ts)).alias("t"), F.col(tie).alias("id"))
    return df.groupBy(*key).agg(*(F.min_by(c, order).alias(c) for c in cols), F.max(ts).alias(ts))


# ---- players


def merge_players(d: DataFrame) -> DataFrame:
    """Player states merged by player; takes those of characters too, as they carry the same attributes."""
    by = {"polaris_id": "first_key", "name": "last_key", "power": "last_key", "region_id": "region_key", "language": "language_key"}
    keys = [F.min(k).alias(k) for k in ("first_key", "last_key", "region_key", "language_key")]
    return d.groupBy("player_id").agg(*(F.min_by(c, k).alias(c) for c, k in by.items()), *keys)


def player_state(sides: DataFrame) -> DataFrame:
    """State of players from (ranked) sides: attributes of the latest battle; the region and language are the latest that are known; polaris_id is the first seen."""
    first = F.struct(F.col("battle_at").alias("t"), F.col("battle_id").alias("id"))
    return merge_players(
        sides.select(
            "player_id", "polaris_id", "name", "power", "region_id", "language", first.alias("first_key"), _latest().alias("last_key"),
            F.when(F.col("region_id").isNotNull(), _latest()).alias("region_key"), F.when(F.col("language").isNotNull(), _latest()).alias("language_key"),
        )
    )


def upsert_players(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge two states; a full row is never rewritten by an older one."""
    return merge_players(target.unionByName(batch))


def players(state: DataFrame) -> DataFrame:
    return state.select("player_id", "polaris_id", "name", "region_id", "language", (-F.col("last_key.t")).alias("latest_battle"), "power")


# ---- character statistics


def _merge_stats(d: DataFrame) -> DataFrame:
    return d.groupBy(*_KEY).agg(F.min_by("dan_rank", "last_key").alias("dan_rank"), F.min("last_key").alias("last_key"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


def stats_delta(sides: DataFrame) -> DataFrame:
    """Increments of a batch by (player, character, version)."""
    win = F.col("is_win").cast("long")
    return _merge_stats(sides.select(*_KEY, "dan_rank", _latest().alias("last_key"), win.alias("wins"), (1 - win).alias("losses")))


def upsert_character_stats(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters add up whatever the order; the rank is that of the latest battle."""
    return _merge_stats(target.unionByName(delta))


def character_stats(state: DataFrame) -> DataFrame:
    return state.select(*_KEY, "dan_rank", (-F.col("last_key.t")).alias("latest_battle"), "wins", "losses")


# ---- both in one


#: What ``character_state`` reads of a side.
STATE_SIDE = ["battle_id", "battle_at", *_KEY, "dan_rank", "is_win", "polaris_id", "name", "power", "region_id", "language"]


def merge_states(d: DataFrame) -> DataFrame:
    by = {"dan_rank": "last_key", "polaris_id": "first_key", "name": "last_key", "power": "last_key", "region_id": "region_key", "language": "language_key"}
    keys = [F.min(k).alias(k) for k in ("first_key", "last_key", "region_key", "language_key")]
    return d.groupBy(*_KEY).agg(*(F.min_by(c, k).alias(c) for c, k in by.items()), *keys, *(F.sum(c).alias(c) for c in ("wins", "losses")))


def character_state(sides: DataFrame) -> DataFrame:
    """Counters, rank and player attributes of each (player, character, version), with the times that they come from.

    One pass over (ranked) sides gives it; ``character_stats``, and ``players`` of ``merge_players``, follow from it alone.
    """
    first = F.struct(F.col("battle_at").alias("t"), F.col("battle_id").alias("id"))
    win = F.col("is_win").cast("long")
    return merge_states(
        sides.select(
            *_KEY, "dan_rank", "polaris_id", "name", "power", "region_id", "language", first.alias("first_key"), _latest().alias("last_key"),
            F.when(F.col("region_id").isNotNull(), _latest()).alias("region_key"), F.when(F.col("language").isNotNull(), _latest()).alias("language_key"),
            win.alias("wins"), (1 - win).alias("losses"),
        )
    )


def with_region(state: DataFrame) -> DataFrame:
    """Statistics with the region of their player and total_plays: the player's rows are in one place anyway for the main character, so this is a window, not a join."""
    region = F.min_by("region_id", "region_key").over(Window.partitionBy("player_id"))
    d = state.withColumn("region_id", region).withColumn("total_plays", F.col("wins") + F.col("losses"))
    return d.select(*_KEY, "dan_rank", (-F.col("last_key.t")).alias("latest_battle"), "wins", "losses", "region_id", "total_plays")


def rebuild_character_stats(battles: DataFrame) -> DataFrame:
    """Full recomputation from ranked battles."""
    return character_stats(stats_delta(to_sides(ranked(battles), ["battle_id", "battle_at", *_KEY, "dan_rank", "is_win"])))


def replace_counts(target: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Counts of ``rebuilt`` replace those of ``target``; other attributes stay; new keys are added."""
    t, r = target.alias("t"), rebuilt.alias("r")
    d = t.join(r, _KEY, "full_outer")
    new = F.col("t.wins").isNull()
    pick = lambda c: F.when(new, F.col(f"r.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return d.select(*_KEY, pick("dan_rank"), pick("latest_battle"), *(F.coalesce(f"r.{c}", f"t.{c}").alias(c) for c in ("wins", "losses")))


def reconcile_character_stats(stored: DataFrame, battles: DataFrame) -> DataFrame:
    """Rows whose stored counts differ from a rebuild; a side that lacks the key has NULLs."""
    old = stored.select(*_KEY, F.col("wins").alias("stored_wins"), F.col("losses").alias("stored_losses"))
    new = rebuild_character_stats(battles).select(*_KEY, F.col("wins").alias("rebuilt_wins"), F.col("losses").alias("rebuilt_losses"))
    same = F.col("stored_wins").eqNullSafe(F.col("rebuilt_wins")) & F.col("stored_losses").eqNullSafe(F.col("rebuilt_losses"))
    return old.join(new, _KEY, "full_outer").where(~same)


def summary_counters(battles: DataFrame, player_rows: DataFrame) -> DataFrame:
    """One row: ranked and unranked replays, players."""
    is_ranked = F.coalesce(F.col("battle_type") == 2, F.lit(False))
    counts = battles.agg(F.count_if(is_ranked).alias("total_ranked_replays"), F.count_if(~is_ranked).alias("total_unranked_replays"))
    return counts.join(player_rows.agg(F.count("*").alias("total_players")), how="cross")  # one row each


def affected_versions(inserted: DataFrame) -> DataFrame:
    """Versions whose cells a batch changes."""
    return ranked(inserted).select("game_version").distinct()
