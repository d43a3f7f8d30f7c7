"""Operators with a state of their own for each key: running statistics with the rank of the latest battle, users that leave.

State lives in the RocksDB store, so it is bounded by disk, is kept in the checkpoint and moves with a restart. Merging is
that of ``operators.state``: counters add up, the rank is that of the latest battle, of equal times that of the
lowest battle_id, so the order in which battles come in does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest

_KEY = ["player_id", "character_id", "game_version"]
STATS = "player_id string, character_id string, game_version int, dan_rank int, latest_battle long, wins long, losses long"
ACTIVITY = "user_id long, last_seen timestamp, active boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need; for all queries that start after it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _RunningStats(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stats = handle.getValueState("stats", "t long, id string, dan_rank int, wins long, losses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t, battle, rank, wins, losses = self.stats.get() if self.stats.exists() else (None, None, None, 0, 0)
        for d in rows:
            wins, losses = wins + int(d["is_win"].sum()), losses + int((~d["is_win"]).sum())
            for at, i, r in zip(d["battle_at"], d["battle_id"], d["dan_rank"], strict=True):
                if t is None or (-at, i) < (-t, battle):
                    t, battle, rank = int(at), i, None if pd.isna(r) else int(r)
        self.stats.update((t, battle, rank, wins, losses))
        yield pd.DataFrame([(*key, rank, t, wins, losses)], columns=[c.split()[0] for c in STATS.split(", ")]).astype({"dan_rank": "Int32"})

    def close(self) -> None:
        pass


def running_stats(battles: DataFrame) -> DataFrame:
    """Rank, latest battle, wins and losses of each (player, character, version) of a stream of battles without repeats; output mode update: a row of a key replaces the one before."""
    sides = ingest.to_sides(ingest.ranked(battles), ["battle_id", "battle_at", *_KEY, "dan_rank", "is_win"])
    use_rocksdb(battles.sparkSession)
    return sides.groupBy(*_KEY).transformWithStateInPandas(_RunningStats(), STATS, "update", "none")


class _Activity(StatefulProcessor):
    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")  # milliseconds

    @staticmethod
    def _row(key, at: int, active: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "last_seen": [pd.Timestamp(at, unit="ms")], "active": [active]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.seen.get()[0] if self.seen.exists() else None
        new = max(int(d["at"].max()) for d in rows)
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old + 1000 * self.seconds)
            self.seen.update((new,))
            self.handle.registerTimer(new + 1000 * self.seconds)
            yield self._row(key, new, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.seen.get()[0]
        self.seen.clear()
        yield self._row(key, at, False)

    def close(self) -> None:
        pass


def active_users(events: DataFrame, seconds: int = 600, user: str = "user_id", ts: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """A row when a user is seen later than before, and one with ``active`` false when event time has passed ``seconds`` without them.

    A user leaves the state with that row: the state holds the users of the last ``seconds`` (and ``delay``) alone. Output mode append.
    """
    use_rocksdb(events.sparkSession)
    at = F.col(ts).cast("timestamp")
    d = events.select(F.col(user).cast("long").alias("user_id"), at.alias("seen_at"), F.unix_millis(at).alias("at")).where("user_id IS NOT NULL AND at IS NOT NULL")
    d = d.withWatermark("seen_at", delay)
    return d.groupBy("user_id").transformWithStateInPandas(_Activity(seconds), ACTIVITY, "append", "eventTime")
