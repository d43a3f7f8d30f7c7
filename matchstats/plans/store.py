"""The tables that statistics are answered from: battles without repeats, state, players, matchups, cells, search postings.

They are derived from the star-schema tables of a folder, each the first time that a session asks for it (battles in one pass
over the line items, the others from battles or state), and written to the shared folder. State, players and matchups lie in the same
buckets by player, so they are joined, grouped and ranked by player without an exchange, and a few players are looked up in a few buckets;
cells are partitioned by version. Sides are dealt out to the buckets as they are, and sorted and aggregated there: a bucket is
small at any size of the input, a part of the battles is not. All are derived again if the tables of the folder have
changed since, if the written ones are gone, or after ``forget``.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures
from ..operators import cells, ingest, players, state
from ..operators.search import SearchIndex
from ..storage import exists, new_path, parts, stamp


class Store:
    _BUILT: dict[tuple, Store] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.paths = spark, []
        self.battles = self._written("battles", fixtures.battles(spark, sf_dir))
        self.buckets = parts(spark, 2 * self.battles.count())

    def _sides(self, columns: list[str]) -> DataFrame:
        """Sides of ranked battles, in the buckets."""
        return ingest.to_sides(ingest.ranked(self.battles), columns).repartition(self.buckets, "player_id")

    @cached_property
    def matchups(self) -> DataFrame:
        return self._bucketed("matchups", players.matchup_state(self._sides(["player_id", "character_id", "opp_character_id", "is_win"])))

    @cached_property
    def state(self) -> DataFrame:
        return self._bucketed("state", state.character_state(self._sides(state.STATE_SIDE)))

    @cached_property
    def players(self) -> DataFrame:
        return self._bucketed("players", state.players(state.merge_players(self.state)))

    @cached_property
    def cells(self) -> DataFrame:
        built = cells.build_cells(state.with_region(self.state))
        path = self._path("cells")
        cells.write_cells(built, path)
        return cells.read_cells(self.spark, path)

    def _path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        path = self._path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _bucketed(self, name: str, df: DataFrame) -> DataFrame:
        """Written in buckets by player: a task writes one."""
        path, table = self._path(name), f"matchstats_{name}_{uuid.uuid4().hex}"
        d = df.repartition(self.buckets, "player_id")
        d.write.bucketBy(self.buckets, "player_id").sortBy("player_id").option("path", path).format("parquet").saveAsTable(table)
        return self.spark.table(table)

    @property
    def stats(self) -> DataFrame:
        return state.character_stats(self.state)

    @cached_property
    def search(self) -> SearchIndex:
        return SearchIndex.build(self.players, self._path("search"))

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Store:
        key = (spark.sparkContext.applicationId, sf_dir, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in fixtures.TABLES))
        found = cls._BUILT.get(key)
        if found is None or not all(exists(spark, p) for p in found.paths):
            found = cls._BUILT[key] = cls(spark, sf_dir)
        return found

    @classmethod
    def forget(cls) -> None:
        cls._BUILT.clear()
