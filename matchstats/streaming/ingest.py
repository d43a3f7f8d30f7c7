"""Micro-batch ingest as one transaction, with incremental state, cells kept up by signed deltas, and rejected rows.

A micro-batch stores what is new: battles and their ids, the state of players and characters and the matchup counts that
these alone give (deltas), the rows that break a rule, and counts. Each is a folder of its own; a commit record, written last, makes them all
visible at once (see ``ledger``). A batch is known by its stream and number, so one that is delivered again changes
nothing, and neither a new checkpoint nor a second query replaces what another one stored. State merges are associative:
the state is the last snapshot merged with the deltas after it. ``compact`` folds these into a new snapshot, and many small
folders of battles into one; ``vacuum`` removes what is not named any more. No battle is read again for the state.

Ids are looked up in a table of their own, sorted by digest: a batch reads the pages that its digests fall into, so what
it reads does not grow with what is stored, but for the number of sorted folders, which grows with its logarithm.

Cells follow by signed deltas: the players of the batches since the last refresh are taken out as they were and put in as
they are now, so a player whose region, rank or main character moves leaves the cells of every version right, and no
other player is looked at. Which batches have their cells is in the records too, so it is not lost with the driver.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import cells, ingest, state
from ..operators import players as views
from ..schema import name_of
from ..storage import BROADCAST_ROWS
from .ledger import Conflict, Ledger, View

#: Seconds between two refreshes of cells.
COOLDOWN = 120
#: Files of a snapshot lie in so many parts by player, so that a few players are looked up in a few of them.
PARTS = 64
#: A batch of at most this many ids is looked up by their digests; a larger one is joined with all ids.
LOOKUP = 5_000
#: Digests in one pushed-down filter: it is a chain of comparisons, and a long one would overflow the reader's stack.
FILTER = 500
#: Rows of a page of ids, the least that a lookup reads for a digest.
PAGE = 1_000
_DAY = 86400


@dataclass
class Tables:
    """Tables under ``root``, as the commit records name them."""

    root: str

    def ledger(self, spark: SparkSession) -> Ledger:
        return Ledger(spark, self.root)

    def view(self, spark: SparkSession) -> View:
        return self.ledger(spark).view()

    def read(self, spark: SparkSession, folders: list[str]) -> DataFrame | None:
        """The rows of some folders, None for no folder."""
        if not folders:
            return None
        paths = [f"{self.root}/{f}" for f in folders]
        return spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths)

    def battles(self, spark: SparkSession, view: View | None = None) -> DataFrame | None:
        d = self.read(spark, [b[0] for b in (view or self.view(spark)).battles])
        return None if d is None else d.drop("day")

    def rejects(self, spark: SparkSession) -> DataFrame | None:
        """Rows that were not stored, with ``failed``: the rules that they break."""
        return self.read(spark, self.view(spark).rejects)

    def cells(self, spark: SparkSession, view: View | None = None, versions: list[int] | None = None) -> DataFrame | None:
        """Cells of all versions that have any, or of some."""
        own = (view or self.view(spark)).cells
        return self.read(spark, [f for v, f in sorted(own.items()) if versions is None or int(v) in versions])


def total_order(batch: DataFrame) -> list[Column]:
    """By time, then by content: the first of several rows of a battle is the same whatever order they arrive in."""
    return [F.col("battle_at"), F.xxhash64(*batch.columns)]


MATCHUP_SIDE = ["player_id", "character_id", "opp_character_id", "is_win"]
#: Columns that a battle has to have.
REQUIRED = ["battle_id", "battle_at", "game_version", "player1_id", "player2_id", "player1_character_id", "player2_character_id"]


def failed_rules(battles: DataFrame) -> Column:
    """The rules that a row breaks: not_null(column) for the columns that a battle has to have (a blank id counts as none), known(battle_type)."""
    kinds = {f.name: f.dataType for f in battles.schema}

    def missing(c: str) -> Column:
        blank = F.trim(c) == "" if kinds[c] == T.StringType() else F.lit(False)
        return F.col(c).isNull() | F.coalesce(blank, F.lit(False))

    rules = {f"not_null({c})": missing(c) for c in REQUIRED}
    rules["known(battle_type)"] = F.col("battle_type").isNotNull() & name_of("battle_type", F.col("battle_type")).isNull()
    return F.filter(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules.items())), lambda r: r.isNotNull())


def _near(view: View, days: tuple[int, int] | None) -> list[str]:
    """Folders of battles that have a day between ``days``."""
    return [f for f, _, low, high in view.battles if days is None or (low <= days[1] and high >= days[0])]


def _digest() -> Column:
    return F.xxhash64("battle_id")


def _write_ids(ids: DataFrame, path: str) -> None:
    """digest, battle_id in the order of digests over all files, in small pages: a digest lies in one page of one file."""
    d = ids.repartitionByRange("digest").sortWithinPartitions("digest")
    d.write.option("parquet.page.row.count.limit", PAGE).parquet(path)


@contextmanager
def _exact_filters(spark: SparkSession) -> Iterator[None]:
    """Lists of up to FILTER values reach the reader value by value, not as the range from the least to the greatest."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(FILTER))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_ids(spark: SparkSession, tables: Tables, view: View, wanted: list[int] | None = None) -> DataFrame | None:
    """digest and battle_id of all stored battles, or of those with one of some digests. None if not all battles have their ids listed, or there are none."""
    if not view.ids or sum(i[2] for i in view.ids) != view.ranked + view.unranked:
        return None
    d = tables.read(spark, [i[0] for i in view.ids])
    if wanted is None:
        return d
    runs = [F.col("digest").isin(wanted[k : k + FILTER]) for k in range(0, len(wanted), FILTER)]
    return d.where(reduce(lambda x, y: x | y, runs, F.lit(False)))


def _new_battles(good: DataFrame, tables: Tables, view: View, order: list | None, horizon: int | None) -> DataFrame:
    """The battles of a batch that are not stored: ids are looked up among all stored ones, or in the folders and days within ``horizon`` seconds of the batch."""
    spark = good.sparkSession
    fresh, stored = ingest.dedupe_first(good, ["battle_id"], order or total_order(good)), None
    if horizon is not None:
        low, high = good.agg(F.min("battle_at"), F.max("battle_at")).first()
        if low is None:
            return fresh
        days = (low - horizon) // _DAY, (high + horizon) // _DAY
        stored = tables.read(spark, _near(view, days))
        if stored is not None:
            stored = stored.where(F.col("day").between(*days)).where(F.col("battle_at").between(low - horizon, high + horizon))
    elif view.ids:
        wanted = [r[0] for r in good.select(_digest().alias("digest")).distinct().limit(LOOKUP + 1).collect()]
        stored = stored_ids(spark, tables, view, sorted(wanted) if len(wanted) <= LOOKUP else None)
    if stored is None and horizon is None:
        stored = tables.read(spark, [b[0] for b in view.battles])
    return fresh if stored is None else fresh.join(stored.select("battle_id"), "battle_id", "left_anti")


def ingest_batch(batch: DataFrame, batch_id: int, tables: Tables, order: list | None = None, horizon: int | None = None, stream: str = "") -> None:
    """Store what is new in a batch, its delta and counts, and the rows that break a rule, in one commit. A batch of a stream that is stored already changes nothing.

    Ids are looked up among all stored ones, by digest. Where a repeated battle is known to keep its time, ``horizon`` (seconds)
    restricts that to stored battles so close to the times of the batch: only folders of these days are read.
    """
    ledger = tables.ledger(batch.sparkSession)
    batch = batch.persist()  # a source is read once, as far as executors live
    try:
        while True:
            view = ledger.view()
            if view.has(stream, batch_id):
                return
            try:
                with _exact_filters(batch.sparkSession):
                    record = _written(batch, batch_id, tables, view, order, horizon, stream)
                ledger.commit(record, view.number, {"ingest"})
                return
            except Conflict:  # another stream stored a batch meanwhile: it may hold the same battles
                continue
    finally:
        batch.unpersist()


def _written(batch: DataFrame, batch_id: int, tables: Tables, view: View, order: list | None, horizon: int | None, stream: str) -> dict:
    """Writes the folders of a batch; the record that names them."""
    spark, ledger = batch.sparkSession, tables.ledger(batch.sparkSession)
    record = {"kind": "ingest", "stream": stream, "batch": batch_id, "ranked": 0, "unranked": 0, "rejected": {}, "versions": []}

    def write(df: DataFrame, table: str) -> tuple[str, DataFrame]:
        folder = ledger.new_folder(table)
        df.write.parquet(f"{tables.root}/{folder}")
        return folder, spark.read.schema(df.schema).parquet(f"{tables.root}/{folder}")

    failed = F.size(failed_rules(batch)) > 0
    fresh = _new_battles(batch.where(~failed), tables, view, order, horizon)
    folder, now = write(fresh.withColumn("day", F.floor(F.col("battle_at") / _DAY).cast("int")), "battles")
    is_ranked = F.coalesce(F.col("battle_type") == 2, F.lit(False))
    n = now.agg(F.count_if(is_ranked).alias("ranked"), F.count_if(~is_ranked).alias("unranked"), F.min("day").alias("low"), F.max("day").alias("high"), F.collect_set(F.when(is_ranked, F.col("game_version"))).alias("versions")).first()
    if n["low"] is not None:
        record |= {"battles": folder, "days": [n["low"], n["high"]], "ranked": n["ranked"], "unranked": n["unranked"], "versions": sorted(n["versions"])}
        record["ids"] = ledger.new_folder("ids")
        _write_ids(now.select(_digest().alias("digest"), "battle_id"), f"{tables.root}/{record['ids']}")
    if n["ranked"]:
        delta = state.character_state(ingest.to_sides(ingest.ranked(now), state.STATE_SIDE))
        record["delta"], _ = write(delta, "deltas")
        record["matchups"], _ = write(views.matchup_state(ingest.to_sides(ingest.ranked(now), MATCHUP_SIDE)), "matchups")
    folder, bad = write(batch.where(failed).withColumn("failed", failed_rules(batch)), "rejects")
    rejected = {r["rule"]: r["n"] for r in bad.select(F.explode("failed").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).collect()}  # a few rules
    if rejected:
        record |= {"rejects": folder, "rejected": rejected}
    return record


def _part(player: Column) -> Column:
    return F.pmod(F.xxhash64(player), F.lit(PARTS)).cast("int")


@dataclass
class Players:
    """Some players: their ids, whether these may be broadcast, and the parts of a snapshot that they lie in."""

    ids: DataFrame
    small: bool
    parts: list[int]

    def of(self, d: DataFrame) -> DataFrame:
        if "part" in d.columns:
            d = d.where(F.col("part").isin(self.parts))
        return d.join(F.broadcast(self.ids) if self.small else self.ids, "player_id", "left_semi")


def current_state(spark: SparkSession, tables: Tables, view: View | None = None, upto: int | None = None, players: Players | None = None) -> DataFrame | None:
    """State of all stored battles, or of those up to a record, or of some players: the snapshot merged with the deltas after it."""
    view, of = view or tables.view(spark), players.of if players else lambda d: d
    parts = []
    if view.state:
        parts.append(of(spark.read.parquet(f"{tables.root}/{view.state}")).drop("part"))
    deltas = tables.read(spark, [f for f, number in view.deltas if upto is None or number <= upto])
    if deltas is not None:
        parts.append(of(deltas))
    return state.merge_states(reduce(DataFrame.unionByName, parts)) if parts else None


def current_matchups(spark: SparkSession, tables: Tables, view: View | None = None, players: Players | None = None) -> DataFrame | None:
    """Matchup counts of all stored ranked battles, or of some players: the snapshot merged with the deltas after it. No battle is read."""
    view, of = view or tables.view(spark), players.of if players else lambda d: d
    parts = []
    if view.matchup_state:
        parts.append(of(spark.read.parquet(f"{tables.root}/{view.matchup_state}")).drop("part"))
    deltas = tables.read(spark, [f for f, _ in view.matchups])
    if deltas is not None:
        parts.append(of(deltas))
    return views.merge_matchups(reduce(DataFrame.unionByName, parts)) if parts else None


def some_players(ids: DataFrame) -> Players:
    """The players of ``ids`` (player_id), for ``current_state`` and ``current_matchups``."""
    ids = ids.select("player_id").distinct()
    by_part = ids.groupBy(_part(F.col("player_id")).alias("part")).agg(F.count("*").alias("n")).collect()  # PARTS rows at most
    return Players(ids, sum(r["n"] for r in by_part) <= BROADCAST_ROWS, sorted(r["part"] for r in by_part))


def _folding(ids: list[list]) -> list[list]:
    """The folders of ids to fold into one: those of single batches, and folded ones up to twice as large as what is folded so far.

    So each id is folded a logarithmic number of times, and as many folders are left.
    """
    out = [i for i in ids if i[1]]
    rows = sum(i[2] for i in out)
    for one in sorted((i for i in ids if not i[1]), key=lambda i: i[2]):
        if not out or one[2] > 2 * rows:
            break
        out.append(one)
        rows += one[2]
    return out if len(out) > 1 else []


def _by_player(d: DataFrame, path: str) -> None:
    """A snapshot: rows in parts by player."""
    d.withColumn("part", _part(F.col("player_id"))).repartition("part").sortWithinPartitions("part", "player_id").write.partitionBy("part").parquet(path)


def compact(spark: SparkSession, tables: Tables) -> None:
    """Fold the deltas into new snapshots, and the battles and ids of single batches into one folder. Batches may come in meanwhile: they are merged as deltas after it.

    Deltas that have no cells yet are needed for them one by one, and stay.
    """
    ledger, view = tables.ledger(spark), tables.view(spark)
    upto = min(view.number, view.fresh) if view.touched else view.number
    now = current_state(spark, tables, view, upto=upto) if any(n <= upto for _, n in view.deltas) else None
    if now is None:
        return
    folder = ledger.new_folder("snapshots")
    _by_player(now, f"{tables.root}/{folder}")
    record = {"kind": "compact", "state": folder, "upto": upto, "battles": None, "replaced": []}
    single = [b for b in view.battles if b[1]]
    if len(single) > 1:
        record["replaced"], battles = [b[0] for b in single], ledger.new_folder("battles")
        rows = tables.read(spark, record["replaced"])
        rows.repartitionByRange("day", "battle_id").sortWithinPartitions("day", "battle_id").write.parquet(f"{tables.root}/{battles}")
        record["battles"] = [battles, 0, min(b[2] for b in single), max(b[3] for b in single)]
    if view.matchups:
        record |= {"matchup_state": ledger.new_folder("snapshots"), "matchups_upto": view.number}
        _by_player(current_matchups(spark, tables, view), f"{tables.root}/{record['matchup_state']}")
    folded = _folding(view.ids)
    if folded:
        record["replaced_ids"], ids = [i[0] for i in folded], ledger.new_folder("ids")
        _write_ids(tables.read(spark, record["replaced_ids"]), f"{tables.root}/{ids}")
        record["ids"] = [ids, 0, sum(i[2] for i in folded)]
    ledger.commit(record, view.number, {"compact"})
    ledger.store_view()


def vacuum(spark: SparkSession, tables: Tables, grace: float = 7 * _DAY, now: float | None = None) -> list[str]:
    """Remove folders that nothing names any more, after ``grace`` seconds; the folders."""
    return tables.ledger(spark).vacuum(time.time() if now is None else now, grace)


def summary(spark: SparkSession, tables: Tables) -> DataFrame | None:
    """One row: ranked and unranked replays, players."""
    view = tables.view(spark)
    if not view.done:
        return None
    now = current_state(spark, tables, view)
    players = spark.range(1).select(F.lit(0).cast("long").alias("total_players")) if now is None else now.agg(F.count_distinct("player_id").alias("total_players"))
    return players.select(F.lit(view.ranked).cast("long").alias("total_ranked_replays"), F.lit(view.unranked).cast("long").alias("total_unranked_replays"), "total_players")


def rejected_counts(spark: SparkSession, tables: Tables) -> DataFrame:
    """constraint_name and violations of the rows that were not stored, as in ``constraint_report``."""
    found = tables.view(spark).rejected
    rules = [*(f"not_null({c})" for c in REQUIRED), "known(battle_type)"]
    return spark.createDataFrame([(r, found.get(r, 0)) for r in rules], "constraint_name string, violations long")


# ---- cells


def pending_versions(spark: SparkSession, tables: Tables, view: View | None = None) -> tuple[list[int], int]:
    """Versions of battles that came in since the last refresh, and the last record that has any."""
    view = view or tables.view(spark)
    return sorted({v for _, versions in view.touched for v in versions}), max((n for n, _ in view.touched), default=view.fresh)


def moved_players(spark: SparkSession, tables: Tables, view: View) -> Players:
    """Players of the batches since the last refresh."""
    return some_players(tables.read(spark, [f for f, number in view.deltas if number > view.fresh]))


def cell_deltas(spark: SparkSession, tables: Tables, view: View) -> DataFrame:
    """What the batches since the last refresh add to the cells (numbers may be negative): the players concerned as they are now, less as they were."""
    moved = moved_players(spark, tables, view)
    after = cells.build_cells(state.with_region(current_state(spark, tables, view, players=moved)))
    before = current_state(spark, tables, view, upto=view.fresh, players=moved)
    return after if before is None else cells.cell_changes(cells.build_cells(state.with_region(before)), after)


def refresh(spark: SparkSession, tables: Tables, now: float | None = None, cooldown: float = COOLDOWN) -> list[int]:
    """Bring the cells up to date, unless the last refresh is less than ``cooldown`` seconds ago; the versions whose cells changed.

    Batches stay pending until their cells are committed: a job that dies in between does them again.
    """
    now = time.time() if now is None else now
    while True:
        view = tables.view(spark)
        versions, upto = pending_versions(spark, tables, view)
        if not versions or (view.refreshed_at is not None and now - view.refreshed_at < cooldown):
            return []
        folder = tables.ledger(spark).new_folder("cells")
        delta = cell_deltas(spark, tables, view)
        cells.write_versions(delta, f"{tables.root}/{folder}-delta")
        delta = cells.read_versions(spark, f"{tables.root}/{folder}-delta")
        changed = sorted(r["game_version"] for r in delta.select("game_version").distinct().collect())  # a few versions
        old = tables.cells(spark, view, changed)
        try:
            _commit_cells(spark, tables, view, delta if old is None else cells.merge_cells(old, delta), changed, folder, upto, now)
            return changed
        except Conflict:  # another refresh was faster
            continue


def _commit_cells(spark: SparkSession, tables: Tables, view: View, new: DataFrame, versions: list[int], folder: str, upto: int, now: float | None) -> None:
    cells.write_versions(new, f"{tables.root}/{folder}")
    kept = {r["game_version"] for r in cells.read_versions(spark, f"{tables.root}/{folder}").select("game_version").distinct().collect()}
    own = {str(v): cells.version_folder(folder, v) if v in kept else None for v in versions}
    tables.ledger(spark).commit({"kind": "refresh", "cells": own, "fresh": upto, "at": now}, view.number, {"refresh"})


def refresh_versions(spark: SparkSession, tables: Tables, versions: list[int] | None) -> None:
    """Recompute the cells of some versions, or of all, from the state of all players. The batches that wait stay pending only if not all versions are done."""
    while True:
        view = tables.view(spark)
        # with pending batches, some versions alone would be ahead of the others: they are recomputed as of the last refresh
        now = current_state(spark, tables, view, upto=None if versions is None else view.fresh)
        if now is None:
            return
        new = cells.build_cells(state.with_region(now))
        new = new if versions is None else new.where(F.col("game_version").isin(versions))
        known = [int(v) for v in view.cells]
        folder = tables.ledger(spark).new_folder("cells")
        wanted = versions if versions is not None else sorted({*known, *(r["game_version"] for r in now.select("game_version").distinct().collect())})
        upto = view.fresh if versions is not None else max(view.fresh, pending_versions(spark, tables, view)[1])
        try:
            _commit_cells(spark, tables, view, new, wanted, folder, upto, view.refreshed_at)
            return
        except Conflict:
            continue


def start_ingest(stream: DataFrame, tables: Tables, checkpoint: str, order: list | None = None, horizon: int | None = None, **trigger) -> StreamingQuery:
    """Ingest a stream of battles. ``trigger``: availableNow=True by default. The checkpoint is what tells one stream from another; its progress reports rows and rows that break a rule."""

    def batch(df: DataFrame, batch_id: int) -> None:
        ingest_batch(df, batch_id, tables, order, horizon, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))

    seen = stream.observe("ingest", F.count("*").alias("rows"), F.count_if(F.size(failed_rules(stream)) > 0).alias("rejected"))
    return seen.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_refresh(spark: SparkSession, tables: Tables, every: str = "2 minutes") -> StreamingQuery:
    """Refresh pending cells at the pace of ``every``, beside ``start_ingest``; what waits is in the tables, so it may be stopped and started at will."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: refresh(spark, tables, cooldown=0)).trigger(processingTime=every).start()


def dedupe_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First row of each battle_id among overlapping pages; ``event_ts`` is added as the event time."""
    d = stream.withColumn("event_ts", F.timestamp_seconds("battle_at")).withWatermark("event_ts", delay)
    return d.dropDuplicatesWithinWatermark(["battle_id"])


def running_stats(battles: DataFrame) -> DataFrame:
    """Running wins and losses of each (player, character, version); for output mode update or complete."""
    sides = ingest.to_sides(ingest.ranked(battles), ["player_id", "character_id", "game_version", "is_win"])
    win = F.col("is_win").cast("long")
    return sides.groupBy("player_id", "character_id", "game_version").agg(F.sum(win).alias("wins"), F.sum(1 - win).alias("losses"))


def live_active(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Last time that each user was seen, for output mode update or complete; ``active_now`` reads it."""
    return events.groupBy(user).agg(F.max(ts).alias("last_seen"))


def active_now(seen: DataFrame, now: Column | None = None, seconds: int = 600) -> DataFrame:
    """Users of what ``live_active`` has put out that were seen in the last ``seconds``, newest first."""
    now = F.current_timestamp() if now is None else now
    last = seen.groupBy(*(c for c in seen.columns if c != "last_seen")).agg(F.max("last_seen").alias("last_seen"))  # update mode repeats users
    at = F.col("last_seen").cast("timestamp")
    return last.where((at > now - F.make_dt_interval(secs=F.lit(seconds))) & (at <= now)).orderBy(F.desc("last_seen"), *(c for c in last.columns if c != "last_seen"))


def active_windows(events: DataFrame, ts: str = "ts", width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events and approximate number of users in each window of event time, final once the watermark has passed."""
    d = events.withColumn("event_ts", F.col(ts).cast("timestamp")).withWatermark("event_ts", delay)
    d = d.groupBy(F.window("event_ts", width).alias("w")).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users_approx"))
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "users_approx")
