"""Replay records: JSON files, pages as messages, and a page-wise data source."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.scalars import utc_date
from ..schema import WIRE, WIRE_SCHEMA

_PAGE = T.ArrayType(WIRE_SCHEMA)


def _columns(df: DataFrame) -> DataFrame:
    """Wire names to column names, and the ``date`` that ingest fills in."""
    return df.select(*(F.col(wire).alias(name) for wire, name, _ in WIRE), utc_date(F.col("battle_at")).alias("date"))


def read_battles(spark: SparkSession, path: str) -> DataFrame:
    """Battles from JSON files that hold one record or an array of records; user ids are read as strings."""
    return _columns(spark.read.schema(WIRE_SCHEMA).option("multiLine", True).json(path))


def decode_battles(c: Column) -> Column:
    """Array of records from a message's text."""
    return F.from_json(c, _PAGE)


def encode_battles(c: Column) -> Column:
    return F.to_json(c)


def to_wire(battles: DataFrame) -> DataFrame:
    return battles.select(*(F.col(name).alias(wire) for wire, name, _ in WIRE))


def write_battle_pages(battles: DataFrame, path: str, page: Column) -> None:
    """One message a page: value (JSON array) and fetched_for (the page), as lines of JSON."""
    d = battles.select(page.alias("fetched_for"), F.struct(*(F.col(name).alias(wire) for wire, name, _ in WIRE)).alias("r"))
    d.groupBy("fetched_for").agg(encode_battles(F.collect_list("r")).alias("value")).write.mode("append").json(path)


MESSAGE_SCHEMA = "fetched_for long, value string"


def read_battle_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of battles from message files; a broken message gives no rows."""
    return decoded_stream(spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path))


def decoded_stream(messages: DataFrame) -> DataFrame:
    """Battles of a stream with a text column ``value`` (files here, a message queue elsewhere)."""
    return _columns(messages.select(F.explode(decode_battles(F.col("value").cast("string"))).alias("r")).select("r.*"))


class _Page(InputPartition):
    def __init__(self, end: int, round: int = 0):
        super().__init__((end, round))
        self.end, self.round = end, round


class ReplayPages(DataSource):
    """``spark.read.format("replay_pages")``: a partition for each page; options path (a folder of ``<end>.json`` arrays), start, end, step.

    A page that is missing or broken is skipped, as a failed fetch would be. As a stream (``readStream``), it goes on from two
    marks in both directions and fetches failed pages again, see ``read_page_stream``.
    """

    @classmethod
    def name(cls) -> str:
        return "replay_pages"

    def schema(self) -> T.StructType:
        return WIRE_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _PageStream(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.ends = range(int(options["end"]), int(options["start"]) - 1, -int(options.get("step", 640)))

    def partitions(self) -> list[InputPartition]:
        return [_Page(t) for t in self.ends]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return iter(_fetched(self.path, partition.end) or [])


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _fetched(path: str, end: int) -> list[tuple] | None:
    """Rows of a page, None if it cannot be fetched."""
    files, root = _files(path)
    try:
        with files.open_input_stream(f"{root}/{end}.json") as f:
            records = json.loads(f.read())
    except (OSError, ValueError):
        return None
    return [tuple(str(v) if v is not None and isinstance(k.dataType, T.StringType) else v for k, v in ((f, r.get(f.name)) for f in WIRE_SCHEMA)) for r in records]


class _PageStream(DataSourceStreamReader):
    """Offsets: the newest page end that was asked for, the oldest one, the failed pages to fetch again, and a count of rounds.

    A task that cannot fetch its page leaves a note in the folder of notes, which the next offset takes up. One that can
    removes it if it is of an earlier round: where a batch is read more than once, a page that failed once in it is
    fetched again in the next one, and counts as tried once. What a batch fetches follows from its two offsets alone, so a batch that is done again fetches the same pages.
    """

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("step", 640))
        self.most, self.tries = int(options.get("pages", 100)), int(options.get("tries", 10))
        self.first, self.limit = int(options["forward_from"]), options.get("back_to")
        self.back = int(options.get("back_from", self.first))
        self.now = options.get("now")
        self.files, self.notes = _files(options["notes"])
        self.files.create_dir(self.notes, recursive=True)
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"forward": self.first, "back": self.back, "again": [], "round": 0}

    def _noted(self) -> dict[int, tuple[int, int]]:
        """Failed pages: how often they were tried, and in which round last."""
        from pyarrow import fs

        out = {}
        for f in self.files.get_file_info(fs.FileSelector(self.notes)):
            if f.base_name.endswith(".failed"):
                end, *last = map(int, f.base_name.split(".")[:3])
                out[end] = max(tuple(last), out.get(end, (0, 0)))
        return out

    def _progress(self) -> dict:
        if self.at is None:
            try:
                with self.files.open_input_stream(f"{self.notes}/progress.json") as f:
                    self.at = json.loads(f.read())
            except FileNotFoundError:
                self.at = self.initialOffset()
        return self.at

    def latestOffset(self) -> dict:
        import time

        at, now = self._progress(), int(self.now) if self.now else int(time.time())
        ahead = min((now - at["forward"]) // self.step, self.most)
        left = self.most - max(ahead, 0)
        # the page of the oldest mark itself comes first
        back = at["back"] - self.step * min(max(0, -(-(at["back"] - int(self.limit)) // self.step)), left) if self.limit else at["back"]
        again = sorted(end for end, (tries, _) in self._noted().items() if tries < self.tries)[: self.most]
        new = {"forward": at["forward"] + self.step * max(ahead, 0), "back": back, "again": again}
        moved = again or any(new[k] != at[k] for k in ("forward", "back"))
        return new | {"round": at["round"] + 1} if moved else at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        forward = range(start["forward"] + self.step, end["forward"] + 1, self.step)
        return [_Page(t, end["round"]) for t in dict.fromkeys([*reversed(forward), *range(start["back"], end["back"], -self.step), *end["again"]])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        rows = _fetched(self.path, partition.end)
        tries, last = self._noted().get(partition.end, (0, -1))
        note = lambda n, r: f"{self.notes}/{partition.end}.{n}.{r}.failed"
        if last != partition.round:
            if rows is None:
                self.files.open_output_stream(note(tries + 1, partition.round)).close()
            if tries:
                self.files.delete_file(note(tries, last))
        return iter(rows or [])

    def commit(self, end: dict) -> None:
        with self.files.open_output_stream(f"{self.notes}/progress.json") as f:
            f.write(json.dumps(end).encode())


def read_pages(spark: SparkSession, path: str, start: int, end: int, step: int = 640) -> DataFrame:
    spark.dataSource.register(ReplayPages)
    return _columns(spark.read.format("replay_pages").options(path=path, start=str(start), end=str(end), step=str(step)).load())


def read_page_stream(plan: DataFrame, path: str, notes: str, step: int = 640, now: int | None = None, pages: int = 100, tries: int = 10) -> DataFrame:
    """Stream of battles from pages: forward from the newest mark to the present, and back from the oldest one to the horizon, ``pages`` a batch at most.

    ``plan`` is the row of ``backfill.resume_plan``, for the first start; later ones go on from the checkpoint. A page that cannot be fetched
    is fetched again in the batches after, ``tries`` times at most; ``notes`` is a folder that driver and executors
    share, which says what failed. Pages overlap, so repeats are for ``dedupe_stream`` or the ingest to drop.
    """
    spark, row = plan.sparkSession, plan.first()
    spark.dataSource.register(ReplayPages)
    options = {"path": path, "notes": notes, "step": str(step), "pages": str(pages), "tries": str(tries), "forward_from": str(row["forward_from"])}
    if row["back_from"] is not None:
        options |= {"back_from": str(row["back_from"]), "back_to": str(row["back_to"])}
    if now is not None:
        options["now"] = str(now)
    return _columns(spark.readStream.format("replay_pages").options(**options).load())
