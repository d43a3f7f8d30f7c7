"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``), and small files in any store that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: A side of at most this many narrow rows may be broadcast (a few tens of bytes each).
BROADCAST_ROWS = 200_000
#: A task sorts about so many rows of sides or histories (some 300 bytes each in memory) at most.
TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        folder = _OWN[context.applicationId]
    return folder.rstrip("/")


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of ``rows`` rows that are sorted after it: the session's number, more where a task would get more than TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- single files


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stamp(spark: SparkSession, path: str) -> tuple | None:
    """Time of change and length of a file, or of all files of a folder that is a table; None if it is not there."""
    files, at = _at(spark, path)
    if not files.exists(at):
        return None
    status = files.getFileStatus(at)
    if not status.isDirectory():
        return status.getModificationTime(), status.getLen()
    # a file that is written anew has another time
    found, below = [], files.listFiles(at, True)
    while below.hasNext():
        one = below.next()
        found.append((one.getModificationTime(), one.getLen()))
    return tuple(sorted(found))


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Name and time of change (milliseconds) of what a folder holds, by name; nothing if it is not there."""
    files, at = _at(spark, folder)
    if not files.exists(at):
        return []
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(at))


def read_text(spark: SparkSession, path: str) -> str:
    files, at = _at(spark, path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, unless there is one of that name: whoever comes second gets False."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, at = _at(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}.tmp")
    stream = files.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE  # does not replace
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(files.makeQualified(part), files.makeQualified(at), options)
        return True
    except Py4JJavaError:
        files.delete(part, False)
        if not files.exists(at):
            raise
        return False


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
