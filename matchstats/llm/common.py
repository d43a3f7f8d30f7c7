"""Helpers that the operators share: tables in the shared folder, checked joins, sampling, word hashing."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise, new_path  # noqa: F401  operators take them from here

#: White space of the contracts, as a Java and RE2 class: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of at most this many narrow rows may be broadcast (a few tens of bytes each).
BROADCAST_ROWS = 200_000
#: Rows in an Arrow batch: a batch of very long texts must fit in a Python worker.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Equi-join that broadcasts ``right`` only if it is known to be small; otherwise a shuffled join, which AQE splits where a key is hot.

    ``right`` has to be a written table, so that counting it reads no more than footers.
    """
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def first_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of one row of each key: the first by the row's JSON, so the same one however rows arrive."""
    row = F.struct(*(df[c].alias(c) for c in columns))
    return df.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("first_row")).select("first_row.*")


_SHIPPED: set[str] = set()


def python_workers(spark: SparkSession) -> None:
    """What Python in tasks needs: this package on the executors, and Arrow batches of a bounded size (texts may be very long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if (app := spark.sparkContext.applicationId) in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    file = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"  # read by the driver alone, which serves it to the executors
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(file))
    _SHIPPED.add(app)


def unit_hash(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from md5 of seed and key: 52 bits, the same in any engine that has md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(1 << 52))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def hash_sample(df: DataFrame, key: Column, expected: int, total: int, seed: int) -> DataFrame:
    """Rows whose hash falls under expected / total: a sample of a bounded expected size, the same on every run."""
    if total <= expected:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * expected / total))


def first_by_hash(df: DataFrame, keys: list[str], within: list[str], most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, by a hash of ``keys``: a bound that also holds where rows repeat."""
    if not within:
        some = df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(most)
        return some.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = fresh("place", df)
    w = Window.partitionBy(*within).orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
    return df.withColumn(at, F.row_number().over(w)).where(F.col(at) <= most).drop(at)


# ---- word hashes over Arrow string buffers ---------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
#: Bytes that are hashed at a time; a text is cut there between words only.
PIECE_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            full = np.full(n, base, dtype=np.uint64)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalising 64-bit mix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word (run of bytes that are not white space)."""
    word = np.empty(len(data) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes | np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, A-Z as a-z; words are runs without the white space of the contracts."""
    data = np.frombuffer(text, dtype=np.uint8) if isinstance(text, (bytes, memoryview)) else text
    out, at, byte = [], 0, _BYTE_LOWER if lower else _BYTE
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and not _IS_SPACE[data[end]]:  # to the next white space
            gap = np.flatnonzero(_IS_SPACE[data[end : end + PIECE_BYTES]])
            end = end + int(gap[0]) if len(gap) else min(end + PIECE_BYTES, len(data))
        piece = data[at:end]
        starts, ends = word_spans(piece)
        if len(starts):
            up, down = _powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(byte[piece] * up[: len(piece)], out=sums[1:])
            out.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, 0x51ED270B + n, dtype=np.uint64)
    for k in range(n):
        h = mixed(h * np.uint64(0xD1342543DE82EF95) + words[k : len(words) - n + 1 + k])
    return np.unique(h)


def texts_of(column) -> Iterator[bytes]:
    """UTF-8 of each string of an Arrow column without making Python strings; null counts as empty."""
    import pyarrow as pa

    for v in column.cast(pa.binary()):
        yield v.as_py() or b""
