"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 has the first chunk of every id, level 1 the
second chunk of the ids that have one, and so on; one bit a chunk says whether the id goes on, and a
rank directory (ones before each block of 512 bits) tells where in the next level. So any id is read
from a chunk, a bit and a rank a level, without decoding a block; a range of ids is a range in every
level.

File, little-endian: magic ``DAC1``; levels u32; documents u64; ids u64; doc_id i64 each; a byte each
that is 1 if doc_id is null; first id of each document and their number, u64; then for each level: entries u64,
chunks u8 each (padded to 8 bytes), bitmap u64 words, ranks u64.

Documents are range-partitioned and sorted by (doc_id, hash of text), a total order up to equal rows, so
a doc_id that very many rows share is spread over partitions. Each task encodes its documents and
writes files of a bounded number of ids; a manifest (one row a file, written by Spark) names the files
of the tasks that succeeded, so what a lost executor wrote twice is never read. The driver sees the
manifest alone, to number the ids across files.

Cases: null text is empty (its document has the end id alone); null doc_ids come first; rows that repeat
a doc_id are documents of their own; an empty table gives no file and an empty result; other columns
of the input do not matter.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from json import loads

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _powers, materialise, mixed, new_path, python_workers, texts_of

MAGIC, BITS, BLOCK_WORDS = b"DAC1", 8, 8
#: Ids in one file at most, beyond its last document.
FILE_IDS = 1 << 22
END_ID = 1


# ---- the codes -------------------------------------------------------------------------------


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap words, ranks) of unsigned 32-bit ids."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        high = rest >> BITS
        more = high > 0
        words = -(-len(rest) // 64)
        bits = np.zeros(words * 8, dtype=np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        bitmap = bits.view("<u8")
        ones = np.bitwise_count(bitmap).astype(np.uint64)
        before = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ones, dtype=np.uint64)])
        levels.append(((rest & ((1 << BITS) - 1)).astype(np.uint8), bitmap, before[::BLOCK_WORDS].copy()))
        rest = high[more]
        if not len(rest):
            return levels


class Codes:
    """Random access to the ids of encoded levels."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Ones in the bitmap before position i."""
        _, bitmap, ranks = self.levels[level]
        word, bit = divmod(i, 64)
        block = word // BLOCK_WORDS
        n = int(ranks[block]) + int(np.bitwise_count(bitmap[block * BLOCK_WORDS : word]).sum())
        return n + (int(bitmap[word]) & ((1 << bit) - 1)).bit_count() if bit else n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        out = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out |= int(chunks[i]) << (BITS * level)
            if not int(bitmap[i // 64]) >> (i % 64) & 1:
                break
            i = self._rank(level, i)
        return out

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1."""
        out, at = np.zeros(b - a, dtype=np.uint32), np.arange(b - a)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(BITS * level)
            first = a // 64
            bits = np.unpackbits(bitmap[first : -(-b // 64)].view(np.uint8), bitorder="little")[a - first * 64 : b - first * 64]
            at, a = at[bits == 1], self._rank(level, a)
            b = a + len(at)
        return out


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = encode(ids)
    out = [MAGIC, struct.pack("<IQQ", len(levels), len(doc_ids), len(ids))]
    out.append(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes())
    out.append(bytes(d is None for d in doc_ids))
    out.append(np.asarray(starts, dtype="<u8").tobytes())
    for chunks, bitmap, ranks in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bytes(-len(chunks) % 8), bitmap.astype("<u8").tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """doc_ids, first id of each document (and the number of ids), codes."""
    if data[:4] != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    n_levels, n_docs, _ = struct.unpack_from("<IQQ", data, 4)
    at = 24

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    doc_ids, null, starts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1)
    levels = []
    for _ in range(n_levels):
        n = int(take("<u8", 1)[0])
        chunks = take("u1", n)
        at += -n % 8
        words = -(-n // 64)
        bitmap = take("<u8", words)
        levels.append((chunks, bitmap, take("<u8", -(-(words + 1) // BLOCK_WORDS))))
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], starts, Codes(levels)


# ---- tokenizing ------------------------------------------------------------------------------

#: Units that a worker remembers at most, and bytes of text taken at a time.
MEMO_UNITS, RECENT_UNITS, TEXT_BYTES = 1_500_000, 150_000, 1 << 21
_TOKENIZERS: dict[str, UnitEncoder | TextEncoder] = {}

# Fixed value: the cuts of the tokenizers whose texts are taken in units.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Kinds of bytes: white space, letter, digit, mark, other. A word of the first four kinds alone is cut into
# runs of letters, runs of marks and single digits, as the tokenizer does; any other word stays whole.
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.int8)
_KIND[list(b" \t\n\v\f\r")] = _SPACE
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(b"!#$%&()*+,-./:;=?@[]_{}")] = _MARK
#: Second bytes, after 0xC3, of the letters U+00C0 to U+00FF.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


class UnitEncoder:
    """Encodes texts with a tokenizer that lower-cases, drops white space and never merges across letters, marks and digits.

    So the ids of a text are those of its units one after the other. The units of many texts are found
    and hashed (64 bits) in numpy; the tokenizer encodes each distinct unit once, and ids are remembered.
    """

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the executor's cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self._forget()

    def _forget(self) -> None:
        """Two tables of (key, first id in the pool, number of ids), sorted by key: a large one and a recent one."""
        self.pool = np.zeros(0, dtype=np.uint32)
        self.tables = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in range(2)]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 where it is new."""
        first, number = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for known, at, n in self.tables:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                first[hit], number[hit] = at[i[hit]], n[i[hit]]
        return first, number

    def _units(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and key of each unit; ``data`` ends with white space."""
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_LATIN[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        low = _TO_LOWER[data]
        capital = lead[(data[lead + 1] < 0x9F) & (data[lead + 1] != 0x97)] + 1
        low[capital] += 0x20
        inside = np.concatenate([[0], (kind != _SPACE).astype(np.int8)])
        edge = np.diff(inside, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        others = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        whole = others[ends] > others[starts]
        mask = np.zeros(len(data) + 1, dtype=np.int8)
        mask[starts[whole]] += 1
        mask[ends[whole]] -= 1
        in_whole = np.cumsum(mask)[:-1] > 0
        low[in_whole] = data[in_whole]
        begin = (kind != _SPACE) & ~in_whole
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begin[starts] = True
        stop = kind != _SPACE
        stop[:-1] &= begin[1:] | (kind[1:] == _SPACE)
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * up[: len(data)], out=sums[1:])
        return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw, dtype=np.uint8)
        starts, ends, keys = self._units(data)
        own, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if sum(len(t[0]) for t in self.tables) > MEMO_UNITS:
            self._forget()
        first, number = self._look_up(own)
        new = np.flatnonzero(first < 0)
        if len(new):
            units = [raw[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            number[new] = [len(x) for x in ids]
            first[new] = len(self.pool) + np.cumsum(number[new]) - number[new]
            self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), dtype=np.uint32)])
            self.tables[1] = self._merged(self.tables[1], (own[new], first[new], number[new]))
            if len(self.tables[1][0]) > RECENT_UNITS:
                self.tables = [self._merged(*self.tables), tuple(x[:0] for x in self.tables[1])]
        n = number[back]
        total = np.cumsum(n)
        flat = self.pool[np.repeat(first[back] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        per_text = np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)
        return np.split(flat, np.cumsum(per_text)[:-1])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text (UTF-8)."""
        out, k = [], 0
        while k < len(texts):
            if len(texts[k]) > TEXT_BYTES:  # a very long text in parts, cut at white space
                parts, at, text = [], 0, texts[k]
                while at < len(text):
                    end = len(text) if at + TEXT_BYTES >= len(text) else text.rfind(b" ", at, at + TEXT_BYTES) + 1 or text.find(b" ", at) + 1 or len(text)
                    parts.append(text[at:end])
                    at = end
                out.append(np.concatenate([self._encode([p])[0] for p in parts]))
                k += 1
                continue
            n, size = k, 0
            while n < len(texts) and size + len(texts[n]) <= TEXT_BYTES:
                size += len(texts[n]) + 1
                n += 1
            out += self._encode(texts[k : max(n, k + 1)])
            k = max(n, k + 1)
        return out


class TextEncoder:
    """Encodes whole texts with any tokenizer."""

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, dtype=np.uint32) for t in texts]


def takes_units(json: str) -> bool:
    """Whether the tokenizer normalises and cuts texts in the way that ``UnitEncoder`` does."""
    t = loads(json)
    normal, cut, model = t.get("normalizer") or {}, t.get("pre_tokenizer") or {}, t["model"]
    steps = [x.get("pattern", {}).get("Regex", x["type"]) for x in normal.get("normalizers", [])]
    cuts = [(x.get("pattern", {}).get("Regex", x["type"]), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in cut.get("pretokenizers", [])]
    plain = model.get("type") == "BPE" and not model.get("dropout") and not t.get("truncation") and not t.get("padding")
    return plain and steps == ["NFC", r"\s+", "Lowercase"] and cuts == [(_CUTS, "Removed", True, None, None), ("ByteLevel", None, None, False, False)]


def _encoder(json: str) -> UnitEncoder | TextEncoder:
    key = hashlib.sha1(json.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = UnitEncoder(json) if takes_units(json) else TextEncoder(json)
    return _TOKENIZERS[key]


# ---- files -----------------------------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


#: Tasks that read files, at most; each takes one after the other.
READ_TASKS = 8192
_MANIFEST = "part int, file int, path string, docs long, ids long"


def write(docs: DataFrame, tokenizer_json: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) as files under ``folder``; the manifest, one row a file."""
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        file_system, root = _file_system(folder)
        file_system.create_dir(root, recursive=True)
        end = np.array([end_id], dtype=np.uint32)
        encoder, names, lengths, held, files = None, [], [], [], 0

        def flush():
            nonlocal files
            path = f"{root}/{part:06d}-{files:04d}-{uuid.uuid4().hex}.dac"
            ids = np.concatenate(held)
            with file_system.open_output_stream(path) as out:
                out.write(pack(names, np.concatenate([[0], np.cumsum(lengths)]), ids))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([files], pa.int32()), "path": [path], "docs": pa.array([len(names)], pa.int64()), "ids": pa.array([len(ids)], pa.int64())})
            files += 1
            for x in (names, lengths, held):
                x.clear()
            return row

        for batch in batches:
            encoder = encoder or _encoder(shared.value)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder([*texts_of(batch.column(1))]), strict=True):
                names.append(doc_id)
                held += [ids, end]
                lengths.append(len(ids) + 1)
            if sum(lengths) >= FILE_IDS:
                yield flush()
        if names:
            yield flush()

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    return materialise(d.select("doc_id", "text").mapInArrow(run, _MANIFEST), "dac-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    spark = manifest.sparkSession
    python_workers(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    before = (Window.unboundedPreceding, -1)
    # one row a part, of which there are as many as tasks wrote files
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("part_base"))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(*before)), F.lit(0))
    todo = manifest.withColumn("own_base", own).join(parts, "part").select("path", (F.col("part_base") + F.col("own_base")).alias("base"))
    todo = materialise(todo, "dac-bases")
    todo = todo.repartition(max(1, min(todo.count(), READ_TASKS)), "path")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _file_system(folder)[0].open_input_stream(path) as f:
                    doc_ids, starts, codes = unpack(f.read())
                crc = [zlib.crc32(codes.range(int(a), int(b)).astype("<u4")) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                starts = starts.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return todo.mapInArrow(run, schema)


def op4(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:  # on the driver; tasks get its text
        json = f.read()
    folder = new_path(docs.sparkSession, "dac")
    return read(write(docs, json, folder), folder)
