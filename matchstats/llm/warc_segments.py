"""WARC archives of segmented records: writing, and reassembly when they are read.

Writing. A page is a ``response`` record whose block is an HTTP message with a chunked body; a block longer
than ``SEGMENT_BYTES`` goes on in ``continuation`` records with the origin's identifier, a segment number
and, in the last, the total length. A page whose payload equals that of a page of smaller page_id is a
``revisit`` record with the payload's digest and no body. Each record is a gzip member. Every task writes
archives of its own, and a manifest (written by Spark) names those of the tasks that succeeded.

Reading. Each archive is streamed by one task, a record at a time. Records in one piece are decoded where
they are read; segments are grouped by origin identifier (a group is one payload), ordered by segment
number, their total length verified, the chunked framing decoded and the payload's digest compared with
the stated one. Revisits find their payload's length and digest in the response of that digest, in a join
that AQE splits where very many pages have one payload.

Cases: null html is an empty payload; a null page_id never is the response for another page and comes back
as null; rows that repeat a page_id with the same html are all responses (their page is the smallest);
an empty table gives no archive and an empty result; a payload of any length is taken whole; other
columns do not matter. A record that is cut, has a gap in its segments or another length or digest than
stated comes back with ``intact`` false; records of other kinds and foreign bytes are passed over, and the
records after a damaged one are read.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, materialise, new_path, python_workers, table

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 16 << 10, 4 << 10, 64 << 20
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def from_chunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are left out, a cut body raises ValueError."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk without size")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no end of HTTP headers")
    return from_chunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, record: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The gzip members of a page; ``record`` is its identifier."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    fields = [("WARC-Record-ID", record), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _member([("WARC-Type", "revisit"), *fields, ("WARC-Profile", profile), ("X-Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response")], head)
        return
    block = head + to_chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment:
        yield _member([("WARC-Type", "response"), *fields, kind], block)
        return
    yield _member([("WARC-Type", "response"), *fields, kind, ("WARC-Segment-Number", 1)], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), start=2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", record), ("WARC-Segment-Number", n)]
        last = [("WARC-Segment-Total-Length", len(block))] if at + segment >= len(block) else []
        yield _member([*more, *last], block[at : at + segment])


#: Bytes that are read of an archive at a time.
_READ = 1 << 16
_MAGIC = b"\x1f\x8b\x08"


class _Archive:
    """The bytes of an archive that have been read and not used."""

    def __init__(self, stream):
        self.stream, self.data = stream, b""

    def more(self) -> bool:
        piece = self.stream.read(_READ)
        self.data += piece
        return bool(piece)

    def members(self) -> Iterator[_Member]:
        """Each gzip member; what lies between two, or follows damage in one, is passed over."""
        while True:
            at = self.data.find(_MAGIC)
            if at >= 0:
                self.data = self.data[at:]
                yield _Member(self)
            else:
                self.data = self.data[-(len(_MAGIC) - 1) :]
                if not self.more():
                    return


class _Member:
    """The content of a gzip member, as far as it can be read."""

    def __init__(self, archive: _Archive):
        self.archive, self.unzip, self.text, self.over, self.used = archive, zlib.decompressobj(31), b"", False, False

    def _fill(self) -> None:
        if not self.archive.data and not self.archive.more():
            self.over = True  # the archive is cut
            return
        data, self.archive.data = self.archive.data, b""
        before = self.unzip.copy()
        try:
            self.text += self.unzip.decompress(data)
            if self.unzip.eof:
                self.over, self.archive.data = True, self.unzip.unused_data
        except zlib.error:
            with contextlib.suppress(zlib.error):  # what comes before the damage
                for k in range(0, len(data), 64):
                    self.text += before.decompress(data[k : k + 64])
            self.over, self.archive.data = True, data[0 if self.used else 1 :]  # another member may begin in it
        self.used = True

    def line(self) -> bytes:
        while b"\n" not in self.text and not self.over:
            self._fill()
        end = self.text.find(b"\n") + 1 or len(self.text)
        out, self.text = self.text[:end], self.text[end:]
        return out

    def take(self, n: int) -> bytes:
        parts, size = [], 0
        while size < n and (self.text or not self.over):
            if not self.text:
                self._fill()
            parts.append(self.text[: n - size])
            self.text = self.text[n - size :]
            size += len(parts[-1])
        return b"".join(parts)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Header fields (names in lower case), block and wholeness of each record of an archive.

    Damage costs what it falls on: a record that is cut, or states no length, comes with what is there of its block and False;
    bytes that are no record are passed over, to the next line that begins one or the next gzip member.
    """
    for member in _Archive(stream).members():
        while line := member.line():
            if not line.startswith(b"WARC/"):
                continue
            fields = {}
            while (line := member.line()).strip():
                k, _, v = line.decode(errors="replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            n = _number(fields.get("content-length"))
            block = b"" if n is None or n < 0 else member.take(n)
            yield fields, block, n is not None and len(block) == n


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) under ``folder``; the manifest: path, records."""
    spark = pages.sparkSession
    python_workers(spark)
    html = F.coalesce(pages["html"], F.lit(""))
    d = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    groups = d.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = materialise(groups, "payload-groups")
    d = joined(d, groups, ["digest"], "left")
    d = d.select("page_id", "url", F.col("html").cast("binary").alias("html"), F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page")).alias("refers_to"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        file_system, root = _file_system(folder)
        file_system.create_dir(root, recursive=True)
        out, path, records = None, "", 0

        def row():
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = file_system.open_output_stream(path, compression=None)
                for member in page_records(page_id, url, payload, refers_to, f"<urn:uuid:{uuid.uuid4()}>"):
                    out.write(member)
                    records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    return materialise(d.mapInArrow(run, "path string, records long"), "warc-manifest")


_HEAD = "page_id long, url string, record_type string, stated_digest string, refers_to long"
_WHOLE = "payload binary, payload_bytes long, payload_digest string, intact boolean"


def _number(text: str | None) -> int | None:
    """A whole number of 64 bits, None for anything else."""
    return int(text) if text is not None and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _decoded(block: bytes, stated: str | None) -> tuple[bytes, str, bool]:
    try:
        payload = http_payload(block)
    except ValueError:
        return b"", "", False
    digest = payload_digest(payload)
    return payload, digest, digest == stated


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, stated_digest, refers_to, payload (null for revisits, or without ``payloads``), payload_bytes, payload_digest, intact."""
    spark = manifest.sparkSession
    python_workers(spark)
    names = [x.split()[0] for x in f"{_HEAD}, {_WHOLE}".split(", ")]
    segment = ["origin", "segment", "total", "block"]

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names, *segment])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with _file_system(folder)[0].open_input_stream(path, compression=None) as stream:
                    for fields, block, whole in read_records(stream):
                        kind, number = fields.get("warc-type"), _number(fields.get("warc-segment-number"))
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        head = (_number(fields.get("x-page-id")), fields.get("warc-target-uri"), kind, stated, _number(fields.get("x-refers-to-page-id")))
                        origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
                        if number is not None and origin is not None:
                            rows.append((*head, None, None, None, None, origin, number, _number(fields.get("warc-segment-total-length")), block))
                        elif kind == "revisit":
                            rows.append((*head, None, None, stated, whole, None, None, None, None))
                        else:
                            payload, digest, intact = _decoded(block, stated)
                            rows.append((*head, payload if payloads else None, len(payload), digest, intact and whole, None, None, None, None))
                        held += len(block)
                        if len(rows) >= 256 or held >= 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    files = manifest.select("path").repartition(max(1, min(manifest.count(), 4096)))
    d = materialise(files.mapInArrow(parse, f"{_HEAD}, {_WHOLE}, origin string, segment long, total long, block binary"), "warc-records")
    pieces = d.where("origin IS NOT NULL").groupBy("origin").agg(
        *(F.max(c).alias(c) for c in ("page_id", "url", "stated_digest", "total")), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts")
    )

    def assemble(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for page_id, url, stated, total, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"".join(p["block"] for p in parts)
                in_order = [p["segment"] for p in parts] == list(range(1, len(parts) + 1))
                payload, digest, intact = _decoded(block, stated) if in_order and len(block) == total else (b"", "", False)
                rows.append((page_id, url, "response", stated, None, payload if payloads else None, len(payload), digest, intact))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    whole = d.where("origin IS NULL").select(*names)
    joined_up = pieces.select("page_id", "url", "stated_digest", "total", "parts").mapInArrow(assemble, f"{_HEAD}, {_WHOLE}")
    return whole.unionByName(joined_up)


def op2(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from the archives."""
    folder = new_path(spark, "warc")
    d = materialise(read(write(table(spark, sf_dir, "pages"), folder), folder, payloads=False).drop("payload"), "warc-pages")
    lengths = d.where("record_type = 'response' AND intact").groupBy("payload_digest").agg(F.max("payload_bytes").alias("bytes"))
    lengths = materialise(lengths, "payload-lengths")
    return d.join(lengths, "payload_digest", "left").select(
        "page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


ORACLE = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_page FROM d),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex || '0', (i * 5 // 4 + 1)::BIGINT, 2))::BIGINT >> (3 - (i * 5) % 4)) & 31)::BIGINT + 1, 1)), '') AS payload_digest FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM b
"""
