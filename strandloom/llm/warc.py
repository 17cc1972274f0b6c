"""WARC archives: a writer with payload deduplication and a splittable reader.

Writer: a gzip member for each record. Of records with equal payloads (of at least revisit_bytes bytes) the one with the smallest
key is a `response`, the others are `revisit` records that refer to it. Tasks write files of their own and
return rows of a manifest; the manifest's commit decides which attempts count.

Reader: each task takes a byte range and looks for the gzip magic. A candidate counts if it inflates to a record's header (version line,
record id and content length), and if members follow each other from it, each whole with its check sum, to the end of the range: so an
archive that lies uncompressed inside a record isn't taken for records. The task then owns all members that start inside its
range, reading over its end where the last one does. The writer never lets such a thing come up: where a record holds the gzip magic, the
compressed stream is broken between its bytes. Files are reached through pyarrow's file systems (local paths, HDFS, object stores), under
the shared scratch folder.

Defined results: a null payload is empty; a null url is written as urn:page:<key>; a null key sorts after all
others and is read back as null; rows that repeat the smallest key with an equal payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm._chunks import shared_fs
from strandloom.session import materialise, scratch_path

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
_READ, _HEAD = 1 << 18, 1 << 16


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def build_record(key: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """An uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = quote(url, safe=";/?:@&=+$,-_.!~*'()#[]%") if url is not None else f"urn:page:{key}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if key is not None:
        head.append(f"X-Page-Id: {key}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page-Id: {first}"]
    block = http if revisit else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of an uncompressed record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and digest(payload) != said:
        raise ValueError(f"payload digest of {fields['warc-record-id']} is wrong")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"), "payload_bytes": length, "payload_digest": said, "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page-id"), "target_uri": fields["warc-target-uri"], "payload": None if revisit else payload,
    }


class _Window:
    """A file's bytes from some place on, read as needed."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.data = file, at, b""

    def more(self) -> bool:
        """Read on: as much again as is held, so that a large member is copied a few times only."""
        self.file.seek(self.at + len(self.data))
        got = self.file.read(max(_READ, len(self.data)))
        self.data += got
        return bool(got)

    def skip_to(self, at: int) -> None:
        self.data = self.data[at - self.at :] if at <= self.at + len(self.data) else b""
        self.at = at


def _inflate(window: _Window, only_head: bool) -> tuple[bytes, int] | None:
    """The member at the window's start: (its content, its compressed length), or None if there is none or its check sum is wrong. only_head: the
    content may end after the header."""
    z, out, used = zlib.decompressobj(31), [], 0
    try:
        while not z.eof:
            if used == len(window.data) and not window.more():
                return None
            chunk = window.data[used : used + 1024 if only_head else None]
            got = z.decompress(chunk)
            used += len(chunk) - len(z.unused_data)
            if got:
                out.append(got)
            if only_head and (sum(map(len, out)) >= _HEAD or b"\r\n\r\n" in b"".join(out)):
                break
    except zlib.error:
        return None
    return b"".join(out), used


def is_record(head: bytes) -> bool:
    """Whether bytes start as a record does."""
    lines = head.partition(b"\r\n\r\n")[0].split(b"\r\n")
    names = {x.partition(b":")[0].strip().lower(): x.partition(b":")[2].strip() for x in lines[1:]}
    return re.fullmatch(rb"WARC/1\.\d+", lines[0]) is not None and names.get(b"warc-record-id", b"").startswith(b"<") and names.get(b"content-length", b"").isdigit()


def _starts_record(window: _Window) -> bool:
    while len(window.data) < len(MAGIC) and window.more():
        pass
    if not window.data.startswith(MAGIC):
        return False
    head = _inflate(window, True)
    return head is not None and is_record(head[0])


def _holds(file, at: int, end: int) -> bool:
    """Whether members follow each other from a candidate to the range's end. A record that starts well and can't be read to its end is damaged."""
    window = _Window(file, at)
    while window.at < end:
        window.data or window.more()
        if not window.data:
            return window.at > at
        if not _starts_record(window):
            return False
        if (got := _inflate(window, False)) is None:
            raise ValueError(f"a member at byte {window.at} is cut off or damaged")
        window.skip_to(window.at + got[1])
    window.data or window.more()
    return not window.data or _starts_record(window)


def members(file, start: int, end: int) -> Iterator[bytes]:
    """Contents of the gzip members with a record that start in [start, end)."""
    window, chained = _Window(file, start), False
    while window.at < end:
        found = window.data.find(MAGIC)
        if found < 0:
            keep = window.at + max(0, len(window.data) - 2)
            window.skip_to(keep)
            if keep >= end or not window.more():
                return
            continue
        window.skip_to(window.at + found)
        if window.at >= end:
            return
        if not chained or found:
            # a file's first member needs no proof: what follows it may be damaged, which is an error and no reason to pass it over
            if not _starts_record(window) or window.at and not _holds(file, window.at, end):
                window.skip_to(window.at + 1)
                chained = False
                continue
        got = _inflate(window, False)
        if got is None:
            raise ValueError(f"a member at byte {window.at} is cut off or damaged")
        yield got[0]
        window.skip_to(window.at + got[1])
        chained = True


def build_member(record: bytes, level: int) -> bytes:
    """A gzip member of a record. Between the bytes of a gzip magic in it the stream is flushed, so no other member can be seen in it."""
    z, out, at = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
    while (found := record.find(MAGIC, at)) >= 0:
        out += [z.compress(record[at : found + 1]), z.flush(zlib.Z_SYNC_FLUSH)]
        at = found + 1
    return b"".join([*out, z.compress(record[at:]), z.flush()])


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 0, level: int = 4, file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each row under path; the manifest: (path, bytes, records)."""
    shared_fs(path)
    body = F.coalesce(df[payload].cast("binary"), F.lit(b""))
    rows = df.select(df[key].cast("long").alias("id"), df[url].alias("url"), body.alias("body")).withColumn("sha", F.sha1("body"))
    slim = rows.where(F.octet_length("body") >= revisit_bytes).select("id", "sha")
    shared = slim.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    # only rows whose payload repeats; as a written table its size is known, and Spark picks the join by it
    repeats = materialise(slim.join(shared, "sha").where("not id <=> first").select("sha", F.col("id").alias("rid"), "first").distinct(), "revisits")
    joined = rows.join(repeats, (rows.sha == repeats.sha) & rows.id.eqNullSafe(repeats.rid), "left").select("id", "url", "body", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = shared_fs(path)
        fs.create_dir(folder, recursive=True)
        out, name, size, records = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, records = fs.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                data = build_member(build_record(*row, row[3] is not None), level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{path}/{name}", size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", size, records))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "records"])

    return materialise(joined.mapInArrow(run, "path string, bytes long, records long"), "manifest")


def read(manifest: DataFrame, split_bytes: int = 4 << 20, payloads: bool = True, most_tasks: int = 100_000) -> DataFrame:
    """A row for each record of the manifest's (path, bytes) files: (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri
    [, payload]). Each byte range is a row of work; ranges are dealt out one by one."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"] + ["payload"] * payloads
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()], strict=False)))
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inside = shared_fs(name)
                rows, held = [], 0
                with fs.open_input_file(inside) as file:
                    for data in members(file, start, min(size, start + split_bytes)):
                        rows.append(parse_record(data))
                        held += len(data) if payloads else 500
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string" + ", payload binary" * payloads
    return ranges.repartition(int(min(tasks, most_tasks))).mapInArrow(run, ddl)


def round_trip(spark: SparkSession, df: DataFrame, **columns: str) -> DataFrame:
    """Write archives under the scratch folder and read them back, without the payloads."""
    return read(write(df, scratch_path(spark, "warc"), **columns), payloads=False)
