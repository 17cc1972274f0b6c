"""Whole texts in chunks: tokens stay in files of the shared folder, and only what chunks ask of partitioned tables moves.

A chunk is what one task holds of its input at a time. It asks a table, partitioned into buckets, about its distinct tokens; each
bucket's answers go back to the chunks. Chunk and bucket sizes follow the input's bytes: chunks hold 16 MB, and more (up to 256 MB) from
some 256 GB on, so that a chunk's question to one bucket stays near a kilobyte instead of ever smaller rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the bytes of a chunk, and bytes of a question to one bucket.
CHUNK_BYTES, MOST_CHUNK_BYTES, QUESTION_BYTES = 16 << 20, 256 << 20, 1000


def plan_sizes(df: DataFrame, text: str) -> tuple[int, int]:
    """(bytes of a chunk, number of buckets) for the texts of df."""
    total = df.select(F.octet_length(F.coalesce(df[text].cast("binary"), F.lit(b""))).alias("n")).agg(F.sum(F.col("n") + 1).alias("n")).first().n or 0
    chunk = min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, math.isqrt(QUESTION_BYTES * total)))
    return chunk, max(8, -(-2 * total // chunk))


def shared_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI for tasks that read and write files themselves: local or mounted folders, hdfs, s3, gs and abfs.
    Names that only Spark knows for the same stores are translated."""
    scheme, mark, rest = uri.partition("://")
    known = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "wasbs": "abfss"}
    try:
        return pyarrow.fs.FileSystem.from_uri(f"{known.get(scheme, scheme)}://{rest}" if mark else uri)
    except (pyarrow.ArrowInvalid, pyarrow.ArrowNotImplementedError, NotImplementedError) as e:
        raise ValueError(f"tasks can't open files under '{scheme}://'; set spark.checkpoint.dir to a folder of file, hdfs, s3, gs or abfs") from e


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of integers or floats, in byte planes, compressed."""
    parts = []
    for a in map(np.ascontiguousarray, arrays):
        if a.dtype.kind in "iu" and a.dtype.itemsize > 4 and (not len(a) or (a.min() >= 0 and a.max() < 1 << 32)):
            a = a.astype(np.uint32)
        parts.append(f"{a.dtype.str},{len(a)};".encode() + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    """Integers come back as int64 or uint64."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        end = raw.index(b";", at)
        kind, n = raw[at:end].decode().split(",")
        kind, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, end + 1).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out.append(a.astype(np.int64) if kind.str in ("<u4", "<i4") else a)
        at = end + 1 + n * kind.itemsize
    return out


def save(path: str, data: bytes) -> None:
    """Write a file whole or not at all; another attempt at the same path writes the same."""
    fs, inside = shared_fs(path)
    fs.create_dir(inside.rpartition("/")[0], recursive=True)
    part = f"{inside}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, inside)


def load(path: str) -> bytes:
    fs, inside = shared_fs(path)
    with fs.open_input_file(inside) as f:
        return f.read()


def range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets that follow the order of 64-bit hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
