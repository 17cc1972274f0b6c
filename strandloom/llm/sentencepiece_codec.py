"""SentencePiece encoding and decoding through a partitioned table of distinct marked words.

If no piece of a model continues after a non-marker character into a whitespace marker, no merge crosses the start of a marked
word, so a text's segmentation is that of its marked words, one after another.
  1. A task cuts its texts into chunks of bounded size, writes each chunk's distinct marked words and their positions as a file in
     the shared folder, and asks a table, partitioned by a hash of the word, for the words.
  2. A bucket of the table segments and decodes each of its distinct words once, whatever the number of chunks that hold it,
     and answers each chunk with ids; text goes back only where decoding changes the word.
  3. A chunk joins the ids back to its texts by position.
Text moves once for each distinct word of a chunk. The files are deleted when the result is written.

Defined results: a null text counts as empty; an empty text has no ids; a literal marker character in a text
acts as a space, as in the library; rows that repeat an id are encoded each; a null id is kept; an empty table gives no rows; other
columns of the input play no part. A model whose pieces may cross markers is served in the same way with whole texts as words.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _chunks
from strandloom.llm._chunks import load, pack, save, unpack
from strandloom.llm._rows import release, released, small_batches
from strandloom.session import drop_path, drop_tables, materialise, scratch_path

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Words that the library segments in one call.
_CALL = 20_000
_ROW = "chunk string, bucket int, data binary"
_SCHEMA = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])

_CODECS: dict[str, Codec] = {}


class Codec:
    """A model in a worker."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.separable = separable(self.sp)
        self.mark_id = self.sp.piece_to_id(MARK)

    def words(self, text: str) -> list[str]:
        """The text's marked words without their first marker, in order; spaces and markers are alike."""
        if not self.separable:
            return [text] * bool(text)
        marked = text.replace(" ", MARK)
        if not marked:
            return []
        if MARK + MARK not in marked and marked[0] != MARK:
            return marked.split(MARK)
        return [c[1:] for c in _CHUNK.findall(MARK + marked)]

    def segment(self, words: list[str]) -> Iterator[tuple[list[int], str]]:
        """(ids, decoded text) of each of some distinct words."""
        for lo in range(0, len(words), _CALL):
            own = words[lo : lo + _CALL]
            ids = self.sp.encode(own, num_threads=1)
            if "" in own:
                ids[own.index("")] = [self.mark_id]  # a marker alone; the library encodes the empty text as nothing
            yield from zip(ids, self.sp.decode(ids), strict=True)


def separable(sp) -> bool:
    """True if segmentation by marked word is exact: no piece holds a marker after another character, the
    normaliser is the identity with a leading marker, and no piece is user-defined."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sp.serialized_model_proto())
    spec = proto.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    before = not proto.trainer_spec.treat_whitespace_as_suffix
    return bool(plain and before) and not any(p.type == 4 or re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)


def _codec(model: bytes) -> Codec:
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    """The model's bytes (under a megabyte), which go to the executors with the task."""
    with open(path, "rb") as f:
        return f.read()


def _texts_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes that each string shares with the one before it, up to 16; lengths of the rest; the rest): in order, strings share much."""
    raw = [w.encode() for w in words]
    sizes = np.array([len(w) for w in raw], np.int64)
    heads = np.frombuffer(b"".join([w[:16].ljust(16, b"\0") for w in raw]), np.uint8).reshape(-1, 16)
    shared = np.zeros(len(raw), np.int64)
    shared[1:] = np.cumprod(heads[1:] == heads[:-1], axis=1).sum(1)
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    return shared.astype(np.uint8), sizes - shared, np.frombuffer(b"".join([w[n:] for w, n in zip(raw, shared.tolist(), strict=True)]), np.uint8)


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of stretches that follow each other."""
    ends = np.cumsum(sizes)
    return zip((ends - sizes).tolist(), ends.tolist(), strict=True)


def _texts_in(shared: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> list[str]:
    raw, out, last = data.tobytes(), [], b""
    for n, (lo, hi) in zip(shared.tolist(), _spans(sizes), strict=True):
        last = last[:n] + raw[lo:hi]
        out.append(last.decode())
    return out


class _Builder:
    """The texts of one chunk as numbers of their distinct words."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.number, self.docs, self.places, self.held = codec, {}, [], [], 0

    def add(self, key: int | None, text: str) -> None:
        number = self.number
        self.places.append(np.array([number.setdefault(w, len(number)) for w in self.codec.words(text)], np.int64))
        self.docs.append(key)
        self.held += len(text) + 1

    def close(self, folder: str, buckets: int) -> list[dict]:
        """Write the chunk, its words in the order of their buckets; its questions."""
        path, words = f"{folder}/{uuid.uuid4().hex}", list(self.number)
        by_name = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        to = np.array([zlib.crc32(words[i].encode()) % buckets for i in by_name], np.int64)
        turn = by_name[np.argsort(to, kind="stable")]
        to.sort()
        words = [words[i] for i in turn]
        ids = np.array([0 if k is None else k for k in self.docs], np.int64)
        # in the file frequent words have small numbers, which take little room; slot leads from them to the order of the buckets
        place = np.concatenate([*self.places, np.zeros(0, np.int64)])
        often = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
        rank, slot = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        rank[often] = np.arange(len(words))
        slot[rank[turn]] = np.arange(len(words))
        save(path, pack(ids, np.array([k is not None for k in self.docs], np.uint8), np.array([len(p) for p in self.places], np.int64), rank[place], slot, *_texts_out(words), level=3))
        cuts = np.searchsorted(to, np.arange(buckets + 1)).tolist()
        # a row without words in some bucket: a chunk that has nothing to ask gets an answer too
        rows = [{"chunk": path, "bucket": zlib.crc32(path.encode()) % buckets, "data": None}]
        return rows + [{"chunk": path, "bucket": b, "data": pack(*_texts_out(words[lo:hi]), level=3)} for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]


def _ask(batches: Iterator[pa.RecordBatch], model: bytes, folder: str, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Step 1."""
    codec = _codec(model)
    chunk = _Builder(codec)
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chunk.add(key, text or "")
            if chunk.held >= chunk_bytes:
                yield pa.RecordBatch.from_pylist(chunk.close(folder, buckets), schema=_SCHEMA)
                chunk = _Builder(codec)
    if chunk.docs:
        yield pa.RecordBatch.from_pylist(chunk.close(folder, buckets), schema=_SCHEMA)


def _answer(table: pa.Table, model: bytes) -> pa.Table:
    """Step 2."""
    codec, bucket = _codec(model), table["bucket"][0].as_py()
    number: dict[str, int] = {}
    asked = []
    for data in table["data"].to_pylist():
        asked.append(None if data is None else np.array([number.setdefault(w, len(number)) for w in _texts_in(*unpack(data))], np.int64))
    words, sizes, flat, odd = list(number), np.empty(len(number), np.int64), [], {}
    for i, (ids, text) in enumerate(codec.segment(words)):
        sizes[i] = len(ids)
        flat.extend(ids)
        if text != words[i]:
            odd[i] = text
    flat, ends = np.array(flat, np.int64), np.cumsum(sizes)
    changed = np.zeros(len(words), bool)
    changed[list(odd)] = True
    rows = []
    for chunk, own in zip(table["chunk"].to_pylist(), asked, strict=True):
        if own is None:
            rows.append({"chunk": chunk, "bucket": -1, "data": None})
            continue
        n = sizes[own]
        at = np.repeat(ends[own] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        other = np.flatnonzero(changed[own])
        rows.append({"chunk": chunk, "bucket": bucket, "data": pack(n, flat[at], other, *_texts_out([odd[i] for i in own[other].tolist()]))})
    return pa.Table.from_pylist(rows, schema=_SCHEMA)


def _join(table: pa.Table, schema: pa.Schema, row: Callable) -> pa.Table:
    """Step 3: row(ids as text of each word, decoded text of each word, the text's places) of every text."""
    docs, known, sizes, place, slot, *words = unpack(load(table["chunk"][0].as_py()))
    csv, decoded = [], _texts_in(*words)
    for _, data in sorted((b, d) for b, d in zip(table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True) if d is not None):
        n, flat, other, *changed = unpack(data)
        for i, text in zip(other.tolist(), _texts_in(*changed), strict=True):
            decoded[len(csv) + i] = text
        said = list(map(str, flat.tolist()))
        csv += [said[lo] if hi == lo + 1 else ",".join(said[lo:hi]) for lo, hi in _spans(n)]
    slot = slot.tolist()
    csv, decoded, place = [csv[i] for i in slot], [decoded[i] for i in slot], place.tolist()
    got = [row(csv, decoded, place[lo:hi]) for lo, hi in _spans(sizes)]
    cols = list(zip(*got, strict=True)) or [[] for _ in schema.names[1:]]
    return pa.table([pa.array(docs, pa.int64(), mask=known == 0), *(pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)


def _map(df: DataFrame, key: str, text: str, schema: pa.Schema, ddl: str, model: bytes, row: Callable) -> DataFrame:
    spark = df.sparkSession
    chunk_bytes, buckets = _chunks.plan_sizes(df, text)
    folder = scratch_path(spark, "words")
    _chunks.shared_fs(folder)
    small_batches(spark)
    rows = df.select(df[key].cast("long").alias("k"), df[text].alias("t"))
    asked = materialise(rows.mapInArrow(lambda b: released(_ask(b, model, folder, buckets, chunk_bytes)), _ROW), "ask-words")

    def answer(table: pa.Table) -> pa.Table:
        out = _answer(table, model)
        release()
        return out

    def join(table: pa.Table) -> pa.Table:
        out = _join(table, schema, row)
        release()
        return out

    answers = materialise(asked.groupBy("bucket").applyInArrow(answer, _ROW), "answers")
    drop_tables(asked)
    out = materialise(answers.groupBy("chunk").applyInArrow(join, ddl), "encoded")
    drop_tables(answers)
    drop_path(spark, folder)
    return out


def encode(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each whole text, a written table."""
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def row(csv: list[str], _: list[str], place: list[int]) -> tuple[list[int]]:
        return ([int(i) for p in place for i in csv[p].split(",")],)

    return _map(df, key, text, schema, f"`{key}` long, ids array<int>", model, row)


def decode(df: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of each list of ids, as the library decodes it; a null list counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _codec(model).sp
        for batch in batches:
            texts = [sp.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(df[key], df[ids]).mapInArrow(run, f"`{key}` long, text string")


def round_trip_digest(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes each whole text and decodes the ids again; a written table."""

    def row(csv: list[str], decoded: list[str], place: list[int]) -> tuple[int, str, str]:
        ids = ",".join([csv[p] for p in place])
        # each word's text lacks the one marker that its first piece starts with
        said = " ".join([decoded[p] for p in place])
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()

    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _map(df, key, text, schema, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string", model, row)
