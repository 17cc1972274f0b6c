"""A Katz backoff model of any order (trigrams by default): training over the corpus and scores of whole texts.

Probabilities. Counts c come from the training texts; each text begins after begin marks and closes with an end token.
On every order Good-Turing discounts d_r apply to counts r of 1 to 5. After a history h with training counts a seen word has
P(w|h) = d c(h,w) / c(h); any other has a(h) P(w|h'), where h' is h without its oldest word, evaluated in the same way one order
down, and a(h) makes the sum over all words exactly 1. A history without training counts backs off whole. On the lowest
order a seen word has d c(w) / N, and what the discounts free is the probability of the unknown word. A history none of whose
continuations is discounted uses c(h) + 1 below the line.

Plan. Counts are too many for one machine, and tokens too many to shuffle as rows, so packed arrays move instead:
  1. A task cuts its texts into chunks, writes each chunk's tokens as a file in the shared folder, and asks a table partitioned by
     word hash for its distinct words (with their training counts in the chunk).
  2. A bucket adds the counts up, numbers the words and answers each chunk.
  3. For each order k from 2 a chunk notes the answers of order k - 1 in a file beside its tokens, and asks a table partitioned by history
     for its distinct k-grams. Left out are histories without training counts, about which nothing is to be learned. Histories with
     over 1/P of all tokens are partitioned by history and word, and their sums are put together from the parts, a bounded number
     of them.
  4. A bucket adds up k-gram counts and answers with each count, and for each history with how many continuations have each low count and
     with what order k - 1 knows of its seen words, as whole numbers: how many have each low count, and the sum of higher ones.
  5. With the answers of the last order a chunk scores its texts, from the unigrams up.
What moves is distinct k-grams of chunks, a few bytes each; each order's answers are a written table, deleted when the next order has
noted them.

Defined results: a null text is empty, so just the end token; repeated rows each count; a null id counts as training and is
kept; an empty table gives no rows; with no training text at all the only probability is that of the unknown word, 1.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _chunks
from strandloom.llm._chunks import load, pack, range_of, save, unpack
from strandloom.llm._rows import release, released
from strandloom.llm._words import mixed, word_hashes
from strandloom.session import drop_path, drop_tables, materialise, scratch_path

END = np.uint64(0x5851F42D4C957F2D)
#: Counts up to this are discounted.
LOW = 5
#: Hot histories are kept for all chunks; there are fewer than this many.
MOST_HOT = 1 << 16
#: Kinds of rows: questions and answers; sums over a bucket; a chunk's name, so that it gets an answer; parts of a hot history.
ASK, SUMS, OWN, HOT = 0, 1, 2, 3
_ROW = "chunk string, bucket int, kind int, data binary, h string, x array<long>"
_SCHEMA = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("h", pa.string()), ("x", pa.list_(pa.int64()))])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: r.get(k) for k in _SCHEMA.names} for r in rows], schema=_SCHEMA)


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def discounts(n: list[int]) -> np.ndarray:
    """d_0 to d_LOW from the numbers n[1] to n[LOW + 1] of counts; where Good-Turing gives none between 0 and 1, half a count is taken."""
    d = np.ones(LOW + 1)
    share = (LOW + 1) * n[LOW + 1] / n[1] if n[1] else 1.0
    for r in range(1, LOW + 1):
        got = ((r + 1) * n[r + 1] / (n[r] * r) - share) / (1 - share) if n[r] and share < 1 else 0.0
        d[r] = got if 0 < got < 1 else (r - 0.5) / r
    return d


def tally(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2 and so on to LOW + 1."""
    n = np.bincount(np.minimum(counts, LOW + 2), minlength=LOW + 3)
    return [int(v) for v in n[1 : LOW + 2]]


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts <= LOW, d[np.minimum(counts, LOW)], 1.0) * counts


@dataclass
class Unigrams:
    """total: training tokens; types: distinct ones; d: discounts; unknown: the unknown word's probability; line: what counts are divided by."""

    total: int
    types: int
    d: np.ndarray
    unknown: float
    line: float

    @classmethod
    def of(cls, total: int, types: int, n: list[int]) -> Unigrams:
        d = discounts(n)
        unknown = sum((1 - d[r]) * r * n[r] for r in range(1, LOW + 1)) / total if total else 1.0
        if total and unknown <= 0:  # nothing is discounted: one more token is counted, the unknown word
            return cls(total, types, np.ones(LOW + 1), 1 / (total + 1), total + 1.0)
        return cls(total, types, d, unknown, max(1.0, total))

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / self.line, self.unknown)


def line_of(count: np.ndarray, low: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For histories with training counts and numbers of continuations by count (columns 1 to LOW): (what to divide their k-gram counts by,
    the probability that is left for unseen words)."""
    freed = (low * np.arange(1, LOW + 1) * (1 - d[1:])).sum(1)
    line = np.maximum(np.where(freed > 0, count, count + 1), 1).astype(float)
    return line, np.where(freed > 0, freed, 1.0) / line


def unique_rows(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row of the columns, equal rows having equal numbers. Rows are told apart by their values, not by a hash of them."""
    if len(columns) == 1:
        return np.unique(columns[0], return_inverse=True)[1]
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        x = mixed(x + c.astype(np.uint64) + np.uint64(1))
    _, first, number = np.unique(x, return_index=True, return_inverse=True)
    if all((c[first][number] == c).all() for c in columns):
        return number
    return np.unique(np.stack(columns, 1), axis=0, return_inverse=True)[1].reshape(-1)


def differences(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows in ascending order, each value less the one above it where all columns before it are the same."""
    same, out = np.arange(len(columns[0])) > 0, []
    for c in columns:
        before = np.append(c[:1], c[:-1])
        out.append(np.where(same, c - before, c))
        same = same & (c == before)
    return out


def sums_of_differences(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rows that differences() took apart."""
    same, out = np.arange(len(columns[0])) > 0, []
    for c in columns:
        total, starts = np.cumsum(c), np.flatnonzero(~same)
        out.append(total - np.repeat((total - c)[starts], np.diff(np.append(starts, len(c)))))
        same = same & (out[-1] == np.append(out[-1][:1], out[-1][:-1]))
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


@dataclass
class Grams:
    """Distinct k-grams of a chunk in the order of (history, word): history (a number of the order below; -1 stands for the begin marks,
    so values of histories have theirs at the end), word, lower (the k-gram without its oldest word), seen (training counts in the
    chunk), and the k-gram that ends at each token."""

    history: np.ndarray
    word: np.ndarray
    lower: np.ndarray
    seen: np.ndarray
    place: np.ndarray


class Chunk:
    """Texts of one chunk as tokens, numbered in the order of the words' hashes, and their k-grams order by order."""

    def __init__(self, doc: np.ndarray, known: np.ndarray, train: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> None:
        # a chunk has fewer than 2^31 tokens, so its own numbers take four bytes
        self.doc, self.known, self.train, self.sizes, self.tokens = doc, known.astype(bool), train.astype(bool), sizes, tokens.astype(np.int32)
        self.of_train = np.repeat(self.train, self.sizes)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.words = int(tokens.max()) + 1
        #: orders[k - 1] are the k-grams.
        self.orders = [self._words()]

    def _words(self) -> Grams:
        none = np.zeros(self.words, np.int32)
        return Grams(none, np.arange(self.words, dtype=np.int32), none, np.bincount(self.tokens[self.of_train], minlength=self.words), self.tokens)

    def renumber(self, rank: np.ndarray) -> None:
        """Give the words new numbers, before any longer k-grams are made."""
        self.tokens = rank.astype(np.int32)[self.tokens]
        self.orders = [self._words()]

    def packed(self) -> bytes:
        """The chunk with words numbered by frequency, as small numbers take little room, and the way back."""
        often = np.argsort(-np.bincount(self.tokens, minlength=self.words), kind="stable")
        rank = np.empty(self.words, np.int64)
        rank[often] = np.arange(self.words)
        return pack(self.doc, self.known.view(np.uint8), self.train.view(np.uint8), self.sizes, rank[self.tokens], often)

    @classmethod
    def unpacked(cls, data: bytes) -> Chunk:
        *rest, tokens, often = unpack(data)
        return cls(*rest, often[tokens])

    def grow(self) -> Grams:
        """The k-grams of the next order."""
        below = self.orders[-1]
        key = np.empty(len(self.tokens), np.int64)
        key[1:] = below.place[:-1]
        key += 1
        key[self.firsts] = 0
        key *= self.words
        key += self.tokens
        key, place = np.unique(key, return_inverse=True)
        place = place.astype(np.int32)
        lower = np.empty(len(key), np.int32)
        lower[place] = below.place
        seen = np.bincount(place[self.of_train], minlength=len(key)).astype(np.int32)
        self.orders.append(Grams((key // self.words - 1).astype(np.int32), (key % self.words).astype(np.int32), lower, seen, place))
        return self.orders[-1]


def build_chunk(rows: list[tuple[int | None, bytes, bool]]) -> tuple[Chunk, np.ndarray]:
    """(the chunk, its words' hashes in order)."""
    found, sizes = word_hashes([t for _, t, _ in rows], fold=True)
    sizes = sizes + 1
    tokens = np.empty(len(found) + len(rows), np.uint64)
    ends = np.zeros(len(tokens), bool)
    ends[np.cumsum(sizes) - 1] = True
    tokens[ends], tokens[~ends] = END, found
    words, number = np.unique(tokens, return_inverse=True)
    ids = np.array([0 if k is None else k for k, _, _ in rows], np.int64)
    return Chunk(ids, np.array([k is not None for k, _, _ in rows]), np.array([x for _, _, x in rows]), sizes, number.astype(np.int64)), words


def _ask_words(batches: Iterator[pa.RecordBatch], folder: str, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Step 1."""
    rows: list[tuple[int | None, bytes, bool]] = []

    def close() -> pa.RecordBatch:
        chunk, words = build_chunk(rows)
        path, of = f"{folder}/{uuid.uuid4().hex}", range_of(words, buckets)
        save(path, chunk.packed())
        cuts = np.searchsorted(of, np.arange(buckets + 1))
        seen = chunk.orders[0].seen
        return _rows([{"chunk": path, "bucket": b, "kind": ASK, "data": pack(words[lo:hi], seen[lo:hi])} for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo])

    held = 0
    for batch in batches:
        for key, text, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((key, text, train))
            held += len(text) + 1
            if held >= chunk_bytes:
                yield close()
                rows, held = [], 0
    if rows:
        yield close()


def _answer_words(table: pa.Table, buckets: int) -> pa.Table:
    """Step 2."""
    bucket, asked = table["bucket"][0].as_py(), [unpack(x) for x in table["data"].to_pylist()]
    words, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.bincount(place, np.concatenate([a[1] for a in asked]), len(words)).astype(np.int64)
    number = np.empty(len(words), np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(words)) * buckets + bucket + 1  # 0 is the begin mark
    rows, at = [], 0
    for chunk, a in zip(table["chunk"].to_pylist(), asked, strict=True):
        own = place[at : at + len(a[0])]
        rows.append({"chunk": chunk, "bucket": bucket, "kind": ASK, "data": pack(number[own], total[own])})
        at += len(a[0])
    rows.append({"kind": SUMS, "bucket": bucket, "x": [int(total.sum()), int((total > 0).sum()), int(total[words == END].sum()), *tally(total)]})
    return _table(rows)


@dataclass
class Model:
    """What all chunks and buckets know: lowest order, number of training texts and of buckets, and for each higher order learned so far
    its discounts and the sums of its hot histories, by their words' numbers."""

    unigrams: Unigrams
    texts: int
    buckets: int
    d: list[np.ndarray] = field(default_factory=list)
    hot: list[dict[str, list[int]]] = field(default_factory=list)

    def is_hot(self, count: np.ndarray) -> np.ndarray:
        return count > max(1, self.unigrams.total // min(4 * self.buckets, MOST_HOT))

    def discounts_of(self, order: int) -> np.ndarray:
        return self.unigrams.d if order == 1 else self.d[order - 2]


class Reader:
    """A chunk with what it has learned from the answers: for each order counts of its k-grams, and what counts after each history are
    divided by and what unseen words there are multiplied with."""

    def __init__(self, path: str, model: Model) -> None:
        self.path, self.model = path, model
        self.chunk = Chunk.unpacked(load(path))
        self.counts: list[np.ndarray] = []
        self.lines: list[tuple[np.ndarray, np.ndarray]] = []
        self.numbers = np.zeros(0, np.int64)
        #: The last order's answers, to be noted.
        self.last: dict[int, bytes] = {}

    def words(self, data: list[bytes]) -> None:
        got = [unpack(d) for d in data]  # in the order of the buckets, which is that of the words
        numbers, count = (np.concatenate([g[i] for g in got]) for i in range(2))
        # from here on the chunk's words, and so its k-grams, are in the order of all words' numbers: questions are sorted, and differences small
        turn = np.argsort(numbers)
        rank = np.empty(len(turn), np.int64)
        rank[turn] = np.arange(len(turn))
        self.chunk.renumber(rank)
        self.numbers = numbers[turn]
        self.counts.append(count[turn])

    def history_counts(self, order: int) -> np.ndarray:
        """Training counts of all histories of an order, the begin marks last."""
        return np.append(self.counts[order - 2], self.model.texts)

    def names(self, order: int, histories: np.ndarray) -> list[np.ndarray]:
        """The words' numbers of histories of an order, oldest first; 0 for begin marks."""
        out, own = [], histories
        for k in range(order - 1, 0, -1):
            grams = self.chunk.orders[k - 1]
            marks = (own < 0) | (own >= len(grams.word))
            safe = np.where(marks, 0, own)
            out.append(np.where(marks, 0, self.numbers[grams.word[safe]]))
            own = np.where(marks, -1, grams.history[safe])
        return out[::-1]

    def asks(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(order by bucket of the k-grams whose histories have training counts, cuts of the buckets)."""
        grams, count = self.chunk.orders[order - 1], self.history_counts(order)
        open_ = np.flatnonzero(count[grams.history] > 0)
        x = np.zeros(len(count), np.uint64)
        for c in self.names(order, np.arange(len(count))):
            x = mixed(x + c.astype(np.uint64) + np.uint64(1))
        x = np.where(self.model.is_hot(count)[grams.history[open_]], mixed(x[grams.history[open_]] + self.numbers[grams.word[open_]].astype(np.uint64)), x[grams.history[open_]])
        to = ((x >> np.uint64(33)) % np.uint64(self.model.buckets)).astype(np.uint16 if self.model.buckets < 1 << 16 else np.int64)
        turn = np.argsort(to, kind="stable")  # numbers of two bytes are sorted by their digits
        return open_[turn], np.searchsorted(to[turn], np.arange(self.model.buckets + 1))

    def learn(self, order: int, answers: dict[int, bytes]) -> None:
        """Take in an order's answers by bucket. Sums of histories become at once what probabilities need of them, as sums take more room."""
        grams, d = self.chunk.grow(), self.model.discounts_of(order)
        count = self.history_counts(order)
        line, alpha = np.ones(len(count)), np.ones(len(count))

        def note(histories: np.ndarray, sums: np.ndarray) -> None:
            line[histories], left = line_of(count[histories], sums[:, :LOW], d)
            below = self.model.discounts_of(order - 1)
            mass = (sums[:, LOW : 2 * LOW] * (np.arange(1, LOW + 1) * below[1:])).sum(1) + sums[:, 2 * LOW]
            alpha[histories] = left / np.maximum(1 - mass / self.lines_below(order, histories), 1e-300)

        own, cuts = self.asks(order)
        c = np.zeros(len(grams.word), np.int64)
        for b, data in answers.items():
            mine = own[cuts[b] : cuts[b + 1]]
            c[mine], *rest = unpack(data)
            starts, _ = _runs(grams.history[mine])
            note(grams.history[mine[starts]], np.stack(rest, 1))
        for h in np.flatnonzero(self.model.is_hot(count)):
            found = self.model.hot[order - 2].get(",".join(str(int(n[0])) for n in self.names(order, np.array([h]))))
            if found:
                note(np.array([h]), np.array([found]))
        self.counts.append(c)
        self.lines.append((line, alpha))

    def lines_below(self, order: int, histories: np.ndarray) -> np.ndarray | float:
        """What counts of the order below are divided by, after these histories without their oldest word."""
        if order == 2:
            return self.model.unigrams.line
        lower, line = self.chunk.orders[order - 2].lower, self.lines[-1][0]  # lower: of histories as k-grams of the order below
        marks = (histories < 0) | (histories >= len(lower))
        return line[np.where(marks, -1, lower[np.where(marks, 0, histories)])]

    def probabilities(self) -> np.ndarray:
        """Of each k-gram of the last order."""
        p = self.model.unigrams.p(self.counts[0])
        for k, (line, alpha) in enumerate(self.lines, 2):
            grams, c = self.chunk.orders[k - 1], self.counts[k - 1]
            p = np.where(c > 0, discounted(c, self.model.discounts_of(k)) / line[grams.history], alpha[grams.history] * p[grams.lower])
        return p


def history_sums(history: np.ndarray, count: np.ndarray, below: np.ndarray, histories: int) -> np.ndarray:
    """A row for each history: how many of its seen words have count 1 to LOW, how many have each such count on the order below, and the
    sum of higher counts there."""
    seen = count > 0
    history, count, below = history[seen], count[seen], below[seen]
    out = np.zeros((histories, 2 * LOW + 1), np.int64)
    for at, c in ((0, count), (LOW, below)):
        low = c <= LOW
        np.add.at(out.reshape(-1), history[low] * (2 * LOW + 1) + at + c[low] - 1, 1)
    np.add.at(out[:, 2 * LOW], history[below > LOW], below[below > LOW])
    return out


def _reader(table: pa.Table, model: Model, order: int) -> Reader:
    """The chunk of a group of rows of order `order`'s answers, with all orders up to it learned."""
    path = table["chunk"][0].as_py()
    reader = Reader(path, model)
    got = dict(sorted((b, d) for b, d in zip(table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True) if d is not None))
    for k in range(1, order + 1):
        answers = got if k == order else pickle.loads(load(f"{path}.{k}"))
        if k == 1:
            reader.words(list(answers.values()))
        else:
            reader.learn(k, answers)
    reader.last = got
    return reader


def _ask(table: pa.Table, model: Model, order: int) -> pa.Table:
    """Step 3: note the answers of the order below and ask for k-grams. A chunk's name goes to some bucket, which gives it a row without
    data back: so a chunk that has nothing to ask isn't lost."""
    reader = _reader(table, model, order - 1)
    path = reader.path
    save(f"{path}.{order - 1}", pickle.dumps(reader.last))
    grams = reader.chunk.grow()
    own, cuts = reader.asks(order)
    count = reader.history_counts(order)
    rows = [{"chunk": path, "bucket": zlib.crc32(path.encode()) % model.buckets, "kind": OWN}]
    lower = reader.counts[order - 2][grams.lower]
    for b in range(model.buckets):
        mine = own[cuts[b] : cuts[b + 1]]
        if len(mine):
            starts, lengths = _runs(grams.history[mine])
            first = grams.history[mine[starts]]
            names, (words,) = differences(reader.names(order, first)), differences([np.repeat(np.arange(len(first)), lengths), reader.numbers[grams.word[mine]]])[1:]
            rows.append({"chunk": path, "bucket": b, "kind": ASK, "data": pack(*names, count[first], lengths, words, lower[mine], grams.seen[mine])})
    return _table(rows)


def _answer(table: pa.Table, model: Model, order: int) -> pa.Table:
    """Step 4, a bucket."""
    bucket, kind = table["bucket"][0].as_py(), table["kind"].to_pylist()
    rows = [{"chunk": chunk, "bucket": -1, "kind": ASK} for chunk, k in zip(table["chunk"].to_pylist(), kind, strict=True) if k == OWN]
    table = table.filter(pa.array([k == ASK for k in kind]))
    asked = [unpack(x) for x in table["data"].to_pylist()]
    n = order - 1
    for a in asked:
        a[:n] = sums_of_differences(a[:n])
        a[n + 2] = sums_of_differences([np.diff(np.repeat(np.arange(len(a[n])), a[n + 1]), prepend=0), a[n + 2]])[1]
    if asked:
        names = [np.concatenate([a[i] for a in asked]) for i in range(n)]
        each = unique_rows(names)
        history = np.concatenate([np.repeat(each[lo:hi], a[n + 1]) for a, lo, hi in _spans(asked, n)])
        word = np.concatenate([a[n + 2] for a in asked])
        if word.max() >= 1 << 32:
            word = np.unique(word, return_inverse=True)[1]
        key, place = np.unique(history << 32 | word, return_inverse=True)
        total = np.bincount(place, np.concatenate([a[n + 4] for a in asked]), len(key)).astype(np.int64)
        below = np.empty(len(key), np.int64)
        below[place] = np.concatenate([a[n + 3] for a in asked])
        found = history_sums(key >> 32, total, below, int(each.max()) + 1)
        at = 0
        for chunk, (a, lo, hi) in zip(table["chunk"].to_pylist(), _spans(asked, n), strict=True):
            own = place[at : at + len(a[n + 2])]
            at += len(own)
            rows.append({"chunk": chunk, "bucket": bucket, "kind": ASK, "data": pack(total[own], *found[each[lo:hi]].T)})
        counts = np.concatenate([a[n] for a in asked])
        _, one = np.unique(each, return_index=True)
        for i in one[model.is_hot(counts[one])]:
            rows.append({"kind": HOT, "bucket": bucket, "h": ",".join(str(int(c[i])) for c in names), "x": [int(v) for v in found[each[i]]]})
        rows.append({"kind": SUMS, "bucket": bucket, "x": tally(total)})
    return _table(rows)


def _spans(asked: list[list[np.ndarray]], n: int) -> Iterator[tuple[list[np.ndarray], int, int]]:
    """Each question with the range of its histories among all."""
    at = 0
    for a in asked:
        yield a, at, at + len(a[n])
        at += len(a[n])


def _score(table: pa.Table, model: Model, order: int) -> pa.Table:
    """Step 5."""
    reader = _reader(table, model, order)
    chunk, grams = reader.chunk, reader.chunk.orders[-1]
    known = reader.counts[0][chunk.tokens]
    base = np.log10((known + 1) / (model.unigrams.total + model.unigrams.types + 1))
    add = lambda x: np.add.reduceat(x, chunk.firsts)
    score = add(np.log10(reader.probabilities())[grams.place])
    return pa.table({"id": pa.array(chunk.doc, mask=~chunk.known), "held_out": ~chunk.train, "n_tokens": chunk.sizes.astype(np.int64), "n_known": add((known > 0).astype(np.int64)), "base_score": add(base), "score": score})


def _totals(answers: DataFrame, n: int) -> list[int]:
    """Sums of the buckets' sums."""
    got = answers.where(F.col("kind") == SUMS).agg(*(F.sum(F.get("x", F.lit(i))) for i in range(n))).first()
    return [int(x or 0) for x in got]


def _next_order(answers: DataFrame, model: Model, order: int) -> DataFrame:
    def ask(table: pa.Table) -> pa.Table:
        out = _ask(table, model, order)
        release()
        return out

    def answer(table: pa.Table) -> pa.Table:
        out = _answer(table, model, order)
        release()
        return out

    return answers.groupBy("chunk").applyInArrow(ask, _ROW).groupBy("bucket").applyInArrow(answer, _ROW)


def score(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text; the model learns from the rows where train
    holds. order: words of the longest n-grams, 2 or more. The result is a written table; all else that was written is deleted."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = df.sparkSession
    chunk_bytes, buckets = _chunks.plan_sizes(df, text)
    folder = scratch_path(spark, "chunks")
    _chunks.shared_fs(folder)
    rows = df.select(df[key].cast("long").alias("k"), F.coalesce(df[text].cast("binary"), F.lit(b"")).alias("t"), F.coalesce(train, F.lit(True)).alias("l"))
    asked = materialise(rows.mapInArrow(lambda b: released(_ask_words(b, folder, buckets, chunk_bytes)), _ROW), "ask-words")
    answers = materialise(asked.groupBy("bucket").applyInArrow(lambda t: _answer_words(t, buckets), _ROW), "words")
    drop_tables(asked)
    total, types, texts, *n = _totals(answers, LOW + 4)
    model = Model(Unigrams.of(total, types, [0, *n]), texts, buckets)
    own = F.col("kind") == ASK
    for k in range(2, order + 1):
        found = materialise(_next_order(answers.where(own), model, k), f"answers-{k}")
        drop_tables(answers)
        answers = found
        hot = answers.where(F.col("kind") == HOT).groupBy("h").agg(*(F.sum(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(2 * LOW + 1))).collect()  # fewer than MOST_HOT
        sums = {r.h: [int(r[f"x{i}"]) for i in range(2 * LOW + 1)] for r in hot}
        model = Model(model.unigrams, texts, buckets, [*model.d, discounts([0, *_totals(answers, LOW + 1)])], [*model.hot, sums])
    out = answers.where(own).groupBy("chunk").applyInArrow(lambda t: _score(t, model, order), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = materialise(out, "scores")
    drop_tables(answers)
    drop_path(spark, folder)
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
