"""Language identification by string kernels.

Kernel: for n = 1, 2, 3 the presence of byte n-grams (ASCII letters in lower case, other ASCII characters as
spaces), restricted to n-grams of the landmarks, normalised for each n and averaged (a blended spectrum). The norm is that of the
restricted vectors, which makes this a kernel of its own: n-grams that no landmark holds count neither above nor below the line.
Landmarks are training texts; K(landmarks, landmarks)^(-1/2) maps a text's kernel row to Nyström features,
on which one ridge regression per language is solved (one versus rest). A batch of texts is scored by two matrix
products: presence x landmarks, then kernel row x weights.

The training sample is bounded, for any number of languages, by rows a language, rows, bytes and languages in all (see train); whole
texts are used in training and scoring.

Defined results: a null text or one without a letter (in the sense of str.isalpha, so numeric signs are none) is `und` with score 0; without training rows every text is;
ties go to the language that sorts first; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from strandloom.llm._rows import append_columns, spread, text_blocks

_MAYBE = re.compile(r"[^\W\d_]")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_START = (0, 256, 256 + 65536, 256 + 65536 + (1 << 24))
_SLICE = 1 << 20


def gram_codes(text: bytes) -> Iterator[np.ndarray]:
    """Codes of all 1-, 2- and 3-grams of the folded text, slice by slice, order by order."""
    folded = b" " + text.translate(_FOLD) + b" "
    for at in range(0, len(folded), _SLICE):
        a = np.frombuffer(folded[at : at + _SLICE + 2], np.uint8).astype(np.int32)
        yield a
        two = (a[:-1] << 8) | a[1:]
        yield two + _START[1]
        yield ((two[:-1] << 8) | a[2:]) + _START[2]


def has_letter(text: bytes) -> bool:
    """Word characters other than digits also take in numeric signs such as fractions and circled numbers, so each is asked."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text.decode("utf-8", "replace")))


#: The one lookup table that a process holds: the codes it is for, and column numbers by code.
_HELD: list[np.ndarray] = []


def _lookup(codes: np.ndarray) -> np.ndarray:
    """The column of each code, len(codes) for others. A worker lives for many tasks and models, so only the last table stays."""
    if not _HELD or not np.array_equal(_HELD[0], codes):
        _HELD.clear()
        table = np.full(_START[3], len(codes), np.uint16 if len(codes) < 65_535 else np.int32)
        table[codes] = np.arange(len(codes))
        _HELD.extend([codes, table])
    return _HELD[1]


@dataclass
class Model:
    """langs; the landmarks' n-gram codes in order; landmark presence rows; weights for each language."""

    langs: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: for each n the known n-grams that it holds, over the root of their number."""
        v = len(self.codes)
        table = _lookup(self.codes)
        cuts = np.searchsorted(self.codes, _START)
        rows = np.zeros((len(texts), v + 1), np.float32)
        for row, text in zip(rows, texts, strict=True):
            for codes in gram_codes(text):
                row[table[codes]] = 1
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                row[lo:hi] *= 1 / np.sqrt(max(1.0, 3 * row[lo:hi].sum()))
        return rows[:, :v]

    def decision(self, texts: list[bytes]) -> np.ndarray:
        return (self.presence(texts) @ self.landmarks.T).astype(np.float64) @ self.weights

    def predict(self, raw: list[bytes | None]) -> list[list]:
        """For each text its language and a score from 0 to 1 (a softmax of the decision values)."""
        langs, scores = ["und"] * len(raw), [0.0] * len(raw)
        if not self.langs:
            return [langs, scores]
        at = [i for i, t in enumerate(raw) if t and has_letter(t)]
        for lo, hi in text_blocks([raw[i] for i in at], 256):
            d = 4 * self.decision([raw[i] for i in at[lo:hi]])
            p = np.exp(d - d.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, best, row in zip(at[lo:hi], p.argmax(1), p, strict=True):
                langs[i], scores[i] = self.langs[best], float(row[best])
        return [langs, scores]


def fit(texts: list[bytes], langs: list[str], landmarks_per_language: int = 40, ridge: float = 1e-3) -> Model:
    """Texts must come in an order that doesn't depend on their content: each language's first ones are landmarks."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    of = {n: [t for t, x in zip(texts, langs, strict=True) if x == n] for n in names}
    marks = [t for n in names for t in of[n][:landmarks_per_language]]
    codes = np.unique(np.concatenate([np.unique(c) for t in marks for c in gram_codes(t)])).astype(np.int64)
    model = Model(names, codes, np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    model.landmarks = model.presence(marks)
    k = (model.landmarks @ model.landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k)
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features, targets = [], []
    for lo, hi in text_blocks(texts, 256):
        features.append((model.presence(texts[lo:hi]) @ model.landmarks.T).astype(np.float64) @ root)
        targets.append(np.array([[1.0 if x == n else -1.0 for n in names] for x in langs[lo:hi]]))
    x, y = np.vstack(features), np.vstack(targets)
    weight = 1 / np.maximum(1, (y > 0).sum(0))[y.argmax(1)]  # each language counts alike
    xw = x * weight[:, None]
    model.weights = root @ np.linalg.solve(xw.T @ x + ridge * np.eye(len(k)), xw.T @ y)
    return model


def train(
    df: DataFrame, rows_per_language: int = 500, most_rows: int = 40_000, most_bytes: int = 200_000_000, most_languages: int = 1000, most_landmarks: int = 4000,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> Model:
    """Fit on a sample of about rows_per_language rows of each language, dealt by a hash of the key; rows without a language, text or letter play
    no part. In all the sample has about most_rows rows and most_bytes bytes, shared alike by the languages, and most_landmarks landmarks.
    Of more than most_languages values of lang, those with the most rows are learned (ties: by name)."""
    rows = df.select(df[key].alias("k"), df[text].cast("binary").alias("t"), df[lang].alias("l")).where("t is not null and l is not null")
    counts = rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size")).orderBy(F.desc("n"), "l").limit(most_languages).collect()
    if not counts:
        return fit([], [])
    own_rows, own_bytes = min(rows_per_language, most_rows / len(counts)), most_bytes / len(counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.l, min(own_rows / r.n, own_bytes / max(1, r["size"])))])
    got = rows.where(spread("k") < F.coalesce(F.try_element_at(share, F.col("l")), F.lit(0.0))).collect()
    got = sorted((r for r in got if has_letter(bytes(r.t))), key=lambda r: (hash_order(r.k), bytes(r.t)))
    return fit([bytes(r.t) for r in got], [r.l for r in got], max(1, min(40, most_landmarks // len(counts))))


def hash_order(key) -> int:
    """An order of keys that is unlike their own."""
    import zlib

    return zlib.crc32(b"order" + str(key).encode())


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of each whole text and its score. The model (a few MB: its size follows the
    landmarks, not the data) goes to the executors as a broadcast variable."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return append_columns(df, text, [StructField(lang_pred, StringType()), StructField(score, DoubleType())], lambda raw: sent.value.predict(raw))
