"""Document quality by a byte-level convolutional network in numpy.

A whole text in UTF-8 is cut into overlapping chunks. Each byte has a learned vector; learned filters slide over
every chunk in steps of two bytes; each filter's largest answer in a chunk is kept (max-pooling). The largest and
the mean answers over the chunks enter one logistic unit, which gives one probability.

Training (Adam on the log loss, fixed seed) runs on the driver over a bounded labelled sample, whole texts again.

Defined results: null and empty texts are one chunk of padding and are scored like any text; repeated rows get
equal results; without training rows, or with one label only, the score is the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from strandloom.llm._rows import append_columns, spread
from strandloom.llm.language_id import hash_order

#: Bytes of a filter, its step, bytes of a chunk and how far on the next chunk starts.
WIDTH, STEP, CHUNK, HOP = 8, 2, 512, 448
_BLOCK = 1 << 16


@dataclass
class Model:
    """share: used alone if there are no filters."""

    share: float
    embed: np.ndarray = field(default_factory=lambda: np.zeros((256, 4), np.float32))
    filters: np.ndarray | None = None
    bias: np.ndarray | None = None
    head: np.ndarray | None = None

    def pooled(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunks x filters: the largest answers; the window each came from; all bytes, padded)."""
        data = np.frombuffer(text, np.uint8)
        short = max(CHUNK, len(data) + (-(len(data) - CHUNK)) % HOP) - len(data)
        data = np.concatenate([data, np.zeros(short, np.uint8)])
        per, hop, d = (CHUNK - WIDTH) // STEP + 1, HOP // STEP, self.embed.shape[1]
        chunks = (len(data) - CHUNK) // HOP + 1
        best = np.empty((chunks, self.filters.shape[1]), np.float32)
        where = np.empty(best.shape, np.int64)
        step = max(1, _BLOCK // CHUNK)
        for lo in range(0, chunks, step):
            hi = min(chunks, lo + step)
            x = self.embed[data[lo * HOP : (hi - 1) * HOP + CHUNK]]
            n = (len(x) - WIDTH) // STEP + 1
            windows = np.lib.stride_tricks.as_strided(x, (n, WIDTH * d), (x.strides[0] * STEP, x.strides[1]), writeable=False)
            answers = np.ascontiguousarray(windows) @ self.filters
            view = np.lib.stride_tricks.as_strided(answers, (hi - lo, per, answers.shape[1]), (answers.strides[0] * hop, *answers.strides), writeable=False)
            own = view.argmax(1)
            best[lo:hi] = np.take_along_axis(view, own[:, None, :], 1)[:, 0]
            where[lo:hi] = (own + np.arange(lo, hi)[:, None] * hop) * STEP
        return np.tanh(best + self.bias), where, data

    def logit(self, text: bytes) -> float:
        z, _, _ = self.pooled(text)
        return float(np.concatenate([z.max(0), z.mean(0), [1]]) @ self.head)

    def predict(self, raw: list[bytes | None]) -> list[list]:
        if self.filters is None:
            return [[self.share] * len(raw)]
        return [[float(1 / (1 + np.exp(-np.clip(self.logit(t or b""), -30, 30)))) for t in raw]]


def fit(texts: list[bytes], labels: list[int], filters: int = 16, passes: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Model:
    """Texts must come in an order that doesn't depend on their content."""
    model = Model((sum(labels) + 1) / (len(labels) + 2))
    if len(set(labels)) < 2:
        return model
    rng = np.random.default_rng(seed)
    d = model.embed.shape[1]
    p = [
        rng.normal(0, 0.5, (256, d)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(WIDTH * d), (WIDTH * d, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.1, 2 * filters + 1).astype(np.float64),
    ]
    p[3][-1] = np.log(model.share / (1 - model.share))
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    steps = passes * -(-len(texts) // batch)
    t = 0
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for lo in range(0, len(texts), batch):
            model.embed, model.filters, model.bias, model.head = p
            g = [np.zeros_like(x) for x in p]
            own = order[lo : lo + batch]
            for i in own:
                z, where, data = model.pooled(texts[i])
                top = z.argmax(0)
                x = np.concatenate([z.max(0), z.mean(0), [1]])
                err = (1 / (1 + np.exp(-np.clip(x @ p[3], -30, 30))) - labels[i]) / len(own)
                g[3] += err * x
                dz = np.repeat((err * p[3][filters:-1] / len(z))[None], len(z), 0)
                dz[top, np.arange(filters)] += err * p[3][:filters]
                dz = (dz * (1 - z * z)).astype(np.float32)
                g[2] += dz.sum(0)
                seen = data[where[:, :, None] + np.arange(WIDTH)]  # chunks x filters x WIDTH
                g[1] += np.einsum("cf,cfk->kf", dz, p[0][seen].reshape(*where.shape, WIDTH * d))
                back = dz[:, :, None, None] * p[1].T.reshape(filters, WIDTH, d)[None]
                np.add.at(g[0], seen.ravel(), back.reshape(-1, d))
            t += 1
            now = rate * (1 - t / (steps + 1))
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                p[k] = p[k] - (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(p[k].dtype)
    model.embed, model.filters, model.bias, model.head = p
    return model


def train(documents: DataFrame, labels: DataFrame, most_rows: int = 3000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on about most_rows labelled rows, dealt by a hash of the key. Rows without a 0 or 1 label play no part;
    a key with several labelled or text rows gives a row for each pair."""
    marked = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("y")).where("k is not null and y in (0, 1)")
    n = marked.count()
    sample = marked.where(spread("k") < most_rows / max(1, n))
    rows = documents.select(documents[key].alias("k"), documents[text].cast("binary").alias("t")).join(F.broadcast(sample), "k")  # at most about most_rows
    got = sorted(((hash_order(r.k), bytes(r.t or b""), r.y) for r in rows.collect()))
    return fit([t for _, t, _ in got], [y for _, _, y in got])


def predict(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """df with the probability of label 1 for each whole text. The model is some 10 KB."""
    return append_columns(df, text, [StructField(score, DoubleType())], model.predict)
