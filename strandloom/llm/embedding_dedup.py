"""Near duplicates among embeddings by int8 tile products.

Within each label, equal vectors form one class and classes are hashed into blocks; each pair of blocks is one task of bounded size. Unit
vectors are quantised to int8 once (u = s q + e, with the norm of e known). A task multiplies two quantised blocks; the true cosine of a pair is
within |e1||s2 q2| + |s1 q1||e2| + |e1||e2| of the product. Pairs whose lower bound reaches the threshold are links; pairs whose upper
bound doesn't are none; what is left is doubtful. Only vectors with a doubtful pair then go to the same tile again in double precision, where just
the doubtful pairs are recomputed: so full vectors move for few, no link is lost and none is wrong. A task returns a row for each
class: how many vectors it links there, and the smallest class it reaches there. The latter are the edges of the components, so links
are never listed. Classes are told apart by 128 bits of hash.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a label,
link with nothing; vectors of different lengths link with nothing; rows that repeat an id are vectors of their own
and share its component; a row with a null id takes no part: no links, null component, not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm._vectors import finite, matrix, merge_labels
from strandloom.operators.components import connected_components
from strandloom.session import materialise, tidied


class Quantised:
    """Unit vectors as scale x int8, with the norms of the parts and of what is lost."""

    def __init__(self, raw: np.ndarray) -> None:
        raw = raw.astype(np.float64)
        self.raw = raw / np.abs(raw).max(1, keepdims=True)  # cosines don't change, norms can't overflow
        self.norm = np.sqrt((self.raw**2).sum(1))
        unit = self.raw / self.norm[:, None]
        self.scale = np.abs(unit).max(1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        part = self.q * self.scale[:, None]
        self.part = np.sqrt((part**2).sum(1))
        self.lost = np.sqrt(((unit - part) ** 2).sum(1))


    @classmethod
    def of(cls, table: pa.Table) -> Quantised:
        """From a table's columns q, scale, part and lost, and vector if it has that."""
        out = cls.__new__(cls)
        out.q = np.frombuffer(b"".join(table["q"].to_pylist()), np.int8).reshape(len(table), -1)
        out.scale, out.part, out.lost = (table[c].to_numpy() for c in ("scale", "part", "lost"))
        if "vector" in table.column_names:
            raw = matrix(table["vector"]).astype(np.float64)
            out.raw = raw / np.abs(raw).max(1, keepdims=True)
            out.norm = np.sqrt((out.raw**2).sum(1))
        return out

    def __getitem__(self, rows: np.ndarray) -> Quantised:
        out = Quantised.__new__(Quantised)
        out.__dict__ = {k: v[rows] for k, v in self.__dict__.items()}
        return out


def bounded(a: Quantised, b: Quantised, threshold: float, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of the pairs that may reach the threshold, some rows of a at a time; sure: they do."""
    kind = np.float32 if a.q.shape[1] <= 1040 else np.float64  # sums of int8 products are exact in it
    right = np.ascontiguousarray(b.q.T.astype(kind))
    for lo in range(0, len(a.q), rows):
        hi = min(len(a.q), lo + rows)
        product = (a.q[lo:hi].astype(kind) @ right).astype(np.float64) * a.scale[lo:hi, None] * b.scale
        slack = a.lost[lo:hi, None] * (b.part + b.lost) + a.part[lo:hi, None] * b.lost + 1e-9  # 1e-9: rounding of the sums
        i, j = np.nonzero(product + slack >= threshold)
        yield i + lo, j, product[i, j] - slack[i, j] >= threshold


def _sides(table: pa.Table) -> tuple[bool, Quantised, np.ndarray, np.ndarray]:
    """Whether a tile is of one block, its vectors, and the rows of both sides."""
    both, left, same = Quantised.of(table), table["left"].to_numpy(zero_copy_only=False), bool(table["same"][0].as_py())
    ia = np.flatnonzero(left)
    return same, both, ia, ia if same else np.flatnonzero(~left)


def _count(links: np.ndarray, labels: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> np.ndarray:
    """Add the links of pairs to both sides (in a tile of one block both orders come up); the labels after them."""
    np.add.at(links, i, n[j])
    if not same:
        np.add.at(links, j, n[i])
    return merge_labels(labels, i, j)


def quick_tile(table: pa.Table, threshold: float) -> pa.Table:
    """A row for each class of one or two blocks: its key, cid, links that are sure, root, and whether a pair of it is doubtful."""
    table = table.sort_by("cid")
    cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
    same, both, ia, ib = _sides(table)
    links, labels, doubt = np.zeros(len(cid), np.int64), np.arange(len(cid)), np.zeros(len(cid), bool)
    for i, j, sure in bounded(both[ia], both[ib], threshold) if len(ia) and len(ib) else ():
        i, j = ia[i], ib[j]
        apart = i != j
        i, j, sure = i[apart], j[apart], sure[apart]
        labels = _count(links, labels, n, i[sure], j[sure], same)
        doubt[i[~sure]] = doubt[j[~sure]] = True
    return pa.table({**{c: table[c] for c in (*TILE, "h1", "h2", "left", "same")}, "cid": cid, "links": links, "root": cid[labels], "doubt": doubt})


def exact_tile(table: pa.Table, threshold: float) -> pa.Table:
    """(cid, links, root) of a tile's classes by its doubtful pairs, in double precision."""
    table = table.sort_by("cid")
    cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
    same, both, ia, ib = _sides(table)
    links, labels = np.zeros(len(cid), np.int64), np.arange(len(cid))
    for i, j, sure in bounded(both[ia], both[ib], threshold) if len(ia) and len(ib) else ():
        i, j = ia[i[~sure]], ib[j[~sure]]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            cosine = np.einsum("ij,ij->i", both.raw[x], both.raw[y]) / (both.norm[x] * both.norm[y])
            good = (cosine >= threshold) & (x != y)
            labels = _count(links, labels, n, x[good], y[good], same)
    return pa.table({"cid": cid, "links": links, "root": cid[labels]})


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds q, scale, part and lost to classes whose last column but one is the vector and whose last is its length."""
    for batch in batches:
        d = batch.column(batch.num_columns - 1).to_numpy()
        q, rest = [b""] * len(d), np.zeros((3, len(d)))
        for own in np.unique(d):
            at = np.flatnonzero(d == own)
            found = Quantised(matrix(batch.column(batch.num_columns - 2).take(pa.array(at))))
            rest[:, at] = found.scale, found.part, found.lost
            for k, row in zip(at, found.q, strict=True):
                q[k] = row.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.binary()), *map(pa.array, rest)], names=[*batch.schema.names, "q", "scale", "part", "lost"])


TILE = ["label", "d", "p", "q_block"]


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, block: int = 2048) -> DataFrame:
    """(key, n_links, component_id, kept), a row for each row of df; a written table."""
    return tidied(df.sparkSession, lambda: _linked(df, key, vector, label, threshold, block), "linked")


def _linked(df: DataFrame, key: str, vector: str, label: str, threshold: float, block: int) -> DataFrame:
    rows = df.select(df[key].cast("long").alias("id"), df[vector].alias("vector"), df[label].alias("label"))
    good = finite("vector") & F.col("label").isNotNull() & F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumns({"good": F.coalesce(good, F.lit(False)), "h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    one = rows.where("good").groupBy("label", "h1", "h2").agg(F.min("id").alias("cid"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    one = one.withColumn("d", F.size("vector"))
    kind = one.schema["label"].dataType.simpleString(), one.schema["vector"].dataType.simpleString()
    classes = materialise(one.mapInArrow(_quantise, f"label {kind[0]}, h1 long, h2 long, cid long, n long, vector {kind[1]}, d int, q binary, scale double, part double, lost double"), "classes")
    # an id may stand for several different vectors; their links add up and their components are one
    sizes = classes.groupBy("label", "d").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    small = ["cid", "n", "h1", "h2", "q", "scale", "part", "lost"]
    dealt = classes.join(sizes, ["label", "d"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "d", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q_block"), (F.col("own") <= F.col("other")).alias("left"), *small,
    )
    tiles = tiles.withColumn("same", F.col("p") == F.col("q_block"))
    place = f"label {kind[0]}, d int, p int, q_block int, h1 long, h2 long, left boolean, same boolean, cid long, links long, root long, doubt boolean"
    quick = materialise(tiles.groupBy(*TILE).applyInArrow(lambda t: quick_tile(t, threshold), place), "tiles")
    again = quick.where("doubt").select(*TILE, "h1", "h2", "left", "same").join(classes.drop("d"), ["label", "h1", "h2"])
    exact = materialise(again.groupBy(*TILE).applyInArrow(lambda t: exact_tile(t, threshold), "cid long, links long, root long"), "doubtful")
    found = quick.select("cid", "links", "root").unionByName(exact)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    components = connected_components(found, "cid", "root")
    of_class = classes.select("label", "h1", "h2", "cid", "n").join(links, "cid").join(components.withColumnRenamed("node", "cid"), "cid", "left")
    out = rows.drop("vector").join(of_class, ["label", "h1", "h2"], "left")
    return out.select(
        F.col("id").alias(key),
        F.when(F.col("good"), F.col("links") + F.col("n") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("good"), F.coalesce("component", "cid")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
