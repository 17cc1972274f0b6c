"""Exact top-k by inner product with a KD-tree for each shard.

Vectors become integers. Cells, which a KD-tree over a bounded sample cuts (at most MOST_CELLS of them; median splits of the widest
component), put near vectors together; a cell's rows are dealt into shards of bounded size. The sample decides only who lies with
whom: every row is in a shard, and bounds come from all of a shard's rows.

Each shard's tree is built once and written as one row: median splits of the widest component with tight boxes at every node, inner ones
too. A box's bound is the sum over components of the larger of q*low and q*high. A block of queries goes through a tree best-first, all
its queries in step: each takes the node with its best bound; an inner node gives its two children, a leaf is scored by one matrix
product for all queries that stand at it. A query stops when its best bound falls under its kth score. A first pass takes each query
through its own shard. The kth scores found there meet the boxes of all cells before anything moves, so a query goes only to the cells that
can still hold a better row; and it takes its kth score along. Bounds and scores are exact integers, and a node whose bound
equals the kth score is opened, so ties are whole.

What moves in the second pass is each shard's tree once for each block of the queries that it can serve, and each query once
for each such shard.

Defined results: null vectors and those with null or non-finite components take no part; vectors of different
lengths aren't compared; rows that share the query's id are never its candidates; rows that repeat another id
are candidates of their own; a query id that repeats is one query if its vectors are equal and else asks with each of them, the best
of all rows counting once for each row; a null id takes no part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm._vectors import finite, matrix
from strandloom.session import drop_tables, materialise

NONE = -(2**62)
#: Rows that the cells are cut by, cells of one length, and rows of a leaf.
SAMPLE_ROWS, MOST_CELLS, LEAF = 20_000, 256, 256


def halves(x: np.ndarray, most: int) -> Iterator[tuple[int, int, int, float]]:
    """(node, component, its left child or -1, value) of a KD-tree over a sample with up to `most` leaves: smaller values go left, others to
    the next node after the left child."""
    waiting, nodes, leaves = [(0, np.arange(len(x)))], 1, 1
    while waiting:
        node, own = waiting.pop(0)
        spread = x[own].max(0) - x[own].min(0) if len(own) and x.shape[1] else np.zeros(1)
        if leaves >= most or len(own) < 2 or spread.max() == 0:
            yield node, 0, -1, 0.0
            continue
        axis = int(spread.argmax())
        value = float(np.median(x[own, axis]))
        left = x[own, axis] < value
        if not left.any():
            value = float(np.unique(x[own, axis])[1])
            left = x[own, axis] < value
        yield node, axis, nodes, value
        waiting += [(nodes, own[left]), (nodes + 1, own[~left])]
        nodes, leaves = nodes + 2, leaves + 1


def cell_of(x: np.ndarray, cells: list[tuple[int, int, int, float]]) -> np.ndarray:
    """The leaf of each row."""
    by = sorted(cells)
    axis, left, value = (np.array([c[k] for c in by]) for k in (1, 2, 3))
    at = np.zeros(len(x), np.int64)
    while (inner := np.flatnonzero(left[at] >= 0)).size:
        own = at[inner]
        at[inner] = left[own] + (x[inner, axis[own]] >= value[own])
    return at


@dataclass
class Tree:
    """Rows in leaf order, and nodes: child (the first of two, or -1), rows from `begin` to `end`, and tight boxes."""

    x: np.ndarray
    ids: np.ndarray
    child: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
        order, nodes = np.argsort(ids, kind="stable"), [(0, len(x))]
        child, boxes, at = [], [], 0
        while at < len(nodes):
            lo, hi = nodes[at]
            own = x[order[lo:hi]]
            boxes.append((own.min(0), own.max(0)))
            spread = boxes[-1][1] - boxes[-1][0]
            if hi - lo <= leaf or not len(spread) or spread.max() == 0:
                child.append(-1)
            else:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, spread.argmax()], mid)]
                child.append(len(nodes))
                nodes += [(lo, lo + mid), (lo + mid, hi)]
            at += 1
        begin, end = np.array(nodes).T
        return cls(x[order], ids[order], np.array(child), begin, end, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))

    def packed(self) -> bytes:
        small = np.int32 if np.abs(self.x).max(initial=0) < 1 << 31 else np.int64
        return pickle.dumps((self.x.astype(small), self.ids, self.child, self.begin, self.end, self.low.astype(small), self.high.astype(small)))


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that each query can have in its own box."""
    return (np.maximum(q, 0) * high).sum(1) + (np.minimum(q, 0) * low).sum(1)


def search(tree: Tree, q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of q, id, score) of each query's k best by (score, smaller id), those under its least score left out; and how many rows were scored."""
    none, scored = np.zeros(0, np.int64), 0
    most = float(np.abs(tree.x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if most < 2**53 else np.int64  # exact either way
    x, low, high, q = (a.astype(kind) for a in (tree.x, tree.low, tree.high, q))
    bound = np.full((len(q), len(tree.child)), -np.inf if kind is np.float64 else -(2**63), kind)
    closed = bound.flat[0] if bound.size else 0
    bound[:, 0] = bounds(q, low[:1], high[:1])
    kth = np.maximum(least.astype(np.int64), NONE)
    row, got, score = none, none, none
    active = np.arange(len(q))
    while len(active):
        node = bound[active].argmax(1)
        on = bound[active, node] >= kth[active]
        active, node = active[on], node[on]
        bound[active, node] = closed
        inner = tree.child[node] >= 0
        for side in (0, 1):
            own, to = active[inner], tree.child[node[inner]] + side
            bound[own, to] = bounds(q[own], low[to], high[to])
        parts = [(row, got, score)]
        for at in np.unique(node[~inner]):
            own = active[node == at]
            lo, hi = tree.begin[at], tree.end[at]
            s = q[own] @ x[lo:hi].T
            scored += s.size
            i, j = np.nonzero((s >= kth[own, None]) & (tree.ids[lo:hi] != q_ids[own, None]))
            parts.append((own[i], tree.ids[lo + j], s[i, j].astype(np.int64)))
        if len(parts) == 1:
            continue
        row, got, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((got, -score, row))
        row, got, score = row[order], got[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, got, score = row[kept], got[kept], score[kept]
        full = np.flatnonzero(np.bincount(row, minlength=len(q)) >= k)
        kth[full] = np.maximum(kth[full], score[np.searchsorted(row, full, "right") - 1])
    return row, got, score, scored


def _visit(trees: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """One shard's tree and a block of queries."""
    if not len(trees) or not len(queries):
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    tree, ids = Tree(*pickle.loads(trees["tree"][0].as_py())), queries["id"].to_numpy()
    row, got, score, _ = search(tree, matrix(queries["v"]), ids, queries["least"].to_numpy(), k)
    return pa.table({"query_id": ids[row], "vec_id": got, "score": score})


def top_k(df: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = 20, shard_rows: int | None = None, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where asks holds, its k best among all other rows.

    shard_rows: at most so many rows share a tree; by default a 64th of all rows, but 8,192 at least and 65,536 at most.
    """
    spark = df.sparkSession
    whole = F.transform(df[vector], lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = df.where(finite(vector) & df[key].isNotNull()).select(df[key].cast("long").alias("id"), whole.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = materialise(rows.withColumn("d", F.size("v")), "vectors")
    n = rows.count()
    shard_rows = shard_rows or min(65_536, max(8192, n // 64))
    sample = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE_ROWS / max(1, n))).select("d", "v").collect()  # about SAMPLE_ROWS rows
    by: dict[int, list] = {}
    for r in sorted(sample, key=lambda r: (r.d, r.v)):
        by.setdefault(r.d, []).append(r.v)
    cells = {d: list(halves(np.array(v, np.int64).reshape(len(v), d), min(MOST_CELLS, max(1, math.ceil(n * len(v) / max(1, len(sample)) / shard_rows))))) for d, v in by.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(3).to_numpy()
            cell = np.zeros(len(d), np.int32)
            for own in np.unique(d):
                if own in cells:
                    at = np.flatnonzero(d == own)
                    cell[at] = cell_of(matrix(batch.column(1).take(pa.array(at))), cells[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "asks", "d", "cell"])

    rows = rows.mapInArrow(deal, "id long, v array<long>, asks boolean, d int, cell int")
    sizes = rows.groupBy("d", "cell").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("parts"))
    rows = rows.join(sizes, ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = materialise(rows, "dealt")
    shard = ["d", "cell", "part"]

    def build(table: pa.Table) -> pa.Table:
        tree = Tree.build(matrix(table["v"]), table["id"].to_numpy())
        head = {c: table[c].slice(0, 1) for c in shard}
        box = [pa.array([b[0].tolist()], pa.list_(pa.int64())) for b in (tree.low, tree.high)]
        return pa.table({**head, "low": box[0], "high": box[1], "tree": [tree.packed()]})

    trees = materialise(rows.select(*shard, "id", "v").groupBy(*shard).applyInArrow(build, "d int, cell int, part int, low array<long>, high array<long>, tree binary"), "trees")
    asked = rows.where("asks").select(*shard, "id", "v").distinct()
    out, visit = "query_id long, vec_id long, score long", lambda t, q: _visit(t, q, k)
    none = F.lit(NONE).cast("long").alias("least")
    first = trees.groupBy(*shard).cogroup(asked.select("*", none).groupBy(*shard)).applyInArrow(visit, out)
    first = materialise(first, "own-shard")
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.sort_array(F.collect_list("score"), False)[k - 1]).otherwise(NONE).alias("least"))  # at most k for each asking vector
    boxes: dict[int, list] = {}
    for r in trees.groupBy("d", "cell").agg(*_box()).collect():  # at most MOST_CELLS for each length of the sample, and one for each other length
        boxes.setdefault(r.d, []).append((r.cell, r.low, r.high))
    boxes = {d: (np.array([b[0] for b in v], np.int32), np.array([b[1] for b in v], np.int64).reshape(len(v), d), np.array([b[2] for b in v], np.int64).reshape(len(v), d)) for d, v in boxes.items()}
    sent = spark.sparkContext.broadcast(boxes)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and cell that may hold one of its best."""
        for batch in batches:
            d, least = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for own in np.unique(d):
                at = np.flatnonzero(d == own)
                names, low, high = sent.value[own]
                q = matrix(batch.column(2).take(pa.array(at)))
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                i, j = np.nonzero(bound >= least[at, None])
                rows = batch.take(pa.array(at[i]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[j])], names=["d", "id", "v", "least", "home", "home_part", "cell"])

    asking = asked.join(reached, "id", "left").select("d", "id", "v", F.coalesce("least", F.lit(NONE)).alias("least"), F.col("cell").alias("home"), F.col("part").alias("home_part"))
    pairs = asking.mapInArrow(reach, "d int, id long, v array<long>, least long, home int, home_part int, cell int")
    parts = trees.select(*shard)
    pairs = pairs.join(parts, ["d", "cell"]).where("not (cell = home and part = home_part)")
    pairs = materialise(pairs.select(*shard, "id", "v", "least"), "pairs")
    blocks = pairs.groupBy(*shard).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).drop("blocks")
    copies = trees.join(blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*shard, "block", "tree")
    rest = materialise(copies.groupBy(*shard, "block").cogroup(dealt.groupBy(*shard, "block")).applyInArrow(visit, out), "others")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    best = materialise(first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
    drop_tables(rows, trees, first, pairs, rest)
    return best


def _box() -> list[Column]:
    """Tight boxes of a cell from those of its shards."""
    fold = lambda c, pick: F.aggregate(F.collect_list(c), F.lit(None).cast("array<long>"), lambda a, b: F.when(a.isNull(), b).otherwise(F.zip_with(a, b, pick)))
    return [fold("low", lambda x, y: F.least(x, y)).alias("low"), fold("high", lambda x, y: F.greatest(x, y)).alias("high")]
