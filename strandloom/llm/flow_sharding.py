"""Resharding by minimum-cost flow.

Documents lie in old shards; new shards have byte capacities. A flow from old shard sizes to new capacities, where a byte
that stays in its shard costs 0 and any other costs 1, moves the fewest bytes. Documents are hashed into blocks of about 64 MB,
1,024 or more for each old shard; the flow is met by whole blocks, and a last pass evens out what blocks can't
meet exactly, so moved bytes stay within a block for each shard of the flow's least. The driver holds block sizes only, at most
about a million rows, beyond which blocks grow; documents go to their new shard's files in one shuffle, to tasks of about 16 MB,
each by its own number, so no two shards meet in a task. Slots are a block's offset plus a row's place in it, by key, size and
a hash of the text, so a retried task gives the same ones.

Defined results: a null text has no bytes; null keys count as key text ''; repeated rows get slots of their own;
an empty table gives no rows; input columns keep their names, whatever they are. Files of shards whose blocks all stay are not written.
"""

from __future__ import annotations

import bisect
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OVERHEAD = 16
#: Columns that plan() and slotted() add, behind a prefix that no input column has.
ADDED = ("old", "block", "size", "shard", "offset", "part", "slot")
#: Blocks on the driver, and at least for each old shard unless that is more; bytes of a block; bytes of a task that writes.
MOST_BLOCKS, LEAST_BLOCKS, BLOCK_BYTES, TASK_BYTES = 1 << 20, 1024, 64 << 20, 16 << 20


class Network:
    """Minimum-cost flow by successive cheapest paths."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.room, self.cost = [], [], []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> int:
        """Push as much as fits; the cost."""
        total = 0
        while True:
            far: dict[int, int] = {source: 0}
            via: dict[int, int] = {}
            line, waiting = deque([source]), {source}
            while line:
                a = line.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and far[a] + self.cost[e] < far.get(b, 1 << 60):
                        far[b], via[b] = far[a] + self.cost[e], e
                        if b not in waiting:
                            waiting.add(b)
                            line.append(b)
            if sink not in far:
                return total
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            total += push * far[sink]


def transfers(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one that move the fewest bytes; shard i of both is the same place."""
    n, m = len(sizes), len(capacities)
    net = Network(n + m + 2)
    arcs = {}
    for i, s in enumerate(sizes):
        net.arc(n + m, i, s, 0)
    for j, c in enumerate(capacities):
        net.arc(n + j, n + m + 1, c, 0)
    for i in range(n):
        for j in range(m):
            arcs[i, j] = net.arc(i, n + j, sizes[i], int(i != j))
    net.solve(n + m, n + m + 1)
    return {k: net.room[e ^ 1] for k, e in arcs.items() if net.room[e ^ 1]}


def capacities_of(total: int, shards: int) -> list[int]:
    """Sizes that differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def place(blocks: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """The new shard of each (old shard, block), from the blocks' sizes. Sizes end as equal as single blocks allow."""
    capacities = capacities_of(sum(blocks.values()), shards)
    sizes = [0] * (max((i for i, _ in blocks), default=-1) + 1)
    for (i, _), s in blocks.items():
        sizes[i] += s
    left: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), f in transfers(sizes, capacities).items():
        left[i][j] = f
    load, at = [0] * shards, {}
    for (i, b), s in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        # a block stays as long as the flow leaves room for it at home; else it goes where the flow has most left
        j = i if left[i].get(i, 0) >= s else max(left[i], key=lambda j: (left[i][j], -j)) if left[i] else i % shards
        left[i][j] = left[i].get(j, 0) - s
        at[i, b] = j
        load[j] += s
    # even out: from the fullest to the emptiest goes the block nearest to half the gap, if possible one that isn't at home any more;
    # every move makes sizes more alike, so this ends
    inside: list[tuple[list, list]] = [([], []) for _ in range(shards)]
    for k, j in at.items():
        inside[j][k[0] == j].append((blocks[k], k))
    for kinds in inside:
        for x in kinds:
            x.sort()
    while True:
        hi, lo = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        for own in inside[hi]:
            i = bisect.bisect_left(own, (gap // 2,))
            near = [own[j] for j in (i - 1, i, i + 1) if 0 <= j < len(own) and 0 < own[j][0] < gap]
            if near:
                break
        else:
            return at
        s, k = min(near, key=lambda x: (abs(gap - 2 * x[0]), x))
        own.remove((s, k))
        bisect.insort(inside[lo][k[0] == lo], (s, k))
        load[hi], load[lo], at[k] = load[hi] - s, load[lo] + s, lo


@dataclass
class Plan:
    """rows: the documents with added columns old, block, size, shard and offset (the slot of the block's first row), named by name();
    affected: shards that a block enters or leaves; untouched: the others that hold rows; sizes: bytes of the new shards; moved: bytes that
    change their shard; least: what the flow needs at least."""

    rows: DataFrame
    prefix: str
    affected: set[int]
    untouched: set[int]
    sizes: list[int]
    moved: int
    least: int

    def name(self, added: str) -> str:
        return self.prefix + added


def plan(df: DataFrame, old: Column, old_shards: int, shards: int, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> Plan:
    """Where the documents of old shards 0 to old_shards - 1 go. blocks: for each old shard, instead of as many as its bytes ask for."""
    spark = df.sparkSession
    prefix = "__"
    while {prefix + a for a in ADDED} & {c.lower() for c in df.columns}:
        prefix += "_"
    own = lambda a: F.col(prefix + a)
    size = (F.coalesce(F.octet_length(df[text]), F.lit(0)) + OVERHEAD).cast("long")
    if blocks is None:
        total = df.agg(F.sum(size).alias("s")).first().s or 0
        blocks = max(1, min(max(LEAST_BLOCKS, -(-total // BLOCK_BYTES // old_shards)), MOST_BLOCKS // old_shards))
    block = F.pmod(F.xxhash64(F.coalesce(df[key].cast("string"), F.lit(""))), F.lit(blocks)).cast("int")
    rows = df.select(*(df[c] for c in df.columns), old.cast("int").alias(prefix + "old"), block.alias(prefix + "block"), size.alias(prefix + "size"))
    found = rows.groupBy(own("old").alias("i"), own("block").alias("b")).agg(F.sum(own("size")).alias("s"), F.count("*").alias("n")).collect()
    at = place({(r.i, r.b): r.s for r in found}, shards)
    offset, sizes, moved, plans = [0] * shards, [0] * shards, 0, []
    before = [0] * old_shards
    for r in sorted(found, key=lambda r: (r.i, r.b)):
        j = at[r.i, r.b]
        plans.append((r.i, r.b, j, offset[j]))
        offset[j] += r.n
        sizes[j] += r.s
        before[r.i] += r.s
        moved += r.s * (r.i != j)
    least = sum(f for (i, j), f in transfers(before, capacities_of(sum(before), shards)).items() if i != j)
    planned = spark.createDataFrame(plans, f"{prefix}old int, {prefix}block int, {prefix}shard int, {prefix}offset long")
    affected = {x for i, _, j, _ in plans if i != j for x in (i, j) if x < shards}
    # the plan has at most MOST_BLOCKS rows of some 20 bytes
    rows = rows.join(F.broadcast(planned), [prefix + "old", prefix + "block"])
    return Plan(rows, prefix, affected, {j for _, _, j, _ in plans} - affected, sizes, moved, least)


def slotted(planned: Plan, shards: set[int], key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of some shards with their slot; a shard's blocks are dealt to as many tasks as its bytes ask for, each with a number of its own."""
    spark, name = planned.rows.sparkSession, planned.name
    col = lambda a: F.col(name(a))
    own = sorted(shards)
    parts = [max(1, -(-planned.sizes[j] // task_bytes)) for j in own]
    first = [sum(parts[:i]) for i in range(len(parts))]
    if not own:
        return planned.rows.where(F.lit(False)).withColumns({name("part"): F.lit(0), name("slot"): F.lit(0).cast("long")})
    tasks = spark.createDataFrame(list(zip(own, parts, first, strict=True)), f"{name('shard')} int, {name('parts')} int, {name('first')} int")
    part = (col("first") + F.pmod(F.xxhash64(name("old"), name("block")), col("parts"))).cast("int")
    rows = planned.rows.join(F.broadcast(tasks), name("shard")).withColumn(name("part"), part).drop(name("parts"), name("first"))  # a row for each shard
    rows = rows.repartitionById(sum(parts), col("part"))
    inside = F.row_number().over(Window.partitionBy(name("part"), name("old"), name("block")).orderBy(key, name("size"), F.xxhash64(text))) - 1
    return rows.withColumn(name("slot"), col("offset") + inside)


def rewrite(planned: Plan, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files of the affected shards under path, a folder for each shard, and read them back; the rows of
    untouched shards, which stay where they are, follow from the source."""
    spark = planned.rows.sparkSession
    moved = slotted(planned, planned.affected, key, text)
    if planned.affected:
        moved.write.partitionBy(planned.name("shard")).parquet(path)
        written = spark.read.schema(moved.schema).parquet(path).select(*moved.columns)
        if not planned.untouched:
            return written
    else:
        written = moved
    return written.unionByName(slotted(planned, planned.untouched, key, text))
