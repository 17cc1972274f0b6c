"""Connected components by hooking of roots and pointer jumping.

Each round, a node's parent becomes the smallest of its own grandparent, the grandparents of its neighbours, and the grandparents
that neighbours of its children have found; so trees hook onto trees, not single nodes, and rounds grow with the logarithm of a
component's size. Rounds are joins and partial aggregates over the edges; nothing is gathered on the driver but one flag,
and each round's labels are written to the shared scratch folder, so lineage stays short and a lost executor costs one round
at most. A round's labels are deleted once the next round has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import drop_tables, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the edges; component is the smallest node that it can reach.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows. Labels only ever fall, so the loop ends.
    """
    pairs = edges.select(edges[a].alias("u"), edges[b].alias("v")).where("u is not null and v is not null and u <> v")
    both = materialise(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    first = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("f"))
    grand = lambda f: f.join(f.select(F.col("node").alias("f"), F.col("f").alias("g")), "f", "left").select("node", "f", F.coalesce("g", "f").alias("g"))
    labels = materialise(grand(first), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "g"), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("m"))
        seen = labels.join(near, "node")
        hook = seen.groupBy(F.col("f").alias("node")).agg(F.min("m").alias("h"))
        now = seen.join(hook, "node", "left").select("node", F.least("f", "g", "m", "h").alias("f"), F.col("f").alias("old_f"), F.col("g").alias("old_g"))
        up = now.select(F.col("node").alias("f"), F.col("f").alias("g"))
        step = materialise(now.join(up, "f").select("node", "f", "g", ((F.col("f") != F.col("old_f")) | (F.col("g") != F.col("old_g"))).alias("moved")), "labels")
        drop_tables(labels)
        labels = step.select("node", "f", "g")
        if not step.where("moved").limit(1).count():
            drop_tables(both)
            return labels.select("node", F.col("f").alias("component"))
