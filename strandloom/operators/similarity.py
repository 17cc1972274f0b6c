"""Similarity join of targets across features, and groups of equivalent targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.components import connected_components


def similar_targets(targets: DataFrame, length: int, mismatches: int = 0, gaps: int = 0) -> DataFrame:
    """(a_feature, a_seq, b_feature, b_seq, errors) of targets of different features, a_feature being the larger name, within so many edits.

    targets: (feature, seq) with sequences of about `length` letters. One of mismatches + gaps + 1 pieces of a must stand in b
    unchanged, shifted by at most `gaps`, so pairs meet in an equi-join on (piece, place, text). Without gaps the edits are mismatches.
    """
    k = mismatches + gaps + 1
    cuts = [length * i // k for i in range(k + 1)]
    t = targets.select("feature", F.upper("seq").alias("seq")).distinct()
    piece = lambda i, shift: F.struct(F.lit(i).alias("no"), F.substring("seq", cuts[i] + 1 + shift, cuts[i + 1] - cuts[i]).alias("text"))
    own = t.select(F.col("feature").alias("a_feature"), F.col("seq").alias("a_seq"), F.inline(F.array(*(piece(i, 0) for i in range(k)))))
    shifted = [piece(i, d) for i in range(k) for d in range(-gaps, gaps + 1) if cuts[i] + d >= 0]
    other = t.select(F.col("feature").alias("b_feature"), F.col("seq").alias("b_seq"), F.inline(F.array(*shifted))).distinct()
    met = own.join(other, ["no", "text"]).where("a_feature > b_feature").select("a_feature", "a_seq", "b_feature", "b_seq").distinct()
    if gaps:
        errors = F.levenshtein("a_seq", "b_seq")
        return met.withColumn("errors", errors).where((F.col("errors") <= mismatches + gaps) & (F.abs(F.length("a_seq") - F.length("b_seq")) <= gaps))
    return met.where(F.length("a_seq") == F.length("b_seq")).withColumn("errors", S.hamming(F.col("a_seq"), F.col("b_seq"))).where(F.col("errors") <= mismatches)


def equivalents(targets: DataFrame, pairs: DataFrame, groups: DataFrame, keep: str = "all") -> DataFrame:
    """(component, feature, seq): targets that similar pairs hold together. keep: 'all' those that reach each feature of their homolog
    group (groups: feature, group), 'exclusive' those of one feature, 'any' every one."""
    if keep not in ("all", "exclusive", "any"):
        raise ValueError(keep)
    name = lambda f, s: F.xxhash64(f, s)
    edges = pairs.select(name("a_feature", "a_seq").alias("a"), name("b_feature", "b_seq").alias("b"))
    t = targets.select("feature", F.upper("seq").alias("seq")).distinct().withColumn("node", name("feature", "seq"))
    rows = t.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    if keep == "any":
        return rows.select("component", "feature", "seq")
    reached = rows.join(groups, "feature").groupBy("component").agg(F.count_distinct("feature").alias("n"), F.min("group").alias("group"))
    sizes = groups.groupBy("group").agg(F.count_distinct("feature").alias("size"))
    right = reached.join(sizes, "group").where("n = size" if keep == "all" else "n = 1").select("component")
    return rows.join(right, "component", "left_semi").select("component", "feature", "seq")
