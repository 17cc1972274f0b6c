"""Multiple alignments by columns: counts, consensus, gaps, and windows that two homologs can share.

An alignment's rows are (grp, name, s) with gapped sequences of one length; its columns are (grp, i, nt, n), from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import sequence as S

def columns(rows: DataFrame, grp: str = "grp", seq: str = "s") -> DataFrame:
    """How often each letter stands in each column."""
    each = rows.select(F.col(grp).alias("grp"), F.posexplode(S.letters(F.col(seq))).alias("i", "nt"))
    return each.groupBy("grp", (F.col("i") + 1).cast("long").alias("i"), "nt").agg(F.count("*").alias("n"))


def consensus(cols: DataFrame) -> DataFrame:
    """(grp, i, consensus, count, mark): the most frequent letters, how often each stands there, and how much of the column that is: all *, three
    quarters |, half :, a quarter ., less or with a gap a space."""
    base = F.col("nt") != "-"
    t = cols.groupBy("grp", "i").agg(
        F.sum("n").alias("total"), F.max(F.when(base, F.col("n"))).alias("count"), F.coalesce(F.sum(F.when(~base, F.col("n"))), F.lit(0)).alias("gaps"),
        F.sort_array(F.collect_list(F.when(base, F.struct("nt", "n")))).alias("all"),
    )
    letters = F.transform(F.filter("all", lambda x: x["n"] == F.col("count")), lambda x: x["nt"])
    n, total = F.col("count"), F.col("total")
    mark = F.when(F.col("gaps") > 0, " ").when(n == total, "*").when(n * 4 >= total * 3, "|").when(n * 2 >= total, ":").when(n * 4 >= total, ".").otherwise(" ")
    return t.select("grp", "i", F.when(F.size("all") > 0, F.array_join(letters, "")).alias("consensus"), "count", mark.alias("mark"))


def minority_gaps(cols: DataFrame) -> DataFrame:
    """(grp, i) of columns of which at most half are gaps."""
    gaps = F.sum(F.when(F.col("nt") == "-", F.col("n")).otherwise(0))
    return cols.groupBy("grp", "i").agg(gaps.alias("g"), F.sum("n").alias("t")).where("g * 2 <= t").select("grp", "i")


def windows(cols: DataFrame, length: int, mismatches: int = 0, gaps: int = 0, errors: int | None = None) -> DataFrame:
    """(grp, i, mismatches, gaps): first columns of windows of full length with at most so many columns that differ, that hold gaps, and of both
    together."""
    base = F.col("nt") != "-"
    differ = (F.max(F.when(base, F.col("n"))) < F.sum(F.when(base, F.col("n")))).cast("int")
    t = cols.groupBy("grp", "i").agg(differ.alias("mm"), (F.count_if(~base) > 0).cast("int").alias("gap"))
    x = Window.partitionBy("grp").orderBy("i").rowsBetween(0, length - 1)
    w = t.select("grp", "i", F.sum(F.coalesce("mm", F.lit(0))).over(x).alias("mismatches"), F.sum("gap").over(x).alias("gaps"), F.count("*").over(x).alias("n"))
    good = (F.col("n") == length) & (F.col("mismatches") <= mismatches) & (F.col("gaps") <= gaps)
    if errors is not None:
        good = good & (F.col("mismatches") + F.col("gaps") <= errors)
    return w.where(good).select("grp", "i", "mismatches", "gaps")


def nearest_windows(cols: DataFrame, length: int, side: str = "right", mismatches: int = 0, gaps: int = 0, errors: int | None = None) -> DataFrame:
    """(grp, nearest, windows): of the windows of an alignment of the letters before a feature (side right) or behind it (left) the one nearest to the
    feature, and how many there are."""
    pick = F.max("i") if side == "right" else F.min("i")
    return windows(cols, length, mismatches, gaps, errors).groupBy("grp").agg(pick.alias("nearest"), F.count("*").alias("windows"))


def homologous_region(upstream: DataFrame, downstream: DataFrame, length: int, mismatches: int = 0, gaps: int = 0, errors: int | None = None) -> DataFrame:
    """(grp, up_end, down_start): how far before and behind a feature's homologs lies the nearest stretch that all of them share well enough, from the
    aligned rows (grp, s) of both sides; null where a side has none."""
    n = columns(upstream).groupBy("grp").agg(F.max("i").alias("n"))
    up = nearest_windows(columns(upstream), length, "right", mismatches, gaps, errors).join(n, "grp").select("grp", (F.col("n") - F.col("nearest") - length + 1).alias("up_end"))
    down = nearest_windows(columns(downstream), length, "left", mismatches, gaps, errors).select("grp", (F.col("nearest") - 1).alias("down_start"))
    groups = upstream.select("grp").union(downstream.select("grp")).distinct()
    return groups.join(up, "grp", "left").join(down, "grp", "left")
