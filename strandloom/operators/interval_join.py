"""Interval joins by bins: an equi-join on (contig, bin), the exact test, and each pair once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column, base: int = 0) -> Column:
    """Length of the intersection: half-open for base 0, closed for base 1; 0 if disjoint or touching."""
    n = F.least(e1, e2) - F.greatest(s1, s2) + base
    return F.greatest(n, F.lit(0))


def interval_join(left: DataFrame, right: DataFrame, width: int = 1024, contig: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows on one contig whose half-open ranges share a place: left's columns as l_<name>, right's as r_<name>, and overlap.

    width should be near the longer side's usual length; both sides repeat a row once for each bin it touches, and a
    pair counts only in the bin where its intersection starts. Empty ranges and null ends join nothing.
    """
    def side(df: DataFrame, mark: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
        named = [F.col(c).alias(f"{mark}_{c}") for c in df.columns]
        return df.where(F.col(end) > F.col(start)).select(*named, F.explode(bins).alias(f"{mark}__bin"))

    a, b = side(left, "l"), side(right, "r")
    same = (F.col(f"l_{contig}") == F.col(f"r_{contig}")) & (F.col("l__bin") == F.col("r__bin"))
    first = F.greatest(F.col(f"l_{start}"), F.col(f"r_{start}"))
    n = overlap(F.col(f"l_{start}"), F.col(f"l_{end}"), F.col(f"r_{start}"), F.col(f"r_{end}"))
    met = a.join(b, same).where((n > 0) & (F.floor(first / width) == F.col("l__bin")))
    return met.withColumn("overlap", n).drop("l__bin", "r__bin")
