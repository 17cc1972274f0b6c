"""Primer scans, checks, weights, pairs and in-silico PCR."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions.statistics import logistic_down, logistic_up, logistic_updown
from strandloom.operators.windows import cut, windows

#: The most rows of primers, with letters left out or not, that are broadcast.
FEW = 1 << 16


def scan(regions: DataFrame, sizes: tuple[int, int], overlap: tuple[int, int] | None = (4, 8)) -> DataFrame:
    """(region columns, strand, p_start, p_end, primer): every oligo of a size that lies in [start, end) of seq, or hangs over its
    edges by leaving at least overlap[0] letters of its 3' end and overlap[1] of its 5' end inside."""
    n = F.col("__n")
    # what primers can hold of a contig is cut out once for each region
    base = F.greatest(F.col("start") - sizes[1], F.lit(0))
    near = cut(F.col("seq"), base, F.greatest(F.col("end") + sizes[1] - base, F.lit(0)))
    sized = regions.withColumns({"__n": F.length("seq"), "__base": base, "__near": near}).withColumn("size", F.explode(F.sequence(F.lit(sizes[0]), F.lit(sizes[1]))))
    inside3, inside5 = overlap if overlap else (None, None)

    def strand(mark: str) -> DataFrame:
        if overlap is None:
            low, high = F.col("start"), F.col("end") - F.col("size")
        else:
            # '+': the 3' end is the right one; '-': the left one
            left, right = (inside3, inside5) if mark == "+" else (inside5, inside3)
            low, high = F.col("start") - (F.col("size") - left), F.col("end") - right
        low, high = F.greatest(low, F.lit(0)), F.least(high, n - F.col("size"))
        at = sized.withColumn("p_start", F.explode(S.positions(low.cast("int"), high.cast("int"))))
        text = F.substring("__near", F.col("p_start") - F.col("__base") + 1, F.col("size"))
        return at.select(*regions.columns, F.lit(mark).alias("strand"), "p_start", (F.col("p_start") + F.col("size")).alias("p_end"), (text if mark == "+" else S.reverse_complement(text)).alias("primer"))

    return strand("+").unionByName(strand("-"))


def gc_clamp(primer: Column) -> Column:
    """Length of the run of G and C at the 3' end."""
    return F.length(F.regexp_extract(primer, "[GCgc]*$", 0))


def last_five_gc(primer: Column) -> Column:
    return S.count_letters(F.right(primer, F.lit(5)), "GCgc")


def has_long_run(primer: Column, most: int) -> Column:
    return primer.rlike("(.)\\1{%d}" % most)


def checks(primer: Column, length=(17, 28), last5=(1, 3), clamp=(0, 2), gc=(0.25, 0.75), run=4, own=3) -> dict[str, Column]:
    """The sequence checks in their order; those that need thermodynamics come after."""
    return {
        "mask": F.upper(primer) == primer,
        "length": F.length(primer).between(*length),
        "last5": last_five_gc(primer).between(*last5),
        "clamp": gc_clamp(primer).between(*clamp),
        "gc": S.base_frequency(primer, "CG").between(*gc),
        "run": ~has_long_run(primer, run),
        "own": S.three_prime_complement(primer, primer) <= own,
    }


def summarise(values: list[Column]) -> Column:
    """True if all checks that aren't null hold."""
    return F.forall(F.filter(F.array(*values), lambda v: v.isNotNull()), lambda v: v)


def weight(length: Column, gc_percent: Column, delta_g: Column) -> Column:
    """A missing delta G counts as minus infinity."""
    fold = F.coalesce(logistic_up(delta_g, 3, -4), F.lit(0.0))
    return logistic_updown(length, 3, 17, 1.7, 30) * logistic_updown(gc_percent, 1.7, 40, 1.7, 60) * fold


def pair_weight(size: Column, delta_g: Column, tm_difference: Column, minimise: bool = False) -> Column:
    by_size = logistic_down(size, 1.03, 150) if minimise else logistic_updown(size, 1.03, 300, 1.03, 700)
    return by_size * F.coalesce(logistic_up(delta_g, 3, -4), F.lit(0.0)) * logistic_updown(tm_difference, 5, -2.5, 5, 2.5)


def joint_weight(pair: Column, forward: Column, reverse: Column, same: Column) -> Column:
    return pair * F.when(same, (forward + reverse) / 2).otherwise(forward * reverse)


def marmur(seq: Column) -> Column:
    """Melting temperature of a short oligo: 2 for A and T, 4 for G and C."""
    return 2 * S.count_letters(seq, "ATat") + 4 * S.count_letters(seq, "GCgc")


def wallace(seq: Column) -> Column:
    return 64.9 + 41 * (S.count_letters(seq, "GCgc") - 16.4) / F.length(seq)


def binding_sites(primers: DataFrame, contigs: DataFrame, substitutions: int = 0) -> DataFrame:
    """(primer, contig, strand, start, end): hits on both strands, overlapping ones too, from (primer) and (contig, seq); with up to so many
    other letters than the primer's.

    Contigs give their windows of each primer length, which meet the primers, and with substitutions the primers with any letter at so many
    places, by equality. Up to FEW rows of primers are broadcast; windows never are, though Spark takes them for as small as the table of contigs.
    """
    own = primers.select(F.upper("primer").alias("primer")).distinct()
    both = own.select("primer", F.lit("+").alias("strand"), F.col("primer").alias("site")).unionByName(own.select("primer", F.lit("-").alias("strand"), S.reverse_complement(F.col("primer")).alias("site")))
    lengths = sorted(map(tuple, own.groupBy(F.length("primer")).count().where(F.length("primer").isNotNull()).collect()))  # a handful of primer lengths
    out = None
    for n, count in lengths:
        w = windows(contigs.select("contig", F.upper("seq").alias("seq")), n).select("contig", F.col("i").alias("start"), (F.col("i") + n).alias("end"), "window")
        p = both.where(F.length("primer") == n)
        holes = [places for places in itertools.combinations(range(n), min(substitutions, n))]
        mask = lambda c, holes=holes: F.explode(F.array(*(_with_holes(F.col(c), h) for h in holes)))
        p = p.withColumn("site", mask("site") if substitutions else F.col("site"))
        p = F.broadcast(p) if 2 * count * len(holes) <= FEW else p
        met = w.withColumn("site", mask("window") if substitutions else F.col("window")).hint("merge").join(p, "site")
        met = met.select("primer", "contig", "strand", "start", "end")
        met = met.distinct() if substitutions else met
        out = met if out is None else out.unionByName(met)
    return contigs.select(F.lit("").alias("primer"), "contig", F.lit("").alias("strand"), F.lit(0).alias("start"), F.lit(0).alias("end")).where(F.lit(False)) if out is None else out


def _with_holes(seq: Column, holes: tuple[int, ...]) -> Column:
    for h in holes:
        seq = F.overlay(seq, F.lit("_"), F.lit(h + 1))
    return seq


def amplicons(pairs: DataFrame, sites: DataFrame, least: int = 0, most: int = 10_000) -> DataFrame:
    """(forward, reverse, contig, start, end, size): products of a '+' hit of forward and a later '-' hit of reverse. Hits meet only where they are
    near enough: by stretches of `most` letters, a reverse hit being looked for in its own and the one before."""
    f = sites.where("strand = '+'").select(F.col("primer").alias("forward"), "contig", F.col("start"), F.floor(F.col("start") / most).alias("bin"))
    r = sites.where("strand = '-'").select(F.col("primer").alias("reverse"), "contig", "end")
    r = r.withColumn("bin", F.explode(F.array(F.floor(F.col("end") / most), F.floor(F.col("end") / most) - 1)))
    met = pairs.join(f, "forward").join(r, ["reverse", "contig", "bin"]).where("start < end")
    return met.select("forward", "reverse", "contig", "start", "end", (F.col("end") - F.col("start")).alias("size")).where(F.col("size").between(least, most))


def simulate_amplification(pairs: DataFrame, contigs: DataFrame, sizes: tuple[int, int] = (10, 5000)) -> DataFrame:
    """amplicons() of pairs (forward, reverse), whose primers may each differ from their sites in one letter."""
    own = pairs.select(F.col("forward").alias("primer")).union(pairs.select("reverse"))
    return amplicons(pairs.select(F.upper("forward").alias("forward"), F.upper("reverse").alias("reverse")), binding_sites(own, contigs, 1), *sizes)


def pair_primers(forward: DataFrame, reverse: DataFrame, product: tuple[int, int] | None = (300, 700), most_tm: float = 3.0, most_end: int = 3, by: str = "name") -> DataFrame:
    """forward's and reverse's columns (as f_<name> and r_<name>) of the pairs of one region, size: whose product is in the range, whose melting
    temperatures differ by at most most_tm and whose 3' ends lie in the other by at most most_end letters. Both need p_start, p_end, primer, tm.

    Pairs meet by region, by stretches of the contig and by degrees, so a large region spreads over many tasks; ends are prepared once
    for each primer. A range of None sets no bound. Neither side is broadcast: each primer is there once for every degree and stretch, and Spark
    takes it for one row.
    """
    low, high = product or (0, 0)
    width = max(50, (high - low) // 4)
    end = most_end + 1

    def side(df: DataFrame, mark: str) -> DataFrame:
        named = [F.col(c).alias(f"{mark}_{c}") for c in df.columns if c != by]
        return df.select(by, *named, F.right("primer", F.lit(end)).alias(f"{mark}__end"), S.reverse_complement(F.col("primer")).alias(f"{mark}__rc"))

    degree = F.floor(F.col("r_tm") / most_tm)
    f = side(forward, "f").withColumn("__degree", F.floor(F.col("f_tm") / most_tm)).withColumn("__bin", F.floor(F.col("f_p_start") / width) if product else F.lit(0).cast("long"))
    r = side(reverse, "r").withColumn("__degree", F.explode(F.array(degree - 1, degree, degree + 1)))
    r = r.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("r_p_end") - high) / width), F.floor((F.col("r_p_end") - low) / width))) if product else F.lit(0).cast("long"))
    # without a range a region has a few degrees only, so its forward primers are dealt out
    parts = 1 if product else 32
    f = f.withColumn("__part", F.pmod(F.xxhash64("f_primer", "f_p_start"), F.lit(parts)))
    r = r.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = f.hint("merge").join(r, [by, "__degree", "__bin", "__part"]).withColumn("size", F.col("r_p_end") - F.col("f_p_start"))
    good = F.abs(F.col("f_tm") - F.col("r_tm")) <= most_tm
    if product:
        good = good & F.col("size").between(low, high)
    met = met.where(good).where(~F.contains("r__rc", F.col("f__end")) & ~F.contains("f__rc", F.col("r__end")))
    return met.drop("__degree", "__bin", "__part", "f__end", "r__end", "f__rc", "r__rc")
