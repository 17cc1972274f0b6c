"""Whole designs: donors by kind, donors that put features back, features widened to hold targets, spacers judged, and all of it together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import sequence as S
from strandloom.functions.words import likeliest_instance
from strandloom.operators import donors as D
from strandloom.operators import offtarget as O
from strandloom.operators.interval_join import interval_join
from strandloom.operators.target_finder import find_targets
from strandloom.plans import api
from strandloom.session import materialise

#: Kinds of donors that take a feature out.
KINDS = ("mintag", "addtag", "unitag", "bartag")


def excision_donors(features: DataFrame, contigs: DataFrame, kind: str, motif: str = "N{20}>NGG", length: int = 100, compositions: dict[str, float] | None = None, **options) -> DataFrame:
    """features with insert and donor. mintag: arms with short inserts (options of donors.mintag); addtag: inserts that are targets of the motif, kept
    where a target spans them; unitag: one such insert for all, unlike the genome's composition if that is given; bartag: a bar code for
    each feature out of `codes`."""
    rows = features.join(contigs.select("contig", "seq"), "contig")
    if kind == "mintag":
        return D.mintag(rows, **{"up": (24, 24), "down": (24, 24), "total": (48, 49), "inserts": (0, 1)} | options).drop("seq")
    if kind == "addtag":
        return D.spanning_tag(rows, motif, length, options.get("samples", 100)).withColumnRenamed("tag", "insert")
    if kind == "unitag":
        tag = likeliest_instance(motif, compositions or dict.fromkeys("ACGT", 0.25), complement=True)
        return D.centred(rows, F.lit(tag), length).withColumn("insert", F.lit(tag)).drop("seq")
    if kind == "bartag":
        codes = options["codes"]
        place = F.row_number().over(Window.orderBy("feature"))  # features of one design
        named = rows.join(features.select("feature").distinct().withColumn("k", place), "feature").where(F.col("k") <= len(codes))
        named = named.withColumn("insert", F.element_at(F.array(*map(F.lit, codes)), F.col("k")))
        return D.centred(named, F.col("insert"), length).drop("seq", "k")
    raise ValueError(f"kinds of donors are {', '.join(KINDS)}")


def reversion_donors(features: DataFrame, contigs: DataFrame, with_primers: bool = False, least: int = 200, most: int = 600, subset: int = 1000, keep: int = 5) -> DataFrame:
    """Donors that put features (feature, contig, start, end, parent_start, parent_end) back. with_primers: what a pair of primers around a feature
    amplifies, the forward one `least` to `most` letters before it and the reverse one as far behind; the best `keep` by weight for each,
    with forward, reverse, size, weight and rank."""
    rows = features.join(contigs.select("contig", "seq"), "contig")
    if not with_primers:
        return D.reversion(rows, least, most).drop("seq")
    low = lambda c: F.greatest(c, F.lit(0))
    regions = features.select(F.col("feature").alias("name"), "contig", low(F.col("start") - most).alias("f_start"), low(F.col("start") - least).alias("f_end"), (F.col("end") + least).alias("r_start"), (F.col("end") + most).alias("r_end"))
    pairs = api.design_primers(contigs, regions, subset=subset, product=(2 * least, 2 * most + 10_000))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("weight"), "forward", "reverse", "size"))
    best = pairs.withColumn("rank", rank).where(F.col("rank") <= keep).withColumnRenamed("name", "feature")
    met = rows.join(best, "feature")
    first = F.instr(F.substring("seq", low(F.col("start") - most) + 1, F.col("start") - low(F.col("start") - most)), F.col("forward")) - 1 + low(F.col("start") - most)
    return met.withColumn("donor", D.part(F.col("seq"), first, first + F.col("size"))).drop("seq")


def expand_features(features: DataFrame, contigs: DataFrame, motifs: list[str], mode: str = "center_both", pad: int = 0, least: int = 0, most: int = 1 << 30) -> DataFrame:
    """(feature, contig, start, end, strand, t_start, t_end, spacer, x_start, x_end): each feature widened to hold each target on it, as the mode lays
    out, and kept if it stays in the contig and of a length between least and most."""
    found = interval_join(find_targets(contigs, motifs), features, 1024)
    rows = found.select(*(F.col(f"r_{c}").alias(c) for c in features.columns), F.col("l_start").alias("t_start"), F.col("l_end").alias("t_end"), F.col("l_spacer").alias("spacer"))
    wide = rows.withColumn("x", D.format_bounds(mode, F.col("start"), F.col("end"), F.col("t_start"), F.col("t_end"), pad, least))
    out = wide.select(*rows.columns, F.col("x.start").cast("int").alias("x_start"), F.col("x.end").cast("int").alias("x_end"))
    inside = out.join(contigs.select("contig", F.length("seq").alias("n")), "contig").where("x_start >= 0 and x_end <= n")
    return inside.where((F.col("x_end") - F.col("x_start")).between(least, most)).drop("n")


def derive_features(expanded: DataFrame) -> DataFrame:
    """(contig, x_start, x_end, name, parents): widened features with equal bounds become one, named after all features in it."""
    one = expanded.groupBy("contig", "x_start", "x_end").agg(F.array_sort(F.collect_set("feature")).alias("parents"))
    return one.withColumn("name", F.concat(F.array_join("parents", "/"), F.lit("_derived-"), F.col("x_start").cast("string"), F.lit(".."), F.col("x_end").cast("string")))


def evaluate_spacers(spacers: DataFrame, contigs: DataFrame, motifs: list[str], mismatches: int = 5, length: int = 20, found: DataFrame | None = None) -> DataFrame:
    """(target, spacer, places, near, gc, guide): for each of a user's spacers how often it stands in the contigs, how many other places are near, its GC
    and its guide score; a spacer that stands nowhere has no score. found: the motifs' targets in the contigs, where they are known.

    Places are counted by their spacer first, and equal spacers are judged once, so pairs are of different texts and hold nothing else."""
    from strandloom.functions.scoring import hsu_zhang

    place = ["contig", "strand", "start", "end"]
    there = (find_targets(contigs, motifs) if found is None else found).where((F.length("spacer") == length) & ~S.is_ambiguous(F.col("spacer")))
    counts = there.select(*place, "spacer").dropDuplicates(place).groupBy("spacer").agg(F.count("*").alias("n"))
    counts = materialise(counts, "places")
    own_rows = materialise(spacers.select("target", "spacer"), "own-spacers")
    pairs = O.near_spacers(own_rows, counts, mismatches, length).join(counts.withColumnRenamed("spacer", "site"), "site")
    own, n = F.col("mismatches") == 0, F.col("n")
    s = pairs.withColumn("s", hsu_zhang(F.col("guide"), F.col("site")) * n)
    sums = s.groupBy(F.col("guide").alias("spacer")).agg(F.sum(F.when(own, n)).alias("places"), F.sum(F.when(~own, n)).alias("near"), F.coalesce(F.sum(F.when(own, F.col("s"))), F.lit(0.0)).alias("on"), F.coalesce(F.sum(F.when(~own, F.col("s"))), F.lit(0.0)).alias("off"))
    out = own_rows.join(sums, "spacer", "left")
    guide = F.when(F.col("places") > 0, O.guide_score(F.col("on"), F.col("off")))
    return out.select("target", "spacer", F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("near", F.lit(0)).alias("near"), S.gc_percent(F.col("spacer")).alias("gc"), guide.alias("guide"))


def design_all(contigs: DataFrame, features: DataFrame, motifs: list[str], kind: str = "mintag", keep: int = 5, **options) -> dict[str, DataFrame]:
    """targets: the best excision targets of each feature; donors: excision donors with inserts; retargets: targets that touch a donor's junction and
    stand nowhere else. features are (name, contig, start, end). Donors and targets that several results need are written once."""
    targets = api.design_targets(contigs, features, motifs, keep=keep)
    donors = excision_donors(features.withColumnRenamed("name", "feature"), contigs, kind, motifs[0], **options)
    key = F.concat_ws(":", "feature", "insert", F.xxhash64("donor").cast("string"))
    donors = materialise(donors.withColumn("key", key), "donors")
    if "up_n" not in donors.columns:
        donors = donors.withColumn("up_n", F.greatest(F.col("start") - F.greatest("us_start", F.lit(0)), F.lit(0)))
    found = find_targets(donors.select(F.col("key").alias("contig"), F.col("donor").alias("seq")).distinct(), motifs)
    t = found.select(F.col("contig").alias("key"), "strand", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("spacer"), "pam")
    touching = donors.join(t.withColumnRenamed("strand", "t_strand"), "key").where(D.over_junction(F.col("t_start"), F.col("t_end"), F.col("up_n"), F.col("insert")))
    elsewhere = find_targets(contigs, motifs).select("spacer").distinct()
    return {"targets": targets, "donors": donors, "retargets": touching.join(elsewhere, "spacer", "left_anti")}
