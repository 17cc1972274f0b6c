"""What a user reads at the end: tables of targets, features, donors and primers, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.sinks import location_text


def _number(name: Column) -> Column:
    return F.substring_index(name, "-", -1).cast("long")


def _listed(pairs: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): the distinct names of each, in the order of their numbers, by commas."""
    entry = F.struct(_number(F.col(name)).alias("k"), F.col(name).alias("n"))
    return pairs.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["n"]), ",").alias(name))


def _places(locations: DataFrame, genes: DataFrame) -> DataFrame:
    """(target, gene, features, positions) of locations (target, feature, contig, strand, start, end); genes are (feature, gene, root)."""
    each = locations.withColumn("f", F.explode(F.split("feature", ","))).join(genes.select(F.col("feature").alias("f"), "gene", "root"), "f", "left")
    position = F.struct("contig", "start", "strand", "f", location_text(F.col("feature"), F.col("contig"), F.col("strand"), F.col("start"), F.col("end")).alias("text"))
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return each.groupBy("target").agg(names("gene").alias("gene"), names("root").alias("features"), F.array_join(F.transform(F.array_sort(F.collect_list(position)), lambda x: x["text"]), ",").alias("positions"))


def target_report(targets: DataFrame, locations: DataFrame, genes: DataFrame, donors: DataFrame, trims: DataFrame | None = None, off: list[str] = (), on: list[str] = ()) -> DataFrame:
    """One row for each target (target, sequence, weight, scores), the best first: genes, features, weight, scores rounded to two places, donors,
    the donors' trims and inserts, positions and warnings. donors are (target, donor); trims (donor, us_trim, insert, ds_trim)."""
    rows = targets.join(_places(locations, genes), "target", "left").join(_listed(donors, "target", "donor"), "target", "left")
    if trims is not None:
        own = donors.join(trims, "donor").select("target", F.struct("insert", "us_trim", "ds_trim").alias("x"))
        said = lambda x: F.concat_ws(":", x["us_trim"].cast("string"), x["insert"], x["ds_trim"].cast("string"))
        rows = rows.join(own.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_set("x")), said), ",").alias("trims")), "target", "left")
    scores = [F.round(F.col(f"`{x}`"), 2).alias(f"OT:{x}") for x in off] + [F.round(F.col(f"`{x}`"), 2).alias(x) for x in on]
    out = rows.orderBy(F.desc("weight"), "target")
    filled = lambda c: F.coalesce(c, F.lit(""))
    return out.select(filled(F.col("gene")).alias("gene"), filled(F.col("features")).alias("features"), "weight", "target", "sequence", *scores, filled(F.col("donor")).alias("donors"), (F.coalesce("trims", F.lit("")) if trims is not None else F.lit("None")).alias("trims"), filled(F.col("positions")).alias("positions"), F.lit("None").alias("warnings"))


def shared_feature_donors(target_features: DataFrame, donor_features: DataFrame) -> DataFrame:
    """(target, donor) with a feature in common, from (target, feature) and (donor, feature): the donors that put back what a target cuts out."""
    return target_features.join(donor_features, "feature").select("target", "donor").distinct()


def feature_report(features: DataFrame) -> DataFrame:
    """One row for each feature in the order of names, from (gene, name, contig, start, end, strand, root, homologs, root_start, root_end and the seed
    target's t_name, t_contig, t_start, t_end): its seed target, its homologs, and, for a derived one, the layout of its parts: letters
    before the first, which it is (F the parent, T the target), letters between, the second, letters after."""
    t_start, t_end = F.coalesce("t_start", F.lit(0)), F.coalesce("t_end", F.lit(0))  # no target stands at the contig's start
    first = F.col("root_start") < t_start
    layout = lambda a, one, b, two, c: F.concat_ws(":", (a).cast("string"), F.lit(one), (b).cast("string"), F.lit(two), (c).cast("string"))
    text = F.when(first, layout(F.col("root_start") - F.col("start"), "F", t_start - F.col("root_end"), "T", F.col("end") - t_end)).otherwise(
        layout(t_start - F.col("start"), "T", F.col("root_start") - t_end, "F", F.col("end") - F.col("root_end"))
    )
    seed = F.when(F.col("t_name").isNotNull(), F.concat(F.concat_ws(":", "t_name", "t_contig", F.col("t_start").cast("string")), F.lit(".."), F.col("t_end").cast("string")))
    others = F.array_join(F.array_except(F.coalesce("homologs", F.array().cast("array<string>")), F.array("name")), ",")
    return features.select("gene", F.col("root").alias("parent"), "name", "contig", "start", "end", "strand", seed.alias("seed_targets"), F.when(F.col("root") != F.col("name"), text).alias("layout"), others.alias("homologs")).orderBy("name")


# Columns of the reports that end with their titles.
TITLES = {
    "reDonor": ["gene", "features", "weight", "reDonor name", "exTargets", "feature:contig:strand:start..end", "sequence"],
    "exDonor": ["gene", "features", "weight", "exDonor name", "reTargets", "feature:contig:strand:start..end", "sequence"],
    "AmpF/AmpR": ["gene", "features", "weight", "reDonor name", "AmpF", "AmpR", "amplicon sizes", "Tms", "GCs", "min(delta-G)"],
}


def donor_report(spark: SparkSession, kind: str, donors: DataFrame | None = None) -> DataFrame:
    """The titles of a report of donors or of primers around them, and under them the rows (in the titles' order) if there are any, best first."""
    schema = ", ".join(f"`{t}` string" for t in TITLES[kind])
    if donors is None:
        return spark.createDataFrame([], schema)
    rows = donors.orderBy(F.desc(donors.columns[2]), donors.columns[3])
    return rows.select(*(F.col(c).cast("string").alias(t) for c, t in zip(donors.columns, TITLES[kind], strict=True)))
