"""Entry points: what a user calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import scoring
from strandloom.functions import sequence as S
from strandloom.functions.alignment import fuzzy_search
from strandloom.functions.motif import parse as motif_parse
from strandloom.functions.statistics import algorithm_weight, parse_weight
from strandloom.operators import offtarget as O
from strandloom.operators import primers as P
from strandloom.operators.interval_join import interval_join
from strandloom.operators.target_finder import find_targets, number_rows
from strandloom.operators.windows import windows
from strandloom.session import materialise


def find_sequence(contigs: DataFrame, queries: list[str]) -> DataFrame:
    """(contig, start, end, strand, id): hits of IUPAC strings on both strands, 1-based and closed, numbered for each query."""
    out = None
    for k, q in enumerate(queries):
        pattern = "^(?i:" + S.class_pattern(q) + ")"
        w = windows(contigs.select("contig", "seq"), len(q))
        sides = F.array(F.struct(F.lit("+").alias("strand"), F.col("window").alias("s")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.col("window")).alias("s")))
        both = w.select("contig", "i", F.inline(sides)).where(F.col("s").rlike(pattern)).select("contig", "strand", "i")
        # a strand's hits of one query don't overlap: of touching ones the leftmost counts, and so on
        both = _leftmost(both, len(q))
        one = number_rows(both, ["contig", "strand", "i"], "n").select("contig", (F.col("i") + 1).alias("start"), (F.col("i") + len(q)).alias("end"), "strand", F.concat(F.lit(f"q{k}_"), F.col("n").cast("string")).alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


def _leftmost(hits: DataFrame, length: int) -> DataFrame:
    """The hits that a left-to-right scan without overlaps takes, within runs of hits that touch."""
    w = Window.partitionBy("contig", "strand").orderBy("i")
    new = F.when(F.col("i") - F.lag("i").over(w) < length, 0).otherwise(1)
    runs = hits.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    at = F.array_sort(F.collect_list("i"))
    pick = F.aggregate(at, F.array().cast("array<int>"), lambda s, i: F.when((F.size(s) == 0) | (i - F.element_at(F.concat(F.array(F.lit(-(1 << 30))), s), -1) >= length), F.concat(s, F.array(i))).otherwise(s))
    return runs.groupBy("contig", "strand", "run").agg(pick.alias("picked")).select("contig", "strand", F.explode("picked").alias("i"))


def find_header(contigs: DataFrame, patterns: list[str], allow_errors: bool = False) -> DataFrame:
    """Records of (contig, info) whose header, '>contig info', matches any of the patterns, whatever the case. allow_errors: with up to a
    quarter of a pattern's letters wrong."""
    head = F.concat(F.lit(">"), "contig", F.when(F.length("info") > 0, F.concat(F.lit(" "), "info")).otherwise(""))
    return contigs.where(matches_any(head, patterns, allow_errors))


def matches_any(text: Column, patterns: list[str], allow_errors: bool = False) -> Column:
    """Whether text holds a match of any pattern, whatever the case."""
    if allow_errors:
        return fuzzy_search([f"(?:{p}){{e<={len(p) // 4}}}" for p in patterns])(text)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike("(?i)" + p)
    return hit


# Tags whose values lead to other features, and tags that aren't searched.
LINKED = ("ID", "Name", "Alias", "Parent", "Gene")
EXCLUDED = ("Note", "orf_classification", "parent_feature_type")


def find_feature(features: DataFrame, patterns: list[str], linked: tuple[str, ...] = LINKED, excluded: tuple[str, ...] = EXCLUDED, allow_errors: bool = False) -> DataFrame:
    """Features (with a map `attributes`) of which an attribute matches a pattern, and those of which an attribute holds a linked value of those;
    each row once, whatever the case. Linked values count as plain text; an Alias is a list of values.

    A linked value is in an attribute only if its first three letters are, so rows meet in an equi-join on three letters. Nothing
    is broadcast: a value is there once for each of its places, and nearly all features may be linked.
    """
    rows = features.withColumn("__values", F.map_values(F.map_filter("attributes", lambda k, _: ~k.isin(*excluded)))).withColumn("__row", F.xxhash64(F.struct(*(c for c in features.columns if c != "attributes")), F.to_json("attributes")))
    rows = materialise(rows, "features")
    if allow_errors:
        found = rows.select("__row", F.explode("__values").alias("v")).where(matches_any(F.col("v"), patterns, True)).select("__row").distinct()
        first = rows.hint("merge").join(found, "__row", "left_semi")
    else:
        first = rows.where(F.exists("__values", lambda v: matches_any(v, patterns)))
    values = F.flatten(F.array(*(F.split(F.coalesce(F.try_element_at("attributes", F.lit(t)), F.lit("")), "," if t == "Alias" else "\u0000") for t in linked if t not in excluded)))
    links = first.select(F.explode(values).alias("link")).where("link <> ''").select(F.lower("link").alias("link")).distinct().withColumn("gram", F.left("link", F.lit(3)))
    grams = lambda v: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(S.positions(F.lit(1), F.length(v) - n + 1), lambda i: F.substring(v, i, n)))))
    texts = rows.select("__row", F.explode("__values").alias("v")).select("__row", F.lower("v").alias("v")).select("__row", "v", F.explode(grams(F.col("v"))).alias("gram"))
    second = texts.hint("merge").join(links, "gram").where(F.contains("v", F.col("link"))).select("__row")
    hit = first.select("__row").union(second).distinct()
    return rows.hint("merge").join(hit, "__row", "left_semi").drop("__row", "__values")


def list_algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.kind, ",".join(s.roles), float(s.least), float(s.most), None if s.default is None else float(s.default), s.weight) for s in scoring.REGISTRY], "name string, kind string, roles string, least double, most double, default double, weight string")


def list_aligners(spark: SparkSession) -> DataFrame:
    rows = [("seed join", "mismatches", "operators.offtarget.seed_join"), ("seed join with shifts", "mismatches and gaps", "operators.similarity.similar_targets"), ("global", "affine gaps", "functions.alignment.align"), ("star", "several sequences", "functions.barcodes.align_groups")]
    return spark.createDataFrame(rows, "name string, allows string, place string")


def list_thermodynamics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("nearest neighbour", "functions.thermodynamics")], "name string, place string")


def list_catalogue(spark: SparkSession, path: str, schema: str = "motif string, protein string, activity string, organism string") -> DataFrame:
    """A catalogue of motifs, restriction sites or terms in a tab-separated file of the user's."""
    return spark.read.csv(path, sep="\t", comment="#", schema=schema)


def design_targets(contigs: DataFrame, features: DataFrame, motifs: list[str], most_mismatches: int = 4, spacer_length: int = 20, weights: dict[str, str] | None = None, keep: int = 5) -> DataFrame:
    """The best `keep` targets of each feature: search, prefilters, off-targets over all contigs, guide score, weight, rank.

    Motifs may give spacers of several lengths; off-targets are compared by the spacer_length letters beside the PAM, shorter spacers by as many as
    they have. weights: {score name: 'position+slope,...'} to weigh by instead of the registered ones.
    """
    found = materialise(find_targets(contigs, motifs), "targets")
    good = found.where(S.gc_percent(F.col("spacer")).between(25, 75) & (S.longest_run(F.col("spacer"), "T") <= 4.5) & (S.longest_homopolymer(F.col("spacer")) <= 4.5))
    inside = interval_join(good, features, 1024).select(F.col("r_name").alias("feature"), F.col("l_spacer").alias("spacer"), F.col("l_pam").alias("pam"), F.col("l_contig").alias("contig"), F.col("l_strand").alias("strand"), F.col("l_start").alias("start"))
    guides = inside.select("spacer").distinct()
    places = found.groupBy("spacer").agg(F.count("*").alias("places"))
    # letters beside the PAM: the last ones where the PAM follows, the first ones where it goes before
    lengths = sorted({min(len(x), spacer_length) for m in motifs for x in motif_parse(m).spacers})
    forward = all(motif_parse(m).side == ">" for m in motifs)
    near = (lambda c, n: F.right(c, F.lit(n))) if forward else (lambda c, n: F.left(c, F.lit(n)))
    pairs = None
    for n in lengths:
        own = guides.where(F.least(F.length("spacer"), F.lit(spacer_length)) == n).select(F.col("spacer").alias("guide"), near(F.col("spacer"), n).alias("spacer"))
        there = places.where(F.length("spacer") >= n).select(F.struct("spacer", "places").alias("site"), near(F.col("spacer"), n).alias("spacer"))
        plain = lambda x: x.where(~S.is_ambiguous(F.col("spacer")))
        one = O.seed_join(plain(own), plain(there), most_mismatches, n)
        pairs = one if pairs is None else pairs.unionByName(one)
    score = scoring.hsu_zhang(F.col("guide"), F.col("site.spacer")) * F.col("site.places")
    sums = pairs.groupBy("guide").agg(F.sum(F.when(F.col("mismatches") == 0, score)).alias("on"), F.coalesce(F.sum(F.when(F.col("mismatches") > 0, score)), F.lit(0.0)).alias("off"))
    rule = parse_weight((weights or {}).get("Hsu-Zhang", next(s.weight for s in scoring.REGISTRY if s.name == "Hsu-Zhang")))
    named = sums.select(F.col("guide").alias("spacer"), O.guide_score(F.col("on"), F.col("off")).alias("guide_score")).withColumn("weight", algorithm_weight(F.col("guide_score"), rule))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("weight"), "spacer", "contig", "start"))
    return inside.join(named, "spacer").withColumn("rank", rank).where(F.col("rank") <= keep)


def design_primers(contigs: DataFrame, regions: DataFrame, sizes: tuple[int, int] = (19, 26), subset: int = 1000, product: tuple[int, int] = (300, 700)) -> DataFrame:
    """(region, forward, reverse, size, weight): pairs for each region (name, contig, f_start, f_end, r_start, r_end).

    Each side's primers are checked and its `subset` best by weight are kept; pairs then meet by region, place and temperature.
    """
    from strandloom.functions.thermodynamics import dimer_dg, duplex

    placed = regions.join(contigs, "contig")

    def side(mark: str, a: str, b: str) -> DataFrame:
        found = P.scan(placed.select("name", F.col(a).alias("start"), F.col(b).alias("end"), "seq"), sizes, None).where(F.col("strand") == mark)
        good = F.lit(True)
        for c in P.checks(F.col("primer")).values():
            good = good & c
        found = found.where(good).select("name", "p_start", "p_end", "primer")
        own = found.withColumn("dg", dimer_dg(F.col("primer"), F.col("primer"))).withColumn("tm", duplex(F.col("primer"))["tm"])
        w = own.withColumn("w", P.weight(F.length("primer"), S.gc_percent(F.col("primer")), F.col("dg")))
        k = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("w"), "primer", "p_start"))
        return w.withColumn("k", k).where(F.col("k") <= subset).drop("k")

    met = P.pair_primers(side("+", "f_start", "f_end"), side("-", "r_start", "r_end"), product)
    weight = P.joint_weight(P.pair_weight(F.col("size"), F.least("f_dg", "r_dg"), F.col("f_tm") - F.col("r_tm")), F.col("f_w"), F.col("r_w"), F.col("f_primer") == F.col("r_primer"))
    return met.select("name", F.col("f_primer").alias("forward"), F.col("r_primer").alias("reverse"), "size", weight.alias("weight"))
