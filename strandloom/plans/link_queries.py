"""Queries for features, alignments, primer sets, words, formats and reports, each through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions import statistics as St
from strandloom.functions import words as W
from strandloom.functions import scoring
from strandloom.functions.motif import parse as motif
from strandloom.functions.translation import STANDARD_CODE
from strandloom.operators import alignments as A
from strandloom.operators import features as Fe
from strandloom.operators import primer_sets as PS
from strandloom.operators import primers as P
from strandloom.plans import bridge as B
from strandloom.plans import reports
from strandloom.plans.registry import query, table
from strandloom.session import materialise
from strandloom.sources import readers as R
from strandloom.sources import sinks as K

# A tree over the features: the parent of the kth is the (k // 3)th.
_TREE = "tree AS (SELECT feature AS name, CASE WHEN substr(feature, 2)::BIGINT // 3 > 0 THEN 'f' || (substr(feature, 2)::BIGINT // 3) END AS parent, gene, contig, start, \"end\", strand FROM features)"
_ROOTS = f"WITH RECURSIVE {B.FEATURES}, {_TREE}, up(name, anc) AS (SELECT name, name FROM tree UNION ALL SELECT up.name, tree.parent FROM up JOIN tree ON tree.name = anc JOIN features f ON f.feature = tree.parent), roots AS (SELECT up.name, anc AS root FROM up JOIN tree t ON t.name = anc WHERE t.parent IS NULL OR t.parent NOT IN (SELECT feature FROM features))"


def _tree(spark, d):
    k = F.expr("cast(substring(feature, 2) as bigint) div 3")
    return B.features(spark, d).select(F.col("feature").alias("name"), F.when(k > 0, F.concat(F.lit("f"), k.cast("string"))).alias("parent"), "gene", "contig", "start", "end", "strand")


@query(f"{_ROOTS} SELECT name, root FROM roots")
def feature_roots(spark, d):
    return Fe.with_root(_tree(spark, d)).select("name", "root")


@query(f"{_ROOTS} SELECT r.name, f.gene FROM roots r JOIN features f ON f.feature = r.root")
def feature_genes(spark, d):
    """Each feature with the gene of its furthest ancestor."""
    t = _tree(spark, d)
    return Fe.with_gene(Fe.with_root(t).drop("gene"), t.select(F.col("name").alias("feature"), "gene")).select("name", "gene")


@query(f"WITH {B.FEATURES}, g AS (SELECT gene, string_agg(feature, ',' ORDER BY feature) AS homologs FROM features GROUP BY gene) SELECT feature, homologs FROM features JOIN g USING (gene)")
def feature_homologs(spark, d):
    f = B.features(spark, d)
    return Fe.with_homologs(f, f.select("feature", F.col("gene").alias("group")), "feature").select("feature", F.array_join("homologs", ",").alias("homologs"))


@query(f"WITH {B.FEATURES} SELECT feature, feature AS gene, feature AS \"group\" FROM features")
def default_homologs(spark, d):
    f = Fe.require_features(B.features(spark, d), B.contigs(spark, d), name="feature")
    return Fe.default_homologs(f, "feature")


_PLACES = "places AS (SELECT l_suppkey % 50 AS target, 'f' || l_partkey AS feature, p_brand AS contig, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, (l_orderkey % 90)::INTEGER AS start, (l_orderkey % 90 + 23)::INTEGER AS \"end\" FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _places(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    start = (c("l_orderkey") % 90).cast("int")
    return rows.select((c("l_suppkey") % 50).alias("target"), F.concat(F.lit("f"), c("l_partkey").cast("string")).alias("feature"), c("p_brand").alias("contig"), F.when(c("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + 23).alias("end"))


@query(f"WITH {_PLACES} SELECT target, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features, string_agg(DISTINCT contig, ',' ORDER BY contig) AS contigs FROM places GROUP BY target")
def target_places(spark, d):
    return Fe.places_of(_places(spark, d), "target").select("target", F.array_join("features", ",").alias("features"), F.array_join("contigs", ",").alias("contigs"))


@query(f"WITH {_PLACES} SELECT DISTINCT target FROM places WHERE feature IN ('f7', 'f11')")
def targets_with_features(spark, d):
    return Fe.targets_with_features(_places(spark, d), spark.createDataFrame([("f7",), ("f11",)], "feature string"))


@query(f"WITH {_PLACES}, donors AS (SELECT DISTINCT p_brand AS donor FROM part) SELECT DISTINCT target, donor FROM places JOIN donors ON contig = donor")
def donors_of_targets(spark, d):
    donors = table(spark, d, "part").select(F.col("p_brand").alias("donor"))
    return Fe.donors_of_targets(_places(spark, d), donors)


_DONORS = f"WITH {B.OLIGOS}, {_PLACES}, x AS (SELECT left(seq, 4) AS seq, feature, contig, strand, start || '..' || \"end\" AS segments, right(seq, 1) AS spacer FROM places JOIN oligos ON id = substr(feature, 2)::BIGINT)"


def _donors(spark, d):
    o = B.oligos(spark, d).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("feature"), F.left("seq", F.lit(4)).alias("seq"), F.right("seq", F.lit(1)).alias("spacer"))
    segments = F.concat(F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string")).alias("segments")
    return _places(spark, d).join(o, "feature").select("seq", "feature", "contig", "strand", segments, "spacer")


@query(f"{_DONORS}, one AS (SELECT seq, min((feature, contig, strand, segments)) AS first, string_agg(DISTINCT spacer, '' ORDER BY spacer) AS spacers, count(DISTINCT (feature, contig, strand, segments)) AS n FROM x GROUP BY seq) SELECT 'exDonor-' || (row_number() OVER (ORDER BY first, seq) - 1) AS donor, seq, spacers, n FROM one")
def distinct_donors(spark, d):
    return Fe.distinct_donors(_donors(spark, d)).select("donor", "seq", F.array_join("spacers", "").alias("spacers"), F.size("locations").cast("long").alias("n"))


@query(f"WITH {B.FEATURES}, {_PLACES}, h AS (SELECT feature, 'f' || ((substr(feature, 2)::BIGINT * 7) % 40 + 1) AS homolog FROM features), own AS (SELECT DISTINCT target, feature FROM places), first AS (SELECT target, min(feature) AS feature FROM own GROUP BY target) SELECT target FROM first f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.feature = f.feature AND NOT EXISTS (SELECT 1 FROM own o WHERE o.target = f.target AND o.feature = h.homolog))")
def allele_agnostic_donors(spark, d):
    h = B.features(spark, d).select("feature", F.expr("concat('f', cast((cast(substring(feature, 2) as bigint) * 7) % 40 + 1 as string))").alias("homolog"))
    return Fe.allele_agnostic(_places(spark, d), h, "target")


@query(f"WITH {B.CONTIGS}, {B.OLIGOS}, own AS (SELECT 'd' || p_partkey AS donor, translate(md5(p_partkey::VARCHAR), '{B.HEX}', '{B.DNA}') AS seq FROM part UNION ALL SELECT 'x' || id, seq FROM oligos) SELECT donor, contig, (instr(c.seq, own.seq) - 1)::INTEGER AS start FROM own JOIN contigs c ON contains(c.seq, own.seq)")
def donors_elsewhere(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("donor"), B.letters_of(F.col("p_partkey")).alias("seq"))
    other = B.oligos(spark, d).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("donor"), "seq")
    return Fe.donors_elsewhere(own.unionByName(other), B.contigs(spark, d))


_RC = lambda s: f"reverse(translate({s}, 'ACGT', 'TGCA'))"
_CUT = lambda a, n: f"substr(seq, {a} + 1, {n})"


@query(
    f"""WITH {B.CONTIGS}, {B.HITS}, h AS (SELECT DISTINCT hit, h.contig, start, "end", CASE WHEN hit % 2 = 0 THEN '+' ELSE '-' END AS strand, seq FROM hits h JOIN contigs c USING (contig)),
  s AS (SELECT hit, strand, contig, start, {_CUT('start', '"end" - start')} AS s, CASE WHEN start >= 10 THEN {_CUT('start - 10', '10')} ELSE '' END AS u, {_CUT('"end"', '10')} AS w FROM h)
  SELECT hit, contig, start, CASE strand WHEN '+' THEN s ELSE {_RC('s')} END AS seq, CASE strand WHEN '+' THEN u ELSE {_RC('w')} END AS upstream, CASE strand WHEN '+' THEN w ELSE {_RC('u')} END AS downstream FROM s"""
)
def alignment_slices(spark, d):
    """What stands under each alignment, as read on its strand, with ten letters at each side."""
    h = B.hits(spark, d).select("hit", "contig", "start", "end", F.when(F.col("hit") % 2 == 0, "+").otherwise("-").alias("strand")).distinct()
    return A.slices(h, B.contigs(spark, d), 23).select("hit", "contig", "start", "seq", "upstream", "downstream")


_DIFF = "list_filter(range(1, 21), lambda i: substr(spacer, i, 1) <> substr(off, i, 1))"


@query(f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, len({_DIFF})::INTEGER AS substitutions, round(100 - 100.0::DOUBLE * coalesce(list_sum({_DIFF}), 0) / 210, 6) AS linear, len({_DIFF}) <= 5 AS postfilter FROM guides")
def alignment_postfilter(spark, d):
    """Scores of an alignment against its target, and whether all that filter are in their ranges."""
    g = B.guides(spark, d).select("id", F.col("spacer").alias("target_spacer"), F.col("off").alias("spacer"), "pam", "upstream", "downstream")
    s = A.score_alignments(g)
    return s.select("id", F.col("Substitutions").cast("int").alias("substitutions"), F.round("Linear", 6).alias("linear"), "postfilter")


_SEARCH = "substr(w, 22, 2) IN ('GG', 'AG')"


@query(f"""WITH {B.CONTIGS}, {B.OLIGOS}, sides AS (SELECT contig, '+' AS strand, seq FROM contigs UNION ALL SELECT contig, '-', {_RC('seq')} FROM contigs),
  win AS (SELECT contig, strand, length(seq) AS n, i, substr(seq, i + 1, 23) AS w FROM (SELECT *, unnest(range(0, length(seq) - 22)) AS i FROM sides)),
  t AS (SELECT id AS target, substr(seq, 1, 20) AS spacer FROM oligos)
  SELECT target, contig, strand, (CASE WHEN strand = '+' THEN i ELSE n - i - 23 END)::INTEGER AS start, left(w, 20) AS spacer, right(w, 3) AS pam, hamming(left(w, 20), t.spacer)::INTEGER AS mismatches FROM win JOIN t ON hamming(left(w, 20), t.spacer) <= 6 WHERE {_SEARCH}""")
def offtarget_alignments(spark, d):
    """Places of on-target and off-target motifs near the guides."""
    t = B.oligos(spark, d).select(F.col("id").alias("target"), F.substring("seq", 1, 20).alias("spacer"))
    return A.align_targets(t, B.contigs(spark, d), ["N{20}>NGG", "N{20}>NAG"], 6).select("target", "contig", "strand", "start", "spacer", "pam", "mismatches")


@query(f"WITH {B.OLIGOS}, x AS (SELECT id, left(seq, 23) AS s FROM oligos) SELECT id, CASE WHEN substr(s, 22, 2) = 'GG' THEN left(s, 20) END AS spacer, left(s, 20) AS forced, CASE WHEN substr(s, 22, 2) = 'GG' THEN 'NGG' WHEN substr(s, 22, 2) = 'AG' THEN 'NAG' END AS pam FROM x")
def motif_conformation(spark, d):
    m, two = motif("N{20}>NGG"), motif("N{20}>N(G,A)G")
    s = F.left("seq", F.lit(23))
    pam = F.when(A.which_pam(s, m).isNotNull(), "NGG").when(A.which_pam(s, two).isNotNull(), "NAG")
    return B.oligos(spark, d).select("id", A.split_by_motif(s, m, True)["spacer"].alias("spacer"), A.split_by_motifs(s, [m])["spacer"].alias("forced"), pam.alias("pam"))


_PRIMERS = "pr AS (SELECT 'p' || (l_partkey % 60) AS primer, 'n' || l_linenumber AS name, (l_suppkey % 3)::VARCHAR AS gene, l_orderkey::VARCHAR AS locus, '0' AS genome, l_returnflag AS region, l_linestatus AS contig, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, (l_orderkey % 500)::INTEGER AS start, (l_orderkey % 500 + 20)::INTEGER AS \"end\" FROM lineitem)"


def _primers(spark, d):
    c = F.col
    text = lambda x: x.cast("string")
    start = (c("l_orderkey") % 500).cast("int")
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), text(c("l_partkey") % 60)).alias("primer"), F.concat(F.lit("n"), text(c("l_linenumber"))).alias("name"), text(c("l_suppkey") % 3).alias("gene"), text(c("l_orderkey")).alias("locus"), F.lit("0").alias("genome"), c("l_returnflag").alias("region"), c("l_linestatus").alias("contig"), F.when(c("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + 20).alias("end"))


@query(f"WITH {_PRIMERS} SELECT primer, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT (gene, locus, genome, region, contig, strand, start, \"end\")) AS places, string_agg(DISTINCT locus, ',' ORDER BY locus) AS loci FROM pr GROUP BY primer")
def distinct_primers(spark, d):
    return PS.distinct_primers(_primers(spark, d)).select("primer", F.array_join("names", ",").alias("names"), F.size("locations").cast("long").alias("places"), F.array_join("loci", ",").alias("loci"))


_SIZES = f"""WITH {_PRIMERS}, q AS (SELECT * FROM pr), sizes AS (SELECT f.primer AS forward, r.primer AS "reverse", f.gene, f.locus, f.genome, f.contig, f.region AS region_f, r.region AS region_r,
  CASE WHEN f.strand = '+' THEN r."end" - f.start ELSE f."end" - r.start END AS size FROM q f JOIN q r USING (gene, locus, genome, contig) WHERE f.primer < r.primer AND (f.strand = '+' AND r.strand = '-' AND f.start < r."end" OR f.strand = '-' AND r.strand = '+' AND r.start < f."end"))"""


def _sized(spark, d):
    p = _primers(spark, d)
    names = p.select("primer").distinct()
    pairs = names.select(F.col("primer").alias("forward")).join(names.select(F.col("primer").alias("reverse")), F.col("forward") < F.col("reverse"))  # 60 names
    return pairs, PS.amplicon_sizes(p, pairs)


@query(f'{_SIZES} SELECT forward, "reverse", gene, locus, genome, contig, region_f, region_r, min(size)::INTEGER AS size, count(*) AS n FROM sizes GROUP BY ALL')
def amplicon_lookup(spark, d):
    sizes = materialise(_sized(spark, d)[1], "sizes")
    keys = [c for c in sizes.columns if c != "size"]
    wanted = sizes.groupBy(*keys).agg(F.count("*").alias("n"))
    return PS.size_of(sizes, wanted.drop("n")).join(wanted, keys).select(*keys, "size", "n")


@query(f'{_SIZES} SELECT DISTINCT forward, "reverse" FROM sizes WHERE forward = \'p11\'')
def shared_primer_pairs(spark, d):
    pairs, sizes = _sized(spark, d)
    return PS.filter_pairs(PS.distinct_pairs(pairs, sizes), forward="p11")


_SETS = "sets AS (SELECT l_orderkey AS set_id, (l_linenumber - 1) AS slot, 'f' || (l_partkey % 5) AS forward, CASE WHEN l_suppkey % 4 > 0 THEN 'r' || (l_suppkey % 4) END AS \"reverse\" FROM lineitem)"
_PLACE = "CASE WHEN slot = 0 THEN k WHEN (slot - 1) % 3 = 0 THEN 2 + 4 * ((slot - 1) // 3) WHEN (slot - 1) % 3 = 1 THEN 3 + 4 * ((slot - 1) // 3) ELSE 4 + k + 4 * ((slot - 1) // 3) END"


def _sets(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("set_id"), (c("l_linenumber") - 1).alias("slot"), F.concat(F.lit("f"), (c("l_partkey") % 5).cast("string")).alias("forward"), F.when(c("l_suppkey") % 4 > 0, F.concat(F.lit("r"), (c("l_suppkey") % 4).cast("string"))).alias("reverse"))


@query(f"""WITH {_SETS}, e AS (SELECT *, unnest([0, 1]) AS k FROM sets), x AS (SELECT set_id, ({_PLACE})::INTEGER AS place, 'r' || ((slot - 1) // 3) AS r, slot, k, CASE WHEN slot = 0 AND k = 0 OR slot > 0 AND ((slot - 1) % 3 = 1 OR (slot - 1) % 3 = 2 AND k = 0) THEN forward ELSE "reverse" END AS primer FROM e WHERE slot = 0 OR (slot - 1) % 3 = 2 OR k = 0)
  SELECT set_id, place, CASE WHEN slot = 0 THEN CASE k WHEN 0 THEN 'sF' ELSE 'sR' END WHEN (slot - 1) % 3 = 0 THEN r || '-oR' WHEN (slot - 1) % 3 = 1 THEN r || '-oF' WHEN k = 0 THEN r || '-iF' ELSE r || '-iR' END AS name, primer FROM x""")
def set_primer_list(spark, d):
    return PS.set_primers(_sets(spark, d))


@query(f"""WITH {_SETS} SELECT set_id, slot, CASE WHEN slot = 0 THEN 'A' ELSE 'r' || ((slot - 1) // 3) || '-' || substr('BCD', ((slot - 1) % 3 + 1)::INTEGER, 1) END AS amplicon, CASE WHEN slot = 0 THEN 'sF/sR' WHEN (slot - 1) % 3 = 0 THEN 'sF/r' || ((slot - 1) // 3) || '-oR' WHEN (slot - 1) % 3 = 1 THEN 'r' || ((slot - 1) // 3) || '-oF/sR' ELSE 'r' || ((slot - 1) // 3) || '-iF/r' || ((slot - 1) // 3) || '-iR' END AS ends FROM sets""")
def set_pair_list(spark, d):
    return PS.set_pairs(_sets(spark, d)).select("set_id", "slot", "amplicon", "ends")


@query(f"""WITH {_SETS}, p AS (SELECT set_id, forward AS x FROM sets WHERE slot = 0 OR (slot - 1) % 3 > 0 UNION ALL SELECT set_id, "reverse" FROM sets WHERE slot = 0 OR (slot - 1) % 3 <> 1) SELECT set_id, count(DISTINCT x) AS n FROM p GROUP BY set_id""")
def set_primer_count(spark, d):
    return PS.primer_counts(_sets(spark, d))


@query("""WITH r AS (SELECT l_linenumber AS list, l_partkey % 97 AS f, l_suppkey % 89 AS r FROM lineitem), l AS (SELECT DISTINCT list FROM r), p AS (SELECT a.list AS i, b.list AS j FROM l a, l b WHERE a.list <> b.list)
  SELECT i, j, CASE WHEN i < j THEN (SELECT count(*) FROM (SELECT f FROM r WHERE list = i INTERSECT SELECT f FROM r WHERE list = j)) ELSE (SELECT count(*) FROM (SELECT r FROM r WHERE list = i INTERSECT SELECT r FROM r WHERE list = j)) END AS shared,
  CASE WHEN i < j THEN (SELECT count(*) FROM (SELECT f FROM r WHERE list = i UNION SELECT f FROM r WHERE list = j)) ELSE (SELECT count(*) FROM (SELECT r FROM r WHERE list = i UNION SELECT r FROM r WHERE list = j)) END AS either FROM p""")
def shared_primer_matrix(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("list"), (F.col("l_partkey") % 97).alias("forward"), (F.col("l_suppkey") % 89).alias("reverse"))
    return PS.shared_primers(t)


@query(f"WITH {B.OLIGOS} SELECT id, left(seq, 10) || repeat('·', (id % 7)::INTEGER) || {_RC('right(seq, 10)')} AS text FROM oligos")
def drawn_pairs(spark, d):
    o = B.oligos(spark, d).select("id", F.left("seq", F.lit(10)).alias("forward"), F.right("seq", F.lit(10)).alias("reverse"), F.lit(10).alias("f_end"), (F.col("id") % 7 + 10).cast("int").alias("r_start"))
    return PS.drawn(o).select("id", "text")


_SITES = f"w AS (SELECT contig, i, substr(seq, i + 1, 8) AS s FROM (SELECT contig, seq, unnest(range(0, length(seq) - 7)) AS i FROM contigs))"


@query(f"""WITH {B.CONTIGS}, {_SITES}, a AS (SELECT contig, i FROM w WHERE hamming(s, 'ACGTACCA') <= 1), b AS (SELECT contig, i FROM w WHERE hamming(s, {_RC("'GATTACAG'")}) <= 1)
  SELECT a.contig, a.i::INTEGER AS start, (b.i + 8)::INTEGER AS "end", (b.i + 8 - a.i)::INTEGER AS size FROM a JOIN b USING (contig) WHERE a.i < b.i + 8 AND b.i + 8 - a.i BETWEEN 10 AND 5000""")
def simulated_amplification(spark, d):
    """Products of a pair whose primers may each differ from their sites in one letter."""
    pairs = spark.createDataFrame([("ACGTACCA", "GATTACAG")], "forward string, reverse string")
    return P.simulate_amplification(pairs, B.contigs(spark, d)).select("contig", "start", "end", "size")


@query("SELECT x || y || z AS genotype FROM (SELECT unnest(['a', 'A']) AS x), (SELECT unnest(['b', 'B']) AS y), (SELECT unnest(['c', 'C', 'd']) AS z)")
def genotype_permutations(spark, d):
    return spark.range(1).select(F.explode(W.genotypes(["aA", "bB", "cCd"])).alias("genotype"))


@query("SELECT a.x || b.x AS word FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS x) a, (SELECT unnest(['A', 'C', 'G', 'T']) AS x) b")
def all_words(spark, d):
    return W.sampled_words(spark, 2, 100)


@query("SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'x' WHEN u < 0.75 THEN 'y' ELSE 'z' END AS pick FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS u FROM orders)")
def weighted_choices(spark, d):
    return table(spark, d, "orders").select("o_orderkey", W.weighted_choice((F.col("o_orderkey") % 100).cast("double") / 100.0, ["x", "y", "z"], [2.0, 1.0, 1.0]).alias("pick"))


@query("SELECT i AS k, round(0.5::DOUBLE + i * 0.25::DOUBLE, 2) AS x FROM (SELECT unnest(range(0, 6)) AS i)")
def decimal_ranges(spark, d):
    return spark.createDataFrame([(k, x) for k, x in enumerate(W.decimal_range(0.5, 2.0, 0.25, 2))], "k long, x double")


@query("SELECT a.b || c.b AS pair, round(a.p * c.p, 6) AS p FROM (VALUES ('A', 0.3::DOUBLE), ('C', 0.2), ('G', 0.2), ('T', 0.3)) a(b, p), (VALUES ('A', 0.25::DOUBLE), ('C', 0.25), ('G', 0.3), ('T', 0.2)) c(b, p)")
def pair_probabilities(spark, d):
    found = St.pair_probabilities({"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}, {"A": 0.25, "C": 0.25, "G": 0.3, "T": 0.2})
    return spark.createDataFrame([(a + b, round(p, 6)) for (a, b), p in found.items()], "pair string, p double")


@query("SELECT o_orderkey, round(log10(0.41::DOUBLE * greatest(m - l, 1 / 0.41::DOUBLE) * greatest(1000000 - 10 * l, 1 / 0.41::DOUBLE) * exp(-0.62::DOUBLE * 40)), 6) AS log_e, round(m * 1000, 3) AS space FROM (SELECT o_orderkey, m, ln(0.41::DOUBLE * m * 1000000) / 0.9::DOUBLE AS l FROM (SELECT o_orderkey, (100 + o_orderkey % 50)::DOUBLE AS m FROM orders))")
def estimated_expect(spark, d):
    m = (100 + F.col("o_orderkey") % 50).cast("double")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.log10(St.estimated_expect(F.lit(40.0), m, 0.41, 0.62, 0.9, 1e6, 10)), 6).alias("log_e"), F.round(St.search_space(m, F.lit(1000.0)), 3).alias("space"))


@query("SELECT l_orderkey, l_linenumber, round(1 - exp(-l_tax), 9) AS p, round(0.0::DOUBLE - ln(1 - l_tax), 9) AS e, round(l_quantity * 1000 / 50, 6) AS corrected FROM lineitem")
def expect_conversions(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(St.expect_to_p(F.col("l_tax")), 9).alias("p"), F.round(St.p_to_expect(F.col("l_tax")), 9).alias("e"), F.round(F.col("l_quantity") * 1000 / 50, 6).alias("corrected"))


_ACIDS = " ".join(f"WHEN '{a + b + c}' THEN '{STANDARD_CODE[16 * i + 4 * j + k]}'" for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG"))


@query(f"SELECT 1 AS number, 'A Code' AS name, a.x || b.x || c.x AS codon, CASE a.x || b.x || c.x {_ACIDS} END AS acid, a.x || b.x || c.x = 'ATG' AS start FROM (SELECT unnest(['T', 'C', 'A', 'G']) AS x) a, (SELECT unnest(['T', 'C', 'A', 'G']) AS x) b, (SELECT unnest(['T', 'C', 'A', 'G']) AS x) c")
def codon_table(spark, d):
    """A block of text as the catalogues of genetic codes have it."""
    base = lambda p: "".join("TCAG"[i // 4**p % 4] for i in range(64))
    starts = "".join("M" if base(2)[i] + base(1)[i] + base(0)[i] == "ATG" else "-" for i in range(64))
    text = f"1. A Code (transl_table=1)\n    AAs  = {STANDARD_CODE}\n  Starts = {starts}\n  Base1  = {base(2)}\n  Base2  = {base(1)}\n  Base3  = {base(0)}"
    return R.parse_codes(spark.createDataFrame([(text,)], "value string"))


@query(f"WITH {B.FEATURES} SELECT feature AS name, contig, start, \"end\", strand FROM features WHERE strand = '+'")
def gff_places(spark, d):
    from strandloom.plans.file_queries import _gff_lines

    return R.parse_gff_places(_gff_lines(spark, d), "gene")


@query("SELECT p_brand AS contig, arg_max(p_name, p_partkey) AS seq FROM part GROUP BY p_brand")
def last_duplicate(spark, d):
    return R.last_of_each(table(spark, d, "part").select(F.col("p_brand").alias("contig"), F.col("p_name").alias("seq"), F.col("p_partkey").alias("number")))


@query(f"WITH {B.OLIGOS} SELECT id, '>exTarget-' || id || ' motif=N{{20}}>NGG locations=' || (id % 3) || ' weight=' || (id % 5) || ' pam=' || right(seq, 3) || chr(10) || left(seq, 20) AS record FROM oligos")
def scored_spacer_records(spark, d):
    o = B.oligos(spark, d)
    text = K.scored_spacer_text(F.concat(F.lit("exTarget-"), F.col("id").cast("string")), F.left("seq", F.lit(20)), F.right("seq", F.lit(3)), {"motif": F.lit("N{20}>NGG"), "locations": F.col("id") % 3, "weight": F.col("id") % 5})
    return o.select("id", text.alias("record"))


@query(f"WITH {B.OLIGOS} SELECT id, '>reDonor-' || id || ' spacers=' || (id % 4) || CASE WHEN id % 2 = 0 THEN ' rank=' || id ELSE '' END || ' a:c:+:1..2:AC:5..9 b:c:-:3..4' || chr(10) || seq AS record FROM oligos")
def donor_records(spark, d):
    places = F.array(K.donor_place_text(F.lit("b"), F.lit("c"), F.lit("-"), F.array(F.lit("3..4"))), K.donor_place_text(F.lit("a"), F.lit("c"), F.lit("+"), F.array(F.lit("1..2"), F.lit("AC"), F.lit("5..9"))))
    text = K.donor_text(F.concat(F.lit("reDonor-"), F.col("id").cast("string")), F.col("seq"), F.col("id") % 4, places, {"rank": F.when(F.col("id") % 2 == 0, F.col("id"))})
    return B.oligos(spark, d).select("id", text.alias("record"))


_TARGETS = f"{_PLACES}, t AS (SELECT DISTINCT l_suppkey % 50 AS target FROM lineitem)"
_GENES = "genes AS (SELECT 'f' || p_partkey AS feature, p_type AS gene, 'f' || (p_partkey - p_partkey % 10) AS root FROM part)"


def _reported(spark, d):
    places = _places(spark, d).withColumn("target", F.concat(F.lit("exTarget-"), F.col("target").cast("string")))
    k = F.col("p_partkey")
    genes = table(spark, d, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("feature"), F.col("p_type").alias("gene"), F.concat(F.lit("f"), (k - k % 10).cast("string")).alias("root"))
    n = F.substring_index("target", "-", -1).cast("long")
    targets = places.select("target").distinct().withColumns({"sequence": F.concat(F.lit("S"), n.cast("string")), "weight": (n % 7).cast("double") / 7.0, "CFD": n / 3.0})
    return places, genes, targets, n


@query(f"""WITH {_PLACES}, {_GENES}, p AS (SELECT *, feature || ':' || contig || ':' || strand || ':' || start || '..' || "end" AS text FROM places),
  g AS (SELECT target, string_agg(DISTINCT gene, ',' ORDER BY gene) AS gene, string_agg(DISTINCT root, ',' ORDER BY root) AS features FROM p JOIN genes USING (feature) GROUP BY target),
  s AS (SELECT target, string_agg(text, ',' ORDER BY contig, start, strand, feature, text) AS positions FROM p GROUP BY target)
  SELECT gene, features, (target % 7)::DOUBLE / 7 AS weight, 'exTarget-' || target AS target, 'S' || target AS sequence, round(target / 3.0::DOUBLE, 2) AS "OT:CFD", 'reDonor-' || (target % 3) || CASE WHEN target % 2 = 0 THEN ',reDonor-' || (10 + target % 3) ELSE '' END AS donors, 'None' AS trims, positions, 'None' AS warnings FROM g JOIN s USING (target)""")
def excision_report(spark, d):
    places, genes, targets, n = _reported(spark, d)
    name = lambda x: F.concat(F.lit("reDonor-"), x.cast("string"))
    donors = targets.select("target", F.explode(F.when(n % 2 == 0, F.array(name(n % 3 + 10), name(n % 3))).otherwise(F.array(name(n % 3)))).alias("donor"))
    return reports.target_report(targets, places, genes, donors, off=["CFD"])


@query(f"""WITH {_PLACES}, p AS (SELECT DISTINCT target FROM places) SELECT 'exTarget-' || target AS target, 'exDonor-' || (target % 4) AS donors, (target % 4) || ':AC:0' || CASE WHEN target % 4 = 1 THEN ',' || (target % 4) || ':GT:2' ELSE '' END AS trims, row_number() OVER (ORDER BY (target % 7) DESC, 'exTarget-' || target)::INTEGER AS place FROM p""")
def reversion_report(spark, d):
    """The report of reversion targets with the trims and inserts of their donors, and its order."""
    places, genes, targets, n = _reported(spark, d)
    donors = targets.select("target", F.concat(F.lit("exDonor-"), (n % 4).cast("string")).alias("donor"))
    trims = spark.createDataFrame([(f"exDonor-{i}", i, "AC", 0) for i in range(4)] + [("exDonor-1", 1, "GT", 2)], "donor string, us_trim int, insert string, ds_trim int")
    report = reports.target_report(targets, places, genes, donors, trims)
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.orderBy(F.desc("weight"), "target"))  # at most 50 targets
    return report.select("target", "donors", "trims", place.alias("place"))


@query(f"WITH {_PLACES} SELECT DISTINCT a.target AS target, 'd' || (b.target % 10) AS donor FROM places a JOIN places b ON a.feature = b.feature")
def shared_feature_donors(spark, d):
    p = _places(spark, d).select("target", "feature").distinct()
    return reports.shared_feature_donors(p, p.select(F.concat(F.lit("d"), (F.col("target") % 10).cast("string")).alias("donor"), "feature").distinct())


@query(f"""WITH {B.FEATURES}, f AS (SELECT *, substr(feature, 2)::BIGINT AS k FROM features) SELECT gene, CASE WHEN k % 3 = 0 THEN feature ELSE 'p' || feature END AS parent, feature AS name, contig, start, "end", strand,
  CASE WHEN k % 2 = 0 THEN 't:' || contig || ':' || (start + 5) || '..' || (start + 9) END AS seed_targets, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 AND k % 4 = 0 THEN '1:F:1:T:' || ("end" - start - 9) WHEN k % 2 = 0 THEN '5:T:2:F:' || ("end" - start - 14) ELSE (-start) || ':T:' || (start + 11) || ':F:' || ("end" - start - 14) END AS layout, 'h' AS homologs FROM f""")
def feature_report(spark, d):
    k = F.expr("cast(substring(feature, 2) as bigint)")
    t = k % 2 == 0
    low = k % 4 == 0
    f = B.features(spark, d).withColumns({
        "name": F.col("feature"), "root": F.when(k % 3 == 0, F.col("feature")).otherwise(F.concat(F.lit("p"), "feature")), "homologs": F.array(F.lit("h"), F.col("feature")),
        "t_name": F.when(t, "t"), "t_contig": F.when(t, F.col("contig")), "t_start": F.when(t, F.col("start") + 5), "t_end": F.when(t, F.col("start") + 9),
        "root_start": F.when(low, F.col("start") + 1).otherwise(F.col("start") + 11), "root_end": F.when(low, F.col("start") + 4).otherwise(F.col("start") + 14),
    })
    return reports.feature_report(f)


@query("SELECT k AS gene, '' AS features, '2' AS weight, k AS \"reDonor name\", '' AS exTargets, '' AS \"feature:contig:strand:start..end\", 'ACGT' AS sequence FROM (VALUES ('a'), ('b')) x(k)")
def redonor_report(spark, d):
    rows = spark.createDataFrame([(k, "", 2, k, "", "", "ACGT") for k in "ba"], "gene string, f string, weight int, name string, t string, p string, s string")
    empty = [reports.donor_report(spark, kind) for kind in reports.TITLES]
    assert all(e.columns == reports.TITLES[kind] for e, kind in zip(empty, reports.TITLES, strict=True))
    return reports.donor_report(spark, "reDonor", rows).unionByName(empty[0])


@query(f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, CASE WHEN right(spacer, 3) = right(off, 3) THEN 1 ELSE 0 END AS r3, list_aggregate(flatten([[spacer], ['x']]), 'string_agg', '-') AS flat FROM guides")
def right_match_score(spark, d):
    g = B.guides(spark, d)
    flat = F.array_join(S.flattened(F.array(F.array("spacer"), F.array(F.lit(None).cast("string"), F.lit("x"))), True), "-")
    return g.select("id", S.has_right_match(F.col("spacer"), F.col("off"), 3).alias("r3"), flat.alias("flat"))


@query(f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, 100.0::DOUBLE AS cfd, 100.0::DOUBLE AS crisprater, round(CASE WHEN id % 2 = 0 THEN (id % 30) / 30.0::DOUBLE * 100 ELSE 100 - (id % 30) / 30.0::DOUBLE * 100 END, 6) AS position FROM guides")
def default_scores(spark, d):
    position = scoring.position_percent((F.col("id") % 30).cast("int"), F.lit(0), F.lit(30), F.when(F.col("id") % 2 == 0, "+").otherwise("-"))
    s = A.default_scores(["CFD", "CRISPRater"])
    return B.guides(spark, d).select("id", s["CFD"].alias("cfd"), s["CRISPRater"].alias("crisprater"), F.round(position, 6).alias("position"))


_EDITS = """e AS (SELECT l_orderkey * 10 + l_linenumber AS edit, (l_linenumber - 1)::INTEGER AS round, 'c' || (l_orderkey % 50) AS contig, (l_partkey % 400)::INTEGER AS start, (l_partkey % 400 + 10)::INTEGER AS "end",
  'c' || (l_orderkey % 50) AS after_contig, (l_suppkey % 400)::INTEGER AS after_start, (l_suppkey % 400 + 6)::INTEGER AS after_end, repeat('A', 10) || l_returnflag AS up, 'CCCC' AS down, repeat('A', 10) || l_returnflag AS after_up, 'CCCC' AS after_down
  FROM lineitem)"""


@query(f"""WITH {_EDITS} SELECT a.edit AS a, b.edit AS b FROM e a JOIN e b ON a.after_contig = b.contig AND b.round = a.round + 1 AND a.after_start < b."end" AND b.start < a.after_end
  WHERE 1 - levenshtein(a.after_up, b.up) / 11.0 > 0.95""")
def edit_links(spark, d):
    """Edits of neighbouring rounds at one place whose flanks agree."""
    from strandloom.operators.rounds import links

    c = F.col
    one = table(spark, d, "lineitem")
    contig, start, after = F.concat(F.lit("c"), (c("l_orderkey") % 50).cast("string")), (c("l_partkey") % 400).cast("int"), (c("l_suppkey") % 400).cast("int")
    flank = lambda x: F.concat(F.lit("A" * 10), x)
    e = one.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("edit"), (c("l_linenumber") - 1).cast("int").alias("round"), contig.alias("contig"), start.alias("start"), (start + 10).alias("end"), contig.alias("after_contig"), after.alias("after_start"), (after + 6).alias("after_end"), flank(c("l_returnflag")).alias("up"), F.lit("CCCC").alias("down"), flank(c("l_returnflag")).alias("after_up"), F.lit("CCCC").alias("after_down"))
    return links(e, 0.95, 32)


@query(f"""WITH {B.CONTIGS}, {B.FEATURES}, sides AS (SELECT contig, '+' AS strand, seq FROM contigs UNION ALL SELECT contig, '-', {_RC('seq')} FROM contigs),
  win AS (SELECT contig, strand, length(seq) AS n, i, substr(seq, i + 1, 23) AS w FROM (SELECT *, unnest(range(0, length(seq) - 22)) AS i FROM sides)),
  t AS (SELECT contig, n, (CASE WHEN strand = '+' THEN i ELSE n - i - 23 END)::INTEGER AS ts, (CASE WHEN strand = '+' THEN i ELSE n - i - 23 END)::INTEGER + 23 AS te, left(w, 20) AS spacer FROM win WHERE substr(w, 22, 2) = 'GG'),
  x AS (SELECT feature, f.contig, n, ts, te, spacer, least(start, ts) - 3 AS xs, greatest("end", te) + 3 AS xe FROM t JOIN features f ON f.contig = t.contig AND ts < "end" AND start < te)
  SELECT feature, ts AS t_start, spacer, xs::INTEGER AS x_start, xe::INTEGER AS x_end FROM x WHERE xs >= 0 AND xe <= n AND xe - xs <= 70""")
def expanded_features(spark, d):
    """Features widened to hold each target on them."""
    from strandloom.plans import design

    f = B.features(spark, d).select("feature", "contig", "start", "end", "strand")
    return design.expand_features(f, B.contigs(spark, d), ["N{20}>NGG"], "center_both", 3, 0, 70).select("feature", "t_start", "spacer", "x_start", "x_end")


@query(f"""WITH {B.CONTIGS}, {B.OLIGOS}, sides AS (SELECT seq FROM contigs UNION ALL SELECT {_RC('seq')} FROM contigs), win AS (SELECT substr(seq, i + 1, 23) AS w FROM (SELECT *, unnest(range(0, length(seq) - 22)) AS i FROM sides)),
  s AS (SELECT left(w, 20) AS site FROM win WHERE substr(w, 22, 2) = 'GG'), t AS (SELECT id AS target, left(seq, 20) AS spacer FROM oligos UNION ALL SELECT 1000000000 + row_number() OVER (ORDER BY site), site FROM (SELECT DISTINCT site FROM s)),
  m AS (SELECT target, hamming(site, spacer) AS h FROM s JOIN t ON hamming(site, spacer) <= 4)
  SELECT spacer, count(*) FILTER (h = 0) AS places, count(*) FILTER (h > 0) AS near, round((20 - length(translate(spacer, 'GC', ''))) * 5.0::DOUBLE, 6) AS gc FROM t LEFT JOIN m USING (target) GROUP BY target, spacer""")
def evaluated_spacers(spark, d):
    """How often each spacer stands in the contigs, and how many places are near."""
    from strandloom.operators.target_finder import find_targets
    from strandloom.plans import design

    found = materialise(find_targets(B.contigs(spark, d), ["N{20}>NGG"]).select("contig", "strand", "start", "end", "spacer"), "targets")
    sites = found.select("spacer").distinct().select(F.concat(F.lit("s"), "spacer").alias("target"), "spacer")
    own = B.oligos(spark, d).select(F.col("id").cast("string").alias("target"), F.left("seq", F.lit(20)).alias("spacer"))
    return design.evaluate_spacers(own.unionByName(sites), B.contigs(spark, d), ["N{20}>NGG"], 4, found=found).select("spacer", "places", "near", F.round("gc", 6).alias("gc"))


@query("SELECT l_orderkey, l_linenumber, 5 * (l_linenumber % 2)::INTEGER AS q_start, (5 * (l_linenumber % 2) + 10 + l_linenumber + 4)::INTEGER AS q_end, repeat('M', (10 + l_linenumber)::INTEGER) || 'DD' || 'IIII' AS steps FROM lineitem")
def cigar_spans(spark, d):
    """The stretch of the query that an alignment covers, and its steps one by one."""
    from strandloom.functions import cigar as C

    n = F.col("l_linenumber")
    body = F.concat((n + 10).cast("string"), F.lit("M2D4I"))
    whole = F.concat(F.when(n % 2 == 1, "5H").otherwise(""), body)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.query_span(whole)["start"].alias("q_start"), C.query_span(whole)["end"].alias("q_end"), C.expand(body).alias("steps"))


@query("SELECT p_partkey, 's' || p_partkey AS pattern, p_brand AS contig, (p_partkey % 90)::INTEGER AS start, p_type AS site, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_size AS mismatches FROM part")
def site_rows(spark, d):
    p = table(spark, d, "part")
    text = lambda c: c.cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("s"), text(F.col("p_partkey"))), "p_brand", text(F.col("p_partkey") % 90), "p_type", F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"), text(F.col("p_size")))
    rows = R.parse_sites(p.select(line.alias("value")))
    return rows.select(F.substring("pattern", 2, 20).cast("long").alias("p_partkey"), "*")


@query("SELECT 'g' || (p_partkey % 30) AS gene, 'f' || p_partkey AS feature FROM part UNION ALL SELECT 'g' || (p_partkey % 30), 'x' || p_partkey FROM part WHERE p_size % 2 = 0")
def homolog_rows(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    line = F.concat_ws("\t", F.concat(F.lit("g"), (k % 30).cast("string")), F.concat(F.lit("f"), k.cast("string")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x"), k.cast("string"))))
    return R.parse_homologs(p.select(line.alias("value")))


@query("SELECT l_orderkey, count(*) AS r, round(exp(-1.001::DOUBLE) * pow(1.001::DOUBLE, factorial((count(*) - 1)::INTEGER)::DOUBLE) / (factorial(count(*)::INTEGER)::DOUBLE * factorial((count(*) - 1)::INTEGER)::DOUBLE), 9) AS p FROM lineitem GROUP BY l_orderkey")
def pairwise_sums(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("r"))
    return g.select("l_orderkey", "r", F.round(St.pairwise_sum_p(F.lit(1.001), F.col("r").cast("int")), 9).alias("p"))


@query("SELECT name, least, most FROM (VALUES " + ", ".join(f"('{s.name}', {float(s.least)!r}::DOUBLE, {float(s.most)!r}::DOUBLE)" for s in scoring.REGISTRY) + ") x(name, least, most)")
def registered_scores(spark, d):
    from strandloom.plans import api

    return api.list_algorithms(spark).select("name", "least", "most")


_SIDES = f"up AS (SELECT p_brand AS grp, translate(md5('u' || p_partkey % 3 || p_brand), '{B.HEX}', 'AAAAAAAAAAAAACG-') AS s FROM part), down AS (SELECT p_brand AS grp, translate(md5('w' || p_partkey % 3 || p_brand), '{B.HEX}', 'AAAAAAAAAAAAACG-') AS s FROM part)"
_SIDE = lambda t: f"{t}c AS (SELECT grp, i, count(DISTINCT nt) FILTER (nt <> '-') > 1 AS mm, count(*) FILTER (nt = '-') > 0 AS gap FROM (SELECT grp, i, substr(s, i, 1) AS nt FROM {t}, (SELECT unnest(range(1, 33)) AS i)) GROUP BY grp, i), {t}w AS (SELECT grp, i, sum(mm::INTEGER) OVER x AS m, sum(gap::INTEGER) OVER x AS g, count(*) OVER x AS n FROM {t}c WINDOW x AS (PARTITION BY grp ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))"


@query(f"WITH {_SIDES}, {_SIDE('up')}, {_SIDE('down')}, a AS (SELECT grp, 32 - max(i) - 4 + 1 AS up_end FROM upw WHERE n = 4 AND m <= 2 AND g <= 1 AND m + g <= 2 GROUP BY grp), b AS (SELECT grp, min(i) - 1 AS down_start FROM downw WHERE n = 4 AND m <= 2 AND g <= 1 AND m + g <= 2 GROUP BY grp) SELECT grp, up_end, down_start FROM (SELECT DISTINCT p_brand AS grp FROM part) LEFT JOIN a USING (grp) LEFT JOIN b USING (grp)")
def homologous_regions(spark, d):
    """The nearest stretches at both sides that homologs share well enough."""
    from strandloom.operators import msa

    k = F.col("p_partkey") % 3
    side = lambda mark: table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.translate(F.md5(F.concat(F.lit(mark), k.cast("string"), "p_brand")), B.HEX, "AAAAAAAAAAAAACG-").alias("s"))
    return msa.homologous_region(side("u"), side("w"), 4, 2, 1, 2)


@query(f"""WITH {B.CONTIGS}, sides AS (SELECT contig, '+' AS strand, seq FROM contigs UNION ALL SELECT contig, '-', {_RC('seq')} FROM contigs),
  win AS (SELECT contig, strand, length(seq) AS n, i, substr(seq, i + 1, 23) AS w FROM (SELECT *, unnest(range(0, length(seq) - 22)) AS i FROM sides))
  SELECT contig, strand, (CASE WHEN strand = '+' THEN i ELSE n - i - 23 END)::BIGINT AS start, left(w, 20) AS spacer FROM win WHERE substr(w, 22, 2) = 'GG'""")
def targets_from_files(spark, d):
    """Contigs written as FASTA files, and their targets found chunk by chunk from the files' lines."""
    from strandloom.session import scratch_path
    from strandloom.sources.long_contigs import find_targets_in_files

    c = B.contigs(spark, d).withColumn("contig", F.replace("contig", F.lit("#"), F.lit("_")))
    path = scratch_path(spark, "fasta")
    K.write_text(c, K.fasta_text(F.col("contig"), F.col("seq"), None, 60), path)
    found = find_targets_in_files(spark, path, ["N{20}>NGG"])
    return found.select(F.replace("contig", F.lit("_"), F.lit("#")).alias("contig"), "strand", F.col("start").cast("long").alias("start"), "spacer")


def _stack_sql(k: int) -> str:
    from strandloom.functions.thermodynamics import STACKS

    both = STACKS | {x.translate(str.maketrans("ACGT", "TGCA"))[::-1]: v for x, v in STACKS.items()}
    return "CASE two " + " ".join(f"WHEN '{x}' THEN {v[k]!r}" for x, v in sorted(both.items())) + " END::DOUBLE"


_END = lambda k: f"(CASE WHEN left(s, 1) IN ('G', 'C') THEN {(0.1, -2.8)[k]} ELSE {(2.3, 4.1)[k]} END::DOUBLE + CASE WHEN right(s, 1) IN ('G', 'C') THEN {(0.1, -2.8)[k]} ELSE {(2.3, 4.1)[k]} END::DOUBLE)"


@query(f"""WITH {B.OLIGOS}, o AS (SELECT id, left(seq, (15 + id % 18)::INTEGER) AS s FROM oligos), t AS (SELECT id, s, substr(s, i, 2) AS two FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM o)),
  e AS (SELECT id, s, sum({_stack_sql(0)}) + {_END(0)} AS dh, sum({_stack_sql(1)}) + {_END(1)} AS ds FROM t GROUP BY id, s),
  p AS (SELECT id, s, s = {_RC('s')} AS own, dh, ds FROM e), q AS (SELECT id, dh, ds + CASE WHEN own THEN -1.4 ELSE 0 END::DOUBLE + 0.368::DOUBLE * (length(s) - 1) * ln(0.05::DOUBLE) AS ds, own FROM p)
  SELECT id, round(dh, 6) AS dh, round(ds, 6) AS ds, round(dh - 298.15::DOUBLE * ds / 1000, 6) AS dg, round(1000 * dh / (ds + 1.987::DOUBLE * ln(2.5e-7::DOUBLE / CASE WHEN own THEN 1 ELSE 4 END)) - 273.15::DOUBLE, 6) AS tm FROM q""")
def duplex_thermodynamics(spark, d):
    """Enthalpy, entropy, free energy and melting temperature of oligos with their complements, by neighbouring pairs."""
    from strandloom.functions.thermodynamics import duplex

    o = B.oligos(spark, d).select("id", F.expr("left(seq, cast(15 + id % 18 as int))").alias("s")).select("id", duplex(F.col("s")).alias("x"))
    return o.select("id", *(F.round(f"x.{c}", 6).alias(c) for c in ("dh", "ds", "dg", "tm")))


@query("SELECT l_orderkey, round(product((1 / (1 + pow(1.03::DOUBLE, 300 - l_quantity * 20))) * (1 / (1 + pow(1.03::DOUBLE, l_quantity * 20 - 700)))), 9) AS weight FROM lineitem GROUP BY l_orderkey")
def size_weight_products(spark, d):
    """The product of a group's size weights."""
    w = St.logistic_updown(F.col("l_quantity") * 20, 1.03, 300, 1.03, 700)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.product(w), 9).alias("weight"))


@query(f"WITH {B.OLIGOS} SELECT id, seq AS donor, list_aggregate(list_transform(range(1, 32), lambda i: left(seq, i) || '|' || substr(seq, i + 1)), 'string_agg', ';') AS cuts FROM oligos")
def donor_splits_from_one(spark, d):
    """All cuts of a donor with a letter at least at both sides."""
    from strandloom.operators import donors as D

    cuts = F.array_join(F.transform(D.splits(F.col("seq"), 1), lambda x: F.concat(x["left"], F.lit("|"), x["right"])), ";")
    return B.oligos(spark, d).select("id", F.col("seq").alias("donor"), cuts.alias("cuts"))


@query("SELECT k, a, b FROM (VALUES (0, 0.0::DOUBLE, 10.0::DOUBLE), (1, 1.0, 10.0), (2, 1.0, 8.0), (3, 2.0, 8.0), (4, 2.0, 6.0), (5, 3.0, 6.0), (6, 3.0, 4.0)) x(k, a, b)")
def cutoff_schedule(spark, d):
    """Cutoffs cycle by cycle, one parameter at a time."""
    from strandloom.operators.designs import schedule

    rows = schedule({"a": 0.0, "b": 10.0}, {"a": 3.0, "b": 4.0}, {"a": 1.0, "b": 2.0})
    return spark.createDataFrame([(k, r["a"], r["b"]) for k, r in enumerate(rows)], "k int, a double, b double")


_G_SCORE = lambda i: f"CASE substr(pam, {i}, 1) WHEN 'G' THEN 1.0 WHEN 'A' THEN -1.0 ELSE -1.2 END::DOUBLE"


@query(f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, round((-0.6::DOUBLE + {_G_SCORE(2)} + {_G_SCORE(3)} + 3.0::DOUBLE) / 4.4::DOUBLE * 100, 6) AS identity FROM guides")
def pam_identity_score(spark, d):
    """How near a PAM is to NGG, between the worst and the best score that three letters can have; gaps cost more than any of them."""
    from strandloom.functions.alignment import pam_identity

    return B.guides(spark, d).select("id", F.round(pam_identity(["NGG"])("pam"), 6).alias("identity"))


@query(f"WITH {B.OLIGOS} SELECT 's' || id AS name, seq FROM oligos")
def clustal_rows(spark, d):
    """Rows of an alignment in two blocks of lines, joined in order."""
    block = lambda k, part: B.oligos(spark, d).select((F.col("id") + k * 10_000_000).alias("number"), F.concat(F.lit("s"), F.col("id").cast("string"), F.lit("   "), part).alias("value"))
    head = spark.createDataFrame([(-1, "CLUSTAL W (1.8)"), (9_999_999, ""), (9_999_998, "     ** *")], "number long, value string")
    return R.parse_clustal(head.unionByName(block(0, F.left("seq", F.lit(16)))).unionByName(block(1, F.right("seq", F.lit(16)))))


@query(f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, CASE WHEN id % 2 = 0 THEN spacer || '>' || pam ELSE pam || '<' || spacer END AS target FROM guides")
def target_texts(spark, d):
    return B.guides(spark, d).select("id", K.target_text(F.col("spacer"), F.col("pam"), F.when(F.col("id") % 2 == 0, ">").otherwise("<")).alias("target"))


@query(f"SELECT p_partkey, reverse(translate(p_name || ' ' || p_type, '{S.UPRIGHT}', '{S.TURNED}')) AS turned FROM part")
def turned_text(spark, d):
    return table(spark, d, "part").select("p_partkey", S.upside_down(F.concat_ws(" ", "p_name", "p_type")).alias("turned"))


@query("SELECT motif, spacer, sense, antisense FROM (VALUES ('N{2}|N{3}>NGG', 'NNNNN', '2', '2'), ('TTN<N{4}/.{2}\\', 'NNNN..', '4', '6')) x(motif, spacer, sense, antisense)")
def motif_cuts(spark, d):
    """Where motifs cut their spacers, on both strands."""
    rows = []
    for text in ("N{2}|N{3}>NGG", "TTN<N{4}/.{2}\\"):
        m = motif(text)
        sense, antisense = m.spacer_cuts[0]
        rows.append((text, m.spacers[0], ",".join(map(str, sense)), ",".join(map(str, antisense))))
    return spark.createDataFrame(rows, "motif string, spacer string, sense string, antisense string")
