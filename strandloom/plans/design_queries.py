"""Queries for targets, off-targets, donors, features and primers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import sequence as S
from strandloom.functions.scoring import linear, registered_weight
from strandloom.operators import donors as D
from strandloom.operators import features as Fe
from strandloom.operators import msa
from strandloom.operators import offtarget as O
from strandloom.operators import primer_sets as PS
from strandloom.operators import primers as P
from strandloom.operators.components import connected_components
from strandloom.operators.interval_join import interval_join, overlap
from strandloom.operators.recombination import flank_pairs, whole_hits
from strandloom.operators.target_finder import distinct_targets, find_targets, number_rows
from strandloom.operators.windows import near
from strandloom.plans import api
from strandloom.plans import bridge as B
from strandloom.plans.registry import query, table
from strandloom.session import materialise

CAS9, CPF1, FLEXIBLE = "N{17}|N{3}>NGG", "TTTN<N{19}/.{4}\\", "N{17,20}>NGG"


def _search_sql(length: int, test: str, spacer: str, pam: str) -> str:
    """Targets of a fixed length on both strands; w is the window."""
    return f"""
  sides AS (SELECT contig, '+' AS strand, seq, seq AS fwd FROM contigs UNION ALL SELECT contig, '-', reverse(translate(seq, 'ACGT', 'TGCA')), seq FROM contigs),
  win AS (SELECT contig, strand, fwd, length(fwd) AS n, i, substr(seq, i + 1, {length}) AS w FROM (SELECT *, unnest(range(0, length(seq) - {length - 1})) AS i FROM sides)),
  found AS (SELECT contig, strand, fwd, (CASE WHEN strand = '+' THEN i ELSE n - i - {length} END)::INTEGER AS start, w FROM win WHERE {test}),
  targets AS (SELECT contig, strand, start, start + {length} AS "end", w AS seq, {spacer} AS spacer, {pam} AS pam,
    CASE WHEN strand = '+' THEN CASE WHEN start >= 10 THEN substr(fwd, start - 9, 10) ELSE '' END ELSE reverse(translate(substr(fwd, start + {length} + 1, 10), 'ACGT', 'TGCA')) END AS upstream,
    CASE WHEN strand = '+' THEN substr(fwd, start + {length} + 1, 10) WHEN start >= 10 THEN reverse(translate(substr(fwd, start - 9, 10), 'ACGT', 'TGCA')) ELSE '' END AS downstream FROM found)"""


_CAS9_TEST = "substr(w, 22, 2) = 'GG'"
_CAS9_SQL = f"WITH {B.CONTIGS}, {_search_sql(23, _CAS9_TEST, 'left(w, 20)', 'right(w, 3)')}"
_TARGET_COLUMNS = ["contig", "strand", "start", "end", "seq", "spacer", "pam", "upstream", "downstream"]
_TARGET_SQL = 'contig, strand, start, "end", seq, spacer, pam, upstream, downstream'


def _targets(spark, d, motif: str = CAS9):
    return find_targets(B.contigs(spark, d), [motif]).select(*_TARGET_COLUMNS)


@query(f"{_CAS9_SQL} SELECT {_TARGET_SQL} FROM targets")
def motif_search_both_strands(spark, d):
    return _targets(spark, d)


@query(f"WITH {B.CONTIGS}, {_search_sql(27, 'left(w, 3) = ' + repr('TTT'), 'substr(w, 5)', 'left(w, 4)')} SELECT {_TARGET_SQL} FROM targets")
def motif_search_5prime_pam(spark, d):
    return _targets(spark, d, CPF1)


@query(f"""WITH {B.CONTIGS}, w AS (SELECT contig, i, substr(seq, i + 1, 23) AS w FROM (SELECT contig, seq, unnest(range(0, length(seq) - 19)) AS i FROM contigs)),
  k AS (SELECT contig, i, CASE WHEN substr(w, 19, 2) = 'GG' THEN 17 WHEN substr(w, 20, 2) = 'GG' THEN 18 WHEN substr(w, 21, 2) = 'GG' THEN 19 WHEN substr(w, 22, 2) = 'GG' THEN 20 END AS n, w FROM w)
  SELECT contig, i::INTEGER AS start, (i + n + 3)::INTEGER AS "end", left(w, n) AS spacer, substr(w, n + 1, 3) AS pam FROM k WHERE n IS NOT NULL""")
def motif_search_variable(spark, d):
    return find_targets(B.contigs(spark, d), [FLEXIBLE]).where("strand = '+'").select("contig", "start", "end", "spacer", "pam")


@query(f"""{_CAS9_SQL}, one AS (SELECT seq, min((contig, start, strand)) AS first, count(*) AS locations, min(spacer) AS spacer FROM targets GROUP BY seq)
  SELECT 'Target-' || (row_number() OVER (ORDER BY first) - 1) AS name, seq, spacer, locations FROM one""")
def target_dedupe(spark, d):
    return distinct_targets(_targets(spark, d)).select("name", "seq", "spacer", "locations")


_GC = "(20 - length(translate(spacer, 'GC', ''))) * 5.0::DOUBLE"


@query(f"{_CAS9_SQL} SELECT contig, strand, start, {_GC} AS gc FROM targets WHERE {_GC} BETWEEN 25 AND 75 AND NOT contains(spacer, 'TTTTT')")
def target_prefilter(spark, d):
    t = _targets(spark, d).withColumn("gc", S.gc_percent(F.col("spacer")))
    return t.where(F.col("gc").between(25, 75) & (S.longest_run(F.col("spacer"), "T") <= 4.5)).select("contig", "strand", "start", "gc")


@query(f"""{_CAS9_SQL}, t AS (SELECT DISTINCT spacer FROM targets)
  SELECT a.spacer AS guide, b.spacer AS site, hamming(a.spacer, b.spacer)::INTEGER AS mismatches FROM t a, t b WHERE hamming(a.spacer, b.spacer) <= 5""")
def offtarget_seed_join(spark, d):
    t = _targets(spark, d).select("spacer")
    return O.near_spacers(t, t, 5, 20)


_TOP_SQL = f"""{_CAS9_SQL}, kept AS (SELECT contig, spacer, count(*) AS locations FROM targets WHERE {_GC} BETWEEN 25 AND 75 AND NOT contains(spacer, 'TTTTT') GROUP BY contig, spacer),
  p AS (SELECT a.contig, a.spacer, a.locations, b.spacer AS other, 100 - 100.0::DOUBLE * coalesce(list_sum(list_filter(range(1, 21), lambda i: substr(a.spacer, i, 1) <> substr(b.spacer, i, 1))), 0) / 210 AS s,
    len(list_filter(range(1, 21), lambda i: substr(a.spacer, i, 1) <> substr(b.spacer, i, 1))) AS mm FROM kept a JOIN kept b ON a.contig = b.contig),
  g AS (SELECT contig, spacer, min(locations) AS locations, 100 * coalesce(sum(s) FILTER (mm = 0), 0) / sum(s) AS score FROM p WHERE mm <= 4 GROUP BY contig, spacer),
  w AS (SELECT *, round(score, 6) AS guide, round(1 / (1 + pow(1.8::DOUBLE, 90 - score)), 6) AS weight FROM g)
  SELECT contig, spacer, locations, guide, weight, row_number() OVER (ORDER BY weight DESC, contig, spacer)::INTEGER AS rank FROM w QUALIFY rank <= 20"""


@query(_TOP_SQL)
def top_targets(spark, d):
    """The 20 best targets: search, filters, off-targets of each contig, guide score, weight."""
    t = _targets(spark, d).where(S.gc_percent(F.col("spacer")).between(25, 75) & ~F.contains("spacer", F.lit("TTTTT")))
    kept = materialise(t.groupBy("contig", "spacer").agg(F.count("*").alias("locations")), "kept")
    near = O.near_spacers(kept, kept, 4, 20, by=("contig",))
    near = near.withColumn("s", F.when(F.col("mismatches") == 0, 100.0).otherwise(linear(F.col("guide"), F.col("site"))))
    on, off = F.sum(F.when(F.col("mismatches") == 0, F.col("s"))), F.sum(F.when(F.col("mismatches") > 0, F.col("s")))
    g = near.groupBy("contig", F.col("guide").alias("spacer")).agg(O.guide_score(F.coalesce(on, F.lit(0.0)), F.coalesce(off, F.lit(0.0))).alias("score"))
    w = g.withColumns({"guide": F.round("score", 6), "weight": F.round(registered_weight("Hsu-Zhang", F.col("score")), 6)}).join(kept, ["contig", "spacer"])
    best = w.orderBy(F.desc("weight"), "contig", "spacer").limit(20)
    rank = F.row_number().over(Window.orderBy(F.desc("weight"), "contig", "spacer")).alias("rank")
    return best.select("contig", "spacer", "locations", "guide", "weight", rank)


@query(f"WITH {B.CONTIGS}, {B.FEATURES}, {B.HITS} SELECT hit, feature, (least(h.\"end\", f.\"end\") - greatest(h.start, f.start))::INTEGER AS overlap FROM hits h JOIN features f ON h.contig = f.contig AND h.start < f.\"end\" AND f.start < h.\"end\"")
def interval_overlap_join(spark, d):
    return interval_join(B.hits(spark, d), B.features(spark, d), 64).select(F.col("l_hit").alias("hit"), F.col("r_feature").alias("feature"), "overlap")


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(b, dd) - greatest(a, c))::INTEGER AS half_open, greatest(0, least(b, dd) - greatest(a, c) + 1)::INTEGER AS closed FROM (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS a, l_partkey % 50 + l_quantity AS b, l_suppkey % 50 AS c, l_suppkey % 50 + l_linenumber AS dd FROM lineitem)")
def interval_overlap_coverage(spark, d):
    a, c = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    args = (a, a + F.col("l_quantity"), c, c + F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", overlap(*args).cast("int").alias("half_open"), overlap(*args, base=1).cast("int").alias("closed"))


@query(f"""WITH {B.CONTIGS}, {B.FEATURES}, {B.HITS}, j AS (SELECT DISTINCT h.hit, h.target, h.score, f.gene FROM hits h LEFT JOIN features f ON h.contig = f.contig AND h.start < f."end" AND f.start < h."end"),
  a AS (SELECT hit, min(target) AS target, min(score) AS score, max(CASE WHEN length(gene) % 2 = target % 2 THEN 1 ELSE 0 END) AS related FROM j GROUP BY hit)
  SELECT hit, CASE WHEN target % 2 = 0 THEN CASE WHEN hit % 3 = 0 THEN CASE WHEN related = 1 THEN 'off' ELSE 'skip' END WHEN related = 1 THEN 'on' ELSE 'off' END
    ELSE CASE WHEN hit % 3 = 0 THEN CASE WHEN related = 1 THEN 'on' ELSE 'skip' END ELSE 'off' END END AS action FROM a""")
def offtarget_classify(spark, d):
    hits, f = B.hits(spark, d), B.features(spark, d)
    met = interval_join(hits, f.select("contig", "start", "end", "gene"), 64)
    related = met.groupBy(F.col("l_hit").alias("hit")).agg(F.max(F.length("r_gene") % 2 == F.col("l_target") % 2).alias("related"))
    one = hits.groupBy("hit").agg(F.min("target").alias("target"))  # some order lines repeat
    rows = one.join(related, "hit", "left").withColumn("related", F.coalesce("related", F.lit(False)))
    kind, where = F.when(F.col("target") % 2 == 0, "excision").otherwise("reversion"), F.when(F.col("hit") % 3 == 0, "exdonor").otherwise("genome")
    return rows.select("hit", O.classify(kind, where, F.col("related"), F.col("related")).alias("action"))


@query(f"""WITH {B.CONTIGS}, {B.HITS} SELECT target, round(100 * sum(CASE WHEN hit % 2 = 0 THEN w END) / sum(w), 6) AS guide FROM
  (SELECT *, score * CASE WHEN hit % 5 = 0 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM hits WHERE score BETWEEN 10 AND 90) GROUP BY target""")
def guide_score(spark, d):
    h = B.hits(spark, d).where(F.col("score").between(10, 90))
    on, donor = F.col("hit") % 2 == 0, F.col("hit") % 5 == 0
    sums = h.groupBy("target").agg(O.weighted_sum(F.col("score"), on, donor, 1000.0).alias("on"), O.weighted_sum(F.col("score"), ~on, donor, 1000.0).alias("off"))
    return sums.select("target", F.round(O.guide_score(F.col("on"), F.col("off")), 6).alias("guide"))


_HOMOLOGS = "edges AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem)"


@query(f"""WITH RECURSIVE {_HOMOLOGS}, sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), nodes AS (SELECT DISTINCT a AS node FROM sides),
  reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT b, root FROM reach JOIN sides ON a = node WHERE root < b)
  SELECT node, min(root) AS component FROM reach GROUP BY node""")
def homolog_components(spark, d):
    line = table(spark, d, "lineitem")
    return connected_components(line.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")))


@query(f"""WITH {B.CONTIGS}, {B.FEATURES}, {B.HITS}, j AS (SELECT DISTINCT h.target, f.contig AS grp, f.gene FROM hits h JOIN features f ON h.contig = f.contig AND h.start < f."end" AND f.start < h."end"),
  g AS (SELECT contig AS grp, count(DISTINCT gene) AS size FROM features GROUP BY contig)
  SELECT target, grp, count(DISTINCT gene) AS covered FROM j JOIN g USING (grp) GROUP BY target, grp, size HAVING count(DISTINCT gene) * 4 >= size""")
def homolog_complete_targets(spark, d):
    """Targets that reach enough of a group (relational division; a quarter, as whole groups are large here)."""
    f = B.features(spark, d)
    reached = interval_join(B.hits(spark, d), f, 64).select(F.col("l_target").alias("target"), F.col("r_contig").alias("grp"), F.col("r_gene").alias("member"))
    return Fe.covered_groups(reached, f.select(F.col("contig").alias("grp"), F.col("gene").alias("member")), 0.25)


@query(f"""WITH {B.CONTIGS}, {B.FEATURES}, {B.HITS} SELECT hit, min(feature) AS feature FROM hits h JOIN features f ON h.contig = f.contig AND h.start < f."end" AND f.start < h."end" GROUP BY hit HAVING count(DISTINCT feature) = 1""")
def allele_specific_targets(spark, d):
    j = interval_join(B.hits(spark, d), B.features(spark, d), 64)
    return Fe.on_one_feature(j.select(F.col("l_hit").alias("hit"), F.col("r_feature").alias("feature")), "hit")


@query("SELECT o_orderkey, weight, row_number() OVER (PARTITION BY o_orderpriority ORDER BY weight DESC, o_orderkey)::INTEGER AS rank FROM (SELECT o_orderkey, o_orderpriority, round(1 / (1 + pow(1.22::DOUBLE, 66 - o_totalprice % 100)) * (1 / (1 + pow(1.2::DOUBLE, 40 - o_totalprice % 90))), 6) AS weight FROM orders)")
def rank_targets(spark, d):
    x = F.col("o_totalprice")
    w = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.round(registered_weight("CRISPRater", x % 100) * registered_weight("CFD", x % 90), 6).alias("weight"))
    return w.select("o_orderkey", "weight", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("weight"), "o_orderkey")).alias("rank"))


@query("SELECT p_brand, p_partkey, k::INTEGER AS k FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 5")
def topk_per_group(spark, d):
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, d, "part").withColumn("k", k).where("k <= 5").select("p_brand", "p_partkey", "k")


@query(f"WITH {B.FEATURES}, g AS (SELECT gene, min(length(feature) + \"end\" - start) AS gap FROM features GROUP BY gene) SELECT gene, gap, row_number() OVER (ORDER BY gap, gene)::INTEGER AS rank FROM g")
def rank_donors(spark, d):
    g = B.features(spark, d).groupBy("gene").agg(F.min(D.gap_rank(F.col("start"), F.col("end"), F.col("feature"))).cast("long").alias("gap"))
    return number_rows(g, ["gap", "gene"], "i").select("gene", "gap", (F.col("i") + 1).cast("int").alias("rank"))


def _featured(spark, d, before, after):
    """Features moved to the letters around them."""
    return near(B.features(spark, d), B.contigs(spark, d), before, after)


_SEQD = f"WITH {B.CONTIGS}, {B.FEATURES}, x AS (SELECT f.*, seq FROM features f JOIN contigs c ON c.contig = f.contig)"
_CUT = lambda s, e: f"substr(seq, greatest({s}, 0) + 1, greatest(({e}) - greatest({s}, 0), 0))"


@query(f"""{_SEQD}, y AS (SELECT *, 'ACGTTGCAAGG' AS tag FROM x) SELECT feature, start - (50 - 6) AS us_start, "end" + (50 - 5) AS ds_end, {_CUT('start - 44', 'start')} || tag || {_CUT('"end"', '"end" + 45')} AS donor FROM y""")
def bartag_donors(spark, d):
    out = D.centred(_featured(spark, d, 50, 50), F.lit("ACGTTGCAAGG"), 100)
    return out.select("feature", (F.col("us_start") + F.col("base")).alias("us_start"), (F.col("ds_end") + F.col("base")).alias("ds_end"), "donor")


_UNITAG = "ACGATCGATCGATTACGATCTGG"


@query(f"""{_SEQD} SELECT feature, {_CUT('start - 38', 'start')} || '{_UNITAG}' || {_CUT('"end"', '"end" + 39')} AS donor, length({_CUT('start - 38', 'start')})::INTEGER AS tag_start, '+' AS strand FROM x""")
def unitag_donors(spark, d):
    """Donors whose tag is itself a whole target, at its place and on the plus strand."""
    out = D.centred(_featured(spark, d, 50, 50), F.lit(_UNITAG), 100).withColumn("up_n", F.length(D.part(F.col("seq"), F.col("us_start"), F.col("start"))))
    met = D.spanned(out.select("feature", "donor", "up_n", F.lit(_UNITAG).alias("tag")), CAS9)
    return met.select("feature", "donor", F.col("up_n").alias("tag_start"), F.col("t_strand").alias("strand"))


@query(f"""{_SEQD}, ins AS (SELECT '' AS insert UNION ALL SELECT unnest(['A', 'C', 'G', 'T'])), z AS (SELECT * FROM x),
  y AS (SELECT feature, insert, {_CUT('start - 24', 'start')} || insert || {_CUT('"end"', '"end" + 24')} AS donor, length({_CUT('start - 24', 'start')}) AS up_n FROM z, ins),
  b AS (SELECT *, '+' AS t_strand, donor AS s FROM y UNION ALL SELECT *, '-', reverse(translate(donor, 'ACGT', 'TGCA')) FROM y),
  w AS (SELECT feature, insert, donor, up_n, t_strand, length(donor) AS n, i, substr(s, i + 1, 23) AS w FROM (SELECT *, unnest(range(0, length(s) - 22)) AS i FROM b)),
  t AS (SELECT *, CASE WHEN t_strand = '+' THEN i ELSE n - i - 23 END AS t0 FROM w WHERE substr(w, 22, 2) = 'GG')
  SELECT feature, insert, donor, t_strand, t0::INTEGER AS t_start, left(w, 20) AS spacer FROM t WHERE NOT (t0 + 23 < up_n OR t0 >= up_n + length(insert))""")
def mintag_donors(spark, d):
    """Donors with arms of 24 and inserts of 0 or 1, and the targets that touch their junction."""
    made = D.mintag(_featured(spark, d, 24, 24), (24, 24), (24, 24), (48, 49), (0, 1))
    # a target brings its donor along as the name of its contig, so that it needn't be looked up; donors are many and short, and stay where they are
    own = F.struct("feature", "insert", "donor", "up_n")
    found = find_targets(made.select(own.alias("contig"), F.col("donor").alias("seq")), [CAS9], spread=0).select("contig.*", F.col("strand").alias("t_strand"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), "spacer")
    met = found.where(D.over_junction(F.col("t_start"), F.col("t_end"), F.col("up_n"), F.col("insert")))
    return met.select("feature", "insert", "donor", "t_strand", "t_start", "spacer")


@query(f"""{_SEQD} SELECT feature, {_CUT('greatest(start - 40, 0)', 'start')} || {_CUT('start', 'start + 4')} || {_CUT('start + 4', '"end" - 3')} || {_CUT('"end" - 3', '"end"')} || {_CUT('"end"', '"end" + 40')} AS donor FROM x""")
def reversion_donors(spark, d):
    f = _featured(spark, d, 40, 40).withColumns({"parent_start": F.col("start") + 4, "parent_end": F.col("end") - 3})
    return D.reversion(f, 10, 40).select("feature", "donor")


_MODES = ["center_feature", "center_target", "center_both", "justify_feature", "justify_target"]


def _bounds_sql(mode: str) -> str:
    reach, low, high = 'greatest(te - start, "end" - ts)', "least(start, ts)", 'greatest(te, "end")'
    if mode == "center_feature":
        s, e = f'"end" - {reach} - 5', f"start + {reach} + 5"
    elif mode == "center_target":
        s, e = f"te - {reach} - 5", f"ts + {reach} + 5"
    elif mode == "center_both":
        s, e = f"{low} - 5", f"{high} + 5"
    else:
        own = "start" if mode == "justify_feature" else "ts"
        s, e = f"CASE WHEN {low} = {own} THEN {low} ELSE {low} - 5 END", f"CASE WHEN {low} = {own} THEN {high} + 5 ELSE {high} END"
    short = f"greatest(60 - (({e}) - ({s})), 0)"
    if mode.startswith("center"):
        a, b = f"({s}) - ({short} + 1) // 2", f"({e}) + ({short} + 1) // 2"
    else:
        own, sign = ("start", "-") if mode == "justify_feature" else ("ts", "+")
        a, b = f"CASE WHEN ({s}) = {own} THEN ({s}) ELSE ({s}) {sign} {short} END", f"CASE WHEN ({s}) = {own} THEN ({e}) + {short} ELSE ({e}) END"
    return f"SELECT feature, '{mode}' AS mode, ({a})::INTEGER AS a, ({b})::INTEGER AS b FROM t"


_TARGETED = "t AS (SELECT *, start + substr(feature, 2)::INTEGER % 40 - 20 AS ts, start + substr(feature, 2)::INTEGER % 40 + 3 AS te FROM features)"


def _bounds(spark, d):
    f, k = B.features(spark, d), F.expr("cast(substring(feature, 2) as int)") % 40
    ts, te = F.col("start") + k - 20, F.col("start") + k + 3
    kinds = F.array(*(F.struct(F.lit(m).alias("mode"), D.format_bounds(m, F.col("start"), F.col("end"), ts, te, 5, 60).alias("x")) for m in _MODES))
    return f.select("feature", "gene", F.inline(kinds)).select("feature", "gene", "mode", F.col("x.start").cast("int").alias("a"), F.col("x.end").cast("int").alias("b"))


@query(f"WITH {B.FEATURES}, {_TARGETED} " + " UNION ALL ".join(_bounds_sql(m) for m in _MODES))
def expand_format_modes(spark, d):
    return _bounds(spark, d).drop("gene")


@query(f"WITH {B.FEATURES}, {_TARGETED}, x AS ({_bounds_sql('center_both')}) SELECT gene, count(*) AS n FROM x JOIN features USING (feature) GROUP BY gene HAVING bool_and(b - a BETWEEN 50 AND 75)")
def feature_size_filter(spark, d):
    return _bounds(spark, d).where("mode = 'center_both'").groupBy("gene").agg(F.count("*").alias("n"), F.bool_and(F.expr("b - a between 50 and 75")).alias("ok")).where("ok").select("gene", "n")


@query(f"WITH {B.FEATURES}, {_TARGETED}, x AS ({_bounds_sql('center_both')}) SELECT contig, a // 100 AS a, b // 100 AS b, string_agg(feature, '/' ORDER BY feature) AS parents, count(*) AS n FROM x JOIN features USING (feature) WHERE a >= 0 GROUP BY contig, a // 100, b // 100")
def derive_features(spark, d):
    """Features with equal bounds become one, named after all of them."""
    x = _bounds(spark, d).where("mode = 'center_both' and a >= 0").join(B.features(spark, d).select("feature", "contig"), "feature")
    bound = lambda c: F.floor(F.col(c) / 100).cast("int").alias(c)
    return x.groupBy("contig", bound("a"), bound("b")).agg(F.array_join(F.sort_array(F.collect_list("feature")), "/").alias("parents"), F.count("*").alias("n"))


_REGIONS = "r AS (SELECT feature, start, \"end\", seq FROM x)"


@query(f"""{_SEQD}, {_REGIONS}, sizes AS (SELECT unnest([18, 20]) AS size), st AS (SELECT unnest(['+', '-']) AS strand),
  p AS (SELECT *, unnest(range(greatest(start - (size - CASE WHEN strand = '+' THEN 4 ELSE 8 END), 0), least("end" - CASE WHEN strand = '+' THEN 8 ELSE 4 END, length(seq) - size) + 1)) AS p_start FROM r, sizes, st)
  SELECT feature, strand, p_start::INTEGER AS p_start, CASE WHEN strand = '+' THEN substr(seq, p_start + 1, size) ELSE reverse(translate(substr(seq, p_start + 1, size), 'ACGT', 'TGCA')) END AS primer FROM p""")
def primer_scan(spark, d):
    r = _featured(spark, d, 20, 20).select("feature", "start", "end", "base", "seq")
    both = P.scan(r, (18, 18)).unionByName(P.scan(r, (20, 20)))
    return both.select("feature", "strand", (F.col("p_start") + F.col("base")).alias("p_start"), "primer")


_LAST5, _CLAMP = "(length(right(s, 5)) - length(translate(right(s, 5), 'GC', '')))", "length(regexp_extract(s, '[GC]*$'))"
_OWN = "CASE " + " ".join(f"WHEN contains(r, right(s, {n})) THEN {n}" for n in range(5, 0, -1)) + " ELSE 0 END"


@query(
    f"WITH {B.OLIGOS}, p AS (SELECT id, left(seq, (15 + id % 18)::INTEGER) AS s FROM oligos), q AS (SELECT *, reverse(translate(s, 'ACGT', 'TGCA')) AS r, (length(s) - length(translate(s, 'GC', '')))::DOUBLE / length(s) AS g FROM p) "
    f"SELECT id, true AS mask, length(s) BETWEEN 17 AND 28 AS length, {_LAST5} BETWEEN 1 AND 3 AS last5, {_CLAMP} BETWEEN 0 AND 2 AS clamp, g BETWEEN 0.25 AND 0.75 AS gc, "
    "NOT regexp_matches(s, 'A{5}|C{5}|G{5}|T{5}') AS run, " + f"{_OWN} <= 3 AS own FROM q"
)
def primer_checks(spark, d):
    p = B.oligos(spark, d).select("id", F.expr("left(seq, cast(15 + id % 18 as int))").alias("s"))
    return p.select("id", *(c.alias(k) for k, c in P.checks(F.col("s")).items()))


@query(
    f"WITH {B.OLIGOS}, p AS (SELECT id, left(seq, (15 + id % 15)::INTEGER) AS s, (-(id % 9))::DOUBLE AS dg FROM oligos), q AS (SELECT *, length(s)::DOUBLE AS n, (length(s) - length(translate(s, 'GC', '')))::DOUBLE / length(s) * 100 AS g FROM p) "
    "SELECT id, round((1 / (1 + pow(3.0::DOUBLE, 17 - n))) * (1 / (1 + pow(1.7::DOUBLE, n - 30))) * (1 / (1 + pow(1.7::DOUBLE, 40 - g))) * (1 / (1 + pow(1.7::DOUBLE, g - 60))) * (1 / (1 + pow(3.0::DOUBLE, -4 - dg))), 6) AS weight, "
    "(2 * (n - (n * g / 100)) + 4 * (n * g / 100))::INTEGER AS marmur, round(64.9::DOUBLE + 41 * (n * g / 100 - 16.4::DOUBLE) / n, 6) AS wallace FROM q"
)
def primer_weight_parts(spark, d):
    p = B.oligos(spark, d).select("id", F.expr("left(seq, cast(15 + id % 15 as int))").alias("s"), F.expr("cast(-(id % 9) as double)").alias("dg"))
    s = F.col("s")
    return p.select("id", F.round(P.weight(F.length(s), S.gc_percent(s), F.col("dg")), 6).alias("weight"), P.marmur(s).cast("int").alias("marmur"), F.round(P.wallace(s), 6).alias("wallace"))


@query(
    "SELECT l_orderkey, l_linenumber, round(w, 6) AS weight, round(w * CASE WHEN l_linenumber = 1 THEN (l_tax + l_discount) / 2 ELSE l_tax * l_discount END, 6) AS joint FROM (SELECT *, (1 / (1 + pow(1.03::DOUBLE, 300 - x))) * (1 / (1 + pow(1.03::DOUBLE, x - 700))) "
    "* (1 / (1 + pow(3.0::DOUBLE, -4 - dg))) * (1 / (1 + pow(5.0::DOUBLE, -2.5 - tm))) * (1 / (1 + pow(5.0::DOUBLE, tm - 2.5))) AS w FROM (SELECT *, l_quantity * 20 AS x, -(l_partkey % 8)::DOUBLE AS dg, (l_suppkey % 7)::DOUBLE - 3 AS tm FROM lineitem))"
)
def pair_weight(spark, d):
    c = F.col
    w = P.pair_weight(c("l_quantity") * 20, -(c("l_partkey") % 8).cast("double"), (c("l_suppkey") % 7).cast("double") - 3)
    joint = P.joint_weight(w, c("l_tax"), c("l_discount"), c("l_linenumber") == 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(w, 6).alias("weight"), F.round(joint, 6).alias("joint"))


_SITES = f"""WITH {B.CONTIGS}, w AS (SELECT contig, i, substr(seq, i + 1, 5) AS s FROM (SELECT contig, seq, unnest(range(0, length(seq) - 4)) AS i FROM contigs)),
  p AS (SELECT 'ACGTA' AS forward, 'CCATG' AS reverse UNION ALL SELECT 'GATTA', 'TTGCA' UNION ALL SELECT 'ACGTA', 'TTGCA')"""


@query(f"{_SITES} SELECT forward, reverse, a.contig, a.i::INTEGER AS start, (b.i + 5)::INTEGER AS \"end\", (b.i + 5 - a.i)::INTEGER AS size FROM p JOIN w a ON a.s = forward JOIN w b ON b.s = reverse(translate(p.reverse, 'ACGT', 'TGCA')) AND b.contig = a.contig WHERE a.i < b.i + 5 AND b.i + 5 - a.i BETWEEN 10 AND 5000".replace("reverse(translate(p.reverse", "reverse(translate(p.\"reverse\""))
def insilico_pcr(spark, d):
    pairs = spark.createDataFrame([("ACGTA", "CCATG"), ("GATTA", "TTGCA"), ("ACGTA", "TTGCA")], "forward string, reverse string")
    own = pairs.select(F.col("forward").alias("primer")).union(pairs.select("reverse"))
    return P.amplicons(pairs, P.binding_sites(own, B.contigs(spark, d)), 10, 5000)


@query(f"{_SITES}, m AS (SELECT contig, i, '+' AS strand FROM w WHERE s IN ('ACGTC', 'ATGTC', 'ACTTC', 'ATTTC') UNION ALL SELECT contig, i, '-' FROM w WHERE reverse(translate(s, 'ACGT', 'TGCA')) IN ('ACGTC', 'ATGTC', 'ACTTC', 'ATTTC')) SELECT contig, (i + 1)::INTEGER AS start, (i + 5)::INTEGER AS \"end\", strand, 'q0_' || (row_number() OVER (ORDER BY contig, strand, i) - 1) AS id FROM m")
def iupac_search(spark, d):
    """Hits of AYKTC on both strands, from 1 and closed, numbered; hits of this query can't overlap themselves."""
    return api.find_sequence(B.contigs(spark, d), ["AYKTC"])


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower('>' || page_id || ' ' || coalesce(url, '')), 'page/1[0-9]|[?]|html 7|^>2')")
def header_search(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("contig"), F.coalesce("url", F.lit("")).alias("info"), "page_id", "url")
    return api.find_header(p, ["PAGE/1[0-9]", "[?]", "html 7", "^>2"]).select("page_id", "url")


_ALIGN = "al AS (SELECT l_orderkey AS q, l_suppkey % 3 AS s, (l_partkey % 10)::INTEGER AS q0, (90 + l_linenumber * 2)::INTEGER AS q1, l_quantity AS n FROM lineitem)"


def _edge_hits(spark, d):
    """Hits of donors of 100 letters, and the donors."""
    c = F.col
    a = _alignments(spark, d).select(c("q").alias("query"), c("s").alias("subject"), c("q0").alias("q_start"), c("q1").alias("q_end"), c("q0").alias("s_start"), c("q1").alias("s_end"), F.lit(0.0).alias("evalue"), F.lit(35).alias("length"))
    return a, a.select(c("query").alias("donor")).distinct().withColumn("seq", F.lit("N" * 100))


def _alignments(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("q"), (c("l_suppkey") % 3).alias("s"), (c("l_partkey") % 10).cast("int").alias("q0"), (90 + c("l_linenumber") * 2).cast("int").alias("q1"), c("l_quantity").alias("n"))


@query(f"WITH {_ALIGN} SELECT q, s FROM al GROUP BY q, s HAVING count(*) FILTER (q0 < 3) = 1 AND count(*) FILTER (q0 >= 3 AND q1 > 97) = 1")
def flank_pair_filter(spark, d):
    """Query and subject pairs with exactly one hit at the left edge and one at the right one."""
    return flank_pairs(*_edge_hits(spark, d)).select(F.col("donor").alias("q"), F.col("contig").alias("s"))


@query(f"WITH {_ALIGN} SELECT q, s, min(q0) AS q0, min(q1) AS q1 FROM al WHERE q0 < 3 AND q1 > 97 GROUP BY q, s HAVING count(*) = 1")
def full_length_hit_filter(spark, d):
    a, donors = _edge_hits(spark, d)
    return whole_hits(a, donors).select(F.col("query").alias("q"), F.col("subject").alias("s"), F.col("q_start").alias("q0"), F.col("q_end").alias("q1"))


# The default alignment scores.
SCORES = {"match": 1.0, "transition": -1.0, "transversion": -1.2, "open": -4.0, "extend": -2.0}


def score_rows() -> list[tuple[str, str, str, float]]:
    """(query, subject, type, score) of the default matrix, gap rows included."""
    rows = [(a, b, "", SCORES["match"] if a == b else SCORES["transition"] if {a, b} in ({"A", "G"}, {"C", "T"}) else SCORES["transversion"]) for a in "ACGT" for b in "ACGT"]
    rows += [(a, b, kind, SCORES[kind]) for kind in ("open", "extend") for x in "ACGT" for a, b in (("-", x), (x, "-"))]
    return rows + [("-", "-", kind, SCORES[kind]) for kind in ("open", "extend")]


_MATRIX = "m(q, s, kind, score) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{k}', {x!r}::DOUBLE)" for a, b, k, x in score_rows()) + ")"


@query(f"WITH {_MATRIX} SELECT round(avg(score) FILTER (kind = '' AND q = s), 6) AS match, round(avg(score) FILTER (kind = '' AND q <> s), 6) AS mismatch, round(avg(score) FILTER (kind <> '' AND s = '-'), 6) AS insertion, round(avg(score) FILTER (kind <> '' AND q = '-'), 6) AS deletion, round(avg(score), 6) AS total FROM m WHERE NOT (q = '-' AND s = '-')")
def matrix_averages(spark, d):
    m = spark.createDataFrame(score_rows(), "q string, s string, kind string, score double").where("not (q = '-' and s = '-')")
    mean = lambda when: F.round(F.avg(F.when(F.expr(when), F.col("score"))), 6)
    return m.agg(mean("kind = '' and q = s").alias("match"), mean("kind = '' and q <> s").alias("mismatch"), mean("kind <> '' and s = '-'").alias("insertion"), mean("kind <> '' and q = '-'").alias("deletion"), mean("true").alias("total"))


@query(f"WITH {_MATRIX}, {B.CONTIGS}, c AS (SELECT unnest(string_split(seq, '')) AS b FROM contigs), f AS (SELECT b, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM c GROUP BY b) SELECT round(sum(x.p * y.p * score), 6) AS expected FROM m JOIN f x ON x.b = q JOIN f y ON y.b = s WHERE kind = ''")
def expected_score(spark, d):
    from strandloom.plans.sequence_queries import composition_frequencies

    f = composition_frequencies(spark, d).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    m = F.broadcast(spark.createDataFrame(score_rows(), "q string, s string, kind string, score double").where("kind = ''"))  # 16 rows
    j = m.join(f.select(F.col("nt").alias("q"), F.col("p").alias("pq")), "q").join(f.select(F.col("nt").alias("s"), F.col("p").alias("ps")), "s")
    return j.agg(F.round(F.sum(F.col("pq") * F.col("ps") * F.col("score")), 6).alias("expected"))


_MSA = f"msa AS (SELECT p_brand AS grp, p_partkey AS id, translate(md5('m' || p_partkey % 7 || p_brand), '{B.HEX}', 'ACGTACGTACGTACG-') AS s FROM part), cols AS (SELECT grp, i, substr(s, i, 1) AS nt, count(*) AS n FROM msa, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL)"


def _msa_columns(spark, d):
    k = F.col("p_partkey")
    s = F.translate(F.md5(F.concat(F.lit("m"), (k % 7).cast("string"), "p_brand")), B.HEX, "ACGTACGTACGTACG-")
    return msa.columns(table(spark, d, "part").select(F.col("p_brand").alias("grp"), s.alias("s")))


@query(f"""WITH {_MSA}, t AS (SELECT grp, i, sum(n) AS total, max(n) FILTER (nt <> '-') AS best, coalesce(sum(n) FILTER (nt = '-'), 0) AS gaps FROM cols GROUP BY grp, i)
  SELECT t.grp, t.i, string_agg(nt, '' ORDER BY nt) AS consensus, min(best)::BIGINT AS count, CASE WHEN min(gaps) > 0 THEN ' ' WHEN min(best) = min(total) THEN '*' WHEN min(best) * 4 >= min(total) * 3 THEN '|' WHEN min(best) * 2 >= min(total) THEN ':' WHEN min(best) * 4 >= min(total) THEN '.' ELSE ' ' END AS mark
  FROM t LEFT JOIN cols c ON c.grp = t.grp AND c.i = t.i AND nt <> '-' AND n = best GROUP BY t.grp, t.i""")
def msa_consensus(spark, d):
    return msa.consensus(_msa_columns(spark, d))


@query(f"WITH {_MSA} SELECT grp, i FROM cols GROUP BY grp, i HAVING coalesce(sum(n) FILTER (nt = '-'), 0) * 2 <= sum(n)")
def msa_gap_filter(spark, d):
    return msa.minority_gaps(_msa_columns(spark, d))


@query(f"""WITH {_MSA}, t AS (SELECT grp, i, (max(n) FILTER (nt <> '-') < sum(n) FILTER (nt <> '-'))::INTEGER AS mm, (count(*) FILTER (nt = '-') > 0)::INTEGER AS gap FROM cols GROUP BY grp, i),
  w AS (SELECT grp, i, sum(coalesce(mm, 0)) OVER x AS mismatches, sum(gap) OVER x AS gaps, count(*) OVER x AS n FROM t WINDOW x AS (PARTITION BY grp ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
  SELECT grp, max(i) AS nearest, count(*) AS windows FROM w WHERE n = 8 AND mismatches <= 8 AND gaps <= 3 GROUP BY grp""")
def msa_window_search(spark, d):
    """The window of 8 columns nearest to the right edge with few enough mismatches and gaps, each counted once a column."""
    return msa.nearest_windows(_msa_columns(spark, d), 8, "right", 8, 3)


@query("WITH g AS (SELECT l_orderkey AS set_id, l_partkey AS primer, avg(50 + l_quantity / 10) AS tm FROM lineitem GROUP BY ALL), m AS (SELECT set_id, tm - avg(tm) OVER (PARTITION BY set_id) AS x FROM g) SELECT set_id, round(exp(sum(ln((1 / (1 + pow(5.0::DOUBLE, -2.5 - x))) * (1 / (1 + pow(5.0::DOUBLE, x - 2.5)))))), 6) AS weight FROM m GROUP BY set_id")
def primer_group_weight(spark, d):
    """Mean Tm of each distinct primer of a set, then the product of the weights of its distance from the set's mean."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("primer"), (50 + F.col("l_quantity") / 10).alias("tm"))
    return PS.group_weights(t).select("set_id", F.round("weight", 6).alias("weight"))


@query("SELECT l_orderkey, round(min(dg), 6) AS dg, round(max(tm) FILTER (dg = low), 6) AS tm FROM (SELECT l_orderkey, 0 - (l_partkey % 6)::DOUBLE AS dg, l_quantity AS tm, min(0 - (l_partkey % 6)::DOUBLE) OVER (PARTITION BY l_orderkey) AS low FROM lineitem) GROUP BY l_orderkey")
def best_structure(spark, d):
    """The structure with the lowest delta G, and of those the highest melting temperature."""
    t = table(spark, d, "lineitem").select("l_orderkey", (0 - (F.col("l_partkey") % 6).cast("double")).alias("dg"), F.col("l_quantity").alias("tm"))
    return PS.best_structures(t, "l_orderkey").select("l_orderkey", F.round("dg", 6).alias("dg"), F.round("tm", 6).alias("tm"))


@query(
    f"WITH {B.OLIGOS}, p AS (SELECT id, left(seq, 20) AS s, (id % 4) AS side, id // 40 AS reg, (id * 37 % 1000)::INTEGER AS at, 50 + (id % 23) / 2.0::DOUBLE AS tm FROM oligos), "
    "m AS (SELECT f.id AS f, r.id AS r, f.s AS fs, r.s AS rs, r.at + 20 - f.at AS size FROM p f JOIN p r ON f.reg = r.reg AND f.side < 2 AND r.side >= 2 WHERE r.at + 20 - f.at BETWEEN 300 AND 700 AND abs(f.tm - r.tm) <= 3) "
    "SELECT f, r, size::INTEGER AS size FROM m WHERE NOT contains(reverse(translate(rs, 'ACGT', 'TGCA')), right(fs, 4)) AND NOT contains(reverse(translate(fs, 'ACGT', 'TGCA')), right(rs, 4))"
)
def primer_pairs(spark, d):
    """Primers of a region that pair by size, temperature and ends."""
    k = F.col("id")
    at = (k * 37 % 1000).cast("int")
    p = B.oligos(spark, d).select("id", F.left("seq", F.lit(20)).alias("primer"), (k % 4).alias("side"), F.floor(k / 40).alias("name"), at.alias("p_start"), (at + 20).alias("p_end"), (50 + (k % 23) / 2.0).alias("tm"))
    return P.pair_primers(p.where("side < 2").drop("side"), p.where("side >= 2").drop("side")).select(F.col("f_id").alias("f"), F.col("r_id").alias("r"), "size")


@query("SELECT o_custkey, o_orderkey AS best, o_totalprice AS weight FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def distinct_designs(spark, d):
    """One design for each key, that of the largest weight."""
    return PS.best_designs(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", F.col("o_orderkey").alias("best"), F.col("o_totalprice").alias("weight"))


@query("WITH n AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k, min(o_orderpriority) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE k WHEN 1 THEN 'haploid' WHEN 2 THEN 'diploid' WHEN 3 THEN 'triploid' ELSE 'polyploid' END AS ploidy FROM n")
def ploidy_labels(spark, d):
    return PS.ploidy(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT p_type AS gene, count(*) AS features, string_agg(p_name, ',' ORDER BY p_name) AS names FROM part GROUP BY p_type")
def features_by_gene(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("gene")).agg(F.count("*").alias("features"), F.array_join(F.sort_array(F.collect_list("p_name")), ",").alias("names"))


@query(f"WITH {B.OLIGOS} SELECT id, i::INTEGER AS cut, left(s, i) AS l, substr(s, i + 1) AS r FROM (SELECT id, seq AS s, unnest(range(4, 29)) AS i FROM oligos)")
def donor_splits(spark, d):
    x = B.oligos(spark, d).select("id", F.inline(D.splits(F.col("seq"), 4)))
    return x.select("id", F.length("left").alias("cut"), F.col("left").alias("l"), F.col("right").alias("r"))
