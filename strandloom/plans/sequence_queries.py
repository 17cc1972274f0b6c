"""Queries over single sequences: letters, runs, k-mers, cigars, codons, scores and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import cigar as C
from strandloom.functions import scoring, sequence as S, statistics as St
from strandloom.functions.translation import STANDARD_CODE, translate
from strandloom.operators.frames import reading_frames
from strandloom.operators.windows import windows
from strandloom.plans import bridge as B
from strandloom.plans.registry import query, table

_SETS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "W": "AT", "S": "CG", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_IUPAC = "iupac(l, b) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SETS.items()) + ")"
_CHARS = "chars AS (SELECT id, i, upper(substr(amb, i, 1)) AS l FROM oligos, (SELECT unnest(range(1, 33)) AS i))"


@query(f"WITH {B.OLIGOS} SELECT id, reverse(translate(amb, 'ACGTRYMKWSBDHVN', 'TGCAYRKMWSVHDBN')) AS amb_rc, reverse(translate(mixed, 'ACGTacgt', 'TGCAtgca')) AS mixed_rc FROM oligos")
def revcomp(spark, d):
    return B.oligos(spark, d).select("id", S.reverse_complement(F.col("amb")).alias("amb_rc"), S.reverse_complement(F.col("mixed")).alias("mixed_rc"))


def _share_sql(bases: str) -> str:
    return "sum(" + "CASE l " + " ".join(f"WHEN '{k}' THEN {len(set(v) & set(bases)) / len(v)!r}" for k, v in _SETS.items()) + " END::DOUBLE)"


@query(f"WITH {B.OLIGOS}, {_CHARS} SELECT id, round({_share_sql('CG')} / 32 * 100, 6) AS gc, round({_share_sql('AG')} / 32, 6) AS purine FROM chars GROUP BY id")
def gc_percent(spark, d):
    o = B.oligos(spark, d)
    return o.select("id", F.round(S.gc_percent(F.col("amb")), 6).alias("gc"), F.round(S.base_frequency(F.col("amb"), "AG"), 6).alias("purine"))


@query(f"WITH {B.OLIGOS}, {_CHARS} SELECT id, " + ", ".join(f"round({_share_sql(b)}, 6) AS n_{b.lower()}" for b in "ACGT") + " FROM chars GROUP BY id")
def nucleotide_counts(spark, d):
    return B.oligos(spark, d).select("id", *(F.round(S.weighted_count(F.col("amb"), b), 6).alias(f"n_{b.lower()}") for b in "ACGT"))


def _run_sql(base: str) -> str:
    share = "CASE l " + " ".join(f"WHEN '{k}' THEN {1 / len(v)!r}" for k, v in _SETS.items() if base in v) + " ELSE 0 END::DOUBLE"
    return (
        f"SELECT id, max(s) AS run FROM (SELECT id, g, sum(x) AS s FROM (SELECT id, x, sum((x = 0)::INTEGER) OVER (PARTITION BY id ORDER BY i) AS g "
        f"FROM (SELECT id, i, {share} AS x FROM chars)) GROUP BY id, g) GROUP BY id"
    )


@query(f"WITH {B.OLIGOS}, {_CHARS} SELECT id, round(run, 6) AS polyt FROM ({_run_sql('T')})")
def polyt_run(spark, d):
    return B.oligos(spark, d).select("id", F.round(S.longest_run(F.col("amb"), "T"), 6).alias("polyt"))


@query(f"WITH {B.OLIGOS}, {_CHARS} SELECT id, round(max(run), 6) AS homopolymer FROM ({' UNION ALL '.join(_run_sql(b) for b in 'ACGT')}) GROUP BY id")
def homopolymer_run(spark, d):
    return B.oligos(spark, d).select("id", F.round(S.longest_homopolymer(F.col("amb")), 6).alias("homopolymer"))


_G = "CASE l " + " ".join(f"WHEN '{k}' THEN {1 / len(v)!r}" for k, v in _SETS.items() if "G" in v) + " ELSE 0 END::DOUBLE"


@query(f"WITH {B.OLIGOS}, chars AS (SELECT id, CASE WHEN id % 2 = 0 THEN right(amb, 1) ELSE left(amb, 1) END AS l FROM oligos) SELECT id, round({_G}, 6) AS g FROM chars")
def proximal_g(spark, d):
    o = B.oligos(spark, d)
    return o.select("id", F.round(S.proximal_g(F.col("amb"), F.when(F.col("id") % 2 == 0, ">").otherwise("<")), 6).alias("g"))


@query(f"WITH {B.OLIGOS} SELECT id, NOT contains(seq, 'TTT') AS kept FROM oligos")
def polyt_filter(spark, d):
    return B.oligos(spark, d).select("id", (~F.contains("seq", F.lit("T" * 3))).alias("kept"))


_LOW, _UP = "regexp_matches(m, '[a-z]')", "regexp_matches(m, '[A-Z]')"


@query(
    f"WITH {B.SPARSE}, x AS (SELECT id, cased AS m FROM sparse) SELECT id, true AS c_ignore, NOT {_LOW} AS c_upper_only, NOT {_UP} AS c_lower_only, "
    f"{_LOW} AS c_mixed_lower, {_UP} AS c_mixed_upper, {_LOW} AND {_UP} AS c_mixed_only FROM x"
)
def target_case_filter(spark, d):
    m = F.col("cased")
    modes = ["ignore", "upper-only", "lower-only", "mixed-lower", "mixed-upper", "mixed-only"]
    return B.sparse(spark, d).select("id", *(S.case_rule(m, x).alias("c_" + x.replace("-", "_")) for x in modes))


@query(f"WITH {B.SPARSE} SELECT id, few AS s FROM sparse WHERE NOT regexp_matches(few, '[^ACGT]')")
def target_ambiguity_discard(spark, d):
    return B.sparse(spark, d).select("id", F.col("few").alias("s")).where(~S.is_ambiguous(F.col("s")))


@query(
    f"WITH RECURSIVE {_IUPAC}, {B.SPARSE}, "
    "r(id, s, n, t) AS (SELECT id, few, 0, '' FROM sparse UNION ALL SELECT r.id, r.s, n + 1, t || substr(b, k, 1) FROM r JOIN iupac ON l = substr(s, n + 1, 1), (SELECT unnest(range(1, 5)) AS k) WHERE n < 32 AND k <= length(b)) "
    "SELECT id, t AS concrete FROM r WHERE n = 32"
)
def target_disambiguate(spark, d):
    return B.sparse(spark, d).select("id", F.explode(S.disambiguate(F.col("few"))).alias("concrete"))


@query(f"WITH {B.OLIGOS} SELECT id, k.i::INTEGER AS start, substr(seq, k.i + 1, 8) AS text FROM oligos, (SELECT unnest(range(0, 25, 3)) AS i) k")
def sliding_windows(spark, d):
    return B.oligos(spark, d).select("id", F.inline(S.windows(F.col("seq"), 8, 3)))


_KMERS = f"WITH {B.CONTIGS}, k AS (SELECT contig, substr(seq, i, 3) AS kmer FROM (SELECT contig, seq, unnest(range(1, length(seq) - 1)) AS i FROM contigs))"


def _kmers(spark, d, k: int = 3):
    return windows(B.contigs(spark, d), k).select("contig", F.col("window").alias("kmer"))


@query(_KMERS + " SELECT kmer, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS freq FROM k GROUP BY kmer")
def kmer_dist_stranded(spark, d):
    n = _kmers(spark, d).groupBy("kmer").agg(F.count("*").alias("n"))  # at most 4^k rows
    return n.withColumn("freq", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


_RC3 = "reverse(translate(kmer, 'ACGT', 'TGCA'))"


@query(_KMERS + f", m AS (SELECT least(kmer, {_RC3}) || ' ' || greatest(kmer, {_RC3}) AS pair FROM k) SELECT pair, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS freq FROM m GROUP BY pair")
def kmer_dist_mirrored(spark, d):
    other = S.reverse_complement(F.col("kmer"))
    pair = F.concat_ws(" ", F.least("kmer", other), F.greatest("kmer", other)).alias("pair")
    n = _kmers(spark, d).groupBy("kmer").agg(F.count("*").alias("c")).groupBy(pair).agg(F.sum("c").alias("n"))
    return n.withColumn("freq", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query(_KMERS + ", f AS (SELECT kmer, count(*)::DOUBLE AS n FROM k GROUP BY kmer) SELECT kmer, round((1 / n) / sum(1 / n) OVER (), 9) AS freq FROM f")
def kmer_dist_complement(spark, d):
    n = _kmers(spark, d).groupBy("kmer").agg((1 / F.count("*")).alias("x"))
    return n.select("kmer", F.round(F.col("x") / F.sum("x").over(Window.partitionBy()), 9).alias("freq"))


@query(
    f"WITH {B.OLIGOS}, k AS (SELECT id, substr(seq, i, 2) AS kmer FROM oligos, (SELECT unnest(range(1, 32)) AS i)), "
    "f AS (SELECT kmer, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM k GROUP BY kmer) SELECT id, round(sum(p), 6) AS likelihood FROM k JOIN f USING (kmer) GROUP BY id"
)
def sequence_likelihood(spark, d):
    k = B.oligos(spark, d).select("id", F.explode(S.windows(F.col("seq"), 2)).alias("w")).select("id", F.col("w.text").alias("kmer"))
    n = k.groupBy("kmer").agg(F.count("*").alias("n"))
    f = n.select("kmer", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))  # 16 rows
    return k.join(F.broadcast(f), "kmer").groupBy("id").agg(F.round(F.sum("p"), 6).alias("likelihood"))


@query(f"WITH {B.CONTIGS}, k AS (SELECT contig, substr(seq, i, 1) AS nt FROM (SELECT contig, seq, unnest(range(1, length(seq) + 1)) AS i FROM contigs)) SELECT nt, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS freq FROM k GROUP BY nt")
def composition_frequencies(spark, d):
    counts = B.contigs(spark, d).agg(*(F.sum(S.count_letters(F.col("seq"), b)).alias(b) for b in "ACGT"))
    n = counts.select(F.expr("stack(4, 'A', A, 'C', C, 'G', G, 'T', T) AS (nt, n)"))
    return n.withColumn("freq", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query(
    "WITH a AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), all_k AS (SELECT a.x || b.x || c.x AS kmer FROM a, a b, a c), "
    + _KMERS[5:] + " SELECT kmer, count(k.contig) AS n FROM all_k LEFT JOIN k USING (kmer) GROUP BY kmer"
)
def kmer_zero_filled(spark, d):
    words = spark.range(64).select(F.concat(*(F.substring(F.lit("ACGT"), ((F.col("id") / 4**p).cast("int") % 4 + 1), F.lit(1)) for p in (2, 1, 0))).alias("kmer"))
    n = _kmers(spark, d).groupBy("kmer").agg(F.count("*").alias("n"))
    return words.join(n, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {B.OLIGOS} SELECT id, levenshtein(substr(seq, 1, 16), substr(seq, 17, 16))::INTEGER AS distance FROM oligos")
def edit_distance(spark, d):
    return B.oligos(spark, d).select("id", F.levenshtein(F.substring("seq", 1, 16), F.substring("seq", 17, 16)).alias("distance"))


_GAPPED = (
    f"WITH {B.OLIGOS}, g AS (SELECT id, translate(md5('q' || id), '{B.HEX}', 'ACGTACGTACGTACG-') AS q, translate(md5('s' || id), '{B.HEX}', 'ACGTACGTACGTAC--') AS s0 FROM oligos), "
    "h AS (SELECT id, q, array_to_string(list_transform(range(1, 33), lambda i: CASE WHEN substr(q, i, 1) = '-' AND substr(s0, i, 1) = '-' THEN 'A' ELSE substr(s0, i, 1) END), '') AS s FROM g), "
    "st AS (SELECT id, i, CASE WHEN substr(q, i, 1) = '-' THEN 'D' WHEN substr(s, i, 1) = '-' THEN 'I' WHEN substr(q, i, 1) = substr(s, i, 1) THEN '=' ELSE 'X' END AS op FROM h, (SELECT unnest(range(1, 33)) AS i))"
)
_RUNS = ", r AS (SELECT id, i, op, i - row_number() OVER (PARTITION BY id, op ORDER BY i) AS g FROM st), c AS (SELECT id, op, g, min(i) AS a, count(*) AS n FROM r GROUP BY id, op, g)"


def _gapped(spark, d):
    k = F.col("id")
    g = B.oligos(spark, d).select("id", B.letters_of(k, "q", "ACGTACGTACGTACG-").alias("q"), B.letters_of(k, "s", "ACGTACGTACGTAC--").alias("s"))
    at = lambda c, i: F.substring(F.col(c), i, F.lit(1))
    one_gap = F.transform(S.positions(F.lit(1), F.lit(32)), lambda i: F.when((at("q", i) == "-") & (at("s", i) == "-"), "A").otherwise(at("s", i)))
    return g.withColumn("s", F.array_join(one_gap, ""))


@query(_GAPPED + _RUNS + " SELECT id, string_agg(n || op, '' ORDER BY a) AS cigar, string_agg(CASE WHEN n = 1 THEN '' ELSE n::VARCHAR END || op, '' ORDER BY a) AS short, string_agg(n || op, '' ORDER BY a DESC) AS reversed FROM c GROUP BY id")
def cigar_from_alignment(spark, d):
    g = _gapped(spark, d).withColumn("steps", C.from_alignment(F.col("q"), F.col("s")))
    cigar = C.collapse(F.col("steps"))
    return g.select("id", cigar.alias("cigar"), C.collapse(F.col("steps"), True).alias("short"), C.reverse_cigar(cigar).alias("reversed"))


_N = lambda op: f"count(*) FILTER (op IN ({', '.join(repr(x) for x in op)}))::INTEGER"


@query(
    _GAPPED + f" SELECT id, {_N('=')} AS matches, {_N('X')} AS mismatches, {_N('I')} AS insertions, {_N('D')} AS deletions, {_N('XID')} AS errors, "
    f"{_N('IX=')} AS query_length, {_N('DX=')} AS subject_length, {_N('=')} * 1.0::DOUBLE + {_N('X')} * -1.5::DOUBLE + {_N('I')} * -3.0::DOUBLE + {_N('D')} * -3.0::DOUBLE AS score FROM st GROUP BY id"
)
def cigar_errors(spark, d):
    c = _gapped(spark, d).withColumn("c", C.collapse(C.from_alignment(F.col("q"), F.col("s"))))
    return c.select("id", C.errors(F.col("c")).alias("e"), C.query_length(F.col("c")).alias("query_length"), C.subject_length(F.col("c")).alias("subject_length"), C.cigar_score(F.col("c"), 1.0, -1.5, -3.0, -3.0).alias("score")).select("id", "e.*", "query_length", "subject_length", "score")


@query(
    _GAPPED + ", m AS (SELECT id, string_agg(CASE WHEN op IN ('=', 'X') THEN 'M' ELSE op END, '' ORDER BY i) AS plain, string_agg(op, '' ORDER BY i) AS steps FROM st GROUP BY id) SELECT id, plain, steps FROM m"
)
def cigar_specify(spark, d):
    g = _gapped(spark, d).withColumn("plain", C.from_alignment(F.col("q"), F.col("s"), specific=False))
    bare = lambda x: F.translate(F.col(x), "-", "")
    return g.select("id", "plain", C.specify(C.collapse(F.col("plain")), bare("q"), bare("s")).alias("steps"))


_FLAG = "(l_orderkey * 7 + l_linenumber * 131) % 4096"


@query(
    f"SELECT l_orderkey, l_linenumber, CASE WHEN (({_FLAG}) & 16) <> 0 THEN '-' ELSE '+' END AS strand, "
    + " || ".join(f"CASE WHEN (({_FLAG}) & {1 << i}) <> 0 THEN '{c}' ELSE '' END" for i, c in enumerate(C.SAM_BITS)) + " AS letters FROM lineitem"
)
def sam_flags(spark, d):
    f = F.expr(f"cast({_FLAG} as int)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.strand(f).alias("strand"), C.flag_letters(f).alias("letters"))


_DIFF = "list_filter(range(1, 21), lambda i: substr(spacer, i, 1) <> substr(off, i, 1))"


@query(f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, len({_DIFF})::INTEGER AS mismatches, round(100 - 100.0::DOUBLE * coalesce(list_sum({_DIFF}), 0) / 210, 6) AS linear FROM guides")
def linear_score(spark, d):
    g = B.guides(spark, d)
    return g.select("id", S.hamming(F.col("spacer"), F.col("off")).alias("mismatches"), F.round(scoring.linear(F.col("spacer"), F.col("off")), 6).alias("linear"))


_HZ = "[" + ", ".join(f"{1 - w!r}::DOUBLE" for w in scoring.HSU_ZHANG) + "]"


@query(
    f"WITH {B.OLIGOS}, {B.GUIDES}, m AS (SELECT id, {_DIFF} AS p FROM guides) SELECT id, round(list_reduce(list_prepend(1.0::DOUBLE, list_transform(p, lambda i: ({_HZ})[i])), lambda a, b: a * b) "
    "* CASE WHEN len(p) < 2 THEN 1.0::DOUBLE ELSE 1 / ((19 - (p[len(p)] - p[1])::DOUBLE / (len(p) - 1)) / 19 * 4 + 1) END * CASE WHEN len(p) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (len(p) * len(p)) END * 100, 6) AS score FROM m"
)
def hsu_zhang_score(spark, d):
    return B.guides(spark, d).select("id", F.round(scoring.hsu_zhang(F.col("spacer"), F.col("off")), 6).alias("score"))


# A stand-in mismatch table with a rule of its own; users give the published one as a file.
CFD_STAND_IN = {f"rU:d{b},{i}": round(1 - i / 40, 6) for b in "CGT" for i in range(1, 21)}


@query(
    f"WITH {B.OLIGOS}, {B.GUIDES}, pams(p, w) AS (VALUES {', '.join(f'({k!r}, {v!r}::DOUBLE)' for k, v in scoring.CFD_PAM.items())}), "
    f"m AS (SELECT id, pam, list_filter({_DIFF}, lambda i: substr(spacer, i, 1) = 'T') AS x FROM guides) "
    "SELECT id, round(list_reduce(list_prepend(1.0::DOUBLE, list_transform(x, lambda i: round(1 - i / 40.0::DOUBLE, 6))), lambda a, b: a * b) * w * 100, 6) AS score FROM m JOIN pams ON p = right(pam, 2)"
)
def cfd_score_as_coded(spark, d):
    return B.guides(spark, d).select("id", F.round(scoring.cfd(F.col("spacer"), F.col("off"), F.col("pam"), CFD_STAND_IN), 6).alias("score"))


_HOUSDEN = "[" + ", ".join(f"{w!r}::DOUBLE" for r in scoring.HOUSDEN for w in r) + "]"


@query(f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, round(-log10(list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, 21), lambda i: ({_HOUSDEN})[(i - 1) * 4 + instr('ACGT', substr(spacer, i, 1))])), lambda a, b: a * b)), 6) AS score FROM guides")
def housden_score(spark, d):
    return B.guides(spark, d).select("id", F.round(scoring.housden(F.col("spacer")), 6).alias("score"))


def _features_sql(features, base: int, text: str) -> str:
    return "f(p, m, w) AS (VALUES " + ", ".join(f"({p - base + 1}, '{m}', {w!r}::DOUBLE)" for p, m, w in features) + f"), s AS (SELECT id, {text} AS t FROM guides), x AS (SELECT id, t, coalesce(sum(w), 0) AS w FROM s LEFT JOIN f ON substr(t, p, length(m)) = m GROUP BY id, t)"


_CONTEXT = lambda n, total: f"left(right('{'-' * n}' || upstream || spacer, {n}) || pam || downstream || '{'-' * total}', {total})"


@query(f"WITH {B.OLIGOS}, {B.GUIDES}, {_features_sql(scoring.CRISPRSCAN, 1, _CONTEXT(26, 35))} SELECT id, round(100 * ({scoring.CRISPRSCAN_BASE}::DOUBLE + w), 6) AS score FROM x")
def position_kmer_score(spark, d):
    g = B.guides(spark, d)
    return g.select("id", F.round(scoring.crisprscan(*(F.col(c) for c in ("spacer", "pam", "upstream", "downstream"))), 6).alias("score"))


_GC20 = "(20 - length(translate(substr(t, 5, 20), 'GC', '')))"


@query(
    f"WITH {B.OLIGOS}, {B.GUIDES}, {_features_sql(scoring.DOENCH_2014, 0, _CONTEXT(24, 30))} SELECT id, round(100 / (1 + exp(-({scoring.DOENCH_2014_BASE}::DOUBLE "
    f"+ abs(10 - {_GC20}) * CASE WHEN {_GC20} <= 10 THEN {scoring.DOENCH_2014_LOW_GC}::DOUBLE ELSE {scoring.DOENCH_2014_HIGH_GC}::DOUBLE END + w))), 6) AS score FROM x"
)
def doench2014_score(spark, d):
    g = B.guides(spark, d)
    return g.select("id", F.round(scoring.doench_2014(*(F.col(c) for c in ("spacer", "pam", "upstream", "downstream"))), 6).alias("score"))


_RATER = " + ".join(f"(length(substr(spacer, {a}, {b - a + 1})) - length(translate(substr(spacer, {a}, {b - a + 1}), '{x}', '')))::DOUBLE / {b - a + 1} * {w!r}" for a, b, x, w in scoring.CRISPRATER)


@query(f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, round(100 * ({scoring.CRISPRATER_BASE}::DOUBLE + {_RATER}), 8) AS score FROM guides")
def crisprater_score(spark, d):
    return B.guides(spark, d).select("id", F.round(scoring.crisprater(F.col("upstream"), F.col("spacer")), 8).alias("score"))


@query(
    f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, {_CONTEXT(24, 30).replace('-', 'N')} AS q30, left(right('NNNNNNNN' || upstream || pam, 8) || spacer || downstream || repeat('N', 34), 34) AS q34 FROM guides"
)
def model_queries(spark, d):
    c = [F.col(x) for x in ("spacer", "pam", "upstream", "downstream")]
    return B.guides(spark, d).select("id", scoring.azimuth_query(*c).alias("q30"), scoring.cpf1_query(*c).alias("q34"))


@query("SELECT o_orderkey, round(1 / (1 + pow(1.22::DOUBLE, 66 - x)), 6) AS up, round(1 / (1 + pow(1.7::DOUBLE, 40 - x)) * (1 / (1 + pow(1.7::DOUBLE, x - 60))), 6) AS updown FROM (SELECT o_orderkey, o_totalprice % 100 AS x FROM orders)")
def logistic_weight(spark, d):
    x = F.col("o_totalprice") % 100
    return table(spark, d, "orders").select("o_orderkey", F.round(scoring.registered_weight("CRISPRater", x), 6).alias("up"), F.round(St.logistic_updown(x, 1.7, 40, 1.7, 60), 6).alias("updown"))


@query(
    "SELECT o_orderkey, round(exp((x - 1) * (x - 1) / -8.0::DOUBLE) / sqrt(2 * pi() * 4), 6) AS normal, round(pow(x, 2.0::DOUBLE) * exp(-x / 2) / 16, 6) AS gamma, "
    "CASE WHEN x < 5 THEN -1 ELSE 1 END AS sign, round(x / ln(2), 6) AS bits, round(x * ln(2), 6) AS nats FROM (SELECT o_orderkey, o_totalprice % 10 AS x FROM orders)"
)
def densities(spark, d):
    x = F.col("o_totalprice") % 10
    cols = {"normal": St.normal_pdf(x, 1, 2), "gamma": St.gamma_pdf(x, 3, 2), "bits": St.nats_to_bits(x), "nats": St.bits_to_nats(x)}
    return table(spark, d, "orders").select("o_orderkey", St.sign(x - 5).alias("sign"), *(F.round(c, 6).alias(k) for k, c in cols.items()))


_KA = "SELECT o_orderkey, (20 + o_totalprice % 40)::DOUBLE AS raw, 0.41::DOUBLE AS k, 0.62::DOUBLE AS lam, 100.0::DOUBLE AS m, 1000000.0::DOUBLE AS n, 0.9::DOUBLE AS h FROM orders"


@query(
    f"SELECT o_orderkey, round(log10(k * m * n * exp(-lam * raw)), 6) AS log_e, round((lam * raw - ln(k)) / ln(2), 6) AS bits, round(log10(m * n * pow(2.0::DOUBLE, -(lam * raw - ln(k)) / ln(2))), 6) AS log_e_bits, "
    f"round(ln(k * m * n) / lam, 6) AS raw_at_one, round(1 - exp(-(k * m * n * exp(-lam * raw))), 6) AS p FROM ({_KA})"
)
def evalue(spark, d):
    raw = (20 + F.col("o_totalprice") % 40).cast("double")
    k, lam, m, n = (F.lit(x) for x in (0.41, 0.62, 100.0, 1e6))
    e, bits = St.raw_score_expect(raw, k, lam, m, n), St.bit_score(raw, k, lam)
    cols = {"log_e": F.log10(e), "bits": bits, "log_e_bits": F.log10(St.bit_score_expect(bits, m, n)), "raw_at_one": St.raw_score_at_expect_one(k, lam, m, n), "p": St.expect_to_p(e)}
    return table(spark, d, "orders").select("o_orderkey", *(F.round(c, 6).alias(x) for x, c in cols.items()))


@query(
    f"SELECT o_orderkey, round(l, 6) AS hsp, round(greatest(mm - l, 1 / k), 6) AS query_length, round(greatest(n - 10 * l, 1 / k), 6) AS database_length, "
    f"round(greatest(mm - l, 1 / k) * greatest(n - 10 * l, 1 / k), 3) AS space FROM (SELECT *, ln(k * m * n) / h AS l, raw AS mm FROM ({_KA}))"
)
def effective_lengths(spark, d):
    mm = (20 + F.col("o_totalprice") % 40).cast("double")
    k, m, n, h = (F.lit(x) for x in (0.41, 100.0, 1e6, 0.9))
    length = St.hsp_length(k, m, n, h)
    q, db = St.effective_query_length(mm, length, k), St.effective_database_length(n, length, F.lit(10), k)
    return table(spark, d, "orders").select("o_orderkey", F.round(length, 6).alias("hsp"), F.round(q, 6).alias("query_length"), F.round(db, 6).alias("database_length"), F.round(q * db, 3).alias("space"))


@query(
    "WITH g AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS total, count(*) AS r FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1), "
    "s AS (SELECT *, 0.62::DOUBLE * total - ln(0.41::DOUBLE * 100 * 1000) - (r - 1) * (ln(0.41::DOUBLE) + 2 * ln(50.0::DOUBLE)) - ln(factorial(r::INTEGER)::DOUBLE) AS score FROM g) "
    "SELECT l_orderkey, round(score, 6) AS sum_score, round(0.5::DOUBLE / (pow(0.5::DOUBLE, r - 1) * 0.5), 6) AS corrected FROM s"
)
def sum_statistics(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("raws"), F.count("*").alias("r")).where("r > 1")
    score = St.sum_score(F.col("raws"), *(F.lit(x) for x in (0.41, 0.62, 100.0, 1000.0, 50.0)))
    return g.select("l_orderkey", F.round(score, 6).alias("sum_score"), F.round(St.tests_corrected_p(F.col("r"), F.lit(0.5), F.lit(0.5)), 6).alias("corrected"))


@query(f"WITH {B.OLIGOS} SELECT id, CASE " + " ".join(f"WHEN contains(rb, right(a, {n})) OR contains(ra, right(b, {n})) THEN {n}" for n in range(5, 0, -1)) + " ELSE 0 END AS n FROM (SELECT id, left(seq, 16) AS a, right(seq, 16) AS b, reverse(translate(left(seq, 16), 'ACGT', 'TGCA')) AS ra, reverse(translate(right(seq, 16), 'ACGT', 'TGCA')) AS rb FROM oligos)")
def three_prime_complement(spark, d):
    return B.oligos(spark, d).select("id", S.three_prime_complement(F.left("seq", F.lit(16)), F.right("seq", F.lit(16))).alias("n"))


@query(
    f"WITH {B.OLIGOS}, {B.GUIDES} SELECT id, coalesce(list_min({_DIFF}) - 1, 20)::INTEGER AS prefix, coalesce(20 - list_max({_DIFF}), 20)::INTEGER AS suffix, CASE WHEN coalesce(20 - list_max({_DIFF}), 20) >= 3 THEN 1 ELSE 0 END AS r_score FROM guides"
)
def end_identities(spark, d):
    a, b = F.col("spacer"), F.col("off")
    return B.guides(spark, d).select("id", S.matching_prefix(a, b).alias("prefix"), S.matching_suffix(a, b).alias("suffix"), F.when(S.matching_suffix(a, b) >= 3, 1).otherwise(0).alias("r_score"))


@query(
    "SELECT p_partkey, translate(m, chr(1) || chr(2), '!_') AS slug FROM (SELECT p_partkey, "
    "regexp_replace(translate(p_name || '.x/' || p_type, '. ', chr(1) || chr(2)), '[^A-Za-z0-9_\\-\\x01\\x02]', '+', 'g') AS m FROM part)"
)
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit(".x/"), "p_type")).alias("slug"))


_FITS, _LEFT = "length(l) + length(r) < 40", "substr(l, 1, least(length(l), 20))"


@query(
    "WITH t AS (SELECT p_partkey, p_name AS l, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' ' || p_name || ' ' || p_type ELSE right(p_type, 3) || p_brand END AS r FROM part) "
    f"SELECT p_partkey, CASE WHEN {_FITS} THEN l || lpad(r, (40 - length(l))::INTEGER, ' ') WHEN length(r) > 19 THEN substr(l, 1, 19) || '..' || right(r, 19) ELSE substr(l, 1, 37 - length(r)) || '...' || r END AS line, "
    f"CASE WHEN {_FITS} THEN l || lpad(r, (40 - length(l))::INTEGER, ' ') ELSE {_LEFT} || ' ...' || lpad(right(r, 36 - length({_LEFT})), (36 - length({_LEFT}))::INTEGER, ' ') END AS split_line FROM t"
)
def justified_lines(spark, d):
    """Both ways to put two texts at the edges of a line, for texts that fit and that don't."""
    k = F.col("p_partkey") % 3
    right = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat_ws(" ", "p_type", "p_name", "p_type")).otherwise(F.concat(F.right("p_type", F.lit(3)), "p_brand"))
    p = table(spark, d, "part").withColumn("r", right)
    return p.select("p_partkey", S.justify(F.col("p_name"), F.col("r"), 40).alias("line"), S.justify_split(F.col("p_name"), F.col("r"), 40).alias("split_line"))


@query("SELECT n, CASE WHEN n % 2 = 0 THEN n // 2 || 'b' ELSE n // 2 || 'a' END AS label, (CASE WHEN n % 2 = 0 THEN n // 2 ELSE n // 2 + 1 END)::INTEGER AS genome FROM (SELECT unnest(range(0, 12)) AS n)")
def round_labels(spark, d):
    n = spark.range(12).select(F.col("id").alias("n"))
    half, even = (F.col("n") / 2).cast("int"), F.col("n") % 2 == 0
    return n.select("n", F.concat(half.cast("string"), F.when(even, "b").otherwise("a")).alias("label"), F.when(even, half).otherwise(half + 1).alias("genome"))


_AT = lambda s, i, k: f"(instr('TCAG', substr({s}, {i} + {k}, 1)) - 1)"


@query(f"WITH {B.OLIGOS} SELECT id, array_to_string(list_transform(range(1, 31, 3), lambda i: substr('{STANDARD_CODE}', ({_AT('seq', 'i', 0)} * 16 + {_AT('seq', 'i', 1)} * 4 + {_AT('seq', 'i', 2)} + 1)::INTEGER, 1)), '') AS protein FROM oligos")
def codon_translate(spark, d):
    return B.oligos(spark, d).select("id", translate(F.col("seq")).alias("protein"))


@query(
    f"WITH {B.CONTIGS}, s AS (SELECT contig, '+' AS strand, seq FROM contigs UNION ALL SELECT contig, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM contigs), "
    "f AS (SELECT contig, strand, frame, seq FROM s, (SELECT unnest([0, 1, 2]) AS frame)), "
    f"c AS (SELECT contig, strand, frame, k, substr('{STANDARD_CODE}', ({_AT('seq', 'frame + 3 * k + 1', 0)} * 16 + {_AT('seq', 'frame + 3 * k + 1', 1)} * 4 + {_AT('seq', 'frame + 3 * k + 1', 2)} + 1)::INTEGER, 1) AS aa "
    "FROM (SELECT *, unnest(range(0, (length(seq) - frame) // 3)) AS k FROM f)), "
    "g AS (SELECT *, coalesce(sum((aa = '*')::INTEGER) OVER (PARTITION BY contig, strand, frame ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM c), "
    "m AS (SELECT contig, strand, frame, piece, min(k) FILTER (aa = 'M') AS a, max(k) AS z, max((aa = '*')::INTEGER) AS stopped FROM g GROUP BY ALL) "
    "SELECT contig, strand, frame::INTEGER AS frame, (frame + 3 * a)::INTEGER AS start, (z - a + 1 - stopped)::INTEGER AS aa FROM m WHERE a IS NOT NULL AND z - a + 1 - stopped >= 12"
)
def orfs(spark, d):
    """Stretches from a first M to the stop or the frame's end, of at least 12 amino acids, in six frames."""
    return reading_frames(B.contigs(spark, d), 12)
