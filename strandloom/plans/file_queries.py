"""Queries over text formats; the lines are made from tables, so that SQL can check the parsed rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import cigar as C
from strandloom.functions import sequence as S
from strandloom.operators.target_finder import number_rows
from strandloom.plans import api
from strandloom.plans import bridge as B
from strandloom.plans.registry import query, table
from strandloom.sources import readers as R
from strandloom.session import scratch_path
from strandloom.sources import sinks as K


def _gff_lines(spark, d):
    f = B.features(spark, d)
    line = F.concat_ws(
        "\t", "contig", F.lit("."), F.when(F.col("strand") == "+", "gene").otherwise("CDS"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"),
        F.concat(F.lit("ID="), "feature", F.lit(";Name="), "gene", F.lit("; Alias=a"), F.col("end").cast("string")),
    )
    return f.select(line.alias("value"))


@query(f"WITH {B.FEATURES} SELECT contig, NULL::VARCHAR AS source, CASE WHEN strand = '+' THEN 'gene' ELSE 'CDS' END AS type, start, \"end\", strand, feature AS name, 'a' || \"end\" AS alias FROM features")
def gff_parse(spark, d):
    rows = R.parse_gff(_gff_lines(spark, d))
    return rows.select("contig", "source", "type", "start", "end", "strand", "name", F.col("attributes")["Alias"].alias("alias"))


_GFF_TEXTS = "v AS (SELECT feature, lower(unnest([feature, gene, 'a' || \"end\"])) AS t FROM features)"


@query(f"""WITH {B.FEATURES}, {_GFF_TEXTS}, hit AS (SELECT DISTINCT feature FROM v WHERE regexp_matches(t, '^f1$|a99$')),
  link AS (SELECT DISTINCT t FROM v JOIN hit USING (feature))
  SELECT DISTINCT v.feature FROM v JOIN link ON contains(v.t, link.t)""")
def gff_search_linked(spark, d):
    """Features with an attribute that a query matches, and those with an attribute that holds one of their linked values."""
    rows = api.find_feature(R.parse_gff(_gff_lines(spark, d)), ["^F1$", "A99$"])
    return rows.select(F.col("name").alias("feature"))


@query("""SELECT l_orderkey, l_linenumber, least(a, b) - 1 AS s_start, greatest(a, b) AS s_end, CASE WHEN a > b THEN 16 ELSE 0 END AS flags, l_tax AS evalue FROM
  (SELECT l_orderkey, l_linenumber, l_tax, (l_partkey + 1)::INTEGER AS a, (l_suppkey * 20 + 1)::INTEGER AS b FROM lineitem)""")
def blast_record(spark, d):
    t = table(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", text("l_orderkey"), text("l_linenumber"), F.lit("99.0"), F.lit("20"), F.lit("0"), F.lit("0"), F.lit("1"), F.lit("20"), (F.col("l_partkey") + 1).cast("string"), (F.col("l_suppkey") * 20 + 1).cast("string"), text("l_tax"), F.lit("40"))
    rows = R.parse_blast(t.select(line.alias("value")))
    return rows.select(F.col("query").cast("long").alias("l_orderkey"), F.col("subject").cast("int").alias("l_linenumber"), "s_start", "s_end", "flags", "evalue")


def _sam_lines(spark, d):
    o = B.oligos(spark, d)
    alts = F.array_join(F.transform(S.positions(F.lit(1), (F.col("id") % 4).cast("int")), lambda k: F.concat(F.lit("c"), k.cast("string"), F.lit(","), F.when(k % 2 == 1, "-").otherwise("+"), (F.col("id") + k).cast("string"), F.lit(",16M2D16M,1;"))), "")
    tag = F.when(F.col("id") % 4 > 0, F.concat(F.lit("\tXA:Z:"), alts)).otherwise("")
    return o.select(F.concat(F.concat_ws("\t", F.col("id").cast("string"), F.lit("0"), F.lit("c0"), F.lit("11"), F.lit("37"), F.lit("32M"), F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*")), tag).alias("value"))


@query(f"""WITH {B.OLIGOS}, a AS (SELECT id, seq, 0 AS k FROM oligos UNION ALL SELECT id, seq, unnest(range(1, (id % 4 + 1)::BIGINT)) FROM oligos)
  SELECT id, 'c' || k AS subject, CASE WHEN k = 0 THEN 10 ELSE id + k - 1 END::INTEGER AS start, CASE WHEN k = 0 THEN 42 ELSE id + k - 1 + 34 END::INTEGER AS "end", CASE WHEN k % 2 = 1 THEN 16 ELSE 0 END AS flags,
    CASE WHEN k % 2 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM a""")
def bwa_xa_expand(spark, d):
    rows = R.expand_alternatives(R.parse_sam(_sam_lines(spark, d)))
    return rows.select(F.col("query").cast("long").alias("id"), "subject", "start", "end", "flags", "seq")


@query(f"WITH {B.OLIGOS} SELECT id, 32 AS q, 32 AS s, 'seq' || id AS name FROM oligos")
def sam_scan(spark, d):
    rows = R.parse_sam(_sam_lines(spark, d))
    return rows.select(F.col("query").cast("long").alias("id"), C.query_length(F.col("cigar")).alias("q"), C.subject_length(F.col("cigar")).alias("s"), F.concat(F.lit("seq"), "query").alias("name"))


@query(f"WITH {B.CONTIGS} SELECT contig, seq, 'nt=' || length(seq) || ' >x' AS info FROM contigs")
def fasta_round_trip(spark, d):
    """Contigs written as wrapped FASTA files and read again; a '>' inside a header starts no record."""
    c = B.contigs(spark, d).withColumn("contig", F.replace("contig", F.lit("#"), F.lit("_")))
    text = K.fasta_text(F.col("contig"), F.col("seq"), F.concat(F.lit("nt="), F.length("seq").cast("string"), F.lit(" >x")), 60)
    path = scratch_path(spark, "fasta")
    K.write_text(c, text, path)
    return R.read_fasta(spark, path).select(F.replace("contig", F.lit("_"), F.lit("#")).alias("contig"), "seq", "info")


_CODED = "replace(" * 12 + "t" + "".join(f", '{a}', '{b}')" for a, b in (("%", "%25"), (" ", "%20"), (";", "%3B"), ("=", "%3D"), ("\"", "%22"), ("(", "%28"), (")", "%29"), ("[", "%5B"), ("]", "%5D"), ("\\", "%5C"), (",", "%2C"), ("&", "%26")))


@query(f"""WITH x AS (SELECT p_partkey, p_name || ';' || p_type || '=%("a",[b])\\&%41' || chr(10) AS t FROM part)
  SELECT p_partkey, replace({_CODED}, chr(10), '%0a') AS encoded, replace(t, chr(10), '%0a') AS decoded FROM x""")
def gff_encode(spark, d):
    raw = F.concat("p_name", F.lit(";"), "p_type", F.lit('=%("a",[b])\\&%41\n'))
    return table(spark, d, "part").select("p_partkey", S.gff_encode(raw).alias("encoded"), S.gff_decode(S.gff_encode(raw)).alias("decoded"))


@query(f"""WITH {B.FEATURES} SELECT feature, feature || ':' || contig || ':' || strand || ':' || start || '..' || "end" AS location FROM features""")
def location_labels(spark, d):
    f = B.features(spark, d)
    return f.select("feature", K.location_text(F.col("feature"), F.col("contig"), F.col("strand"), F.col("start"), F.col("end")).alias("location"))


@query(f"WITH {B.OLIGOS} SELECT id, '@' || id || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', 32) AS record FROM oligos")
def fastq_records(spark, d):
    return B.oligos(spark, d).select("id", K.fastq_text(F.col("id").cast("string"), F.col("seq")).alias("record"))


@query("""WITH g AS (SELECT s_suppkey, substr(s_name, 1, length(s_name) - 1) AS stem FROM supplier), l AS (SELECT *, (stem <> lag(stem) OVER (ORDER BY s_suppkey))::INTEGER AS new FROM g)
  SELECT s_suppkey, stem, coalesce(sum(new) OVER (ORDER BY s_suppkey), 0)::BIGINT AS grp FROM l""")
def gff_homologs(spark, d):
    """Neighbouring genes whose names differ in the last letter only form a group, numbered in order."""
    g = table(spark, d, "supplier").select("s_suppkey", F.expr("substring(s_name, 1, length(s_name) - 1)").alias("stem"))
    near = number_rows(g, ["s_suppkey"], "i")
    before = near.select((F.col("i") + 1).alias("i"), F.col("stem").alias("last"))
    new = near.join(before, "i", "left").withColumn("new", F.when(F.col("last") != F.col("stem"), 1).otherwise(0))
    # a running sum without one task for all rows: sums inside blocks of neighbours, and blocks' sums before them
    block = F.floor(F.col("i") / 4096)
    new = new.withColumn("block", block)
    inside = F.sum("new").over(Window.partitionBy("block").orderBy("i"))
    before_block = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = new.groupBy("block").agg(F.sum("new").alias("n")).select("block", F.coalesce(F.sum("n").over(before_block), F.lit(0)).alias("base"))
    return new.join(blocks, "block").select("s_suppkey", "stem", (inside + F.col("base")).alias("grp"))
