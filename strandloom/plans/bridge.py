"""Sequence data as pure functions of the keys of ordinary tables, the same in Spark and in DuckDB.

Digits of an md5 digest become letters, so every part has a 32-letter sequence; parts of a brand, in key order, make a contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.plans.registry import table

HEX = "0123456789abcdef"
DNA, AMBIGUOUS, MIXED = "ACGT" * 4, "ACGTRYMKWSBDHVNA", "ACGTacgtACGTacgt"
#: Letters for sequences with few ambiguous ones; the last digit stands for one of these, by the key.
FEW, RARE = "ACGTACGTACGTACG?", "RYMKWSBDHVN"


def letters_of(key: Column, prefix: str = "", alphabet: str = DNA) -> Column:
    text = key.cast("string")
    return F.translate(F.md5(F.concat(F.lit(prefix), text) if prefix else text), HEX, alphabet)


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """(contig, seq): one for each brand. The parts of a contig meet in one row, as a FASTA record would."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", letters_of(F.col("p_partkey")).alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct("p_partkey", "s")))
    return p.groupBy(F.col("p_brand").alias("contig")).agg(F.array_join(ordered.getField("s"), "").alias("seq"))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """(id, few, cased): for each part 32 letters of which some two are ambiguous, and 32 in upper, lower or mixed case."""
    k = F.col("id")
    few = F.replace(letters_of(k, "r", FEW), F.lit("?"), F.substring(F.lit(RARE), (k % len(RARE) + 1).cast("int"), F.lit(1)))
    cased = F.when(k % 3 == 0, F.upper("mixed")).when(k % 3 == 1, F.lower("mixed")).otherwise(F.col("mixed"))
    return oligos(spark, d).select("id", few.alias("few"), cased.alias("cased"))


SPARSE = (
    f"sparse AS (SELECT p_partkey AS id, replace(translate(md5('r' || p_partkey), '{HEX}', '{FEW}'), '?', substr('{RARE}', (p_partkey % {len(RARE)} + 1)::INTEGER, 1)) AS few, "
    f"CASE p_partkey % 3 WHEN 0 THEN upper(m) WHEN 1 THEN lower(m) ELSE m END AS cased FROM (SELECT p_partkey, translate(md5('m' || p_partkey), '{HEX}', '{MIXED}') AS m FROM part))"
)

CONTIGS = f"contigs AS (SELECT p_brand AS contig, string_agg(translate(md5(p_partkey::VARCHAR), '{HEX}', '{DNA}'), '' ORDER BY p_partkey) AS seq FROM part GROUP BY p_brand)"


def oligos(spark: SparkSession, d: str) -> DataFrame:
    """(id, seq, amb, mixed): for each part 32 plain letters, 32 of the whole alphabet, 32 of both cases."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), letters_of(k, "o").alias("seq"), letters_of(k, "i", AMBIGUOUS).alias("amb"), letters_of(k, "m", MIXED).alias("mixed"))


OLIGOS = (
    f"oligos AS (SELECT p_partkey AS id, translate(md5('o' || p_partkey), '{HEX}', '{DNA}') AS seq, "
    f"translate(md5('i' || p_partkey), '{HEX}', '{AMBIGUOUS}') AS amb, translate(md5('m' || p_partkey), '{HEX}', '{MIXED}') AS mixed FROM part)"
)


def guides(spark: SparkSession, d: str) -> DataFrame:
    """(id, upstream, spacer, pam, downstream, off): a 20-letter spacer in context, and a target that shares its start."""
    o, k = oligos(spark, d), F.col("id")
    other = letters_of(k, "x")
    keep = (k % 21).cast("int")
    spacer = F.substring("seq", 5, 20)
    return o.select(
        "id", F.substring("seq", 1, 4).alias("upstream"), spacer.alias("spacer"), F.substring("seq", 25, 3).alias("pam"), F.substring("seq", 28, 5).alias("downstream"),
        F.concat(F.left(spacer, keep), F.substring(other, keep + 1, 20 - keep)).alias("off"),
    )


GUIDES = (
    "guides AS (SELECT id, substr(seq, 1, 4) AS upstream, substr(seq, 5, 20) AS spacer, substr(seq, 25, 3) AS pam, substr(seq, 28, 5) AS downstream, "
    f"left(substr(seq, 5, 20), (id % 21)::INTEGER) || substr(translate(md5('x' || id), '{HEX}', '{DNA}'), (id % 21)::INTEGER + 1, 20 - (id % 21)::INTEGER) AS off FROM oligos)"
)


def features(spark: SparkSession, d: str) -> DataFrame:
    """(feature, gene, contig, start, end, strand): one for each part, on its brand's contig, half-open from 0."""
    p = table(spark, d, "part")
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    start = (at * 32 + (F.col("p_partkey") % 20)).cast("int")
    return p.select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature"), F.col("p_type").alias("gene"), F.col("p_brand").alias("contig"),
        start.alias("start"), (start + 10 + F.col("p_size")).alias("end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


FEATURES = (
    "features AS (SELECT 'f' || p_partkey AS feature, p_type AS gene, p_brand AS contig, "
    "((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 32 + p_partkey % 20)::INTEGER AS start, "
    "((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 32 + p_partkey % 20)::INTEGER + 10 + p_size AS \"end\", "
    "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"
)


def hits(spark: SparkSession, d: str) -> DataFrame:
    """(hit, target, contig, start, end, score): alignments of targets, one for each order line with a part's brand."""
    line = table(spark, d, "lineitem")
    size = contigs(spark, d).select("contig", F.length("seq").alias("n"))
    rows = line.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(size, F.col("p_brand") == F.col("contig"))
    start = F.pmod(F.col("l_orderkey") * 37 + F.col("l_suppkey"), F.col("n") - 23).cast("int")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hit"), (F.col("l_suppkey") % 50).alias("target"), "contig",
        start.alias("start"), (start + 23).alias("end"), (F.col("l_quantity") * 2).alias("score"),
    )


HITS = (
    "hits AS (SELECT l_orderkey * 10 + l_linenumber AS hit, l_suppkey % 50 AS target, contig, ((l_orderkey * 37 + l_suppkey) % (length(seq) - 23))::INTEGER AS start, "
    "((l_orderkey * 37 + l_suppkey) % (length(seq) - 23))::INTEGER + 23 AS \"end\", l_quantity * 2 AS score "
    "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN contigs ON contig = p_brand)"
)
