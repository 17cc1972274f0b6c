"""File formats as DataFrames. Each parser takes a DataFrame with a `value` column of text, so batch and streaming readers share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.functions import sequence as S
from strandloom.functions import statistics as St
from strandloom.functions.sequence import gff_decode


def read_fasta(spark: SparkSession, paths: str | list[str], stream: bool = False) -> DataFrame:
    """(contig, info, seq, file): records of plain or gzipped FASTA. A name ends at the first white space; case is kept.

    Records are split where a line starts with '>', so a file is read by as many tasks as it has blocks; a gzipped one by one task. A
    record is one row: contigs of over 2 GB don't fit.
    """
    reader = (spark.readStream if stream else spark.read).option("lineSep", RECORD)
    return parse_fasta(reader.text(paths).select("value", F.col("_metadata.file_path").alias("file")))


#: What lies between two records of a file.
RECORD = "\n>"


def parse_fasta(records: DataFrame) -> DataFrame:
    """Records without the '>' of their start, which only a file's first one still has. What stands before a file's first record is
    left out."""
    value = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(value, "^([^\\r\\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(value, "^[^\\r\\n]*", ""), "\\s", "")
    extra = [c for c in records.columns if c != "value"]
    rows = records.where(F.length(F.trim("value")) > 0)
    return rows.select(F.regexp_extract(head, "^(\\S*)", 1).alias("contig"), F.trim(F.regexp_replace(head, "^\\S*", "")).alias("info"), seq.alias("seq"), *extra)


def require_unique(contigs: DataFrame, name: str = "contig") -> DataFrame:
    """contigs; an error if a name repeats."""
    twice = contigs.groupBy(name).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"contig names repeat: {', '.join(str(r[0]) for r in twice)}")
    return contigs


def rounds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(round, contig, seq): one round for each file, in the given order."""
    out = None
    for i, p in enumerate(paths):
        one = read_fasta(spark, p).select(F.lit(i).alias("round"), "contig", "seq")
        out = one if out is None else out.unionByName(one)
    return out


def parse_gff(lines: DataFrame, tag: str = "ID") -> DataFrame:
    """(contig, source, type, start, end, score, strand, frame, attributes, name): 0-based half-open; '.' is null; comments and lines of
    under 7 columns are left out; name is null without the tag."""
    f = F.split("value", "\t")
    at = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit("."))
    pairs = F.filter(F.transform(F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ";\\s*"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("=")))
    keys = F.transform(pairs, lambda x: F.trim(F.substring_index(x, "=", 1)))
    entries = F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.trim(F.element_at(F.transform(F.filter(pairs, lambda x: F.trim(F.substring_index(x, "=", 1)) == k), lambda x: F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x))), -1)))))
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.size(f) > 6)).select("*", entries.alias("attributes"))
    return rows.select(
        F.get(f, F.lit(0)).alias("contig"), at(1).alias("source"), at(2).alias("type"), (at(3).cast("int") - 1).alias("start"), at(4).cast("int").alias("end"),
        at(5).alias("score"), at(6).alias("strand"), at(7).alias("frame"), "attributes", gff_decode(F.try_element_at("attributes", F.lit(tag))).alias("name"),
    )


def read_gff(spark: SparkSession, path: str, types: list[str] | None = None, selected: list[str] | None = None, tag: str = "ID") -> DataFrame:
    """Features of the types (all if None or 'all'), and of the names if given."""
    rows = parse_gff(spark.read.text(path), tag)
    if types and "all" not in types:
        rows = rows.where(F.col("type").isin(types))
    return rows.where(F.col("name").isin(selected)) if selected else rows


def parse_homologs(lines: DataFrame) -> DataFrame:
    """(gene, feature): the first column is the gene, the others its features."""
    f = F.split("value", "\t")
    return lines.where(F.size(f) > 1).select(F.get(f, F.lit(0)).alias("gene"), F.explode(F.filter(F.slice(f, 2, F.size(f) - 1), lambda x: x != "")).alias("feature"))


def homolog_groups(homologs: DataFrame) -> DataFrame:
    """(feature, gene, group): rows that share a feature are one group, however far; group is its smallest feature hash."""
    from strandloom.operators.components import connected_components

    h = homologs.select("gene", "feature", F.xxhash64("feature").alias("f"), F.xxhash64(F.concat(F.lit("gene "), F.col("gene"))).alias("g"))
    c = connected_components(h, "f", "g").withColumnRenamed("node", "f")
    return h.join(c, "f").groupBy("feature").agg(F.max("gene").alias("gene"), F.min("component").alias("group"))


BLAST_COLUMNS = ["query", "subject", "pident", "length", "mismatch", "gapopen", "q1", "q2", "s1", "s2", "evalue", "bits"]


def parse_blast(lines: DataFrame) -> DataFrame:
    """Tabular BLAST hits: ranges are 0-based half-open, flags 16 for the minus strand."""
    f = F.split("value", "\t")
    at = lambda n: F.get(f, F.lit(BLAST_COLUMNS.index(n)))
    num = lambda n: at(n).cast("int")
    return lines.where(~F.startswith("value", F.lit("#")) & (F.size(f) == len(BLAST_COLUMNS))).select(
        at("query").alias("query"), at("subject").alias("subject"), (F.least(num("q1"), num("q2")) - 1).alias("q_start"), F.greatest(num("q1"), num("q2")).alias("q_end"),
        (F.least(num("s1"), num("s2")) - 1).alias("s_start"), F.greatest(num("s1"), num("s2")).alias("s_end"), F.when(num("s1") > num("s2"), 16).otherwise(0).alias("flags"),
        at("evalue").cast("double").alias("evalue"), at("bits").cast("double").alias("bits"), num("length").alias("length"),
    )


def parse_sam(lines: DataFrame) -> DataFrame:
    """(query, flags, subject, start, end, cigar, seq, tags): mapped rows, 0-based; the end follows from the cigar."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.where(~F.startswith("value", F.lit("@")) & (F.size(f) > 5)).where(at(2) != "*")
    start = at(3).cast("int") - 1
    return rows.select(
        at(0).alias("query"), at(1).cast("int").alias("flags"), at(2).alias("subject"), start.alias("start"), (start + C.subject_length(at(5))).alias("end"),
        at(5).alias("cigar"), at(9).alias("seq"), F.when(F.size(f) > 11, F.slice(f, 12, F.size(f))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def with_expect(hits: DataFrame, score: Column, query_length: Column, k: float, lam: float, h: float, database: float, sequences: int) -> DataFrame:
    """hits with the E-value of a raw score, from the effective lengths of query and database."""
    kk, ll, hh, db, n = (F.lit(x) for x in (k, lam, h, database, sequences))
    length = St.hsp_length(kk, query_length, db, hh)
    m = St.effective_query_length(query_length, length, kk)
    return hits.withColumn("evalue", St.raw_score_expect(score, kk, ll, m, St.effective_database_length(db, length, n, kk)))


def expand_alternatives(sam: DataFrame) -> DataFrame:
    """sam rows, and one more for each `contig,±position,cigar,edits;` of an XA tag. Where the strand differs the sequence turns."""
    xa = F.get(F.filter("tags", lambda t: F.startswith(t, F.lit("XA:Z:"))), F.lit(0))
    others = F.filter(F.split(F.substring(F.coalesce(xa, F.lit("")), 6, 1 << 30), ";"), lambda x: x != "")
    own = F.struct(F.col("subject").alias("subject"), F.col("start").alias("start"), F.col("flags").alias("flags"), F.col("cigar").alias("cigar"))

    def other(x: Column) -> Column:
        p = F.split(x, ",")
        minus = F.startswith(p[1], F.lit("-"))
        flags = F.col("flags").bitwiseAND(~16).bitwiseOR(F.when(minus, 16).otherwise(0))
        return F.struct(p[0].alias("subject"), (F.abs(p[1].cast("int")) - 1).alias("start"), flags.alias("flags"), p[2].alias("cigar"))

    rows = sam.withColumn("x", F.explode(F.concat(F.array(own), F.transform(others, other))))
    turned = F.col("flags").bitwiseAND(16) != F.col("x.flags").bitwiseAND(16)
    return rows.select(
        "query", F.col("x.flags").alias("flags"), F.col("x.subject").alias("subject"), F.col("x.start").alias("start"), (F.col("x.start") + C.subject_length(F.col("x.cigar"))).alias("end"),
        F.col("x.cigar").alias("cigar"), F.when(turned, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
    )


def parse_sites(lines: DataFrame) -> DataFrame:
    """(pattern, contig, start, site, strand, mismatches) of tabular off-target hits; lower-case letters are mismatches."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    return lines.where(F.size(f) >= 6).select(at(0).alias("pattern"), at(1).alias("contig"), at(2).cast("int").alias("start"), at(3).alias("site"), at(4).alias("strand"), at(5).cast("int").alias("mismatches"))


def parse_clustal(lines: DataFrame) -> DataFrame:
    """(name, seq) of a CLUSTAL alignment from (value, number of the line): blocks are joined in order."""
    m = "^(\\S+)\\s+([A-Za-z.\\-]+)(?:\\s+\\d+)?\\s*$"
    rows = lines.where(F.col("value").rlike(m) & ~F.startswith("value", F.lit("CLUSTAL")))
    part = rows.select("number", F.regexp_extract("value", m, 1).alias("name"), F.regexp_extract("value", m, 2).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("number", "part")))
    return part.groupBy("name").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("seq"))


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table of weights with '#' comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema=schema)


def last_of_each(contigs: DataFrame, order: str = "number", name: str = "contig") -> DataFrame:
    """contigs with the last of the records that share a name, by a column that tells their order in the file."""
    others = [c for c in contigs.columns if c not in (name, order)]
    return contigs.groupBy(name).agg(F.max_by(F.struct(*others), order).alias("x")).select(name, "x.*")


def parse_gff_places(lines: DataFrame, kind: str, tag: str = "ID") -> DataFrame:
    """(name, contig, start, end, strand) of one type's features by a plain search for the tag: up to the next semicolon. Lines without it are
    left out."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    name = F.regexp_extract(at(8), f"(?:^|;)\\s*{tag}=([^;]*)", 1)
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.size(f) > 8) & (at(2) == kind))
    return rows.select(name.alias("name"), at(0).alias("contig"), (at(3).cast("int") - 1).alias("start"), at(4).cast("int").alias("end"), at(6).alias("strand")).where("name <> ''")


def parse_codes(blocks: DataFrame) -> DataFrame:
    """(number, name, codon, acid, start) of genetic codes, one block of text a row: a line with number and name, then `label = letters` lines of
    acids (AAs), starts (Starts) and the three bases (Base1 to Base3)."""
    line = lambda label: F.regexp_extract("value", f"(?m)^\\s*{label}\\s*=\\s*(\\S+)", 1)
    parts = [S.letters(line(x)) for x in ("Base1", "Base2", "Base3", "AAs", "Starts")]
    rows = blocks.where(F.col("value").rlike("^\\s*\\d+\\."))
    head = rows.select(F.regexp_extract("value", "^\\s*(\\d+)\\.", 1).cast("int").alias("number"), F.trim(F.regexp_extract("value", "^\\s*\\d+\\.\\s*([^(\\r\\n]*)", 1)).alias("name"), F.inline(F.arrays_zip(*(p.alias(f"c{i}") for i, p in enumerate(parts)))))
    cols = head.columns[2:]
    return head.select("number", "name", F.concat(*cols[:3]).alias("codon"), F.col(cols[3]).alias("acid"), (F.col(cols[4]) == "M").alias("start"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Genetic codes of a file whose blocks are parted by empty lines."""
    return parse_codes(spark.read.option("lineSep", "\n\n").text(path))


def known_results(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """rows with what an earlier run wrote about their key; null where it knows nothing."""
    return rows.join(spark.read.parquet(path), key, "left")
