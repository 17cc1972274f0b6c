"""Nuclease targets on both strands.

Every start gives at most one match, the first spacer and PAM that fit, as the motif's alternatives are tried in
sorted order. Contigs are cut into short overlapping chunks that spread over the cluster; a match belongs to the chunk it starts in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import motif as M
from strandloom.functions import sequence as S
from strandloom.operators.windows import CHUNK, chunks
from strandloom.session import materialise

FLANK = 10


def search(contigs: DataFrame, motif: str, chunk: int = CHUNK, spread: int | None = None, case: str = "ignore") -> DataFrame:
    """(contig, strand, start, end, upstream, downstream, seq, side, spacer, pam, motif) of every target of (contig, seq).

    Coordinates are on the given strand's contig, half-open from 0. Upstream of '+' (downstream of '-') is empty nearer than
    10 letters to the contig's start. spread: to how many tasks chunks are dealt; 0 leaves them where they are. Letters other
    than A, C, G and T match only '.'.
    """
    reach = M.parse(motif).longest + FLANK
    return find_in_chunks(chunks(contigs.select("contig", "seq"), chunk, reach, reach, spread), [motif], chunk, case)


def find_in_chunks(rows: DataFrame, motifs: list[str], chunk: int, case: str = "ignore") -> DataFrame:
    """search() of several motifs over chunks (contig, at, first, text) with the longest motif and ten letters more at both sides."""
    sides = F.array(F.struct(F.lit("+").alias("strand"), F.col("text").alias("text")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.col("text")).alias("text")))
    both, out = rows.select("contig", "at", "first", F.inline(sides)), None
    for text in motifs:
        m = M.parse(text)
        found = _one_strand(both, m, chunk).where(S.case_rule(F.col("seq"), case)).withColumn("seq", F.upper("seq")).withColumn("motif", F.lit(m.text))
        out = found if out is None else out.unionByName(found)
    return out


def _one_strand(rows: DataFrame, m: M.Motif, chunk: int) -> DataFrame:
    text = F.col("text")
    least = min(map(len, m.spacers)) + min(map(len, m.pams))
    at = rows.withColumn("i", F.explode(S.positions(F.lit(0), F.length(text) - least)))
    window = F.substring(text, F.col("i") + 1, F.lit(m.longest))
    hit = at.withColumn("window", window).where(F.col("window").rlike("^(?i:" + m.pattern() + ")"))
    one, two = (F.regexp_extract("window", "^(?i:" + m.pattern() + ")", k) for k in (1, 2))
    hit = hit.withColumns({"a": one, "b": two}).withColumn("len", F.length("a") + F.length("b"))
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("first") + F.col("i")).otherwise(F.col("first") + F.length(text) - F.col("i") - F.col("len"))
    hit = hit.withColumn("start", start).where((F.col("start") >= F.col("at")) & (F.col("start") < F.col("at") + chunk))
    before = F.substring(text, F.greatest(F.col("i") - FLANK, F.lit(0)) + 1, F.least(F.col("i"), F.lit(FLANK)))
    after = F.substring(text, F.col("i") + F.col("len") + 1, F.lit(FLANK))
    near = F.col("start") < FLANK
    spacer, pam = ("a", "b") if m.side == ">" else ("b", "a")
    return hit.select(
        "contig", "strand", "start", (F.col("start") + F.col("len")).alias("end"),
        F.when(plus & near, "").otherwise(before).alias("upstream"), F.when(~plus & near, "").otherwise(after).alias("downstream"),
        F.concat("a", "b").alias("seq"), F.lit(m.side).alias("side"), F.upper(spacer).alias("spacer"), F.upper(pam).alias("pam"),
    )


def find_targets(contigs: DataFrame, motifs: list[str], **options) -> DataFrame:
    """Targets of all motifs, a row for each (contig, strand, start, end, motif, seq)."""
    out = search(contigs, motifs[0], **options)
    for m in motifs[1:]:
        out = out.unionByName(search(contigs, m, **options))
    return out


def distinct_targets(targets: DataFrame, prefix: str = "Target") -> DataFrame:
    """(seq, name, spacer, pam, locations): one row for each sequence. Names are numbered in order of first location.

    Numbering an unbounded set needs one order over all; here ranges are numbered apart and offset by the counts before them.
    """
    place = F.struct("contig", "start", "strand", "end")
    one = targets.groupBy("seq").agg(F.min(place).alias("first"), F.min("spacer").alias("spacer"), F.min("pam").alias("pam"), F.count_distinct(place).alias("locations"))
    return number_rows(one, ["first"], "index").select("seq", F.concat(F.lit(prefix + "-"), F.col("index").cast("string")).alias("name"), "spacer", "pam", "locations")


def number_rows(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """df with a gapless number from 0 in the given order, without putting all rows in one task. The order must be total."""
    from pyspark.sql.window import Window

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")  # a range's number must not depend on who reads it
    ranged = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))  # one row for each task
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")
