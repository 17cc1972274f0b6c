"""Open reading frames in all six frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import sequence as S
from strandloom.functions.translation import STANDARD_CODE, translate


def reading_frames(contigs: DataFrame, least: int, code: str = STANDARD_CODE) -> DataFrame:
    """(contig, strand, frame, start, aa): stretches from a first M to the stop or the frame's end, of at least `least` amino acids; start is on the
    strand's own reading. A frame is one row, as its stops cut it."""
    both = contigs.select("contig", F.lit("+").alias("strand"), "seq").unionByName(contigs.select("contig", F.lit("-").alias("strand"), S.reverse_complement(F.col("seq")).alias("seq")))
    frames = both.withColumn("frame", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    protein = translate(F.expr("substring(seq, frame + 1)"), code)
    pieces = frames.select("contig", "strand", "frame", F.posexplode(F.split(protein, "\\*")).alias("piece", "aa"))
    before = F.sum(F.length("aa") + 1).over(Window.partitionBy("contig", "strand", "frame").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    at = F.coalesce(before, F.lit(0)) + F.instr("aa", F.lit("M")) - 1
    out = pieces.select("contig", "strand", "frame", (F.col("frame") + 3 * at).cast("int").alias("start"), (F.length("aa") - F.instr("aa", F.lit("M")) + 1).alias("n"), F.contains("aa", F.lit("M")).alias("m"))
    return out.where(F.col("m") & (F.col("n") >= least)).select("contig", "strand", "frame", "start", F.col("n").alias("aa"))
