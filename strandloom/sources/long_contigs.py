"""FASTA of contigs of any length: lines become overlapping chunks, without a row that holds a whole contig.

A file's blocks are read by as many tasks. A line's contig and place follow from the headers and letters before it: inside a block from the
block's own lines, across blocks from one row for each block (its last header, and letters since).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import motif as M
from strandloom.operators.target_finder import FLANK, find_in_chunks
from strandloom.operators.windows import CHUNK


def fasta_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(contig, start, text): the sequence lines with their places, from 0. Lines before a file's first header are left out."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.regexp_replace("value", "\\s+$", "").alias("line"))
    head = F.startswith("line", F.lit(">"))
    # a record's number in its block; 0 is what the block before has begun
    inside = Window.partitionBy("file", "block").orderBy("k")
    rows = raw.withColumns({"record": F.sum(head.cast("int")).over(inside), "contig": F.when(head, F.regexp_extract("line", "^>(\\S*)", 1)), "n": F.when(head, 0).otherwise(F.length("line")).cast("long")})
    earlier = Window.partitionBy("file", "block", "record").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"own": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "name": F.last("contig", True).over(inside)})
    tail = rows.groupBy("file", "block").agg(F.max("record").alias("records"), F.max_by("name", "k").alias("last"), F.max_by(F.col("own") + F.col("n"), "k").alias("since"))
    # one row for each block of a file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    tail = tail.withColumns({"header": F.last("last", True).over(before), "run": F.sum((F.col("records") > 0).cast("int")).over(upto)})
    in_run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = tail.withColumn("reached", F.sum("since").over(in_run))
    tail = tail.withColumn("carried", F.coalesce(F.lag("reached").over(Window.partitionBy("file").orderBy("block")), F.lit(0)))
    joined = rows.join(tail.select("file", "block", "header", "carried"), ["file", "block"])
    name = F.when(F.col("record") > 0, F.col("name")).otherwise(F.col("header"))
    start = F.col("own") + F.when(F.col("record") > 0, 0).otherwise(F.col("carried"))
    return joined.where("n > 0").select(name.alias("contig"), start.alias("start"), F.col("line").alias("text")).where("contig is not null")


def line_chunks(lines: DataFrame, size: int = CHUNK, reach: int = 0, before: int = 0) -> DataFrame:
    """(contig, at, first, text) as operators.windows.chunks gives them, from lines: each line goes to every chunk that it is a part of. Places are
    longs."""
    end = F.col("start") + F.length("text")
    low = F.greatest(F.floor((F.col("start") - reach - size) / size) + 1, F.lit(0).cast("long"))
    high = F.floor((end - 1 + before) / size)
    each = lines.select("contig", "start", "text", F.explode(F.sequence(low, high)).alias("c"))
    first = F.greatest(F.col("c") * size - before, F.lit(0).cast("long"))
    last = F.col("c") * size + size + reach
    skip = F.greatest(first - F.col("start"), F.lit(0).cast("long")).cast("int")
    piece = F.substring("text", skip + 1, (last - F.greatest(first, F.col("start"))).cast("int"))
    own = F.max(F.when((F.col("start") < (F.col("c") + 1) * size) & (end > F.col("c") * size), True))
    grouped = each.groupBy("contig", "c").agg(F.array_sort(F.collect_list(F.struct("start", piece.alias("piece")))).alias("p"), own.alias("own"))  # a chunk's few lines
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return grouped.where("own").select("contig", (F.col("c") * size).alias("at"), F.greatest(F.col("c") * size - before, F.lit(0).cast("long")).alias("first"), text.alias("text"))


def find_targets_in_files(spark: SparkSession, paths: str | list[str], motifs: list[str], case: str = "ignore") -> DataFrame:
    """operators.target_finder.find_targets over files whose contigs may be of any length."""
    reach = max(M.parse(m).longest for m in motifs) + FLANK
    return find_in_chunks(line_chunks(fasta_lines(spark, paths), CHUNK, reach, reach), motifs, CHUNK, case)
