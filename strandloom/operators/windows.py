"""Contigs in short overlapping chunks, so that work is linear in contig length and spreads over the cluster.

A substring of a string walks to its place letter by letter; one of bytes doesn't. So chunks are cut from the bytes of a contig, and places are
looked at only inside chunks of a few hundred letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S

#: Letters of a chunk.
CHUNK = 512


def cut(seq: Column, first: Column, length: Column) -> Column:
    """seq[first : first + length] of plain letters, without a walk."""
    return F.substring(seq.cast("binary"), first.cast("int") + 1, length.cast("int")).cast("string")


def tasks(contigs: DataFrame) -> int:
    """To how many tasks chunks are dealt: contigs may be few and long."""
    spark = contigs.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(contigs: DataFrame, size: int = CHUNK, reach: int = 0, before: int = 0, spread: int | None = None, contig: str = "contig", seq: str = "seq") -> DataFrame:
    """Other columns of contigs, n (the contig's length), at, first and text: a chunk starts at `at`; text runs from `first`, up to `before` letters
    earlier, to `reach` letters past the chunk's end. spread: deal the chunks to so many tasks; 0: leave them where they are."""
    others = [c for c in contigs.columns if c != seq]
    # Spark puts a column of a contig off until a chunk needs it, and so would copy the whole contig for each chunk; a nondeterministic one isn't put off,
    # which a stream doesn't allow
    once = lambda c: c if contigs.isStreaming else F.when(F.monotonically_increasing_id() >= 0, c)
    whole = contigs.select(*others, once(F.length(seq)).alias("n"), once(F.col(seq).cast("binary")).alias("__bytes"))
    n = F.col("n")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = whole.select(*others, "n", "__bytes", F.explode(starts).alias("at"))
    first = F.greatest(F.col("at") - before, F.lit(0))
    text = F.substring("__bytes", first + 1, F.col("at") - first + size + reach).cast("string")
    out = rows.select(*others, "n", "at", first.alias("first"), text.alias("text"))
    spread = tasks(contigs) if spread is None else spread
    return out.repartition(spread, contig, "at") if spread else out


def windows(contigs: DataFrame, width: int, size: int = CHUNK, spread: int | None = None) -> DataFrame:
    """Other columns of contigs, i and window: every full window of a contig, from 0."""
    others = [c for c in contigs.columns if c != "seq"]
    rows = chunks(contigs, size, width - 1, 0, spread)
    places = S.positions(F.lit(0), F.least(F.length("text") - width, F.lit(size - 1)))
    return rows.select(*others, "at", "text", F.explode(places).alias("k")).select(*others, (F.col("at") + F.col("k")).alias("i"), F.substring("text", F.col("k") + 1, F.lit(width)).alias("window"))


def near(features: DataFrame, contigs: DataFrame, before: int, after: int) -> DataFrame:
    """features (contig, start, end, ...) on contigs that are there, moved to the letters around them: seq runs from base, `before` letters before start
    (0 at the least), to `after` letters past end, and start and end count from base. Features meet chunks by equality, so no row holds a whole contig."""
    base = F.greatest(F.col("start") - before, F.lit(0)).cast("int")
    length = F.greatest(F.col("end") + after - base, F.lit(0)).cast("int")
    # a chunk is as long as what the longest feature needs, so with its reach a letter is moved about twice at most
    longest = features.agg(F.max(length)).first()[0] or 0
    size = max(CHUNK, longest)
    there = features.join(contigs.select("contig"), "contig").withColumns({"base": base, "__length": length, "at": (F.floor(base / size) * size).cast("int")})
    met = there.join(chunks(contigs.select("contig", "seq"), size, longest, 0, 0).drop("n", "first"), ["contig", "at"], "left")
    seq = F.coalesce(cut(F.col("text"), F.col("base") - F.col("at"), F.col("__length")), F.lit(""))
    moved = {"start": F.col("start") - F.col("base"), "end": F.col("end") - F.col("base")}
    return met.withColumn("seq", seq).select(*(moved[c].alias(c) if c in moved else c for c in features.columns), "base", "seq")
