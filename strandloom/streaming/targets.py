"""Targets of a folder of FASTA files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators.target_finder import find_targets
from strandloom.sources.readers import RECORD, parse_fasta


def stream_targets(spark: SparkSession, folder: str, motifs: list[str]) -> DataFrame:
    """A streaming DataFrame of targets; the search keeps no state, so each file's records come out once."""
    lines = spark.readStream.option("lineSep", RECORD).text(folder)
    return find_targets(parse_fasta(lines.select("value")), motifs, spread=0)
