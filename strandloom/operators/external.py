"""External programs as operators: indexes, aligners and structure predictors that a user has installed.

A program runs on the executors, a batch of rows at a time: its input is a file in the task's own temporary folder, its output is read
back as rows, and the folder goes with the batch. Index files must be where every executor finds them.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Command lines by program; {index}, {query}, {out} and {threads} are filled in.
INDEX = {
    "blastn": ["makeblastdb", "-dbtype", "nucl", "-in", "{query}", "-out", "{index}"],
    "bowtie2": ["bowtie2-build", "--threads", "{threads}", "{query}", "{index}"],
    "bwa": ["bwa", "index", "-p", "{index}", "{query}"],
}
ALIGN = {
    "blastn": ["blastn", "-db", "{index}", "-query", "{query}", "-out", "{out}", "-outfmt", "6", "-num_threads", "{threads}"],
    "bowtie2": ["bowtie2", "-x", "{index}", "-f", "-U", "{query}", "-S", "{out}", "-a", "-p", "{threads}"],
    "bwa": ["bwa", "mem", "-a", "-t", "{threads}", "-o", "{out}", "{index}", "{query}"],
}


def available(program: str) -> bool:
    return shutil.which(program) is not None


def command(parts: list[str], options: dict[str, object] | None = None, **values: object) -> list[str]:
    """The words of a command: values filled in, then options; True stands for an option without a value, a list for one that repeats."""
    out = [p.format(**values) for p in parts]
    for key, value in (options or {}).items():
        for v in value if isinstance(value, list) else [value]:
            out += [key] if v is True else [] if v is False or v is None else [key, str(v)]
    return out


def run(words: list[str]) -> str:
    """What the program prints; an error with the end of what it complains about if it fails."""
    done = subprocess.run(words, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{words[0]} ended with {done.returncode}: {done.stderr[-1000:]}")
    return done.stdout


def build_index(program: str, fasta: str, index: str, threads: int = 1) -> str:
    """Runs once, on the driver, into a folder that executors share."""
    os.makedirs(os.path.dirname(os.path.abspath(index)), exist_ok=True)
    run(command(INDEX[program], query=fasta, index=index, threads=threads))
    return index


def map_program(rows: DataFrame, key: str, seq: str, words: list[str], options: dict[str, object] | None = None, **values: object) -> DataFrame:
    """(value): the lines that the program writes about the sequences, batch by batch; parse them with the readers."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            with tempfile.TemporaryDirectory() as folder:
                query, out = os.path.join(folder, "query.fa"), os.path.join(folder, "out")
                with open(query, "w") as f:
                    f.writelines(f">{k}\n{s}\n" for k, s in zip(frame[key], frame[seq], strict=True))
                said = run(command(words, options, query=query, out=out, **values))
                if os.path.exists(out):
                    with open(out) as f:
                        said = f.read()
            yield pd.DataFrame({"value": said.splitlines()})

    return rows.select(key, seq).mapInPandas(batches, "value string")


def align(rows: DataFrame, program: str, index: str, key: str = "name", seq: str = "seq", threads: int = 1, options: dict[str, object] | None = None) -> DataFrame:
    return map_program(rows, key, seq, ALIGN[program], options, index=index, threads=threads)


def site_queries(guides: DataFrame, genome: str, motif: str, mismatches: int = 5) -> DataFrame:
    """(name, text): one input file for each guide (name, spacer) of a bulge-free site search: the genome's folder, a pattern of N with the
    motif's PAM, then the spacer with N for the PAM."""
    from strandloom.functions import motif as M

    m = M.parse(motif)
    pam = max(m.pams, key=len)
    fill = lambda letters: F.concat(letters, F.lit(pam)) if m.side == ">" else F.concat(F.lit(pam), letters)
    blank = lambda letters: F.concat(letters, F.lit("N" * len(pam))) if m.side == ">" else F.concat(F.lit("N" * len(pam)), letters)
    text = F.concat_ws("\n", F.lit(genome), fill(F.repeat(F.lit("N"), F.length("spacer"))), F.concat(blank(F.col("spacer")), F.lit(f" {mismatches}")))
    return guides.select("name", text.alias("text"))


def structures(pairs: DataFrame, predict: Callable[[list[tuple[str, str]]], list[float]], name: str = "dg") -> DataFrame:
    """pairs (a, b) with the lowest free energy that a predictor gives for each: any picklable callable, such as a wrapper of a folding program."""
    @F.pandas_udf(DoubleType())
    def energy(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(predict(list(zip(a, b, strict=True))), dtype=float)

    return pairs.withColumn(name, energy("a", "b"))
