"""Bar codes that keep a distance, and small multiple alignments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from strandloom.functions import motif
from strandloom.functions.alignment import align


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def codes(pattern: str, distance: int, most_fails: int = 1000, most: int = 200, seed: int = 0) -> list[str]:
    """Instances of a motif part, each at least `distance` edits from all before it; ends after most_fails misses in all."""
    out: list[str] = []
    fails, k = 0, seed
    while fails < most_fails and len(out) < most:
        new = motif.random_instance(pattern + ">", k)
        k += 1
        if all(levenshtein(new, x) >= distance for x in out):
            out.append(new)
        else:
            fails += 1
    return out


def star_alignment(seqs: list[str]) -> list[str]:
    """Gapped sequences of one length: all are aligned to the one that is nearest to the others, and gaps once opened stay."""
    if not seqs:
        return []
    centre = max(range(len(seqs)), key=lambda i: (sum(align(seqs[i], s)[0] for j, s in enumerate(seqs) if j != i), -i))
    gaps, pairs = [0] * (len(seqs[centre]) + 1), []
    for s in seqs:
        _, top, bottom, *_ = align(seqs[centre], s)
        pairs.append((top, bottom))
        at, run = 0, 0
        for c in top + "$":
            if c == "-":
                run += 1
            else:
                gaps[at] = max(gaps[at], run)
                at, run = at + 1, 0
    out = []
    for top, bottom in pairs:
        line, at, i = "", 0, 0
        while at <= len(seqs[centre]):
            run = ""
            while i < len(top) and top[i] == "-":
                run += bottom[i]
                i += 1
            line += run + "-" * (gaps[at] - len(run))
            if at < len(seqs[centre]):
                line += bottom[i]
                i += 1
            at += 1
        out.append(line)
    return out


def align_groups(rows: DataFrame) -> DataFrame:
    """(grp, name, seq) with gaps, each group aligned by itself. A group is one task: it should hold a gene's few homologs."""
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("name")
        return g.assign(seq=star_alignment(g.seq.tolist()))[["grp", "name", "seq"]]

    return rows.select("grp", "name", "seq").groupBy("grp").applyInPandas(one, "grp string, name string, seq string")
