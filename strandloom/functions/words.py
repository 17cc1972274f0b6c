"""Words by rule or by chance. Chance is a hash of a seed and a number, so a retried task draws the same."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import motif as M
from strandloom.functions import sequence as S


def chance(*parts: Column) -> Column:
    """A number in [0, 1) that only the parts decide."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def weighted_choice(draw: Column, population: list[str], weights: list[float] | None = None) -> Column:
    """The member of the population that a number in [0, 1) falls on."""
    weights = weights or [1.0] * len(population)
    if len(weights) != len(population) or not sum(weights) > 0:
        raise ValueError("weights don't fit the population")
    total, below, out = float(sum(weights)), 0.0, None
    for member, w in zip(population[:-1], weights[:-1], strict=True):
        below += w
        hit = draw < below / total
        out = F.when(hit, member) if out is None else out.when(hit, member)
    return F.lit(population[-1]) if out is None else out.otherwise(population[-1])


def random_sequence(seed: Column, length: int, compositions: dict[str, float] | None = None) -> Column:
    """A sequence of so many letters with the given shares of A, C, G and T, a quarter each by default."""
    shares = [(compositions or dict.fromkeys("ACGT", 0.25))[b] for b in "ACGT"]
    places = F.sequence(F.lit(1), F.lit(length)) if length else F.array().cast("array<int>")
    return F.array_join(F.transform(places, lambda i: weighted_choice(chance(seed, i), list("ACGT"), shares)), "")


def sampled_words(spark: SparkSession, length: int, n: int, letters: str = "ACGT", seed: int = 0) -> DataFrame:
    """(word): all words of a length if there are at most n, else n different ones by a hash's order."""
    total = len(letters) ** length
    digit = lambda k: F.substring(F.lit(letters), (F.floor(F.col("id") / len(letters) ** k) % len(letters) + 1).cast("int"), F.lit(1))
    word = F.concat(F.lit(""), *(digit(k) for k in reversed(range(length)))).alias("word")
    rows = spark.range(total).select("id", word)
    return rows.select("word") if total <= n else rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("word")


def genotypes(genes: list[str]) -> Column:
    """Every genotype with one allele, a letter, of each gene, the first gene's changing last."""
    out = F.array(F.lit(""))
    for alleles in genes:
        out = F.flatten(_extended(out, alleles))
    return out


def _extended(have: Column, alleles: str) -> Column:
    letters = F.array(*(F.lit(a) for a in alleles))
    return F.transform(have, lambda y: F.transform(letters, lambda x: F.concat(y, x)))


def genotype_list(genes: list[str]) -> Iterator[str]:
    return map("".join, itertools.product(*genes))


def likeliest_instance(text: str, compositions: dict[str, float], complement: bool = False, samples: int = 100, seed: int = 0) -> str:
    """Of so many instances of a motif the one with the largest mean share of its letters, or the smallest with complement."""
    found = [M.random_instance(text, seed + k) for k in range(samples)]
    mean = lambda s: sum(compositions[c] for c in s) / len(s)
    return (min if complement else max)(found, key=lambda s: (mean(s), s))


def decimal_range(start: float, stop: float, step: float = 1.0, rounding: int | None = None) -> list[float]:
    """start, start + step and so on, short of stop; a negative step goes down."""
    if step == 0:
        raise ValueError("step is 0")
    out, now = [], start
    while (now < stop) if step > 0 else (now > stop):
        out.append(round(now, rounding) if rounding is not None else now)
        now += step
    return out


def fuzzy_pattern(iupac: str, substitutions: int | None = 0, insertions: int | None = 0, deletions: int | None = 0, errors: int | None = 0) -> str:
    """A pattern of an IUPAC string that allows errors: at most so many of each kind and in all, None for any number. Without any it is the plain
    pattern."""
    body = S.class_pattern(iupac)
    limits = {"s": substitutions, "i": insertions, "d": deletions, "e": errors}
    if all(v == 0 for v in limits.values()):
        return body
    said = [k if v is None else f"{k}<={v}" for k, v in limits.items() if v is None or v > 0 or k == "e" and v]
    return f"(?:{body}){{{','.join(said)}}}"


def flank_pattern(seq: str, least: int = 1, most_between: int = 2000) -> str:
    """What finds the two parts of a donor with up to so many letters between them, for every way to cut it."""
    return "|".join(f"{seq[:i]}(.{{,{most_between}}}){seq[i:]}" for i in range(least, len(seq) - least + 1))
