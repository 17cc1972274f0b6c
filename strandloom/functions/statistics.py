"""Weights, densities and alignment statistics as Column builders, and two solvers that run once for each scoring matrix."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic_up(x: Column, slope: float = 8, at: float = 0, height: float = 1.0) -> Column:
    return F.lit(height) / (1 + F.pow(F.lit(float(slope)), F.lit(float(at)) - x))


def logistic_down(x: Column, slope: float = 8, at: float = 0, height: float = 1.0) -> Column:
    return F.lit(height) / (1 + F.pow(F.lit(float(slope)), x - F.lit(float(at))))


def logistic_updown(x: Column, up_slope: float, up: float, down_slope: float, down: float, height: float = 1.0) -> Column:
    return F.lit(height) * logistic_up(x, up_slope, up) * logistic_down(x, down_slope, down)


def normal_pdf(x: Column, mean: float = 0, std: float = 1) -> Column:
    return F.exp((x - mean) * (x - mean) / F.lit(-2.0 * std * std)) / F.lit(math.sqrt(2 * math.pi * std * std))


def gamma_pdf(x: Column, shape: int, scale: float = 1) -> Column:
    return F.pow(x, F.lit(float(shape - 1))) * F.exp(-x / F.lit(float(scale))) / F.lit(float(scale) ** shape * math.factorial(shape - 1))


def parse_weight(text: str) -> list[tuple[float, str, float]]:
    """'66+1.22' or '40+1.7,60-1.7' as (position, sign, slope)."""
    return [(float(a), s, float(b)) for a, s, b in re.findall(r"([0-9.]+)([+-])([0-9.]+)", text)]


def algorithm_weight(x: Column, parameters: list[tuple[float, str, float]]) -> Column:
    """Product of the logistic curves; 1 without parameters."""
    out = F.lit(1.0)
    for at, sign, slope in parameters:
        out = out * (logistic_up(x, slope, at) if sign == "+" else logistic_down(x, slope, at))
    return out


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, b: a * b)


def nats_to_bits(x: Column) -> Column:
    return x / F.lit(math.log(2))


def bits_to_nats(x: Column) -> Column:
    return x * F.lit(math.log(2))


def bit_score(raw: Column, k: Column, lam: Column) -> Column:
    return (lam * raw - F.log(k)) / F.lit(math.log(2))


def raw_score_expect(raw: Column, k: Column, lam: Column, m: Column, n: Column) -> Column:
    return k * m * n * F.exp(-lam * raw)


def bit_score_expect(bits: Column, m: Column, n: Column) -> Column:
    return m * n * F.pow(F.lit(2.0), -bits)


def raw_score_at_expect_one(k: Column, lam: Column, m: Column, n: Column) -> Column:
    return F.log(k * m * n) / lam


def hsp_length(k: Column, m: Column, n: Column, h: Column) -> Column:
    return F.log(k * m * n) / h


def effective_query_length(m: Column, length: Column, k: Column) -> Column:
    return F.greatest(m - length, 1 / k)


def effective_database_length(n: Column, length: Column, sequences: Column, k: Column) -> Column:
    return F.greatest(n - sequences * length, 1 / k)


def expect_to_p(e: Column) -> Column:
    return -F.expm1(-e)


def p_to_expect(p: Column) -> Column:
    return -F.log1p(-p)


def sum_score(raws: Column, k: Column, lam: Column, m: Column, n: Column, gap: Column) -> Column:
    """Of an array of raw scores; null for a single one."""
    r = F.size(raws)
    total = F.aggregate(raws, F.lit(0.0), lambda a, b: a + b)
    return F.when(r > 1, lam * total - F.log(k * m * n) - (r - 1) * (F.log(k) + 2 * F.log(gap)) - F.log(F.factorial(r).cast("double")))


def pairwise_sum_p(s: Column, r: Column) -> Column:
    """As the program computes it: the exponent is (r - 1)!."""
    f = _factorial(r - 1)
    return F.exp(-s) * F.pow(s, f) / (_factorial(r) * f)


def _factorial(n: Column) -> Column:
    """As a double, since Spark's own ends at 20; infinite over 170; null below 0."""
    known = F.array(*(F.lit(float(math.factorial(k))) for k in range(171)))
    return F.when(n > 170, F.lit(math.inf)).otherwise(F.get(known, n.cast("int")))


def tests_corrected_p(r: Column, p: Column, beta: Column) -> Column:
    return p / (F.pow(beta, r - 1) * (1 - beta))


def size_corrected_expect(p: Column, database: Column, subject: Column) -> Column:
    return database / subject * p


def sign(x: Column) -> Column:
    return F.when(x < 0, -1).otherwise(1)


def karlin_altschul_lambda(scores: dict[tuple[str, str], float], shares: dict[str, float], precision: float = 1e-3) -> float:
    """The positive root of sum p_a p_b exp(lambda s_ab) = 1, by halving [0, 2]. Scores need a negative mean and a
    positive maximum."""
    pairs = [(shares[a] * shares[b], s) for (a, b), s in scores.items() if a in shares and b in shares]
    if sum(p * s for p, s in pairs) >= 0 or max(s for _, s in pairs) <= 0:
        raise ValueError("illegal scores")
    low, high = 0.0, 2.0
    while high - low > precision:
        mid = (low + high) / 2
        low, high = (low, mid) if sum(p * math.exp(mid * s) for p, s in pairs) >= 1 else (mid, high)
    return (low + high) / 2


def relative_entropy(scores: dict[tuple[str, str], float], shares: dict[str, float], lam: float) -> float:
    """Mean score of aligned pairs, in nats."""
    return sum(lam * s * shares[a] * shares[b] * math.exp(lam * s) for (a, b), s in scores.items() if a in shares and b in shares)


def karlin_altschul_k(steps: dict[int, float], lam: float, h: float, most: int = 1000, least: float = 1e-3) -> float:
    """K for integer scores with the given probabilities: closed forms where the extreme score is one step, otherwise
    the series of the random walk's ladder sums."""
    low, high = min(steps), max(steps)
    unit = math.gcd(*(s for s in steps if s))
    low, high, lam_unit = low // unit, high // unit, lam * unit
    p = {s // unit: x for s, x in steps.items()}
    tilt, mean = 1 - math.exp(-lam_unit), sum(s * x for s, x in p.items())
    if low == -1 and high == 1:
        return (p[1] - p[-1]) ** 2 / p[-1]
    if high == 1:
        return h / lam_unit * tilt
    if low == -1:
        return lam_unit * tilt / h * mean * mean
    walk, sigma = {0: 1.0}, 0.0
    for j in range(1, most + 1):
        new: dict[int, float] = {}
        for a, x in walk.items():
            for s, y in p.items():
                new[a + s] = new.get(a + s, 0.0) + x * y
        walk = new
        part = sum(x * math.exp(lam_unit * a) if a < 0 else x for a, x in walk.items()) / j
        sigma += part
        if part < least:
            break
    return lam_unit * math.exp(-2 * sigma) / (h * tilt)


def search_space(m: Column, n: Column) -> Column:
    return m * n


def estimated_expect(score: Column, query_length: Column, k: float, lam: float, h: float, database: float, sequences: int) -> Column:
    """The E-value of a raw score from effective lengths of query and database."""
    kk, ll, hh, db = (F.lit(float(x)) for x in (k, lam, h, database))
    length = hsp_length(kk, query_length, db, hh)
    return raw_score_expect(score, kk, ll, effective_query_length(query_length, length, kk), effective_database_length(db, length, F.lit(sequences), kk))


def pair_probabilities(query: dict[str, float], database: dict[str, float]) -> dict[tuple[str, str], float]:
    """The chance of each pair of letters."""
    return {(a, b): p * q for a, p in query.items() for b, q in database.items()}
