"""Functions against published vectors and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignment, cigar, motif, scoring, statistics
from strandloom.functions import sequence as S
from strandloom.functions import thermodynamics as T
from strandloom.operators import designs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="AaCcGgTtRrYyMmKkWwSsBbDdHhVvNn") == "nNbBdDhHvVsSwWmMkKrRyYaAcCgGtT"
    assert one(spark, S.reverse_complement(F.col("s"), rna=True), s="ACGU") == "ACGU"


@pytest.mark.parametrize(("seq", "want"), [("ACATGTTNTG", 3.25), ("AACTTTTTYCCATTNTTTTT", 7.25), ("", 0.0)])
def test_poly_t(spark, seq, want):
    assert one(spark, S.longest_run(F.col("s"), "T"), s=seq) == pytest.approx(want)


@pytest.mark.parametrize(("seq", "want"), [("RYMKWSACGTbDHVNACGTA", 2.25), ("NNNAACC", 2.75)])
def test_homopolymer(spark, seq, want):
    assert one(spark, S.longest_homopolymer(F.col("s")), s=seq) == pytest.approx(want)


def test_cigar_vector(spark):
    q, s = "AAAAAATCCC", "AGACGAAACCC"
    steps = one(spark, cigar.specify(F.col("c"), F.col("q"), F.col("s")), c="3M2D3MI3M", q=q, s=s)
    assert steps == "=X=DD===I==="
    assert one(spark, cigar.collapse(F.col("c")), c=steps) == "1=1X1=2D3=1I3="
    assert one(spark, cigar.collapse(F.col("c"), True), c=steps) == "=X=2D3=I3="
    e = one(spark, cigar.errors(F.col("c")), c="=X=2D3=I3=")
    assert tuple(e) == (8, 1, 1, 2, 4)
    assert one(spark, cigar.expand(F.col("c")), c="2=X") == "==X"
    assert one(spark, cigar.from_alignment(F.col("a"), F.col("b")), a="AC", b="A") is None
    assert tuple(one(spark, cigar.query_span(F.col("c")), c="3H5M2D1I")) == (3, 9)


def test_housden_vector(spark):
    assert one(spark, scoring.housden(F.col("s")), s="AAAATTAACTATAGGTAAAG") == pytest.approx(5.069672946242666)
    assert one(spark, scoring.housden(F.col("s")), s="AAAATTAACTATAGGTAAAN") == 0
    low, high = ([f(r) for r in scoring.HOUSDEN] for f in (max, min))
    assert -math.log10(math.prod(low)) == pytest.approx(1.1406, abs=1e-4) and -math.log10(math.prod(high)) == pytest.approx(12.8129, abs=1e-4)


def test_crisprscan_vector(spark):
    s = "AAGTGTCGACTCCCGCTCTCAAAGAGCGGAGCTCC"
    x = scoring.crisprscan(F.lit(s[6:26]), F.lit(s[26:29]), F.lit(s[:6]), F.lit(s[29:]))
    assert one(spark, x) == pytest.approx(50.767526362900014)


def test_paired_scores(spark):
    a = "AAAATTAACTATAGGTAAAG"
    assert one(spark, scoring.linear(F.col("a"), F.col("b")), a=a, b=a) == 100
    assert one(spark, scoring.hsu_zhang(F.col("a"), F.col("b")), a=a, b=a) == 100
    assert one(spark, scoring.hsu_zhang(F.col("a"), F.col("b")), a=a, b=a[:-1] + "A") == pytest.approx(100 * (1 - 0.583))
    table = {f"rU:d{b},{i}": 0.5 for b in "CGT" for i in range(1, 21)}
    assert one(spark, scoring.cfd(F.col("a"), F.col("b"), F.lit("AGG"), table), a=a, b=a.replace("T", "A")) == pytest.approx(100 * 0.5 ** a.count("T"))
    assert one(spark, scoring.cfd(F.col("a"), F.col("b"), F.lit("NNN"), table), a=a, b=a) == 0


def test_motif_grammar():
    m = motif.parse("N{17}|N{3}>NGG")
    assert (m.side, m.spacers, m.pams, m.spacer_cuts[0]) == (">", ("N" * 20,), ("NGG",), ([17], [17]))
    assert motif.parse("N{20}>(N{1,2}G,GAW,CAA)").pams == ("CAA", "GAW", "NG", "NNG")
    assert motif.parse("TTTN<N{19}/.{4}\\").spacer_cuts[0] == ([19], [23])
    assert motif.expand("A(C,G(T,A)){2}") == sorted("A" + x + y for x in ("C", "GT", "GA") for y in ("C", "GT", "GA"))
    for bad in ("NGG", "N{2,}>NGG", "N{3,2}>NGG", "N>(A,C", "N >NGG", "N>N>G"):
        with pytest.raises(ValueError):
            motif.parse(bad)
    import re

    for k in range(5):
        assert re.fullmatch(m.pattern(), motif.random_instance(m.text, k))


def test_global_alignment(spark):
    score, top, bottom, *n = alignment.align("ACGTACGT", "ACGACGT")
    assert (score, top, bottom, n) == (3.0, "ACGTACGT", "ACG-ACGT", [0, 0, 1, 1])
    assert alignment.align("NGG", "AGG")[0] > alignment.align("NGG", "AGA")[0]
    got = one(spark, alignment.global_alignment(F.col("a"), F.col("b")), a="ACGT", b="AGGT")
    assert (got.score, got.substitutions, got.errors) == (pytest.approx(1.8), 1, 1)
    assert one(spark, alignment.pam_identity(["NGG"])(F.col("p")), p="AGG") == pytest.approx(100)
    assert tuple(one(spark, alignment.longest_common_substring(F.col("a"), F.col("b")), a="xxhello", b="yhelloy")) == (2, 1, 5)
    best = one(spark, alignment.best_motif([motif.parse("N{20}>NGG"), motif.parse("N{20}>NAG")])(F.col("s")), s="A" * 20 + "CAG")
    assert (best.motif, best.errors, best.pam) == ("N{20}>NAG", 0, "CAG")


def test_karlin_altschul():
    scores = {(a, b): 1.0 if a == b else -1.0 for a in "ACGT" for b in "ACGT"}
    p = dict.fromkeys("ACGT", 0.25)
    lam = statistics.karlin_altschul_lambda(scores, p, 1e-9)
    assert lam == pytest.approx(math.log(3))
    h = statistics.relative_entropy(scores, p, lam)
    assert statistics.karlin_altschul_k({1: 0.25, -1: 0.75}, lam, h) == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        statistics.karlin_altschul_lambda({k: 1.0 for k in scores}, p)
    blast = {(a, b): 1.0 if a == b else -2.0 for a in "ACGT" for b in "ACGT"}
    lam = statistics.karlin_altschul_lambda(blast, p, 1e-9)
    assert lam == pytest.approx(1.33, abs=0.01)
    k = statistics.karlin_altschul_k({1: 0.25, -2: 0.75}, lam, statistics.relative_entropy(blast, p, lam))
    assert k == pytest.approx(0.62, abs=0.02)


def test_weights():
    assert statistics.parse_weight("40+1.7,60-1.7") == [(40, "+", 1.7), (60, "-", 1.7)]
    assert statistics.parse_weight("") == []


def test_thermodynamics(spark):
    d = one(spark, T.duplex(F.col("s"), sodium=1.0, temperature=37.0, concentration=1e-4), s="CGTTGA")
    assert (d.dh, d.ds, d.dg) == (pytest.approx(-41.2, abs=2.5), pytest.approx(-119.5, abs=8), pytest.approx(-4.2, abs=1.3))
    assert one(spark, T.dimer_dg(F.col("a"), F.col("b")), a="AAAA", b="CCCC") == 0
    strong = one(spark, T.dimer_dg(F.col("a"), F.col("b")), a="GGGCCCGGG", b="CCCGGGCCC")
    assert strong < -8


def test_designs(spark):
    r = random.Random(1)
    rows = [("d", s, f"p{s}{k}", r.random(), 55 + r.random()) for s in range(3) for k in range(6)]
    df = spark.createDataFrame(rows, "design string, slot int, pair string, weight double, tm double")
    out = {m: designs.optimise(df, m, 200).first().set_weight for m in ("best", "ranked", "uniform", "direct")}
    assert out["direct"] >= out["best"] and out["ranked"] >= out["best"]
    assert designs.optimise(df, "ranked", 200).collect() == designs.optimise(df, "ranked", 200).collect()
    steps = designs.schedule({"a": 1, "b": 0}, {"a": 3, "b": -1}, {"a": 1, "b": 1})
    assert steps[0] == {"a": 1, "b": 0} and steps[-1] == {"a": 3, "b": -1} and len(steps) == 4
