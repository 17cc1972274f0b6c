"""What must not grow with a contig's length or with the number of pairs."""

import itertools
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import statistics as St
from strandloom.functions.scoring import linear
from strandloom.operators import donors as D
from strandloom.operators import features as Fe
from strandloom.operators import offtarget as O
from strandloom.operators import primers as P
from strandloom.operators import rounds
from strandloom.operators import windows as W
from strandloom.plans import api, design

SEQ = "".join("ACGT"[(i * i * 7 + i // 3) % 4] for i in range(3000))


def test_chunks_dont_copy_the_contig(spark):
    contig = spark.range(1).select(F.lit("c").alias("contig"), F.repeat(F.lit("ACGTTGCA"), (F.col("id") + (1 << 20)).cast("int")).alias("seq")).repartition(1)
    began = time.time()
    n, letters = W.chunks(contig, spread=0).agg(F.count("*"), F.sum(F.length("text"))).first()
    assert (n, letters) == (1 << 14, 1 << 23)
    assert time.time() - began < 20  # 16,384 copies of 8 MB took 45 s


def test_features_bring_the_letters_around_them(spark):
    contigs = spark.createDataFrame([("c", SEQ), ("short", "ACGT")], "contig string, seq string")
    places = [("c", 0, 5), ("c", 3, 40), ("c", 500, 530), ("c", 511, 1400), ("c", 2990, 3000), ("short", 1, 3), ("missing", 1, 3)]
    f = spark.createDataFrame([(f"f{i}", *x) for i, x in enumerate(places)], "feature string, contig string, start int, end int")
    rows = {r.feature: r for r in W.near(f, contigs, 20, 30).collect()}
    assert len(rows) == 6
    for i, (contig, start, end) in enumerate(places[:6]):
        seq, r = SEQ if contig == "c" else "ACGT", rows[f"f{i}"]
        assert (r.base, r.seq, r.start + r.base, r.end + r.base) == (max(start - 20, 0), seq[max(start - 20, 0) : end + 30], start, end)


def test_spanned_tags(spark):
    tag = "ACGATCGATCGATTACGATCTGG"
    made = spark.createDataFrame([("a", "TTT" + tag + "CCAA", 3, tag), ("b", "TTT" + tag[:-1] + "ACCAA", 3, tag[:-1] + "A")], "feature string, donor string, up_n int, tag string")
    assert [(r.feature, r.t_strand, r.spacer) for r in D.spanned(made, "N{20}>NGG").collect()] == [("a", "+", tag[:20])]


def test_donors_over_chunk_borders(spark):
    contigs = spark.createDataFrame([("c", SEQ.lower()), ("d", SEQ[400:1300])], "contig string, seq string")
    donors = {"a": SEQ[500:530], "b": SEQ[450:1200], "c": SEQ[2976:], "d": SEQ[600:623]}
    want = {(k, c, s.find(v)) for k, v in donors.items() for c, s in (("c", SEQ), ("d", SEQ[400:1300])) if len(v) >= 24 and v in s}
    assert {tuple(r) for r in Fe.donors_elsewhere(spark.createDataFrame(list(donors.items()), "donor string, seq string"), contigs).collect()} == want


def broadcasts(df):
    """The parts of df's plan that are broadcast, each with its branches."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1].splitlines()
    depth = lambda x: re.search(r"[^\s:+*-]", x).start()
    at = [i for i, x in enumerate(lines) if "BroadcastExchange" in x]
    return ["\n".join([lines[i], *itertools.takewhile(lambda x, i=i: depth(x) > depth(lines[i]), lines[i + 1 :])]) for i in at]


@pytest.mark.parametrize("substitutions", [0, 1])
def test_windows_are_not_broadcast_to_primers(spark, monkeypatch, substitutions):
    contigs = spark.range(3).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("contig"), F.lit(SEQ).alias("seq"))
    own = spark.createDataFrame([(SEQ[40:48],), (SEQ[900:908].lower(),), (SEQ[7:12],)], "primer string")
    few = P.binding_sites(own, contigs, substitutions)
    assert broadcasts(few) and not any("Range" in x for x in broadcasts(few))
    monkeypatch.setattr(P, "FEW", 0)
    many = P.binding_sites(own.unionByName(own.select(F.lit(None).cast("string").alias("primer"))), contigs, substitutions)
    assert not broadcasts(many)
    rows = Counter(map(tuple, few.collect()))
    assert rows and rows == Counter(map(tuple, many.collect()))


def test_pairing_primers_broadcasts_no_side(spark):
    p = spark.range(100).select((F.col("id") % 3).alias("name"), (F.col("id") * 11).cast("int").alias("p_start"), (F.col("id") * 11 + 20).cast("int").alias("p_end"), F.lit("ACGTACGTACGTACGTACGA").alias("primer"), F.lit(50.0).alias("tm"))
    assert not broadcasts(P.pair_primers(p, p))


def test_donors_broadcast_no_windows(spark):
    contigs = spark.range(3).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("contig"), F.lit(SEQ).alias("seq"))
    donors = spark.range(3).select(F.col("id").alias("donor"), F.lit(SEQ[100:140]).alias("seq"))
    assert not broadcasts(Fe.donors_elsewhere(donors, contigs))


def test_linked_features_broadcast_no_rows(spark):
    features = spark.range(9).select(F.col("id").alias("n"), F.create_map(F.lit("ID"), F.concat(F.lit("gene"), F.col("id").cast("string"))).alias("attributes"))
    for errors in (False, True):
        assert not broadcasts(api.find_feature(features, ["gene3"], allow_errors=errors))


@pytest.mark.parametrize("least", [1, 5, 24])
def test_donors_at_every_place(spark, least):
    donors = [(f"{i}-{n}", SEQ[i : i + n]) for i in (0, 1, 2, 3, 509, 510, 511, 512, 2990 - least, 3000 - least) for n in (least, least + 1, least + 9)]
    donors = [x for x in donors if len(x[1]) >= least] + [("lost", "ACGT" * 10), ("twice", SEQ[5:50]), ("twice", SEQ[800:850])]
    contigs = {"c": SEQ, "d": SEQ[2:1000], "short": SEQ[:least], "shorter": SEQ[: least - 1], "A": "A" * 60}
    want = {}
    for name, x in donors:
        for c, s in contigs.items():
            if x in s:
                want[name, c] = min(s.find(x), want.get((name, c), 1 << 30))
    got = Fe.donors_elsewhere(spark.createDataFrame(donors, "donor string, seq string"), spark.createDataFrame(list(contigs.items()), "contig string, seq string"), least)
    rows = got.collect()
    assert len(rows) == len(want) and {(r.donor, r.contig): r.start for r in rows} == want


def test_pairwise_sums_of_many(spark):
    rows = dict(spark.range(1, 34).select("id", St.pairwise_sum_p(F.lit(1.0), F.col("id").cast("int"))).collect())
    for r, p in rows.items():
        assert math.isclose(p, math.exp(-1) / (math.factorial(r) * math.factorial(r - 1)), rel_tol=1e-12)


@pytest.mark.parametrize(("length", "most"), [(20, 5), (20, 4), (31, 6), (20, 0), (3, 3)])
def test_near_codes_by_brute_force(monkeypatch, length, most):
    r = np.random.default_rng(length + most)
    base = r.integers(0, 1 << 2 * length, 150)
    codes = np.unique(np.concatenate([base, np.repeat(base, 3) ^ (3 << 2 * r.integers(0, length, 450)) ^ (1 << 2 * r.integers(0, length, 450))]))
    texts = O.unpacked(codes.astype(np.uint64), length).to_pylist()
    want = {(a, b, n) for a in texts[::3] for b in texts if (n := sum(x != y for x, y in zip(a, b, strict=True))) <= most}
    for at_once in (1 << 20, 5):
        monkeypatch.setattr(O, "AT_ONCE", at_once)
        got = [x for g, s, m in O.near_codes(codes[::3], codes, most, length) for x in zip(O.unpacked(g, length).to_pylist(), O.unpacked(s, length).to_pylist(), m.tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want


def test_near_spacers_in_blocks_by_contig(spark, monkeypatch):
    for name, n in (("GUIDE_BLOCK", 20), ("SITE_BLOCK", 50), ("PIECE", 7)):
        monkeypatch.setattr(O, name, n)
    r = np.random.default_rng(1)
    rows = [(f"c{i % 3}", "".join(r.choice(list("AC"), 12))) for i in range(300)] + [(None, "A" * 12), ("c1", None)]
    df = spark.createDataFrame(rows, "contig string, spacer string")
    guides = df.where("spacer < 'B' or contig = 'c2'")
    got = [tuple(x) for x in O.near_spacers(guides, df, 2, 12, by=("contig",)).collect()]
    sites = {x for x in rows if None not in x}
    want = {(c, g, s, n) for c, g in sites for k, s in sites if c == k and (g < "B" or c == "c2") and (n := sum(x != y for x, y in zip(g, s, strict=True))) <= 2}
    assert len(got) == len(want) and set(got) == want


def test_seed_join_shuffles_no_changed_seeds(spark):
    df = spark.range(1000).select(F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 20), "0123456789abcdef", "ACGT" * 4).alias("spacer"))
    plan = O.near_spacers(df, df, 5, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitwisexor" not in plan.lower() and " ^ " not in plan  # 872 rows for each guide are 4 billion rows for 5 million guides


def test_near_spacers_score_their_own_text_as_linear_does(spark):
    row = spark.range(1).select(linear(F.lit("ACGTACGTACGTACGTACGT"), F.lit("ACGTACGTACGTACGTACGT")).alias("s")).first()
    assert row.s == 100.0  # top_targets puts this in without going through the letters


def test_spacers_at_several_places_are_judged_once(spark):
    one = "ACGTACGTACGTACGTACGT"
    other = "T" + one[1:]
    seq = (one + "AGG") * 3 + other + "TGG"
    contigs = spark.createDataFrame([("c", seq), ("d", seq)], "contig string, seq string")
    spacers = spark.createDataFrame([("a", one), ("b", one), ("x", "C" * 20)], "target string, spacer string")
    out = design.evaluate_spacers(spacers, contigs, ["N{20}>NGG"], 1)
    assert sorted((r.target, r.places, r.near, r.guide is None) for r in out.collect()) == [("a", 6, 2, False), ("b", 6, 2, False), ("x", 0, 0, True)]
    known = spark.createDataFrame([("k", "+", 1, 24, one)], "contig string, strand string, start int, end int, spacer string")
    assert {r.target: r.places for r in design.evaluate_spacers(spacers, contigs, ["N{20}>NGG"], 1, found=known).collect()} == {"a": 1, "b": 1, "x": 0}


def test_homologs_are_not_shuffled_for_each_feature(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), (None, 5)], "name string, group int")
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("c", "x"), ("d", None)], "feature string, group string")
    out = Fe.with_homologs(f, groups)
    rows = [(r.name, r.group, r.homologs) for r in out.collect()]
    assert out.columns == ["name", "group", "homologs"]
    assert sorted(rows, key=str) == sorted([("a", 1, ["a", "b", "c"]), ("b", 2, ["a", "b", "c"]), ("c", 3, ["c"]), ("c", 3, ["a", "b", "c"]), ("d", 4, None), (None, 5, None)], key=str)
    plan = out._jdf.queryExecution().optimizedPlan()
    joins = [plan.apply(i).toString() for i in range(12) if plan.apply(i) is not None and plan.apply(i).nodeName() == "Join"]
    assert "homologs" not in joins[1]  # the second join's whole tree: before, it was where lists met features


def test_edits_of_one_place_are_compared_once(spark, monkeypatch):
    names = ("edit", "round", "contig", "start", "end", "after_contig", "after_start", "after_end", "up", "down", "after_up", "after_down")
    long = ("ACGT" * 300, "ACGT" * 299 + "ACGA")
    e = lambda k, r, up=long[0], after_up=long[1], contig="c", at=100: (k, r, contig, at, at + 10, contig, at + 3, at + 8, up, "CC", after_up, "CC")
    rows = [e(k, k % 2) for k in range(500)] + [e(7, 1), e(8, 0), e(None, 1), e(600, 1, up="T"), e(601, 1, at=108), e(602, 0, contig=None), e(603, 1, contig=None), e(604, None), e(605, 1, up=None), e(606, 2, contig="d"), e(607, 1, contig="d")]
    taken = {id(x): dict(zip(names, x, strict=True)) for x in rows}.values()
    meet = lambda a, b: a["contig"] is not None and a["contig"] == b["contig"] and a["round"] is not None and b["round"] == a["round"] + 1 and a["after_start"] < b["end"] and b["start"] < a["after_end"] and b["up"] in long
    want = Counter((a["edit"], b["edit"]) for a in taken for b in taken if meet(a, b))
    assert want.total() == 251 * 252 + 1 and want[8, 7] == 4 and want[8, None] == 2
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if 'contig' in c or 'up' in c or 'down' in c else 'int'}" for c in names))
    for most in (128, 50):
        monkeypatch.setattr(rounds, "LIST", most)
        began = time.time()
        assert Counter(map(tuple, rounds.links(df, 0.9, 32).collect())) == want
        assert time.time() - began < 40  # 63,000 comparisons of 1,200 letters were stopped at 110 s
