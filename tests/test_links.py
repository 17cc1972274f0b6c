"""Faults that were found once, scans that must stay linear, and operators without a query, against plain Python."""

import difflib
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignment as Al
from strandloom.functions import barcodes, cigar, motif, scoring
from strandloom.functions import sequence as S
from strandloom.functions import statistics as St
from strandloom.functions import words as W
from strandloom.operators import alignments as A
from strandloom.operators import external
from strandloom.operators import features as Fe
from strandloom.operators import offtarget as O
from strandloom.operators import primers as P
from strandloom.operators.target_finder import find_targets
from strandloom.operators.windows import chunks, windows
from strandloom.plans import api
from strandloom.sources import readers, sinks


def dna(seed, n, letters="ACGT"):
    return "".join(random.Random(seed).choices(letters, k=n))


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_fasta_records_start_lines(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a desc a>b\nACGT\nAC\n>b\n>c x > y\nGG\n\n")
    got = {r.contig: (r["info"], r.seq) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"a": ("desc a>b", "ACGTAC"), "b": ("", ""), "c": ("x > y", "GG")}


def encoded(text):
    table = {c: "%" + hex(ord(c))[2:].zfill(2) for c in map(chr, range(33))} | {c: f"%{ord(c):02X}" for c in "\"%&'(),;=[\\]\x7f"}
    return "".join(table.get(c, c) for c in text)


def test_gff_codes(spark):
    texts = ["a b;c=1,2&3%", "".join(map(chr, range(1, 128))), "%41%%41%4", "é%E9%zz%", "", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.gff_encode(F.col("t")).alias("e"), S.gff_decode(F.col("t")).alias("d")).collect()
    import re

    for r in rows:
        assert r.e == encoded(r.t)
        assert r.d == re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), r.t)


def test_justify(spark):
    long = "this is my favorite thing to do in the entire whole wide world"
    cases = [("", long, 59), (long, "something else smells like fish", 60), ("ab", "cd", 10), (long, "short", 40), ("left", long, 41)]

    def plain(a, b, w):
        half = w // 2 - 1
        if len(a) + len(b) < w:
            return a + b.rjust(w - len(a))
        return a[:half] + "." * (w - 2 * half) + b[-half:] if len(b) > half else a[: w - len(b) - 3] + "..." + b

    def split(a, b, w):
        if len(a) + len(b) < w:
            return a + b.rjust(w - len(a))
        head = a[: w // 2] + " ..."
        return head + b[-(w - len(head)) :].rjust(w - len(head))

    for a, b, w in cases:
        got = one(spark, x=S.justify(F.lit(a), F.lit(b), w), y=S.justify_split(F.lit(a), F.lit(b), w))
        assert (got.x, got.y) == (plain(a, b, w), split(a, b, w))


def test_codes_count_all_misses(monkeypatch):
    made = iter(["AAAA", "AAAA", "CCCC", "AAAT", "GGGG", "TTTT"])
    monkeypatch.setattr(motif, "random_instance", lambda *_: next(made))
    assert barcodes.codes("N{4}", 2, most_fails=2) == ["AAAA", "CCCC"]


def test_find_feature(spark):
    rows = [("c", 0, 9, "a", {"ID": "gene1", "Alias": "x1,Y2"}), ("c", 5, 9, "b", {"ID": "g2", "Parent": "GENE1"}), ("c", 6, 9, "d", {"Note": "gene1"}), ("c", 7, 9, "e", {"ID": "q", "Name": "my2y2z"}), ("c", 8, 9, "f", {"ID": "zz"})]
    df = spark.createDataFrame(rows, "contig string, start int, end int, name string, attributes map<string,string>")
    names = lambda *p, **k: sorted(r.name for r in api.find_feature(df, list(p), **k).collect())
    assert names("^GENE1$") == ["a", "b", "e"]
    assert names("nothing") == [] and names("zz") == ["f"]
    assert names("gene1", excluded=()) == ["a", "b", "d", "e"]
    assert names("genx1", allow_errors=True) == ["a", "b", "e"]


def test_find_header(spark):
    df = spark.createDataFrame([("chr1", "len=5"), ("CHR2", ""), ("x", "chr")], "contig string, info string")
    assert sorted(r.contig for r in api.find_header(df, ["^>chr[0-9]", "LEN"]).collect()) == ["CHR2", "chr1"]
    assert sorted(r.contig for r in api.find_header(df, ["chrr1"], allow_errors=True).collect()) == ["chr1"]


def test_design_targets_keeps_all_spacer_lengths(spark):
    seq = "ATGCATGCCATTAGCATCAATACAGATTACCAGGTTAGACA" * 3
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    features = spark.createDataFrame([("f", "c", 0, len(seq))], "name string, contig string, start int, end int")
    got = api.design_targets(contigs, features, ["N{17,18}>NGG"], keep=1000)
    want = {r.spacer for r in find_targets(contigs, ["N{17,18}>NGG"]).collect() if 25 <= 100 * sum(c in "CG" for c in r.spacer) / len(r.spacer) <= 75}
    assert {r.spacer for r in got.collect()} == want and want


def test_windows_and_chunks(spark):
    df = spark.createDataFrame([("a", dna(1, 100)), ("b", "ACG"), ("c", "")], "contig string, seq string")
    seqs = {r.contig: r.seq for r in df.collect()}
    got = sorted((r.contig, r.i, r.window) for r in windows(df, 4, 16).collect())
    assert got == sorted((k, i, s[i : i + 4]) for k, s in seqs.items() for i in range(len(s) - 3))
    for r in chunks(df, 30, 5, 3).collect():
        assert r.text == seqs[r.contig][r["first"] : r["at"] + 35] and r["first"] == max(0, r["at"] - 3)


def test_search_is_linear_in_contig_length(spark):
    took = []
    for n in (20_000, 20_000, 320_000):
        df = spark.createDataFrame([("a", dna(2, n))], "contig string, seq string")
        at = time.time()
        find_targets(df, ["N{20}>NGG"]).count()
        took.append(time.time() - at)
    assert took[2] < 16 * max(took[1], 0.3)  # a quadratic scan takes 256 times as long


@pytest.mark.parametrize(("most", "length"), [(5, 20), (3, 12), (0, 8)])
def test_seed_plans_lose_no_pair(most, length):
    for guides, sites in ((10, 10), (10**5, 4 * 10**8)):
        k, e = O.plan_seeds(most, length, guides, sites)
        assert k * (e + 1) > most  # most mismatches over k seeds leave one with at most e
    assert len(O.variants(4, 2)) == 1 + 12 + 54 == len(set(O.variants(4, 2)))


def test_seed_join_deals_hot_seeds(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT_SEEDS", 1)
    sites = ["AAAAAAAA" + "".join(x) for x in itertools.product("ACGT", repeat=6)]
    df = spark.createDataFrame([(s,) for s in sites], "spacer string")
    guides = spark.createDataFrame([("AAAAAAAAAAAAAA",), ("AAAACAAACAAAAA",)], "spacer string")
    got = O.seed_join(guides.select(F.col("spacer").alias("guide"), "spacer"), df.select(F.col("spacer").alias("site"), "spacer"), 3, 14)
    want = [(g, s, n) for g in ("AAAAAAAAAAAAAA", "AAAACAAACAAAAA") for s in sites if (n := sum(a != b for a, b in zip(g, s, strict=True))) <= 3]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_binding_with_substitutions(spark):
    seq = dna(5, 400)
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    primer = seq[40:48]
    got = {(r.strand, r.start) for r in P.binding_sites(spark.createDataFrame([(primer,)], "primer string"), contigs, 1).collect()}
    turn = primer.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    near = lambda p, i: sum(a != b for a, b in zip(p, seq[i : i + 8], strict=True)) <= 1
    assert got == {(m, i) for m, p in (("+", primer), ("-", turn)) for i in range(len(seq) - 7) if near(p, i)}


def test_features_need_what_they_name(spark):
    f = spark.createDataFrame([("a", "x", None), ("b", "x", "a"), ("c", "x", "gone")], "name string, contig string, parent string")
    contigs = spark.createDataFrame([("x", "")], "contig string, seq string")
    assert Fe.require_features(f, contigs, ["a"]) is f
    for bad in (lambda: Fe.require_features(f, contigs, ["q"]), lambda: Fe.require_features(f.limit(0), contigs), lambda: Fe.require_features(f, contigs.limit(0))):
        with pytest.raises(ValueError):
            bad()
    assert {r.name: r.root for r in Fe.with_root(f).collect()} == {"a": "a", "b": "a", "c": "c"}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "name string, parent string")
    with pytest.raises(ValueError):
        Fe.with_root(loop)


def test_cigars(spark):
    got = one(spark, a=cigar.query_span(F.lit("5H10M2I3D4M")), b=cigar.errors(F.lit("3=X2I=4D")), c=cigar.cigar_score(F.lit("3=X2I=4D"), 1, -1, -2, -3), d=cigar.collapse(F.lit("==XX=")), e=cigar.collapse(F.lit("")), f=cigar.from_alignment(F.lit("A-C"), F.lit("AG")), g=cigar.op_total(F.lit("10M2I3D"), "MI"))
    assert tuple(got.a) == (5, 21) and tuple(got.b) == (4, 1, 2, 4, 7) and got.c == 4 - 1 - 4 - 12
    assert (got.d, got.e, got.f, got.g) == ("2=2X1=", "", None, 12)


def test_statistics_without_a_query(spark):
    got = one(spark, a=St.pairwise_sum_p(F.lit(2.0), F.lit(3)), b=St.size_corrected_expect(F.lit(0.01), F.lit(1000.0), F.lit(50.0)), c=P.summarise([F.lit(True), F.lit(None).cast("boolean")]), d=P.summarise([F.lit(True), F.lit(False)]), e=scoring.position_percent(F.lit(25), F.lit(0), F.lit(100), F.lit("-")))
    assert got.a == pytest.approx(2.718281828**-2 * 2**2 / (6 * 2)) and got.b == pytest.approx(0.2) and (got.c, got.d, got.e) == (True, False, 75.0)


def test_fuzzy_matches(spark):
    rows = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "ACCT"), ("ACGT", "ACGGT"), (None, "A")], "a string, b string")
    got = [tuple(r.x) if r.x else None for r in rows.select(Al.error_counts("a", "b").alias("x")).collect()]
    assert got[0] == (0, 0, 0) and got[1] == (1, 0, 0) and sum(got[2]) <= 1
    assert Al.identity("ACGTACGTAC", "ACGTACGTAA") == 0.9 and Al.identity("AAAA", "CCCC") == 0 and Al.identity("NNNN", "ACGT") == 1 and Al.identity("", "") == 0
    assert Al.match_cigar("TTACGTACGG", "ACGTACG", 0, True) == "7=" and Al.match_cigar("AAAA", "CCCC", 1) is None
    assert W.fuzzy_pattern("ANNC") == "A[ACGT]{2}C" and W.fuzzy_pattern("AC", 1, errors=2) == "(?:AC){s<=1,e<=2}"
    assert rows.where(Al.fuzzy_search([W.fuzzy_pattern("ACTT", errors=1)])("b")).count() == 2


def test_words_by_chance(spark):
    got = one(spark, a=W.random_sequence(F.lit(1), 400, {"A": 1.0, "C": 0.0, "G": 0.0, "T": 0.0}), b=W.random_sequence(F.lit(1), 4000), c=W.random_sequence(F.lit(1), 0))
    assert got.a == "A" * 400 and got.c == "" and all(850 < got.b.count(x) < 1150 for x in "ACGT")
    few = [r.word for r in W.sampled_words(spark, 4, 50).collect()]
    assert len(set(few)) == 50 and all(len(w) == 4 for w in few) and few == [r.word for r in W.sampled_words(spark, 4, 50).collect()]
    assert list(W.genotype_list(["aA", "bB"])) == ["ab", "aB", "Ab", "AB"] == one(spark, x=W.genotypes(["aA", "bB"])).x
    assert W.decimal_range(1, 0, -0.5) == [1, 0.5] and W.decimal_range(0, 1, 0.4, 1) == [0, 0.4, 0.8]
    best = W.likeliest_instance("N{6}>NGG", {"A": 0.7, "C": 0.1, "G": 0.1, "T": 0.1})
    worst = W.likeliest_instance("N{6}>NGG", {"A": 0.7, "C": 0.1, "G": 0.1, "T": 0.1}, complement=True)
    assert best.count("A") > worst.count("A") and len(best) == 9
    assert W.flank_pattern("ACGT") == "A(.{,2000})CGT|AC(.{,2000})GT|ACG(.{,2000})T"


def test_models_and_programs_in_batches(spark, tmp_path):
    df = spark.createDataFrame([("ACGT",), ("GGGG",), ("GGGG",), (None,)], "s string")
    got = sorted((r.s or "", r.score) for r in A.score_batches(df, F.col("s"), lambda texts: [t.count("G") for t in texts], "score", 1).collect())
    assert got[1:] == [("ACGT", 1.0), ("GGGG", 4.0), ("GGGG", 4.0)]
    names = df.where("s is not null").withColumn("name", F.col("s"))
    out = external.map_program(names, "name", "s", ["sh", "-c", "grep -c '>' {query} > {out}; cat {query} >> {out}"])
    assert sum(r.value.startswith(">") for r in out.collect()) == 3
    with pytest.raises(RuntimeError):
        external.run(["sh", "-c", "exit 3"])
    assert external.command(["x", "{index}"], {"-a": True, "-b": 2, "-c": ["p", "q"], "-d": None}, index="i") == ["x", "i", "-a", "-b", "2", "-c", "p", "-c", "q"]
    assert not external.available("no-such-program-here")
    pairs = spark.createDataFrame([("AC", "GT")], "a string, b string")
    assert external.structures(pairs, lambda x: [-float(len(a + b)) for a, b in x]).first().dg == -4.0
    queries = external.site_queries(spark.createDataFrame([("g", "ACGT")], "name string, spacer string"), "/genome", "N{4}>NGG", 3)
    assert queries.first().text == "/genome\nNNNNNGG\nACGTNNN 3"


def test_score_tables_and_sites(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("# position weights\n1\t0.5\t1\n2\t0.25\t2\n")
    assert [tuple(r) for r in readers.read_scores(spark, str(tmp_path / "w.tsv"), "p int, a double, b double").collect()] == [(1, 0.5, 1.0), (2, 0.25, 2.0)]
    lines = spark.createDataFrame([("NNNNGG\tc\t7\tACgTGG\t-\t1",)], "value string")
    assert tuple(readers.parse_sites(lines).first()) == ("NNNNGG", "c", 7, "ACgTGG", "-", 1)
    (tmp_path / "x.gff").write_text("##gff\nc\t.\tgene\t1\t9\t.\t+\t.\tID=a%2Cb;Note=x\nc\t.\tCDS\t2\t5\t.\t-\t0\tID=q\n")
    assert [(r.name, r.start, r.end) for r in readers.read_gff(spark, str(tmp_path / "x.gff"), ["gene"]).collect()] == [("a,b", 0, 9)]
    assert [r.name for r in readers.read_gff(spark, str(tmp_path / "x.gff"), selected=["q"]).collect()] == ["q"]
    hits = spark.createDataFrame([(40.0, 30.0)], "s double, n double")
    assert 0 < readers.with_expect(hits, F.col("s"), F.col("n"), 0.41, 0.62, 0.9, 1e6, 10).first().evalue < 1
    (tmp_path / "r1.fa").write_text(">a\nAC\n")
    (tmp_path / "r2.fa").write_text(">a\nGG\n")
    assert sorted(map(tuple, readers.rounds(spark, [str(tmp_path / "r1.fa"), str(tmp_path / "r2.fa")]).collect())) == [(0, "a", "AC"), (1, "a", "GG")]
    known = spark.createDataFrame([("a", 1.0)], "k string, score double")
    known.write.parquet(str(tmp_path / "known"))
    assert {r.k: r.score for r in readers.known_results(spark, str(tmp_path / "known"), spark.createDataFrame([("a",), ("b",)], "k string"), "k").collect()} == {"a": 1.0, "b": None}


def test_drawings(spark):
    rows = F.array(F.struct(F.lit("ab").alias("name"), F.lit("AC-T").alias("seq")), F.struct(F.lit("c").alias("name"), F.lit("ACGT").alias("seq")))
    assert one(spark, x=sinks.alignment_text(F.lit("grp"), rows, F.lit("** |"), F.lit("ACGT"))).x == "grp\nab AC-T\nc  ACGT\n   ** |\n   ACGT"
    text = Al.label_rows(["us", "x"], [6, 4], ["a", "bb"], ["ACGTAC", "ACGTACGTAC"]).split("\n")
    assert len(text) == 3 and text[1].endswith(" ACGTAC") and text[0].strip().startswith("┌")
    assert Al.donor_tracks("ACGT", "GG", "TTTT", [("GTGG", 2)]).split("\n")[1:] == ["ACGTGGTTTT", "  GTGG"]
    assert difflib.SequenceMatcher(None, S.class_pattern("AAN"), "A{2}[ACGT]").ratio() == 1


def test_split_of_a_sequence_by_a_motif():
    assert Al.split_errors("ACGTAGG", "NNNN", "NGG", ">")[0] == 0
    assert Al.split_errors("TTTAACGT", "NNNN", "TTTN", "<")[4:] == ("ACGT", "TTTA")
    m = motif.parse("N{17}|N{3}>NGG")
    assert m.spacer_cuts[0] == ([17], [17]) and m.pam_cuts[0] == ([], [])


def test_edits_of_a_place_form_chains(spark):
    from strandloom.operators import rounds

    e = lambda k, r, a, b, up="AAAAAAAAAA", after_up="AAAAAAAAAA", contig="c": (k, r, contig, a, a + 10, contig, b, b + 5, up, "CC", after_up, "CC")
    rows = [e(1, 0, 100, 100), e(2, 1, 103, 200), e(3, 2, 204, 300), e(4, 1, 500, 1), e(5, 1, 101, 900, up="TTTTTTTTTT"), e(6, 2, 202, 1, contig="d"), e(7, 3, 301, 1)]
    df = spark.createDataFrame(rows, "edit long, round int, contig string, start int, end int, after_contig string, after_start int, after_end int, up string, down string, after_up string, after_down string")
    assert {r.edit: r.chain for r in rounds.chains(df).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 5, 6: 6}


def test_donors_by_kind(spark):
    from strandloom.plans import design

    seq = dna(3, 400)
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    f = spark.createDataFrame([("f", "c", 150, 200), ("g", "c", 220, 260)], "feature string, contig string, start int, end int")
    mint = design.excision_donors(f, contigs, "mintag").where("feature = 'f' and insert = ''").first()
    assert mint.donor == seq[126:150] + seq[200:224]
    bar = {r.feature: r for r in design.excision_donors(f, contigs, "bartag", codes=["ACGTACGTAC", "TTTTTTTTTT"]).collect()}
    assert bar["g"].insert == "TTTTTTTTTT" and bar["f"].donor == seq[105:150] + "ACGTACGTAC" + seq[200:245]
    uni = {r.insert for r in design.excision_donors(f, contigs, "unitag", compositions={"A": 0.4, "C": 0.1, "G": 0.1, "T": 0.4}).collect()}
    assert len(uni) == 1 and len(next(iter(uni))) == 23 and next(iter(uni)).endswith("GG")
    assert all(r.insert in r.donor for r in design.excision_donors(f, contigs, "addtag", samples=3).collect())
    with pytest.raises(ValueError):
        design.excision_donors(f, contigs, "sigtag")
    back = f.withColumns({"parent_start": F.col("start") + 5, "parent_end": F.col("end") - 5})
    assert {r.feature: r.donor for r in design.reversion_donors(back, contigs, least=10, most=30).collect()} == {"f": seq[120:230], "g": seq[190:290]}


def test_reversion_donors_with_primers_and_whole_designs(spark):
    from strandloom.plans import design

    seq = dna(11, 1500)
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    f = spark.createDataFrame([("f", "c", 700, 760, 710, 750)], "feature string, contig string, start int, end int, parent_start int, parent_end int")
    rows = design.reversion_donors(f, contigs, True, 100, 250, subset=60, keep=3).collect()
    turn = str.maketrans("ACGT", "TGCA")
    assert 0 < len(rows) <= 3
    for r in rows:
        assert r.donor in seq and r.donor.startswith(r.forward) and r.donor.endswith(r.reverse.translate(turn)[::-1]) and len(r.donor) == r["size"] and seq[700:760] in r.donor
    whole = design.design_all(contigs, f.select(F.col("feature").alias("name"), "contig", "start", "end"), ["N{20}>NGG"])
    targets = whole["targets"].collect()
    assert targets and [r["rank"] for r in targets] == list(range(1, len(targets) + 1))
    here = {r.spacer for r in find_targets(contigs, ["N{20}>NGG"]).collect()}
    assert whole["donors"].count() > 0 and not here & {r.spacer for r in whole["retargets"].collect()}
    wide = design.expand_features(f.select("feature", "contig", "start", "end"), contigs, ["N{20}>NGG"], "center_both", 2)
    derived = design.derive_features(wide).collect()
    assert sum(len(r.parents) for r in derived) >= 1 and all(r.name.startswith("f_derived-") for r in derived)


def test_inserts_of_any_length(spark):
    from strandloom.operators.donors import with_words

    rows = spark.createDataFrame([(0,), (1,), (6,)], "n int")
    got = [(r.n, r.word) for r in with_words(rows, "n", "word").collect()]
    assert sorted(got) == sorted((n, "".join(x)) for n in (0, 1, 6) for x in itertools.product("ACGT", repeat=n))


def plain_alignment(a, b):
    """The rule for one pair, cell by cell."""
    best = {(0, 0): (0.0, "")}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = []
            if i and j:
                options.append((best[i - 1, j - 1][0] + Al.pair_score(a[i - 1], b[j - 1]), "P"))
            if i:
                options.append((best[i - 1, j][0] + (-2 if best[i - 1, j][1] == "D" else -4), "D"))
            if j:
                options.append((best[i, j - 1][0] + (-2 if best[i, j - 1][1] == "I" else -4), "I"))
            if options:
                best[i, j] = max(options, key=lambda o: o[0])
    i, j, steps = len(a), len(b), ""
    while i or j:
        s = best[i, j][1]
        steps, i, j = s + steps, i - (s in "PD"), j - (s in "PI")
    return best[len(a), len(b)][0], steps


def test_alignments_of_many_pairs(spark, monkeypatch):
    r = random.Random(8)
    pairs = [(dna(r.random(), r.randint(0, 12), "ACGTRN"), dna(r.random(), r.randint(0, 12), "ACGTRN")) for _ in range(120)]
    for cells in (Al._CELLS, 50):
        monkeypatch.setattr(Al, "_CELLS", cells)
        for (a, b), (score, top, bottom, *counts) in zip(pairs, Al.align_all(pairs), strict=True):
            want, steps = plain_alignment(a, b)
            assert score == pytest.approx(want) and (top.replace("-", ""), bottom.replace("-", "")) == (a, b)
            assert "".join("D" if y == "-" else "I" if x == "-" else "P" for x, y in zip(top, bottom, strict=True)) == steps and counts[3] == sum(counts[:3])


def test_contigs_of_any_length_by_lines(spark, tmp_path):
    from strandloom.sources.long_contigs import fasta_lines, find_targets_in_files, line_chunks

    r, seqs = random.Random(4), {f"c{i}": dna(i, n) for i, n in enumerate((3000, 1, 700, 5000, 40))}
    for part in range(2):
        lines = ["stray"] if part else []
        for name in list(seqs)[part::2]:
            lines.append(f">{name} x > y")
            at = 0
            while at < len(seqs[name]):
                n = r.randint(1, 90)
                lines.append(seqs[name][at : at + n] + "  " * (n % 2))
                at += n
            lines.append("")
        (tmp_path / f"{part}.fa").write_text("\n".join(lines))
    paths = [str(tmp_path / f"{k}.fa") for k in range(2)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "512b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for x in fasta_lines(spark, paths).orderBy("contig", "start").collect():
                assert x.start == len(got.get(x.contig, ""))
                got[x.contig] = got.get(x.contig, "") + x.text
            assert got == seqs
            for x in line_chunks(fasta_lines(spark, paths), 64, 20, 10).collect():
                assert x.text == seqs[x.contig][x["first"] : x["at"] + 84] and x["first"] == max(0, x["at"] - 10)
            whole = find_targets(spark.createDataFrame(list(seqs.items()), "contig string, seq string"), ["N{20}>NGG"])
            assert sorted(map(str, find_targets_in_files(spark, paths, ["N{20}>NGG"]).collect())) == sorted(map(str, whole.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
