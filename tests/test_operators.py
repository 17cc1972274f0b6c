"""Operators against plain Python, file formats round trip, and edge cases."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components
from strandloom.operators.interval_join import interval_join
from strandloom.operators.offtarget import seed_join
from strandloom.operators.target_finder import find_targets, number_rows
from strandloom.plans import api
from strandloom.sources import readers, sinks
from strandloom.streaming.targets import stream_targets

TURN = str.maketrans("ACGT", "TGCA")


def dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def plain_targets(name, seq):
    out = set()
    for strand, s in (("+", seq), ("-", seq.translate(TURN)[::-1])):
        for i in range(len(s) - 22):
            if s[i + 21 : i + 23] == "GG":
                a = i if strand == "+" else len(s) - i - 23
                out.add((name, strand, a, a + 23, s[i : i + 20], s[i + 20 : i + 23]))
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 50])
def test_targets_in_chunks(spark, chunk):
    seqs = {"a": dna(1, 700), "b": dna(2, 30), "c": "ACGT", "d": ""}
    df = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    got = find_targets(df, ["N{20}>NGG"], chunk=chunk)
    want = set().union(*(plain_targets(k, s) for k, s in seqs.items()))
    assert sorted(tuple(r) for r in got.select("contig", "strand", "start", "end", "spacer", "pam").collect()) == sorted(want)
    whole = find_targets(df, ["N{20}>NGG"])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in whole.collect()}


def test_interval_join(spark):
    r = random.Random(3)
    rows = lambda n: [(i, r.choice("xy"), s := r.randrange(500), s + r.choice([0, 1, 5, 90])) for i in range(n)]  # noqa: E731, F841
    a, b = rows(80), rows(60)
    schema = "id int, contig string, start int, end int"
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[1] == y[1] and min(x[3], y[3]) > max(x[2], y[2]))
    for width in (7, 64, 10_000):
        got = interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), width)
        assert sorted(tuple(x) for x in got.select("l_id", "r_id", "overlap").collect()) == want


@pytest.mark.parametrize("packed", [True, False])
def test_seed_join(spark, packed):
    r, base = random.Random(4), [dna(i, 20) for i in range(6)]
    spacers = set(base)
    for s in base:
        for _ in range(8):
            t = list(s)
            for k in r.sample(range(20), r.randint(1, 7)):
                t[k] = r.choice("ACGT")
            spacers.add("".join(t))
    df = spark.createDataFrame([(s,) for s in spacers], "spacer string")
    got = seed_join(df.select(F.col("spacer").alias("guide"), "spacer"), df.select(F.col("spacer").alias("site"), "spacer"), 4, 20, packed)
    want = {(a, b, n) for a in spacers for b in spacers if (n := sum(x != y for x, y in zip(a, b, strict=True))) <= 4}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert sorted((r.k, r.n) for r in number_rows(df, ["k"], "n").collect()) == [(i, i) for i in range(1000)]
    assert number_rows(df.limit(0), ["k"], "n").collect() == []


def test_fasta_files(spark, tmp_path):
    text = ">a one two\nACGT\nacgtn\n>b\n>c x\nGG\n"
    (tmp_path / "x.fasta").write_text(text)
    with gzip.open(tmp_path / "y.fasta.gz", "wt") as f:
        f.write(">d\nTTTT\n")
    got = readers.read_fasta(spark, str(tmp_path))
    assert sorted(tuple(r)[:3] for r in got.collect()) == [("a", "one two", "ACGTacgtn"), ("b", "", ""), ("c", "x", "GG"), ("d", "", "TTTT")]
    assert readers.require_unique(got).count() == 4
    with pytest.raises(ValueError):
        readers.require_unique(got.unionByName(got))
    sinks.write_text(got, sinks.fasta_text(F.col("contig"), F.col("seq"), F.col("info"), 4), str(tmp_path / "out"))
    again = readers.read_fasta(spark, str(tmp_path / "out"))
    assert sorted(tuple(r)[:3] for r in again.collect()) == sorted(tuple(r)[:3] for r in got.collect())


def test_gff_lines(spark):
    lines = ["# comment", "c\ts\tgene\t11\t20\t.\t+\t.\tID=f1;Alias=x,y;Note=a%3Bb=c", "c\ts\tCDS\t1\t5\t1.5\t-\t0", "short\tline", "c\ts\tgene\t1\t5\t.\t.\t.\tID=f2; Name = n ;"]
    got = readers.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.start, r.end, r.strand, r.name) for r in got] == [(10, 20, "+", "f1"), (0, 5, "-", None), (0, 5, None, "f2")]
    assert got[0].attributes["Note"] == "a%3Bb=c" and got[2].attributes["Name"] == "n"


def test_other_formats(spark):
    df = lambda rows: spark.createDataFrame([(x,) for x in rows], "value string")
    h = readers.homolog_groups(readers.parse_homologs(df(["g1\ta\tb", "g2\tb\tc", "g3\td"]))).collect()
    groups = {r.feature: r.group for r in h}
    assert groups["a"] == groups["b"] == groups["c"] != groups["d"]
    rows = spark.createDataFrame(list(enumerate(["CLUSTAL W", "", "one  ACG-", "two  ACGT", "     *** ", "one  TT", "two  T-"])), "number int, value string")
    assert {r.name: r.seq for r in readers.parse_clustal(rows).collect()} == {"one": "ACG-TT", "two": "ACGTT-"}
    r = readers.parse_blast(df(["#c", "q\ts\t99\t20\t0\t0\t1\t20\t50\t31\t1e-5\t40"])).first()
    assert (r.q_start, r.q_end, r.s_start, r.s_end, r.flags) == (0, 20, 30, 50, 16)


def test_genbank(spark):
    notes = F.array(F.struct(F.lit("gene").alias("type"), F.lit(3).alias("start"), F.lit(9).alias("end"), F.lit("-").alias("strand"), F.lit("g").alias("label")))
    text = spark.range(1).select(sinks.genbank_text(F.lit("c1"), F.lit("acgt" * 20), notes).alias("x")).first().x
    assert "complement(4..9)" in text and "        1 acgtacgtac gtacgtacgt" in text and "       61 acgtacgtac gtacgtacgt\n//" in text


def test_find_sequence_without_overlaps(spark):
    df = spark.createDataFrame([("c", "AAAAAGGTTTTT")], "contig string, seq string")
    got = {(r.start, r.end, r.strand) for r in api.find_sequence(df, ["AA"]).collect()}
    assert got == {(1, 2, "+"), (3, 4, "+"), (8, 9, "-"), (10, 11, "-")}


def test_find_feature(spark):
    lines = ["c\ts\tgene\t1\t5\t.\t+\t.\tID=f1;Alias=zz", "c\ts\tgene\t7\t9\t.\t+\t.\tID=f2;Note=has zz", "c\ts\tgene\t8\t9\t.\t+\t.\tID=f3"]
    f = readers.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string"))
    keep = f.withColumn("attributes", F.col("attributes"))
    hit = keep.where(F.exists(F.map_values("attributes"), lambda v: v.rlike("f1")))
    assert [r.name for r in hit.collect()] == ["f1"]


def test_design_targets_and_primers(spark):
    seq = dna(11, 2000)
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    features = spark.createDataFrame([("f1", "c", 200, 400), ("f2", "c", 900, 1200)], "name string, contig string, start int, end int")
    best = api.design_targets(contigs, features, ["N{20}>NGG"]).collect()
    assert {r.feature for r in best} == {"f1", "f2"} and all(1 <= r.rank <= 5 and 0 <= r.guide_score <= 100 for r in best)
    regions = spark.createDataFrame([("r", "c", 100, 160, 500, 560)], "name string, contig string, f_start int, f_end int, r_start int, r_end int")
    for p in api.design_primers(contigs, regions, (19, 22), 30).collect():
        assert 300 <= p["size"] <= 700 and seq.find(p.forward) + p["size"] == seq.find(p.reverse.translate(TURN)[::-1]) + len(p.reverse)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seq = dna(12, 300)
    (tmp_path / "in" / "a.fasta").write_text(f">s\n{seq}\n")
    q = stream_targets(spark, str(tmp_path / "in"), ["N{20}>NGG"]).writeStream.format("memory").queryName("targets_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("targets_seen").select("contig", "strand", "start", "end", "spacer", "pam").collect()} == plain_targets("s", seq)


def test_recombination(spark):
    from strandloom.operators import recombination

    seq, insert = dna(21, 400), "ACGTACGTAA"
    donor = seq[100:150] + insert + seq[180:230]
    back = seq[100:150] + seq[150:180] + seq[180:230]
    contigs = spark.createDataFrame([("c", seq), ("other", dna(22, 200))], "contig string, seq string")
    one = lambda s: spark.createDataFrame([("d", s)], "donor string, seq string")
    r0, r1, r2 = recombination.recombine(contigs, [one(donor), one(back)])
    assert {r.contig: r.seq for r in r1.collect()}["c-d"] == seq[:150] + insert + seq[180:]
    assert {r.contig: r.seq for r in r2.collect()}["c-d-d"] == seq
    assert r0 is contigs and r2.where("contig = 'other'").count() == 1


def test_barcodes_and_alignments(spark):
    from strandloom.functions import barcodes

    found = barcodes.codes("N{8}", 4, 50, 12)
    assert len(found) == 12 and all(barcodes.levenshtein(a, b) >= 4 for i, a in enumerate(found) for b in found[:i])
    assert barcodes.levenshtein("kitten", "sitting") == 3
    lines = barcodes.star_alignment(["ACGTACGT", "ACGACGT", "ACGTTACGT"])
    assert len({len(x) for x in lines}) == 1 and [x.replace("-", "") for x in lines] == ["ACGTACGT", "ACGACGT", "ACGTTACGT"]
    rows = spark.createDataFrame([("g", "a", "ACGT"), ("g", "b", "AGT"), ("h", "c", "TT")], "grp string, name string, seq string")
    assert {r.name: r.seq for r in barcodes.align_groups(rows).collect()} == {"a": "ACGT", "b": "A-GT", "c": "TT"}


def test_spanning_tag(spark):
    from strandloom.operators import donors

    f = spark.createDataFrame([("f", "c", 100, 150, dna(23, 300))], "feature string, contig string, start int, end int, seq string")
    got = donors.spanning_tag(f, "N{20}>NGG", 100, 8).collect()
    assert len(got) >= 8 and all(r.donor[r.up_n : r.up_n + 23] == r.tag and len(r.donor) == 100 for r in got)


@pytest.mark.parametrize("limits", [(0, 0), (2, 0), (1, 1)])
def test_similar_targets(spark, limits):
    from strandloom.functions.barcodes import levenshtein
    from strandloom.operators.similarity import equivalents, similar_targets

    r, rows = random.Random(5), []
    for i in range(8):
        s = dna(30 + i, 20)
        for f in "abc":
            t = list(s)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(20)] = r.choice("ACGT")
            rows.append((f, "".join(t) if r.random() < 0.7 else "".join(t[1:]) + "A"))
    m, g = limits
    near = lambda x, y: levenshtein(x, y) <= m + g if g else sum(p != q for p, q in zip(x, y, strict=True)) <= m
    want = {(a, s, b, t) for a, s in rows for b, t in rows if a > b and near(s, t)}
    df = spark.createDataFrame(rows, "feature string, seq string")
    pairs = similar_targets(df, 20, m, g)
    assert {tuple(x)[:4] for x in pairs.collect()} == want
    if limits == (2, 0):
        groups = spark.createDataFrame([(f, 1) for f in "abc"], "feature string, group int")
        for keep, ok in (("all", lambda n: n == 3), ("exclusive", lambda n: n == 1), ("any", lambda n: True)):
            by = {}
            for x in equivalents(df, pairs, groups, keep).collect():
                by.setdefault(x.component, set()).add(x.feature)
            assert by and all(ok(len(v)) for v in by.values())


def test_small_formatters():
    from strandloom.functions import alignment

    a, b = dna(41, 900), dna(42, 900)
    shared = dna(43, 250)
    one, two = a[:500] + shared + a, b[:300] + shared + b
    i, j, n = alignment.common_region(one, two)
    assert n >= 200 and one[i : i + n] == two[j : j + n] and alignment.common_region(a, b, least=900)[2] < 30
    assert alignment.label_track(["ab", "long", "x"], [6, 4, 1]) == "┌─ab─┐┌lo┐│"


def test_listings(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# motif\tprotein\nN{20}>NGG\tCas9\tcut\tbug\n")
    assert api.list_catalogue(spark, str(tmp_path / "m.tsv")).first().protein == "Cas9"
    assert api.list_algorithms(spark).count() == 18 and api.list_aligners(spark).count() == 4 and api.list_thermodynamics(spark).count() == 1
