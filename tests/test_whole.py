"""Queries over their whole tables, against plain Python."""

import hashlib
import itertools
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

from strandloom.functions.sequence import IUPAC
from strandloom.plans import QUERIES


def rows_of(sf_dir, name, *columns):
    t = pq.read_table(f"{sf_dir}/{name}.parquet", columns=list(columns))
    return list(zip(*(t[c].to_pylist() for c in columns), strict=True))


def result(spark, sf_dir, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect())


def test_homolog_components(spark, sf_dir):
    above = {}

    def root(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for part, supplier in rows_of(sf_dir, "lineitem", "l_partkey", "l_suppkey"):
        a, b = sorted((root(part), root(supplier + 1000000)))
        above[b] = a
    assert result(spark, sf_dir, "homolog_components") == sorted((x, root(x)) for x in above)


TURN = str.maketrans("ACGT", "TGCA")


def letters_of(text):
    return hashlib.md5(text.encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4))


def contigs_of(sf_dir):
    out = defaultdict(str)
    for key, brand in sorted(rows_of(sf_dir, "part", "p_partkey", "p_brand")):
        out[brand] += letters_of(str(key))
    return out


def features_of(sf_dir):
    """(feature, gene, contig, start, end)"""
    out, at = [], Counter()
    for key, brand, kind, size in sorted(rows_of(sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")):
        start = at[brand] * 32 + key % 20
        at[brand] += 1
        out.append((f"f{key}", kind, brand, start, start + 10 + size))
    return out


def test_primer_scan(spark, sf_dir):
    contigs, want = contigs_of(sf_dir), []
    for feature, _, contig, start, end in features_of(sf_dir):
        seq = contigs[contig]
        for size in (18, 20):
            for strand, left, right in (("+", 4, 8), ("-", 8, 4)):
                for i in range(max(start - (size - left), 0), min(end - right, len(seq) - size) + 1):
                    text = seq[i : i + size]
                    want.append((feature, strand, i, text if strand == "+" else text.translate(TURN)[::-1]))
    assert result(spark, sf_dir, "primer_scan") == sorted(want)


def test_mintag_donors(spark, sf_dir):
    contigs, want = contigs_of(sf_dir), []
    for feature, _, contig, start, end in features_of(sf_dir):
        seq = contigs[contig]
        up = seq[max(start - 24, 0) : start]
        for insert in ("", "A", "C", "G", "T"):
            donor = up + insert + seq[end : end + 24]
            for strand, s in (("+", donor), ("-", donor.translate(TURN)[::-1])):
                for i in range(len(s) - 22):
                    at = i if strand == "+" else len(s) - i - 23
                    if s[i + 21 : i + 23] == "GG" and at + 23 >= len(up) and at < len(up) + len(insert):
                        want.append((feature, insert, donor, strand, at, s[i : i + 20]))
    assert result(spark, sf_dir, "mintag_donors") == sorted(want)


def hits_of(sf_dir):
    """(hit, target, contig, start, end, score)"""
    size, brand = {k: len(s) for k, s in contigs_of(sf_dir).items()}, dict(rows_of(sf_dir, "part", "p_partkey", "p_brand"))
    out = []
    for order, part, supplier, number, quantity in rows_of(sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"):
        if part in brand:
            start = (order * 37 + supplier) % (size[brand[part]] - 23)
            out.append((order * 10 + number, supplier % 50, brand[part], start, start + 23, quantity * 2))
    return out


def met_of(sf_dir):
    """(hit, target, feature, gene, contig, overlap) of each hit and feature that overlap."""
    on = defaultdict(list)
    for f in features_of(sf_dir):
        on[f[2]].append(f)
    return [(h[0], h[1], f[0], f[1], h[2], min(h[4], f[4]) - max(h[3], f[3])) for h in hits_of(sf_dir) for f in on[h[2]] if h[3] < f[4] and f[3] < h[4]]


def test_interval_overlap_join(spark, sf_dir):
    assert result(spark, sf_dir, "interval_overlap_join") == sorted((m[0], m[2], m[5]) for m in met_of(sf_dir))


def test_offtarget_classify(spark, sf_dir):
    target, related, want = {}, defaultdict(bool), []
    for hit, t, *_ in hits_of(sf_dir):
        target[hit] = min(t, target.get(hit, t))
    for hit, t, _, gene, *_ in met_of(sf_dir):
        related[hit] |= len(gene) % 2 == t % 2
    for hit, t in target.items():
        donor, near = hit % 3 == 0, related[hit]
        if t % 2 == 0:
            action = ("off" if near else "skip") if donor else ("on" if near else "off")
        else:
            action = ("on" if near else "skip") if donor else "off"
        want.append((hit, action))
    assert result(spark, sf_dir, "offtarget_classify") == sorted(want)


def test_guide_score(spark, sf_dir):
    on, whole = defaultdict(float), defaultdict(float)
    for hit, target, _, _, _, score in hits_of(sf_dir):
        if 10 <= score <= 90:
            w = score * (1000 if hit % 5 == 0 else 1)
            whole[target] += w
            on[target] += w if hit % 2 == 0 else 0
    got = result(spark, sf_dir, "guide_score")
    assert [t for t, _ in got] == sorted(whole) and all(abs(x - 100 * on[t] / whole[t]) < 1e-5 for t, x in got)


def test_homolog_complete_targets(spark, sf_dir):
    genes, covered = defaultdict(set), defaultdict(set)
    for _, gene, contig, *_ in features_of(sf_dir):
        genes[contig].add(gene)
    for _, target, _, gene, contig, _ in met_of(sf_dir):
        covered[target, contig].add(gene)
    want = sorted((t, c, len(x)) for (t, c), x in covered.items() if len(x) * 4 >= len(genes[c]))
    assert result(spark, sf_dir, "homolog_complete_targets") == want


def test_allele_specific_targets(spark, sf_dir):
    features = defaultdict(set)
    for hit, _, feature, *_ in met_of(sf_dir):
        features[hit].add(feature)
    assert result(spark, sf_dir, "allele_specific_targets") == sorted((h, *x) for h, x in features.items() if len(x) == 1)


def alignments_of(sf_dir):
    """(query, subject) -> [(q0, q1)]"""
    out = defaultdict(list)
    for order, part, supplier, number in rows_of(sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"):
        out[order, supplier % 3].append((part % 10, 90 + number * 2))
    return out


def test_flank_pair_filter(spark, sf_dir):
    want = [k for k, x in alignments_of(sf_dir).items() if sum(a < 3 for a, _ in x) == 1 == sum(a >= 3 and b > 97 for a, b in x)]
    assert result(spark, sf_dir, "flank_pair_filter") == sorted(want)


def test_full_length_hit_filter(spark, sf_dir):
    full = {k: [(a, b) for a, b in x if a < 3 and b > 97] for k, x in alignments_of(sf_dir).items()}
    assert result(spark, sf_dir, "full_length_hit_filter") == sorted((*k, *x[0]) for k, x in full.items() if len(x) == 1)


def columns_of(sf_dir):
    """(group, place) -> numbers of letters"""
    out = defaultdict(Counter)
    for key, brand in rows_of(sf_dir, "part", "p_partkey", "p_brand"):
        text = hashlib.md5(f"m{key % 7}{brand}".encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACG-"))
        for i, nt in enumerate(text, 1):
            out[brand, i][nt] += 1
    return out


def test_msa_consensus(spark, sf_dir):
    want = []
    for (group, i), n in columns_of(sf_dir).items():
        total, gaps = n.total(), n.pop("-", 0)
        best = max(n.values(), default=None)
        mark = " "
        if not gaps:
            mark = "*" if best == total else "|" if best * 4 >= total * 3 else ":" if best * 2 >= total else "." if best * 4 >= total else " "
        want.append((group, i, "".join(sorted(x for x in n if n[x] == best)) or None, best, mark))
    got = QUERIES["msa_consensus"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_msa_gap_filter(spark, tmp_path):
    # at one place most rows have a gap, all in rows that a key test would leave out
    text = lambda key, brand: hashlib.md5(f"m{key % 7}{brand}".encode()).hexdigest()
    brand, place = next((b, i) for b in map(str, range(2000)) for i in range(32) if all(text(k, b)[i] == "f" for k in (0, 1, 2)) and all(text(k, b)[i] != "f" for k in (3, 4, 5, 6)))
    keys = [3, 7, 8, 9, 17]
    pq.write_table(pa.table({"p_partkey": keys, "p_brand": [brand] * len(keys)}), tmp_path / "part.parquet")
    want = [k for k, n in columns_of(tmp_path).items() if n["-"] * 2 <= n.total()]
    assert result(spark, tmp_path, "msa_gap_filter") == sorted(want) and (brand, place + 1) not in want


def test_msa_window_search(spark, sf_dir, tmp_path):
    whole = pq.read_table(f"{sf_dir}/part.parquet", columns=["p_partkey", "p_brand"])
    keys = [k for k in whole["p_partkey"].to_pylist() if k % 10 >= 7]
    pq.write_table(pa.table({"p_partkey": keys, "p_brand": [str(k % 9) for k in keys]}), tmp_path / "part.parquet")
    columns, want = columns_of(tmp_path), []
    for group in {g for g, _ in columns}:
        gap = {i: "-" in columns[group, i] for i in range(1, 33)}
        fits = [i for i in range(1, 26) if sum(gap[j] for j in range(i, i + 8)) <= 3]  # 8 columns never have over 8 mismatches
        if fits:
            want.append((group, max(fits), len(fits)))
    assert want and result(spark, tmp_path, "msa_window_search") == sorted(want)


def oligos_of(sf_dir, prefix, alphabet):
    turn = str.maketrans("0123456789abcdef", alphabet)
    return [(k, hashlib.md5(f"{prefix}{k}".encode()).hexdigest().translate(turn)) for (k,) in rows_of(sf_dir, "part", "p_partkey")]


def test_target_case_filter(spark, sf_dir):
    want = []
    for key, s in oligos_of(sf_dir, "m", "ACGTacgtACGTacgt"):
        s = (s.upper(), s.lower(), s)[key % 3]
        low, up = s.upper() != s, s.lower() != s
        want.append((key, True, not low, not up, low, up, low and up))
    assert result(spark, sf_dir, "target_case_filter") == sorted(want)


RARE = "RYMKWSBDHVN"


def sparse_of(sf_dir):
    return [(k, s.replace("?", RARE[k % len(RARE)])) for k, s in oligos_of(sf_dir, "r", "ACGTACGTACGTACG?")]


def test_target_ambiguity_discard(spark, sf_dir):
    want = sorted((k, s) for k, s in sparse_of(sf_dir) if not set(s) - set("ACGT"))
    assert want and result(spark, sf_dir, "target_ambiguity_discard") == want


def test_target_disambiguate(spark, sf_dir):
    want = [(k, "".join(x)) for k, s in sparse_of(sf_dir) for x in itertools.product(*(IUPAC[c] for c in s))]
    assert result(spark, sf_dir, "target_disambiguate") == sorted(want)


def test_donor_splits(spark, sf_dir):
    assert result(spark, sf_dir, "donor_splits") == sorted((k, i, s[:i], s[i:]) for k, s in oligos_of(sf_dir, "o", "ACGT" * 4) for i in range(4, 29))
