"""Near duplicates, embeddings, exact search: against brute force, and edge cases."""

import collections
import math
import random

import numpy as np
import pytest

from strandloom.llm import bagminhash as B
from strandloom.llm import embedding_dedup, kdtree_topk
from tests.llm.conftest import edge_rows, prose


def bag(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}


def jaccard(a, b):
    low = sum(min(a[s], b[s]) for s in a if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if low else 0.0


def classes(texts: dict):
    bags, root = {k: bag(t) for k, t in texts.items()}, {k: k for k in texts}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if jaccard(bags[a], bags[b]) >= 0.8:
                x, y = up(a), up(b)
                root[max(x, y)] = min(x, y)
    return {k: up(k) for k in keys}


def test_similarity_is_weighted_jaccard():
    r = random.Random(2)
    texts = [prose(r.randint(0, 9), r.randint(1, 300)) for _ in range(20)] + ["a b", "a b c d e", "a b c d e a b c d e a b c d e"]
    found = B.bags([t.encode() for t in texts])
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert B.similarity(found[i], found[j]) == pytest.approx(jaccard(bag(texts[i]), bag(texts[j])))


@pytest.mark.parametrize("counts", [({1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}), ({1: 5, 2: 3}, {1: 3, 2: 3, 3: 2}), ({1: 100, 2: 7}, {1: 37, 2: 90}), ({1: 1000}, {1: 600})])
def test_signatures_estimate_without_bias(counts):
    rng, agree, rounds = np.random.default_rng(3), 0, 60
    for _ in range(rounds):
        name = {k: np.uint64(rng.integers(1, 2**63)) for k in range(1, 5)}
        pair = []
        for c in counts:
            h = np.array([name[k] for k in c], np.uint64)
            order = np.argsort(h)
            pair.append((h[order], np.array(list(c.values()))[order]))
        a, b = B.signatures(pair)
        agree += (a == b).mean() / rounds
    low = sum(min(counts[0].get(k, 0), counts[1].get(k, 0)) for k in range(1, 5))
    want = low / (sum(counts[0].values()) + sum(counts[1].values()) - low)
    assert abs(agree - want) < 4 * math.sqrt(want * (1 - want) / (rounds * B.PLACES)) + 1e-9


def test_near_duplicates_edges(edge, clashing, empty):
    texts = {k: t for k, t, *_ in edge_rows() if k is not None}
    want = classes(texts)
    for df in (edge, clashing):
        rows = B.near_duplicates(df).collect()
        assert len(rows) == len(edge_rows())
        for r in rows:
            if r.doc_id is None:
                assert r.class_id is None and r.kept
            else:
                assert r.class_id == want[r.doc_id] and r.kept == (r.doc_id == r.class_id)
    assert B.near_duplicates(empty).collect() == []
    left = sorted(r.doc_id for r in B.one_of_each(clashing).collect() if r.doc_id is not None)
    assert left == sorted(set(want.values()))
    assert B.one_of_each(clashing).columns == clashing.columns


def test_large_group_of_near_copies(spark):
    """Many texts around one, mostly under the threshold of each other: all links between components must be found."""
    base, rows = prose(7, 150).split(), []
    for i in range(90):
        r, w = random.Random(i), list(base)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = classes(dict(rows))
    assert 1 < len(set(want.values())) < 90
    got = {r.doc_id: r.class_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["BLOCK", "STAR"])
def test_groups_of_few(spark, monkeypatch, name):
    monkeypatch.setattr(B, name, 10)
    test_large_group_of_near_copies(spark)


def test_an_id_with_several_texts(spark):
    a, b = prose(1, 100), prose(2, 100)
    near = b.split()
    near[3] = "changed"
    rows = [(5, a), (5, b), (9, " ".join(near)), (11, a), (11, a), (12, prose(3, 60)), (12, prose(3, 60)), (13, None), (13, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id, r.kept) for r in B.near_duplicates(df).collect())
    assert got == {(5, 5, True): 2, (9, 5, False): 1, (11, 5, False): 2, (12, 12, True): 2, (13, 13, True): 2}
    left = collections.Counter((r.doc_id, r.text) for r in B.one_of_each(df).collect())
    assert left == collections.Counter([(5, a), (5, b), (12, prose(3, 60)), (13, None), (13, "")])


def test_hierarchy_wastes_at_most_half():
    """The nodes of a count cover it, and reach at most as far again; equal counts below a node's end share the node's points."""
    for c in range(1, 300):
        doc, seed, width, start, count = B._nodes(np.zeros(1, np.int64), np.array([77], np.uint64), np.array([c]))
        assert sorted(zip(start.tolist(), (start + width).tolist(), strict=True)) == [(0, 1), *((1 << k, 2 << k) for k in range((c - 1).bit_length()))]
        assert int(width.sum()) < 2 * c + (c == 1) and len(set(seed.tolist())) == len(seed)


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=16) * 0.08], i % 3) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, rows[0][1], 0), (202, rows[0][1], 0)]
    rows += [(210, None, 0), (211, [0.0] * 16, 0), (212, [None] + [1.0] * 15, 0), (213, [float("nan")] * 16, 0), (214, [float("inf")] * 16, 0), (215, [1.0] * 16, None), (216, [1.0] * 3, 0), (217, [], 0), (None, rows[0][1], 0)]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [2048, 7])
def test_embedding_dedup(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS + ", cid string, n string")
    good = [(k, np.array(v, float), y) for k, v, y in rows if usable(v) and any(v) and y is not None and k is not None]
    links, root = collections.Counter(), {k: k for k, _, _ in good}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, u, x) in enumerate(good):
        for j, (b, v, y) in enumerate(good):
            if i != j and x == y and len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.98:
                links[i] += 1
                p, q = up(a), up(b)
                root[max(p, q)] = min(p, q)
    want = collections.Counter((k, links[i], up(k), up(k) == k) for i, (k, _, _) in enumerate(good))
    got = embedding_dedup.near_duplicates(df, block=block).collect()
    assert len(got) == len(rows)
    assert collections.Counter(tuple(r) for r in got if r.vec_id is not None and r.vec_id in root) == want
    assert sum(links.values()) > 100
    for r in got:
        if r.vec_id is None or r.vec_id not in root:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept == (r.vec_id is not None)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_quantised_bound_holds():
    rng = np.random.default_rng(8)
    a = embedding_dedup.Quantised(rng.normal(size=(200, 24)) * rng.lognormal(size=(200, 1)))
    unit = a.raw / a.norm[:, None]
    exact, got = unit @ unit.T, (a.q.astype(float) @ a.q.T.astype(float)) * a.scale[:, None] * a.scale
    slack = a.lost[:, None] * (a.part + a.lost) + a.part[:, None] * a.lost
    assert (np.abs(exact - got) <= slack + 1e-12).all()
    for threshold in (0.3, 0.9, 1.0):
        sure, maybe = np.zeros(exact.shape, bool), np.zeros(exact.shape, bool)
        for i, j, s in embedding_dedup.bounded(a, a, threshold):
            sure[i, j], maybe[i, j] = s, True
        assert (exact[sure] >= threshold).all() and (exact[~maybe] < threshold).all()


@pytest.mark.parametrize("sizes", [(8192, 2048), (16, 3)])
def test_exact_top_k(spark, sizes):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", shard string")
    good = [(k, [math.floor(64 * x) for x in v]) for k, v, _ in rows if usable(v) and k is not None]
    want = set()
    for k, q in good:
        if k % 20 == 0:
            best = sorted(((-sum(x * y for x, y in zip(q, v, strict=True)), i) for i, v in good if i != k and len(v) == len(q)))[:20]
            want |= {(k, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    from pyspark.sql import functions as F

    got = kdtree_topk.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=sizes[0], block=sizes[1])
    assert {tuple(r) for r in got.collect()} == want
    assert kdtree_topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).collect() == []


def test_search_prunes_and_is_exact():
    rng = np.random.default_rng(6)
    x, q = rng.integers(-64, 64, (3000, 8)), rng.integers(-64, 64, (20, 8))
    for big in (1, 10**6, 10**7):
        tree = kdtree_topk.Tree.build(x * big, np.arange(3000), leaf=32)
        row, got, score, scored = kdtree_topk.search(tree, q * big, np.full(20, -1), np.full(20, kdtree_topk.NONE), 5)
        full = (q * big) @ (x * big).T
        for i in range(20):
            best = sorted(zip(-full[i], range(3000), strict=True))[:5]
            assert [(-s, j) for s, j in best] == list(zip(score[row == i].tolist(), got[row == i].tolist(), strict=True))
        assert scored < 0.5 * full.size  # most leaves stay closed
    inner = tree.child >= 0
    for side in (0, 1):
        assert (tree.low[tree.child[inner] + side] >= tree.low[inner]).all() and (tree.high[tree.child[inner] + side] <= tree.high[inner]).all()


def test_cells_cut_every_row():
    rng = np.random.default_rng(7)
    x = rng.integers(-5, 5, (500, 3))
    cells = list(kdtree_topk.halves(x, 16))
    at = kdtree_topk.cell_of(x, cells)
    assert len(set(at.tolist())) == 16 and set(at.tolist()) <= {n for n, _, left, _ in cells if left < 0}
    assert kdtree_topk.cell_of(x, list(kdtree_topk.halves(x[:1], 16))).tolist() == [0] * 500
    assert len(list(kdtree_topk.halves(np.zeros((40, 0), np.int64), 8))) == 1


def test_a_query_id_that_repeats(spark):
    rows = [(20, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [0.5, 0.0], 0), (2, [0.25, 0.0], 0), (40, [0.0, 1.0], 0)]
    from pyspark.sql import functions as F

    got = [tuple(r) for r in kdtree_topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 4096), (20, 2, 2, 2048), (20, 3, 2, 1024), (40, 1, 1, 4096), (40, 2, 2, 0), (40, 3, 2, 0)]
