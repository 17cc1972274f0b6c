"""WARC, sharding, language model, mixing and the pipeline: round trips, brute force and edge cases."""

import collections
import hashlib
import io
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import _chunks, flow_sharding, katz_lm, language_id, queries, raking_mix, warc
from strandloom.session import scratch_path
from tests.llm.conftest import CLASHES, edge_rows, prose
from tests.llm.test_pairs import classes

PAGES = "page_id long, url string, html string"


def page_rows():
    rows = [(i, f"http://h/{i}?a=b c\r\nX: y", f"<p>{prose(i, 30)}</p>é") for i in range(3, 40)]
    return rows + [(50, None, None), (51, "u", ""), (52, "u", rows[5][2]), (1, "u", rows[5][2]), (None, "u", rows[5][2]), (60, "u", "dup"), (60, "u", "dup"), (61, "u", "dup"), (None, "v", "alone"), (70, "u", prose(1, 200_000))]


@pytest.mark.parametrize("split", [4 << 20, 999])
def test_warc_round_trip(spark, split):
    df = spark.createDataFrame([(*r, "x") for r in page_rows()], PAGES + ", payload_digest string").repartition(3)
    manifest = warc.write(df, scratch_path(spark, "warc"), file_bytes=3000)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == len(page_rows())
    first = {}
    for k, _, html in page_rows():
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    want = collections.Counter()
    for k, _, html in page_rows():
        f = first.get(html or "")
        revisit = f is not None and k != f
        want[k, len((html or "").encode()), warc.digest((html or "").encode()), "revisit" if revisit else "response", f if revisit else None] += 1
    got = warc.read(manifest, split_bytes=split).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    bodies = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id}
    assert all(bodies[k] == (h or "") for k, _, h in page_rows() if k in bodies)


def test_warc_empty_and_threshold(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).collect() == []
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    got = {r.page_id: r.record_type for r in warc.round_trip(spark, df, revisit_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_members_are_owned_once_and_damage_is_an_error():
    records = [warc.build_record(i, "u", prose(i, 1 + i * 7 % 90).encode(), None, False) for i in range(60)]
    data = b""
    for r in records:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        data += z.compress(r) + z.flush()
    for split in (1, 37, 500, 10**6):
        got = [m for s in range(0, len(data), split) for m in warc.members(io.BytesIO(data), s, min(len(data), s + split))]
        assert got == records
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5]), 0, len(data)))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5]), len(data) // 2, len(data)))


def stored(record):
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def test_an_archive_inside_a_record_is_no_record():
    """Neither the writer's members, which hide it, nor foreign ones, in which it lies as it is."""
    inner = b"".join(stored(warc.build_record(i, "u", prose(i, 20).encode(), None, False)) for i in range(20))
    records = [warc.build_record(i, "u", inner if i % 3 == 1 else prose(i, 40).encode(), None, False) for i in range(9)]
    for pack in (lambda r: warc.build_member(r, 4), stored):
        packed = [pack(r) for r in records]
        data = b"".join(packed)
        assert [zlib.decompress(p, 31) for p in packed] == records
        for split in (700, 20_000, 10**7):
            got = [m for s in range(0, len(data), split) for m in warc.members(io.BytesIO(data), s, min(len(data), s + split))]
            assert pack is stored and split < len(inner) or got == records
    assert warc.MAGIC in b"".join(map(stored, records[1:2]))[10:] and warc.MAGIC not in warc.build_member(records[1], 0)[10:]


def test_a_member_larger_than_many_splits():
    records = [warc.build_record(1, "u", random.Random(1).randbytes(3_000_000), None, False), warc.build_record(2, "u", b"x", None, False)]
    data = b"".join(warc.build_member(r, 1) for r in records)
    got = [m for s in range(0, len(data), 50_000) for m in warc.members(io.BytesIO(data), s, min(len(data), s + 50_000))]
    assert got == records


def test_only_whole_headers_count():
    good = warc.build_record(1, "u", b"x", None, False)
    assert warc.is_record(good) and not any(map(warc.is_record, (b"WARC/1", b"WARC/1.1\r\n\r\n", good.replace(b"WARC/1.1", b"WARC/x"), good.replace(b"Content-Length", b"Content-Size"), good.replace(b"WARC-Record-ID", b"ID"))))


def test_shared_folders_have_known_schemes():
    with pytest.raises(ValueError):
        _chunks.shared_fs("nosuchscheme://bucket/x")
    assert _chunks.shared_fs("/tmp/x")[1] == "/tmp/x"


def test_flow_moves_the_fewest_bytes():
    r = random.Random(1)
    for _ in range(20):
        n, m = r.randint(1, 5), r.randint(1, 6)
        sizes = [r.randint(0, 50) for _ in range(n)]
        total = sum(sizes)
        capacities = [total // m + (j < total % m) for j in range(m)]
        flow = flow_sharding.transfers(sizes, capacities)
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(n)] == sizes
        assert [sum(f for (_, j), f in flow.items() if j == k) for k in range(m)] == capacities
        kept = sum(min(sizes[i], capacities[i]) for i in range(min(n, m)))
        assert sum(f for (i, j), f in flow.items() if i == j) == kept


def test_place_is_even():
    r = random.Random(2)
    blocks = {(i, b): r.randint(16, 400) for i in range(4) for b in range(200)}
    at = flow_sharding.place(blocks, 7)
    load = collections.Counter()
    for k, j in at.items():
        load[j] += blocks[k]
    assert max(load.values()) - min(load.values()) < 16
    moved = sum(blocks[k] for k, j in at.items() if k[0] != j)
    assert moved < sum(blocks.values()) * (3 / 7 + 0.02)
    assert flow_sharding.place({}, 3) == {}


def test_shards(spark, edge, clashing, empty):
    for df in (edge, clashing):
        planned = flow_sharding.plan(df, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int"), 3, 5, blocks=64)
        path = scratch_path(spark, "shards")
        written = flow_sharding.rewrite(planned, path)
        rows = written.select("doc_id", "text", F.col(planned.name("shard")).alias("to"), F.col(planned.name("slot")).alias("at")).collect()
        assert df is edge or all(set(r) == {"x"} for r in written.select("__shard", "__part").collect())
        assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((k, t) for k, t, *_ in edge_rows())
        by = collections.defaultdict(list)
        for r in rows:
            by[r.to].append(r["at"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(5))
        if planned.affected:
            assert spark.read.parquet(path).count() > 0
    none = flow_sharding.plan(empty, F.lit(0), 1, 5)
    assert flow_sharding.rewrite(none, scratch_path(spark, "shards")).collect() == []


def test_query_moves_near_the_least(spark, sf_dir):
    """The registered query's placement: whole rows, gapless slots, near equal sizes, and moved bytes near the flow's least."""
    docs = queries.table(spark, sf_dir, "documents")
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    rows = queries.QUERIES["op8_flow_sharding"](spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    load, slots, before = [0] * queries.SHARDS, collections.defaultdict(list), [0] * queries.OLD_SHARDS
    moved = 0
    for r in rows:
        old = zlib.crc32(str(r.doc_id).encode()) % queries.OLD_SHARDS
        load[r.shard] += r["size"]
        before[old] += r["size"]
        moved += r["size"] * (old != r.shard)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(load) - min(load) <= largest
    least = sum(f for (i, j), f in flow_sharding.transfers(before, flow_sharding.capacities_of(sum(load), queries.SHARDS)).items() if i != j)
    assert abs(moved - least) <= (max(load) - min(load)) * queries.SHARDS  # sizes differ a little, so the least may be undercut


def test_slots_of_repeated_ids_are_decided_by_the_text(spark):
    rows = [(1, f"text {i}") for i in range(10)] * 2
    got = []
    for parts in (1, 4):
        planned = flow_sharding.plan(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), F.lit(0), 1, 2)
        got.append(sorted((r[planned.name("slot")], r.text) for r in flow_sharding.rewrite(planned, scratch_path(spark, "shards")).collect()))
    assert got[0] == got[1]


def test_blocks_have_no_limit(spark):
    df = spark.createDataFrame([(i, "x" * 20) for i in range(50)], "doc_id long, text string")
    planned = flow_sharding.plan(df, F.lit(0), flow_sharding.MOST_BLOCKS + 5, 3)
    assert flow_sharding.rewrite(planned, scratch_path(spark, "shards")).count() == 50


def test_untouched_shards_stay(spark):
    df = spark.createDataFrame([(i, "x" * 20) for i in range(40)], "doc_id long, text string")
    planned = flow_sharding.plan(df, (F.col("doc_id") % 4).cast("int"), 4, 4, blocks=32)
    assert planned.affected == set() and planned.untouched == {0, 1, 2, 3}
    assert flow_sharding.rewrite(planned, scratch_path(spark, "shards")).count() == 40


def katz(docs: dict, train: set, order: int):
    """The model by its definition: (texts, word counts, their sum, unknown word's probability, p(history, word), continuations)."""
    low = katz_lm.LOW
    tok = lambda x: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")) + [None]
    texts = {k: tok(t) for k, t in docs.items()}
    uni, after = collections.Counter(), collections.defaultdict(collections.Counter)
    for k in train:
        line = ["<b>"] * (order - 1) + texts[k]
        for i in range(order - 1, len(line)):
            uni[line[i]] += 1
            for n in range(1, order):
                after[tuple(line[i - n : i])][line[i]] += 1
    counts = lambda values: [0, *(sum(1 for v in values if v == r) for r in range(1, low + 2))]
    total, du = sum(uni.values()), katz_lm.discounts(counts(uni.values()))
    by = {n: katz_lm.discounts(counts([v for h, c in after.items() if len(h) == n for v in c.values()])) for n in range(1, order)}
    d = lambda t, c: t[c] if c <= low else 1.0
    unknown = sum((1 - d(du, c)) * c for c in uni.values()) / total if total else 1.0
    plus = 0
    if total and unknown <= 0:
        du, plus, unknown = [1.0] * (low + 1), 1, 1 / (total + 1)

    def p(h, w):
        if not h:
            return d(du, uni[w]) * uni[w] / (total + plus) if uni[w] else unknown
        if h not in after:
            return p(h[1:], w)
        own, db = after[h], by[len(h)]
        freed = sum((1 - d(db, c)) * c for c in own.values())
        line = sum(own.values()) + (freed <= 0)
        if w in own:
            return d(db, own[w]) * own[w] / line
        return (freed if freed > 0 else 1) / line / (1 - sum(p(h[1:], x) for x in own)) * p(h[1:], w)

    return texts, uni, total, unknown, p, after


@pytest.mark.parametrize(("chunk", "order"), [(16 << 20, 2), (300, 2), (16 << 20, 3), (300, 3), (700, 4)])
def test_language_model(spark, monkeypatch, chunk, order):
    monkeypatch.setattr(_chunks, "CHUNK_BYTES", chunk)
    r = random.Random(3)
    words = ["The", "of", "and", "A", "é", "|", *(f"w{i}" for i in range(60))]
    docs = {i: " ".join(r.choices(words, [60, 30, 20, 10, 5, 5, *([1] * 60)], k=r.randint(0, 80))) for i in range(120)}
    docs |= {200: None, 201: "", 202: " \t\n", 203: "unseen words only", 204: "the the the the", 205: "the of the of " * 100}
    train = {k for k in docs if k % 4}
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id long, text string, h string").repartition(3)
    got = {x.doc_id: x for x in katz_lm.score(df, F.col("doc_id") % 4 != 0, order=order).collect()}
    texts, uni, total, unknown, p, after = katz(docs, train, order)
    assert sum(p((), w) for w in uni) + unknown == pytest.approx(1)
    for h in [*sorted(after)[:3], *(("<b>",) * n for n in range(1, order)), ("the",) * (order - 1)]:
        assert sum(p(h, w) for w in set(uni) | {"<unseen>"}) == pytest.approx(1)
    assert len(got) == len(docs)
    for k, x in texts.items():
        line = ["<b>"] * (order - 1) + x
        s = sum(math.log10(p(tuple(line[i - order + 1 : i]), line[i])) for i in range(order - 1, len(line)))
        base = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in x)
        assert got[k].score == pytest.approx(s) and got[k].base_score == pytest.approx(base)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens, got[k].held_out) == (len(x), sum(uni[w] > 0 for w in x), total, k not in train)


def test_differences_come_back():
    r = np.random.default_rng(1)
    rows = np.unique(r.integers(0, 6, (200, 3)) * [1, 1 << 33, 7], axis=0).T
    apart = katz_lm.differences(list(rows))
    assert min(int(c.min()) for c in apart) >= 0
    assert [c.tolist() for c in katz_lm.sums_of_differences(apart)] == [c.tolist() for c in rows]


def test_unique_rows_when_hashes_meet(monkeypatch):
    rows = [np.array([3, 1, 3, 2, 1]), np.array([1 << 40, 5, 1 << 40, 5, 6])]
    want = [0, 1, 0, 2, 3]
    for hashed in (katz_lm.mixed, lambda x: np.zeros(len(x), np.uint64)):
        monkeypatch.setattr(katz_lm, "mixed", hashed)
        got = katz_lm.unique_rows(rows).tolist()
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(5) for j in range(5))


def test_language_model_edges(edge, clashing, empty):
    for df in (edge, clashing):
        rows = katz_lm.score(df, F.lit(True)).collect()
        assert len(rows) == len(edge_rows()) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
        assert sorted(r.n_tokens for r in rows if r.doc_id in (0, 1, 2)) == [1, 1, 1]
    untrained = katz_lm.score(edge, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 and r.n_known == 0 for r in untrained)
    assert katz_lm.score(empty, F.lit(True)).collect() == []


def test_mixing_meets_its_targets(spark, monkeypatch):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    anchors = raking_mix.learn_topics(docs)
    held = collections.Counter(w for r in docs.collect() for w in set((r.text or "").split(" ")) if len(w) >= 4)
    most = docs.count() / 8
    assert anchors == sorted((w for w, n in held.items() if n <= most), key=lambda w: (-held[w], w))[:12]
    out = raking_mix.mix(docs).collect()
    texts = {r.doc_id: collections.Counter((r.text or "").split(" ")) for r in docs.collect()}
    for r in out:
        best = max(anchors, key=lambda w: (texts[r.doc_id][w], -anchors.index(w)))
        assert r.topic == (best if best in texts[r.doc_id] else "other")
    assert max(r.probability for r in out) == 1 and all(0 <= r.probability <= 1 for r in out)
    expected, drawn = sum(r.probability * r.n_tokens for r in out), sum(r.n_tokens for r in out if r.sampled)
    assert expected == pytest.approx(0.5 * sum(r.n_tokens for r in out), rel=1e-6)
    assert drawn == pytest.approx(expected, rel=0.25)
    # without the broadcast of cells nothing changes
    monkeypatch.setattr(raking_mix, "BROADCAST_CELLS", 0)
    assert sorted(map(tuple, raking_mix.mix(docs).collect())) == sorted(map(tuple, out))


def test_raking_converges(spark):
    r = random.Random(1)
    cells = [(f"s{i}", f"l{j}", f"t{k}", r.randint(1, 900)) for i in range(6) for j in range(3) for k in range(4)]
    raked = raking_mix.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")).collect()
    for s in raking_mix.SIDES:
        sums, want = collections.Counter(), {}
        for x in raked:
            sums[x[s]] += x.w
            want[x[s]] = x[f"t_{s}"]
        assert sum(want.values()) == pytest.approx(1)
        assert all(sums[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_marginals_and_topic_column(spark):
    rows = [(i, "a b c d" * (1 + i % 3), f"s{i % 2}", "en" if i % 5 else "de", f"k{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    out = raking_mix.mix(df, keep=0.2, topic_column="kind")
    assert {r.topic for r in out.select("topic").collect()} == {"k0", "k1", "k2"} and out.agg(F.max("probability")).first()[0] < 1
    for r in raking_mix.marginals(out).collect():
        assert r.expected == pytest.approx(r.target, rel=1e-6) and 0 < r.observed < 1


def test_mixing_edges(edge, clashing, empty):
    for df in (edge, clashing):
        rows = raking_mix.mix(df).collect()
        assert len(rows) == len(edge_rows())
        assert {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
        drawn = collections.Counter(r.doc_id for r in rows if r.sampled)
        kept = raking_mix.mix(df, keep_all_columns=True)
        assert kept.columns == df.columns and collections.Counter(r.doc_id for r in kept.collect()) == drawn
        assert df is edge or {r.topic for r in kept.collect()} <= {"x"}
    assert raking_mix.mix(empty).collect() == []


def test_queries_and_stages_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {m[0] for m in (re.match(r"op\d+_", k) for k in names) if m}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][2] == "near_duplicates"


@pytest.fixture(scope="module")
def small(spark, edge, labels, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    edge.write.parquet(os.path.join(d, "documents.parquet"))
    labels.write.parquet(os.path.join(d, "labels.parquet"))
    return d


def test_stages_on_edges(spark, clashing, empty, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, small)
        assert name == "sentencepiece" or out.columns == clashing.columns
        assert name == "sentencepiece" or all(set(r) == {"x"} for r in out.select(*CLASHES[:4]).collect())
        assert out.count() <= clashing.count()
        assert stage(spark, empty, small).collect() == []


def test_stage_decisions(spark, edge, small):
    stage = dict(corpus_pipeline.STAGES)
    named = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    left = named(stage["language"](spark, edge, small))
    assert not left & {0, 1, 2, 4} and set(range(10, 60)) <= left
    unique = stage["near_duplicates"](spark, edge, small)
    assert not named(unique) & {71, 72, 73, 74, 75, 80, 81} and 70 in named(unique)


def test_pipeline_runs(spark):
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    assert out.columns[0] == "doc_id" and 0 < out.count() <= spark.read.parquet(f"{d}/documents.parquet").count()


def mixed(rows):
    """Rows (id, text, source, lang) that mixing draws, by its definition in plain Python."""
    words = {i: (t or "").split(" ") for i, t, _, _ in rows}
    held = collections.Counter(w for i, *_ in rows for w in set(words[i]) if len(w) >= raking_mix.LETTERS)
    fits = lambda n: n * raking_mix.RARE <= len(rows) <= n * raking_mix.MOST_RARE
    anchors = sorted((w for w, n in held.items() if fits(n)), key=lambda w: (-held[w], w))[: raking_mix.TOPICS]
    cell, n = {}, {}
    for i, t, source, lang in rows:
        own = collections.Counter(w for w in words[i] if w in anchors)
        cell[i] = (source or "(none)", lang or "(none)", min(own, key=lambda w: (-own[w], anchors.index(w))) if own else raking_mix.OTHER)
        n[i] = len(words[i]) if t else 0
    tokens = collections.Counter()
    for i, c in cell.items():
        tokens[c] += n[i]
    tokens = {c: float(x) for c, x in tokens.items() if x}
    sums = [collections.Counter() for _ in range(3)]
    for c, x in tokens.items():
        for k in range(3):
            sums[k][c[k]] += x
    goal = [{v: x**raking_mix.TEMPER / sum(y**raking_mix.TEMPER for y in s.values()) for v, x in s.items()} for s in sums]
    w = dict(tokens)
    for _ in range(raking_mix.MOST_SWEEPS):
        for k in range(3):
            now = collections.Counter()
            for c, x in w.items():
                now[c[k]] += x
            w = {c: x * goal[k][c[k]] / now[c[k]] for c, x in w.items()}
    ratio, whole = {c: w[c] / tokens[c] for c in w}, sum(tokens.values())
    factor, taken = 0.0, None
    while (full := {c for c in ratio if ratio[c] * factor >= 1}) != taken:
        taken = full
        factor = max(factor, (raking_mix.KEEP * whole - sum(tokens[c] for c in full)) / sum(w[c] for c in w if c not in full))
    draw = lambda i: int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:12], 16) / 2**48
    return {i for i in cell if draw(i) < round(min(1.0, ratio.get(cell[i], 0.0) * factor), 9)}


def test_pipeline_end_to_end(spark):
    """Every stage's decisions by the models in plain Python, exact similarities, raking in plain Python, and the library's ids."""
    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    model = language_id.train(docs.where(corpus_pipeline.remainder("doc_id", 4) != 2))
    scores = model.predict([t.encode() if t is not None else None for _, t, _, _ in rows])[1]
    rows = [r for r, x in zip(rows, scores, strict=True) if x >= corpus_pipeline.LEAST_LANGUAGE]
    named = lambda: docs.where(F.col("doc_id").isin([r[0] for r in rows]))
    quality = queries.quality_model(named(), queries.table(spark, d, "labels"))
    scores = quality.predict([t.encode() if t is not None else None for _, t, _, _ in rows])[0]
    rows = [r for r, x in zip(rows, scores, strict=True) if x >= corpus_pipeline.LEAST_QUALITY]
    groups = classes({i: t for i, t, _, _ in rows})
    rows = [r for r in rows if groups[r[0]] == r[0]]
    kept = mixed(rows)
    sp = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t, _, _ in rows if i in kept}
    got = [tuple(r) for r in corpus_pipeline.run(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(want) > 20 and set(got) == want
