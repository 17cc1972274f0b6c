"""The queries of this subpackage with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bagminhash, embedding_dedup, flow_sharding, katz_lm, kdtree_topk, language_id, quality_cnn, raking_mix, sentencepiece_codec, warc
from strandloom.llm._rows import remainder
from strandloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def piece_model() -> bytes:
    import public_tokenizers

    return sentencepiece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digest(table(spark, sf_dir, "documents"), piece_model())


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(remainder("doc_id", 4) != 2))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


#: Rows to learn quality from are those whose remainder by this number is not 0.
QUALITY_FOLDS = 5


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_cnn.Model:
    return quality_cnn.train(docs, labels.where(remainder("doc_id", QUALITY_FOLDS) != 0))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_cnn.predict(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    held = (remainder("doc_id", QUALITY_FOLDS) == 0).alias("held_out")
    return found.select("doc_id", held, "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op3_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), component AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.vec_id = e.vec_id LEFT JOIN degree d ON d.vec_id = e.vec_id
"""


@query
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op7_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20
"""


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("target_uri")


SQL["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p),
b AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    (instr('0123456789abcdef', substr(hex, 1 + (5 * k) // 4, 1)) - 1) * 16
    + (instr('0123456789abcdef', substr(hex || '0', 2 + (5 * k) // 4, 1)) - 1)) // (CASE (5 * k) % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)
    % 32)::INTEGER, 1)), 'string_agg', '') AS digest FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM b
"""

#: How many shards documents lie in before, and how many they go to.
OLD_SHARDS, SHARDS = 32, 40


@query
def op8_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.coalesce(remainder("doc_id", OLD_SHARDS), F.lit(0))
    planned = flow_sharding.plan(docs, F.greatest(old, F.lit(0)), OLD_SHARDS, SHARDS)
    written = flow_sharding.rewrite(planned, scratch_path(spark, "shards"))
    body = F.coalesce(F.col("text"), F.lit(""))
    return written.select(
        "doc_id", (F.octet_length(body) + flow_sharding.OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col(planned.name("shard")).alias("shard"), F.col(planned.name("slot")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def _mixing_sql() -> str:
    ctes = [f"""docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(t, ' '))) AS w FROM docs) WHERE length(w) >= {raking_mix.LETTERS} GROUP BY w),
anchors AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS k FROM words WHERE n * {raking_mix.RARE} <= (SELECT count(*) FROM docs) AND n * {raking_mix.MOST_RARE} >= (SELECT count(*) FROM docs) ORDER BY n DESC, w LIMIT {raking_mix.TOPICS}),
held AS (SELECT rid, k, w, count(*) AS n FROM (SELECT rid, unnest(string_split(t, ' ')) AS w FROM docs) JOIN anchors USING (w) GROUP BY rid, k, w),
best AS (SELECT rid, w FROM held QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, k) = 1),
d AS (
  SELECT doc_id, source, lang, coalesce(w, '{raking_mix.OTHER}') AS topic, CASE WHEN length(t) = 0 THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END::BIGINT AS n_tokens
  FROM docs LEFT JOIN best USING (rid)
), c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""]  # fmt: skip
    for s in raking_mix.SIDES:
        ctes.append(f"t_{s} AS (SELECT {s}, p / sum(p) OVER () AS t FROM (SELECT {s}, pow(sum(tokens), {raking_mix.TEMPER}) AS p FROM c GROUP BY {s}))")
    ctes.append("w0 AS (SELECT *, tokens AS w FROM c)")
    k = 0
    for _ in range(raking_mix.MOST_SWEEPS):
        for s in raking_mix.SIDES:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT x.* REPLACE (w * t / sum(w) OVER (PARTITION BY x.{s}) AS w) FROM w{k} x JOIN t_{s} USING ({s}))")
            k += 1
    ctes.append(f"r AS (SELECT *, w / tokens AS r FROM w{k})")
    above = "(ORDER BY r DESC, source, lang, topic)"
    ctes.append(f"a AS (SELECT sum(tokens) OVER {above} AS t, sum(w) OVER {above} AS s, sum(tokens) OVER () AS tt, sum(w) OVER () AS ww FROM r)")
    ctes.append(f"f AS (SELECT greatest({raking_mix.KEEP}::DOUBLE * max(tt) / max(ww), max(({raking_mix.KEEP}::DOUBLE * tt - t) / (ww - s)) FILTER (ww - s > 1e-9 * ww)) AS f FROM a)")
    ctes.append("odds AS (SELECT r.*, round(least(r * f, 1.0::DOUBLE), 9) AS p FROM r, f)")
    ctes.append("h AS (SELECT d.*, coalesce(p, 0.0) AS probability, list_sum(list_transform(range(1, 13), lambda i: (instr('0123456789abcdef', substr(md5('mix' || doc_id), i, 1)) - 1) * pow(16, 12 - i))) / pow(2, 48) AS u FROM d LEFT JOIN odds USING (source, lang, topic))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, source, lang, topic, n_tokens, probability, u < probability AS sampled FROM h"


SQL["op10_mixing"] = _mixing_sql()


@query
def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz_lm.score(docs, remainder("doc_id", 7) != 2)


@query
def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, by exact weighted Jaccard: what the query's links are but for 3 in a million pairs at the threshold.
SQL["op5_bagminhash"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) < {bagminhash.WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {bagminhash.WORDS - 2}), lambda i: array_to_string(w[i:i + {bagminhash.WORDS - 1}], ' ')) END) AS x
  FROM w WHERE len(w) > 0
), c AS (SELECT doc_id, x, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS low FROM c a JOIN c b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.x, p.y FROM p JOIN t a ON a.doc_id = p.x JOIN t b ON b.doc_id = p.y WHERE low::DOUBLE / (a.n + b.n - low) >= {bagminhash.SIMILAR}::DOUBLE),
sides AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(node, root) AS (SELECT doc_id, doc_id FROM t UNION SELECT y, root FROM reach JOIN sides ON x = node WHERE root < y),
g AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN g ON node = doc_id
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
