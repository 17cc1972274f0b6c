"""A corpus pipeline: language, quality, near duplicates, mixing, then token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bagminhash, language_id, quality_cnn, queries, raking_mix, sentencepiece_codec
from strandloom.llm._rows import remainder
from strandloom.session import drop_tables, scratch_path

#: A document goes if its language's score is under this; that rejects texts without letters too, whose score is 0.
LEAST_LANGUAGE = 0.4
#: A document goes if its quality score is under this.
LEAST_QUALITY = 0.3


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(remainder("doc_id", 4) != 2))
    score = unused(docs, "__score")
    found = language_id.predict(docs, model, lang_pred=unused(docs, "__lang"), score=score)
    return found.where(F.col(score) >= LEAST_LANGUAGE).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    score = unused(docs, "__score")
    found = quality_cnn.predict(docs, model, score=score)
    return found.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return raking_mix.mix(docs, keep_all_columns=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digest(docs, queries.piece_model())


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The classifiers and signatures have no form in SQL; tests hold each stage against its brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read back by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != STAGES[0][0]:
            drop_tables(before)
    return docs
