"""The training-data pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns the columns of documents; the last returns digests of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import bpe, language, mixing, quality, simhash
from tickerloom.llm.common import cut_lineage, drop_ids, read, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored like others."""
    model = quality.fit_model(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs.select(*COLUMNS), model)
    return scored.filter(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; rows are told apart by all that the decision rests on, so ids may repeat or be null."""
    model = language.fit_text_model(docs)
    rows = docs.select(*COLUMNS).withColumn("__mark", F.xxhash64("doc_id", "text", "lang", "source"))
    found = language.identify_documents(rows, model, id_col="__mark")
    gone = cut_lineage(found.filter(F.col("language") == "und").select("__mark").distinct())
    return drop_ids(rows, gone, "__mark").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity .8 or more on 5-word shingles: that with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS), scheme=simhash.COPIES)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each row and of the bytes that they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: Trained models and XXH64 are out of SQL's reach; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
