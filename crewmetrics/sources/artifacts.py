"""Saved retrieval indexes and trained models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics.operators import postings, tfidf
from crewmetrics.operators.buckets import BucketIndex
from crewmetrics.operators.model import AttritionModel
from crewmetrics.operators.retrieval import CHUNK_KEY, Index, chunks
from crewmetrics.functions import text as tx
from crewmetrics.sources.files import exists


def build_and_save(
    docs: DataFrame, path: str, size: int = 800, overlap: int = 100, max_features: int = tfidf.MAX_FEATURES
) -> Index:
    """Build an index step by step, each step reading the written result of the one before."""
    spark = docs.sparkSession
    pieces = chunks(docs.where(tx.not_blank(F.col("text"))), size, overlap)
    pieces.write.mode("overwrite").parquet(f"{path}/chunks")
    pieces = spark.read.parquet(f"{path}/chunks")
    tfidf.term_arrays(pieces, CHUNK_KEY, "text").write.mode("overwrite").parquet(f"{path}/terms")
    arrays = spark.read.parquet(f"{path}/terms")
    vocab = tfidf.vocabulary(arrays, max_features)
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    tfidf.vectors(arrays, vocab, CHUNK_KEY).write.mode("overwrite").parquet(f"{path}/vectors")
    _write_postings(postings.build(spark.read.parquet(f"{path}/vectors"), CHUNK_KEY), path)
    _write_text(spark, {"dim": max_features}, f"{path}/meta")
    return load_index(spark, path)


def save_index(index: Index, path: str) -> None:
    """Write an index that was built elsewhere."""
    for name in ("chunks", "vocab", "vectors"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    _write_postings(index.postings, path)
    _write_text(index.chunks.sparkSession, {"dim": index.dim}, f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> Index:
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"no index at {path}")
    meta = _read_text(spark, f"{path}/meta")
    chunk, vocab, vector, posting = (spark.read.parquet(f"{path}/{n}") for n in ("chunks", "vocab", "vectors", "postings"))
    return Index(chunk, vocab, vector, posting, meta["dim"])


def _write_postings(made: DataFrame, path: str) -> None:
    # the shards' numbers are those of the tasks: written as they are, then put in order of term
    made.write.mode("overwrite").parquet(f"{path}/shards")
    postings.arranged(made.sparkSession.read.parquet(f"{path}/shards")).write.mode("overwrite").parquet(f"{path}/postings")


def save_buckets(index: BucketIndex, path: str) -> None:
    """Write the buckets of an approximate search, table by table, so that a table is read by its folder."""
    index.rows.write.mode("overwrite").partitionBy("table").parquet(f"{path}/rows")
    meta = {name: getattr(index, name) for name in ("key", "dim", "tables", "bits", "seed", "metric")}
    _write_text(index.rows.sparkSession, meta, f"{path}/meta")


def load_buckets(spark: SparkSession, path: str) -> BucketIndex:
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"no buckets at {path}")
    rows = spark.read.parquet(f"{path}/rows")
    return BucketIndex(rows, **_read_text(spark, f"{path}/meta"))


def save_model(model: AttritionModel, path: str) -> None:
    """The fitted pipeline and, as JSON, its inputs and measures."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    meta = {k: getattr(model, k) for k in ("kind", "numeric", "categorical", "metrics", "label", "key")}
    _write_text(SparkSession.active(), meta, f"{path}/meta")


def load_model(path: str) -> AttritionModel:
    spark = SparkSession.active()
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"no trained model at {path}")
    return AttritionModel(PipelineModel.load(f"{path}/pipeline"), **_read_text(spark, f"{path}/meta"))


def _write_text(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
