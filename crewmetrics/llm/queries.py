"""Registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics.llm import bpe, decontaminate, lm_scoring, near_dup, packing, pii, prefix_trie, quality, ranked_search, substring_dedup, token_counts, url_filters, warc
from crewmetrics.llm.oracles import ORACLES  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_entities(table(spark, folder, "documents"), secret="check key").select("doc_id", "text", "n_entities")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, folder, "documents"), window=20).drop("spans")


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(table(spark, folder, "pages"), RULES)


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(table(spark, folder, "documents"), TOKENIZER)


def op6_minhash_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), shingle=4, percent=80)


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    from crewmetrics.llm.scratch import written

    rows = warc.with_originals(table(spark, folder, "pages"), "page_id", "html")
    records = warc.read_archives(written(warc.write_archives(rows, "page_id", "html"), "none"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return records.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), TOKENIZER, limit=1024)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conv = F.col("conv")
    taken = (F.crc32(conv.cast("string").cast("binary")) % 9).cast("int")
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"), base=conv - conv % 5, taken=taken, most=8)


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.encode_decode(table(spark, folder, "documents"), TOKENIZER)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    index = ranked_search.build(table(spark, folder, "documents"))
    return ranked_search.search(index, table(spark, folder, "benchmark"), k=50)


_ALL = [
    op1_pii_surrogates, op2_substring_dedup, op3_benchmark_decontamination, op4_url_filters, op5_lm_scoring, op6_minhash_near_dup, op7_best_fit_packing,
    op8_warc, op9_quality_rules, op10_token_counts, op11_prefix_trie, op12_bpe, op13_ranked_search,
]
QUERIES = {f.__name__: f for f in _ALL}
