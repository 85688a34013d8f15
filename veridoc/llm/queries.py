"""The registered queries: each applies its operator to its whole table and derives the agreed columns from the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.language_id import fit, held_out, identify

    documents = table(spark, sf_dir, "documents")
    found = identify(documents, fit(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veridoc.llm.bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.sharding import shard_by_bytes

    found = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.html_extract import main_texts

    found = main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_radix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.window_dedup import repeated_windows

    return repeated_windows(table(spark, sf_dir, "documents"))


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.exact_dedup import exact_duplicates

    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.llm.common import unsigned
    from veridoc.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", unsigned(F.col("fp")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_crf_language, op2_best_fit_packing, op3_likelihood_ratio, op4_prefix_bpe, op5_histogram_shards, op6_block_tree, op7_radix_windows, op8_bloom_lm, op9_exact_dedup, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
            g AS (SELECT t, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
        """
    }
