"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Two passes over the texts. The first counts the pairs (length, prefix hash) of the normalised texts, pre-aggregated before the
shuffle. Keys that occur once end there. The others are put into a Bloom filter of bounded size, by which the second pass takes
the full hash of surviving texts only; a false positive costs one more hash and changes nothing. Groups form by full SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import as_bytes, cut, fresh, join_skewed, over_batches, staged

#: Characters that don't count when texts are compared: fixed values.
IGNORED = b" \t\n\v\f\r"
#: Bytes of normalised text under the prefix hash.
PREFIX = 256
#: Bits of the filter for each surviving key, and at most (16 MB as broadcast).
BITS_A_KEY, MOST_BITS, PROBES = 16, 1 << 27, 4


def normalised(text: bytes) -> bytes:
    return text.translate(None, IGNORED)


def _key(norm: bytes) -> int:
    """Length and prefix hash as one signed 64-bit key; the length also stands in the table as such."""
    return xxhash.xxh64_intdigest(norm[:PREFIX], len(norm) & 0xFFFFFFFF) - (1 << 63)


def _slots(keys: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """The filter's positions of each key, one row for each probe."""
    x = keys.astype(np.uint64) ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)])


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter as bytes, put together from the words that each task has set: at most bits / 64 rows reach the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.unique(_slots(b["prefix"].to_numpy(), b["length"].to_numpy(), bits))
                word, where = np.unique(at >> np.uint64(6), return_index=True)
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), where)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    found = keys.mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def _hashed(df: DataFrame, text: str, carry: list[str], every_digest: bool) -> DataFrame:
    """Stage 1 to 3: the carried columns with n_chars, the full hash of survivors, and on wish the digest of every row."""
    spark = df.sparkSession
    n_chars, full, digest, row, plain_text = fresh(df, "norm_chars", "norm_hash", "norm_digest", "norm_row", "norm_text")

    def keys(b: pa.RecordBatch) -> pa.RecordBatch:
        norm = [normalised(t) for t in as_bytes(b["text"])]
        return pa.RecordBatch.from_arrays([pa.array([len(t) for t in norm], pa.int64()), pa.array([_key(t) for t in norm], pa.int64())], ["length", "prefix"])

    plain = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    twice = cut(over_batches(plain, keys, "length long, prefix long").groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("length", "prefix"))
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_A_KEY * twice.count()).bit_length()))
    bloom = spark.sparkContext.broadcast(_bloom(twice, bits))

    def hashes(b: pa.RecordBatch) -> pa.RecordBatch:
        norm = [normalised(t) for t in as_bytes(b[plain_text])]
        at = _slots(np.array([_key(t) for t in norm], np.int64), np.array([len(t) for t in norm], np.int64), bits)
        survives = ((bloom.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0) if norm else []
        sha = [hashlib.sha256(t).digest() if s or every_digest else None for t, s in zip(norm, survives, strict=True)]
        chars = pc.utf8_length(b[plain_text]).cast(pa.int64())
        columns = [*(b[c] for c in carry), chars, pa.array([h if s else None for h, s in zip(sha, survives, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(sha, pa.binary())] if every_digest else [])], names=[*carry, n_chars, full, *([digest] if every_digest else [])])

    schema = df.select(*carry).schema.add(n_chars, "long").add(full, "binary")
    if every_digest:
        schema = schema.add(digest, "binary")
    wide = df.select(*carry, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(plain_text))
    return over_batches(wide, hashes, schema).withColumn(row, F.monotonically_increasing_id())


def _groups(rows: DataFrame, id_col: str, n_chars: str, full: str, row: str) -> DataFrame:
    """One row for each group of two or more: who stays, and how many there are."""
    best = F.min(F.struct((-F.col(n_chars)).alias("c"), F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col(row).alias("r")))
    return rows.where(F.col(full).isNotNull()).groupBy(full).agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1").select(full, "group_size", F.col("best.i").alias("keep_id"), F.col("best.r").alias("keep_row"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, digest (SHA-256 of the normalised text).

    Texts are equal when identical after deleting space, tab, line feed, vertical tab, form feed and carriage return. Of equal
    texts the row with the most code points in the original stays, then the smallest id (null last), then the first of repeated
    rows, so that exactly one stays. A null text counts as empty; empty texts form a group. An empty table gives no rows. Other
    columns of df are ignored, whatever their names.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_hashed(own, "text", ["doc_id"], every_digest=True))
    groups = cut(_groups(rows, "doc_id", "norm_chars", "norm_hash", "norm_row"))
    joined = join_skewed(rows, groups, "norm_hash", "group_size", ["keep_id", "group_size", "keep_row"])
    alone = F.col("keep_row").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep_row") == F.col("norm_row"))).alias("kept"),
        F.col("norm_digest").alias("digest"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_duplicates marks as not kept: all columns as they are, rows in any order.

    Null, empty and long texts, ties, repeated rows and null ids count as there; an empty table gives no rows. Columns may have
    any names.
    """
    n_chars, full, row = fresh(df, "norm_chars", "norm_hash", "norm_row")
    rows = staged(_hashed(df, text_col, df.columns, every_digest=False))
    groups = cut(_groups(rows, id_col, n_chars, full, row))
    hashed = rows.where(F.col(full).isNotNull()).select(full, row)
    gone = join_skewed(hashed, groups, full, "group_size", ["keep_row"]).where(F.col("keep_row") != F.col(row)).select(row)
    return rows.join(gone, row, "left_anti").select(*df.columns)
