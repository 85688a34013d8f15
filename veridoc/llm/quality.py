"""Quality by a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams fall into a fixed number of buckets. Two multinomials over the buckets, one of trusted documents and
one of all documents, give each bucket a log ratio; a document's score is the mean over its n-grams. The raw counts cover every
document and are summed in fixed-size tables, one per task. The labelled rows, all of them, are parted by a hash of the id: two
quarters of the trusted ones make the target, one quarter of trusted and rejected ones sets the threshold, and one is used for
neither, so that the separation can be measured on it. A Bloom filter of bounded size takes the target's documents out of the
corpus, which isn't shuffled; what it passes wrongly goes by the join. The best threshold is found range by range of the scores, and
only one row of each range comes to the driver. No random draw decides: a document is kept if its score reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import cut, join_skewed, over_batches, staged, texts
from veridoc.llm.exact_dedup import BITS_A_KEY, MOST_BITS, _bloom, _slots
from veridoc.llm.words import Texts, mix, slices

BUCKETS = 1 << 18
#: What the quarters of the labelled rows serve for, by a hash of the id modulo 4; the one not named is held out.
TARGET, THRESHOLD = (0, 1), (2,)
#: Added to each bucket's count.
PRIOR = 1.0
#: Characters that count as symbols: fixed values.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each unigram and each bigram within a text."""
    word = t.words()
    pair = t.doc[1:] == t.doc[:-1]
    two = mix(word[:-1] * np.uint64(3) + word[1:])[pair]
    return (np.concatenate((word, two)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((t.doc, t.doc[:-1][pair]))


def _repeated_words(t: Texts) -> np.ndarray:
    """For each text, its words inside 3-word windows that it has twice or more."""
    out = np.zeros(t.n, np.int64)
    if len(t.doc) < 3:
        return out
    word = t.words()
    whole = t.doc[2:] == t.doc[:-2]
    at = np.flatnonzero(whole)
    window = mix(mix(mix(word[:-2]) + word[1:-1]) + word[2:])[at] ^ mix(t.doc[at].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(t.doc), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.bincount(t.doc[covered], minlength=t.n)


def _repeated_lines(t: Texts) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier line."""
    if not len(t.data):
        return np.zeros(t.n, np.int64)
    breaks = np.flatnonzero(t.data == 10)
    start = np.sort(np.concatenate((t.offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((breaks, t.offsets[1:])))
    # a break at the very end of a text gives an empty last line there; both sorted lists stay aligned
    inked = np.concatenate(([0], np.cumsum(~t.space)))
    full = inked[end] > inked[start]
    start, end = start[full], end[full]
    doc = np.searchsorted(t.offsets, start, side="right") - 1
    key = t.hashes(start, end) ^ mix(doc.astype(np.uint64) + np.uint64(1 << 41))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=t.n) - np.bincount(doc[first], minlength=t.n)


def _measures(t: Texts) -> dict[str, np.ndarray]:
    whole = (t.data & 0xC0) != 0x80  # first bytes of code points
    return {"n_words": t.counts, "word_chars": t.per_text(whole & ~t.space), "n_symbols": t.per_text(SYMBOLS[t.data]), "n_dup_lines": _repeated_lines(t), "n_repeat_words": _repeated_words(t)}


def quarter(doc_id: Column) -> Column:
    """Which quarter of the labelled rows an id falls into."""
    return F.pmod(F.xxhash64(doc_id, F.lit(29)), F.lit(4))


def _known(labels: DataFrame, quarters: tuple[int, ...]) -> DataFrame:
    """doc_id, good: one row for each labelled id of the quarters that is trusted (quality 1, not toxic) or rejected (quality 0) by some label.

    good is null where an id is both.
    """
    q, x = F.coalesce("quality", F.lit(-1)), F.coalesce("toxic", F.lit(0))
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), ((q == 1) & (x == 0)).alias("trusted"), (q == 0).alias("rejected"))
    some = known.where(quarter(F.col("doc_id")).isin(*quarters)).groupBy("doc_id").agg(F.bool_or("trusted").alias("trusted"), F.bool_or("rejected").alias("rejected"))
    return some.where("trusted or rejected").select("doc_id", "trusted", F.when(F.col("trusted") != F.col("rejected"), F.col("trusted")).alias("good"))


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among `ids` (doc_id, good), with good; an id may be that of any share of the rows."""
    counts = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(ids, "doc_id"))
    return join_skewed(rows, counts, "doc_id", "n", ["good"]).where("good is not null")


def _documents_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the rows that `ids` names; the other texts aren't moved."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_A_KEY * ids.count()).bit_length()))
    bloom = rows.sparkSession.sparkContext.broadcast(_bloom(ids.select(F.xxhash64("doc_id").alias("prefix"), F.lit(0).cast("long").alias("length")), bits))

    def passing(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = b["key"].to_numpy()
        at = _slots(keys, np.zeros(len(keys), np.int64), bits)
        kept = ((bloom.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)
        return b.select(["doc_id", "text"]).filter(pa.array(kept, pa.bool_()))

    passed = staged(over_batches(rows.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("key"), "text"), passing, "doc_id long, text string"))
    return _marked(passed, ids).select("doc_id", "text")


def _counts(rows: DataFrame) -> np.ndarray:
    """How often the rows' texts have each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, data, offsets in slices(b["text"]):
                found += np.bincount(_grams(Texts(data, offsets))[0], minlength=BUCKETS)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Each bucket's log ratio."""
    rows = texts(df, id_col, text_col)
    ids = cut(_known(labels, TARGET).where("trusted").select("doc_id", F.lit(True).alias("good")))
    raw, target = _counts(rows), _counts(_documents_of(rows, ids))
    if not target.any():  # nothing trusted: no document differs from the corpus
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR) / (target.sum() + PRIOR * BUCKETS)) - np.log((raw + PRIOR) / (raw.sum() + PRIOR * BUCKETS))


def _threshold(seen: DataFrame) -> float:
    """The score that parts the rows (score, good) best: most rejected rows below it, less ten times the share of trusted rows there.

    The scores are dealt into ranges; each range tells its counts and the best cut inside it, in whole numbers.
    """
    good, bad = seen.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not good or not bad:
        return -np.inf

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, first, last, top = 0, None, None, None
        for b in batches:
            if b.num_rows:
                at, step = b["score"].to_numpy(), b["bad"].to_numpy() * good - 10 * b["good"].to_numpy() * bad
                below = gain + np.cumsum(step) - step
                k = int(np.argmax(below))
                if top is None or below[k] > top[0]:
                    top = (int(below[k]), float(at[k]), float(at[k - 1]) if k else last)
                gain, first, last = gain + int(step.sum()), float(at[0]) if first is None else first, float(at[-1])
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((first, last, gain, *top), [pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)], ["first", "last", "gain", "top", "at", "before"])

    counts = seen.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    ranges = counts.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(best, "first double, last double, gain long, top long, at double, before double")
    total, most, least, last = 0, 0, -np.inf, None
    for r in sorted(ranges.collect()):
        if total + r.top > most:
            most, least = total + r.top, (r.at + (last if r.before is None else r.before)) / 2
        total, last = total + r.gain, r.last
    return float(least)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed, and the
    score (mean log ratio, 0 for a text without words) reaches the threshold fitted on the labelled rows; without labels of
    both kinds every other document is kept. A null text counts as empty. Repeated rows each give a row and count as often.
    labels: doc_id, quality (0 or 1, null is neither), toxic (null is 0); of an id labelled twice, both labels hold. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(fit(df, labels, id_col, text_col))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for _, _, data, offsets in slices(b["text"]):
                t = Texts(data, offsets)
                bucket, doc = _grams(t)
                total, n = np.bincount(doc, table.value[bucket], t.n), np.bincount(doc, minlength=t.n)
                parts.append({**_measures(t), "score": total / np.maximum(n, 1)})
            whole = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in [*names, "score"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x.astype(np.int64)) for x in whole[:-1]), pa.array(whole[-1].astype(np.float64))], ["doc_id", *names, "score"])

    rows = cut(texts(df, id_col, text_col).mapInArrow(score, f"doc_id long, {', '.join(f'{c} long' for c in names)}, score double"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = cut(_known(labels, THRESHOLD).where("good is not null").select("doc_id", "good"))
    least = _threshold(cut(_marked(rows.where(~failed).select("doc_id", "score"), known).select("score", "good")))
    return rows.select("doc_id", *names, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= F.lit(least))).alias("kept"))
