"""SimHash near duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most k bits share at least 8 - k of them
(k = 4: four). Counting single shared bytes would pair up every 256th fingerprint, so the index holds each fingerprint under every
set of that many positions instead (70 sets of four): two fingerprints meet in a posting list exactly if their tally of shared
positional bytes reaches the guaranteed minimum. Each meeting is verified bit by bit. Only distinct fingerprints are indexed,
and a posting list gives a spanning forest of its links, never all pairs: short lists are compared outright, in long ones all
fingerprints within k/2 bits of a common midpoint are linked to each other, which finds the same links in linear work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.llm.common import as_bytes, components, cut, first_of_each, first_runs, fresh, join_skewed, local_roots, over_batches, release, staged, texts

SEED = 42
#: Lists up to this length are compared outright.
SHORT = 48
#: Midpoints held at once for a long list.
MIDPOINTS = 4_000_000
#: Entries of the index that a task holds, besides those of a longer list.
FLUSH = 500_000


def fingerprint(text: bytes, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-words].tolist()]
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp: the SimHash of every whole text as a signed 64-bit value."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b["doc_id"], _signed([fingerprint(t, words) for t in as_bytes(b["text"])])], ["doc_id", "fp"])

    return over_batches(texts(df, id_col, text_col), run, "doc_id long, fp long")


def _postings(k: int) -> list[tuple[int, ...]]:
    return list(combinations(range(8), 8 - k))


def _links(keys: np.ndarray, fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within posting lists, thinned to a forest: (fingerprint, a smaller index's fingerprint)."""
    if not len(keys):
        return fps, fps
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    starts = first_runs(keys)
    lengths = np.diff(np.append(starts, len(keys)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = np.flatnonzero((lengths > 1) & (lengths <= SHORT))
    for d in range(1, int(lengths[short].max(initial=1))):
        own = short[lengths[short] > d]
        n = lengths[own] - d
        i = np.repeat(starts[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(fps[i] ^ fps[i + d]) <= k
        a.append(i[near])
        b.append(i[near] + d)
    masks = np.array([0, *(sum(1 << x for x in c) for r in range(1, k // 2 + 1) for c in combinations(range(64), r))], np.uint64)
    for at in np.flatnonzero(lengths > SHORT).tolist():
        s, n = starts[at], lengths[at]
        own = fps[s : s + n]
        free = np.bitwise_or.reduce(own ^ own[0])  # positions on which the list agrees need no flips
        for x, y in _near_midpoints(own, [(np.arange(n), masks[(masks & ~free) == 0])], free):
            a.append(s + x)
            b.append(s + y)
    a, b = np.concatenate(a), np.concatenate(b)
    values, index = np.unique(fps, return_inverse=True)
    root = local_roots(len(values), index[a], index[b])
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def _near_midpoints(own: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], free: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints (as numbers) that share a midpoint, each with the next one that has it.

    parts: numbers and flips whose midpoints are meant. Too many are parted by a free bit of the midpoint: a fingerprint goes with
    the flips that keep the bit to the side of its own bit, and with those that change it to the other side.
    """
    many = sum(len(rows) * len(flips) for rows, flips in parts)
    if many <= MIDPOINTS or not free:
        mid = np.concatenate([(own[rows, None] ^ flips).ravel() for rows, flips in parts])
        who = np.concatenate([np.repeat(rows, len(flips)) for rows, flips in parts])
        by = np.argsort(mid, kind="stable")
        same = mid[by][1:] == mid[by][:-1]
        x, y = who[by][:-1][same], who[by][1:][same]
        code = np.unique(np.minimum(x, y) << 32 | np.maximum(x, y))
        yield code >> 32, code & 0xFFFFFFFF
        return
    sample = np.concatenate([own[rows[:: max(1, len(rows) // 256)]] for rows, _ in parts])
    bits = [p for p in range(64) if int(free) >> p & 1]
    best = min(bits, key=lambda p: (abs(0.5 - float((sample >> np.uint64(p) & np.uint64(1)).mean())), p))
    bit = np.uint64(1 << best)
    sides: tuple[list, list] = ([], [])
    for rows, flips in parts:
        high, change = (own[rows] & bit) > 0, (flips & bit) > 0
        for r, up in ((rows[~high], 0), (rows[high], 1)):
            for f, turned in ((flips[~change], 0), (flips[change], 1)):
                if len(r) and len(f):
                    sides[up ^ turned].append((r, f))
    for side in sides:
        if side:
            yield from _near_midpoints(own, side, free & ~bit)


def link_fingerprints(distinct: DataFrame, k: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at k or fewer differing bits, thinned so that components stay."""
    sets = _postings(k)
    if k % 2 or not 2 <= k <= 4:
        raise ValueError("midpoints are exact for an even distance; 32-bit keys need four positions or more")
    width = min(8 - k, 4)

    def key(number: int, positions: tuple[int, ...]):
        bits = F.lit(0).cast("long")
        for p in positions[:width]:
            bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")), 8 * positions.index(p)))
        return bits.bitwiseOR(F.lit(number << 32).cast("long"))

    listed = distinct.select("fp", F.explode(F.array(*(key(n, s) for n, s in enumerate(sets)))).alias("key"))
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.repartition(tasks, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(last: bool) -> pa.RecordBatch:
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = len(keys) if last else int(np.searchsorted(keys, keys[-1]))  # the last list may go on
            held[:] = [(keys[whole:], fps[whole:])]
            a, b = _links(keys[:whole], fps[:whole], k)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        waiting, due = 0, FLUSH
        for b in batches:
            if b.num_rows:
                held.append((b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64)))
                waiting += b.num_rows
                if waiting >= due:
                    yield links(last=False)
                    waiting = len(held[0][0])
                    due = max(FLUSH, 2 * waiting)
        if waiting:
            yield links(last=True)
        held.clear()
        release()

    return dealt.mapInArrow(run, "a long, b long")


def _components_of(rows: DataFrame, id_col: str, fp: str, k: int) -> DataFrame:
    """One row for each distinct fingerprint: fp, root (the component's fingerprint), component_id (smallest id reachable), copies (rows that have it)."""
    distinct = cut(rows.groupBy(fp).agg(F.min(id_col).alias("low_id"), F.count("*").alias("copies")).withColumnRenamed(fp, "fp"))
    roots = components(link_fingerprints(distinct, k))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low_id", "copies", F.coalesce("root", "fp").alias("root"))
    lows = labelled.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count("*").alias("members"))
    return cut(join_skewed(labelled, lows, "root", "members", ["component_id"]).select(F.col("fp").alias(fp), "root", "component_id", "copies"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of df: doc_id, fp (signed 64-bit SimHash), component_id (smallest id reachable over links, its own included).

    A null or empty text has fingerprint zero and links like any other. Fewer than `words` words are one shingle. Repeated rows
    each give a row; ties have no bearing. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = cut(fingerprints(df, id_col, text_col, words))
    found = _components_of(rows, "doc_id", "fp", distance)
    return join_skewed(rows, found, "fp", "copies", ["component_id"])


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """df with one row of each component: that of the smallest id (a null id only where no row has one), the first of repeated rows; all columns as they are.

    A null or empty text has fingerprint zero and links like any other; texts may be of any length. An empty table gives no rows.
    Columns may have any names. With `similarity` texts link by the share of five-word shingles that they have in common instead, as
    no bit distance that the index can guarantee holds pairs of 0.8: see veridoc.llm.similar.
    """
    if similarity is not None:
        from veridoc.llm.similar import drop_similar

        return drop_similar(df, id_col, text_col, similarity)
    (fp, row, low), names = fresh(df, "sim_fp", "sim_row", "sim_text"), df.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = _signed([fingerprint(t, words) for t in as_bytes(b[low])])
        return pa.RecordBatch.from_arrays([*(b[c] for c in names), got], names=[*names, fp])

    wide = df.withColumn(low, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = staged(over_batches(wide, run, T.StructType([*df.schema.fields, T.StructField(fp, T.LongType())])).withColumn(row, F.monotonically_increasing_id()))
    narrow = rows.select(F.col(id_col).alias("own_id"), F.col(fp).alias("fp"), F.col(row).alias("own_row"))
    joined = join_skewed(narrow, _components_of(narrow, "own_id", "fp", distance), "fp", "copies", ["root"])
    kept = first_of_each(joined).withColumnRenamed("own_row", row)
    return rows.join(kept, row, "left_semi").select(*names)
