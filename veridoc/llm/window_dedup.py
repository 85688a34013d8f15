"""Removal of repeated byte windows by a depth-limited, distributed radix sort of suffixes.

Suffixes are ordered only through their first `WINDOW` bytes, most significant digit first; whatever is alone in its group drops
out, and the groups left after the last digit are exactly the repeated windows. The first digit of a suffix is its window's
anchor: the 16-byte string in the window with the least hash. Equal windows have equal anchors at the same place, and
neighbouring windows mostly share one, so that the first pass moves one key for some 17 suffixes. Only anchors found in two
texts go on, with the bytes around them; the further passes split their groups by eight bytes at a time.

Equal texts are brought down to one before that; all but those of the smallest id are repeated as a whole. Within a chunk of
texts equal surroundings are merged before they are sent, so that a passage in a third of all texts sends one row per chunk, and
equal surroundings that follow each other in one text, as in a run of one character, are one row. An anchor with very many rows is
not sent to one shard: its windows go to shards by all their bytes. Every exchange ends in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import as_bytes, bucketed, cut, fresh, join_skewed, pack, release, unpack
from veridoc.llm.words import BASE, INVERSE, columns, mix, powers, slices

WINDOW, GRAM = 50, 16
#: Windows that can share an anchor, and the bytes around an anchor that they cover.
REACH = WINDOW - GRAM + 1
AROUND = 2 * WINDOW - GRAM
#: Bytes of text in a chunk, and for each shard, about.
CHUNK, SHARD = 4 << 20, 16 << 20
#: Bytes of text that are hashed at once, and rows of surroundings that are built or grouped at once, about.
SLICE, ROWS = 1 << 18, 4_000
#: Bits of an anchor's hash that are dropped; equal hashes only let it go on.
DROPPED = np.uint64(16)
#: Bits of a position within a slice.
PLACE = np.uint64(30)
#: Rows from which on the windows of an anchor are dealt by all their bytes.
LONG_KEY = 100_000
#: Rows that one copy of a text serves in a join.
SERVED = 256


def _anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor's hash, its place, first window, last window, text)."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * powers(INVERSE, n - GRAM + 1))
    low = (gram >> PLACE << PLACE) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH:
        low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    at = (low & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    whole = np.zeros(n + 1, np.int32)  # windows that lie within one text
    long = offsets[1:] - offsets[:-1] >= WINDOW
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - WINDOW + 1, -1)
    start = np.flatnonzero(np.cumsum(whole[: len(at)]) > 0)
    if not len(start):
        return _anchored(data[:0], offsets[:1])
    at = at[start]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.append(first[1:], len(start)) - 1
    place = at[first]
    return gram[place] >> DROPPED, place, start[first], start[last], np.searchsorted(offsets, start[first], side="right") - 1


class _Chunk:
    """The texts of a chunk, one of each, by order of their hashes; doc: the smallest id of each."""

    def __init__(self, table: pa.Table, notes: pa.Table) -> None:
        sha = as_bytes(table["sha"].combine_chunks())
        first: dict[bytes, int] = {}
        for i, s in enumerate(sha):
            first.setdefault(s, i)
        self.sha = sorted(first)
        self.texts = table["text"].combine_chunks().take(pa.array([first[s] for s in self.sha], pa.int64()))
        kind = notes["kind"].to_numpy()
        ids = dict(zip(notes["sha"].filter(pa.array(kind == 0)).to_pylist(), notes["doc"].filter(pa.array(kind == 0)).to_pylist(), strict=True))
        self.doc = np.array([ids[s] for s in self.sha], np.int64)
        self.notes = list(zip(*(notes[c].filter(pa.array(kind == 1)).to_pylist() for c in ("one", "two")), strict=True))

    def runs(self) -> Iterator[tuple[np.ndarray, int, np.ndarray, tuple[np.ndarray, ...]]]:
        """(bytes, first text, for each text where it begins among them, anchors); a long text comes in pieces that overlap."""
        for row, _, data, offsets in slices(self.texts, SLICE):
            if len(offsets) > 2 or len(data) <= 2 * SLICE:
                yield data, row, offsets[:-1], _anchored(data, offsets)
                continue
            for low in range(0, len(data) - WINDOW + 1, SLICE):
                piece = data[low : low + SLICE + WINDOW - 1]
                yield piece, row, np.array([-low]), _anchored(piece, np.array([0, len(piece)]))


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(shard[rows[0]]), rows


def _sent(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "chunk", "one", "two"])


def _notes(rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["chunk", "one", "two"])


def _squeezed(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _expanded(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins, in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))


def _first_digit(chunk: _Chunk, number: int, shards: int) -> pa.Table:
    """For each shard the chunk's anchors, once each, how often they stand, and which of them several of its texts have."""
    keys, rows, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, row, _, (key, _, _, _, text) in chunk.runs():
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        first = _runs_of(key, text)
        keys.append(key[first])
        rows.append(text[first] + row)
        counts.append(np.diff(np.append(first, len(key))))
    key, row, count = np.concatenate(keys), np.concatenate(rows), np.concatenate(counts)
    order = np.lexsort((row, key))
    key, row, count = key[order], row[order], count[order]
    first = _runs_of(key)
    if not len(first):
        return _sent([])
    distinct, count = key[first], np.add.reduceat(count, first)
    many = row[first] != row[np.append(first[1:], len(key)) - 1]
    size = (np.minimum(np.ceil(np.log2(count)), 62).astype(np.uint8) << np.uint8(1)) | many.astype(np.uint8)  # rounded up to a power of two
    split = np.uint64(shards)
    out = [(s, number, pack(distinct[r] // split), _squeezed(size[r])) for s, r in _by_shard((distinct % split).astype(np.int64))]
    return _sent(out)


def _trimmed(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        out = fn(table)
        release()
        return out

    return run


def _surviving(table: pa.Table, shards: int, long_key: int) -> pa.Table:
    """For each chunk those of its anchors that another text has too, and which of them have very many rows."""
    shard, split = np.uint64(table["shard"][0].as_py()), np.uint64(shards)
    keys = [unpack(x) for x in table["one"].to_pylist()]
    sizes = [_expanded(x, np.uint8) for x in table["two"].to_pylist()]
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    size = np.concatenate(sizes)
    stay = (np.bincount(index) > 1) | (np.bincount(index, size & 1) > 0)
    hot = np.bincount(index, 2.0 ** (size >> 1)) >= long_key
    out, low = [], 0
    for chunk, k in zip(table["chunk"].to_pylist(), keys, strict=True):
        own = index[low : low + len(k)]
        low += len(k)
        if stay[own].any():
            some = own[stay[own]]
            out.append((chunk, pack(distinct[some] * split + shard), np.packbits(hot[some]).tobytes()))
    return _notes(out)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _blocks(key: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in blocks of about `most`, all rows of a key in one."""
    order = np.argsort(key, kind="stable")
    ends = np.append(np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, len(key))
    low = 0
    while low < len(key):
        high = int(ends[min(np.searchsorted(ends, low + most), len(ends) - 1)])
        yield order[low:high]
        low = high


def _as_values(rows: np.ndarray) -> np.ndarray:
    """Each row of bytes as one value."""
    return np.ascontiguousarray(rows).view([("", f"V{rows.shape[1]}")]).ravel()


class _Rows:
    """Surroundings of anchors: key, id, text, span of the starts of equal ones that follow each other, bytes."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, AROUND + 2), np.uint8))]

    def add(self, key: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray, rows: np.ndarray) -> None:
        """Those in one text whose starts are at most a window apart become one."""
        group = np.unique(_as_values(rows), return_inverse=True)[1].ravel()
        order = np.lexsort((start, text, group, key))
        key, doc, text, start, rows, group = (x[order] for x in (key, doc, text, start, rows, group))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1]) | (text[1:] != text[:-1]) | (start[1:] - start[:-1] > WINDOW)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        self.parts.append((key[first], doc[first], text[first], start[first], start[last], rows[first]))

    def all(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))


def _surroundings(chunk: _Chunk, number: int, shards: int) -> pa.Table:
    """For each shard the surviving anchors with their surroundings; with no second part the spans already known to be repeated.

    Of an anchor with very many rows the single windows go, each to a shard by its bytes.
    """
    alive = [(unpack(one), np.unpackbits(np.frombuffer(two, np.uint8)).astype(bool)) for one, two in chunk.notes]
    if not alive:
        return _sent([])
    keys = np.concatenate([k for k, _ in alive])
    order = np.argsort(keys)
    keys, hot = keys[order], np.concatenate([h[: len(k)] for k, h in alive])[order]
    found = _Rows()
    for data, row, begins, (key, place, first, last, text) in chunk.runs():
        at = np.flatnonzero(_among(key, keys))
        for low in range(0, len(at), ROWS):
            r = at[low : low + ROWS]
            left = place[r] - (REACH - 1)
            index = left[:, None] + np.arange(AROUND)
            used = (index >= first[r, None]) & (index < last[r, None] + WINDOW)
            around = np.where(used, data[np.where(used, index, 0)], 0).astype(np.uint8)
            edge = np.stack([first[r] - left, last[r] - left], axis=1).astype(np.uint8)
            found.add(key[r], chunk.doc[row + text[r]], row + text[r], first[r] - begins[text[r]], np.hstack([around, edge]))
    key, doc, text, start, final, rows = found.all()
    del found
    own = np.zeros(len(key), bool)
    for r in _blocks(key, ROWS):
        group = np.unique(_as_values(rows[r]), return_inverse=True)[1].ravel()
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc[r])
        own[r] = doc[r] == least[group]
    far = np.flatnonzero(~own)
    length = rows[:, AROUND + 1].astype(np.int64) - rows[:, AROUND] + WINDOW
    out = [(number % shards, number, _span_bytes(text[far], start[far], final[far] + length[far]), b"")] if len(far) else []
    long = _among(key, keys[hot])
    some = np.flatnonzero(own & ~long)
    for s, r in _by_shard((key[some] // np.uint64(7) % np.uint64(shards)).astype(np.int64)):
        r = some[r]
        head = np.stack([key[r].view(np.int64), doc[r], text[r], start[r], final[r]])
        out.append((s, number, b"r" + head.tobytes(), _squeezed(rows[r].ravel())))
    long = np.flatnonzero(own & long)
    return _sent(out + (_single_windows(number, shards, doc[long], text[long], start[long], final[long], rows[long]) if len(long) else []))


def _single_windows(number: int, shards: int, doc: np.ndarray, text: np.ndarray, start: np.ndarray, final: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
    """The windows that the rows hold, one by one, to shards by their bytes: those of the smallest id here, and spans of the others."""
    out, away = [], []
    for low in range(0, len(rows), ROWS):
        some = rows[low : low + ROWS]
        edge = some[:, AROUND:].astype(np.int64)
        row, at = np.nonzero((np.arange(REACH) >= edge[:, :1]) & (np.arange(REACH) <= edge[:, 1:]))
        window = some[row[:, None], at[:, None] + np.arange(WINDOW)]
        value, group = np.unique(_as_values(window), return_inverse=True)
        group, shift, row = group.ravel(), at - edge[row, 0], row + low
        least = np.full(len(value), np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc[row])
        own = doc[row] == least[group]
        away.append((text[row[~own]], start[row[~own]] + shift[~own], final[row[~own]] + shift[~own] + WINDOW))
        pick = np.flatnonzero(own)
        digit = mix((window[pick].astype(np.uint64) + np.uint64(1)) @ powers(BASE, WINDOW))
        for s, r in _by_shard((digit % np.uint64(shards)).astype(np.int64)):
            r = pick[r]
            head = np.stack([doc[row[r]], text[row[r]], start[row[r]] + shift[r], final[row[r]] + shift[r]])
            out.append((s, number, b"w" + head.tobytes(), _squeezed(window[r].ravel())))
    spans = [np.concatenate(x) for x in zip(*away, strict=True)]
    return out + ([(number % shards, number, _span_bytes(*spans), b"")] if len(spans[0]) else [])


def _span_bytes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([text, start, end]).astype(np.int64).tobytes()


def equal_windows(windows: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `windows` (bytes) that equal another document's within their group, and the number of each one's final group.

    Most-significant-digit passes of eight bytes; after each, groups of one document only drop out.
    """
    live = np.arange(len(windows))
    for at in [None, *range(0, WINDOW - 8, 8), WINDOW - 8]:
        if at is not None:
            digit = np.ascontiguousarray(windows[live, at : at + 8]).view(">u8").ravel().astype(np.uint64)
            order = np.lexsort((digit, group))
            new = np.concatenate(([True], (digit[order][1:] != digit[order][:-1]) | (group[order][1:] != group[order][:-1])))
        else:
            order = np.argsort(group, kind="stable")
            new = np.concatenate(([True], group[order][1:] != group[order][:-1]))
        live, number = live[order], np.cumsum(new) - 1
        first = np.flatnonzero(new)
        mixed = np.minimum.reduceat(doc[live], first) < np.maximum.reduceat(doc[live], first)
        live, group = live[mixed[number]], number[mixed[number]]
        if not len(live):
            break
    return live, group


def _hits(key: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row which of its windows a document with a smaller id has too."""
    group = np.unique(key, return_inverse=True)[1]
    low, high = rows[:, AROUND], rows[:, AROUND + 1]
    hit = np.zeros((len(rows), REACH + 1), bool)
    for r in range(REACH):
        some = np.flatnonzero((low <= r) & (r <= high))
        if len(some):
            live, number = equal_windows(rows[some, r : r + WINDOW], group[some], doc[some])
            if len(live):
                least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, number, doc[some[live]])
                hit[some[live[doc[some[live]] > least[number]]], r] = True
    return hit


def _matched(table: pa.Table) -> pa.Table:
    """For each chunk the spans whose windows also start in a document with a smaller id; known spans pass."""
    out, heads, rows, chunk = [], {b"r": [], b"w": []}, {b"r": [], b"w": []}, {b"r": [], b"w": []}
    width = {b"r": AROUND + 2, b"w": WINDOW}
    for c, head, packed in zip(table["chunk"].to_pylist(), table["one"].to_pylist(), table["two"].to_pylist(), strict=True):
        if not packed:
            out.append((c, head, b""))
            continue
        kind = head[:1]
        heads[kind].append(np.frombuffer(head, np.int64, offset=1).reshape(5 if kind == b"r" else 4, -1))
        rows[kind].append(_expanded(packed, np.uint8).reshape(-1, width[kind]))
        chunk[kind].append(np.full(heads[kind][-1].shape[1], c))

    def tell(chunk: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        out.extend((int(chunk[r[0]]), _span_bytes(text[r], begin[r], end[r]), b"") for _, r in _by_shard(chunk))

    if heads[b"r"]:
        key, doc, text, start, final = np.concatenate(heads[b"r"], axis=1)
        around, number = np.concatenate(rows[b"r"]), np.concatenate(chunk[b"r"])
        for block in _blocks(key, 8 * ROWS):
            hit = _hits(key[block], doc[block], around[block])
            edge = np.diff(np.hstack([np.zeros((len(hit), 1), bool), hit]).astype(np.int8), axis=1)
            (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            row = block[row]
            low = around[row, AROUND].astype(np.int64)
            tell(number[row], text[row], start[row] + first - low, final[row] + last - 1 - low + WINDOW)
    if heads[b"w"]:
        doc, text, start, final = np.concatenate(heads[b"w"], axis=1)
        group = np.unique(_as_values(np.concatenate(rows[b"w"])), return_inverse=True)[1].ravel()
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc)
        hit = np.flatnonzero(doc > least[group])
        tell(np.concatenate(chunk[b"w"])[hit], text[hit], start[hit], final[hit] + WINDOW)
    return _notes(out)


def _applied(chunk: _Chunk) -> pa.Table:
    """Each text of the chunk with what is left of it."""
    noted = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(3, -1) for x, _ in chunk.notes)], axis=1)
    noted = noted[:, np.argsort(noted[0], kind="stable")]
    removed, runs, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for row, end, data, offsets in slices(chunk.texts, SLICE):
        text, start, stop = noted[:, slice(*np.searchsorted(noted[0], [row, end]))]
        marks = np.zeros(len(data) + 1, np.int32)
        np.add.at(marks, offsets[text - row] + start, 1)
        np.add.at(marks, offsets[text - row] + stop, -1)
        gone = np.cumsum(marks[:-1], dtype=np.int32) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(gone)]
        begins[inner] = gone[inner]
        for flags, out in ((gone, removed), (begins, runs)):
            total = np.concatenate(([0], np.cumsum(flags)))
            out.append(total[offsets[1:]] - total[offsets[:-1]])
        kept += [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.diff(columns(chunk.texts)[1])
    return pa.Table.from_arrays([pa.array(chunk.sha, pa.binary()), *(pa.array(x.astype(np.int64)) for x in (sizes, np.concatenate(removed), np.concatenate(runs))), pa.array(kept, pa.binary())], ["sha", "n_bytes", "n_removed", "n_spans", "kept"])


def _distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """sha, text: each text at most once for each task, so that copies aren't moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keep, sha = [], [hashlib.sha256(t).digest() for t in as_bytes(b["text"])]
            for s in sha:
                keep.append(s not in seen)
                seen.add(s)
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), b["text"]], ["sha", "text"]).filter(pa.array(keep, pa.bool_()))
        release()

    return df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "sha binary, text string")


def _left_of(df: DataFrame, id_col: str, text_col: str, long_key: int = LONG_KEY) -> tuple[DataFrame, DataFrame]:
    """(sha, low_id, lows, copies) and (sha, n_bytes, n_removed, n_spans, kept) of each distinct text; lows: rows with the smallest id.

    The texts are dealt into chunks once and stored; each of the three passes over them reads that, exchanges what it found by
    shard, and stores the answers.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = df.select(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, shards = max(8, size // CHUNK), max(8, size // SHARD)
    each = df.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id")).groupBy("sha", "id").agg(F.count("*").alias("n"))
    lows = cut(each.groupBy("sha").agg(F.min(F.struct("id", "n")).alias("low"), F.sum("n").alias("copies")).select("sha", F.col("low.id").alias("low_id"), F.col("low.n").alias("lows"), "copies"))
    number = F.pmod(F.xxhash64("sha"), F.lit(chunks)).alias("chunk")
    whole = bucketed(_distinct_texts(df, text_col).select(number, "sha", "text"), "chunk")
    ids = lows.select(number, F.lit(0).alias("kind"), "sha", F.col("low_id").alias("doc"), F.lit(None).cast("binary").alias("one"), F.lit(None).cast("binary").alias("two"))

    def over_chunks(notes: DataFrame | None, fn, schema: str) -> DataFrame:
        side = ids
        if notes is not None:
            side = ids.union(notes.select("chunk", F.lit(1), F.lit(None).cast("binary"), F.lit(None).cast("long"), "one", "two"))

        def run(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
            out = fn(_Chunk(texts, notes), key[0].as_py())
            release()
            return out

        return whole.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(run, schema)

    sent = "shard long, chunk long, one binary, two binary"
    noted = "chunk long, one binary, two binary"
    survivors = cut(over_chunks(None, lambda c, k: _first_digit(c, k, shards), sent).groupBy("shard").applyInArrow(_trimmed(lambda t: _surviving(t, shards, long_key)), noted))
    spans = cut(over_chunks(survivors, lambda c, k: _surroundings(c, k, shards), sent).groupBy("shard").applyInArrow(_trimmed(_matched), noted))
    return lows, over_chunks(spans, lambda c, k: _applied(c), "sha binary, n_bytes long, n_removed long, n_spans long, kept binary")


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_key: int = LONG_KEY) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id; judged on the input as a whole. A null
    text counts as empty. Of equal texts all but those with the smallest id go as a whole if they have 50 bytes; rows that
    repeat an id don't count against each other. A null id counts as the largest. An empty table gives no rows. Other columns
    are ignored, whatever their names. long_key: rows from which on an anchor's windows are dealt one by one; no result depends on it.
    """
    lows, left = _left_of(df, id_col, text_col, long_key)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    results = left.select("sha", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    known = lows.join(results, "sha")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha"))
    joined = join_skewed(rows, known, "sha", "copies", ["low_id", "n_removed", "n_spans", "kept_sha256"])
    own = (F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("low_id")) | (F.col("n_bytes") < WINDOW)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(own, F.col("n_removed")).otherwise(F.col("n_bytes")).alias("n_removed"),
        F.when(own, F.col("n_spans")).otherwise(F.lit(1).cast("long")).alias("n_spans"),
        F.when(own, F.col("kept_sha256")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"),
    )


def drop_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_key: int = LONG_KEY) -> DataFrame:
    """df with its texts cut down as repeated_windows says; bytes of characters that were cut through go too. Rows all stay.

    A null text stays null, an empty one empty; a text of which nothing is left becomes empty. Ids, repeated rows, ties and empty
    tables count as there. Columns may have any names.
    """
    sha, low, many, copies, kept, salt, short = fresh(df, "win_sha", "win_low", "win_lows", "win_copies", "win_kept", "win_salt", "win_short")
    lows, left = _left_of(df, id_col, text_col, long_key)
    text = F.col(text_col).cast("string")
    brief = F.coalesce(F.octet_length(text), F.lit(0)) < WINDOW
    # the texts stay behind: a row takes what is left of its text by the text's hash; short ones lose nothing
    keyed = df.withColumns({sha: F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), short: F.when(brief, F.coalesce(text, F.lit(""))), kept: text.isNull()}).drop(text_col).withColumnRenamed(kept, copies)
    marked = join_skewed(keyed, lows.select(F.col("sha").alias(sha), F.col("low_id").alias(low), F.col("lows").alias(many), F.col("copies").alias(kept)), sha, kept, [low, many])
    first = F.col(short).isNull() & (F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)) == F.col(low))
    served = F.ceil(F.col(many) / SERVED).cast("long")
    hashed = F.xxhash64(F.col(id_col), F.spark_partition_id())
    asking = marked.withColumn(salt, F.when(first, F.pmod(hashed, served)).otherwise(F.lit(-1) - F.pmod(hashed, F.lit(65536))))
    clean = F.pandas_udf(lambda s: s.map(lambda x: x.decode("utf-8", "ignore")), "string")
    rest = left.where(F.col("n_bytes") >= WINDOW).join(lows.select("sha", F.col("lows").alias(many)), "sha")
    results = rest.select(F.col("sha").alias(sha), F.explode(F.sequence(F.lit(0).cast("long"), served - 1)).alias(salt), clean(F.col("kept")).alias(kept))
    whole = asking.join(results, [sha, salt], "left")
    return whole.withColumn(text_col, F.when(~F.col(copies), F.coalesce(short, kept, F.lit("")))).select(*df.columns)
