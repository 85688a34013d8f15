"""Language-model scores from a log-frequency Bloom filter.

The texts are read once and stored as chunks: a chunk's distinct token hashes, and its texts as numbers into them. Counts of
single tokens are exact: every chunk sends its tokens' training counts to shards by hash and gets the totals back in the same
order, so no table of the vocabulary exists anywhere as a whole. Token pairs go the same way: every chunk sends its distinct pairs
with their training counts to segments by key, a segment keeps its pairs in a filter, and the chunk gets back what the filter says
of each of its pairs. A pair seen c times is a member once for each level whose threshold c reaches, up to the highest counts.
Probing level by level until one fails gives the count rounded down. Each level is sized by the number of pairs that reach it, so
that at any corpus size every training pair is a member and no level passes half full; no filter is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import cut, pack, staged, texts, unpack
from veridoc.llm.words import Texts, mix, slices

#: Bytes of text in a chunk, about.
CHUNK = 8 << 20
#: Counts that the levels stand for.
LEVELS = tuple(sorted({1, *(1 << k for k in range(1, 41)), *(3 << k for k in range(40))}))
#: Bits of a level for each pair that reaches it, which leaves a sixth of them set; and of all segments' least levels together.
BITS_A_KEY, LEAST_BITS = 16, 14
#: Weight levels, steps of a factor of 2^(1/2).
WEIGHT_LEVELS = 12
PROBES = 3
END = np.uint64(0x1B873593CC9E2D51)
#: Bits of a pair's key that its first token gives.
HEAD = np.uint64(36)


def level_bits(members: int, segments: int) -> int:
    """Bits of a level with so many members, in one of `segments` equal parts of the key space."""
    return max(64, (1 << LEAST_BITS) // segments, BITS_A_KEY * members)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    head = mix(first + np.uint64(17)) >> (np.uint64(64) - HEAD) << (np.uint64(64) - HEAD)
    return head | (mix(first * np.uint64(3) + second) >> HEAD)


def _slots(keys: np.ndarray, level: int, bits: int | np.ndarray) -> np.ndarray:
    a = mix(keys + np.uint64(level * 0x632BE59B + 1))
    b = (a >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a & np.uint64(0xFFFFFFFF)) + np.uint64(i) * b) % np.asarray(bits, np.uint64) for i in range(PROBES)]).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _chunks(df: DataFrame, fold: int, folds: int) -> DataFrame:
    """chunk, ids, held, lengths, vocabulary, tokens: the corpus as numbers, an end token after each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        ids, lengths, hashes, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal serial, size
            vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            held = np.array([i is not None and crc32(str(i).encode()) % folds == fold for i in ids], bool)
            packed = (np.concatenate(lengths), tokens)
            out = pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | serial], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in (squeeze(packed[0]), pack(vocabulary), squeeze(packed[1])))],
                ["chunk", "ids", "held", "lengths", "vocabulary", "tokens"],
            )
            serial, size = serial + 1, 0
            for x in (ids, lengths, hashes):
                x.clear()
            return out

        for b in batches:
            names = b["doc_id"].to_pylist()
            for first, end, data, offsets in slices(b["text"]):
                t = Texts(data, offsets, lower=True)
                n = t.counts + 1
                flat = np.full(int(n.sum()), END)
                inside = np.ones(len(flat), bool)
                inside[np.cumsum(n) - 1] = False
                flat[inside] = t.words()
                ids += names[first:end]
                lengths.append(n)
                hashes.append(flat)
                size += len(data)
                if size >= CHUNK or len(ids) >= 200_000:
                    yield row()
        if ids:
            yield row()

    return staged(df.mapInArrow(run, "chunk long, ids array<long>, held array<boolean>, lengths binary, vocabulary binary, tokens binary"))


def _opened(lengths: bytes, tokens: bytes, held: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, whether each is a text's first, whether each is of a training text)."""
    n, t = expand(lengths), expand(tokens)
    first = np.zeros(len(t), bool)
    first[np.cumsum(n) - n] = True
    return t, first, np.repeat(~np.array(held, bool), n)


def _parts(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(of[a]), slice(a, b)


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _token_totals(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, part, counts (training counts of the chunk's tokens of that part, in their order), types, tokens (of the part, once)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, held, lengths, vocabulary, tokens in zip(*(b[c].to_pylist() for c in ("chunk", "held", "lengths", "vocabulary", "tokens")), strict=True):
                keys = unpack(vocabulary)
                t, _, train = _opened(lengths, tokens, held)
                counts = np.bincount(t[train], minlength=len(keys))
                out = [(p, chunk, pack(keys[s]), squeeze(counts[s])) for p, s in _parts(_top(keys, bits))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "chunk", "keys", "counts"])

    def total(table: pa.Table) -> pa.Table:
        keys, counts = [unpack(x) for x in table["keys"].to_pylist()], [expand(x) for x in table["counts"].to_pylist()]
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, index, np.concatenate(counts))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        once = [int((sums > 0).sum())] + [0] * (len(keys) - 1), [int(sums.sum())] + [0] * (len(keys) - 1)
        return pa.Table.from_arrays([table["chunk"], table["part"], pa.array([squeeze(sums[i]) for i in np.split(index, cuts)], pa.binary()), pa.array(once[0], pa.int64()), pa.array(once[1], pa.int64())], ["chunk", "part", "counts", "types", "tokens"])

    sent = chunks.select("chunk", "held", "lengths", "vocabulary", "tokens").mapInArrow(send, "part long, chunk long, keys binary, counts binary")
    return cut(sent.groupBy("part").applyInArrow(total, "chunk long, part long, counts binary, types long, tokens long"))


def segment_filter(keys: np.ndarray, counts: np.ndarray, segments: int) -> bytes:
    """The filter's part for all pairs of one segment: the sizes of the levels in bits, then the bits of each level.

    Weights: of a token v with pairs in the filter, the share that these get is 2^(-w/2), rounded down, where the rest is left to
    single tokens: what the discount (one for each distinct pair of v) and counts rounded away make up.
    """
    thresholds = np.array(LEVELS)
    level = np.searchsorted(thresholds, counts, side="right")
    members = [keys[level > k] for k in range(len(LEVELS))]
    head = keys >> (np.uint64(64) - HEAD)
    starts = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if len(head) else np.zeros(0, np.int64)
    v, steps = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(starts):
        all_of, types = np.add.reduceat(counts, starts), np.diff(np.append(starts, len(head)))
        share = np.add.reduceat(thresholds[level - 1], starts) / (all_of + types)
        v, steps = head[starts], np.ceil(-2 * np.log2(share)).astype(np.int64) + 1
        v, steps = v[steps <= WEIGHT_LEVELS], steps[steps <= WEIGHT_LEVELS]
    sizes, bits = [], []
    for salt, own in [*enumerate(members), *((100 + k, v[steps > k]) for k in range(WEIGHT_LEVELS))]:
        sizes.append(level_bits(len(own), segments))
        level_of = np.zeros(sizes[-1], bool)
        level_of[_slots(own, salt, sizes[-1])] = True
        bits.append(np.packbits(level_of).tobytes())
    return np.array(sizes, "<i8").tobytes() + b"".join(bits)


class LogFrequencyFilter:
    """Levels of quantised counts, probed one after another."""

    def __init__(self, parts: list[bytes]) -> None:
        self.segments, levels = len(parts), len(LEVELS) + WEIGHT_LEVELS
        self.sizes = np.stack([np.frombuffer(p, "<i8", levels) for p in parts])
        used = -(-self.sizes // 8)
        self.starts = (np.cumsum(used) - used.ravel()).reshape(used.shape)
        self.bits = np.concatenate([np.frombuffer(p, np.uint8, offset=8 * levels) for p in parts])

    def _member(self, keys: np.ndarray, segment: np.ndarray, which: int, salt: int) -> np.ndarray:
        at = _slots(keys, salt, self.sizes[segment, which])
        return ((self.bits[self.starts[segment, which] + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)

    def _segment(self, keys: np.ndarray) -> np.ndarray:
        bits = self.segments.bit_length() - 1
        return _top(keys, bits) if bits else np.zeros(len(keys), np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of each pair, rounded down to a threshold; 0 if it isn't in the filter."""
        out, segment = np.zeros(len(keys), np.int64), self._segment(keys)
        live = np.arange(len(keys))
        for k, threshold in enumerate(LEVELS):
            live = live[self._member(keys[live], segment[live], k, k)]
            out[live] = threshold
            if not len(live):
                break
        return out

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """Of each pair's first token: the weight level of its pairs against single tokens, 0 if it has none in the filter."""
        head, segment = keys >> (np.uint64(64) - HEAD), self._segment(keys)
        steps, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for k in range(WEIGHT_LEVELS):
            live = live[self._member(head[live], segment[live], len(LEVELS) + k, 100 + k)]
            steps[live] = k + 1
            if not len(live):
                break
        return steps


def _pair_totals(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, part, counts, steps: what the filter says of the chunk's distinct pairs of that part, in their order.

    A segment's filter is built from all training pairs of the segment and probed for the pairs of every chunk.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, held, lengths, vocabulary, tokens in zip(*(b[c].to_pylist() for c in ("chunk", "held", "lengths", "vocabulary", "tokens")), strict=True):
                words = unpack(vocabulary)
                t, first, train = _opened(lengths, tokens, held)
                word = words[t]
                keys, index = np.unique(pair_keys(np.where(first, END, np.roll(word, 1)), word), return_inverse=True)
                counts = np.bincount(index[train], minlength=len(keys))
                out = [(p, chunk, pack(keys[s]), squeeze(counts[s])) for p, s in _parts(_top(keys, bits))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "chunk", "keys", "counts"])

    def probe(table: pa.Table) -> pa.Table:
        sent = [unpack(x) for x in table["keys"].to_pylist()]
        keys, index = np.unique(np.concatenate(sent), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, index, np.concatenate([expand(x) for x in table["counts"].to_pylist()]))
        held = LogFrequencyFilter([segment_filter(keys[sums > 0], sums[sums > 0], 1 << bits)])
        counts, steps = held.counts(keys), held.steps(keys)
        cuts = np.cumsum([len(k) for k in sent])[:-1]
        back = [(squeeze(counts[i]), squeeze(steps[i])) for i in np.split(index, cuts)]
        return pa.Table.from_arrays([table["chunk"], table["part"], *(pa.array([x[k] for x in back], pa.binary()) for k in (0, 1))], ["chunk", "part", "counts", "steps"])

    sent = chunks.select("chunk", "held", "lengths", "vocabulary", "tokens").mapInArrow(send, "part long, chunk long, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(probe, "chunk long, part long, counts binary, steps binary")


def lm_scores(df: DataFrame, fold: int = 1, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on texts whose crc32 of the id as text, modulo `folds`, is not `fold` (a null id trains). A token's probability after
    another is a * c / n + (1 - a) * base, with the pair's count c from the filter, the first token's exact count n, and the
    weight a from the filter (0 where the token has no pairs there). A null or empty text is its end token alone. Repeated rows
    each train and score. With no training text every count is 0. An empty table gives no rows. Other columns are ignored.
    """
    own = texts(df, id_col, text_col)
    size = own.select(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = _chunks(own, fold, folds)
    bits = min(20, max(4, (size // (24 << 20)).bit_length()))
    totals = _token_totals(chunks, bits)
    types, tokens = (int(x or 0) for x in totals.agg(F.sum("types"), F.sum("tokens")).first())
    found = totals.select("chunk", "part", "counts", F.lit(None).cast("binary").alias("steps")).union(_pair_totals(chunks, bits))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(right["part"].to_pylist(), right["counts"].to_pylist(), right["steps"].to_pylist(), strict=True), key=lambda x: x[0])
        counts = np.concatenate([expand(c) for _, c, w in parts if w is None])
        pair_counts, steps = (np.concatenate([expand(x[k]) for x in parts if x[2] is not None]) for k in (1, 2))
        shares = np.where(steps > 0, 2.0 ** (-(steps - 1) / 2), 0.0)
        ids, held = left["ids"][0].as_py(), left["held"][0].as_py()
        n = expand(left["lengths"][0].as_py())
        words = unpack(left["vocabulary"][0].as_py())
        t, first, _ = _opened(left["lengths"][0].as_py(), left["tokens"][0].as_py(), held)
        base = (counts + 0.5) / (tokens + 0.5 * (types + 1))
        log_base, end = np.log10(base), int(np.searchsorted(words, END))
        starts = np.cumsum(n) - n
        word = words[t]
        place = np.unique(pair_keys(np.where(first, END, np.roll(word, 1)), word), return_inverse=True)[1]
        score = np.empty(len(t))
        for low in range(0, len(t), 1 << 18):
            some = slice(low, low + (1 << 18))
            now = t[some]
            before = np.where(first[some], end, t[np.maximum(np.arange(low, low + len(now)) - 1, 0)])
            share, seen = shares[place[some]], counts[before]
            share[seen == 0] = 0
            pair = np.zeros(len(now))
            some_share = share > 0
            pair[some_share] = pair_counts[place[some]][some_share] / seen[some_share]
            score[some] = np.log10(share * np.minimum(pair, 1) + (1 - share) * base[now])
        columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n), pa.array(np.add.reduceat((counts[t] > 0).astype(np.int64), starts)), pa.array(np.full(len(n), tokens)), pa.array(np.add.reduceat(log_base[t], starts)), pa.array(np.add.reduceat(score, starts))]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, schema)
