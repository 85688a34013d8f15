"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Where a piece goes depends on the multiset of lengths alone, so the documents are never brought together. Lengths are counted
(at most `capacity` different ones, pre-aggregated), and the driver runs best-fit decreasing over the counts: a segment tree over
remaining capacities finds the tightest open bin in logarithmic time, and runs of equal pieces meeting runs of equal bins are
placed in one step. The result is the same as that of placing piece by piece. A run of bins at least halves its remaining
capacity whenever it takes a piece, so the plan has O(capacity * log(capacity)) rows however many documents there are; that
is what is broadcast. Pieces then find their place by their rank among pieces of equal length, which is counted over salted
buckets.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.llm.common import cut, release, texts
from veridoc.llm.words import slices

#: Words of which a worker keeps the ids (some 200 bytes each); beyond that it keeps those and starts a new table, into which used words move.
CACHED_WORDS = 600_000
#: Bytes of text that are tokenised at once: each distinct word among them is looked up once.
BLOCK = 8 << 20
#: A character that the tokenizer makes one token of; it stands between words that are encoded together.
MARK = b"\x01"


class WordIds:
    """Ids of whole texts by a tokenizer that never joins characters across ASCII white space.

    Each distinct word is encoded once by the tokenizers library and kept; the ids of a text are its words' ids in a row. Special
    tokens that a text spells out become their ids, as by the library's default.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that close a word
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes[[k for token, k in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.cached = cached
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, joined. Each distinct word is looked up once; all new ones go to the library in one call."""
        if len(self.known) > self.cached:
            self.known, self.older = {}, self.known
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.known.get, words))
        if None in found:
            gaps = [k for k, ids in enumerate(found) if ids is None]
            self._learn({words[k] for k in gaps})
            for k in gaps:
                found[k] = self.known[words[k]]
        code = coded.indices.to_numpy()
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        size = np.diff(stops, prepend=0)
        ends = np.concatenate(([0], np.cumsum(size[code])))  # where each word's ids end among all ids
        place = np.repeat((stops - size)[code] - ends[:-1], size[code]) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[place]
        offsets = split.offsets.to_numpy()
        edges = ends[offsets - offsets[0]].tolist()
        for start, stop in zip(edges, edges[1:]):
            yield ids[start:stop].tobytes()

    def _learn(self, words: set[bytes]) -> None:
        known, older, ends = self.known, self.older, []
        new: set[bytes] = set()
        for w in words:
            if older and (ids := older.get(w)) is not None:
                known[w] = ids
                continue
            base, tail = _stem(w)
            new.add(base)
            if tail:
                new.add(tail)
            if tail or base is not w:
                ends.append((w, base, tail))
        new.difference_update(known)
        if older:
            for w in [w for w in new if w in older]:
                known[w] = older[w]
            new.difference_update(known)
        letters, others = [], []
        for w in new:
            (letters if w.isalpha() or not w.isascii() and w.decode().isalpha() else others).append(w)
        known.update(zip(letters, self._encode_letters(letters), strict=True))
        known.update(zip(others, self._encode(others), strict=True))
        for w, base, tail in ends:
            known[w] = known[base] + known[tail] if tail else known[base]

    def _encode_letters(self, words: list[bytes]) -> Iterator[bytes]:
        """Words of letters alone: the tokenizer makes one run of each, and only its last token may close a word."""
        blocks = [words[k : k + 400] for k in range(0, len(words), 400)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(stops) != len(block) or stops[-1] != 4 * len(ids):  # a letter that in lower case isn't one alone
                yield from self._encode(block)
                continue
            data, start = ids.tobytes(), 0
            for stop in stops:
                yield data[start:stop]
                start = stop

    def _encode(self, words: list[bytes]) -> Iterator[bytes]:
        """Words in strings of many, as a call has a cost of its own; a word that holds the mark goes alone."""
        strings, block = [], []
        for w in words:
            if MARK in w or len(block) == 400:
                strings.append(block)
                block = []
            block.append(w)
            if MARK in w:
                strings.append(block)
                block = []
        strings = [x for x in [*strings, block] if x]
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        between = b" " + MARK + b" "
        for block, e in zip(strings, self.tokenizer.encode_batch_fast([between.join(x).decode() for x in strings], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data, start = ids.tobytes(), 0
            if len(block) > 1:
                for at in np.flatnonzero(ids == mark[0]).tolist():
                    yield data[4 * start : 4 * at]
                    start = at + 1
            yield data[4 * start :]


def _stem(word: bytes) -> tuple[bytes, bytes]:
    """A word and the one mark that ends it, as far as the tokenizer splits there in any case; ASCII words in lower case."""
    base, tail = (word[:-1], word[-1:]) if word[-1:] in (b".", b",") else (word, b"")
    if base.isalpha():
        return base.lower(), tail
    if tail and base and unicodedata.normalize("NFC", base.decode()).lower()[-1].isalpha():
        return base, tail
    return word, b""


_encoders: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, cached: int = CACHED_WORDS) -> WordIds:
    if (path, cached) not in _encoders:
        _encoders[path, cached] = WordIds(path, cached)
    return _encoders[path, cached]


def pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED_WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit, binary): documents as token ids with an end, cut only where longer than a sequence.

    A null or empty text is one piece that holds the end alone; texts may be of any length. Repeated rows each give their pieces, an
    empty table none; other columns are ignored, whatever their names.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, most = word_ids(tokenizer, cached), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            doc, piece, start, length, ids = [], [], [], [], []
            for d, whole in zip(b["doc_id"].to_pylist(), _by_slice(encode, b["text"], block), strict=True):
                whole += end
                for k in range(0, len(whole), most):
                    part = whole[k : k + most]
                    doc.append(d)
                    piece.append(k // most)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])
        release()

    return texts(df, id_col, text_col).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids binary")


def _by_slice(encode: WordIds, column: pa.Array, block: int = BLOCK) -> Iterator[bytes]:
    """A few MB of text at a time, however large the batch is."""
    for row, stop, _, _ in slices(column, block):
        yield from encode(column.slice(row, stop - row))


class Tightest:
    """A segment tree over remaining capacities: which is the smallest one, at least so large, that an open bin has."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.width)

    def mark(self, remaining: int, is_open: bool) -> None:
        node = remaining + self.width
        self.open[node] = is_open
        while node := node >> 1:
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def find(self, least: int) -> int | None:
        node = least + self.width
        if self.open[node]:
            return least
        while node > 1:
            if not node & 1 and self.open[node + 1]:  # what stands to the right is larger
                node += 1
                while node < self.width:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.width
            node >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: how many}: rows (length, first rank, how many, first bin, pieces a bin, first offset).

    Within a row, rank r (from the first) lies in bin `first bin + r // pieces a bin`, at `first offset + length * (r % pieces a bin)`.
    """
    tree, runs, rows, bins = Tightest(capacity), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room is None:  # open as many new bins as the rest needs
                room, each = capacity, capacity // length
                runs[room].append((bins, -(-left // each)))
                bins += -(-left // each)
                tree.mark(room, True)
            first, n = runs[room].pop()
            if not runs[room]:
                tree.mark(room, False)
            each = room // length  # a bin that took a piece is tighter than before, so it takes the next one too
            full, rest = min(n, left // each), 0
            if full:
                rows.append((length, rank, full * each, first, each, capacity - room))
                _put(runs, tree, room - each * length, (first, full))
                rank, left = rank + full * each, left - full * each
            if full < n and 0 < left < each:
                rows.append((length, rank, left, first + full, left, capacity - room))
                _put(runs, tree, room - left * length, (first + full, 1))
                rank, left, rest = rank + left, 0, 1
            if full + rest < n:
                _put(runs, tree, room, (first + full + rest, n - full - rest))
    return rows


def _put(runs: dict[int, list[tuple[int, int]]], tree: Tightest, room: int, run: tuple[int, int]) -> None:
    if room:
        runs[room].append(run)
        tree.mark(room, True)


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """parts (doc_id, piece, length and other columns) with sequence_id and offset (offsets in a sequence are gapless from 0).

    Exactly what best-fit decreasing over all pieces gives, at any size. Ties between equal lengths go by bucket, id and piece;
    repeated rows get places of their own. Lengths must lie in 1 to capacity. An empty table gives no rows. parts is read three
    times; hand over a stored table.
    """
    spark = parts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.lit(11)), F.lit(buckets)).cast("int"))
    sizes = cut(salted.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    planned = spark.sparkContext.broadcast(rows)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "base")
    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = numbered.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("number"))
    names = [*parts.columns]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = planned.value
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            row = rows[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(row[:, 3] + at // row[:, 4]), pa.array(row[:, 5] + length * (at % row[:, 4]))], [*names, "sequence_id", "offset"])

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*names, "rank").mapInArrow(places, schema)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached: int = CACHED_WORDS, block: int = BLOCK) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids on wish.

    A null or empty text is one piece that holds the end alone. Extra columns of df are ignored. The pieces are stored in the
    shared folder between tokenising and packing, without their ids unless these are asked for. cached: words of which a worker
    keeps the ids; block: bytes of text that it tokenises at once; the rows are the same at any number.
    """

    parts = pieces(df, tokenizer, capacity, end_id, id_col, text_col, cached, block).withColumn("ids_crc32", F.crc32("ids"))
    return pack(cut(parts if with_ids else parts.drop("ids")), capacity)
