"""Near duplicates by the Jaccard similarity of word shingles: the similarity mode of op10.

The method is that of op10, a SimHash under a byte-position inverted index with count filtering, at a width that holds pairs of 0.8:
of 64 bits such pairs differ in some ten, so that no positional byte need be shared; of `BITS` they differ in 15 %, each positional
byte is shared with a probability of 0.27, and each `BAND` of two with 0.072. A posting list is a band with its two bytes, so that
two nodes meet where their tally of shared bytes in a band is full: a pair at 0.8 in one band or more with a probability of 0.9993.
Of those that meet, the first `FRONT` bits, which the lists carry, are counted, then all bits; whole shingle sets decide. Texts with
equal shingle sets are one node.

No posting list is paired up as a whole. First each member of a list is held against the list's first node and its own neighbour,
which joins large groups in linear work; then all pairs of a list that still lie in different groups are held against each other. So
the groups are the components of all pairs that meet, and no two nodes of different groups do. Each node's set is brought to its group
once, and there all bits and sets decide, over a search that holds a node only against those not reached yet. A group too large for
one task is cut into parts, each two of which meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.llm.common import components, cut, first_of_each, first_runs, fresh, join_skewed, local_roots, over_batches, release, release_heaps, staged
from veridoc.llm.exact_dedup import BITS_A_KEY, MOST_BITS, _bloom, _slots
from veridoc.llm.words import Texts, mix, slices

#: Words of a shingle and least similarity.
WORDS, LEAST = 5, 0.8
#: Bits of a SimHash, of its front that the posting lists carry, and of a band (two positional bytes).
BITS, FRONT, BAND = 1536, 128, 16
BANDS = BITS // BAND
#: Bytes of text that are worked on at once, about; nodes that are listed at once; entries of the lists that a task holds, besides those of a longer list.
SLICE, LISTED, FLUSH = 1 << 18, 2_000, 300_000
#: Lists up to this length are compared outright, one distance in the list after the other.
SHORT = 512
#: Bytes of shingle sets in small groups that are compared by one task, and in a part of a larger group, about.
BLOCK, PART = 1 << 20, 4 << 20
#: Links up to this many are joined into components by one task, which holds some 50 MB; more of them by rounds of joins.
LINKS = 500_000
#: Standard deviations that a count of differing bits may lie above its mean at the least similarity.
DEVIATIONS = 4.2
#: What sets of few shingles may differ in beside that, as a share of the bits and over the shingles: their bits are often tied.
FEW = 0.2
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(t: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; how many each text has). Fewer than `words` words are one shingle."""
    many = np.where(t.counts > 0, np.maximum(t.counts - words + 1, 1), 0)
    starts = np.cumsum(t.counts) - t.counts
    doc = np.repeat(np.arange(t.n), many)
    at = np.arange(len(doc)) - (np.cumsum(many) - many)[doc] + starts[doc]
    end, word = (starts + t.counts)[doc], t.words()
    out = np.zeros(len(doc), np.uint64)
    for k in range(words):
        inside = at + k < end
        own = np.where(inside, word[np.minimum(at + k, max(0, len(word) - 1))], np.uint64(0)) if len(doc) else out
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + own + inside.astype(np.uint64))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.bincount(doc[new], minlength=t.n)


def simhashes(found: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The SimHash of each text as bytes: the bits that more than half of its distinct shingles have. found, many: as of `shingles`."""
    out = np.zeros((len(many), BITS // 8), np.uint8)
    ends = np.cumsum(many)
    for doc in np.flatnonzero(many).tolist():
        ones, end = np.zeros(BITS, np.int64), int(ends[doc])
        for k in range(end - int(many[doc]), end, 255):  # so many fit a byte's sum
            ones += np.unpackbits(mix(found[k : min(k + 255, end), None] * _FACTORS).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
        out[doc] = np.packbits(2 * ones > many[doc])
    return out


def _sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, size, SimHash) of each text; a text without words is node 0."""
    nodes, sizes, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, BITS // 8), np.uint8)]
    for _, _, data, offsets in slices(column, SLICE):
        found, many = shingles(Texts(data, offsets, lower=True))
        some = np.flatnonzero(many)
        node = np.zeros(len(many), np.uint64)
        if len(some):
            node[some] = np.add.reduceat(mix(found), (np.cumsum(many) - many)[some])
        nodes.append(node)
        sizes.append(many)
        bits.append(simhashes(found, many))
    return np.concatenate(nodes), np.concatenate(sizes), np.concatenate(bits)


def _limit(bits: int, low: np.ndarray, least: float) -> np.ndarray:
    """Bits of so many that sets of similarity `least`, the smaller one of `low` shingles, may differ in."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return bits * (p + FEW / low) + DEVIATIONS * np.sqrt(bits * p * (1 - p))


def _listed(nodes: DataFrame) -> DataFrame:
    """An entry for each band of each node: key (the band and its bytes), node, size, front, back (the first bits). nodes: node, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, LISTED):
                b = batch.slice(low, LISTED)
                sketch = np.frombuffer(b"".join(b["sketch"].to_pylist()), np.uint8).reshape(-1, BITS // 8)
                key = sketch.view("<u2").T.astype(np.int32) | (np.arange(BANDS, dtype=np.int32) << BAND)[:, None]
                front = np.ascontiguousarray(sketch[:, : FRONT // 8]).view(np.int64)
                rest = [b["node"].to_numpy(), b["size"].to_numpy(), front[:, 0], front[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.tile(x, BANDS)) for x in rest)], ["key", "node", "size", "front", "back"])
            release()

    return nodes.select("node", "size", "sketch").mapInArrow(run, "key int, node long, size long, front long, back long")


def _close(size: np.ndarray, front: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes and first bits let entries i and j be similar."""
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    return (low >= least * high - 1e-9) & (np.bitwise_count(front[i] ^ front[j]).sum(axis=1) <= _limit(FRONT, low, least))


def _steps(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within each short list, one distance in the list after the other."""
    short = np.flatnonzero((lengths > 1) & (lengths <= SHORT))
    for d in range(1, int(lengths[short].max(initial=1))):
        own = short[lengths[short] > d]
        n = lengths[own] - d
        i = np.repeat(starts[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield i, i + d


def _by_list(entries: DataFrame, work: Callable[[list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """work over whole posting lists, many at once, in the order of their keys. entries: key first; front and back become one."""
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = entries.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def done(last: bool) -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            whole = len(parts[0]) if last else int(np.searchsorted(parts[0], parts[0][-1]))  # the last list may go on
            held[:] = [tuple(x[whole:] for x in parts)]
            return work([x[:whole] for x in parts])

        waiting, due = 0, FLUSH
        for b in batches:
            if b.num_rows:
                front = np.stack([b["front"].to_numpy(), b["back"].to_numpy()], axis=1).view(np.uint64)
                held.append((*(b[c].to_numpy() for c in names), front))
                waiting += b.num_rows
                if waiting >= due:
                    yield done(last=False)
                    waiting = len(held[0][0])
                    due = max(FLUSH, 2 * waiting)
        if waiting:
            yield done(last=True)
        held.clear()
        release()

    return cut(entries.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, schema))


def _live(nodes: DataFrame, least: float) -> DataFrame:
    """The entries that have another one in their list that they may be similar to, and all of long lists: the others serve no more."""

    def work(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, node, size, front = parts
        starts = first_runs(key)
        lengths = np.diff(np.append(starts, len(key)))
        live = np.repeat(lengths > SHORT, lengths)
        for i, j in _steps(starts, lengths):
            near = _close(size, front, i, j, least)
            live[i[near]] = live[j[near]] = True
        words = front[live].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[live], node[live], size[live], words[:, 0], words[:, 1])], ["key", "node", "size", "front", "back"])

    return _by_list(_listed(nodes), work, "key int, node long, size long, front long, back long")


def _meet(key: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, front: np.ndarray, least: float, every: bool) -> tuple[np.ndarray, ...]:
    """(a, b) of nodes in one list and of different roots, whose sizes and first bits let them be similar.

    every: all such pairs, but each only in the first band of the front that it shares, if any; else those with the list's first
    node and those of neighbours.
    """
    order = np.lexsort((node, key))
    key, node, root, size, front = key[order], node[order], root[order], size[order], front[order]
    starts = first_runs(key)
    lengths = np.diff(np.append(starts, len(key)))
    out = [[np.zeros(0, np.int64)] for _ in range(2)]

    def take(i: np.ndarray, j: np.ndarray) -> None:
        some = root[i] != root[j]
        i, j = i[some], j[some]
        near = _close(size, front, i, j, least)
        i, j = i[near], j[near]
        if every:
            same = np.ascontiguousarray(front[i] ^ front[j]).view(np.uint16).reshape(-1, FRONT // BAND) == 0
            new = ~same.any(axis=1) | (same.argmax(axis=1) >= key[i] >> BAND)
            i, j = i[new], j[new]
        for at, x in enumerate((np.maximum(node[i], node[j]), np.minimum(node[i], node[j]))):
            out[at].append(x)

    if not every:
        first = np.repeat(starts, lengths)
        take(first, np.arange(len(key)))
        beside = np.flatnonzero(key[1:] == key[:-1])
        take(beside, beside + 1)
    else:
        for i, j in _steps(starts, lengths):
            take(i, j)
        for at in np.flatnonzero(lengths > SHORT).tolist():
            span = np.arange(starts[at], starts[at] + lengths[at])
            roots, many = np.unique(root[span], return_counts=True)
            largest = root[span] == roots[many.argmax()]
            for i in span[~largest].tolist():
                j = span[largest | (span > i)]
                take(np.full(len(j), i), j)
    return tuple(np.concatenate(x) for x in out)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that the links (a, b) of one task join to a smaller one."""
    nodes, at = np.unique(np.stack([a, b]), return_inverse=True)
    root = local_roots(len(nodes), *at.reshape(2, -1))
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _pairs(entries: DataFrame, roots: DataFrame | None, least: float) -> DataFrame:
    """The pairs (a, b) of nodes that meet in posting lists, each once.

    roots: (node, root) of joined nodes, whose pairs of different roots are all meant; None: the first pass, whose pairs are thinned
    so that components stay.
    """
    if roots is None:
        rooted = entries.withColumn("root", F.col("node"))
    else:
        counts = cut(entries.groupBy("node").agg(F.count("*").alias("lists")).join(roots, "node"))
        rooted = join_skewed(entries, counts, "node", "lists", ["root"]).withColumn("root", F.coalesce("root", "node"))

    every = roots is not None

    def work(parts: list[np.ndarray]) -> pa.RecordBatch:
        found = _meet(*parts, least, every)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (found if every else _forest(*found))], ["a", "b"])

    found = _by_list(rooted.select("key", "node", "root", "size", "front", "back"), work, "a long, b long")
    return cut(found.distinct())


def _groups(entries: DataFrame, least: float) -> DataFrame:
    """(node, root) of each node that meets another one: the components of all pairs that meet, their roots too."""
    first = _joined(_pairs(entries, None, least))
    found = _joined(_pairs(entries, first, least).union(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def _dealt(members: DataFrame) -> DataFrame:
    """own_row, root and block (x, y, z) of each node of a group (node, root, size, own_row).

    Small groups share blocks. Groups of more than `PART` are cut into parts by a hash; a block is two parts of one group, and a node
    goes to one for each other part.
    """
    weights = cut(members.groupBy("root").agg(F.sum("size").alias("weight")))
    blocks = F.lit(8 * (weights.agg(F.sum("weight")).first()[0] or 0) // BLOCK + 1)
    parts = F.ceil(F.lit(8) * F.col("weight") / PART).cast("long")
    wide = join_skewed(members, weights, "root", "weight", ["weight"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    whole = F.col("parts") == 1
    others = wide.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where(whole | (F.col("other") != F.col("part")))
    x, y, z = F.pmod(F.xxhash64("root"), blocks), F.least("part", "other"), F.greatest("part", "other")
    return cut(others.select("own_row", "root", F.when(whole, x).otherwise(F.col("root")).alias("x"), F.when(whole, -1).otherwise(y).alias("y"), F.when(whole, -1).otherwise(z).alias("z")))


def _held(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """root, x, y, z, node, set (sorted hashes), sketch of the rows (node, own_row, sketch, text) that `dealt` names.

    A Bloom filter of bounded size takes them out of the texts, which aren't shuffled; what it passes wrongly goes by the join.
    """
    heads = dealt.select("own_row").distinct()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_A_KEY * heads.count()).bit_length()))
    bloom = rows.sparkSession.sparkContext.broadcast(_bloom(heads.select(F.xxhash64("own_row").alias("prefix"), F.lit(0).cast("long").alias("length")), bits))

    def collect(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = b["key"].to_numpy()
        at = _slots(keys, np.zeros(len(keys), np.int64), bits)
        b = b.filter(pa.array(((bloom.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0), pa.bool_()))
        sets = []
        for _, _, data, offsets in slices(b["text"], SLICE):
            found, many = shingles(Texts(data, offsets, lower=True))
            sets += [x.tobytes() for x in np.split(found, np.cumsum(many)[:-1])]
        return pa.RecordBatch.from_arrays([b["node"], b["own_row"], pa.array(sets, pa.binary()), b["sketch"]], ["node", "own_row", "set", "sketch"])

    passed = over_batches(rows.select("node", "own_row", F.xxhash64("own_row").alias("key"), "sketch", "text"), collect, "node long, own_row long, set binary, sketch binary")
    return passed.join(dealt, "own_row").drop("own_row")


def _alike(own: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the sets are similar enough to one of them."""
    good = [np.zeros(0, bool)]
    for low in range(0, len(others), 256):
        some = others[low : low + 256]
        many = np.array([len(x) for x in some])
        joined = np.concatenate(some)
        hit = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(many) - many)
        good.append(both >= least * (len(own) + many - both) - 1e-9)
    return np.concatenate(good)


def _search(bits: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links (a, b) within a group, by number, that give its components: a node that is reached is held against those that aren't yet, by all bits, then by the sets."""
    sizes, rest, a, b = np.array([len(x) for x in sets]), np.arange(len(sets)), [], []
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            low = np.minimum(sizes[rest], sizes[x])
            at = np.flatnonzero(low >= least * np.maximum(sizes[rest], sizes[x]) - 1e-9)
            at = at[np.bitwise_count(bits[rest[at]] ^ bits[x]).sum(axis=1, dtype=np.int64) <= _limit(BITS, low[at], least)]
            at = at[_alike(sets[x], [sets[y] for y in rest[at].tolist()], least)]
            found = rest[at].tolist()
            a += [x] * len(found)
            b += found
            reached += found
            rest = np.delete(rest, at)
    return a, b


def _verified(held: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of nodes whose similarity is `least` or more, thinned so that components stay. held: as of `_held`."""

    def compare(block: pa.Table) -> pa.Table:
        root = block["root"].to_numpy()
        order = np.argsort(root, kind="stable")
        block = block.take(pa.array(order))
        node = block["node"].to_numpy()
        bits = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        sets = [np.frombuffer(x, np.uint64) for x in block["set"].to_pylist()]
        starts = first_runs(root[order]).tolist()
        a, b = [], []
        for low, high in zip(starts, [*starts[1:], len(node)], strict=True):
            x, y = _search(bits[low:high], sets[low:high], least)
            a += [low + k for k in x]
            b += [low + k for k in y]
        release()
        return pa.Table.from_arrays([pa.array(node[np.array(x, np.int64)]) for x in (a, b)], ["a", "b"])

    return cut(held.groupBy("x", "y", "z").applyInArrow(compare, "a long, b long"))


def _joined(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes that the links (a, b) join to a smaller one."""
    if links.count() > LINKS:
        return components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([np.zeros((2, 0), np.int64), *(np.stack([b["a"].to_numpy(), b["b"].to_numpy()]) for b in batches)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(*ends)], ["node", "root"])

    return cut(links.coalesce(1).mapInArrow(run, "node long, root long"))


def _roots(nodes: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(node, root) of the nodes that are linked to others. nodes: node, size, sketch, own_row (one of it); rows: node, own_row, sketch, text."""
    entries = _live(nodes.where("size > 0"), least)
    release_heaps(nodes.sparkSession)  # the index's shuffle goes, too
    members = cut(nodes.select("node", "size", "own_row").join(_groups(entries, least), "node"))
    del entries
    release_heaps(nodes.sparkSession)
    return _joined(_verified(_held(rows, _dealt(members)), least))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """df with one row of each component of texts linked at similarity `least` or more; all columns as they are.

    That of the smallest id stays (a null id only where no row has one), the first of repeated rows. ASCII letters are lowercased.
    Texts without words, null ones too, are one component. A text of fewer than five words is one shingle; texts may be of any length.
    An empty table gives no rows. Columns may have any names.
    """
    (node, row, size, sketch, low), names = fresh(df, "near_node", "near_row", "near_size", "near_sketch", "near_text"), df.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own, many, found = _sketches(b[low])
        return pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(own.view(np.int64)), pa.array(many), pa.array([x.tobytes() for x in found], pa.binary())], names=[*names, node, size, sketch])

    added = [T.StructField(node, T.LongType()), T.StructField(size, T.LongType()), T.StructField(sketch, T.BinaryType())]
    wide = df.withColumn(low, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = staged(over_batches(wide, run, T.StructType([*df.schema.fields, *added])).withColumn(row, F.monotonically_increasing_id()))
    own = rows.select(F.col(id_col).alias("own_id"), F.col(node).alias("node"), F.col(row).alias("own_row"))
    nodes = cut(rows.groupBy(F.col(node).alias("node")).agg(F.min(size).alias("size"), F.min(sketch).alias("sketch"), F.min(row).alias("own_row"), F.count("*").alias("copies")))
    own_texts = rows.select(F.col(node).alias("node"), F.col(row).alias("own_row"), F.col(sketch).alias("sketch"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    roots = _roots(nodes, own_texts, least).withColumnRenamed("node", "linked")
    labelled = cut(nodes.join(roots, nodes.node == roots.linked, "left").select("node", "copies", F.coalesce("root", "node").alias("root")))
    kept = first_of_each(join_skewed(own, labelled, "node", "copies", ["root"]))
    gone = staged(own.select("own_row").join(kept, "own_row", "left_anti").withColumnRenamed("own_row", row))
    return rows.join(gone, row, "left_anti").select(*names)
