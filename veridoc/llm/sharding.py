"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, id, row). Candidate boundaries (probes) are counted against all rows: each round gives the
exact bytes and rows below every probe, and the next round's probes go only between the two that enclose a target. When every
splitter meets the tolerance, the rows are exchanged once. The hash comes first, so equal texts lie side by side: a splitter goes
to the nearest edge between two groups of equal texts, and into a group (by id, then by row) only where that edge lies farther from
the target than the tolerance and than half of the largest row, by which any splitter between whole rows may be off.

A shard is exchanged as cells, parts of some `CELL` bytes by a hash of id and row, so that no task holds a whole shard; rows are
numbered by (cell, key) within their shard.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import fresh, staged

#: Probes between the two that enclose a target, in each round.
PROBES = 64
#: Bytes that every row counts besides its text.
ROW_BYTES = 8
#: What a splitter may be off, as a share of a shard's bytes, to fall between two groups.
TOLERANCE = 0.01
#: Bytes of a cell, about, and cells of all shards at most (their row counts are broadcast: 1.6 MB).
CELL, MOST_CELLS = 8 << 20, 100_000

Key = tuple[int, int, int]
#: Each part of a key is a signed 64-bit value.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(columns: tuple[np.ndarray, ...], probes: list[Key]) -> np.ndarray:
    """For each row, how many probes are at most its key; probes are sorted."""
    out = np.zeros(len(columns[0]), np.int64)
    _count(columns, np.arange(len(out)), probes, 0, 0, out)
    return out


def _count(columns: tuple[np.ndarray, ...], rows: np.ndarray, probes: list[Key], part: int, before: int, out: np.ndarray) -> None:
    heads, starts = np.unique(np.array([p[part] for p in probes], np.int64), return_index=True)
    ends = [*starts[1:].tolist(), len(probes)]
    values = columns[part][rows]
    at = np.searchsorted(heads, values, side="right")
    out[rows] = before + np.array([0, *ends], np.int64)[at]
    if part + 1 < len(columns):
        for k in np.unique(at[(at > 0) & (heads[np.maximum(at - 1, 0)] == values)]).tolist():
            group = probes[starts[k - 1] : ends[k - 1]]
            if any(p[part + 1 :] != (LOW,) * (len(columns) - part - 1) for p in group):
                same = rows[(at == k) & (values == heads[k - 1])]
                _count(columns, same, group, part + 1, before + int(starts[k - 1]), out)


def _histogram(rows: DataFrame, names: list[str], size: str, probes: list[Key]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = _below(tuple(b[c].to_numpy(zero_copy_only=False) for c in names), probes)
            n += np.bincount(at, minlength=len(n))
            np.add.at(total, at, b[size].to_numpy(zero_copy_only=False))
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells]), pa.array(n[cells])], ["cell", "size", "n"])

    found = rows.select(*names, size).mapInArrow(count, "cell long, size long, n long").groupBy("cell").agg(F.sum("size"), F.sum("n")).collect()
    total, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for cell, s, c in found:
        total[cell], n[cell] = s, c
    return list(zip(np.cumsum(total)[:-1].tolist(), np.cumsum(n)[:-1].tolist(), strict=True))


def _between(low: Key, high: Key) -> list[Key]:
    """Up to PROBES keys strictly between, in the first part that leaves room."""
    for part in range(3):
        if low[part] != high[part]:
            room = high[part] - low[part]
            if room > 1:
                step = [low[part] + room * i // PROBES for i in range(1, PROBES)]
                return [(*low[:part], v, *(LOW,) * (2 - part)) for v in sorted(set(step)) if low[part] < v < high[part]]
            # neighbouring values: what lies between has low's value here, so the room is in the parts behind
            for deeper in range(part + 1, 3):
                room = HIGH - low[deeper]
                if room > 0:
                    step = [low[deeper] + room * i // PROBES + (i == 0) for i in range(PROBES)]
                    return [(*low[:deeper], v, *(LOW,) * (2 - deeper)) for v in sorted(set(step)) if v > low[deeper]]
            return []
    return []


def find_splitters(rows: DataFrame, names: list[str], size: str, targets: list[int], slack: int, reach: int) -> list[Key]:
    """A splitter for each target.

    An edge between groups within `slack` bytes of the target is taken at once; else the group around the target is sought out, and
    its nearer edge taken if that is within `reach`; else the nearest place inside the group.
    """
    first, last = (LOW,) * 3, (HIGH,) * 3
    total = rows.agg(F.sum(size), F.count("*")).first()
    known: dict[Key, tuple[int, int]] = {first: (0, 0), last: (total[0] or 0, total[1])}
    chosen: dict[int, Key] = {}
    while True:
        order = sorted(known)
        sums = [known[k][0] for k in order]
        probes: set[Key] = set()
        for target in targets:
            if target in chosen:
                continue
            at = max(1, bisect.bisect_left(sums, target))
            low, high = order[at - 1], order[at]
            # the nearest edges of groups on both sides, and whether nothing but one group lies between them
            left, right = (low[0], LOW, LOW), high if high[1:] == (LOW, LOW) or high == last else last if high[0] == HIGH else (high[0] + 1, LOW, LOW)
            edges = [k for k in (left, right) if k in known]
            near = min(edges, key=lambda k: (abs(known[k][0] - target), k), default=None)
            alone = len(edges) == 2 and (right[0] - left[0] <= 1 or known[right][1] - known[left][1] <= 1)
            if near is not None and abs(known[near][0] - target) <= (max(slack, reach) if alone else slack):
                chosen[target] = near
                continue
            inner = _between(low, high) if known[high][1] - known[low][1] > 1 and known[high][0] > known[low][0] else []
            if not alone and len(edges) < 2:
                inner += [k for k in (left, right) if k not in known]
            if inner:
                probes.update(inner)
            else:
                chosen[target] = min((low, high), key=lambda k: (abs(known[k][0] - target), k))
        if not probes:
            return [chosen[t] for t in targets]
        asked = sorted(probes - known.keys())
        if not asked:
            raise AssertionError("probes between two counted keys are always new")
        known.update(zip(asked, _histogram(rows, names, size, asked), strict=True))


def shard_by_bytes(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """df's rows with shard (0 to shards - 1), slot (gapless from 0 in each shard) and size, after one exchange of whole rows.

    Sizes are the text's UTF-8 bytes plus 8; a null text has none. Each splitter is off its target by at most the tolerance (a share
    of a shard's bytes) or half of the largest row, whichever is more. Equal texts share a shard unless all of them together hold
    more than twice that and a target falls among them. Repeated rows are told apart by their place in the staged table. An empty
    table gives no rows; shards may be empty when there are fewer rows than shards. Null ids count as the smallest id. Column
    names that clash with the new ones get an underscore on the new side.
    """
    shard, slot, size, key, ident, row, cell = fresh(df, "shard", "slot", "size", "sort_hash", "sort_id", "sort_row", "sort_cell")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = staged(
        df.withColumns({size: F.octet_length(text).cast("long") + ROW_BYTES, key: F.xxhash64(text), ident: F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)), row: F.monotonically_increasing_id()})
    )
    names, spark = [key, ident, row], rows.sparkSession
    total, largest = (x or 0 for x in rows.agg(F.sum(size), F.max(size)).first())
    targets = [total * i // shards for i in range(1, shards)]
    bounds = sorted(find_splitters(rows, names, size, targets, int(tolerance * total / shards), largest // 2))
    cells = max(1, min(MOST_CELLS // shards, -(-total // (shards * CELL))))

    @F.pandas_udf("int")
    def place(h: pd.Series, i: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(_below((h.to_numpy(), i.to_numpy(), r.to_numpy()), bounds) if bounds else np.zeros(len(h), np.int64))

    placed = rows.withColumn(shard, place(key, ident, row)).withColumn(cell, F.pmod(F.xxhash64(ident, row), F.lit(cells)).cast("int"))
    counts = placed.groupBy(shard, cell).agg(F.count("*").alias("n")) if cells > 1 else placed.groupBy(shard).agg(F.lit(0).alias(cell), F.lit(0).alias("n"))
    base = np.zeros(shards * cells, np.int64)
    for r in counts.collect():
        base[r[0] * cells + r[1]] = r["n"]
    base = base.reshape(shards, cells)
    start = spark.sparkContext.broadcast((np.cumsum(base, axis=1) - base).ravel())

    @F.pandas_udf("long")
    def before(s: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(start.value[s.to_numpy() * cells + c.to_numpy()])

    rank = F.row_number().over(Window.partitionBy(shard, cell).orderBy(*names)) - 1
    ranked = placed.withColumn(slot, rank.cast("long"))
    return ranked.withColumn(slot, F.col(slot) + before(shard, cell) if cells > 1 else F.col(slot)).select(*df.columns, size, shard, slot)
