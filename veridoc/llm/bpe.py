"""Byte-level BPE by prefix dynamic programming, exact against ranked merging.

For each prefix of a byte string exactly one token can stand last in that prefix's encoding. The encoder stores that token for
each prefix. A token t fits the end of a prefix if the prefix before it has a last token s such that the bytes of s and t
together encode to just (s, t); encodings whose neighbours all pass this test are the ones that merging gives. Appending bytes
only adds entries; an edit redoes entries from the edit on; the ids are read off from the end backward.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veridoc.llm.common import texts

#: Distinct matches of which a worker keeps ids (then it starts a new table, into which used ones move), and pairs of which it
#: keeps the test's outcome (then it starts afresh).
CACHED_MATCHES, CACHED_PAIRS = 250_000, 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """The table of last tokens for one growing and editable byte string."""

    def __init__(self, bpe: BytePairs, data: bytes = b"") -> None:
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: no entry of a shorter prefix changes."""
        self.data += data
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Re-encode after data[start:end] became new; entries before start stay."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :]
        self.bpe.extend(self.data, self.last)

    def ids(self, end: int | None = None) -> list[int]:
        """Ids of the whole string, or of the prefix up to end."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(token := self.last[at])
            at -= len(self.bpe.tokens[token])
        return out[::-1]


class BytePairs:
    """Encoder and decoder over a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes, int]] = {}
        self.older: dict[str, tuple[bytes, bytes, int]] = {}
        self.ending: dict = {}  # tokens by their bytes from the last to the first; the rank under -1
        for token, rank in ranks.items():
            node = self.ending
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank

    def merged(self, data: bytes) -> list[int]:
        """Plain ranked merging, for strings of two tokens: the definition that the pair test rests on."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (known := self.fits.get(pair)) is None:
            if len(self.fits) > CACHED_PAIRS:
                self.fits.clear()
            if left < 0:  # alone at the start: the token's own bytes must merge to it
                known = self.merged(self.tokens[right]) == [right]
            else:
                known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self.fits[pair] = known
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fill in the last token of each prefix of data that has none yet. last[0] is -1, for nothing."""
        fit, known, ending = self.fit, self.fits, self.ending
        for end in range(len(last), len(data) + 1):
            node, found, at = ending, [], end
            while at and (node := node.get(data[at - 1])) is not None:
                at -= 1
                if -1 in node:
                    found.append((at, node[-1]))
            for start, token in reversed(found):  # longer tokens pass more often
                before = last[start]
                if (ok := known.get((before, token))) is None:
                    ok = fit(before, token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError(f"the ranks have no token for byte {data[end - 1]}")

    def match_ids(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token itself is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last = [-1]
        self.extend(data, last)
        at, out = len(data), []
        while at:
            out.append(token := last[at])
            at -= len(self.tokens[token])
        return out[::-1]

    def _learn(self, match: str) -> None:
        if (known := self.older.get(match)) is not None:
            self.known[match] = known
            return
        ids = self.match_ids(match.encode())
        self.known[match] = (b",%d" * len(ids) % tuple(ids), b"".join(self.tokens[i] for i in ids), len(ids))

    def encode(self, text: str) -> list[int]:
        return [i for m in self.matches(text) for i in self.match_ids(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def round_trip(self, text: str) -> tuple[bytes, bytes, int]:
        """Decimal ids joined by commas, the bytes that these ids decode to, and how many there are."""
        if len(self.known) > CACHED_MATCHES:
            self.known, self.older = {}, self.known
        matches, known = self.matches(text), self.known
        try:
            found = [known[m] for m in matches]
        except KeyError:
            for m in matches:
                if m not in known:
                    self._learn(m)
            found = [known[m] for m in matches]
        return b"".join([f[0] for f in found])[1:], b"".join([f[1] for f in found]), sum([f[2] for f in found])


_encoders: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BytePairs(load_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_documents(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the encoding of every whole text, in one pass and without a shuffle.

    A null text counts as empty and has no ids; texts may be of any length. Repeated rows each give a row, an empty table none; other
    columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(ranks, pattern)
        for b in batches:
            lists = [[int(x) for x in bpe.round_trip(t)[0].split(b",") if x] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (binary): the bytes of every list of ids.

    A null or empty list decodes to no bytes; an unknown or null id fails the query. Repeated rows each give a row, an empty table none;
    other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([bpe.decode(x or []) for x in b["ids"].to_pylist()], pa.binary())], ["doc_id", "data"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every whole text, in one pass and without a shuffle.

    A null text counts as empty: no tokens. Repeated rows each give a row, an empty table none; other columns are ignored. A
    match of any length takes time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = byte_pairs(ranks, pattern), hashlib.sha256
        for b in batches:
            n, ids, data = [], [], []
            for text in b["text"].to_pylist():
                i, d, k = bpe.round_trip(text)
                n.append(k)
                ids.append(sha(i).hexdigest())
                data.append(sha(d).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
