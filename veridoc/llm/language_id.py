"""Language of each word by a linear-chain conditional random field; a text's language by its words' marginals.

A word's features are its prefixes and suffixes, its byte n-grams and the word itself (a hashed lexicon). Transitions between
the languages of neighbouring words are learned along with them, from sequences put together from pieces of differently labelled
texts, so that switching inside a text has a cost but is possible. Marginals come from the forward-backward algorithm, exact over
whole texts: texts are cut into blocks whose transfer matrices are multiplied, so that blocks of all texts advance together. A
long text goes through in pieces, twice: the first time for each piece's transfer matrix, the second with what comes in from both
sides, so that memory doesn't grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import fresh, release, texts
from veridoc.llm.words import SPACE, Texts, mix, slices

#: Rows of each language that the model is fitted on, at most, by order of a hash of the id; and characters of each: a window
#: of the text at a place that the hash gives.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 2000
#: Rows of all languages, about: every language is learned, from fewer rows each where there are many.
ALL_ROWS = 64 * SAMPLE_ROWS
#: Bytes of text that are labelled at once, about: a longer text is worked on in pieces, cut at white space; a word of more than
#: LONG_WORD bytes counts as several words of at most so many.
SLICE, LONG_WORD = 1 << 18, 1 << 16
#: Rows of the weight table; lengths of affixes and n-grams in bytes.
ROWS, AFFIXES, GRAMS = 1 << 18, (1, 2, 3, 4), (2, 3, 4)
#: Words in a training sequence, in a block, and passes over the sample.
SEQUENCE, BLOCK, EPOCHS = 64, 64, 4
#: Below this mean of its words' largest marginals the pipeline's language stage rejects a text.
LEAST_SCORE = 0.35

#: A character of a Unicode category L.
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Features:
    """Feature rows of each word: one per affix and for the word, and one per n-gram, weighted by their number."""

    def __init__(self, t: Texts) -> None:
        start, end = t.start, t.end
        self.single, self.grams = [], []
        for kind, n in enumerate(AFFIXES):
            for side in (0, 1):
                a, b = (start, np.minimum(start + n, end)) if side == 0 else (np.maximum(end - n, start), end)
                self.single.append(self._rows(t, a, b, 2 * kind + side))
        self.single.append(self._rows(t, start, end, 99))
        length = end - start
        for n in GRAMS:
            many = np.maximum(length - n + 1, 0)
            ends = np.cumsum(many)
            at = np.repeat(start - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            self.grams.append((self._rows(t, at, at + n, 100 + n), many, ends))

    @staticmethod
    def _rows(t: Texts, a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return (mix(t.hashes(a, b) + np.uint64(kind * 0x9E3779B9)) % np.uint64(ROWS)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = sum(weights[rows] for rows in self.single).astype(np.float64)
        for rows, many, ends in self.grams:
            total = np.zeros((len(rows) + 1, weights.shape[1]))
            np.cumsum(weights[rows], axis=0, out=total[1:])
            out += (total[ends] - total[ends - many]) / np.maximum(many, 1)[:, None]
        return out

    def gradient(self, delta: np.ndarray) -> np.ndarray:
        out = np.zeros((ROWS, delta.shape[1]))
        for k in range(delta.shape[1]):
            for rows in self.single:
                out[:, k] += np.bincount(rows, delta[:, k], ROWS)
            for rows, many, _ in self.grams:
                out[:, k] += np.bincount(rows, np.repeat(delta[:, k] / np.maximum(many, 1), many), ROWS)
        return out


def _emissions(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf)) if len(scores) else scores


def transfer(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The matrix that takes the labels before a run of words to those after it, up to a factor."""
    out, blocks = np.eye(emit.shape[1]), -(-len(emit) // BLOCK)
    parts = np.broadcast_to(out, (blocks, *out.shape)).copy()
    padded = np.ones((blocks * BLOCK, emit.shape[1]))
    padded[: len(emit)] = emit
    padded = padded.reshape(blocks, BLOCK, -1)
    for k in range(BLOCK):
        live = -(-(len(emit) - k) // BLOCK)  # blocks with more than k words
        moved = (parts[:live] @ step) * padded[:live, k][:, None, :]
        parts[:live] = moved / moved.max(axis=(1, 2), keepdims=True)
    for part in parts:
        out = out @ part
        out /= out.max()
    return out


def marginals(emit: np.ndarray, step: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Each word's label probabilities by forward-backward. emit: exp of word scores; step: exp of transition scores; lengths: words of each text.

    before, after: for one text alone that is a piece of a longer one, what comes in from the words before and behind it.
    """
    labels = emit.shape[1]
    blocks = -(-lengths // BLOCK)
    n_blocks = int(blocks.sum())
    if not n_blocks:
        return np.zeros((0, labels))
    first_word = np.cumsum(lengths) - lengths
    first_block = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(lengths)), blocks)
    place = np.arange(n_blocks) - first_block[doc]
    start = first_word[doc] + place * BLOCK
    size = np.minimum(lengths[doc] - place * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")  # the blocks that still have a word are always a head of the list
    start, size = start[order], size[order]
    live = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks with more than k words
    transfer = np.broadcast_to(np.eye(labels), (n_blocks, labels, labels)).copy()
    for k in range(int(size.max())):
        m = live[k]
        moved = (transfer[:m] @ step) * emit[start[:m] + k][:, None, :]
        transfer[:m] = moved / moved.max(axis=(1, 2), keepdims=True)
    back_order = np.empty(n_blocks, np.int64)
    back_order[order] = np.arange(n_blocks)
    # vectors at the blocks' edges, one block of every text at a time
    enter, leave = np.ones((n_blocks, labels)), np.ones((n_blocks, labels))
    if before is not None:
        enter[back_order[0]] = before
    if after is not None:
        leave[back_order[-1]] = after
    most = int(blocks.max())
    for k in range(1, most):
        at = first_block[blocks > k] + k
        v = np.einsum("ni,nij->nj", enter[back_order[at - 1]], transfer[back_order[at - 1]])
        enter[back_order[at]] = v / v.max(axis=1, keepdims=True)
    for k in range(most - 2, -1, -1):
        at = first_block[blocks > k + 1] + k
        v = np.einsum("nij,nj->ni", transfer[back_order[at + 1]], leave[back_order[at + 1]])
        leave[back_order[at]] = v / v.max(axis=1, keepdims=True)
    forward = np.empty_like(emit)
    for k in range(int(size.max())):
        m = live[k]
        v = (enter[:m] @ step) * emit[start[:m] + k]
        enter[:m] = v / v.max(axis=1, keepdims=True)
        forward[start[:m] + k] = enter[:m]
    for k in range(int(size.max()) - 1, -1, -1):
        m = live[k]
        at = start[:m] + k
        v = leave[:m].copy()
        forward[at] *= v
        v = (v * emit[at]) @ step.T
        leave[:m] = v / v.max(axis=1, keepdims=True)
    return forward / forward.sum(axis=1, keepdims=True)


class Model:
    """Labels, word weights and transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.labels, self.weights, self.transitions = labels, weights, transitions

    def word_labels(self, t: Texts) -> np.ndarray:
        """Each word's probabilities, one column per label."""
        return marginals(_emissions(Features(t).scores(self.weights)), np.exp(self.transitions), t.counts)


def train(sample: list[tuple[str, str]]) -> Model:
    """Fit to (language, text) rows by adaptive gradient steps on the conditional likelihood. Deterministic."""
    labels = sorted({lang for lang, _ in sample})
    number, rng = {lang: k for k, lang in enumerate(labels)}, np.random.default_rng(0)
    pieces: list[tuple[int, list[bytes]]] = []
    for lang, text in sample:
        words, at = text.encode().split(), 0
        while at < len(words):
            n = int(rng.integers(4, 40))
            pieces.append((number[lang], words[at : at + n]))
            at += n
    rng.shuffle(pieces)
    words = [w for _, p in pieces for w in p]
    gold = np.array([k for k, p in pieces for _ in p], np.int64)
    weights, moves = np.zeros((ROWS, len(labels)), np.float32), np.zeros((len(labels), len(labels)))
    if len(labels) < 2 or not words:
        return Model(labels, weights, moves)
    seen, seen_moves = np.full(weights.shape, 1e-2, np.float32), np.full(moves.shape, 1e-2)
    batch = SEQUENCE * 160
    for _ in range(EPOCHS):
        for low in range(0, len(words), batch):
            some, truth = words[low : low + batch], gold[low : low + batch]
            joined = b" ".join(some)
            t = Texts(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), lower=True)
            lengths = np.array([min(SEQUENCE, len(some) - k) for k in range(0, len(some), SEQUENCE)])
            features, step = Features(t), np.exp(moves)
            emit = _emissions(features.scores(weights))
            p, expected = pair_marginals(emit, step, lengths)
            delta = -p
            delta[np.arange(len(truth)), truth] += 1
            g = features.gradient(delta / len(truth))
            seen += g * g
            weights += (0.5 * g / np.sqrt(seen)).astype(np.float32) * (g != 0)
            g = (_observed(truth, lengths, len(labels)) - expected) / len(truth)
            seen_moves += g * g
            moves += 0.3 * g / np.sqrt(seen_moves) - 1e-4 * moves
    return Model(labels, weights, moves)


def pair_marginals(emit: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each word's label probabilities, the expected number of each transition) by forward-backward over short sequences side by side."""
    n, labels, most = len(lengths), emit.shape[1], int(lengths.max(initial=0))
    place = np.arange(most) + (np.cumsum(lengths) - lengths)[:, None]
    real = np.arange(most) < lengths[:, None]
    e = np.where(real[:, :, None], emit[np.where(real, place, 0)], 1.0)
    forward, backward = np.empty((n, most, labels)), np.ones((n, most, labels))
    v = np.ones((n, labels))
    for k in range(most):
        v = (v @ step) * e[:, k]
        v /= v.sum(axis=1, keepdims=True)
        forward[:, k] = v
    expected = np.zeros((labels, labels))
    for k in range(most - 2, -1, -1):
        inside = real[:, k + 1]
        ahead = e[:, k + 1] * backward[:, k + 1]
        v = ahead @ step.T
        backward[:, k] = np.where(inside[:, None], v / v.sum(axis=1, keepdims=True), 1.0)
        pair = forward[:, k, :, None] * step * ahead[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True))[inside].sum(axis=0)
    p = (forward * backward)[real]
    return p / p.sum(axis=1, keepdims=True), expected


def _observed(truth: np.ndarray, lengths: np.ndarray, labels: int) -> np.ndarray:
    """How often each transition stands in the sequences."""
    inner = np.ones(len(truth), bool)
    inner[np.cumsum(lengths) - 1] = False
    a = np.flatnonzero(inner)
    return np.bincount(truth[a] * labels + truth[a + 1], minlength=labels * labels).reshape(labels, labels).astype(float)


def sample_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, training) -> list[tuple[str, str]]:
    """The bounded sample: rows of every language under the condition `training` with a language and a text.

    Those of the least hashes of id and text. Rows beyond a hash that some four times as many reach are left out before the shuffle,
    by each language's count (broadcast: a row for each language, of which the model holds 1 MB), so that no task gets more than a few
    times the sample of its languages; repeated rows count once.
    """
    labelled = df.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    most = min(SAMPLE_ROWS, max(1, ALL_ROWS // max(1, counts.count())))
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    where = F.lit(1) + F.pmod(F.shiftright(h, 8), F.greatest(F.lit(1), F.length(text_col) - SAMPLE_CHARS)).cast("int")
    hashed = labelled.select(F.col(lang_col).alias("lang"), h.alias("h"), F.col(text_col).substr(where, F.lit(SAMPLE_CHARS)).alias("window"))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(4.0 * most + 40) / F.col("n")).alias("share"))
    near = hashed.join(F.broadcast(share), "lang").where(F.col("h") <= F.lit(-(2.0**63)) + F.col("share") * 2.0**64).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    top = near.withColumn("rank", rank).where(F.col("rank") <= most)
    return [(r["lang"], r["window"]) for r in top.orderBy("lang", "rank").select("lang", "window").collect()]


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where a long text is cut: behind the last white space within SLICE bytes, or within a word that is longer than LONG_WORD."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            space = np.flatnonzero(SPACE[data[at:end]])
            if len(space) and end - at - int(space[-1]) <= LONG_WORD:
                end = at + int(space[-1]) + 1
        yield at, end
        at = end


def _words(data: np.ndarray, offsets: np.ndarray) -> Texts:
    """The texts' words; one of more than LONG_WORD bytes is taken apart."""
    t = Texts(data, offsets, lower=True)
    size = t.end - t.start
    if len(size) and size.max() > LONG_WORD:
        many = -(-size // LONG_WORD)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ends = np.repeat(t.end, many)
        t.start = np.repeat(t.start, many) + k * LONG_WORD
        t.end, t.doc = np.minimum(t.start + LONG_WORD, ends), np.repeat(t.doc, many)
        t.counts = np.bincount(t.doc, minlength=t.n)
    return t


def _inked(t: Texts) -> np.ndarray:
    """Which words have a byte of a letter, or one beyond ASCII."""
    inked = np.concatenate(([0], np.cumsum(_ASCII_LETTER[t.data] | (t.data >= 128))))
    return inked[t.end] > inked[t.start]


def _totals(t: Texts, p: np.ndarray) -> np.ndarray:
    """For each text the sums, over words with letters, of each label's marginal, of the largest one and of 1."""
    counts = _inked(t)
    p = p * counts[:, None]
    return np.stack([np.bincount(t.doc, x, t.n) for x in (*p.T, p.max(axis=1, initial=0), counts)], axis=1)


def _long_totals(model: Model, data: np.ndarray) -> np.ndarray:
    """The same of one long text, piece by piece."""
    step, cuts = np.exp(model.transitions), list(_pieces(data))

    def emissions(k: int) -> tuple[Texts, np.ndarray]:
        t = _words(data[slice(*cuts[k])], np.array([0, cuts[k][1] - cuts[k][0]]))
        return t, _emissions(Features(t).scores(model.weights))

    matrices = [transfer(emissions(k)[1], step) for k in range(len(cuts))]
    before, after = [np.ones(len(step))], [np.ones(len(step))]
    for m in matrices[:-1]:
        before.append((v := before[-1] @ m) / v.max())
    for m in matrices[:0:-1]:
        after.append((v := m @ after[-1]) / v.max())
    out = np.zeros((1, len(step) + 2))
    for k, (start, end) in enumerate(zip(before, after[::-1], strict=True)):
        t, emit = emissions(k)
        out += _totals(t, marginals(emit, step, t.counts, start, end))
    return out


def _predict(model: Model, batch: pa.Array) -> tuple[list[str], list[float], list[float]]:
    """Each text's language, the mean marginal of it over words with letters, and the mean of each word's largest marginal."""
    langs: list[str] = []
    scores: list[float] = []
    certain: list[float] = []
    labels = len(model.labels)
    for _, _, data, offsets in slices(batch, SLICE):
        n = len(offsets) - 1
        if not labels:
            total = np.zeros((n, 2))
        elif n == 1 and len(data) > SLICE:
            total = _long_totals(model, data)
        else:
            t = _words(data, offsets)
            total = _totals(t, model.word_labels(t))
        for k in range(n):
            own = data[offsets[k] : offsets[k + 1]]
            letter = _ASCII_LETTER[own].any() or _LETTER.search(own.tobytes().decode("utf-8", "replace")) is not None
            if not letter or not labels:
                langs.append("und")
                scores.append(0.0)
                certain.append(0.0)
            else:
                best, words = int(np.argmax(total[k, :labels])), total[k, -1]
                langs.append(model.labels[best])
                scores.append(float(min(1.0, total[k, best] / words)))
                certain.append(float(min(1.0, total[k, -2] / words)))
    return langs, scores, certain


def held_out(id_col: str = "doc_id"):
    """Whether a document is set apart from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    model = train(sample_rows(df, id_col, text_col, lang_col, ~held_out(id_col)))
    release()
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, lang_pred, score (mean marginal of that language over words with letters, 0 to 1).

    `und` with score 0 for a null text or one without a letter, and for every text where nothing was learned. Ties go to the
    language first in the alphabet. Whole texts count, however long. Repeated rows each give a row, an empty table none; other
    columns are ignored, whatever their names.
    """
    known = df.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*known.value)
        for b in batches:
            langs, scores, _ = _predict(model, b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
        release()

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """df without texts in no learned language: those without a letter, and those whose words' largest marginals have a mean below `least`.

    A null or empty text goes, as it has no letter; so does every text where nothing was learned. Texts may be of any length. Repeated
    rows stay or go together, an empty table gives none. Columns may have any names.
    """
    known = df.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transitions))
    (text,), names = fresh(df, "lang_text"), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*known.value)
        for b in batches:
            langs, _, certain = _predict(model, b[text])
            keep = pa.array([lang != "und" and s >= least for lang, s in zip(langs, certain, strict=True)], pa.bool_())
            release()
            yield b.select(names).filter(keep)
        release()

    return df.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, df.schema)
