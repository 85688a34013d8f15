"""Each operator on a small table with nulls, empty and odd texts, copies, repeated rows and clashing names, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from veridoc.llm import bpe, exact_dedup, html_extract, language_id, lm_score, packing, quality, sharding, simhash, window_dedup

SPACE = "[\x20\x09-\x0d]+"
WORDS = re.compile("[^\x20\x09-\x0d]+")
PASSAGE = "This passage of more than fifty bytes stands in several of the documents here. "
CLASH = "doc_id long, text string, lang string, kept string, shard string, size int, norm_hash string, component_id string, bucket int, score string, chunk string, sha string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    vocabulary = [a + b for a in ("the", "of", "ßen", "é", "a", "in", "tion") for b in ("", "er", ".", "ing", "中")]
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "***"), (5, "one two three")]
    for i in range(6, 60):
        out.append((i, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))))
    out += [(60 + k, PASSAGE * (k % 3 + 1) + out[10 + k][1]) for k in range(6)]
    out += [(70, out[20][1]), (71, out[20][1].replace(" ", "  ")), (72, out[21][1] + " x"), (73, "For " * 3000), (74, "aaaa" * 5000), (75, out[20][1])]
    return [*out, out[20], out[20]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, ("en", "fr", None)[k % 3], "x", "x", 1, "x", "x", 1, "x", "x", "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def test_exact(docs, empty, rows):
    norm = {i: re.sub(SPACE, "", t or "") for i, t in rows}
    size = Counter(re.sub(SPACE, "", t or "") for _, t in rows)
    best = {}
    for i, t in rows:
        n = norm[i]
        best[n] = min(best.get(n, (0, 1 << 60)), (-len(t or ""), i))
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n = norm[r.doc_id]
        assert (r.keep_id, r.group_size, bytes(r.digest)) == (best[n][1], size[n], hashlib.sha256(n.encode()).digest())
    assert sum(r.kept for r in got) == len(size)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(size)
    assert exact_dedup.exact_duplicates(empty).count() == 0 == exact_dedup.drop_exact_duplicates(empty).count()


def test_simhash(docs, empty, rows):
    def brute(t):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fp = {i: brute(t) for i, t in rows}
    low = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    low[a] = min(low[a], low[b])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all((r.fp % (1 << 64), r.component_id) == (fp[r.doc_id], low[r.doc_id]) for r in got)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(low.values()))
    assert simhash.near_duplicates(empty).count() == 0 == simhash.drop_near_duplicates(empty).count()


def test_long_lists_give_the_links_of_outright_comparison():
    rng = np.random.default_rng(0)
    center = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (rng.integers(0, 2, (400, 20)).astype(np.uint64) << rng.integers(0, 32, (400, 20)).astype(np.uint64)).sum(axis=1) for c in center]))
    a, b = simhash._links(np.zeros(len(fps), np.int64), fps, 4)
    near = np.bitwise_count(fps[:, None] ^ fps) <= 4
    x, y = np.nonzero(near)
    want = simhash.local_roots(len(fps), x, y)
    index = {v: k for k, v in enumerate(fps.tolist())}
    got = simhash.local_roots(len(fps), np.array([index[v] for v in a.tolist()], np.int64), np.array([index[v] for v in b.tolist()], np.int64))
    assert np.array_equal(want, got)


def test_windows(docs, empty, rows):
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    for long_key in (window_dedup.LONG_KEY, 2):  # the second deals nearly all windows one by one
        got = window_dedup.repeated_windows(docs, long_key=long_key).collect()
        assert len(got) == len(rows)
        assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4] for r in got)
    left = window_dedup.drop_repeated_windows(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, str(r.text)) for r in left.collect()) == sorted((i, str(t if t is None else want[i][4].decode("utf-8", "ignore"))) for i, t in rows)
    assert window_dedup.repeated_windows(empty).count() == 0 == window_dedup.drop_repeated_windows(empty).count()


def test_sharding(docs, empty, rows):
    got = sharding.shard_by_bytes(docs.select("doc_id", "text"), 5).collect()
    assert len(got) == len(rows)
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.size == len((r.text or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    clashing = sharding.shard_by_bytes(docs, 3)
    assert clashing.columns == [*docs.columns, "size_", "shard_", "slot"] and clashing.count() == len(rows)
    assert sharding.shard_by_bytes(empty, 3).count() == 0


def test_sharding_cuts_through_one_repeated_row(spark):
    df = spark.range(4000).selectExpr("7L as doc_id", "'same text' as text")
    sizes = Counter(r.shard for r in sharding.shard_by_bytes(df, 4).collect())
    assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 40


def test_best_fit_plan_is_that_of_one_piece_at_a_time():
    rng = random.Random(5)
    for _ in range(40):
        lengths = sorted(rng.choices(range(1, 41), k=rng.randint(0, 300)), reverse=True)
        rooms: list[int] = []
        for n in lengths:
            fitting = [r for r in rooms if r >= n]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - n)
            else:
                rooms.append(40 - n)
        bins: dict[int, list[tuple[int, int]]] = {}
        for length, _, many, first, each, offset in packing.plan(Counter(lengths), 40):
            for k in range(many):
                bins.setdefault(first + k // each, []).append((offset + length * (k % each), length))
        for placed in bins.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
        assert sorted(40 - sum(n for _, n in p) for p in bins.values()) == sorted(rooms)


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 128).collect()
    by: dict[int, list] = {}
    places: dict[int, list] = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    times = Counter(i for i, _ in rows)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = [(k // 128, k, len(ids[k : k + 128]), zlib.crc32(np.array(ids[k : k + 128], "<u4").tobytes())) for k in range(0, len(ids), 128)]
        assert sorted(by[i]) == sorted(parts * times[i])
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack_documents(empty, path).count() == 0


def test_bpe(docs, empty, rows):
    import tiktoken

    pairs = bpe.byte_pairs(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    got = bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    text = dict(rows)
    for r in got:
        ids = library.encode_ordinary(text[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest())
    assert bpe.round_trip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choices(["a", "aa", "th", "the", "ß", "中", "0", "!", "\n", " ", "😀"], k=rng.randint(1, 40)))
        assert pairs.encode(s) == library.encode_ordinary(s)


def test_bpe_prefix_table_after_appends_and_edits():
    pairs = bpe.byte_pairs(RANKS, public_tokenizers.PATTERN)
    table = bpe.PrefixEncoder(pairs, b"thereof")
    table.append(b"withal")
    assert table.ids() == bpe.PrefixEncoder(pairs, b"thereofwithal").ids()
    table.replace(2, 5, b"inki")
    assert table.ids() == bpe.PrefixEncoder(pairs, b"thinkiofwithal").ids() == pairs.merged(b"thinkiofwithal")


def test_quality(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(6, 40)] + [(None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = text[r.doc_id] or ""
        w = WORDS.findall(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                again += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered))
        assert r.base_failed == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r.kept and r.base_failed)
    assert quality.quality(empty, labels).count() == 0


def test_language(spark, docs, empty, rows):
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", dict(rows)[r.doc_id] or "")) and 0 <= r.score <= 1
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train([])).collect()} == {"und"}
    left = language_id.keep_identified(docs, model)
    assert left.columns == docs.columns


def test_marginals_are_those_of_all_label_sequences():
    from itertools import product

    rng = np.random.default_rng(2)
    emit, step, lengths = rng.random((9, 3)), rng.random((3, 3)), np.array([4, 0, 5])
    got, at = language_id.marginals(emit, step, lengths), 0
    for n in lengths.tolist():
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            p = np.prod([emit[at + k, s] * (step[path[k - 1], s] if k else step[:, s].sum()) for k, s in enumerate(path)])
            for k, s in enumerate(path):
                want[k, s] += p
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_long_texts_in_blocks_agree_with_one_block():
    rng = np.random.default_rng(4)
    emit, step = rng.random((500, 3)) + 0.01, rng.random((3, 3)) + 0.01
    got = language_id.marginals(emit, step, np.array([500]))
    forward, backward = np.zeros_like(emit), np.ones_like(emit)
    a = np.ones(3)
    for k in range(500):
        a = (a @ step) * emit[k]
        forward[k] = a = a / a.sum()
    for k in range(498, -1, -1):
        b = step @ (emit[k + 1] * backward[k + 1])
        backward[k] = b / b.sum()
    p = forward * backward
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True))


def test_lm(docs, empty, rows):
    tokens = [(i, [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(), None]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    total, types = sum(c.values()), len(c)
    want = {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), total, sum(np.log10((c[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)) for i, ws in tokens}
    got = lm_score.lm_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 and np.isfinite(r.score) and r.score <= 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_score.lm_scores(empty).count() == 0


def test_filter_rounds_counts_down():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    counts = np.minimum(rng.zipf(1.7, len(keys)), 3000)
    held = lm_score.LogFrequencyFilter([lm_score.segment_filter(k := keys, counts, 1)])
    got = held.counts(k)
    floor = np.array(lm_score.LEVELS)[np.searchsorted(lm_score.LEVELS, counts, side="right") - 1]
    assert (got >= floor).all() and (got == floor).mean() > 0.99
    assert (held.counts(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) > 0).mean() < 0.05


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        (None, ""),
        ("<article><h1>T&amp;x</h1><p>a  b<br>c<p>d</article><footer>f</footer>", "T&x\na b c\nd"),
        ("<nav><a>x</a></nav><main><p>y</p><form>no</form><aside>no</aside></main><script>var t='</p>'", "y"),
        ("<div class='comments'><p>" + "word " * 60 + "</p></div>", ""),
        ("<!-- <article>", ""),
    ],
)
def test_html(spark, page, text):
    df = spark.createDataFrame([(1, "u", page, "x")], "page_id long, url string, html string, text string")
    assert [r.text for r in html_extract.main_texts(df).collect()] == [text]
    assert html_extract.main_texts(df.where("false")).count() == 0
