"""The pipeline's near stage against brute force over sets of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from veridoc.llm import similar
from veridoc.llm.words import Texts

SCHEMA = "doc_id long, text string, near_row string"


def sets(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_stage_links_lightly_edited_copies(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = [(0, None), (1, ""), (2, "two words"), (3, "Two  words"), (None, "four words here now"), (None, "other words stand here alone today")]
    for k in range(40):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        rows.append((10 * k + 10, " ".join(base)))
        for j in range(rng.randint(1, 6)):  # chains too: each copy of the one before
            base = base.copy()
            for _ in range(rng.randint(1, 1 + len(base) // 40)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append((10 * k + 11 + j, " ".join(base)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in corpus_pipeline.near(spark, spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), "").collect())
    own, root = [sets(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if own[a] == own[b] or len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    best = {}
    for (i, t), r in zip(rows, root, strict=True):
        best[r] = min(best.get(r, (True, 0, "")), (i is None, -1 if i is None else i, t or "")) if r in best else (i is None, -1 if i is None else i, t or "")
    assert got == sorted((i, t) for _, i, t in best.values())
    assert len(got) < 100 < len(rows)
    assert corpus_pipeline.near(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_simhash_bits_are_those_of_most_shingles():
    texts = ["", "one", " ".join(f"w{k % 700}" for k in range(1_300)), "a b c d e f"]
    data = "".join(texts).encode()
    found, many = similar.shingles(Texts(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)])))
    got = np.unpackbits(similar.simhashes(found, many), axis=1)
    for k, end in enumerate(np.cumsum(many).tolist()):
        words = similar.mix(found[end - many[k] : end, None] * similar._FACTORS)
        ones = sum((np.unpackbits(w.view(np.uint8)).astype(int) for w in words), np.zeros(similar.BITS, int))
        assert np.array_equal(got[k], 2 * ones > many[k])


@pytest.mark.parametrize("short", [similar.SHORT, 3])
def test_posting_lists_bring_all_pairs_of_different_roots_together(spark, monkeypatch, short):
    """The near stage's candidates are the pairs with two equal positional bytes in a band, whose first bits are close: each once."""
    monkeypatch.setattr(similar, "SHORT", short)
    monkeypatch.setattr(similar, "FLUSH", 500)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, (6, similar.BITS)).repeat(20, axis=0)
    bits = np.packbits(base ^ (rng.random(base.shape) < rng.uniform(0, 0.15, (len(base), 1))), axis=1)
    root = np.arange(120) // 40 * 40 + np.where(np.arange(120) % 5 == 0, np.arange(120) % 40, 0)
    nodes = spark.createDataFrame([(k, int(root[k]), 100 + k % 40, bits[k].tobytes()) for k in range(120)], "node long, root long, size long, sketch binary").repartition(3)
    want = set()
    for a in range(120):
        for b in range(a):
            front = np.unpackbits(bits[a, : similar.FRONT // 8] ^ bits[b, : similar.FRONT // 8]).sum()
            sizes = sorted((100 + a % 40, 100 + b % 40))
            if root[a] != root[b] and (bits[a].view("<u2") == bits[b].view("<u2")).any() and sizes[0] >= 0.8 * sizes[1] and front <= similar._limit(similar.FRONT, np.array(sizes[0]), 0.8):
                want.add((a, b))
    entries = similar._live(nodes, 0.8)
    got = [(r.a, r.b) for r in similar._pairs(entries, nodes.select("node", "root"), 0.8).collect()]
    assert len(got) == len(set(got)) > 300 and set(got) == want
    assert {(r.a, r.b) for r in similar._pairs(entries, None, 0.8).collect()}


def test_few_and_many_links_give_the_same_components(spark, monkeypatch):
    rng = random.Random(2)
    links = spark.createDataFrame([(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(140)] + [(k, k + 1) for k in range(1_000, 1_040)], "a long, b long").repartition(3)
    few = {tuple(r) for r in similar._joined(links).collect()}
    monkeypatch.setattr(similar, "LINKS", 0)
    assert few == {tuple(r) for r in similar._joined(links).collect()} and len(few) > 100
    monkeypatch.setattr(similar, "LINKS", 10)
    assert similar._joined(links.where("a > 5000")).count() == 0


@pytest.mark.parametrize("part", [similar.PART, 30_000])
def test_sets_are_brought_to_a_group_once_and_not_for_each_list(spark, monkeypatch, part):
    """A large group whose members are often just below the least similarity: sets travel with its size, not with its pairs; parts lose no link."""
    monkeypatch.setattr(similar, "PART", part)
    dealt, deal = [], similar._dealt
    monkeypatch.setattr(similar, "_dealt", lambda members: dealt.append(deal(members)) or dealt[-1])
    rng = random.Random(3)
    base, texts = [f"w{rng.randrange(3_000)}" for _ in range(150)], []
    for _ in range(120):
        words = base.copy()
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(3_000)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"u{rng.randrange(3_000)}" for _ in range(100)) for _ in range(10)]
    own, root = [sets(t) for t in texts], list(range(130))
    for a in range(130):
        for b in range(a):
            if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    got = similar.drop_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root)) and 11 < len(got) < 100
    times = [r["count"] for r in dealt[0].groupBy("own_row").count().collect()]
    parts = -(-8 * sum(len(x) for x in own[:120]) // part)
    assert len(times) == 120 and set(times) == {max(1, parts - 1)}
