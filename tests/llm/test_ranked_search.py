"""Ranked search against a plain scorer: nulls, empty and long texts, ties, repeats, skipping, many shards and chunks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """(item, rank, doc_id, score) by the formula, document after document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    total, words = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for row, ((i, c), n) in enumerate(zip(counts, lengths)):
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * total // words))) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, row int, term string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in ranked_search.search(ranked_search.index(d), q, **more).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    common, rare = ["the", "Of", "straße", "10"], [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(900)]
    docs += [(1000, None), (1001, ""), (1002, " .,\n"), (None, text(30)), (None, "w1 w2 w3"), (1003, text(30_000)), (1004, "w1 w2 w3"), (1004, "w1 w2 w3"), (1005, "w3, W2-w1")]
    docs += [(2000 + i, "tie of the w7") for i in range(40)]
    items = [(i, text(rng.randint(1, 25))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "the"), (104, "w1 w2"), (104, "w3"), (105, "w7 tie"), (None, "w1"), (106, "STRASSE straße Straße")]
    return docs, items


def test_search(spark, corpus):
    assert found(spark, *corpus) == plain(*corpus)


@pytest.mark.parametrize("sizes", [(64, 3, 16, 8, 2), (100_000, 4096, 1, 128, 1), (100_000, 4096, 10**6, 4, 1)])
def test_any_sizes(spark, corpus, sizes, monkeypatch):
    """Many shards and chunks; all lists short; all lists long."""
    for name, value in zip(("SHARD", "CHUNK", "SHORT", "BLOCK", "AT_ONCE"), sizes):
        monkeypatch.setattr(ranked_search, name, value)
    assert found(spark, *corpus, k=3) == plain(*corpus, k=3)


def test_blocks_are_skipped(monkeypatch):
    """With one good document and long lists of weak ones, few blocks are scored, and the result is the best all the same."""
    rng = np.random.default_rng(2)
    long = [(np.sort(rng.choice(10_000, 6_000, replace=False)), rng.integers(1, 9, 6_000)) for _ in range(3)]
    short = [(np.array([17, 8_000]), np.array([90, 95])), (np.array([17, 40]), np.array([50, 60]))]
    dense = np.zeros(10_000, np.int64)
    for at, part in [*long, *short]:
        dense[at] += part
    order = np.lexsort((np.arange(10_000), -dense))[:3]
    seen = []
    flat = np.flatnonzero
    monkeypatch.setattr(ranked_search.np, "flatnonzero", lambda x: seen.append(1) or flat(x))
    best, score = ranked_search._best([*long, *short], 10_000, 3)
    assert best.tolist() == order.tolist() and score.tolist() == dense[order].tolist()
    assert len(seen) < 20  # not each of the ten groups of blocks, twice


def test_empty(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
