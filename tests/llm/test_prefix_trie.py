"""The trie of conversations against a plain one: nulls, ties, repeats, long conversations, hot ends, empty tables."""

import hashlib
import random
import zlib

import pytest

from lodestar.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, b int, key string"


def plain(rows):
    """Nodes by prefix, from rows (conv_id, turn, role, text) without ties."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children.get(k, [])), leaves[k], saved[k], sha(k)) for k, m in members.items())


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[x] is None else r[x] for x in names) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in range(60):
        for t in range(rng.choice([1, 2, 5, 8, 9, 16, 17, 30])):
            out.append((c, t if t else None, rng.choice(["user", None]), rng.choice(["", None, "ja", "né", "x"])))
    out += [(100 + c, t, "u", f"t{t}") for c in range(0, 50) for t in range(70 if c % 2 else 64)]  # long, many equal
    out += [(5_000_000_000, 3, "user", "far"), (None, 1, "user", "none"), (-10, 1, "u", "below"), (-10, 2, "u", "zero")]
    return out


def test_trie(spark, rows):
    assert found(prefix_trie.conversation_trie(make(spark, rows).repartition(3))) == plain(rows)


@pytest.mark.parametrize("width", [1, 3])
def test_narrow_blocks(spark, rows, width):
    """Chains of many blocks, whose sums are carried over several rounds."""
    few = [r for r in rows if r[0] is not None and r[0] < 110]
    convs, turns = prefix_trie.rebuilt(prefix_trie.numbered(make(spark, few)))
    assert found(prefix_trie.prefix_trie(convs, turns, width)) == plain(few)


def test_many_ends_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 1, "u", "same") for c in range(0, 500, 5)]
    assert found(prefix_trie.conversation_trie(make(spark, rows).repartition(5))) == plain(rows)


def test_repeats_and_ties(spark):
    rows = [(0, 1, "u", "a"), (0, 1, "u", "a"), (10, 1, "u", "a"), (10, 2, "u", "b"), (15, 1, "u", "x"), (15, 1, "u", "y")]
    first = found(prefix_trie.conversation_trie(make(spark, rows)))
    assert first == found(prefix_trie.conversation_trie(make(spark, rows[::-1]).repartition(4)))
    assert sum(r[1] == 2 for r in first) == 3  # a repeated row is a turn


def test_empty(spark):
    assert found(prefix_trie.conversation_trie(make(spark, []))) == []
