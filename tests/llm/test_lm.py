"""Language-model scoring: counts and base score by brute force, gradients by differences, one probability, whole texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import attention, lm
from lodestar.llm.common import fold

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row string, c long, train string"


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"the number {i % 7} of Ünder x{i}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "The the THE Ünder\x0bend"), (6, "one two"), (6, "one two"), (None, "one  two three"), (10, "<|endoftext|> word\x85word"), (None, None)]
    return rows + [(20 + i, " ".join(f"w{(i * j) % 23}" for j in range(i * 3))) for i in range(30)]


@pytest.fixture(scope="module")
def scored(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    return [r.asDict() for r in lm.scores(docs.repartition(3), fold("doc_id", 10) != 0, PATH).collect()]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_base_score(rows, scored):
    assert len(scored) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = [(i, not held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None])) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = [tuple(r[x] for x in ("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score")) for r in scored]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_rare_words_are_joined(spark, rows, scored, monkeypatch):
    """The base score is the same when all words are frequent and when hardly any is."""
    monkeypatch.setattr(lm, "FREQUENT", 4)
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    again = lm.scores(docs, fold("doc_id", 10) != 0, PATH).collect()
    order = lambda x: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in x)
    assert order(again) == order(scored)


def test_scores_depend_on_the_text_alone(rows, scored):
    by = {}
    for r in scored:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[6][0] == pytest.approx(by[6][1], rel=1e-5) and by[1] == pytest.approx(by[2], rel=1e-5)
    assert all(r["score"] < 0 for r in scored)


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    model = attention.Attention(rng.integers(0, 9, 40))
    model.params = [x + rng.normal(0, 0.2, x.shape).astype(np.float32) for x in model.params]
    model.params[9][-1], model.params[10][-1] = 0, 0
    return model


def test_ids_have_probability_one(small):
    """After any context the probabilities of all ids sum to 1, and each id is scored once."""
    context = np.array([5, 7, 7, 3] * 20)
    total = 0.0
    alone = small.log10(context, np.array([0, len(context)]))[0]
    for i in range(40):
        both = small.log10(np.append(context, i), np.array([0, len(context) + 1]))[0]
        total += 10 ** (both - alone)
    assert total == pytest.approx(1, abs=1e-3)


def test_windows_score_every_id_once():
    for n in [*range(0, 140), 5000]:
        begins = np.array([0, n, n, n + 3])
        first, size, skip = attention.windows(begins)
        seen = Counter(x for f, s, k in zip(first, size, skip) for x in range(f + k, f + s))
        assert seen == Counter(range(n + 3))
        assert (size <= attention.LENGTH).all()


def test_windows_agree_with_single_steps(small):
    """A window's batched scores are those of its ids one by one, from the plain formulas."""
    ids = np.array([4, 9, 9, 1, 30, 2, 8, 8, 4, 11])
    e, p, wq, wk, wv, wo, w1, b1, w2, un, bn = [x.astype(np.float64) for x in small.params]
    total, context = 0.0, [attention.START, *ids]
    for t in range(len(ids)):
        x = np.array([e[small.row[context[i]]] + p[i] for i in range(t + 1)])
        a = x[t] @ wq @ (x @ wk).T / math.sqrt(attention.WIDTH)
        a = np.exp(a - a.max())
        y = x[t] + (a / a.sum()) @ (x @ wv) @ wo
        h = y + np.maximum(y @ w1 + b1, 0) @ w2
        for k in range(small.begins[ids[t]], small.begins[ids[t] + 1]):
            node = small.nodes[k]
            total -= math.log1p(math.exp(-small.signs[k] * (h @ un[node] + bn[node] + small.prior[node])))
    assert small.log10(ids, np.array([0, len(ids)]))[0] == pytest.approx(total / math.log(10), rel=1e-4)


def test_gradients(small):
    import copy

    model = copy.copy(small)
    model.params = [x.astype(np.float64) for x in small.params]
    model.prior, model.mask = small.prior.astype(np.float64), small.mask.astype(np.float64)
    pieces = np.random.default_rng(1).integers(0, 40, (5, attention.LENGTH + 1))
    pieces[2, 9:] = -1
    _, grads = model.gradients(pieces)
    for x, g in zip(model.params, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = x[at]
        x[at] = was + 1e-5
        up = model.gradients(pieces)[0]
        x[at] = was - 1e-5
        down = model.gradients(pieces)[0]
        x[at] = was
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_held_out_text_is_told_better_than_by_counts_of_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = fold("doc_id", 10) != 0
    held = [r for r in lm.scores(docs, train, PATH).collect() if not r.train]
    assert len(held) > 5
    tokenizer, model = Tokenizer.from_file(PATH), attention.Attention(np.zeros(49408, np.int64))
    texts = docs.select("doc_id", "text", train.alias("t")).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    model = attention.Attention(np.bincount([i for r in texts if r.t for i in ids(r.text)], minlength=49408))
    plain = 0.0
    for r in texts:
        if not r.t:
            x = np.array(ids(r.text))
            plain += model.log10(x, np.array([0, len(x)]))[0]
    assert sum(r.score for r in held) > 0.8 * plain  # at the smallest scale; 0.7 at a hundred times its size


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lm.scores(none, fold("doc_id", 10) != 0, PATH).collect() == []
    docs = spark.createDataFrame([(10, "one two", "x", 1, "y")], SCHEMA)
    from pyspark.sql import functions as F

    r = lm.scores(docs, F.lit(False), PATH).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0) and r.score < 0


def trigrams(rows, held):
    """log10 probability of each text from all training texts, by plain counts."""
    tokenizer = Tokenizer.from_file(PATH)
    v = tokenizer.get_vocab_size()
    ids = [[2, 2, *(x for w in words(t) for x in tokenizer.encode(w, add_special_tokens=False).ids), 2] for _, t in rows]
    learned = [(x[i - 2], x[i - 1], x[i]) for x, (doc, _) in zip(ids, rows) if not held(doc) for i in range(2, len(x))]
    one, two, three = Counter(c for _, _, c in learned), Counter((b, c) for _, b, c in learned), Counter(learned)
    after, after_kinds, both, both_kinds = Counter(), Counter(), Counter(), Counter()
    for (b, _), n in two.items():
        after[b] += n
        after_kinds[b] += 1
    for (a, b, _), n in three.items():
        both[a, b] += n
        both_kinds[a, b] += 1

    def p(a, b, c):
        q = (one[c] + 1) / (len(learned) + v)
        q = (two[b, c] + after_kinds[b] * q) / (after[b] + after_kinds[b]) if after[b] else q
        return (three[a, b, c] + both_kinds[a, b] * q) / (both[a, b] + both_kinds[a, b]) if both[a, b] else q

    return [sum(math.log10(p(*x[i - 2 : i + 1])) for i in range(2, len(x))) for x in ids]


def test_the_model_counts_every_training_text(spark, rows, scored, monkeypatch):
    """Scores are those of counts over all training rows, however rows, blocks and shards lie."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    want = sorted((str(i), round(s, 3)) for (i, _), s in zip(rows, trigrams(rows, held)))
    assert [held(i) for i, _ in rows].count(True) and len(want) == len(scored)

    def agrees(found):
        got = sorted((str(r["doc_id"]), round(r["score"], 3)) for r in found)
        assert [x for x, _ in got] == [x for x, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-5, abs=2e-3)

    agrees(scored)
    monkeypatch.setattr(lm, "BLOCK", 1)
    monkeypatch.setattr(lm, "SHARD", 500)
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    agrees([r.asDict() for r in lm.scores(docs.repartition(7), fold("doc_id", 10) != 0, PATH).collect()])


def test_a_frequent_id_is_dealt_over_shards():
    """Runs around one middle id go to as many shards as it has copies, each where its pairs are."""
    copies, first = np.full(9, 1), np.arange(1000)
    copies[4] = 5
    shards = lm._shards(np.full(1000, 4), first % copies[4], 7)
    assert len(set(shards)) == 5 and np.bincount(shards).max() == 200
    assert set(shards) == set(lm._shards(np.full(5, 4), np.arange(5), 7))
    assert len(set(lm._shards(np.full(1000, 3), first % copies[3], 7))) == 1
