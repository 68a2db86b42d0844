"""Toxicity by a convolutional text classifier (operator 9).

A word is the sum of two hashed embeddings, of the word and of its first PREFIX letters, so that inflected and unseen
forms share what was learned; filters of several widths run over them, the largest response of each filter
over the whole text is kept, and a logistic layer gives the score, calibrated (Platt) on held-back rows. It is trained
in numpy from a bounded sample: the SAMPLE labelled rows with the smallest hash of their id, whole texts, fewer where
texts are so long that they would hold over SAMPLE_LETTERS in the mean. A threshold
for each language is chosen on the held-back rows; it decides the extra column ``toxic``, never the score.

Words and first letters are hashed to 2^BITS buckets. Those seen in fewer than LEAST_TEXTS training texts get no
embedding of their own: they would be learned by heart, and in a small sample they outnumber the rest. Of the others, the
ROWS seen in most texts have one, which bounds the model (under 12 MB).

A trained filter tap times the embedding table is a table by word, so scoring is a few look-ups and additions a word.
Scoring needs no shuffle.

Edge cases: null and empty texts, and texts without words, are scored as no words; very long texts are pooled whole;
repeated rows score alike; labels that are null take no part; with no labels, or labels of one kind only, every score
is that kind's rate, and so it is where the rows left to train on, beside those for calibration, are of one kind; an empty
table gives no rows; other columns are kept, those of the names that are added are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches, without

BITS, EMBED, FILTERS, WIDTHS, PREFIX = 20, 16, 8, (1, 2, 3), 4
BUCKETS, LEAST_TEXTS, ROWS = 1 << BITS, 4, 1 << 15
SAMPLE, SAMPLE_LETTERS, EPOCHS, STEPS, BATCH, RATE, DROP, START, SEED = 10_000, 100_000_000, 6, 1_400, 32, 4e-3, 0.5, 0.02, 11
MOST_EPOCHS = 200
#: Words remembered with their bucket in a Python worker; then the memo starts anew.
MEMO = 500_000
_WORD = re.compile(r"[^\W\d_]+")
_memo: dict[str, int] = {}


def _buckets(text: str | None) -> np.ndarray:
    """Of each word its bucket and, BITS higher, its prefix's; 0 is padding, of which two stand at the end."""
    words = _WORD.findall((text or "").lower())
    found = list(map(_memo.get, words))
    if None in found:
        if len(_memo) > MEMO:
            _memo.clear()
        for w in words:
            if w not in _memo:
                whole, start = (1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for x in (w, "^" + w[:PREFIX]))
                _memo[w] = whole | start << BITS
        found = [_memo[w] for w in words]
    return np.array([*found, 0, 0], dtype=np.int64)


class TextCNN:
    def __init__(self, texts: list[np.ndarray], seed: int = SEED, least_texts: int = LEAST_TEXTS):
        """Untrained; ``texts`` (buckets by word) decide which buckets have a row of the embedding table."""
        self.seed = seed
        rng, seen = np.random.default_rng(seed), np.zeros(BUCKETS, np.int32)
        for t in texts:
            seen[np.unique([t & (BUCKETS - 1), t >> BITS])] += 1
        seen[0] = 0
        most = np.argsort(-seen, kind="stable")[: ROWS - 1]
        self.kept = np.sort(most[seen[most] >= least_texts]).astype(np.int32)
        self.embed = rng.normal(0, START, (len(self.kept) + 1, EMBED)).astype(np.float32)
        self.taps = [rng.normal(0, (1 / (EMBED * w)) ** 0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.base = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32)
        self.scale, self.shift, self.thresholds = 1.0, 0.0, {}
        self.embed[0] = 0
        self.tables: list[np.ndarray] | None = None

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """The same words by row of the embedding table; row 0 is padding and all rare words."""
        word, start = buckets & (BUCKETS - 1), buckets >> BITS
        if not len(self.kept):
            return np.zeros(len(buckets), np.int64)
        at = [np.minimum(np.searchsorted(self.kept, x), len(self.kept) - 1) for x in (word, start)]
        word, start = (np.where(self.kept[i] == x, i + 1, 0) for i, x in zip(at, (word, start)))
        return word | start << BITS

    def _projected(self) -> list[np.ndarray]:
        """For each width, the response of each tap by word bucket."""
        return [np.stack([self.embed @ tap for tap in taps]) for taps in self.taps]

    @staticmethod
    def _responses(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        n = len(ids)
        word, start = ids & (BUCKETS - 1), ids >> BITS
        out = table[0][word] + table[0][start]
        for j in range(1, len(table)):
            out[: n - j] += table[j][word[j:]]
            out[: n - j] += table[j][start[j:]]
        return out

    def pooled(self, tables: list[np.ndarray], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text; ids of several texts, each ending in padding."""
        best = [np.maximum.reduceat(self._responses(t, ids), starts, axis=0) + b for t, b in zip(tables, self.bias)]
        return np.maximum(np.hstack(best), 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        self.tables = self.tables or self._projected()
        out, i = np.empty(len(texts)), 0
        while i < len(texts):  # at most about 200,000 words at a time, or one text
            j, words = i, 0
            while j < len(texts) and (j == i or words + len(texts[j]) < 200_000):
                words += len(texts[j])
                j += 1
            part = [self.rows(t) for t in texts[i:j]]
            starts = np.concatenate([[0], np.cumsum([len(t) for t in part])[:-1]])
            out[i:j] = self.pooled(self.tables, np.concatenate(part), starts) @ self.out + self.base
            i = j
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -40, 40)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        texts = [self.rows(t) for t in texts]
        rng, params = np.random.default_rng(self.seed), [self.embed, *self.taps, *self.bias, self.out, self.base]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(max(EPOCHS, min(MOST_EPOCHS, -(-STEPS * BATCH // len(texts))))):  # a small sample is gone over more often
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                # other words get to be the largest when some are left out
                seen = {r: np.where(rng.random(len(texts[r])) < DROP, 0, texts[r]) for r in rows}
                tables, grads, step = self._projected(), [np.zeros_like(p) for p in params], step + 1
                at, best = [], []
                for r in rows:  # where each filter responds most
                    for t in tables:
                        resp = self._responses(t, seen[r])
                        at.append(resp.argmax(0))
                        best.append(resp.max(0))
                best = np.array(best).reshape(len(rows), -1) + np.concatenate(self.bias)
                hidden = np.maximum(best, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.base, -30, 30)))
                delta = (p - labels[rows]) / len(rows)
                grads[-2], grads[-1] = hidden.T @ delta, delta.sum(keepdims=True)
                back = (delta[:, None] * self.out) * (best > 0)
                for w, width in enumerate(WIDTHS):
                    own = back[:, w * FILTERS : (w + 1) * FILTERS]
                    grads[1 + len(WIDTHS) + w] = own.sum(0)
                    where = np.array([at[i * len(WIDTHS) + w] for i in range(len(rows))])
                    for j in range(width):
                        words = np.array([[seen[r][x] if (x := a + j) < len(seen[r]) else 0 for a in where[i]] for i, r in enumerate(rows)])
                        for f in range(FILTERS):
                            for half in (words[:, f] & (BUCKETS - 1), words[:, f] >> BITS):
                                grads[1 + w][j, :, f] += self.embed[half].T @ own[:, f]
                                np.add.at(grads[0], half, own[:, f : f + 1] * self.taps[w][j, :, f])
                grads[0][0] = 0
                for x, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.tables = None

    def calibrate(self, texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> None:
        """Platt scaling, then for each language the threshold with the best F1."""
        x, y = self.logits(texts), labels
        for _ in range(50):  # Newton steps on (scale, shift), lightly held to (1, 0)
            p = 1 / (1 + np.exp(-np.clip(self.scale * x + self.shift, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - y) * x).sum() + (self.scale - 1), (p - y).sum() + self.shift])
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            d = np.clip(np.linalg.solve(h, g), -0.5, 0.5)  # full steps run away where the rows are separable
            self.scale, self.shift = self.scale - d[0], self.shift - d[1]
        score = self.scores(texts)
        for lang in [None, *sorted({x for x in langs if x})]:
            own = np.array([lang is None or x == lang for x in langs], dtype=bool)
            if lang is None or (own.sum() >= 50 and y[own].sum() >= 5):
                cuts = np.linspace(0.1, 0.9, 33)
                hit = [(score[own] >= c) for c in cuts]
                f1 = [2 * (h & (y[own] == 1)).sum() / max(1, h.sum() + y[own].sum()) for h in hit]
                self.thresholds[lang] = float(np.median(cuts[np.array(f1) >= max(f1) - 1e-12]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> TextCNN:
    """Trained from rows of labels where ``usable``; at most SAMPLE texts come to the driver."""
    few = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    joined = docs.select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id")
    mean = joined.agg(F.avg(F.length("text"))).first()[0] or 0.0
    rows = joined.orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("text")).limit(min(SAMPLE, int(SAMPLE_LETTERS / max(mean, 1.0)))).collect()
    return trained([(r.doc_id, _buckets(r.text), r.lang, float(r.y)) for r in rows])


def trained(rows: list[tuple[int, np.ndarray, str | None, float]], seed: int = SEED, least_texts: int = LEAST_TEXTS) -> TextCNN:
    """From (doc_id, buckets by word, language, label) in a fixed order; a quarter of the rows is for calibration."""
    y, texts = np.array([r[3] for r in rows]), [r[1] for r in rows]
    held = np.array([zlib.crc32(b"c%d" % r[0]) % 4 == 0 for r in rows], dtype=bool)
    model = TextCNN([t for t, h in zip(texts, held) if not h], seed, least_texts)
    if len(set(y[~held].tolist())) < 2:
        rate = float(y.mean()) if len(y) else 0.0  # of all rows
        model.out[:], model.shift = 0, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        model.thresholds = {None: 0.5}
        return model
    model.train([t for t, h in zip(texts, held) if not h], y[~held])
    model.calibrate([t for t, h in zip(texts, held) if h], y[held], [r[2] for r, h in zip(rows, held) if h])
    return model


def crossed(rows: list[tuple[int, np.ndarray, str | None, float]], seed: int = SEED, least_texts: int = LEAST_TEXTS, folds: int = 3) -> tuple[int, int, int, float]:
    """(positive rows, those scored 0.7 or more, other rows so scored, mean log loss), each row scored by a model that is
    trained on the other folds of ``rows``. Settings are chosen by this, on training rows alone."""
    fold = np.array([zlib.crc32(b"f%d" % r[0]) % folds for r in rows])
    y, score = np.array([r[3] for r in rows]), np.zeros(len(rows))
    for k in range(folds):
        model = trained([r for r, f in zip(rows, fold) if f != k], seed, least_texts)
        score[fold == k] = model.scores([r[1] for r, f in zip(rows, fold) if f == k])
    p = np.clip(np.where(y == 1, score, 1 - score), 1e-6, 1)
    return int(y.sum()), int(((score >= 0.7) & (y == 1)).sum()), int(((score >= 0.7) & (y == 0)).sum()), float(-np.log(p).mean())


def score(docs: DataFrame, model: TextCNN) -> DataFrame:
    """``docs`` plus toxicity (0 to 1) and toxic (by the language's threshold)."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([_buckets(t) for t in texts]))

    base = model.thresholds.get(None, 0.5)
    cuts = [F.when(F.col("lang") == lang, F.lit(c)) for lang, c in model.thresholds.items() if lang]
    scored = docs.select(*without(docs, "toxicity", "toxic"), run(F.col("text")).alias("toxicity"))
    return scored.withColumn("toxic", F.col("toxicity") >= F.coalesce(*cuts, F.lit(base)))
