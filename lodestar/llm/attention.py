"""A causal self-attention model over subword ids, in numpy: one attention layer, one feed-forward layer, Huffman output.

The output is a Huffman tree over the whole vocabulary, built from the counts of the training corpus: the probability of an
id is the product of the left or right decisions on its path, so all ids together have probability 1 and an id costs as
many products as its path has nodes (some eight), not as many as the vocabulary has ids. Node biases begin at the corpus'
log-odds, so an untrained model is the smoothed unigram. The ROWS most common ids have an embedding, the ROWS nodes of most
weight a vector; the others share row 0 and have a bias alone.

Windows of LENGTH ids overlap: each begins STRIDE further, and only ids that no window before has scored count, so each id
is scored once, with LENGTH - STRIDE ids of context at least.
"""

from __future__ import annotations

import heapq
import numpy as np

LENGTH, STRIDE, WIDTH, HIDDEN, ROWS = 32, 29, 24, 36, 4096
#: Windows in a batch, and the learning rate.
BATCH, RATE = 64, 4e-3
#: The id that begins every context.
START = 2


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(path begins by id, nodes, signs, node biases); nodes are numbered by falling weight. Every id counts once more."""
    n = len(counts)
    weights = [int(c) + 1 for c in counts]
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    left, right, total = [], [], []
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        left.append(i)
        right.append(j)
        total.append((a, b))
        heapq.heappush(heap, (a + b, n + len(left) - 1))
    parent = np.zeros(n + len(left), np.int64) - 1
    side = np.zeros(n + len(left), np.int8)
    for k, (i, j) in enumerate(zip(left, right)):
        parent[i], parent[j], side[i], side[j] = k, k, 1, -1
    pairs = np.array(total, np.float64).reshape(-1, 2)
    number = np.empty(len(left), np.int64)
    number[np.argsort(-pairs.sum(1), kind="stable")] = np.arange(len(left))
    nodes, signs, begins = [], [], np.zeros(n + 1, np.int64)
    for i in range(n):
        at = i
        while parent[at] >= 0:
            nodes.append(number[parent[at]])
            signs.append(side[at])
            at = n + parent[at]
        begins[i + 1] = len(nodes)
    bias = np.zeros(len(left))
    bias[number] = np.log(pairs[:, 0] / pairs[:, 1]) if len(left) else 0.0
    return begins, np.array(nodes, np.int32), np.array(signs, np.float32), bias.astype(np.float32)


def windows(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents whose ids lie one after another, from ``begins`` to its last: (first place, places, places at
    its front that a window before has scored)."""
    sizes = np.diff(begins)
    each = np.where(sizes <= LENGTH, sizes > 0, 1 - (LENGTH - sizes) // STRIDE)  # 1 + ceil((n - LENGTH) / STRIDE)
    doc = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    first = begins[:-1][doc] + nth * STRIDE
    return first, np.minimum(LENGTH, begins[1:][doc] - first), np.where(nth > 0, LENGTH - STRIDE, 0)


class Attention:
    def __init__(self, counts: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.begins, self.nodes, self.signs, self.prior = huffman(counts)
        common = np.argsort(-counts, kind="stable")[: ROWS - 1]
        common = common[counts[common] > 0]
        self.row = np.zeros(len(counts), np.int32)
        self.row[common] = 1 + np.arange(len(common))
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        d, s = WIDTH, WIDTH**-0.5
        self.params = [
            normal(0.3, len(common) + 1, d), normal(0.1, LENGTH, d), normal(s, d, d), normal(s, d, d), normal(s, d, d), normal(s * 0.5, d, d),
            normal(s, d, HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN**-0.5 * 0.5, HIDDEN, d), np.zeros((ROWS, d), np.float32), np.zeros(ROWS, np.float32),
        ]
        self.mask = np.triu(np.full((LENGTH, LENGTH), -1e9, np.float32), 1)
        self.seen = np.tril(np.ones((LENGTH, LENGTH), np.float32))

    def _forward(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        e, p, wq, wk, wv, wo, w1, b1, w2 = self.params[:9]
        length = rows.shape[1]
        x = e.take(rows, 0)
        x += p[:length]
        q, k, v = _dot(x, wq * np.float32(WIDTH**-0.5)), _dot(x, wk), _dot(x, wv)
        a = q @ k.transpose(0, 2, 1)
        a += self.mask[:length, :length]
        a -= a.max(-1, keepdims=True)
        np.exp(a, a)
        size = a.sum(-1, keepdims=True)
        m = a @ v
        m /= size
        y = _dot(m, wo)
        y += x
        u = _dot(y, w1)
        u += b1
        np.maximum(u, 0, u)
        h = _dot(u, w2)
        h += y
        return x, q, k, v, a, size, m, y, u, h

    def _told(self, rows: np.ndarray) -> np.ndarray:
        """h of ``_forward`` alone. With one head, products of weights stand for two steps: x (wq wk') x' and a x (wv wo)."""
        e, p, wq, wk, wv, wo, w1, b1, w2 = self.params[:9]
        length = rows.shape[1]
        x = e.take(rows, 0)
        x += p[:length]
        a = _dot(x, wq @ wk.T * np.float32(WIDTH**-0.5)) @ x.transpose(0, 2, 1)
        np.clip(a, -80, 80, a)  # as good as taking off the maximum, and cheaper
        np.exp(a, a)
        a *= self.seen[:length, :length]
        m = a @ x
        m /= (a.reshape(-1, length) @ np.ones(length, a.dtype)).reshape(*a.shape[:2], 1)
        y = _dot(m, wv @ wo)
        y += x
        u = _dot(y, w1)
        u += b1
        np.maximum(u, 0, u)
        y += _dot(u, w2)
        return y

    def _decisions(self, h: np.ndarray, targets: np.ndarray):
        """Of every decision on the targets' paths, which lie one after another: (where each target's begin, place of its
        target, node, sign, signed log-odds). Nodes beyond the vectors share the last one, which is zero."""
        begins = self.begins[targets]
        sizes = self.begins[targets + 1] - begins
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(targets), dtype=np.int32), sizes)
        at = np.arange(len(owner)) + np.repeat(begins - starts, sizes)
        node, sign = self.nodes[at], self.signs[at]
        z = np.einsum("ij,ij->i", h.take(owner, 0), self.params[9].take(node, 0, mode="clip"))
        z += self.prior.take(node)
        z += self.params[10].take(node, mode="clip")
        z *= sign
        return starts, owner, node, sign, z

    def log10(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 probability of each document, of documents' ids one after another; ``begins`` has the end too."""
        first, size, skip = windows(begins)
        context = np.empty(len(ids), np.int64)
        context[1:] = ids[:-1]
        context[begins[:-1][np.diff(begins) > 0]] = START
        rows, scores = self.row[context], np.zeros(len(ids), np.float64)
        order = np.argsort(size, kind="stable")  # windows of about one length together
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            place = np.arange(size[own].max())
            inside = place < size[own, None]
            at = np.where(inside, first[own, None] + place, 0)
            counts = inside & (place >= skip[own, None])
            places = at[counts]
            starts, _, _, _, z = self._decisions(self._told(rows[at])[counts], ids[places])
            lost = np.log(1 + np.exp(-np.abs(z)))
            lost -= np.minimum(z, 0)
            scores[places] = -np.add.reduceat(lost, starts, dtype=np.float64)
        total = np.concatenate([[0.0], np.cumsum(scores)])
        return (total[begins[1:]] - total[begins[:-1]]) / np.log(10)

    def gradients(self, pieces: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss in nats and its gradient, of pieces: rows of ids, each to be told from those before it, -1 as padding."""
        e, p, wq, wk, wv, wo, w1, b1, w2, un, bn = self.params
        counts = pieces[:, 1:] >= 0
        rows = self.row[np.maximum(pieces[:, :-1], 0)]
        x, q, k, v, a, size, m, y, u, h = self._forward(rows)
        a /= size
        own = h[counts]
        starts, owner, node, sign, z = self._decisions(own, pieces[:, 1:][counts])
        n, scale, length = max(1, len(own)), np.float32(WIDTH**-0.5), rows.shape[1]
        back = (-sign / (1 + np.exp(np.clip(z, -30, 30))) / n).astype(x.dtype)
        loss = float((np.log1p(np.exp(-np.abs(z))) - np.minimum(z, 0)).sum()) / n
        node = np.minimum(node, len(bn) - 1).astype(np.uint16)  # short numbers are sorted by their digits
        g_un, g_bn = np.zeros_like(un), np.bincount(node, weights=back, minlength=len(bn)).astype(x.dtype)
        _add(g_un, node, own.take(owner, 0) * back[:, None])
        g_un[-1], g_bn[-1] = 0, 0
        g_h = np.zeros_like(h)
        g_h[counts] = np.add.reduceat(un.take(node, 0) * back[:, None], starts, axis=0) if len(own) else 0
        flat = lambda t: t.reshape(-1, t.shape[-1])
        g_w2 = flat(u).T @ flat(g_h)
        g_u = _dot(g_h, w2.T) * (u > 0)
        g_w1, g_b1 = flat(y).T @ flat(g_u), flat(g_u).sum(0)
        g_y = g_h + _dot(g_u, w1.T)
        g_wo, g_m = flat(m).T @ flat(g_y), _dot(g_y, wo.T)
        g_a, g_v = g_m @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ g_m
        g_s = a * (g_a - (g_a * a).sum(-1, keepdims=True))
        g_q, g_k = g_s @ k, g_s.transpose(0, 2, 1) @ q
        g_wq, g_wk, g_wv = scale * (flat(x).T @ flat(g_q)), flat(x).T @ flat(g_k), flat(x).T @ flat(g_v)
        g_x = g_y + scale * _dot(g_q, wq.T) + _dot(g_k, wk.T) + _dot(g_v, wv.T)
        g_e, g_p = np.zeros_like(e), np.zeros_like(p)
        _add(g_e, rows.ravel().astype(np.uint16), flat(g_x))
        g_p[:length] = g_x.sum(0)
        return loss, [g_e, g_p, g_wq, g_wk, g_wv, g_wo, g_w1, g_b1, g_w2, g_un, g_bn]

    def train(self, pieces: np.ndarray, rate: float = RATE) -> None:
        """Adam steps over ``pieces`` in their order, BATCH at a time."""
        first, second = [np.zeros_like(x) for x in self.params], [np.zeros_like(x) for x in self.params]
        for step, i in enumerate(range(0, len(pieces), BATCH), 1):
            _, grads = self.gradients(pieces[i : i + BATCH])
            for x, g, m, v in zip(self.params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def _dot(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """t @ w as one product, not one a window."""
    return (t.reshape(-1, t.shape[-1]) @ w).reshape(*t.shape[:-1], w.shape[1])


def _add(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, the rows of one place summed."""
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[cuts]] += np.add.reduceat(rows.take(order, 0), cuts, axis=0)
