"""Mixture-controlled packing by deficit round-robin (operator 2).

Texts become token ids once; the ids are kept in the shared folder. Each source is a queue: its documents in the order
they were read, and a token's place in its queue is known from counts by input part and source alone. A schedule says
how far every queue is read when x tokens are packed in all: at the ``targets`` (token shares by source; what is left
goes to the other sources by their size), or by default at the corpus shares, and at the targets of what is left once
a source has run out. It cuts every queue in lanes of about LANE_TOKENS tokens in all, so each lane holds each source
at its target share to the token, whatever documents are long or hot, and documents are cut at lane edges. The part of
a token by which a lane's edge was rounded is carried into the lane behind.

Within a lane, for each window every queue's deficit grows by its share of the window, the queue gives the whole
tokens of its deficit, and what it could not give or round is carried to the next window; missing tokens come from the
queues with the largest deficits. Documents are cut freely where a window is full, so windows hold no padding; the rest
of a lane goes to sequences of powers of two, which hold none either. In a lane where a source runs out, windows follow
that lane's own mean.

Shuffled are the ids once (two bytes a token where the vocabulary allows) and small counts; a lane's size is fixed. The
table of places has one row for each input part and source: Spark broadcasts it while it is small, and else joins by a
shuffle.

Edge cases: a null or empty text is its end token alone; a null source is a source of its own, other than the empty
one; repeated rows are packed as often as they occur; a null doc_id is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_batches

WINDOW, END, LANE_TOKENS = 4096, 2, 1 << 20
#: Words remembered with their ids in a Python worker, then the memo starts anew; bytes of text split at a time.
MEMO, SPLIT_BYTES = 1_000_000, 1 << 23
_MARKS = ".,;:!?*&%$#"


class Words:
    """Ids of texts by the tokenizers library. Text between ASCII white space encodes on its own; that is memoised."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{id_width(self.tokenizer)}")
        self.memo: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Memoise the ids of new words, the plain ones many in one text: each is one run of ids up to a word's end."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() and max(w) < "Ā" else other).append(w)
        for i in range(0, len(plain), 256):
            part = plain[i : i + 256]
            ids = np.array(self._encoded([" ".join(part)])[0], self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                other += part
                continue
            data, size = ids.tobytes(), ids.itemsize
            at = 0
            for w, stop in zip(part, (stops * size).tolist()):
                self.memo[w] = data[at:stop]
                at = stop
        for i in range(0, len(other), 256):
            part = other[i : i + 256]
            self.memo.update(zip(part, [np.array(ids, self.dtype).tobytes() for ids in self._encoded(part)]))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Packed ids of each of these different words."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        found = list(map(memo.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            # marks after a letter or digit are a token of their own: such a word needs its stem's ids and theirs
            stems = {w: s for w in new if w[-1:] in _MARKS and (s := w.rstrip(_MARKS))[-1:].lower()[-1:].isalnum()}
            need = {w for w in new if w not in stems}
            need.update(stems.values())
            need.update(w[len(s) :] for w, s in stems.items())
            self._learn([w for w in need if w not in memo])
            for w, s in stems.items():
                memo[w] = memo[s] + memo[w[len(s) :]]
            found = list(map(memo.get, words))
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end token; where each text's ids begin, and the end)."""
        if texts.offset:  # ascii_lower reads a slice's offsets wrongly
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # the vocabulary is lower case; lowering A-Z first makes fewer words, but special tokens are case-sensitive
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = lists.flatten().dictionary_encode()
        each = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        each.append(np.array([END], self.dtype).tobytes())
        flat = np.frombuffer(b"".join(each), self.dtype)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        words = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(each) - 1)
        n = sizes[words]
        after = np.cumsum(n)
        places = np.arange(int(after[-1]) if len(after) else 0) + np.repeat(begins[words] - (after - n), n)
        return flat[places], np.concatenate([[0], after[ends + np.arange(len(ends))]]).astype(np.int64)


def id_width(tokenizer) -> int:
    """Bytes an id takes."""
    return 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4


_LOADED: dict[str, Words] = {}
_TOKENS = "doc_id long, queue string, n long, ids binary, part int, before long"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, queue (the source), n, ids (packed little-endian), part (of the input) and before (tokens of the same
    queue before it in that part) of every row, without a shuffle."""
    text_batches(docs.sparkSession)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= SPLIT_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Words(path)
        words, part, read = _LOADED[path], TaskContext.get().partitionId(), {}
        for t in together(batches):
            if not t.num_rows:
                continue
            ids, at = words(t["text"].combine_chunks())
            n, before, queues = np.diff(at), np.empty(t.num_rows, np.int64), t["queue"].combine_chunks().dictionary_encode()
            code = queues.indices.to_numpy(zero_copy_only=False)
            for k, q in enumerate(queues.dictionary.to_pylist()):
                own = np.flatnonzero(code == k)
                upto = np.cumsum(n[own]) + read.get(q, 0)
                before[own] = upto - n[own]
                read[q] = int(upto[-1])
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), t.num_rows, [None, pa.py_buffer(at * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [t["doc_id"].combine_chunks(), t["queue"].combine_chunks(), pa.array(n), packed, pa.array(np.full(t.num_rows, part, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "queue", "n", "ids", "part", "before"])

    queue = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text").mapInArrow(run, _TOKENS)


def schedule(totals: Mapping[str, int], targets: Mapping[str, float]) -> dict[str, list[tuple[float, float, float, float]]]:
    """For each queue, stretches (c0, c1, x0, x1): it is read evenly from c0 to c1 while the tokens packed in all go
    from x0 to x1. Shares are the targets', among the queues that have not run out."""
    out: dict[str, list[tuple[float, float, float, float]]] = {q: [] for q in totals}
    read, x = dict.fromkeys(totals, 0.0), 0.0
    live = {q for q, n in totals.items() if n}
    while live:
        want = {q: max(0.0, targets.get(q, 0.0)) for q in live}
        if not sum(want.values()):
            want = {q: float(totals[q] - read[q]) for q in live}
        share = {q: w / sum(want.values()) for q, w in want.items() if w}
        step = min((totals[q] - read[q]) / s for q, s in share.items())
        gone = {q for q, s in share.items() if (totals[q] - read[q]) / s <= step * (1 + 1e-12)}
        for q, s in share.items():
            c1 = float(totals[q]) if q in gone else read[q] + s * step
            out[q].append((read[q], c1, x, x + step))
            read[q] = c1
        x, live = x + step, live - gone
    return out


def lane_windows(left: np.ndarray, owed: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """(size, tokens taken from each queue) of each window; left: tokens in each queue; owed: the deficits at first."""
    left, deficit, total = left.astype(np.int64).copy(), owed.astype(np.float64).copy(), int(left.sum())
    share, rest = left / max(total, 1), total % window
    tail = [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]
    for size in [window] * (total // window) + tail:
        deficit += size * share
        take = np.minimum(np.maximum(np.floor(deficit), 0), left).astype(np.int64)
        short = size - int(take.sum())
        for s in np.argsort(-(deficit - take), kind="stable") if short > 0 else np.argsort(deficit - take, kind="stable"):
            if not short:
                break
            move = min(short, int(left[s] - take[s])) if short > 0 else -min(-short, int(take[s]))
            take[s] += move
            short -= move
        deficit -= take
        left -= take
        yield size, take


def pack_lane(pieces: pd.DataFrame, width: int) -> pd.DataFrame:
    """Sequences of one lane. pieces: lane, queue, place (in the queue), owed, doc_id, start, doc_tokens, ids."""
    lane = int(pieces["lane"].iloc[0])
    pieces = pieces.sort_values(["queue", "place"], kind="stable")
    queues, owed = [], []
    for _, own in pieces.groupby("queue", sort=True):
        stream = np.frombuffer(b"".join(own["ids"]), f"<u{width}").astype("<u4")
        sizes = [len(x) // width for x in own["ids"]]
        queues.append((stream.view(np.uint8).data, own["doc_id"].tolist(), own["start"].tolist(), own["doc_tokens"].tolist(), sizes))
        owed.append(own["owed"].iloc[0])
    left = np.array([sum(q[4]) for q in queues])
    at = [[0, 0, 0] for _ in queues]  # in each queue: piece, its tokens before, tokens of the queue before
    out = []
    for number, (_, take) in enumerate(lane_windows(left, np.array(owed))):
        offset = 0
        for (data, ids, starts, tokens, sizes), where, want in zip(queues, at, take.tolist()):
            while want:
                k, inside, before = where
                length = min(want, sizes[k] - inside)
                crc = zlib.crc32(data[4 * before : 4 * (before + length)])
                out.append((ids[k], starts[k] + inside, length, crc, tokens[k], (lane << 32) + number, offset))
                offset, want = offset + length, want - length
                where[:] = [k + 1, 0, before + length] if inside + length == sizes[k] else [k, inside + length, before + length]
    found = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    found["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in found["doc_id"]], dtype="Int64")
    return found


def _placed(counts: DataFrame, targets: Mapping[str | None, float], lanes: int) -> DataFrame:
    """(queue, part, behind, stretches) for counts(queue, part, n): tokens of the queue in the parts before, and the
    stretches (lo, hi, lane, rate) in which tokens lo to hi go to the lanes from ``lane`` on, ``rate`` lanes a token."""
    named = {("0" if s is None else f"1{s}"): w for s, w in targets.items()}
    group = F.when(F.col("queue").isin(*named), F.col("queue")).otherwise("rest") if named else F.lit("rest")
    sizes = counts.groupBy("queue").agg(F.sum("n").alias("size")).withColumn("group", group)
    totals = {r.group: r.size for r in sizes.groupBy("group").agg(F.sum("size").alias("size")).collect()}  # a row for each target
    total = sum(totals.values())
    named.setdefault("rest", max(0.0, 1.0 - sum(named.values())))
    part, whole = lambda g: F.col("size") / F.lit(float(totals[g])), lanes / max(total, 1)
    edge = lambda g, c: (F.col("size") if c >= totals[g] else F.floor(F.lit(c) * part(g))).cast("long")

    def stretch(g, c0, c1, x0, x1):
        lo, hi = edge(g, c0), edge(g, c1)
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(x0 * whole).alias("lane"), (F.lit((x1 - x0) * whole) / F.nullif(hi - lo, F.lit(0))).alias("rate"), F.lit(min(math.ceil(x1 * whole), lanes)).cast("long").alias("to"))

    ends = F.lit(None).cast("array<struct<lo:bigint,hi:bigint,lane:double,rate:double,to:bigint>>")  # at most one stretch a target
    for g, plan in schedule(totals, named).items():
        ends = F.when(F.col("group") == g, F.array(*[stretch(g, *s) for s in plan])).otherwise(ends) if plan else ends
    stretches = sizes.select("queue", F.filter(ends, lambda s: s.lo < s.hi).alias("stretches"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("behind", F.coalesce(F.sum("n").over(before), F.lit(0))).join(stretches, "queue").select("queue", "part", "behind", "stretches")


def pack(docs: DataFrame, path: str, lane_tokens: int = LANE_TOKENS, targets: Mapping[str | None, float] | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``targets``: token shares by source, of 1 in all; sources not named share what is left by their size.
    """
    from tokenizers import Tokenizer

    width = id_width(Tokenizer.from_file(path))
    tokens = stored(tokenised(docs, path))
    counts = stored(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    lanes = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // lane_tokens))
    placed = stored(_placed(counts, targets or {}, lanes))

    first = F.col("behind") + F.col("before")

    def cuts(s):
        """Pieces of a row that lie in a stretch, one for each lane they reach."""
        a, b = F.greatest(first, s.lo), F.least(first + F.col("n"), s.hi)
        at = lambda x: F.floor(s.lane + (x - s.lo) * s.rate)
        begin = lambda i: F.when(i <= s.lane, s.lo).when(i >= s.to, s.hi).otherwise(F.greatest(s.lo, F.least(s.hi, s.lo + F.floor((i - s.lane) / s.rate))))
        # one lane more at either end, for rounding: a piece without tokens goes
        reach = F.sequence(F.greatest(at(a) - 1, F.floor(s.lane)), F.least(at(b - 1) + 1, s.to - 1))
        piece = lambda i: F.struct(i.alias("lane"), F.greatest(a, begin(i)).alias("lo"), F.least(b, begin(i + 1)).alias("hi"), F.when(i > s.lane, (i - s.lane) / s.rate % 1).otherwise(0.0).alias("owed"))
        return F.when(a < b, F.filter(F.transform(reach, piece), lambda p: p.lo < p.hi)).otherwise(F.array().cast("array<struct<lane:bigint,lo:bigint,hi:bigint,owed:double>>"))

    row = tokens.join(placed, ["queue", "part"])
    row = row.select("queue", "doc_id", "n", "ids", first.alias("first"), F.explode(F.flatten(F.transform("stretches", cuts))).alias("p"))
    start, length = F.col("p.lo") - F.col("first"), F.col("p.hi") - F.col("p.lo")
    pieces = row.select(
        "p.lane", "queue", F.col("p.lo").alias("place"), "p.owed", "doc_id", start.alias("start"), F.col("n").alias("doc_tokens"),
        F.substring("ids", (start * width + 1).cast("int"), (length * width).cast("int")).alias("ids"),
    )
    return pieces.groupBy("lane").applyInPandas(
        lambda own: pack_lane(own, width), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
