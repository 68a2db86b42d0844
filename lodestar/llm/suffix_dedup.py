"""Removal of repeated byte strings by suffix arrays over shards (operator 1).

Every byte covered by a LENGTH-byte string that also starts earlier (in a document before, or earlier in the same one)
is removed; strings are judged on the input.

Sharding. Each LENGTH-byte window picks its minimal K-byte piece (an *anchor*, about 2.9 bytes in 100), so two equal
windows pick the same piece at the same place. Anchors whose hash occurs once in the corpus are dropped; only hashes
are shuffled for that. An anchor's *stretch* is the bytes of the windows that pick it. Of anchors with equal hash and
equal stretches only the first needs comparing: the others are repeated over their whole stretches. The first ones,
where a hash has two or more different stretches, are fetched as text and dealt by hash over shards of about SHARD
bytes; a shard's suffix array is made by induced sorting, permuted common prefixes give the groups of equal windows, and
all but the earliest of a group mark their bytes.

A hash with more stretches than HOT is dealt over several shards: its windows are halved by where the anchor lies in
them. The windows of one half share more bytes than the anchor (all that each of them must hold around it), and the hash
of those bytes deals them; equal windows still meet. That goes on, half by half, until no shard is too large; at the end
windows share all their bytes, and equal ones are one stretch.

Texts travel by document to where anchors or marks are; nothing is gathered per group or on the driver.

Edge cases: a null text is empty; texts under LENGTH bytes lose nothing; a null doc_id comes after all others; rows
that share an id count as documents of their own in the order of their text's hash, identical rows as one document;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, stored, text_batches
from .suffix_array import common_prefixes, suffix_array

LENGTH, K, SHARD = 100, 32, 1 << 21
#: Most stretches of one hash in a shard.
HOT = 8192
CHUNK_BITS = 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xFF51AFD7ED558CCD))
_BASE = 0xD6E8FEB86659FD93


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for i in range(min(8, max(n, 0))):
        m = (n - i + 7) // 8
        out[i::8] = np.frombuffer(data[i : i + 8 * m].tobytes(), "<u8")
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    return h ^ (h >> np.uint64(29))


def _hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each position on."""
    n = len(words) - K + 8
    h = words[:n] * _MIX[0]
    for i, at in enumerate(range(8, K, 8)):
        h ^= h >> np.uint64(29 + i)
        h += words[at : n + at]
        h *= _MIX[i % 3]
    return _mixed(h)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2^64, at least n of them."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            each = np.full(2 * n, base, np.uint64)
            each[0] = 1
            _powers[i] = np.multiply.accumulate(each)
    return _powers


def anchors(data: np.ndarray, begins: np.ndarray, stretches: bool = True) -> tuple[np.ndarray, ...]:
    """(place, hash, first window, last window, hash of the stretch) of the pieces that windows pick. ``data``: texts one
    after the other; ``begins``: where each begins, and the end; no window reaches over an end."""
    none = np.empty(0, np.int64)
    sizes = np.maximum(np.diff(begins) - LENGTH + 1, 0)
    valid = np.repeat(begins[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())  # windows by their first byte
    if not len(valid):
        return none, none, none, none, none
    words, found, low, width = _words(data), [], np.uint64((1 << CHUNK_BITS) - 1), LENGTH - K + 1
    for first in range(0, len(data) - LENGTH + 1, (1 << CHUNK_BITS) - LENGTH):
        h = _hashes(words[first : first + (1 << CHUNK_BITS) - 7])
        windows = len(h) - width + 1
        own = valid[np.searchsorted(valid, first) : np.searchsorted(valid, first + windows)]
        if not len(own):
            continue
        # the least hash, and among equal ones the first: the place fills the low bits
        m = -(-len(h) // width) * width
        rank = np.full(m, np.iinfo(np.uint64).max)
        rank[: len(h)] = h & ~low | np.arange(len(h), dtype=np.uint64)
        blocks = rank.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[own - first], ahead[own - first + width - 1])
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[begin] & low).astype(np.int64)
        found.append(np.stack([place + first, h[place].view(np.int64), own[begin], own[np.append(begin[1:], len(own)) - 1]]))
    at, h, lo, hi = np.hstack(found)
    once = np.concatenate([[True], at[1:] != at[:-1]])  # a piece can be picked from two chunks
    at, h, lo, hi = at[once], h[once], lo[once], hi[np.append(np.flatnonzero(once)[1:], len(at)) - 1]
    if not stretches:
        return at, h, lo, hi, none
    power, inverse = _power(len(words) + 1)
    upto = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(_mixed(words * _MIX[1]) * power[: len(words)], out=upto[1:])
    s = (upto[hi + LENGTH - 7] - upto[lo]) * inverse[lo]
    return at, h, lo, hi, _mixed(s + _MIX[2] * ((hi - lo) << 8 | (at - lo)).astype(np.uint64)).view(np.int64)


def _documents(docs: DataFrame) -> DataFrame:
    """_id (never null), _key (0 where ids are unique) and text."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    twice = docs.groupBy(ids.alias("i")).count().where("count > 1").limit(1).count()
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if twice else F.lit(0).cast("long")
    return docs.select(ids.alias("_id"), key.alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text begins, and the end) without a copy."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(anchors(*_bytes(b.column("text")), stretches=False)[1])], ["h"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            data, begins = _bytes(b.column("text"))
            at, h, lo, hi, s = anchors(data, begins)
            doc = np.searchsorted(begins, lo, side="right") - 1
            ids = [pa.array(b.column(c).to_numpy(zero_copy_only=False)[doc]) for c in ("_id", "_key")]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), *ids, pa.array((lo - begins[doc]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array((at - lo).astype(np.int32))], ["h", "s", "_id", "_key", "lo", "n", "o"])


def _fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, key, text, anchored in zip(b["_id"], b["_key"], b["text"], b["anchors"]):
            data = text.encode("utf-8", "replace")
            rows += [(a["h"], i, key, a["lo"], a["n"], a["o"], data[a["lo"] : a["lo"] + a["n"] + LENGTH]) for a in anchored]
        yield pd.DataFrame(rows, columns=["h", "_id", "_key", "lo", "n", "o", "piece"]).assign(r0=0, r1=LENGTH - K)


def _halved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each stretch as two: windows in which the anchor lies r0 to the middle, and beyond, dealt by the bytes that all such
    windows hold."""
    for b in batches:
        rows = []
        for p in b.itertuples(index=False):
            middle = (p.r0 + p.r1) // 2
            for r0, r1 in ((p.r0, middle), (middle + 1, p.r1)):
                first, last = max(0, p.o - r1), min(p.n, p.o - r0)  # windows, from the stretch's begin
                if r0 <= r1 and first <= last:
                    core = p.piece[p.o - r0 : p.o - r1 + LENGTH]
                    own = p.piece[first : last + LENGTH]
                    h, s = (xxhash.xxh3_64_intdigest(x, seed) for x, seed in ((core, r0 << 8 | r1), (own, p.o - first)))
                    rows.append((h - (h >> 63 << 64), s - (s >> 63 << 64), p.doc, p.doc_key, p.lo + first, last - first, p.o - first, own, r0, r1))
        yield pd.DataFrame(rows, columns=["h", "s", "_id", "_key", "lo", "n", "o", "piece", "r0", "r1"])


def _marked(shard: pd.DataFrame) -> pd.DataFrame:
    """Windows of a shard's pieces that start earlier elsewhere: (_id, _key, lo, hi) of their bytes."""
    none = pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("_id", "_key", "lo", "hi")})
    shard = shard.sort_values(["_id", "_key", "lo"], kind="stable")
    pieces = shard["piece"].tolist()
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    t = np.zeros(int(sizes.sum() + len(sizes)) + 1, np.int64)
    joined = np.frombuffer(b"\0".join(pieces), np.uint8)
    t[: len(joined)] = joined.astype(np.int64) + 2
    t[starts + sizes] = 1  # between pieces; the end letter is 0
    sa = suffix_array(t)
    shared = common_prefixes(t, sa, LENGTH)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    own = sa[1:]  # without the end letter
    whole = starts[piece[own]] + sizes[piece[own]] - own >= LENGTH
    own = own[whole]
    if not len(own):
        return none
    # neighbours in the array that both hold whole windows are neighbours still: others share less than LENGTH letters
    first = np.flatnonzero(shared[own] < LENGTH)
    if not len(first) or first[0]:
        first = np.concatenate([[0], first])
    docs = shard[["_id", "_key"]].drop_duplicates()
    number = shard[["_id", "_key"]].merge(docs.assign(n=np.arange(len(docs))), how="left")["n"].to_numpy()
    place = (number[piece[own]].astype(np.int64) << 40) + shard["lo"].to_numpy().astype(np.int64)[piece[own]] + own - starts[piece[own]]
    least = np.minimum.reduceat(place, first)
    group = np.zeros(len(own), np.int64)
    group[first[1:]] = 1
    again = np.unique(place[place > least[np.cumsum(group)]])
    if not len(again):
        return none
    doc, lo = again >> 40, again & ((1 << 40) - 1)
    edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + LENGTH)])
    begin = np.flatnonzero(edge)
    end = np.concatenate([begin[1:] - 1, [len(lo) - 1]])
    ids = docs.iloc[doc[begin]]
    return pd.DataFrame({"_id": ids["_id"].to_numpy(), "_key": ids["_key"].to_numpy(), "lo": lo[begin], "hi": lo[end] + LENGTH})


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text, marks in zip(b["doc_id"], b["text"], b["marks"]):
            data = text.encode("utf-8", "replace")
            keep, spans, at, runs = [], 0, 0, sorted((int(m["lo"]), min(int(m["hi"]), len(data))) for m in (() if marks is None else marks))
            gone, begin, end = 0, None, None
            for lo, hi in [*runs, (len(data) + 1, None)]:
                if end is not None and lo <= end:
                    end = max(end, hi or end)
                    continue
                if end is not None:
                    keep.append(data[at:begin])
                    gone, spans, at = gone + end - begin, spans + 1, end
                begin, end = lo, hi
            left = b"".join([*keep, data[at:]])
            rows.append((doc, len(data), gone, spans, hashlib.sha256(left).hexdigest(), left))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _finished(batches):
        yield b.drop(columns="kept")


_IDENT = ["_id", "_key"]
_PLACE = [*_IDENT, "lo"]


def _classed(kept: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(firsts, spans): of stretches equal in h and s the first, with its columns, and the bytes of all the others."""
    classes = stored(kept.groupBy("h", "s").agg(F.min_by(F.struct(*_PLACE, "n", "o", *more), F.struct(*_PLACE)).alias("first")))
    later = kept.join(classes.select("h", "s", *[F.col(f"first.{c}").alias(f"first{c}") for c in _PLACE]), ["h", "s"])
    later = later.where(~((F.col("_id") == F.col("first_id")) & (F.col("_key") == F.col("first_key")) & (F.col("lo") == F.col("firstlo"))))
    return classes.select("h", "first.*"), later.select(*_IDENT, F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("n") + LENGTH).cast("long").alias("hi"))


def _spans(docs: DataFrame) -> DataFrame:
    """(_id, _key, lo, hi) of repeated bytes in ``docs`` (see ``_documents``); spans may overlap."""
    counts = docs.select("text").mapInArrow(_counted, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(counts.where("n > 1").select("h"))  # written, so that the join is of plain shuffles and a hot hash can be split
    occurrences = docs.select(*_IDENT, "text").mapInArrow(_placed, "h long, s long, _id long, _key long, lo int, n int, o int")
    firsts, gone = _classed(stored(occurrences.join(repeated, "h", "left_semi")))

    several = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    wanted = firsts.join(several, "h").groupBy(*_IDENT).agg(F.collect_list(F.struct("h", "lo", "n", "o")).alias("anchors"))  # of one document
    fetched = "h long, _id long, _key long, lo int, n int, o int, piece binary, r0 int, r1 int"
    pieces = stored(docs.select(*_IDENT, "text").join(wanted, _IDENT).mapInPandas(_fetched, fetched))
    while True:  # seven times at most: then one place of the anchor is left
        hot = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("h")
        if hot.isEmpty():
            break
        hot = stored(hot)
        halves = pieces.join(hot, "h", "left_semi").withColumnsRenamed({"_id": "doc", "_key": "doc_key"}).mapInPandas(_halved, f"s long, {fetched}")
        firsts, more = _classed(stored(halves), "piece", "r0", "r1")
        pieces, gone = stored(pieces.join(hot, "h", "left_anti").unionByName(firsts)), gone.unionByName(more)

    size = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    marks = pieces.select("h", *_IDENT, "lo", "piece").groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInPandas(_marked, "_id long, _key long, lo long, hi long")
    return gone.unionByName(marks)


def _marks(docs: DataFrame) -> DataFrame:
    """doc_id, text and marks of every row."""
    text_batches(docs.sparkSession)
    docs = _documents(docs)
    spans = _spans(docs).groupBy(*_IDENT).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))  # of one document
    return docs.join(spans, _IDENT, "left").select("doc_id", "text", "marks")


_DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay)."""
    return _marks(docs).mapInPandas(_finished, _DIGESTS + ", kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """``suffix_dedup`` without the bytes that stay."""
    return _marks(docs).mapInPandas(_digested, _DIGESTS)
