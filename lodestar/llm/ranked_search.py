"""Ranked lexical search, term at a time over short lists and document at a time over long ones (operator 11).

``index`` writes each document's terms and their counts to the shared folder once. A search joins them with the terms that
are asked for, which gives postings; counts by term give the weights, and a posting carries its part of the score. Documents
are dealt to shards of about SHARD, queries to chunks of CHUNK; in each shard every query of a chunk is solved by itself:

- Lists that hold at most one in SHORT of the shard's documents are short. They are summed term by term into accumulators,
  in document order, which from then on are one more list with its bounds.
- That list and the long ones have a bound for every BLOCK documents. Going on in document order, blocks whose bounds' sum
  can't reach the k-th best score so far are skipped in all lists; the others are scored exactly.

The shards' best k a query are merged by a window, which keeps k rows a task before the shuffle.

All scores are integers, so they do not depend on any order. Edge cases: a null or empty text has no terms, is in no list and
does not count; a null doc_id ranks behind its equals; repeated rows are documents of their own; rows of one item_id are one
query, a null item_id none; queries without a term that some document holds give no rows; empty tables give none; other
columns are ignored. A term in every document may weigh 0 and then adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, stored, text_batches

#: What stands between terms.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD, CHUNK, SHORT, BLOCK, AT_ONCE = 8_192, 4_096, 16, 128, 8


def index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, key, n, terms, tfs) of every row of ``docs``: its different terms, how often each occurs, and n in all."""
    text_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = b.column("text"), b.num_rows
            if not n:
                continue
            if texts.offset:  # ascii_lower reads a slice's offsets wrongly
                texts = texts.take(pa.array(np.arange(n)))
            lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _BETWEEN)
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            none = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()  # at the ends of texts
            owner, code = owner[code != none], code[code != none]
            width = max(1, len(coded.dictionary))
            pairs, times = np.unique(owner * width + code, return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * width).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(pairs % width)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column(key), pa.array(np.bincount(owner, minlength=n)), terms, pa.ListArray.from_arrays(offsets, pa.array(times))], names=["row", key, "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), key, "text")
    return stored(rows.mapInArrow(run, f"row long, {key} {kind}, n long, terms array<string>, tfs array<long>"))


def _best(query: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best, equals by number, of lists (ascending documents, parts of the score)."""
    short = [x for x in query if len(x[0]) * SHORT <= docs]
    lists = [x for x in query if len(x[0]) * SHORT > docs]
    if short:
        at, where = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
        sums = np.zeros(len(at), np.int64)
        np.add.at(sums, where, np.concatenate([x[1] for x in short]))
        lists.append((at, sums))
    blocks = -(-docs // BLOCK)
    bounds, cuts = np.zeros(blocks, np.int64), []
    for at, part in lists:
        cut = np.searchsorted(at, np.arange(blocks + 1) * BLOCK)
        full = np.flatnonzero(cut[1:] > cut[:-1])
        bounds[full] += np.maximum.reduceat(part, cut[full])
        cuts.append(cut)
    best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = 1
    if short and len(sums) >= k:  # the accumulators alone reach this
        least = max(1, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
    i = 0
    while i < blocks:
        ahead = np.flatnonzero(bounds[i:] >= least)
        if not len(ahead):
            break
        i += int(ahead[0])  # all lists skip to this block
        end = min(blocks, i + AT_ONCE)
        there = np.zeros((end - i) * BLOCK, np.int64)
        for (at, part), cut in zip(lists, cuts):
            own = slice(cut[i], cut[end])
            there[at[own] - i * BLOCK] += part[own]
        hit = np.flatnonzero(there >= least)
        if len(hit):
            best, score = np.concatenate([best, hit + i * BLOCK]), np.concatenate([score, there[hit]])
            order = np.lexsort((best, -score))[:k]
            best, score = best[order], score[order]
            if len(score) == k:
                least = max(least, int(score[-1]) + 1)  # later documents lose ties
        i = end
    return best, score


def search(found: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(item_id, rank, key, score) for queries(item_id, text) on what ``index`` has written."""
    total, words = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = index(queries.where(F.col("item_id").isNotNull()), "item_id").select("item_id", F.explode("terms").alias("term")).distinct()
    numbers = stored(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")))
    each = found.select("row", key, "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", key, "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    postings = stored(each.join(numbers, "term").select("tid", "row", key, "n", "tf"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * total + 2)) / (2 * F.col("df") + 1).cast("double")))
    # written, so that Spark knows its size: broadcast while it is small, and beyond that a join whose hot terms can be split
    weights = stored(postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", weight.alias("w")).where("w > 0"))
    size = F.expr(f"100 - 90 + (90 * n * {total}L) div {max(1, words)}L")
    part = F.col("w") * F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)")
    shards = max(1, -(-total // SHARD))
    items = stored(asked.join(numbers, "term").select("item_id", "tid"))
    chunks = max(1, -(-items.select("item_id").distinct().count() // CHUNK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    terms = items.select(deal("item_id", chunks).alias("chunk"), "tid").distinct()
    scored = postings.withColumn("m", size).join(weights, "tid").select(deal("row", shards).alias("shard"), "tid", "row", F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), part.alias("part"))
    data = scored.join(terms, "tid").select("shard", "chunk", "tid", "row", "id", "part")  # to each chunk that asks for the term
    wanted = items.select(deal("item_id", chunks).alias("chunk"), "item_id", "tid").select(span(shards).alias("shard"), "chunk", "item_id", "tid")
    kind = dict(queries.dtypes)["item_id"]

    def solve(data: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(wanted):
            nth = data[["id", "row"]].drop_duplicates("row").sort_values(["id", "row"])  # documents in the order of ties
            ids, rows = nth["id"].to_numpy(), nth["row"].to_numpy()
            place = pd.Index(rows).get_indexer(data["row"])
            order = np.lexsort((place, data["tid"].to_numpy()))
            tid, place, parts = data["tid"].to_numpy()[order], place[order], data["part"].to_numpy()[order]
            begins = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]]))
            lists = {t: (place[a:b], parts[a:b]) for t, a, b in zip(tid[begins].tolist(), begins, [*begins[1:], len(tid)])}
            for item, own in wanted.groupby("item_id", sort=False)["tid"]:
                query = [lists[t] for t in own.tolist() if t in lists]
                if query:
                    best, score = _best(query, len(rows), k)
                    out += [(item, rows[x], ids[x], s) for x, s in zip(best, score)]
        return pd.DataFrame(out, columns=["item_id", "row", "id", "score"])

    keys = ["shard", "chunk"]
    near = data.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(solve, f"item_id {kind}, row long, id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "id", "row")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", F.nullif("id", F.lit(NO_ID)).alias(key), "score")
