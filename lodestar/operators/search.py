"""Retrieval for tables of queries: full text, vectors, rank fusion, re-ranking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import query_terms, terms, unit
from lodestar.operators.graph import cut, drop

K1, B, RRF_K = 1.2, 0.75, 60


def top(hits: DataFrame, k: int, by: str = "qid", score: str = "score", also: tuple[str, ...] = ()) -> DataFrame:
    """The k best hits a query, ranked from 0; ties go to the smaller id."""
    w = Window.partitionBy(by, *also).orderBy(F.desc(score), "id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 12, fuzzy: bool = True) -> DataFrame:
    """(qid, id, score, rank) of docs(id, text) for queries(qid, text): Okapi BM25 over an OR of the query's terms.

    With ``fuzzy`` a term of six letters or more also matches terms one edit away, at a weight less by the share of its
    letters that differs; of the forms that a document has, the best counts. Only occurrences of terms that some query
    asks for leave the scan; a document is its term counts from then on. Postings are dealt by (term, id), so a common
    term is spread; what joins them is one row a term and query.
    """
    asked = queries.select("qid", F.explode(query_terms(F.col("text"))).alias("term"))
    words = docs.select("id", terms(F.col("text")).alias("t"))
    sizes = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean")).first()  # two numbers
    forms = asked.select("term").distinct().select("term", F.col("term").alias("match"), F.lit(1.0).alias("boost"))
    if fuzzy:
        vocabulary = words.select(F.explode("t").alias("term")).where(F.length("term") >= 5).distinct()
        near = fuzzy_terms(vocabulary, asked).where("term <> match")
        forms = cut(forms.unionByName(near.select("term", "match", (1.0 - 1.0 / F.least(F.length("term"), F.length("match"))).alias("boost"))))
    wanted = forms.select("match").distinct()
    postings = words.select("id", F.size("t").alias("len"), F.explode("t").alias("match")).join(wanted, "match").groupBy("match", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("match").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (sizes.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (sizes.mean or 1.0)))
    weights = postings.join(df, "match").select("match", "id", weight.alias("w")).join(forms, "match").select("term", "id", (F.col("w") * F.col("boost")).alias("w"))
    best = weights.groupBy("term", "id").agg(F.max("w").alias("w")) if fuzzy else weights.select("term", "id", "w")
    scored = asked.join(best, "term").groupBy("qid", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top(scored, k)


#: Postings in a block of a stored index, and postings of a term that are ordered in one task.
POSTINGS, ORDERED = 128, 1 << 20


def text_index(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of an inverted index of docs(id, text), to be published: ``totals`` (one row: n, mean), ``vocabulary`` (term,
    df) and ``postings`` (term, block, bound, posted), in blocks of falling impact.

    A posting's impact is its BM25 weight without the idf; a block's bound is the largest in it. A term in very many
    documents is dealt over several runs of blocks by document, so no task orders more than about ORDERED postings.
    """
    words = docs.select("id", terms(F.col("text")).alias("t"))
    totals = cut(words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("mean")))
    mean = totals.first().mean or 1.0  # one number
    each = cut(words.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf")))
    vocabulary = cut(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    run = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / ORDERED).cast("long")), F.lit(0)).cast("int")
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    common = cut(vocabulary.where(F.col("df") > ORDERED))  # at most one term in ORDERED postings; all others have one run
    placed = each.join(F.broadcast(common), "term", "left").select("term", run.alias("run"), "id", impact.alias("impact"))
    nth = F.row_number().over(Window.partitionBy("term", "run").orderBy(F.desc("impact"), "id")) - 1
    # blocks of a run are grouped where the run is ordered, so postings are shuffled once
    blocks = placed.withColumn("block", F.floor(nth / POSTINGS).cast("long") + (F.col("run").cast("long") * 2**32)).groupBy("term", "run", "block")
    postings = cut(blocks.agg(F.max("impact").alias("bound"), F.array_sort(F.collect_list(F.struct("id", "impact"))).alias("posted")).drop("run"))  # POSTINGS at most
    drop(each, common)
    return {"totals": totals, "vocabulary": vocabulary, "postings": postings}


def bm25_indexed(index: dict[str, DataFrame], queries: DataFrame, k: int = 12, fuzzy: bool = True) -> DataFrame:
    """What ``bm25`` gives, from a stored ``text_index``; no text is read.

    The first block of each list gives every query k scores that are reached at least. A block is read only if its bound,
    with the largest part of each of the query's other terms, can reach the k-th of them. All blocks that a document of the
    result is in can, so results are exact.
    """
    n = index["totals"].first().n
    asked = cut(queries.select("qid", F.explode(query_terms(F.col("text"))).alias("term")))
    forms = asked.select("term").distinct().select("term", F.col("term").alias("match"), F.lit(1.0).alias("boost"))
    if fuzzy:
        near = fuzzy_terms(index["vocabulary"].where(F.length("term") >= 5).select("term"), asked).where("term <> match")
        forms = forms.unionByName(near.select("term", "match", (1.0 - 1.0 / F.least(F.length("term"), F.length("match"))).alias("boost")))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut(forms.join(index["vocabulary"].withColumnRenamed("term", "match"), "match").select("term", "match", (F.col("boost") * idf).alias("w")))
    bounds = cut(index["postings"].select(F.col("term").alias("match"), "block", "bound").join(weights, "match").select("term", "match", "w", "block", (F.col("w") * F.col("bound")).alias("most")))

    def scored(blocks: DataFrame) -> DataFrame:
        """(qid, id, score) by blocks(qid, term, match, w, block); of the forms of a term the best counts."""
        posted = index["postings"].select(F.col("term").alias("match"), "block", "posted")
        parts = blocks.join(posted, ["match", "block"]).select("qid", "term", "w", F.explode("posted").alias("p")).select("qid", "term", "p.id", (F.col("w") * F.col("p.impact")).alias("x"))
        return parts.groupBy("qid", "term", "id").agg(F.max("x").alias("x")).groupBy("qid", "id").agg(F.round(F.sum("x"), 6).alias("score"))

    wanted = asked.join(bounds, "term")
    first = top(scored(wanted.where(F.col("block") % 2**32 == 0)), k)
    reached = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("reached"))
    largest = asked.join(bounds.groupBy("term").agg(F.max("most").alias("largest")), "term")
    all_terms = largest.groupBy("qid").agg(F.sum("largest").alias("all"))
    able = wanted.join(largest, ["qid", "term"]).join(all_terms, "qid").join(reached, "qid", "left")
    kept = able.where(F.col("most") + F.col("all") - F.col("largest") >= F.coalesce("reached", F.lit(0.0)) - 1e-5)
    return top(scored(kept.select("qid", "term", "match", "w", "block")), k)


def fuzzy_terms(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, match): vocabulary terms within one edit or one swap of neighbouring letters of alphabetic terms of 6 or more.

    Both sides write every form with one letter left out; terms one edit apart share such a form, so this is an
    equality join of length + 1 rows a term, verified after.
    """
    a = asked.where(F.col("term").rlike(r"^\p{L}{6,}$")).select("term").distinct()
    forms = lambda df, c: df.select(c, F.explode(F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))))).alias("form"))
    v = vocabulary.select(F.col("term").alias("match")).distinct()
    pairs = forms(a, "term").join(forms(v, "match"), "form").select("term", "match").distinct()
    swapped = F.exists(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.concat(F.substring(F.col("term"), F.lit(1), i - 1), F.substring(F.col("term"), i + 1, F.lit(1)), F.substring(F.col("term"), i, F.lit(1)), F.substring(F.col("term"), i + 2, F.length("term"))) == F.col("match"))
    return pairs.where((F.levenshtein("term", "match") <= 1) | swapped)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors in a block of the top-k search, and queries compared with them at a time.
TOPK_BLOCK, TOPK_QUERIES = 16_384, 1_024


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 12, floor: float | None = None) -> DataFrame:
    """(qid, id, score, rank) by cosine of unit vectors: vectors(id, embedding), queries(qid, embedding).

    The stated queries meet all vectors in blocks of about TOPK_BLOCK: both sides are keyed by block, the queries being
    repeated in each, so no side is broadcast. A block is one product of matrices, cut to its best k a query before
    anything is merged. Nulls take no part. ``floor`` is on (1 + cosine) / 2.
    """
    data = vectors.where("id is not null and embedding is not null")
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((data, TOPK_BLOCK), (queries, TOPK_QUERIES)))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    data = data.select("id", "embedding", at("id", blocks).alias("block")).select("*", span(parts).alias("part"))
    asked = queries.where("embedding is not null").select("qid", F.col("embedding").alias("q"), at("qid", parts).alias("part")).select("*", span(blocks).alias("block"))
    # a query's key can be a struct: it travels as a number, written once, and is joined back
    ids = cut(queries.select("qid").distinct().select("qid", F.monotonically_increasing_id().alias("key")))
    keyed = asked.join(ids, "qid").select("key", "q", "part", "block")
    kind = vectors.schema["id"].dataType.simpleString()

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"key": [], "id": [], "score": []})
        x = x.sort_values("id")
        s = np.round(np.stack(y["q"].to_numpy()).astype(np.float64) @ np.stack(x["embedding"].to_numpy()).astype(np.float64).T, 6)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equals by id
        found = pd.DataFrame({"key": np.repeat(y["key"].to_numpy(), order.shape[1]), "id": x["id"].to_numpy()[order.ravel()], "score": np.take_along_axis(s, order, 1).ravel()})
        return found if floor is None else found[(1 + found["score"]) / 2 >= floor]

    found = data.groupBy("block", "part").cogroup(keyed.groupBy("block", "part")).applyInPandas(best, f"key long, id {kind}, score double")
    return top(top(found, k, by="key").drop("rank").join(ids, "key").drop("key"), k)


def rrf(hits: DataFrame) -> DataFrame:
    """(qid, id, score) from ranked lists hits(qid, list_id, id, rank): sum of 1 / (60 + rank + 1)."""
    return hits.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (RRF_K + 1 + F.col("rank"))), 9).alias("score"))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores divided by the query's largest, unless that is not positive."""
    most = F.max("score").over(Window.partitionBy("qid"))
    return scores.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(F.col("score")))


def rerank(passages: DataFrame, ppr: DataFrame, mentions: DataFrame, k: int = 8) -> DataFrame:
    """0.6 x normalised fusion score + 0.4 x normalised PageRank of the entities a passage mentions."""
    walked = mentions.join(ppr.select("qid", F.col("id").alias("entity_id"), "rank"), "entity_id").groupBy("qid", F.col("chunk_id").alias("id")).agg(F.sum("rank").alias("score"))
    both = passages.select("qid", "id").join(walked, ["qid", "id"], "left").select("qid", "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    mixed = normalised(passages).select("qid", "id", (0.6 * F.col("score")).alias("score")).unionByName(normalised(both).select("qid", "id", (0.4 * F.col("score")).alias("score")))
    return top(mixed.groupBy("qid", "id").agg(F.round(F.sum("score"), 6).alias("score")), k)


def name_search(names: DataFrame, asked: DataFrame, k: int = 12) -> DataFrame:
    """(qid, id, score, rank) of names(id, label, pagerank) for asked(qid, q): 2 where a label begins with q, 1 where one
    holds it elsewhere, plus 50 times the pagerank. An entity has a row for its name and one for each alias, in normal form.

    Every label is written once for each place where some q could begin, keyed by the three letters there (fewer where a
    q is shorter), so that holding is an equality join, verified after.
    """
    asked = asked.where(F.length("q") > 0)
    key = lambda c, at: F.substring(c, at, F.lit(3))
    short, long = asked.where(F.length("q") < 3), asked.where(F.length("q") >= 3)
    starts = names.where(F.length("label") > 0).select("id", "label", "pagerank", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at"))
    met = starts.withColumn("_k", key(F.col("label"), F.col("at"))).where(F.length("_k") == 3).join(long.withColumn("_k", key(F.col("q"), F.lit(1))), "_k")
    for n in (1, 2):
        few = starts.withColumn("_k", F.substring("label", F.col("at"), F.lit(n))).where(F.length("_k") == n).join(short.where(F.length("q") == n).withColumn("_k", F.col("q")), "_k")
        met = met.unionByName(few)
    held = met.where(F.substring("label", F.col("at"), F.length("q")) == F.col("q"))
    return top(held.groupBy("qid", "id").agg(F.round(F.max(F.when(F.col("at") == 1, 2.0).otherwise(1.0)) + 50 * F.max("pagerank"), 6).alias("score")), k)


NEAR_BLOCK = 4096


def near_pairs(vectors: DataFrame, least: float = 0.95, pivots: int = 3) -> DataFrame:
    """(a, b, score), a < b: all pairs of vectors(id, embedding) with a cosine of ``least`` or more.

    Two such vectors are at most acos(least) apart, and so are their angles to any third: a vector's cell is its angles to
    a few pivots in steps of that width, and only the 3^pivots cells around it can hold a partner. A cell of many rows is
    compared in blocks of about NEAR_BLOCK. Where all angles are alike the cells prune little and the join nears all
    pairs, in blocks. Null vectors, those of length zero and those of another length than the first pivot take no part.
    """
    rows = vectors.where("embedding is not null").select("id", unit(F.col("embedding")).alias("v")).where(F.exists("v", lambda x: x != 0))
    picked = [r.v for r in rows.orderBy(F.xxhash64("id")).limit(pivots).collect()]  # a few vectors
    none = rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score")).limit(0)
    if not picked:
        return none
    step, width = math.acos(min(1.0, least)) + 1e-9, len(picked[0])
    picked = [p for p in picked if len(p) == width]
    cell = F.array(*[F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("v"), F.array(*map(F.lit, p)))))) / step).cast("int") for p in picked])
    own = cut(rows.where(F.size("v") == width).withColumn("cell", cell))
    sizes = own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / NEAR_BLOCK).cast("int").alias("blocks"))
    around = own.withColumn("home", F.col("cell"))
    for i in range(len(picked)):
        parts = [F.get("cell", F.lit(j)) + (F.col("_d") if j == i else F.lit(0)) for j in range(len(picked))]
        around = around.withColumn("_d", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("cell", F.array(*parts)).drop("_d")
    there = sizes.select(F.col("cell").alias("home"), F.col("blocks").alias("others"))
    met = sizes.select("cell").join(around.select("cell", "home").distinct(), "cell").join(sizes, "cell").join(there, "home")  # cells, not rows
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    left = own.join(met, "cell").select("cell", "home", at(F.col("blocks")).alias("i"), F.explode(span(F.col("others"))).alias("j"), "id", "v")
    right = own.withColumnRenamed("cell", "home").join(met, "home").select("cell", "home", F.explode(span(F.col("blocks"))).alias("i"), at(F.col("others")).alias("j"), F.col("id").alias("other"), F.col("v").alias("w"))
    kind = vectors.schema["id"].dataType.simpleString()

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        s = np.stack(x["v"].to_numpy()) @ np.stack(y["w"].to_numpy()).T
        i, j = np.nonzero(s >= least - 1e-12)
        found = pd.DataFrame({"a": x["id"].to_numpy()[i], "b": y["other"].to_numpy()[j], "score": s[i, j]})
        return found[found["a"] < found["b"]]

    keys = ["cell", "home", "i", "j"]
    right = right.toDF(*[f"_{c}" for c in keys], "other", "w")
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInPandas(compare, f"a {kind}, b {kind}, score double")
