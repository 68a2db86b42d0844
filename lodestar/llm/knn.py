"""Exact top-k search by a Voronoi kNN join (operator 6).

Vectors are quantised to floor(256 * x). Largest inner product becomes nearest neighbour by one more coordinate
sqrt(M^2 - |c|^2) on the data side, M being the largest norm. PIVOTS data vectors (those with the smallest hash of
their id) cut the space in cells. One pass gives each row its cell and distance to the pivot; a small summary per
cell (rows, and its k + 1 smallest distances) bounds, per query cell, how far the k-th neighbour can be; by the
triangle inequality a data row is sent only to the query cells whose bound it can beat, once for each group of
neighbouring cells that together hold about CHUNK queries. Groups are solved locally by
integer products, in blocks: rows of a cell are dealt over blocks of about BLOCK rows and its queries over chunks of
CHUNK, so neither a common vector nor a large cell lands in one task, and the blocks' best k are merged by a window.

The driver holds PIVOTS pivots and PIVOTS x (k + 1) distances, both fixed. Where vectors have no cluster structure
the bounds prune little and the join nears queries x rows, in blocks.

Edge cases: vectors that are null, or hold null, NaN or infinite components, or whose length differs from the most
common one of the pivots, take no part; ties go to the smaller vec_id; a null vec_id takes no part; rows that
share an id are queries and candidates of their own, told apart by a row number that is written once; fewer than k candidates give all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PIVOTS, BLOCK, CHUNK = 64, 8_192, 4_096


def _quantised(col: str) -> Column:
    return F.transform(F.col(col), lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def _usable(col: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~F.exists(F.col(col), bad)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def voronoi_topk(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows other than the query's own with the largest inner product."""
    rows = vectors.where(F.col("vec_id").isNotNull() & _usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), _quantised("embedding").alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row")
    )
    chosen = rows.orderBy(F.xxhash64("vec_id"), F.xxhash64("v")).limit(pivots).select("v").collect()  # at most ``pivots`` rows
    width = max((len(r.v) for r in chosen), key=[len(r.v) for r in chosen].count, default=0)
    rows = rows.where(F.size("v") == width)
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    top = rows.agg(F.max(norm2)).first()[0] or 0
    points = np.array([r.v for r in chosen if len(r.v) == width], dtype=np.float64).reshape(-1, max(width, 1))
    points = np.hstack([points, np.sqrt(np.maximum(top - (points**2).sum(1), 0))[:, None]])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Both roles of a row: as data with the lifted coordinate, as a query with zero there."""
        for b in batches:
            if not len(b):
                continue
            v = _matrix(b["v"])
            size = (v**2).sum(1)
            out = {"row": b["row"], "vec_id": b["vec_id"], "v": b["v"], "q": b["q"]}
            for role, lift in (("s", np.sqrt(np.maximum(top - size, 0))), ("r", np.zeros(len(v)))):
                x = np.hstack([v, lift[:, None]])
                d2 = (x**2).sum(1)[:, None] + (points**2).sum(1) - 2 * x @ points.T
                cell = d2.argmin(1)
                out[f"{role}_cell"], out[f"{role}_dist"] = cell, np.sqrt(np.maximum(d2[np.arange(len(x)), cell], 0))
            yield pd.DataFrame(out)

    kept = cut(rows.mapInPandas(placed, "row long, vec_id long, v array<long>, q boolean, s_cell int, s_dist double, r_cell int, r_dist double"))

    nearest = Window.partitionBy("s_cell").orderBy("s_dist")
    summary = kept.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).select("s_cell", "s_dist").collect()  # pivots x (k + 1)
    spread = {r.r_cell: (r.u, r.n) for r in kept.where("q").groupBy("r_cell").agg(F.max("r_dist").alias("u"), F.count(F.lit(1)).alias("n")).collect()}  # pivots rows
    apart = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2)) if len(points) else np.zeros((0, 0))
    slack, want, group = 1e-6 * (1 + float(top) ** 0.5), {}, 0
    held, rest, at = 0, set(spread), None
    while rest:  # neighbouring query cells share a group of about CHUNK queries, so that data is sent once for all
        at = min(rest, key=lambda c: (0.0 if at is None else apart[at, c], c))
        rest.discard(at)
        u, n = spread[at]
        if held and held + n > CHUNK:
            group, held = group + 1, 0
        held += n
        upper = sorted(u + apart[at, s.s_cell] + s.s_dist for s in summary)[: k + 1]
        bound = upper[k] if len(upper) > k else float("inf")  # k + 1: one may be the query itself
        for other in range(len(points)):
            low = max(0.0, apart[at, other] - u - bound - slack)  # nearer to its pivot than this: out of reach
            high = apart[at, other] + u + bound + slack
            old = want.get((other, group), (low, high))
            want[other, group] = min(old[0], low), max(old[1], high)
        spread[at] = (u, n, group)
    spark = vectors.sparkSession
    grouped = spark.createDataFrame([(int(c), int(x[2])) for c, x in spread.items()], "r_cell int, cell int")  # at most ``pivots`` rows
    reached = spark.createDataFrame([(int(o), int(g), float(lo), float(hi)) for (o, g), (lo, hi) in want.items()], "s_cell int, cell int, low double, high double")  # at most pivots^2 rows
    queries: dict[int, int] = {}
    for _, n, g in spread.values():
        queries[g] = queries.get(g, 0) + n
    sent = kept.join(F.broadcast(reached), "s_cell").where("s_dist between low and high")
    sizes = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # pivots rows
    cells = spark.createDataFrame([(c, max(1, -(-n // BLOCK)), max(1, -(-queries[c] // CHUNK))) for c, n in sizes.items()], "cell int, blocks int, chunks int")
    deal = lambda i, n: F.pmod(F.xxhash64(i), n).cast("int")
    data = sent.select("cell", "row", "vec_id", "v").join(F.broadcast(cells), "cell").select("cell", deal("row", F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "row", "vec_id", "v")
    asked = kept.where("q").join(F.broadcast(grouped), "r_cell").select("cell", F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("w")).join(F.broadcast(cells), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), deal("query_row", F.col("chunks")).alias("chunk"), "query_row", "query_id", "w")

    def solve(asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "vec_id", "row", "score"]
        empty = pd.DataFrame({n: [] for n in names}).astype("int64")
        if not len(asked) or not len(data):
            return empty
        data = data.sort_values(["vec_id", "row"])
        ids, rows, v, out = data["vec_id"].to_numpy(), data["row"].to_numpy(), _matrix(data["v"]), []
        exact = float(np.abs(v).max(initial=0)) * float(max(np.abs(x).max(initial=0) for x in asked["w"])) * v.shape[1] < 2**52
        for i in range(0, len(asked), 256):
            part = asked.iloc[i : i + 256]
            own, asker, w = part["query_row"].to_numpy(), part["query_id"].to_numpy(), _matrix(part["w"])
            score = (w @ v.T).astype(np.int64) if exact else w.astype(np.int64) @ v.astype(np.int64).T
            score[own[:, None] == rows[None, :]] = np.iinfo(np.int64).min
            n = min(k, len(ids))
            least = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
            for j in range(len(own)):
                near = np.flatnonzero(score[j] >= least[j])  # ascending ids
                near = near[np.argsort(-score[j][near], kind="stable")][:n]
                out += [(own[j], asker[j], ids[x], rows[x], score[j, x]) for x in near if score[j, x] > np.iinfo(np.int64).min]
        return pd.DataFrame(out, columns=names) if out else empty

    keys = ["cell", "block", "chunk"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_row long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
