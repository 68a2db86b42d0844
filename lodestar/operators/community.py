"""Communities of a weighted graph: local moves by modularity gain, levels by contraction, and their cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.graph import WEIGHTS, both_ways, by_number, cut, drop, numbered

#: Node types left out, and the resolution.
LEFT_OUT = ("Person", "Domain", "Language", "Location")
RESOLUTION = 1.1


def weighted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, w), a < b: undirected edges between nodes that take part, weights of parallel types summed."""
    part = nodes.where(~F.col("type").isin(*LEFT_OUT)).select("id")
    weight = F.try_element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("type"))
    flat = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), weight.alias("w")).where("w is not null and a <> b")
    summed = flat.groupBy("a", "b").agg(F.sum("w").alias("w"))
    return summed.join(part, F.col("a") == part.id, "left_semi").join(part, F.col("b") == part.id, "left_semi")


def modularity(pairs: DataFrame, labels: DataFrame, resolution: float = RESOLUTION) -> float:
    """Of labels(id, label) on pairs(a, b, w); pairs with a = b are loops. 0 without edges."""
    both = pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    degrees = both.select(F.explode(F.array(F.struct(F.col("la").alias("l"), "w"), F.struct(F.col("lb").alias("l"), "w"))).alias("s")).groupBy("s.l").agg(F.sum("s.w").alias("k"))
    m, inside = both.agg(F.sum("w"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0))).first()
    if not m:
        return 0.0
    return inside / m - resolution * degrees.agg(F.sum((F.col("k") / (2 * m)) ** 2)).first()[0]


def _moves(pairs: DataFrame, rounds: int, resolution: float, least: float) -> DataFrame:
    """(id, label) of pairs(a, b, w) of numbers: every node looks for the neighbouring community of most gain; to smaller
    labels in even rounds, to larger in odd ones, so that two nodes cannot swap for ever.

    A round sends each node's label along its edges and shuffles them once, by the node that is told. What a node hears of
    its own label is the weight inside communities, so the modularity of labels falls out of the round that follows them.
    """
    loops = pairs.where("a = b")
    arcs = both_ways(pairs.where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target"), "w"), "w")
    ends = arcs.select("source", "w").unionByName(loops.select(F.col("a").alias("source"), (2 * F.col("w")).alias("w")))
    degree = cut(ends.groupBy(F.col("source").alias("id")).agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0] or 1.0  # 2m, one number
    looped = loops.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    now = cut(degree.select("id", F.col("id").alias("label"), "k"))
    drop(degree)
    best, score, was = now, None, None
    for i in range(rounds + 1):
        sums = cut(now.groupBy("label").agg(F.sum("k").alias("total")))
        mine = now.join(sums, "label")
        told = arcs.join(mine.select(F.col("id").alias("source"), "label", "total"), "source").select(F.col("target").alias("id"), "label", "total", "w")
        # the own community counts too, without the node itself
        offers = told.unionByName(mine.select("id", "label", "total", F.lit(0.0).alias("w"))).repartition("id").groupBy("id", "label").agg(F.sum("w").alias("inside"), F.max("total").alias("total"))
        met = offers.join(now.select("id", F.col("label").alias("mine"), "k"), "id")
        own = F.col("label") == F.col("mine")
        gain = F.round(F.col("inside") - resolution * (F.col("total") - F.when(own, F.col("k")).otherwise(0.0)) * F.col("k") / total, 9)
        allowed = (F.col("label") <= F.col("mine")) if i % 2 == 0 else (F.col("label") >= F.col("mine"))
        # the best gain, of equals the own community, then the smallest label
        to = F.max(F.when(allowed, F.struct(gain.alias("gain"), own.alias("stays"), (-F.col("label")).alias("to")))).alias("o")
        new = cut(met.groupBy("id").agg(to, F.max("k").alias("k"), F.sum(F.when(own, F.col("inside")).otherwise(0.0)).alias("inside")).select("id", (-F.col("o.to")).alias("label"), "k", "inside"))
        reached = 2 / total * (new.agg(F.sum("inside")).first()[0] / 2 + looped) - resolution * sums.agg(F.sum((F.col("total") / total) ** 2)).first()[0] if total and not now.isEmpty() else 0.0
        drop(sums)
        if score is None or reached > score:
            if score is not None:
                drop(best)
            gained, best, score = reached - (score or 0.0), now, reached
        else:
            gained = reached - score
            drop(now)
        if i == rounds or (i and i % 2 == 0 and gained < least):
            drop(new)
            break
        now = new
    return best.select("id", "label")


def _by_number(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``weighted`` with numbers for ids, stored, and what the numbers stand for."""
    names = numbered(nodes)
    found = by_number(edges, names)
    pairs = cut(weighted(found, nodes.select("id", "type").join(names, "id").select(F.col("n").alias("id"), "type")))
    drop(found)
    return pairs, names


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = RESOLUTION, rounds: int = 10, levels: int = 2, least: float = 1e-4) -> DataFrame:
    """(id, community): deterministic, the label being the smallest id of the members. Nodes without edges are left out."""
    pairs, names = _by_number(edges, nodes)
    base, member = pairs, None
    for _ in range(levels):
        labels = _moves(pairs, rounds, resolution, least)
        member = cut(labels if member is None else member.join(labels.select(F.col("id").alias("label"), F.col("label").alias("_l")), "label").select("id", F.col("_l").alias("label")))
        half = cut(base.join(member.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").select("la", "b", "w"))
        pairs = cut(half.join(member.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("w").alias("w")))
        drop(half)
        if pairs.where("a <> b").isEmpty():
            break
    drop(base, pairs)
    first = member.groupBy("label").agg(F.min("id").alias("n")).join(names.select("n", F.col("id").alias("community")), "n").select("label", "community")
    return member.join(first, "label").join(names.select(F.col("n").alias("id"), F.col("id").alias("name")), "id").select(F.col("name").alias("id"), "community")


def cards(member: DataFrame, edges: DataFrame, nodes: DataFrame, least: int = 3, most: int = 12) -> DataFrame:
    """(id, title, key_entities, size) of the ``most`` largest communities of ``least`` members and more.

    Members rank by weighted degree; the three first names make the title, four ids are key entities, and the id is a
    hash of the sorted member ids. Members of one community are pre-ranked, only four of them gathered; the hash takes
    the sorted ids' hashes, summed by community, so no list of members is built.
    """
    pairs, names = _by_number(edges, nodes)
    k = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("n"), "w"), F.struct(F.col("b").alias("n"), "w"))).alias("s")).groupBy("s.n").agg(F.round(F.sum("s.w"), 6).alias("k")).join(names, "n").drop("n")
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("_h")).where(F.col("size") >= least).orderBy(F.desc("size"), "community").limit(most)
    w = Window.partitionBy("community").orderBy(F.desc("k"), "id")
    first = member.join(k, "id").withColumn("_n", F.row_number().over(w)).where("_n <= 4").join(nodes.select("id", "name"), "id")
    told = first.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_n", "name", "id"))).alias("f"))
    return sizes.join(told, "community").select(
        F.substring(F.sha1(F.concat_ws("|", F.col("_h").cast("string"), F.col("size").cast("string"))), 1, 10).alias("id"), "community", F.array_join(F.transform(F.slice("f", 1, 3), lambda x: x["name"]), " · ").alias("title"), F.transform("f", lambda x: x.id).alias("key_entities"), "size"
    )
