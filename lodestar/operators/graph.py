"""Graph tables: merging, traversal, PageRank, paths. Edges are (source, type, target); ids are strings."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weight of a relation type in random walks; types not listed are not walked.
WEIGHTS = {"HELD_ROLE": 0.6, "AT": 1.0, "BUILT": 0.6, "DELIVERED": 1.0, "USES": 1.0, "USED": 1.0, "IN_DOMAIN": 0.35, "RELATED_TO": 0.7, "STUDIED": 0.6, "SPEAKS": 0.3, "WON": 0.6, "AWARDED_FOR": 1.0, "AWARDED_BY": 0.8, "LOCATED_IN": 0.3}

#: Blocks of nodes that a query without seeds is dealt over, edges of a hub that are one key of a join, and parts in which the
#: edges of a walk are dealt.
BLOCKS, HUB, DEALS = 64, 10_000, 3


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors share (spark.checkpoint.dir; a local one only where that is unset, on a local master)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is written go once it is."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go packed to the folder that executors share, and the shuffles behind them go once they are
    written. ``drop`` takes the files away when a later step has replaced them."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with _cleaning(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(*done: DataFrame) -> None:
    """Delete the rows of tables that ``cut`` gave and that no table still to be read comes from."""
    for df in done:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def merge_entities(rows: DataFrame) -> DataFrame:
    """One row an id: first name and url by seq, longest description (first of equals), aliases and sources united, sorted."""
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    merged = rows.groupBy("id").agg(
        F.min_by("type", "seq").alias("type"),
        F.min_by("name", "seq").alias("name"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
        united("aliases").alias("aliases"),
        F.min_by("url", F.when(F.col("url").isNotNull(), F.col("seq"))).alias("url"),
        united("sources").alias("sources"),
        F.min("seq").alias("seq"),
    )
    return merged.withColumn("aliases", F.filter("aliases", lambda a: a != F.col("name")))


def merge_relations(edges: DataFrame, nodes: DataFrame, props: tuple[str, ...] = ()) -> DataFrame:
    """Distinct edges between known nodes, no loops; a repeat only fills properties that are missing."""
    ids = nodes.select("id")
    known = edges.where("source <> target").join(ids, F.col("source") == ids.id, "left_semi").join(ids, F.col("target") == ids.id, "left_semi")
    fill = [F.min_by(p, F.when(F.col(p).isNotNull(), F.col("seq"))).alias(p) for p in props]
    return known.groupBy("source", "type", "target").agg(F.min("seq").alias("seq"), *fill)


def move_ids(rows: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """rows with ids of ``column`` moved from merged.drop_id to merged.keep_id; rows equal after it are one (mentions, describes)."""
    to = merged.select(F.col("drop_id").alias(column), F.col("keep_id").alias("_k"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_k", column)).select(*rows.columns).distinct()


def widened(edges: DataFrame, nodes: DataFrame, sets: DataFrame, types: tuple[str, ...] | None = None, hubs: tuple[str, ...] = ()) -> DataFrame:
    """``induced`` for sets(qid, id) of the given node types alone, plus edges other than HAS_SKILL from nodes of the types
    in ``hubs`` into the set."""
    if types is not None:
        sets = sets.join(nodes.where(F.col("type").isin(*types)).select("id"), "id", "left_semi")
    out = induced(edges, sets)
    if hubs:
        near = edges.where("type <> 'HAS_SKILL'").join(nodes.where(F.col("type").isin(*hubs)).select(F.col("id").alias("source")), "source", "left_semi")
        out = out.unionByName(near.join(sets.select("qid", F.col("id").alias("target")), "target").select("qid", "source", "type", "target")).distinct()
    return out


def remap(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Both ends of edges moved from merged.drop_id to merged.keep_id."""
    to = lambda df, end: df.join(merged.select(F.col("drop_id").alias(end), F.col("keep_id").alias("_k")), end, "left").withColumn(end, F.coalesce("_k", end)).drop("_k")
    return to(to(edges, "source"), "target").where("source <> target").select(*edges.columns)


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *more)
    return edges.select("source", "target", *more).unionByName(back)


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def neighbors(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("source").alias("id"), "type", F.lit("out").alias("direction"), F.col("target").alias("other"))
    return out.unionByName(edges.select(F.col("target").alias("id"), "type", F.lit("in").alias("direction"), F.col("source").alias("other")))


def induced(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """For each qid of sets(qid, id): the edges with both ends in its set."""
    a, b = sets.select("qid", F.col("id").alias("source")), sets.select(F.col("qid").alias("_q"), F.col("id").alias("_t"))
    return edges.join(a, "source").join(b, (F.col("qid") == F.col("_q")) & (F.col("target") == F.col("_t")), "left_semi").select("qid", "source", "type", "target")


def match_path(edges: DataFrame, types: list[str]) -> DataFrame:
    """Paths n0 -types[0]-> n1 -types[1]-> ... of fixed length."""
    out = edges.where(F.col("type") == types[0]).select(F.col("source").alias("n0"), F.col("target").alias("n1"))
    for i, kind in enumerate(types[1:], 1):
        out = out.join(edges.where(F.col("type") == kind).select(F.col("source").alias(f"n{i}"), F.col("target").alias(f"n{i + 1}")), f"n{i}")
    return out


def numbered(ids: DataFrame) -> DataFrame:
    """(id, n): a number for each of ids(id), in the order of the ids; numbers are not without gaps."""
    return cut(ids.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("n")))


def by_number(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(source, type, target), both ends as numbers of names(id, n): distinct, without loops and unknown ends. One step after
    another is stored, so that no two shuffles of all edges are there at a time."""
    found = edges.where("source <> target").select("source", "type", "target")
    for end in ("source", "target"):
        rest = [c for c in found.columns if c != end]
        to = cut(found.join(names.select(F.col("id").alias(end), "n"), end).select(F.col("n").alias(end), *rest))
        if end == "target":
            drop(found)
        found = to
    out = cut(found.distinct().select("source", "type", "target"))
    drop(found)
    return out


def _weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their weight ``w``; those at a Person and of types without a weight go."""
    people = nodes.where("type = 'Person'").select(F.col("id").alias("_p"))
    walk = edges.withColumn("w", F.try_element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("type"))).where("w is not null")
    for end in ("source", "target"):
        walk = walk.join(people, F.col(end) == F.col("_p"), "left_anti")
    return walk


def transitions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, p): undirected walk probabilities; edges at a Person and types without a weight are not walked."""
    flat = both_ways(_weights(edges, nodes), "w").groupBy("source", "target").agg(F.sum("w").alias("w"))
    total = flat.groupBy("source").agg(F.sum("w").alias("t"))
    return flat.join(total, "source").select("source", "target", (F.col("w") / F.col("t")).alias("p"))


def walk(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``transitions``, p in proportion alone, which is all that the ranks below ask for. Each pair of ends is stored once, and
    for one use: ``Steps`` deletes it when its edges are dealt."""
    pairs = cut(_weights(edges, nodes).groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("w").alias("p")))
    out = both_ways(pairs, "p")
    out.once = pairs
    return out


class Steps:
    """The edges of a walk, dealt by their source once, so that only what flows along them is shuffled in a step. A hub's
    edges are dealt over keys of about HUB; key -1 leads from each node to itself, so that a step reads its rows once. They are a
    table in buckets. ``ends`` has every node with ``per``, one over the sum of the p of its edges (0 without edges)."""

    def __init__(self, walk: DataFrame, nodes: DataFrame):
        spark = walk.sparkSession
        each = walk.select(F.col("source").alias("id"), "p", F.lit(1).alias("n")).unionByName(nodes.select("id", F.lit(0.0).alias("p"), F.lit(0).alias("n")))
        sums = each.groupBy("id").agg(F.sum("p").alias("p"), F.sum("n").alias("_n"))
        self.ends = cut(sums.select("id", F.when(F.col("p") > 0, 1 / F.col("p")).otherwise(0.0).alias("per"), "_n"))
        self.hubs = cut(self.ends.where(F.col("_n") > HUB).select("id", F.ceil(F.col("_n") / HUB).cast("int").alias("_keys")))  # a row for HUB edges at most
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        key = F.when(F.col("_keys").isNull(), 0).otherwise(F.pmod(F.xxhash64("target"), F.col("_keys"))).cast("int")
        dealt = walk.join(self.hubs.withColumnRenamed("id", "source"), "source", "left").select("source", key.alias("_key"), "target", "p")
        own = self.ends.select(F.col("id").alias("source"), F.lit(-1).alias("_key"), F.col("id").alias("target"), F.lit(0.0).alias("p"))
        self.name, path = f"steps_{uuid.uuid4().hex}", f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
        with _cleaning(spark):
            for i in range(DEALS):  # one after another, so that a part of the edges is shuffled at a time
                some = dealt.where(F.pmod(F.xxhash64("target"), F.lit(DEALS)) == i)
                some = (some.unionByName(own) if not i else some).repartition(parts, "source", "_key").sortWithinPartitions("source", "_key")
                some.write.format("parquet").bucketBy(parts, "source", "_key").sortBy("source", "_key").option("path", path).option("compression", "zstd").mode("append").saveAsTable(self.name)
        if hasattr(walk, "once"):
            drop(walk.once)
        self.edges = spark.table(self.name)
        self.edges.cut_at = path

    def along(self, rows: DataFrame, sends: Column) -> DataFrame:
        """rows(id, ...) with ``target``, p and ``own``: each row to its own node, and where it ``sends`` along its edges."""
        keys = F.when(sends, F.sequence(F.lit(-1), F.coalesce("_keys", F.lit(1)) - 1)).otherwise(F.array(F.lit(-1)))
        out = rows.join(self.hubs, "id", "left").withColumn("_at", F.explode(keys)).drop("_keys")
        met = out.hint("shuffle_hash").join(self.edges, (F.col("id") == F.col("source")) & (F.col("_at") == F.col("_key")))
        return met.withColumn("own", F.col("_at") < 0).drop("_at", "_key", "source")

    def close(self) -> None:
        self.edges.sparkSession.sql(f"DROP TABLE {self.name}")
        drop(self.edges, self.hubs, self.ends)


def _restart(walk: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, id, r): the normalised positive known seeds of each query; all nodes alike where there are none."""
    good = seeds.where("weight > 0").join(nodes.select("id"), "id", "left_semi").select("qid").distinct()
    lost = seeds.select("qid").distinct().join(good, "qid", "left_anti")
    if not lost.isEmpty():
        ends = walk.select(F.col("source").alias("id")).unionByName(nodes.select("id")).distinct()
        block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")
        asked = lost.select("qid", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("_b"))  # these queries against all nodes, in blocks
        alike = ends.select("id", F.lit(1.0).alias("weight"), block.alias("_b")).join(asked, "_b").select("qid", "id", "weight")
        seeds = seeds.join(good, "qid", "left_semi").select("qid", "id", "weight").unionByName(alike)
    start = seeds.where("weight > 0").join(nodes.select("id"), "id", "left_semi").groupBy("qid", "id").agg(F.sum("weight").alias("weight"))
    total = start.groupBy("qid").agg(F.sum("weight").alias("t"))
    return start.join(total, "qid").select("qid", "id", (F.col("weight") / F.col("t")).alias("r"))


def pagerank(walk: DataFrame, nodes: DataFrame, seeds: DataFrame, damping: float = 0.5, least: float = 1e-9) -> DataFrame:
    """(qid, id, rank), rank > 0, for every qid of seeds(qid, id, weight): personalised PageRank of a batch of queries, by
    pushing residuals.

    A query's residual is at first its restart: the normalised positive known seeds, or every node alike where there are
    none. A node whose residual is over ``least`` of the query's largest seed keeps the share 1 - damping of it as rank and
    sends the rest along its edges; the others wait, so a step touches what still matters and a query that has settled
    costs nothing. What is left at the end is what ranks can lack: each rank is at most the true one, and a query's ranks
    together lack no more than 1 less their sum. Mass at nodes without walkable edges restarts: as the walk goes both
    ways only seeds can be such nodes, and it comes to a factor a query.
    """
    restart = cut(_restart(walk, nodes, seeds))
    steps = Steps(walk, nodes)
    lone = restart.join(steps.ends.where("_n = 0"), "id", "left_semi").groupBy("qid").agg(F.sum("r").alias("_lone"))
    bounds = cut(restart.groupBy("qid").agg((least * F.max("r")).alias("_least")).join(lone, "qid", "left"))
    now = cut(restart.join(bounds.select("qid", "_least"), "qid").join(steps.ends.select("id", "per"), "id").select("qid", "id", F.lit(0.0).alias("rank"), "r", "_least", "per"))
    drop(restart)
    sends = F.col("r") > F.col("_least")
    while not now.where(sends).isEmpty():
        own = F.col("own")
        kept = F.when(own, F.col("rank") + F.when(sends, (1 - damping) * F.col("r")).otherwise(0.0)).otherwise(0.0)
        left = F.when(~own, damping * F.col("r") * F.col("per") * F.col("p")).when(sends, 0.0).otherwise(F.col("r"))
        met = steps.along(now, sends).select("qid", F.col("target").alias("id"), kept.alias("rank"), left.alias("r"))
        new = met.groupBy("qid", "id").agg(F.sum("rank").alias("rank"), F.sum("r").alias("r"))
        new = cut(new.join(bounds.select("qid", "_least"), "qid").join(steps.ends.select("id", "per"), "id").select("qid", "id", "rank", "r", "_least", "per"))
        drop(now)
        now = new
    steps.close()
    back = 1 / (1 - damping * F.coalesce("_lone", F.lit(0.0)))
    return now.where("rank > 0").join(bounds.select("qid", "_lone"), "qid").select("qid", "id", (F.col("rank") * back).alias("rank"))


def global_pagerank(walk: DataFrame, nodes: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, digits: int = 6) -> DataFrame:
    """(id, pagerank), uniform restart; a Person gets 1.6 times the largest.

    All nodes matter in every step, so nothing waits here; instead each step is combined with the two before it. The walk
    goes both ways, so its eigenvalues are real and within damping of 0, and Chebyshev's weights make the error shrink by
    (1 - sqrt(1 - damping^2)) / damping a step (0.56, against 0.85 for plain steps). The number of steps follows from the
    tolerance: 37, where plain steps would take 128.
    """
    steps = Steps(walk, nodes)
    n = steps.ends.count()
    if not n:
        steps.close()
        return nodes.select("id", F.lit(0.0).alias("pagerank")).limit(0)
    b = (1 - damping) / n
    now = cut(steps.ends.select("id", F.lit(b).alias("x"), F.lit(0.0).alias("y"), "per"))
    shrink, omega = (1 - math.sqrt(1 - damping**2)) / damping, 1.0
    last = math.ceil(math.log(2 / tolerance) / -math.log(shrink))
    for i in range(1, last + 1):
        omega = 1 / (1 - damping**2 * (0.5 if i == 1 else omega / 4))
        met, own = steps.along(now, F.lit(True)), F.col("own")
        x = F.when(own, omega * b + (1 - omega) * F.col("y")).otherwise(omega * damping * F.col("x") * F.col("per") * F.col("p"))
        only = lambda c: F.when(own, F.col(c)).otherwise(0.0)  # noqa: B023, E731
        sent = met.select(F.col("target").alias("id"), x.alias("x"), only("x").alias("y"), only("per").alias("per"))
        new = cut(sent.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("x", "y", "per"))))
        drop(now)
        now = new
    steps.close()
    total, top = now.agg(F.sum("x"), F.max("x")).first()  # what nodes without edges would give back is a factor
    rank = F.when(F.col("type") == "Person", F.lit(1.6 * top)).otherwise(F.col("x")) / F.lit(total)
    return now.join(nodes.select("id", "type"), "id").select("id", F.round(rank, digits).alias("pagerank"))


def shortest_paths(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, most: int = 6, hubs: tuple[str, ...] = ("Person", "Domain")) -> DataFrame:
    """(source, target, path) of pairs: a shortest undirected path, hubs only as its ends; of several the first by its ids.

    Searched from both ends: a source's frontier serves all its pairs, and so does a target's; they grow in turns and stop
    where all pairs of theirs have met, so each goes half the way. Kept are (end, node, parent) edges, no paths. The edges
    on shortest paths are those that lead back from where frontiers met; a path is rebuilt from them step by step.
    """
    hub = nodes.where(F.col("type").isin(*hubs)).select("id")
    links = cut(both_ways(edges).where("source <> target").distinct())
    pairs = cut(pairs.select("source", "target").distinct())
    found = pairs.where("source = target").select("source", "target", F.array("source").alias("path"))
    wanted = cut(pairs.where("source <> target"))

    class Side:
        """Levels of a breadth-first search from each root; parents[i] holds (root, id, parent) of level i + 1."""

        def __init__(self, end: str):
            self.end = end
            self.front = wanted.select(F.col(end).alias("root"), F.col(end).alias("id")).distinct()
            self.seen, self.parents = self.front, []

        def grow(self, wanted: DataFrame) -> None:
            live = self.front.join(wanted.select(F.col(self.end).alias("root")).distinct(), "root", "left_semi")
            if self.parents:  # roots are hubs that may be left
                live = live.join(hub, "id", "left_anti")
            near = live.select("root", F.col("id").alias("parent")).join(links.select(F.col("source").alias("parent"), F.col("target").alias("id")), "parent")
            met = cut(near.join(self.seen, ["root", "id"], "left_anti").select("root", "id", "parent"))
            self.front = met.select("root", "id").distinct()
            self.seen = self.seen.unionByName(self.front)
            self.parents.append(met)

    ahead, behind = Side("source"), Side("target")
    for depth in range(1, most + 1):
        (ahead if depth % 2 else behind).grow(wanted)
        mine = wanted.join(ahead.front.withColumnRenamed("root", "source"), "source")
        met = cut(mine.join(behind.front.withColumnRenamed("root", "target"), ["target", "id"]).select("source", "target", "id"))
        # a hub may be where they meet only if it is an end
        met = met.join(hub.withColumn("_hub", F.lit(True)), "id", "left").where("_hub is null or id = source or id = target").select("source", "target", "id")
        if not met.isEmpty():
            # (step, from, to) of every edge on a shortest path, in both directions from where they met
            parts, here = [], met
            for i in range(len(ahead.parents), 0, -1):
                up = here.join(ahead.parents[i - 1].withColumnRenamed("root", "source"), ["source", "id"])
                parts.append(up.select("source", "target", F.lit(i).alias("step"), F.col("parent").alias("at"), F.col("id").alias("to")))
                here = up.select("source", "target", F.col("parent").alias("id")).distinct()
            here = met
            for i in range(len(behind.parents), 0, -1):
                down = here.join(behind.parents[i - 1].withColumnRenamed("root", "target"), ["target", "id"])
                parts.append(down.select("source", "target", F.lit(depth - i + 1).alias("step"), F.col("id").alias("at"), F.col("parent").alias("to")))
                here = down.select("source", "target", F.col("parent").alias("id")).distinct()
            ways = parts[0]
            for p in parts[1:]:
                ways = ways.unionByName(p)
            ways = cut(ways)
            path = met.select("source", "target", F.col("source").alias("at"), F.array("source").alias("path")).distinct()
            for i in range(1, depth + 1):
                path = path.join(ways.where(F.col("step") == i).drop("step"), ["source", "target", "at"]).groupBy("source", "target", "path").agg(F.min("to").alias("at"))
                path = path.select("source", "target", "at", F.concat("path", F.array("at")).alias("path"))
            found = found.unionByName(cut(path.select("source", "target", "path")))
            wanted = cut(wanted.join(met.select("source", "target"), ["source", "target"], "left_anti"))
        if depth < most and (wanted.isEmpty() or (ahead if (depth + 1) % 2 else behind).front.isEmpty()):
            break
    return found
