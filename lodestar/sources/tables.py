"""Graph tables derived from the star schema: entities(id, type, name, seq) and relations(source, type, target, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import slugify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores: a table in one small file is otherwise one task. A table of
    many files stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind), F.col(key).cast("string") if isinstance(key, str) else key)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    of = lambda df, kind, prefix, key, name: df.select(node(prefix, key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), F.col(key).cast("long").alias("seq"))
    domains = t("part").groupBy("p_type").agg(F.min("p_partkey").alias("k")).select(node("domain:", slugify(F.col("p_type"))).alias("id"), F.lit("Domain").alias("type"), F.col("p_type").alias("name"), F.col("k").alias("seq"))
    parts = [of(t("region"), "Person", "person:r", "r_regionkey", "r_name"), of(t("customer"), "Role", "role:c", "c_custkey", "c_name"), of(t("part"), "Skill", "skill:p", "p_partkey", "p_name"), of(t("supplier"), "Organization", "org:s", "s_suppkey", "s_name"), of(t("nation"), "Location", "loc:n", "n_nationkey", "n_name")]
    orders = t("orders").select(node("project:o", "o_orderkey").alias("id"), F.lit("Project").alias("type"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("seq"))
    out = orders.unionByName(domains)
    for p in parts:
        out = out.unionByName(p)
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges with repeats (one for each line item), so that merging has work to do."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, kind, b, seq: df.select(a.alias("source"), F.lit(kind).alias("type"), b.alias("target"), seq.cast("long").alias("seq"))
    orders, lines = t("orders").select("o_orderkey", "o_custkey"), t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    held = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        edge(orders, node("role:c", "o_custkey"), "DELIVERED", node("project:o", "o_orderkey"), F.col("o_orderkey"))
        .unionByName(edge(lines, node("project:o", "l_orderkey"), "USES", node("skill:p", "l_partkey"), seq))
        .unionByName(edge(sold, node("role:c", "o_custkey"), "USED", node("skill:p", "l_partkey"), seq))
        .unionByName(edge(held, node("person:r", "n_regionkey"), "HELD_ROLE", node("role:c", "c_custkey"), F.col("c_custkey")))
        .unionByName(edge(t("part"), node("skill:p", "p_partkey"), "IN_DOMAIN", node("domain:", slugify(F.col("p_type"))), F.col("p_partkey")))
        .unionByName(edge(t("customer"), node("role:c", "c_custkey"), "LOCATED_IN", node("loc:n", "c_nationkey"), F.col("c_custkey")))
        .unionByName(edge(t("supplier"), node("org:s", "s_suppkey"), "LOCATED_IN", node("loc:n", "s_nationkey"), F.col("s_suppkey")))
    )
