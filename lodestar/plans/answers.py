"""Retrieval, communities and cards. The searched graph is made of words of ``benchmark`` that ``documents`` mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import community, documents, graph, retrieve
from lodestar.sources.tables import entities, node, relations, table

def _words(spark, sf):
    """(item_id, pos, word): plain words of 7 letters and more, in order."""
    items = table(spark, sf, "benchmark")
    found = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_.-])[a-z]{7,}(?![\p{L}\p{N}_-])"), F.lit(0))
    return items.select("item_id", F.posexplode(found).alias("pos", "word"))


def corpus(spark: SparkSession, sf: str) -> retrieve.Corpus:
    """Skills are words, projects are items: an item uses its words, and a word is related to the next one."""
    words = _words(spark, sf)
    skill = lambda c: F.concat(F.lit("skill:"), c)
    item = node("project:b", "item_id")
    skills = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(skill(F.col("word")).alias("id"), F.lit("Skill").alias("type"), F.col("word").alias("name"), F.lit("").alias("text"))
    projects = table(spark, sf, "benchmark").select(item.alias("id"), F.lit("Project").alias("type"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("name"), "text")
    uses = words.select(item.alias("source"), F.lit("USES").alias("type"), skill(F.col("word")).alias("target"))
    after = F.lead("word").over(Window.partitionBy("item_id").orderBy("pos"))
    near = words.select(skill(F.col("word")).alias("source"), F.lit("RELATED_TO").alias("type"), skill(after).alias("target")).where("target is not null and source <> target")
    docs = table(spark, sf, "documents")
    labels = skills.select(F.col("id").alias("entity_id"), F.col("name").alias("label"), F.lit(0).alias("priority"))
    found = graph.cut(documents.mentions(docs.select(F.col("doc_id").alias("id"), "text"), labels))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieve.Corpus(skills.unionByName(projects), uses.unionByName(near).distinct(), docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"), found, None, vectors.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi"))


def _asked(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.lit(0).alias("sub"), "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.lit(0).alias("sub"), "embedding").join(items.select("qid"), "qid", "left_semi")
    return items, vectors


def _found(spark, sf):
    return retrieve.hybrid(corpus(spark, sf), *_asked(spark, sf))


def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered sources for every benchmark item."""
    return _found(spark, sf).sources.select("qid", "ref", "kind", "id", "title")


def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.extractive_answer(_found(spark, sf).sources)


def fit_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Ten benchmark items make a job; each is a requirement with 3 passages and 5 entities; sources once a job."""
    asked, vectors = _asked(spark, sf)
    key = lambda df: df.withColumn("qid", F.struct(F.floor(F.col("qid") / 10).alias("job_id"), (F.col("qid") % 10).alias("idx")))
    found = retrieve.hybrid(corpus(spark, sf), key(asked), key(vectors), k_chunks=3, k_entities=5).sources
    merged = retrieve.merged_evidence(found.select("qid.job_id", "qid.idx", "ref", "kind", "id"))
    return merged.withColumn("requirements", F.array_join(F.transform("requirements", lambda x: x.cast("string")), ","))


def question_intent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", retrieve.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.language", "i.overview")


def _sold(spark, sf):
    """Customers and parts joined by USED, parts by their types: the graph whose communities are sought."""
    return entities(spark, sf), relations(spark, sf).where("type in ('USED', 'DELIVERED')").select("source", "type", "target").distinct()


def communities(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _sold(spark, sf)
    return community.communities(edges, nodes, rounds=6)


def community_cards(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _sold(spark, sf)
    edges = graph.cut(edges)
    found = community.cards(community.communities(edges, nodes, rounds=6), edges, nodes)
    return found.withColumn("key_entities", F.array_join("key_entities", ","))


def collapsed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected weights of parallel types summed; hubs left out; by smaller end."""
    nodes, edges = entities(spark, sf), relations(spark, sf).select("source", "type", "target").distinct()
    return community.weighted(edges, nodes).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("w"))


def entity_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Of every customer: its first 14 relations."""
    nodes = entities(spark, sf).withColumn("text", F.lit(None).cast("string"))
    edges = relations(spark, sf).where("type in ('DELIVERED', 'LOCATED_IN')").select("source", "type", "target").distinct()
    return retrieve.cards(nodes, edges, nodes.where("type = 'Role'"))


QUERIES = {f.__name__: f for f in (hybrid_retrieve, extractive_answer, fit_evidence, question_intent, communities, community_cards, collapsed_edges, entity_cards)}

ORACLES = {
    "question_intent": r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(quel|quelle|est-ce|expérience|compétences|projets)($|[^\p{L}\p{N}_])') THEN 'fr' ELSE 'en' END AS language,
 coalesce(regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(who|summary|overview|strengths?|profil|qui est|résumé)($|[^\p{L}\p{N}_])'), false) AS overview FROM conversations""",
    "collapsed_edges": """WITH e AS (SELECT DISTINCT 'project:o' || o_orderkey AS a, 'role:c' || o_custkey AS b, 1.0::DOUBLE AS w FROM orders
 UNION ALL SELECT DISTINCT 'project:o' || l_orderkey, 'skill:p' || l_partkey, 1.0::DOUBLE FROM lineitem
 UNION ALL SELECT DISTINCT 'role:c' || o_custkey, 'skill:p' || l_partkey, 1.0::DOUBLE FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT a, b, sum(w) AS w FROM e GROUP BY ALL) SELECT a, count(*) AS n, round(sum(w), 4) AS w FROM s GROUP BY a""",
    "entity_cards": """WITH r AS (SELECT c_custkey, 'DELIVERED' AS t, 'project:o' || o_orderkey AS o, '-> DELIVERED Order ' || o_orderkey AS line FROM customer JOIN orders ON o_custkey = c_custkey
 UNION ALL SELECT c_custkey, 'LOCATED_IN', 'loc:n' || c_nationkey, '-> LOCATED_IN ' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY t, o) AS n FROM r),
l AS (SELECT c_custkey, string_agg(line, chr(10) ORDER BY n) AS text FROM k WHERE n <= 14 GROUP BY 1)
SELECT 'role:c' || c_custkey AS id, 'Role: ' || c_name AS title, coalesce(text, '') AS text FROM customer LEFT JOIN l USING (c_custkey)""",
}
