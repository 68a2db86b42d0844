"""What a user asks of a graph, each for a whole table of questions: compositions of the operators, no logic of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import evidence, graph, link, retrieve, view


def ask(corpus: retrieve.Corpus, requests: DataFrame, vectors: DataFrame | None = None, **more) -> DataFrame:
    """(qid, answer): retrieval, and an answer made of its sources, in the question's language."""
    found = retrieve.hybrid(corpus, requests, vectors, **more)
    spoken = requests.groupBy("qid").agg(F.min_by("text", "sub").alias("text")).select("qid", retrieve.intent(F.col("text")).language.alias("language"))
    return retrieve.extractive_answer(found.sources, languages=spoken)


def search(corpus: retrieve.Corpus, requests: DataFrame, vectors: DataFrame | None = None, limit: int = 8, **more) -> DataFrame:
    """(qid, ref, kind, id, title, text): the first sources."""
    return retrieve.hybrid(corpus, requests, vectors, **more).sources.where(F.col("ref") <= limit)


def entity_detail(names: DataFrame, nodes: DataFrame, edges: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, relations) of the entities that names(name) mean."""
    wanted = link.lookup(names.select("name"), index).select("id").distinct()
    return view.summary(nodes.join(wanted, "id", "left_semi"), 3000), view.node_relations(nodes, edges, wanted)


def connect(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b, source, target, path) of pairs(a, b) of names or ids: a shortest path; no row where there is none."""
    ids = nodes.select("id")
    end = lambda df, c, to: (
        df.join(ids.select(F.col("id").alias("_id")), F.col(c) == F.col("_id"), "left")
        .join(link.lookup(pairs.select(F.col(c).alias("name")).distinct(), index).select(F.col("name").alias(c), F.col("id").alias("_n")), c, "left")
        .withColumn(to, F.coalesce("_id", "_n")).drop("_id", "_n")
    )
    known = end(end(pairs.select("a", "b"), "a", "source"), "b", "target").where("source is not null and target is not null")
    return known.join(graph.shortest_paths(edges, nodes, known), ["source", "target"]).select("a", "b", "source", "target", "path")


def fit(requirements: DataFrame, grades: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, items) of jobs: ``evidence.fit_score`` and ``view.fit_items``."""
    return evidence.fit_score(requirements, grades), view.fit_items(requirements, grades, sources)


def profile(nodes: DataFrame, skilled: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strongest skills, featured projects) of every person."""
    return view.profile_card(nodes, skilled), view.featured(projects)
