"""Views of a graph for readers: passages with their mentions, evidence, node details, catalogs, profile cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import citation_refs, passage_title, relation_label, truncate
from lodestar.operators import graph

EVIDENCE, EVIDENCE_LETTERS = 6, 600
TOP_SKILLS, CATALOG_NAMES, CATALOG_LETTERS = 24, 160, 9000
#: The order of types in a catalog, and the properties a summary shows.
CATALOG = ("Role", "Organization", "Project", "Skill", "Domain", "Degree", "Award", "Language", "Location")
SHOWN = ("category", "start", "end", "period", "level", "honors", "school", "year", "stars")


def chunk_entities(mentions: DataFrame) -> DataFrame:
    """(chunk_id, entities): what each passage mentions, sorted; of one passage."""
    return mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))


def hydrated(chunks: DataFrame, docs: DataFrame, mentions: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """chunks(id, doc_id, title, text) with doc_title, kind, url, a title to show and what they mention; those of
    wanted(id) if given. A chunk without a document goes."""
    if wanted is not None:
        chunks = chunks.join(wanted.select("id").distinct(), "id", "left_semi")
    d = docs.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), "kind", "url")
    own = chunk_entities(mentions.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"))
    joined = chunks.join(d, "doc_id").join(own.withColumnRenamed("chunk_id", "id"), "id", "left")
    return joined.select("id", "title", "text", "doc_id", "doc_title", "kind", "url", F.coalesce("entities", F.array().cast("array<string>")).alias("mentions"), passage_title(F.col("doc_title"), F.col("title")).alias("shown"))


def entity_evidence(mentions: DataFrame, chunks: DataFrame, docs: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(entity_id, position, id, title, text, doc_title, kind, url): an entity's first passages, those of a cv before
    others, then by ord and id. Spark cuts each task's rows to ``most`` an entity before they are shuffled."""
    c = chunks.select(F.col("id").alias("chunk_id"), "doc_id", "title", F.substring("text", 1, EVIDENCE_LETTERS).alias("text"), "ord")
    d = docs.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), "kind", "url")
    w = Window.partitionBy("entity_id").orderBy(~F.coalesce(F.col("kind") == "cv", F.lit(False)), "ord", "chunk_id")
    joined = mentions.select("chunk_id", "entity_id").distinct().join(c, "chunk_id").join(d, "doc_id")
    return joined.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("entity_id", "position", F.col("chunk_id").alias("id"), "title", "text", "doc_title", "kind", "url")


def summary(nodes: DataFrame, letters: int = 400) -> DataFrame:
    """(id, type, name, description, url, extras): what is null or empty is left out; extras holds the SHOWN properties of
    the map ``props``."""
    shown = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*SHOWN) & (F.coalesce(v, F.lit("")) != ""))
    some = lambda c: F.nullif(c, F.lit(""))
    return nodes.select("id", "type", "name", some(F.substring("description", 1, letters)).alias("description"), some(F.col("url")).alias("url"), shown.alias("extras"))


def view_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with their degree (0 without edges); the links of the view are the edges themselves."""
    return nodes.join(graph.degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def node_relations(nodes: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, label, position, other, name, type): an entity's relations by display label, neighbours of higher pagerank
    first. nodes(id, type, name, pagerank). A neighbour is a row, so that a hub is no list."""
    near = graph.neighbors(edges)
    if wanted is not None:
        near = near.join(wanted.select("id").distinct(), "id", "left_semi")
    own = graph.cut(near.withColumnRenamed("type", "relation").join(nodes.select("id", F.col("type").alias("own")), "id"))
    met = own.join(nodes.select(F.col("id").alias("other"), "name", "type", "pagerank"), "other")
    labelled = met.select("id", relation_label(F.col("relation"), F.col("direction"), F.col("own")).alias("label"), "other", "name", "type", "pagerank")
    w = Window.partitionBy("id", "label").orderBy(F.desc("pagerank"), "other")
    labelled = graph.cut(labelled)  # one shuffle of all relations at a time
    graph.drop(own)
    return labelled.select("id", "label", F.row_number().over(w).alias("position"), "other", "name", "type")


def has_skill(evidence: DataFrame, people: DataFrame) -> DataFrame:
    """HAS_SKILL edges (source, type, target, strength, evidence) from each of people(id, skill) to its skills' evidence(id, ...)."""
    return people.select(F.col("id").alias("source"), F.lit("HAS_SKILL").alias("type"), F.col("skill").alias("target")).join(evidence.select(F.col("id").alias("target"), "strength", "evidence"), "target").select("source", "type", "target", "strength", "evidence")


def profile_card(nodes: DataFrame, skilled: DataFrame, most: int = TOP_SKILLS) -> DataFrame:
    """(person, position, id, name, strength, evidence): a person's strongest skills, equals by name."""
    named = skilled.join(nodes.select(F.col("id").alias("target"), "name"), "target")
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("strength"), "name", "target")
    return named.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select(F.col("source").alias("person"), "position", F.col("target").alias("id"), "name", "strength", "evidence")


def featured(projects: DataFrame) -> DataFrame:
    """(id, name, url, summary) of projects(..., featured) that are."""
    return projects.where("featured").select("id", "name", "url", F.col("description").alias("summary"))


def catalog(nodes: DataFrame) -> DataFrame:
    """One row (text): a line for each type with its first names by pagerank; 9000 letters at most."""
    at = F.array_position(F.array(*map(F.lit, CATALOG)), F.col("type"))
    w = Window.partitionBy("type").orderBy(F.desc("pagerank"), "id")
    first = nodes.where(at > 0).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= CATALOG_NAMES)
    names = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["name"]), ", ")
    lines = first.groupBy("type").agg(F.collect_list(F.struct("_n", "name")).alias("l")).select(at.alias("at"), F.concat_ws(": ", "type", names(F.col("l"))).alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), "\n").alias("text")).select(truncate(F.col("text"), CATALOG_LETTERS).alias("text"))  # at most a line a type


def skill_text(skills: DataFrame, roles: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, description) of skills(id, name, category, years, verified, listed) from the names of roles(skill, name) and
    projects(skill, name) that used them, sorted."""
    names = lambda df, c: df.groupBy("skill").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias(c)).withColumnRenamed("skill", "id")
    said = skills.join(names(roles, "r"), "id", "left").join(names(projects, "p"), "id", "left")
    return said.select("id", F.concat_ws(
        " ",
        F.concat("name", F.lit(" ("), F.coalesce("category", F.lit("skill")), F.lit(").")),
        F.when(F.col("r").isNotNull(), F.format_string("Used professionally (~%.1f years) as: %s.", F.coalesce("years", F.lit(0.0)), "r")),
        F.when(F.col("p").isNotNull(), F.format_string("Used in projects: %s.", "p")),
        F.when(F.col("verified"), "Verified in source code / manifests on GitHub."),
        F.when(F.col("listed"), "Listed on the CV."),
    ).alias("description"))


def fit_items(requirements: DataFrame, grades: DataFrame, sources: DataFrame) -> DataFrame:
    """(job_id, idx, requirement, importance, status, rationale, evidence, cited) of requirements: a missing grade is a
    gap, "Not assessed."; evidence keeps the refs that sources(job_id, ref) has; cited adds those the rationale names."""
    g = grades.select("job_id", "idx", "status", "rationale", F.col("evidence").alias("_e"))
    rows = requirements.join(g, ["job_id", "idx"], "left")
    asked = rows.select("job_id", "idx", F.posexplode("_e").alias("at", "ref")).join(sources.select("job_id", "ref").distinct(), ["job_id", "ref"], "left_semi")
    valid = asked.groupBy("job_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x.ref).alias("evidence"))  # of one grade
    out = rows.drop("_e").join(valid, ["job_id", "idx"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<int>")))
    cited = F.array_sort(F.array_union(F.coalesce(citation_refs(F.col("rationale")), F.array().cast("array<int>")), "evidence"))
    return out.withColumn("cited", cited).withColumn("status", F.coalesce("status", F.lit("gap"))).withColumn("rationale", F.coalesce("rationale", F.lit("Not assessed.")))


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """sources(qid, ref, ...) with ``cited``: whether the text of answers(qid, text) cites them."""
    refs = answers.select("qid", F.explode(citation_refs(F.col("text"))).alias("ref")).distinct().withColumn("_c", F.lit(True))
    return sources.join(refs, ["qid", "ref"], "left").withColumn("cited", F.coalesce("_c", F.lit(False))).drop("_c")


def ordered_distinct(rows: DataFrame, by: str, value: str, position: str) -> DataFrame:
    """Each value of a group once, where it comes first, numbered from 1."""
    first = rows.groupBy(by, value).agg(F.min(position).alias("_p"))
    return first.select(by, value, F.row_number().over(Window.partitionBy(by).orderBy("_p", value)).alias("position"))


def call_totals(calls: DataFrame) -> DataFrame:
    """(model, requests, failures, input_tokens, output_tokens, hits, misses) of calls(model, failed, input, output, hit)."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(no("failed")).alias("failures"), F.sum(F.coalesce("input", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output", F.lit(0))).alias("output_tokens"), F.count_if(no("hit")).alias("hits"), F.count_if(~no("hit")).alias("misses")
    )


def community_context(member: DataFrame, edges: DataFrame, nodes: DataFrame, ranked: DataFrame, lines: int = 40, triples: int = 60) -> DataFrame:
    """(community, text): its first members by ranked(id, k), and the relations inside, as lines; both are cut to their
    number before they are gathered."""
    w = Window.partitionBy("community").orderBy(F.desc("k"), "id")
    first = member.join(ranked, "id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= lines).join(nodes.select("id", "type", "name", "description"), "id")
    line = F.concat(F.lit("- "), "type", F.lit(": "), "name", F.lit(" — "), truncate(F.coalesce("description", F.lit("")), 160))
    gather = lambda df, c: df.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x.line), "\n").alias(c))
    a = member.select(F.col("id").alias("source"), "community")
    inside = edges.join(a, "source").join(member.select(F.col("id").alias("target"), F.col("community").alias("_c")), "target").where(F.col("community") == F.col("_c"))
    inside = inside.withColumn("_n", F.row_number().over(Window.partitionBy("community").orderBy("source", "type", "target"))).where(F.col("_n") <= triples)
    name = lambda end: nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    told = inside.join(name("source"), "source").join(name("target"), "target").withColumn("line", F.concat(F.lit("- "), "source_name", F.lit(" —"), "type", F.lit("→ "), "target_name"))
    both = gather(first.withColumn("line", line), "e").join(gather(told, "r"), "community", "left")
    return both.select("community", F.concat(F.lit("Entities:\n"), "e", F.lit("\n\nRelations:\n"), F.coalesce("r", F.lit(""))).alias("text"))


def all_communities(communities: DataFrame) -> DataFrame:
    """Largest first; equals by id."""
    return communities.orderBy(F.desc("size"), "id")
