"""Queries that link, view and assess: names in questions, evidence, cards, catalogs, repositories, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import graph, link, profile, repos, resolve, search, view
from lodestar.sources.tables import entities, node, relations, table


def _names(spark, sf):
    """Words of benchmark items as entities: the first one, two or three words of an item; types by its number."""
    items = table(spark, sf, "benchmark").select("item_id", F.filter(F.split(F.translate("text", "?,.", "   "), r"\s+"), lambda w: w != "").alias("w"))
    kind = F.element_at(F.array(*map(F.lit, ("Person", "Skill", "Project", "Award", "Domain"))), (F.col("item_id") % 5 + 1).cast("int"))
    name = F.array_join(F.slice("w", 1, (F.col("item_id") % 3 + 1).cast("int")), " ")
    return items.select(F.col("item_id").alias("id"), kind.alias("type"), name.alias("name"), F.array(F.get("w", F.lit(4))).alias("aliases"), F.col("item_id").alias("seq"))


def linked_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that the turns of conversations and the benchmark items name."""
    turns = table(spark, sf, "conversations").select((1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("qid"), "text")
    return link.mentioned(items.unionByName(turns), link.name_index(_names(spark, sf)))


def _passages(spark, sf):
    """Orders are passages of customers' documents; they mention the parts of their lines."""
    o = table(spark, sf, "orders")
    chunks = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc_id"), "o_orderpriority", F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("text"), (F.col("o_orderkey") % 7).cast("int").alias("ord"))
    chunks = chunks.select("id", "doc_id", F.when(F.col("id") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("title"), "text", "ord")
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") == "FURNITURE", "cv").otherwise("note").alias("kind"), F.lit(None).cast("string").alias("url"))
    said = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").cast("string").alias("entity_id")).distinct()
    return chunks, docs, said


def hydrated_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks, docs, said = _passages(spark, sf)
    return view.hydrated(chunks, docs, said).select("id", "doc_title", "kind", "shown", F.array_join("mentions", ",").alias("mentions"))


def entity_evidence(spark: SparkSession, sf: str) -> DataFrame:
    chunks, docs, said = _passages(spark, sf)
    return view.entity_evidence(said, chunks, docs).select("entity_id", "position", "id", "text", "doc_title", "kind")


def _view(spark, sf):
    nodes = entities(spark, sf)
    edges = relations(spark, sf).select("source", "type", "target").distinct()
    return nodes, edges


def view_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _view(spark, sf)
    return view.view_nodes(nodes, edges).select("id", "type", "name", "degree")


def node_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of customers and suppliers by label, neighbours of high degree first."""
    nodes, edges = _view(spark, sf)
    edges = graph.cut(edges)
    ranked = graph.cut(view.view_nodes(nodes, edges).select("id", "type", "name", F.col("degree").alias("pagerank")))
    return view.node_relations(ranked, edges, nodes.where("type in ('Role', 'Organization')")).select("id", "label", "position", "other")


def _skilled(spark, sf):
    strength = table(spark, sf, "part").select(node("skill:p", "p_partkey").alias("id"), F.round(F.col("p_size") / 50, 2).alias("strength"), (F.col("p_size") % 7).alias("evidence"))
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return view.has_skill(strength, people.select(node("person:r", "n_regionkey").alias("id"), node("skill:p", "l_partkey").alias("skill")).distinct())


def profile_cards(spark: SparkSession, sf: str) -> DataFrame:
    return view.profile_card(entities(spark, sf), _skilled(spark, sf))


def entity_catalog(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _view(spark, sf)
    return view.catalog(view.view_nodes(nodes, edges).withColumn("pagerank", F.col("degree")))


def skill_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Of every part: who used it (customers by nation's name), in what (priorities of orders), and flags."""
    p, l, o = (table(spark, sf, t) for t in ("part", "lineitem", "orders"))  # noqa: E741
    skills = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("category"), (F.col("p_size") / 4).alias("years"), (F.col("p_size") > 40).alias("verified"), (F.col("p_size") % 2 == 0).alias("listed"))
    sold = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    nations = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    roles = sold.where("l_returnflag = 'A'").join(nations, F.col("o_custkey") == F.col("c_custkey")).select(F.col("l_partkey").alias("skill"), F.col("n_name").alias("name"))
    projects = sold.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("skill"), F.col("o_orderpriority").alias("name"))
    return view.skill_text(skills, roles, projects)


def fit_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are jobs, lines requirements; every third is not graded; refs up to the number of lines are valid."""
    l = table(spark, sf, "lineitem").withColumn("idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))  # noqa: E741
    req = l.select(F.col("l_orderkey").alias("job_id"), "idx", F.col("l_partkey").cast("string").alias("requirement"), F.when(F.col("l_quantity") > 25, "must").otherwise("nice").alias("importance"))
    ref = F.col("l_suppkey").cast("int") % 6 + 1
    grades = l.where("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("job_id"), "idx", F.lit("strong").alias("status"), F.concat(F.lit("As ["), ref.cast("string"), F.lit("-7] shows.")).alias("rationale"), F.array(ref, F.lit(2), F.lit(9)).alias("evidence"))
    sources = l.select(F.col("l_orderkey").alias("job_id"), F.col("idx").alias("ref"))
    found = view.fit_items(req, grades, sources)
    return found.select("job_id", "idx", "requirement", "importance", "status", "rationale", F.array_join("evidence", ",").alias("evidence"), F.array_join("cited", ",").alias("cited"))


def cited_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order are its numbered sources; the answer cites from its customer's number to three further."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    first = F.col("o_custkey") % 5 + 1
    answers = o.select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("so ["), first.cast("string"), F.lit("-"), (first + 3).cast("string"), F.lit("] and [1](x)")).alias("text"))
    sources = l.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").cast("int").alias("ref")).distinct()
    return view.cited_sources(answers, sources)


def ordered_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's parts in the order of their first sale."""
    sold = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return view.ordered_distinct(sold.select("o_custkey", "l_partkey", "o_orderkey"), "o_custkey", "l_partkey", "o_orderkey")


def call_totals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return view.call_totals(e.select(F.col("event_type").alias("model"), (F.col("event_id") % 9 == 0).alias("failed"), F.floor("value").alias("input"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") / 2)).alias("output"), (F.col("user_id") % 3 == 0).alias("hit")))


def quota_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Events as refusals of a service: a delay, a daily quota, both, broken JSON."""
    e = table(spark, sf, "events")
    delay = F.concat(F.lit('{"retryDelay":"'), F.col("user_id").cast("string"), F.lit('.5s"}'))
    daily = F.lit('{"violations":[{"quotaId":"RequestsPerDay"},{"quotaId":"x"}]}')
    body = F.when(F.col("event_id") % 4 == 0, delay).when(F.col("event_id") % 4 == 1, daily).when(F.col("event_id") % 4 == 2, F.concat_ws(",", delay, daily)).otherwise('{"retryDelay":"soon"')
    wrapped = F.when(F.col("event_id") % 8 < 4, F.concat(F.lit('{"error":{"details":['), body, F.lit("]}}"))).otherwise(F.concat(F.lit('{"details":['), body, F.lit("]}")))
    return e.select("event_id", text.quota(wrapped).alias("q")).select("event_id", "q.retry_after", "q.daily")


def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Of suppliers, with the parts they sell as aliases and nations as highlights."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    sold = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("parts"))  # parts of a supplier
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(sold, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    made = text.embedding_text(F.lit("Organization"), F.col("s_name"), F.col("parts"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(""), F.when(F.col("s_suppkey") % 3 == 0, F.array("n_name", "s_name")))
    return j.select("s_suppkey", made.alias("embedding_text"))


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Length and largest component of every vector after normalising."""
    v = table(spark, sf, "embeddings").select("vec_id", text.unit(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return v.select("vec_id", F.round(F.sqrt(search.dot(F.col("v"), F.col("v"))), 6).alias("length"), F.round(F.array_max("v"), 5).alias("largest"))


def role_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written as months, years or nothing, as the beginnings and ends of roles."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    start = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy")).otherwise("")
    end = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, "soon")
    shown = o.select("o_orderkey", start.alias("s"), end.alias("e"))
    return shown.select("o_orderkey", text.period(F.col("s"), F.col("e")).alias("period"), F.round(text.role_years(text.month(F.col("s")), text.month(F.col("e")), F.lit("1999-06-01").cast("date")), 4).alias("years"))


def distinctive_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names and brands of parts that are telling enough to look for."""
    p = table(spark, sf, "part")
    forms = p.select("p_partkey", F.explode(F.array("p_name", F.replace("p_brand", F.lit("#"), F.lit("")), F.initcap("p_name"), F.replace("p_name", F.lit(" "), F.lit("")), F.substring("p_brand", 1, 5))).alias("name"))
    return forms.where(text.distinctive(F.col("name"))).distinct()


def near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors with a cosine of 0.4 or more."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding"))
    return search.near_pairs(v, 0.4).withColumn("score", F.round("score", 5))


def merged_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as skills: every seventh is known, sources are numbers that overlap; near ones merge in input order."""
    v, k = table(spark, sf, "embeddings"), F.col("vec_id")
    sources = F.transform(F.sequence(F.lit(0), k % 4), lambda i: i + k % 3)
    skills = v.select(k.alias("id"), (k % 7 == 0).alias("known"), sources.alias("sources"), k.alias("seq"))
    return resolve.merge_similar(skills, near_vectors(spark, sf))


def repo_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as repositories: overrides rename every tenth and merge the next into it; parts in code, brands as topics."""
    o, l, p = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))  # noqa: E741
    sold = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    topics = sold.where("p_size <= 10").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("p_brand")).alias("topics"))
    r = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("repo")).join(topics, "k", "left")
    over = o.where("o_orderkey % 10 < 2").select(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("repo"), F.when(F.col("o_orderkey") % 10 == 0, "Tenth").alias("name"), F.when(F.col("o_orderkey") % 10 == 1, F.concat(F.lit("order-"), (F.col("o_orderkey") - 1).cast("string"))).alias("project"))
    named = repos.overridden(r, over)
    tech = sold.where("p_size > 25").select(F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("repo"), F.col("p_brand").alias("technology"), F.col("p_name").alias("evidence")).groupBy("repo", "technology").agg(F.min("evidence").alias("evidence"))
    skills = p.select(F.col("p_brand").alias("name"), F.concat(F.lit("skill:"), text.slugify(F.col("p_brand"))).alias("id")).distinct()
    return repos.repository_edges(named, tech, skills, "person:x").fillna("", ["via", "evidence"])


def first_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as documents, some of them licences."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    path = F.concat(F.lit("docs/"), F.when(F.col("l_partkey") % 3 == 0, "LICENSE-").when(F.col("l_partkey") % 3 == 1, "security-").otherwise("guide-"), F.col("l_partkey").cast("string"), F.lit(".md"))
    files = l.select(F.col("l_orderkey").alias("repo"), path.alias("path"), F.when(F.col("l_returnflag") == "N", "manifest").otherwise("docs").alias("route")).distinct()
    return repos.first_docs(files).select("repo", "path")


def profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as profiles (orders are roles, their lines projects): entities and relations by type, names of skills."""
    o, l, p, c, n = (table(spark, sf, t) for t in ("orders", "lineitem", "part", "customer", "nation"))  # noqa: E741
    none = F.lit(None).cast("string")
    lines = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    used = lines.groupBy("l_orderkey").agg(F.collect_set("p_name").alias("skills"))
    role = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("Buyer").alias("title"), F.col("o_orderpriority").alias("organization"), none.alias("organization_description"), none.alias("organization_url"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("location"), F.date_format("o_orderdate", "yyyy-MM").alias("start"), none.alias("end"), F.array(F.lit("a  b")).alias("highlights"), F.col("skills"))
    project = F.struct(F.concat("l_orderkey", F.lit("-"), "l_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("summary"), none.alias("url"), F.lit(True).alias("featured"), none.alias("period"), F.when(F.col("p_size") > 25, F.col("l_orderkey").cast("string")).alias("role"), F.array().cast("array<string>").alias("highlights"), F.array("p_brand").alias("skills"))
    # stored one after another, so that their shuffles are not there at a time; so are the profiles, which many parts below read
    roles = graph.cut(o.join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.collect_list(role).alias("experience")))  # of one customer
    made = graph.cut(lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.collect_set(project).alias("projects")))
    person = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("x").alias("summary"), none.alias("headline"), F.col("n_name").alias("location"), none.alias("email"), none.alias("website"), none.alias("linkedin"), none.alias("github"), none.alias("work_authorization"))
    group = F.array(F.struct(F.col("c_mktsegment").alias("group"), F.array("n_name").alias("names")))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(roles, F.col("c_custkey") == roles.o_custkey, "left").drop("o_custkey").join(made, F.col("c_custkey") == made.o_custkey, "left")
    school = F.array(F.struct(F.col("c_custkey").cast("string").alias("id"), F.lit("D").alias("degree"), F.col("c_mktsegment").alias("school"), none.alias("location"), none.alias("start"), none.alias("end"), none.alias("honors"), none.alias("note")))
    award = F.array(F.struct(F.col("c_custkey").cast("string").alias("id"), F.lit("A").alias("name"), F.lit("1999").alias("year"), none.alias("project"), F.col("n_name").alias("organization")))
    spoken = F.array(F.struct(F.col("n_name").alias("name"), F.lit("good").alias("level")))
    profiles = graph.cut(rows.select(person.alias("person"), group.alias("skills"), "experience", "projects", school.alias("education"), award.alias("awards"), spoken.alias("languages")))
    graph.drop(roles, made)
    g = profile.profile_graph(profiles)
    nodes = graph.cut(graph.merge_entities(g.entities).select("id", "type"))
    related = graph.by_number(g.relations, graph.numbered(nodes))
    count = lambda df, what: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "type", "n")
    names = g.skills.select(F.coalesce("type", F.lit("LISTED")).alias("type"), "subject", "name").distinct()
    return count(nodes, "entity").unionByName(count(related, "relation")).unionByName(count(names, "skill")).unionByName(count(g.docs.withColumnRenamed("kind", "type"), "document"))


def extraction_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as subjects (odd ones are projects), their parts as skills found in them, related by line."""
    o, l, p = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))  # noqa: E741
    subjects = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 2 == 1, "Project").otherwise("Role").alias("type"))
    sold = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("subject"), "p_name", "p_brand", "p_type")
    skills = sold.select("subject", F.col("p_name").alias("name"), F.col("p_type").alias("how")).unionByName(sold.select("subject", F.col("p_brand").alias("name"), F.col("p_type").alias("how")))
    names = p.select(F.explode(F.array("p_name", "p_brand")).alias("name")).distinct().select("name", F.concat(F.lit("skill:"), text.slugify(F.col("name"))).alias("id"))
    related = sold.select("subject", F.upper("p_name").alias("a"), F.col("p_brand").alias("b")).distinct()
    return repos.extraction_edges(subjects, skills, related, names).fillna("", ["how"])


QUERIES = {
    f.__name__: f
    for f in (linked_questions, hydrated_chunks, entity_evidence, view_graph, node_relations, profile_cards, entity_catalog, skill_texts, fit_items, cited_sources, ordered_parts, call_totals, quota_errors, embedding_texts, unit_vectors, role_periods, distinctive_names, near_vectors, merged_similar, repo_edges, first_documents, profile_counts, extraction_edges)
}

_SLUG = "regexp_replace(regexp_replace(lower(replace({0}, '#', 'sharp')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_NORM = "regexp_replace(replace(replace(lower(strip_accents({0})), '++', 'pp'), '#', 'sharp'), '[^a-z0-9]', '', 'g')"
_EDGES = """e AS (SELECT DISTINCT 'role:c' || o_custkey AS s, 'DELIVERED' AS t, 'project:o' || o_orderkey AS d FROM orders UNION ALL SELECT DISTINCT 'project:o' || l_orderkey, 'USES', 'skill:p' || l_partkey FROM lineitem
 UNION ALL SELECT DISTINCT 'role:c' || o_custkey, 'USED', 'skill:p' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'person:r' || n_regionkey, 'HELD_ROLE', 'role:c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'skill:p' || p_partkey, 'IN_DOMAIN', 'domain:' || regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') FROM part UNION ALL SELECT 'role:c' || c_custkey, 'LOCATED_IN', 'loc:n' || c_nationkey FROM customer UNION ALL SELECT 'org:s' || s_suppkey, 'LOCATED_IN', 'loc:n' || s_nationkey FROM supplier),
g AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM e UNION ALL SELECT d FROM e) GROUP BY id),
v AS (SELECT id, type, name, coalesce(degree, 0)::BIGINT AS degree FROM (SELECT 'person:r' || r_regionkey AS id, 'Person' AS type, r_name AS name FROM region UNION ALL SELECT 'role:c' || c_custkey, 'Role', c_name FROM customer UNION ALL SELECT 'skill:p' || p_partkey, 'Skill', p_name FROM part
 UNION ALL SELECT 'org:s' || s_suppkey, 'Organization', s_name FROM supplier UNION ALL SELECT 'loc:n' || n_nationkey, 'Location', n_name FROM nation UNION ALL SELECT 'project:o' || o_orderkey, 'Project', 'Order ' || o_orderkey FROM orders UNION ALL SELECT DISTINCT 'domain:' || regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), 'Domain', p_type FROM part) LEFT JOIN g USING (id))"""
_PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
ORACLES = {
    "linked_questions": f"""WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, '?,.', '   '), '\\s+'), lambda w: w <> '') AS w FROM benchmark),
n AS (SELECT item_id AS id, CASE item_id % 5 WHEN 0 THEN 'Person' WHEN 1 THEN 'Skill' WHEN 2 THEN 'Project' WHEN 3 THEN 'Award' ELSE 'Domain' END AS type, unnest([array_to_string(w[1:item_id % 3 + 1], ' '), w[5]]) AS n FROM i),
x AS (SELECT k, (arg_min((id, type), (CASE type WHEN 'Skill' THEN 1 WHEN 'Project' THEN 2 WHEN 'Domain' THEN 5 ELSE 6 END, id))) AS f FROM (SELECT *, {_NORM.format('n')} AS k FROM n WHERE n IS NOT NULL) WHERE k <> '' GROUP BY k),
q AS (SELECT item_id AS qid, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations),
w AS (SELECT qid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '?,', '  '), '\\s+'), lambda w: w <> '') AS w FROM q),
r AS (SELECT qid, 4 - s AS shorter, pos, array_to_string(w[pos:pos + s - 1], ' ') AS name FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS pos FROM (SELECT *, unnest([4, 3, 2, 1]) AS s FROM w))),
c AS (SELECT *, {_NORM.format('name')} AS k FROM r WHERE len(name) >= 2 AND NOT (shorter = 3 AND lower(name) IN ('{"', '".join(text.STOP)}'))),
t AS (SELECT qid, shorter, pos, name, 0 AS p, k FROM c WHERE k <> '' UNION ALL SELECT qid, shorter, pos, name, 1, k || 's' FROM c WHERE k <> '' UNION ALL SELECT qid, shorter, pos, name, 2, left(k, -1) FROM c WHERE k LIKE '%s' AND len(k) > 3),
m AS (SELECT qid, shorter, pos, arg_min(f, p) AS f FROM t JOIN x USING (k) GROUP BY qid, shorter, pos),
o AS (SELECT qid, f[1] AS id, min((shorter, pos)) AS pos FROM m WHERE f[2] <> 'Person' GROUP BY 1, 2)
SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY pos, id)::INT AS position FROM o) WHERE position <= 8""",
    "hydrated_chunks": """SELECT o_orderkey AS id, c_name AS doc_title, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'cv' ELSE 'note' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN c_name || ' › ' || o_orderpriority ELSE c_name END AS shown,
 coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT l_partkey::VARCHAR AS p FROM lineitem WHERE l_orderkey = o_orderkey)), '') AS mentions FROM orders JOIN customer ON o_custkey = c_custkey""",
    "entity_evidence": """SELECT * FROM (SELECT l_partkey::VARCHAR AS entity_id, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END, o_orderkey % 7, o_orderkey)::INT AS position, o_orderkey AS id, o_orderstatus || ' ' || o_orderpriority AS text, c_name AS doc_title, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'cv' ELSE 'note' END AS kind
 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) WHERE position <= 6""",
    "view_graph": f"WITH {_EDGES} SELECT id, type, name, degree FROM v",
    "node_relations": f"""WITH {_EDGES}, n AS (SELECT s AS id, t, 'out' AS way, d AS other FROM e UNION ALL SELECT d, t, 'in', s FROM e),
l AS (SELECT n.id, CASE t || way WHEN 'DELIVEREDout' THEN 'Delivered projects' WHEN 'USEDout' THEN 'Skills used' WHEN 'HELD_ROLEin' THEN 'Held by' WHEN 'LOCATED_INout' THEN 'Location' END AS label, other, v.degree FROM n JOIN v ON v.id = other WHERE starts_with(n.id, 'role:') OR starts_with(n.id, 'org:'))
SELECT id, label, row_number() OVER (PARTITION BY id, label ORDER BY degree DESC, other)::INT AS position, other FROM l""",
    "profile_cards": """SELECT * FROM (SELECT person, row_number() OVER (PARTITION BY person ORDER BY strength DESC, name, id)::INT AS position, id, name, strength, evidence FROM (
 SELECT DISTINCT 'person:r' || n_regionkey AS person, 'skill:p' || p_partkey AS id, p_name AS name, round(p_size / 50, 2) AS strength, p_size % 7 AS evidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)) WHERE position <= 24""",
    "entity_catalog": f"""WITH {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY degree DESC, id) AS n FROM v WHERE type NOT IN ('Person')),
l AS (SELECT type, type || ': ' || string_agg(name, ', ' ORDER BY n) AS line FROM r WHERE n <= 160 GROUP BY type),
t AS (SELECT string_agg(line, chr(10) ORDER BY list_position(['Role', 'Organization', 'Project', 'Skill', 'Domain', 'Degree', 'Award', 'Language', 'Location'], type)) AS t FROM l) SELECT CASE WHEN len(t) <= 9000 THEN t ELSE rtrim(left(t, 8999)) || '…' END AS text FROM t""",
    "skill_texts": """WITH s AS (SELECT l_partkey, l_returnflag, n_name, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT l_partkey AS id, string_agg(n, '; ' ORDER BY n) AS r FROM (SELECT DISTINCT l_partkey, n_name AS n FROM s WHERE l_returnflag = 'A') GROUP BY 1), p AS (SELECT l_partkey AS id, string_agg(n, '; ' ORDER BY n) AS p FROM (SELECT DISTINCT l_partkey, o_orderpriority AS n FROM s WHERE l_returnflag = 'R') GROUP BY 1)
SELECT p_partkey AS id, concat_ws(' ', p_name || ' (' || CASE WHEN p_size > 10 THEN p_type ELSE 'skill' END || ').', CASE WHEN r IS NOT NULL THEN 'Used professionally (~' || printf('%.1f', round(p_size / 4 + 0.000001, 1)) || ' years) as: ' || r || '.' END, 'Used in projects: ' || p || '.',
 CASE WHEN p_size > 40 THEN 'Verified in source code / manifests on GitHub.' END, CASE WHEN p_size % 2 = 0 THEN 'Listed on the CV.' END) AS description FROM part LEFT JOIN r ON p_partkey = r.id LEFT JOIN p ON p_partkey = p.id""",
    "fit_items": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n, l_suppkey % 6 + 1 AS r FROM lineitem),
x AS (SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN list_filter([r, 2, 9], lambda y: y <= n) ELSE []::BIGINT[] END AS ev, CASE WHEN l_partkey % 3 = 0 THEN []::BIGINT[] WHEN r < 7 THEN range(r, 8) ELSE [7] END AS c FROM l)
SELECT l_orderkey AS job_id, idx::INT AS idx, l_partkey::VARCHAR AS requirement, CASE WHEN l_quantity > 25 THEN 'must' ELSE 'nice' END AS importance, CASE WHEN l_partkey % 3 = 0 THEN 'gap' ELSE 'strong' END AS status, CASE WHEN l_partkey % 3 = 0 THEN 'Not assessed.' ELSE 'As [' || r || '-7] shows.' END AS rationale,
 array_to_string(ev, ',') AS evidence, array_to_string(list_sort(list_distinct(list_concat(c, ev))), ',') AS cited FROM x""",
    "cited_sources": "SELECT DISTINCT l_orderkey AS qid, l_linenumber::INT AS ref, l_linenumber BETWEEN o_custkey % 5 + 1 AND o_custkey % 5 + 4 AS cited FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "ordered_parts": "SELECT o_custkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY k, l_partkey)::INT AS position FROM (SELECT o_custkey, l_partkey, min(o_orderkey) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "call_totals": "SELECT event_type AS model, count(*) AS requests, count(*) FILTER (WHERE event_id % 9 = 0) AS failures, sum(floor(value))::BIGINT AS input_tokens, sum(CASE WHEN event_id % 2 = 0 THEN floor(value / 2) ELSE 0 END)::BIGINT AS output_tokens, count(*) FILTER (WHERE user_id % 3 = 0) AS hits, count(*) FILTER (WHERE user_id % 3 <> 0) AS misses FROM events GROUP BY 1",
    "quota_errors": "SELECT event_id, CASE WHEN event_id % 4 IN (0, 2) THEN user_id + 0.5::DOUBLE END AS retry_after, event_id % 4 IN (1, 2) AS daily FROM events",
    "embedding_texts": """SELECT s_suppkey, left(concat_ws(' ', 'Organization: ' || s_name, '(also known as ' || (SELECT array_to_string(list_slice(list_sort(list(DISTINCT l_partkey::VARCHAR)), 1, 6), ', ') FROM lineitem WHERE l_suppkey = s_suppkey) || ')', CASE WHEN s_suppkey % 2 = 0 THEN '— ' || n_name END, CASE WHEN s_suppkey % 3 = 0 THEN n_name || ' ' || s_name END), 4000) AS embedding_text FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "unit_vectors": "SELECT vec_id, 1.0::DOUBLE AS length, round(list_max(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS largest FROM embeddings",
    "role_periods": """WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 3 AS a, o_orderkey % 4 AS b FROM orders), y AS (SELECT *, CASE a WHEN 0 THEN year(d) * 12 + month(d) WHEN 1 THEN year(d) * 12 + 1 END AS s, CASE b WHEN 0 THEN year(d) * 12 + month(d) ELSE 1999 * 12 + 6 END AS e FROM x)
SELECT o_orderkey, CASE a WHEN 0 THEN strftime(d, '%Y-%m') WHEN 1 THEN strftime(d, '%Y') ELSE '?' END || ' – ' || CASE b WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN 'soon' ELSE 'present' END AS period, CASE WHEN s IS NULL THEN 0.5 ELSE round(greatest(0.1, (e - s + 1) / 12.0::DOUBLE), 4) END AS years FROM y""",
    "distinctive_names": """SELECT DISTINCT p_partkey, name FROM (SELECT p_partkey, unnest([p_name, replace(p_brand, '#', ''), array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' '), replace(p_name, ' ', ''), left(p_brand, 5)]) AS name FROM part) WHERE len(name) >= 6 AND regexp_matches(name, '[0-9.+#/ -]|^[A-Z]')""",
    "near_vectors": f"WITH {_PAIRS} SELECT a, b, round(score, 5) AS score FROM p WHERE score >= 0.4",
    "merged_similar": f"""WITH RECURSIVE {_PAIRS}, q AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS i FROM p WHERE score >= 0.4), base AS (SELECT vec_id AS id, list_transform(range(vec_id % 4 + 1), lambda x: x + vec_id % 3) AS s FROM embeddings),
w AS (SELECT i, a, b, x.s AS sa, y.s AS sb FROM q JOIN base x ON x.id = a JOIN base y ON y.id = b),
t AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS d, NULL::BIGINT AS k, [0::BIGINT][2:] AS gone, MAP {{-1::BIGINT: [0::BIGINT]}} AS held
 UNION ALL SELECT i, CASE WHEN ok THEN CASE WHEN first THEN b ELSE a END END, CASE WHEN ok THEN CASE WHEN first THEN a ELSE b END END, CASE WHEN ok THEN list_append(gone, CASE WHEN first THEN b ELSE a END) ELSE gone END,
  CASE WHEN ok THEN map_concat(held, MAP {{CASE WHEN first THEN a ELSE b END: list_distinct(list_concat(na, nb))}}) ELSE held END
 FROM (SELECT *, a % 7 = 0 OR len(na) >= len(nb) AS first, NOT (list_contains(gone, a) OR list_contains(gone, b) OR a % 7 = 0 AND b % 7 = 0) AS ok FROM (
  SELECT w.i, a, b, gone, held, coalesce(held[a], sa) AS na, coalesce(held[b], sb) AS nb FROM t JOIN w ON w.i = t.i + 1))),
m AS (SELECT d, k FROM t WHERE d IS NOT NULL), r AS (SELECT d, k FROM m UNION ALL SELECT r.d, m.k FROM r JOIN m ON r.k = m.d)
SELECT d AS drop_id, k AS keep_id FROM r WHERE k NOT IN (SELECT d FROM m)""",
    "repo_edges": f"""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 1 THEN 'project:order-' || (o_orderkey - 1) ELSE 'project:order-' || o_orderkey END AS p FROM orders),
u AS (SELECT p, 'skill:' || {_SLUG.format('p_brand')} AS t, CASE WHEN p_size > 25 THEN 'code' ELSE 'topic' END AS via, CASE WHEN p_size > 25 THEN p_name ELSE 'topic' END AS ev FROM lineitem JOIN r ON l_orderkey = k JOIN part ON l_partkey = p_partkey WHERE p_size > 25 OR p_size <= 10)
SELECT DISTINCT 'person:x' AS source, 'BUILT' AS type, p AS target, '' AS via, '' AS evidence FROM r UNION ALL SELECT p, 'USES', t, min((via, ev))[1], min((via, ev))[2] FROM u GROUP BY p, t""",
    "first_documents": "SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM (SELECT DISTINCT l_orderkey AS repo, 'docs/guide-' || l_partkey || '.md' AS path FROM lineitem WHERE l_partkey % 3 = 2 AND l_returnflag <> 'N')) WHERE n <= 3",
    "profile_counts": f"""WITH x AS (SELECT l_orderkey, l_partkey, o_custkey, p_name, p_brand, p_size FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'entity' AS what, 'Person' AS type, count(*) AS n FROM c UNION ALL SELECT 'entity', 'Role', count(*) FROM orders UNION ALL SELECT 'entity', 'Project', count(DISTINCT (l_orderkey, l_partkey)) FROM x UNION ALL SELECT 'entity', 'Degree', count(*) FROM c UNION ALL SELECT 'entity', 'Award', count(*) FROM c
UNION ALL SELECT 'entity', 'Language', count(DISTINCT {_SLUG.format('n_name')}) FROM c UNION ALL SELECT 'entity', 'Domain', count(DISTINCT c_mktsegment) FROM c
UNION ALL SELECT 'entity', 'Location', count(*) FROM (SELECT {_SLUG.format('n_name')} FROM c UNION SELECT {_SLUG.format('o_orderstatus')} FROM orders WHERE o_orderkey % 2 = 0)
UNION ALL SELECT 'entity', 'Organization', count(*) FROM (SELECT {_SLUG.format('o_orderpriority')} FROM orders UNION SELECT {_SLUG.format('c_mktsegment')} FROM c UNION SELECT {_SLUG.format('n_name')} FROM c)
UNION ALL SELECT 'relation', 'HELD_ROLE', count(*) FROM orders UNION ALL SELECT 'relation', 'AT', (SELECT count(*) FROM orders) + (SELECT count(*) FROM c) UNION ALL SELECT 'relation', 'BUILT', count(DISTINCT (l_orderkey, l_partkey)) FROM x UNION ALL SELECT 'relation', 'DELIVERED', count(DISTINCT (l_orderkey, l_partkey)) FROM x WHERE p_size > 25
UNION ALL SELECT 'relation', 'STUDIED', count(*) FROM c UNION ALL SELECT 'relation', 'WON', count(*) FROM c UNION ALL SELECT 'relation', 'AWARDED_BY', count(*) FROM c UNION ALL SELECT 'relation', 'SPEAKS', count(*) FROM c
UNION ALL SELECT 'relation', 'LOCATED_IN', (SELECT count(*) FROM c) + (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) + (SELECT count(DISTINCT (o_orderpriority, o_orderstatus)) FROM orders WHERE o_orderkey % 2 = 0)
UNION ALL SELECT 'skill', 'LISTED', count(DISTINCT n_name) FROM c UNION ALL SELECT 'skill', 'USED', count(DISTINCT (l_orderkey, p_name)) FROM x UNION ALL SELECT 'skill', 'USES', count(DISTINCT (l_orderkey, l_partkey, p_brand)) FROM x
UNION ALL SELECT 'document', 'cv', 3 * (SELECT count(*) FROM c) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT (l_orderkey, l_partkey)) FROM x)""",
    "extraction_edges": f"""WITH x AS (SELECT l_orderkey AS k, p_name, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT k::VARCHAR AS source, CASE WHEN k % 2 = 1 THEN 'USES' ELSE 'USED' END AS type, t AS target, min(p_type) AS how FROM (SELECT k, unnest(['skill:' || {_SLUG.format('p_name')}, 'skill:' || {_SLUG.format('p_brand')}]) AS t, p_type FROM x) GROUP BY ALL
UNION ALL SELECT DISTINCT 'skill:' || {_SLUG.format('p_name')}, 'RELATED_TO', 'skill:' || {_SLUG.format('p_brand')}, '' FROM x""",
}
