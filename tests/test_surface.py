"""What a user sees: summaries, contexts, documents of repositories, chunk tables, and the calls that compose them."""

import pytest

from lodestar.operators import link, repos, retrieve, surface, view


@pytest.fixture(scope="module")
def corpus(spark):
    nodes = spark.createDataFrame([("s:a", "Skill", "Alpha", "a skill", None, 1), ("s:b", "Skill", "Beta", "", ["Second"], 2), ("p:x", "Project", "Xenon", "a project", None, 3), ("me", "Person", "Pat", "", None, 4)], "id string, type string, name string, text string, aliases array<string>, seq long")
    edges = spark.createDataFrame([("p:x", "USES", "s:a"), ("s:a", "RELATED_TO", "s:b"), ("me", "BUILT", "p:x")], "source string, type string, target string")
    chunks = spark.createDataFrame([(1, "One", "Alpha was used"), (2, "Two", "something of Beta"), (3, "Three", "nothing")], "id long, title string, text string")
    mentions = spark.createDataFrame([(1, "s:a"), (2, "s:b")], "chunk_id long, entity_id string")
    return retrieve.Corpus(nodes.select("id", "type", "name", "text"), edges, chunks, mentions, names=nodes.select("id", "type", "name", "aliases", "seq"))


def test_summary(spark):
    rows = [("a", "Skill", "A", "x" * 500, "u", {"category": "tool", "secret": "1", "level": ""}), ("b", "Role", "B", "", "", None)]
    df = spark.createDataFrame(rows, "id string, type string, name string, description string, url string, props map<string,string>")
    found = {r.id: r for r in view.summary(df).collect()}
    assert found["a"].description == "x" * 400 and found["a"].extras == {"category": "tool"} and found["a"].url == "u"
    assert found["b"].description is None and found["b"].url is None and found["b"].extras == {}


def test_all_communities(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9)], "id string, size int")
    assert [r.id for r in view.all_communities(df).collect()] == ["c", "a", "b"]


def test_repository_docs(spark):
    r = spark.createDataFrame([("one", "project:one", "One"), ("two", "project:two", "Two")], "repo string, project_id string, name string")
    routed = spark.createDataFrame([("one", "README.md", "readme", "hello"), ("one", "docs/LICENSE.md", "docs", "no"), *[("one", f"docs/{c}.md", "docs", c) for c in "dcba"], ("two", "go.mod", "manifest", "m")], "repo string, path string, route string, text string")
    profiles = spark.createDataFrame([("one", "p1"), ("two", "p2")], "repo string, text string")
    found = {d.id: d for d in repos.repository_docs(r, routed, profiles).collect()}
    assert set(found) == {"github:one:readme", "github:one:docs-a-md", "github:one:docs-b-md", "github:one:docs-c-md", "github:one:analysis", "github:two:analysis"}
    assert found["github:one:readme"].title == "GitHub — One (README)" and found["github:one:readme"].extract and found["github:one:readme"].describes == ["project:one"]
    assert not found["github:one:docs-a-md"].extract and found["github:one:docs-a-md"].kind == "doc"
    assert not found["github:one:analysis"].extract and found["github:two:analysis"].extract  # a profile is read only where no readme is


def test_chunk_table(spark):
    docs = spark.createDataFrame([("d1", "Doc", "# Intro\n\n" + "We used Alpha and Beta here. " * 5, ["p:x", "gone"]), ("d2", "Empty", "", ["p:x"])], "id string, title string, text string, describes array<string>")
    labels = spark.createDataFrame([("s:a", "Alpha", 0), ("s:z", "Zeta", 0)], "entity_id string, label string, priority int")
    known = spark.createDataFrame([("s:a",), ("p:x",)], "id string")
    chunks, met = repos.chunk_table(docs, labels, known)
    assert {c.id for c in chunks.collect()} == {"d1#0"}
    assert {(m.chunk_id, m.entity_id) for m in met.collect()} == {("d1#0", "s:a"), ("d1#0", "p:x")}


def test_passages_come_through_entities_too(spark, corpus):
    """Alpha hits passage 1 alone; the walk reaches Beta, whose first passage joins the candidates."""
    found = retrieve.hybrid(corpus, spark.createDataFrame([(1, 0, "alpha")], "qid long, sub int, text string"))
    assert [r.id for r in found.passages.orderBy("rank").collect()] == [1, 2]
    assert {r.id for r in found.seeds.collect()} == {"s:a"} and [r.degraded for r in found.flags.collect()] == [True]


def test_context(spark, corpus):
    found = retrieve.hybrid(corpus, spark.createDataFrame([(1, 0, "alpha")], "qid long, sub int, text string"))
    text = retrieve.context(found, corpus.nodes).first().context
    assert text.startswith("## Evidence passages\n[1] One\nAlpha was used\n\n[2] Two\nsomething of Beta\n\n## Knowledge-graph entities\n[3] Skill: Alpha\na skill\n")
    assert text.endswith("## Relations between the retrieved entities\n- Xenon —USES→ Alpha\n- Alpha —RELATED_TO→ Beta")


def test_ask_and_search(spark, corpus):
    asked = spark.createDataFrame([(1, 0, "what about Alpha?"), (2, 0, "quel projet ?"), (3, 0, "zzz")], "qid long, sub int, text string")
    answers = {r.qid: r.answer for r in surface.ask(corpus, asked).collect()}
    assert answers[1].startswith(retrieve.HEADERS["en"] + "- **One** — Alpha was used [1]") and answers[2].startswith(retrieve.HEADERS["fr"])
    assert answers[3] == retrieve.HEADERS["en"] + retrieve.NOTHING
    first = surface.search(corpus, asked, limit=2).where("qid = 1").orderBy("ref").collect()
    assert [(r.ref, r.kind, r.id) for r in first] == [(1, "passage", "1"), (2, "passage", "2")]


def test_entity_detail(spark, corpus):
    nodes = corpus.nodes.selectExpr("id", "type", "name", "text AS description", "CAST(NULL AS STRING) AS url", "CAST(NULL AS MAP<STRING, STRING>) AS props", "1.0D AS pagerank")
    about, near = surface.entity_detail(spark.createDataFrame([("second",), ("nobody",)], "name string"), nodes, corpus.edges, link.name_index(corpus.names))
    assert [(r.id, r.name) for r in about.collect()] == [("s:b", "Beta")]
    assert [(r.id, r.other) for r in near.collect()] == [("s:b", "s:a")]


def test_fit_and_profile(spark, corpus):
    requirements = spark.createDataFrame([(1, 1, "Alpha", "must"), (1, 2, "Gamma", "nice")], "job_id int, idx int, requirement string, importance string")
    grades = spark.createDataFrame([(1, 1, "strong", "as shown [2] [9]", [2, 7])], "job_id int, idx int, status string, rationale string, evidence array<int>")
    scores, items = surface.fit(requirements, grades, spark.createDataFrame([(1, 2)], "job_id int, ref int"))
    assert (scores.first().percent, scores.first().strong, scores.first().gap) == (67, 1, 1)
    assert [(r.idx, r.status, r.evidence, r.cited) for r in items.orderBy("idx").collect()] == [(1, "strong", [2], [2, 9]), (2, "gap", [], [])]
    skilled = spark.createDataFrame([("me", "HAS_SKILL", "s:b", 0.5, 1), ("me", "HAS_SKILL", "s:a", 0.9, 2)], "source string, type string, target string, strength double, evidence int")
    projects = spark.createDataFrame([("p:x", "Xenon", None, "d", True), ("p:y", "Y", None, "d", False)], "id string, name string, url string, description string, featured boolean")
    best, shown = surface.profile(corpus.nodes, skilled, projects)
    assert [r.name for r in best.orderBy("position").collect()] == ["Alpha", "Beta"] and [r.id for r in shown.collect()] == ["p:x"]
