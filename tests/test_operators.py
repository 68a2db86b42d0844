"""Operators that SQL does not reach, against small brute-force forms and hand-made cases."""

import os
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import community, detect, documents, graph, guard, link, repos, resolve, retrieve, surface, view
from lodestar.plans import live
from lodestar.sources import publish
from lodestar.sources.tables import table
from lodestar.streaming import state


def one(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_clean_markdown(spark):
    code = "a\n```sh\nx = 1\n```\nb"
    long = "a\n```\n" + "l\n" * 9 + "```\nb"
    cases = {code: "a\n```\nx = 1\n```\nb", long: "a\n\nb", "a\n```\nrest\nrest": "a", "x <!-- y\nz --> w": "x  w", "[![b](u)](v) t ![i](j)": "t", "<div class='a'>t</div>\n\n\n\nu  ": "t\n\nu", "a\n┌──┐\nb": "a\nb", "": "", "   ": ""}
    assert one(spark, documents.clean_markdown, [*cases, None]) == [*cases.values(), None]
    assert one(spark, documents.clean_markdown, ["x\n```\n" + "line\n" * 200_000 + "```\ny"]) == ["x\n\ny"]


def test_chunks(spark):
    para = "word " * 50
    text = "intro " * 20 + "\n\n# One\n\n" + para + "\n\n" + para + "\n\n## Two\n\nsmall\n\n# **Three**\n\n" + "x" * 3000 + "\n\n#### Deep\n\n" + "deep " * 30
    rows = documents.chunk(spark.createDataFrame([(1, "T", text), (2, "T", None), (3, "T", " "), (4, "T", "short")], "doc_id long, title string, text string"), most=400).orderBy("ord").collect()
    assert {r.doc_id for r in rows} == {1}
    assert [r.title for r in rows][:3] == ["T", "One", "One"] and rows[-1].title == "Three › Deep"
    assert not any("small" in r.text for r in rows)  # tiny, under another title
    assert "".join(r.text for r in rows if r.title == "Three") == "x" * 3000
    assert all(len(r.text) <= 400 for r in rows)


def test_mentions_prefer_long_labels(spark):
    docs = spark.createDataFrame([(1, "We use Spark SQL and spark-like things, node.js, C++ and Go; go home"), (2, None), (3, "Xspark spark")], "id long, text string")
    labels = spark.createDataFrame([("a", "Spark", 0), ("b", "Spark  SQL", 0), ("c", "Node.js", 0), ("d", "C++", 0), ("e", "Go", 0), ("f", "spark", 1), ("g", "js", 0)], "entity_id string, label string, priority int")
    found = {(r.chunk_id, r.entity_id) for r in documents.mentions(docs, labels).collect()}
    assert found == {(1, "b"), (1, "c"), (1, "d"), (1, "e"), (3, "a")}


def test_mentions_by_trie_and_by_join(spark, monkeypatch):
    """Both ways give the same on random texts with marks, dots, hyphens, accents and labels that begin alike."""
    rng = random.Random(6)
    words = ["go", "Go", "GO", "node", "Node.js", "node.js", "js", "c++", "C++", "été", "Été", "a-b", "a", "b", "x_y", "straße", "STRASSE", "(x)", "one two", "one  two three", "two three"]
    labels = spark.createDataFrame([(f"e{i:02}", w, rng.randrange(3)) for i, w in enumerate(words * 2)], "entity_id string, label string, priority int")
    texts = [rng.choice([" ", "-", ".", ", ", "\n", ""]).join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["", None, "one two\tthree", "Node.JS."]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id long, text string")
    found = sorted(map(tuple, documents.mentions(docs.where("id % 2 = 0").withColumn("id", F.xxhash64("text")), labels).collect()))
    monkeypatch.setattr(documents, "TRIE_LETTERS", 0)
    assert found == sorted(map(tuple, documents.mentions(docs.where("id % 2 = 0").withColumn("id", F.xxhash64("text")), labels).collect())) and len(found) > 200


def test_guard(spark):
    good = ["MATCH (s:Skill) RETURN s.name LIMIT 5;", "MATCH (s {name: 'Data set CREATE'}) RETURN s"]
    bad = ["MATCH (n) DETACH DELETE n RETURN 1", "CREATE (n) RETURN n", "MATCH (n) RETURN n; MATCH (m) RETURN m", "call db.labels() YIELD x RETURN x", "MATCH (n)", " ; ", None]
    found = one(spark, guard.refusal, good + bad)
    assert found[:2] == [None, None] and all(found[2:])
    views = {"entity": spark.range(100).toDF("id")}
    assert guard.ask(spark, "SELECT id FROM entity -- all", views, 7).count() == 7
    with pytest.raises(Exception):
        guard.ask(spark, "DROP VIEW entity", views)


def test_communities(spark):
    pairs = [(f"n{g}{i}", f"n{g}{j}") for g in range(3) for i in range(5) for j in range(i)] + [("n00", "n10"), ("n10", "n20")]
    edges = spark.createDataFrame([(a, "USES", b) for a, b in pairs] + [("p", "USES", "n00")], "source string, type string, target string")
    nodes = spark.createDataFrame([(x, "Skill", x) for x in sorted({v for p in pairs for v in p})] + [("p", "Person", "p"), ("alone", "Skill", "alone")], "id string, type string, name string")
    member = community.communities(edges, nodes)
    assert {(r.id, r.community) for r in member.collect()} == {(f"n{g}{i}", f"n{g}0") for g in range(3) for i in range(5)}
    card = community.cards(member, edges, nodes).orderBy("community").first()
    assert card["size"] == 5 and card.title == "n00 · n01 · n02"


def test_manifests(spark):
    files = [
        ("a", "package.json", '{"dependencies": {"React": "1"}, "devDependencies": {"jest": "2"}}'), ("a", "bad/package.json", "{oops"), ("a", "requirements-dev.txt", "# c\nnumpy>=1\n"), ("a", "pyproject.toml", '[project]\ndependencies = ["pandas>=2", "torch"]\n'),
        ("a", "Dockerfile", "FROM docker.io/library/postgres:16 AS db\n"), ("a", "k8s/d.yaml", "apiVersion: apps/v1\nkind: Deployment\n"), ("a", "app/build.gradle", "implementation 'com.x:y:1.0'"), ("a", "pubspec.yaml", "dependencies:\n  http: ^1.0\n"), ("a", "src/package.py", "numpy"), ("a", "null/package.json", None),
    ]
    names = {("npm", "react"): "React", ("npm", "jest"): "Jest", ("pypi", "numpy"): "NumPy", ("pypi", "pandas"): "pandas", ("pypi", "torch"): "PyTorch", ("docker", "postgres"): "PostgreSQL", ("kind", "deployment"): "Kubernetes", ("maven", "com.x:y"): "Y", ("pub", "http"): "http", ("npm", "absent"): "no"}
    df = spark.createDataFrame([(r, p, len(t or ""), t) for r, p, t in files], "repo string, path string, size long, text string")
    packages = spark.createDataFrame([(*k, v) for k, v in names.items()], "ecosystem string, name string, technology string")
    assert {r.technology for r in detect.manifest_technologies(df, packages).collect()} == set(names.values()) - {"no"}


def test_publish_and_cache(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Skill", "A"), ("b", None, None)], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "USES", "b"), ("a", "USES", "gone")], "source string, type string, target string")
    g = {"entities": nodes, "relations": edges}
    path = str(tmp_path / "graph")
    version, written = publish.publish(spark, g, path)
    assert written and publish.publish(spark, {k: v.repartition(3) for k, v in g.items()}, path) == (version, False)
    assert publish.publish(spark, {**g, "entities": nodes.where("id = 'a'")}, path)[1]
    assert publish.load(spark, path)["relations"].count() == 0

    def fn(batches):
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "n": b["t"].str.len()})

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "t string")
    cache = str(tmp_path / "cache")
    first, misses = publish.cached_enrich(texts("aa", "aa", "b"), ["t"], cache, fn, "n long")
    assert misses == 2 and sorted(map(tuple, first.collect())) == [("aa", 2), ("aa", 2), ("b", 1)]
    assert publish.cached_enrich(texts("b", "ccc"), ["t"], cache, fn, "n long")[1] == 1


def test_two_publishers(spark, tmp_path, monkeypatch):
    """Of two that began from one version the second to finish is overtaken and changes nothing; readers see whole versions,
    and a pointer that was left empty is passed over."""
    path, of = str(tmp_path / "g"), lambda *ids: {"entities": spark.createDataFrame([(i, "Skill", i) for i in ids], "id string, type string, name string"), "relations": spark.createDataFrame([], "source string, type string, target string")}
    first = publish.publish(spark, of("a"), path)[0]
    looked = publish._newest(spark, path)
    second = publish.publish(spark, of("a", "b"), path)[0]
    seen = publish._newest
    monkeypatch.setattr(publish, "_newest", lambda s, p, answers=[looked]: answers.pop() if answers else seen(s, p))  # began before the second
    with pytest.raises(publish.Overtaken):
        publish.publish(spark, of("c"), path)
    monkeypatch.undo()
    assert first != second == publish.current(spark, path) and {r.id for r in publish.load(spark, path)["entities"].collect()} == {"a", "b"}
    with pytest.raises(publish.Overtaken):  # at the last moment: the number is taken
        publish._point(spark, path, looked.number + 1, "x", "y")
    (tmp_path / "g" / "versions" / "000000000003").touch()
    assert publish.current(spark, path) == second
    with pytest.raises(publish.Overtaken):  # it may be about to be written
        publish.publish(spark, of("c"), path)
    os.utime(tmp_path / "g" / "versions" / "000000000003", (0, 0))
    third = publish.publish(spark, of("c"), path)[0]
    assert publish.current(spark, path) == third and publish._newest(spark, path).number == 4


def test_repo_files_and_notes(spark, tmp_path):
    for name, content in {"r/README.md": b"# Hi", "r/src/a.py": "é".encode(), "r/node_modules/x.js": b"x", "r/l.txt": b"\xe9", "r/b.bin": b"a\x00b", "r/big.txt": b"x" * 200_001}.items():
        (tmp_path / "repos" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repos" / name).write_bytes(content)
    found = {(r.repo, r.path): r.text for r in publish.read_repo_files(spark, str(tmp_path / "repos")).collect()}
    assert found == {("r", "README.md"): "# Hi", ("r", "src/a.py"): "é", ("r", "l.txt"): "é"}
    (tmp_path / "notes").mkdir()
    for name, text in {"A b.md": "x\n## Title\ny", "b.md": "none", "README.md": "# no"}.items():
        (tmp_path / "notes" / name).write_text(text)
    assert {(r.id, r.title) for r in publish.read_notes(spark, str(tmp_path / "notes")).collect()} == {("note:a-b", "Note — Title"), ("note:b", "Note — b")}


@pytest.mark.parametrize("rule", ["limit", "cache", "breaker"])
def test_stream_is_batch(spark, sf_dir, tmp_path, rule):
    rules = {"limit": state.sliding_limit(live.MOST, live.PER_DAY, live.WINDOW), "cache": state.ttl_cache(live.TTL), "breaker": state.breaker_rule(100_000.0, 900_000.0)}
    events = table(spark, sf_dir, "events").where("user_id < 20").orderBy("ts", "event_id").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = live.calls(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = state.follow(stream, rules[rule]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    calls = live.calls(events)
    batch = state.breaker(calls, 100_000.0, 900_000.0) if rule == "breaker" else state.replay(calls, rules[rule])
    tidy = lambda df: sorted(tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert tidy(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)) == tidy(batch)


def test_limit_cost(spark):
    rows = [("ip", 0, 1, 1), ("ip", 1, 2, 2), ("ip", 2, 3, 1), ("other", 3, 4, 1), ("ip", 70, 5, 3), (None, 71, 6, 1)]
    df = spark.createDataFrame(rows, "key string, s int, event_id long, cost int").withColumn("ts", F.timestamp_seconds("s"))
    found = {r.event_id: (r.accepted, r.retry_after) for r in state.replay(df, state.sliding_limit(3, 10)).collect()}
    assert found == {1: (True, None), 2: (True, None), 3: (False, 58.0), 4: (True, None), 5: (True, None), 6: (True, None)}
    assert state.replay(df.limit(0), state.sliding_limit(3, 10)).count() == 0


@pytest.mark.parametrize("fuzzy", [True, False])
def test_search_by_a_stored_index(spark, tmp_path, monkeypatch, fuzzy):
    """Small blocks in several runs give what a scan of the texts gives, and blocks that cannot matter are not read."""
    from lodestar.operators import search

    monkeypatch.setattr(search, "POSTINGS", 3)
    monkeypatch.setattr(search, "ORDERED", 40)
    rng = random.Random(2)
    words = ["kitchen", "kitchens", "kichten", "garden", "gardens", "river", "a1", "stone", "bridge", "common"]
    docs = spark.createDataFrame([(i, None if i == 3 else " ".join(rng.choice([*words, "common", "common"]) for _ in range(rng.randint(0, 40)))) for i in range(150)], "id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(12)] + [(50, "nowhere"), (51, None)], "qid long, text string")
    publish.publish(spark, search.text_index(docs), str(tmp_path))
    index = publish.tables(spark, str(tmp_path), ("totals", "vocabulary", "postings"))
    found = search.bm25_indexed(index, asked, 3, fuzzy)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.bm25(docs, asked, 3, fuzzy).select(*found.columns).collect()))
    assert index["postings"].where("block >= 4294967296").count() > 0 and index["postings"].agg(F.max(F.size("posted"))).first()[0] == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and search.bm25_indexed({**index, "postings": index["postings"].limit(0)}, asked, 3, fuzzy).count() == 0


def test_hybrid(spark):
    """Seeds, walk, focus and passages of a small corpus, recomputed in plain Python."""
    nodes = [("s:a", "Skill", "alpha"), ("s:b", "Skill", "beta"), ("s:c", "Skill", "gamma"), ("p", "Person", "pat")]
    edges = [("s:a", "RELATED_TO", "s:b"), ("s:b", "USES", "s:c"), ("p", "USES", "s:a")]
    texts = {1: "alpha work alpha", 2: "gamma notes", 3: "other words", 4: "beta and alpha"}
    ents = {1: ["s:a"], 2: ["s:c"], 4: ["s:a", "s:b"]}
    c = retrieve.Corpus(
        spark.createDataFrame([(*n, "") for n in nodes], "id string, type string, name string, text string"), spark.createDataFrame(edges, "source string, type string, target string"),
        spark.createDataFrame([(i, "t", t) for i, t in texts.items()], "id long, title string, text string"), spark.createDataFrame([(i, e) for i, es in ents.items() for e in es], "chunk_id long, entity_id string"),
    )
    found = retrieve.hybrid(c, spark.createDataFrame([(7, 0, "alpha"), (7, 1, " "), (8, 0, "nothing")], "qid long, sub int, text string"))
    rrf = {1: 1 / 61, 4: 1 / 62}
    seed = {"s:a": 1 + 15 * (1 / 61 + 1 / 62), "s:b": 15 / 62}
    assert {r.id: r.score for r in found.seeds.collect()} == pytest.approx(seed, abs=1e-6)
    walk = {"s:a": {"s:b": 1.0}, "s:b": {"s:a": 0.7 / 1.7, "s:c": 1 / 1.7}, "s:c": {"s:b": 1.0}}
    start = {k: v / sum(seed.values()) for k, v in seed.items()}
    rank = dict(start)
    for _ in range(60):
        rank = {n: 0.5 * start.get(n, 0) + 0.5 * sum(rank.get(m, 0) * out.get(n, 0) for m, out in walk.items()) for n in walk}
    assert [r.id for r in found.focus.orderBy("position").collect()] == sorted(rank, key=lambda n: -rank[n])
    mass = {i: sum(rank[e] for e in ents[i]) for i in ents}
    score = {i: 0.6 * rrf.get(i, 0) * 61 + 0.4 * mass[i] / max(mass.values()) for i in ents}
    assert {r.id: r.score for r in found.passages.collect()} == pytest.approx(score, abs=1e-5)
    kinds = [(r.ref, r.kind) for r in found.sources.orderBy("ref").collect()]
    assert kinds == [(i + 1, "passage" if i < 3 else "entity") for i in range(6)]
    assert {r.qid for r in found.sources.collect()} == {7} and found.links.count() == 2
    answer = retrieve.extractive_answer(found.sources).first().answer
    assert answer.startswith(f"- **t** — {texts[max(score, key=score.get)]} [1]\n- ") and answer.count("\n") == 5
    assert retrieve.payload(found).first().seeds == ["s:a", "s:b"]


def exact_ranks(walk, ids, seeds, damping=0.5, steps=400):
    """The plain power iteration, for one query."""
    known = {i: v for i, v in seeds.items() if i in ids and v > 0} or dict.fromkeys(ids, 1.0)
    start = {i: v / sum(known.values()) for i, v in known.items()}
    rank = dict(start)
    for _ in range(steps):
        lost = sum(v for i, v in rank.items() if i not in walk)
        new = {n: start.get(n, 0) * (1 - damping + damping * lost) for n in ids}
        for m, out in walk.items():
            for n, p in out.items():
                new[n] += damping * rank.get(m, 0) * p
        rank = new
    return rank


def as_walk(spark, walk):
    return spark.createDataFrame([(a, b, p) for a, out in walk.items() for b, p in out.items()], "source string, target string, p double")


def test_pagerank_with_lone_seeds(spark):
    """Seeds without edges hold and give back mass; unknown seeds and none restart everywhere."""
    walk = {"a": {"b": 1.0}, "b": {"a": 0.25, "c": 0.75}, "c": {"b": 1.0}}
    seeds = {"q": {"a": 1.0, "x": 2.0, "y": 1.0}, "r": {"x": 3.0}, "s": {"c": 1.0, "zz": 5.0}, "t": {"a": -1.0}}
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "id string")
    df = spark.createDataFrame([(q, i, v) for q, vs in seeds.items() for i, v in vs.items()], "qid string, id string, weight double")
    expect = {(q, i): v for q, vs in seeds.items() for i, v in exact_ranks(walk, "abcxy", vs).items() if v}
    found = {(r.qid, r.id): r["rank"] for r in graph.pagerank(as_walk(spark, walk), nodes, df, 0.5, 1e-12).collect()}
    assert found == pytest.approx(expect, abs=1e-10)


@pytest.mark.parametrize("hub", [10_000, 3])
def test_pushed_ranks_lack_no_more_than_what_is_left(spark, monkeypatch, hub):
    """At any bound each rank is at most the true one, and together they lack at most 1 less their sum; hubs of few edges
    are dealt over several keys with the same result."""
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(3)
    weights = {}
    for i in range(60):
        for j in [rng.randrange(60) for _ in range(2)] + [0]:
            if i != j:
                weights[i, j] = weights[j, i] = weights.get((i, j), rng.choice([0.3, 1.0, 0.7]))
    walk = {}
    for (i, j), w in weights.items():
        walk.setdefault(str(i), {})[str(j)] = w / sum(v for (a, _), v in weights.items() if a == i)
    ids = [str(i) for i in range(60)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    df = spark.createDataFrame([("a", "7", 1.0), ("b", "0", 2.0), ("b", "9", 1.0)], "qid string, id string, weight double")
    exact = {"a": exact_ranks(walk, ids, {"7": 1.0}), "b": exact_ranks(walk, ids, {"0": 2.0, "9": 1.0})}
    for least in (0.05, 1e-6):
        found = {"a": {}, "b": {}}
        for r in graph.pagerank(as_walk(spark, walk), nodes, df, 0.5, least).collect():
            found[r.qid][r.id] = r["rank"]
        for q, ranks in found.items():
            lacks = [exact[q][i] - ranks.get(i, 0.0) for i in ids]
            assert min(lacks) > -1e-12 and sum(lacks) <= 1 - sum(ranks.values()) + 1e-12
    assert max(lacks) < 1e-5


def test_global_pagerank_to_the_end(spark):
    """Chebyshev's steps end where plain ones do; nodes without edges share what they would give back."""
    nodes = spark.createDataFrame([(n, "Person" if n == "x" else "Skill") for n in "abcdx"], "id string, type string")
    weights = {("a", "b"): 2.0, ("b", "c"): 5.0, ("b", "d"): 3.0, ("c", "d"): 4.0}
    both = {**weights, **{(b, a): w for (a, b), w in weights.items()}}
    walk = {i: {j: w / sum(v for (x, _), v in both.items() if x == i) for (a, j), w in both.items() if a == i} for i in "abcd"}
    plain = exact_ranks(walk, "abcdx", {}, 0.85)
    found = {r.id: r.pagerank for r in graph.global_pagerank(as_walk(spark, walk), nodes, digits=12).collect()}
    assert found.pop("x") == pytest.approx(1.6 * max(plain.values()), abs=1e-8)
    assert found == pytest.approx({i: v for i, v in plain.items() if i != "x"}, abs=1e-8)


def test_shortest_paths_from_both_ends(spark):
    """Against a plain search over all paths: hubs, ties, ends that are hubs, unknown ends, loops, odd and even lengths."""
    import itertools

    rng = random.Random(9)
    ids = [f"n{i:02}" for i in range(26)]
    hubs = {"n03", "n11"}
    links = {tuple(sorted(rng.sample(ids, 2))) for _ in range(30)}
    near = {i: sorted({b for x in links for a, b in (x, x[::-1]) if a == i}) for i in ids}

    def plain(s, t):
        front = [(s,)]
        for _ in range(7):
            hit = [p for p in front if p[-1] == t]
            if hit:
                return min(hit)
            front = [(*p, n) for p in front if len(p) == 1 or p[-1] not in hubs for n in near.get(p[-1], []) if n not in p]
        return None

    nodes = spark.createDataFrame([(i, "Domain" if i in hubs else "Skill") for i in ids], "id string, type string")
    edges = spark.createDataFrame([(a, "R", b) for a, b in links] + [("n00", "R", "n00")], "source string, type string, target string")
    asked = [*itertools.product(ids, ids), ("n01", "zz"), ("zz", "zz")]
    found = {(r.source, r.target): tuple(r.path) for r in graph.shortest_paths(edges, nodes, spark.createDataFrame(asked * 2, "source string, target string")).collect()}
    expect = {(s, t): p for s, t in asked if (p := plain(s, t)) and len(p) <= 7}
    assert found == expect and max(map(len, expect.values())) > 5


def test_fit_score_at_any_partitioning(spark):
    """Halves are rounded to even exactly, whatever the order of the rows."""
    from lodestar.operators import evidence

    rng = random.Random(1)
    rows = [(j, i, rng.choice(["must", "nice", None]), rng.choice(["strong", "partial", "transferable", "gap", None])) for j in range(300) for i in range(rng.randint(1, 12))]
    value = {"strong": 20, "partial": 12, "transferable": 7}
    expect = {}
    for j in range(300):
        own = [r for r in rows if r[0] == j]
        expect[j] = round(Fraction(100 * sum((2 if r[2] == "must" else 1) * value.get(r[3], 0) for r in own), 20 * sum(2 if r[2] == "must" else 1 for r in own)))
    df = spark.createDataFrame(rows, "job_id int, idx int, importance string, status string")
    for n in (1, 3, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found = {r.job_id: r.percent for r in evidence.fit_score(df.drop("status").repartition(n), df.drop("importance").repartition(n)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert found == expect


def test_resolve(spark):
    names = lambda rows, s: spark.createDataFrame(rows, s)
    raw = names([("* React 19", 1), ("reactjs", 2), ("Own Thing", 3), ("tools", 4), ("x" * 61, 5), (None, 6), ("C++ (planned)", 7), ("Mine", 8)], "name string, seq long")
    found = resolve.canonical(raw, names([("react", "React", 1), ("React.js", "React", 2), ("cpp", "C++", 3)], "alias string, label string, seq long"), names([("skill:z", "mine", None, 1)], "id string, name string, aliases array<string>, seq long"), names([("Tools",)], "name string"))
    assert {r.name: (r.id, r.label) for r in found.collect()} == {"* React 19": ("skill:react", "React"), "reactjs": ("skill:react", "React"), "Own Thing": ("skill:own-thing", "Own Thing"), "C++ (planned)": ("skill:cpp", "C++"), "Mine": ("skill:z", "Mine")}


def test_slugs_keep_plus_and_sharp_apart(spark):
    assert one(spark, text.slugify, ["C", "C++", "C#", "F#", "Node.js", "++", "Café au lait"]) == ["c", "cpp", "csharp", "fsharp", "node-js", "pp", "cafe-au-lait"]
    assert one(spark, text.citation_refs, ["[2;5]", "[7; 2, 4-6]", "[3;4](u)", "[1-2-4] [20-40] [9-3] [4–6]", None]) == [[2, 5], [2, 4, 5, 6, 7], [], [1, 2, 3, 4, 5, 6, 9, 20, 40], None]
    raw = spark.createDataFrame([("C", 1), ("C++", 2), ("C#", 3)], "name string, seq long")
    listed = spark.createDataFrame([], "alias string, label string, seq long")
    known = spark.createDataFrame([], "id string, name string, aliases array<string>, seq long")
    found = resolve.skills(raw, listed, known, spark.createDataFrame([], "name string")).collect()
    assert {(r.id, r.label) for r in found} == {("skill:c", "C"), ("skill:cpp", "C++"), ("skill:csharp", "C#")}


def test_streams_of_budgets_silences_and_blocks(spark):
    rows = [("a", 0, 1, 3, "text"), ("a", 5, 2, 3, "tool"), ("a", 40, 3, 1, "text"), ("a", 41, 4, 1, "reasoning"), ("b", 41, 5, 1, "failure"), ("a", 90_000, 6, 4, "text")]
    df = spark.createDataFrame(rows, "key string, s int, event_id long, cost int, kind string").withColumn("ts", F.timestamp_seconds("s"))
    of = lambda rule, *c: {r.event_id: tuple(r[x] for x in c) for r in state.replay(df, rule).collect()}
    assert of(state.daily_budget(4), "accepted", "used") == {1: (True, 3), 2: (False, 3), 3: (True, 4), 4: (False, 4), 5: (True, 1), 6: (True, 4)}
    assert of(state.silences(10.0), "n", "last") == {1: (0, None), 2: (0, None), 3: (3, 35.0), 4: (0, None), 5: (0, None), 6: (8995, 89991.0)}
    assert of(state.block_rule(), "block") == {1: (1,), 2: (None,), 3: (1,), 4: (2,), 5: (None,), 6: (3,)}


def test_linking(spark):
    nodes = spark.createDataFrame([("s", "Skill", "Graph Neural Network", ["GNN"], 2), ("p", "Project", "GNN", None, 1), ("l", "Skill", "LLMs", None, 3), ("x", "Person", "Ada", None, 4)], "id string, type string, name string, aliases array<string>, seq long")
    index = link.name_index(nodes)
    asked = spark.createDataFrame([("gnn",), ("LLM",), ("graph-neural networks",), ("llmss",), ("?",)], "name string")
    assert {r.name: r.id for r in link.lookup(asked, index).collect()} == {"gnn": "s", "LLM": "l", "graph-neural networks": "s", "llmss": "l"}
    questions = spark.createDataFrame([(1, "Does Ada know LLM, graph neural network?"), (2, "with the and"), (3, None)], "qid long, text string")
    assert [(r.qid, r.id, r.position) for r in link.mentioned(questions, index).orderBy("position").collect()] == [(1, "s", 1), (1, "l", 2)]


def test_repository_texts(spark):
    repo = spark.createDataFrame([("r", "about", ["x"], "2024-01-02T", None)], "repo string, description string, topics array<string>, created_at string, pushed_at string")
    langs = spark.createDataFrame([("r", "Go", 75, 1), ("r", "C", 25, 2)], "repo string, language string, bytes long, position int")
    tech = spark.createDataFrame([("r", "Kafka", "go.mod")], "repo string, technology string, evidence string")
    files = spark.createDataFrame([("r", "a.go"), ("r", "ios/b.go"), ("r", "pubspec.yaml")], "repo string, path string")
    found = repos.profile_text(repo, langs, tech, repos.relevant(files), r"\.go$").first().text
    assert found == "# Repository r\n\nabout\n\nLanguages (by bytes of code): Go 75%, C 25%.\nTechnologies verified from the code and manifests: Kafka (go.mod).\nTopics: x.\nActivity: created 2024-01-02.\nSource files: 1 (e.g. a.go)."
    subjects = spark.createDataFrame([("p", "Project", "repo-x", "", None, None, "github", None, None), ("q", "Project", "Q", "own", None, ["h"], "cv", None, None)], "id string, type string, name string, description string, aliases array<string>, highlights array<string>, source string, renamed boolean, minor boolean")
    said = spark.createDataFrame([("p", "sum", ["a"], "Repo X!", ["AI"], False), ("q", "sum", ["a"], "New", [], True)], "subject string, summary string, highlights array<string>, display_name string, domains array<string>, substantial boolean")
    got = {r.id: r for r in repos.apply_extraction(subjects, said).collect()}
    assert (got["p"].name, got["p"].description, got["p"].highlights, got["p"].domains, got["p"].minor) == ("repo-x", "sum", ["a"], ["ai"], True)
    assert (got["q"].name, got["q"].description, got["q"].highlights, got["q"].minor) == ("Q", "own", ["h"], False)


def test_followups(spark):
    focus = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4)], "qid long, id string, position int")
    nodes = spark.createDataFrame([("a", "Skill", "Spark", "tool"), ("b", "Skill", "Agility", "concept"), ("c", "Project", "Atlas", None), ("d", "Project", "Bolt", None)], "id string, type string, name string, category string")
    asked = spark.createDataFrame([(1, "what of spark", "en", "ask")], "qid long, text string, language string, intent string")
    got = [r.question for r in retrieve.followups(focus, nodes, asked, {"en": "More?", "fr": "Encore ?"}).orderBy("position").collect()]
    assert got == ["What was built in Atlas?", "What was built in Bolt?", "More?"]


def test_select_repos(spark):
    repo = spark.createDataFrame([("a", False, None), ("b", True, False), ("c", None, True), ("d", False, False)], "repo string, fork boolean, private boolean")
    names = lambda *r: spark.createDataFrame([(x,) for x in r], "repo string")
    kept = lambda **more: {r.repo for r in detect.select_repos(repo, **more).collect()}
    assert kept() == {"a", "d"} and kept(forks=True) == {"a", "b", "d"} and kept(private=True) == {"a", "c", "d"}
    assert kept(include=names("a", "b"), exclude=names("a"), forks=True) == {"b"}


def test_generated_languages_of_apps(spark):
    sizes = spark.createDataFrame([("r", "Dart", 90), ("r", "C++", 100), ("r", "Nix", 1), ("q", "C++", 10)], "repo string, language string, bytes long")
    got = repos.top_languages(sizes, spark.createDataFrame([("r",)], "repo string"), ("C++",))
    assert [(r.repo, r.language, r.position) for r in got.orderBy("repo", "position").collect()] == [("q", "C++", 1), ("r", "Dart", 1)]


def test_export_and_fresh_answers(spark, tmp_path):
    nodes = spark.createDataFrame([("a", [0.5])], "id string, embedding array<float>")
    publish.export_json({"entities": nodes}, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "entities"))
    assert back.columns == ["id"] and back.count() == 1
    cache = spark.sql("select * from values ('k', 'r1', 'old', timestamp'2024-01-01 00:00:00'), ('k', 'r1', 'new', timestamp'2024-01-02 00:00:00'), ('k', 'r2', 'else', timestamp'2024-01-02 00:00:00') t(key, revision, value, created)")
    asked = spark.createDataFrame([("k", "r1"), ("k", "r3")], "key string, revision string")
    at = lambda t: {r.revision: r.value for r in publish.fresh_answers(asked, cache, F.lit(t).cast("timestamp")).collect()}
    assert at("2024-01-02 12:00:00") == {"r1": "new", "r3": None}
    assert at("2024-01-05 00:00:00") == {"r1": None, "r3": None}


def test_revision_follows_contents(spark):
    files = lambda *r: publish.revision(spark.createDataFrame(r, "path string, content string")).first()[0]
    assert files(("a", "1"), ("b", "2")) == files(("b", "2"), ("a", "1")) != files(("a", "2"), ("b", "1"))


def test_dash_aliases(spark):
    rows = spark.createDataFrame([("A — B", ["x"]), ("A — B", None), ("A", None)], "name string, aliases array<string>")
    assert [r.aliases for r in resolve.dash_aliases(rows).collect()] == [["x", "A", "B"], ["A", "B"], None]


def test_moves_after_a_merge(spark):
    said = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "chunk_id long, entity_id string")
    merged = spark.createDataFrame([("b", "a")], "drop_id string, keep_id string")
    assert sorted(map(tuple, graph.move_ids(said, merged, "entity_id").collect())) == [(1, "a"), (2, "a"), (3, "c")]


def test_widened(spark):
    edges = spark.createDataFrame([("p", "USES", "s"), ("me", "BUILT", "p"), ("me", "HAS_SKILL", "s"), ("p", "USES", "t"), ("o", "AT", "p")], "source string, type string, target string")
    nodes = spark.createDataFrame([("p", "Project"), ("s", "Skill"), ("t", "Skill"), ("me", "Person"), ("o", "Org")], "id string, type string")
    sets = spark.createDataFrame([(1, "p"), (1, "s"), (1, "o")], "qid long, id string")
    got = graph.widened(edges, nodes, sets, ("Project", "Skill"), ("Person",))
    assert {tuple(r)[1:] for r in got.select("qid", "source", "type", "target").collect()} == {("p", "USES", "s"), ("me", "BUILT", "p")}


def test_community_context(spark):
    nodes = spark.createDataFrame([("a", "Skill", "A", "first"), ("b", "Skill", "B", None), ("c", "Skill", "C", None)], "id string, type string, name string, description string")
    member = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "n")], "id string, community string")
    edges = spark.createDataFrame([("a", "USES", "b"), ("a", "USES", "c")], "source string, type string, target string")
    ranked = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.5)], "id string, k double")
    got = {r.community: r.text for r in view.community_context(member, edges, nodes, ranked).collect()}
    assert got["m"] == "Entities:\n- Skill: B — \n- Skill: A — first\n\nRelations:\n- A —USES→ B"
    assert got["n"] == "Entities:\n- Skill: C — \n\nRelations:\n"


def test_connect(spark):
    nodes = spark.createDataFrame([("x", "Project", "Atlas", None, 1), ("y", "Skill", "Spark", None, 2), ("z", "Project", "Bolt", None, 3), ("w", "Skill", "Lone", None, 4)], "id string, type string, name string, aliases array<string>, seq long")
    edges = spark.createDataFrame([("x", "USES", "y"), ("z", "USES", "y")], "source string, type string, target string")
    pairs = spark.createDataFrame([("atlas", "z"), ("x", "Lone"), ("x", "nobody")], "a string, b string")
    got = surface.connect(pairs, nodes, edges, link.name_index(nodes)).collect()
    assert [(r.a, r.b, r.source, r.target) for r in got] == [("atlas", "z", "x", "z")]
    assert "y" in str(got[0].path)


def test_streams_of_enrichment(spark, tmp_path):
    """Content that the cache knows is not computed again, and a batch joins the version that is in force when it begins."""
    asked = tmp_path / "in"

    def fn(batches):
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "n": b["t"].str.len()})

    cache, out = str(tmp_path / "cache"), str(tmp_path / "out")
    for words in (["aa", "b"], ["b", "ccc"]):
        spark.createDataFrame([(w,) for w in words], "t string").coalesce(1).write.mode("append").parquet(str(asked))
        stream = spark.readStream.schema("t string").parquet(str(asked))
        publish.incremental_enrich(stream, ["t"], cache, out, str(tmp_path / "c1"), fn, "n long").awaitTermination()
    assert sorted((r.t, r.n) for r in spark.read.parquet(out).collect()) == [("aa", 2), ("b", 1), ("b", 1), ("ccc", 3)]
    assert spark.read.parquet(cache).count() == 3

    edges = spark.createDataFrame([], "source string, type string, target string")
    graphs = [spark.createDataFrame([("aa", "Skill", name)], "id string, type string, name string") for name in ("old", "new")]
    seen = []
    sink = lambda rows, version, number: seen.append((version, sorted((r.id, r.name) for r in rows.collect())))
    versions = []
    for g in graphs:
        versions.append(publish.publish(spark, {"entities": g, "relations": edges}, str(tmp_path / "graph"))[0])
        spark.createDataFrame([("aa",), ("zz",)], "id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "ids"))
        stream = spark.readStream.schema("id string").parquet(str(tmp_path / "ids"))
        publish.with_current(stream, str(tmp_path / "graph"), "entities", "id", sink, str(tmp_path / "c2")).awaitTermination()
    assert seen == [(versions[0], [("aa", "old"), ("zz", None)]), (versions[1], [("aa", "new"), ("zz", None)])]


def test_similar_skills_merge_as_in_one_pass(spark):
    """Rounds of pairs that are first at both ends give what one pass over the ordered pairs gives, on random pairs."""
    for seed in range(3):
        rng = random.Random(seed)
        ids = [f"s{i:02}" for i in rng.sample(range(60), 40)]
        skills = [(x, rng.choice([True, False, False, None]), [f"d{rng.randrange(6)}" for _ in range(rng.randrange(4))], i) for i, x in enumerate(ids)]
        pairs = {tuple(rng.sample(ids, 2)) for _ in range(70)}
        known, held, alive, to = {s[0]: bool(s[1]) for s in skills}, {s[0]: set(s[2]) for s in skills}, set(ids), {}
        near = {frozenset(p) for p in pairs}
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if a in alive and b in alive and frozenset((a, b)) in near and not (known[a] and known[b]):
                    keep, drop = (a, b) if known[a] or len(held[a]) >= len(held[b]) else (b, a)
                    held[keep] |= held[drop]
                    alive.discard(drop)
                    to[drop] = keep
        expect = {}
        for d, k in to.items():
            while k in to:
                k = to[k]
            expect[d] = k
        df = spark.createDataFrame(skills, "id string, known boolean, sources array<string>, seq long")
        found = resolve.merge_similar(df, spark.createDataFrame([*pairs, (ids[0], ids[0])], "a string, b string"))
        assert {r.drop_id: r.keep_id for r in found.collect()} == expect and len(expect) > 10
    assert resolve.merge_similar(df.limit(0), spark.createDataFrame([], "a string, b string")).count() == 0
