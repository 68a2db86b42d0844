"""Registered queries against their SQL on tables that sf0.001 has no like of."""

import os

import duckdb
import pytest

from lodestar.operators import community, graph, resolve, search
from lodestar.plans import catalog


def rows(columns, found):
    """Sorted rows as text, by the columns' names."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple("null" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


def same(spark, tables, name):
    """Whether a query gives what its SQL does on the Parquet files in ``tables``."""
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tables}/{f}{'/*.parquet' if os.path.isdir(f'{tables}/{f}') else ''}'")
    found, want = catalog.QUERIES[name](spark, str(tables)), con.sql(catalog.ORACLES[name])
    want = rows(want.columns, want.fetchall())
    assert want[1] and rows(found.columns, found.collect()) == want


def test_histories_cut_at_blanks(spark, tmp_path):
    """A cut behind a newline or a space, blanks of all kinds at the ends, links behind citations, and nulls."""
    cuts = [("x" * 697 + blank * 2 + "y" * 9, i) for i, blank in enumerate(("\n", " ", "\t", "\u00a0", " \n", "\n ", "\x0b"))]
    odd = [" \t a [1, 2] b [3](u)\x0b", "\x0c[4\x0b,5] [6 ;\f7]\u00a0", "", None, "\n" * 3, "z" * 700, "z" * 701]
    turns = [(1 + i, 1, "user", t) for t, i in cuts] + [(20, i, "user" if i % 2 else None, t) for i, t in enumerate(odd)] + [(30, None, "user", "late"), (30, 2, "system", "a"), (30, 1, "user", "b"), (31, 1, "user", None), (None, 1, "user", "n")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    same(spark, tmp_path, "history_window")


@pytest.mark.parametrize("turns", [20, 1 << 16])
def test_a_long_chain_of_similar_skills_takes_few_rounds(spark, monkeypatch, turns):
    """Each pair waits for the one before it; what is stored on the way does not grow with the chain."""
    monkeypatch.setattr(resolve, "TURNS", turns, raising=False)
    cuts = []
    monkeypatch.setattr(resolve, "cut", lambda df: (cuts.append(1), graph.cut(df))[1])
    n = 60
    skills = spark.createDataFrame([(i, i % 7 == 0, [i % 5, None], i) for i in range(n)], "id long, known boolean, sources array<int>, seq long")
    found = resolve.merge_similar(skills, spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long"))
    held, to = {i: {i % 5, None} for i in range(n)}, {}
    for a in range(n - 1):
        if a not in to and not (a % 7 == 0 and (a + 1) % 7 == 0):
            drop, keep = (a + 1, a) if a % 7 == 0 or len(held[a]) >= len(held[a + 1]) else (a, a + 1)
            to[drop] = keep
            held[keep] |= held[drop]
    want = {}
    for d, k in to.items():
        while k in to:
            k = to[k]
        want[d] = k
    assert {r.drop_id: r.keep_id for r in found.collect()} == want and len(want) > 20
    assert len(cuts) < 60


def left_by(spark, run):
    """Folders that ``run`` leaves among what executors share."""
    shared = graph.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    run()
    return set(os.listdir(shared)) - before


def ring(spark, n=12):
    nodes = spark.createDataFrame([(f"n{i:02}", "Skill") for i in range(n)], "id string, type string")
    return nodes, spark.createDataFrame([(f"n{i:02}", "USES", f"n{(i + k) % n:02}") for i in range(n) for k in (1, 2)], "source string, type string, target string")


def test_steps_of_ranks_do_not_pile_up(spark):
    """However many steps there are, what they store is deleted when the next has replaced it, and so are their edges."""
    nodes, edges = ring(spark)
    seeds = spark.createDataFrame([("q", "n00", 1.0)], "qid string, id string, weight double")
    assert len(left_by(spark, lambda: graph.global_pagerank(graph.walk(edges, nodes), nodes).count())) <= 2
    assert len(left_by(spark, lambda: graph.pagerank(graph.walk(edges, nodes), nodes, seeds, 0.5, 1e-3).count())) <= 3
    assert not spark.catalog.listTables()


def test_a_walk_in_proportion_ranks_as_probabilities(spark):
    nodes, edges = ring(spark)
    seeds = spark.createDataFrame([("q", "n00", 1.0), ("q", "n05", 3.0)], "qid string, id string, weight double")
    for ranks in (lambda w: graph.global_pagerank(w, nodes, digits=9), lambda w: graph.pagerank(w, nodes, seeds, 0.5, 1e-6)):
        a, b = ({r[-2]: r[-1] for r in ranks(w).collect()} for w in (graph.walk(edges, nodes), graph.transitions(edges, nodes)))
        assert len(a) == 12 and a == pytest.approx(b, abs=1e-9)


def test_rounds_of_communities_do_not_pile_up(spark):
    nodes, edges = ring(spark)
    found = []
    assert len(left_by(spark, lambda: found.extend(community.communities(edges, nodes, rounds=4).collect()))) <= 8
    assert {r.id for r in found} == {f"n{i:02}" for i in range(12)}


@pytest.mark.parametrize("name,most", [("community_cards", 12), ("node_relations", 1), ("profile_counts", 9)])
def test_shuffles_are_not_there_all_at_once(spark, sf_dir, name, most):
    """What is left to run when a query is returned: earlier shuffles are stored and gone by then."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most, plan.count("Exchange hashpartitioning")


def test_postings_are_shuffled_once(spark, monkeypatch):
    """Terms in very many documents are few; they travel, and no other table meets the postings."""
    plans = []
    monkeypatch.setattr(search, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), graph.cut(df))[1])
    docs = spark.createDataFrame([(i, f"common w{i % 5} x{i}") for i in range(40)], "id long, text string")
    monkeypatch.setattr(search, "ORDERED", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        found = search.text_index(docs)["postings"].collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(p.id for r in found if r.term == "common" for p in r.posted) == list(range(40)) and sum(r.term == "common" for r in found) >= 3
    assert [p.count("Exchange hashpartitioning") for p in plans if "Window" in p] == [1]
