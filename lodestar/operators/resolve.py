"""Entity resolution: raw names to canonical skills, what skills imply, and domains."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import clean_skill_name, normalize_name, slugify, strip_version
from lodestar.operators.graph import cut, drop

MOST_LETTERS = 60


def cleaned(raw: DataFrame, generic: DataFrame) -> DataFrame:
    """raw(name, seq) with ``clean`` and its normal form ``key``; empty, very long and generic(name) names go."""
    names = raw.withColumn("clean", clean_skill_name(F.col("name"))).withColumn("key", normalize_name(F.col("clean")))
    kept = names.where((F.col("key") != "") & (F.length("clean") <= MOST_LETTERS))
    return kept.join(generic.select(normalize_name(F.col("name")).alias("key")).distinct(), "key", "left_anti")


def canonical(raw: DataFrame, dictionary: DataFrame, known: DataFrame, generic: DataFrame) -> DataFrame:
    """(name, id, label, in_dictionary) of distinct raw(name, seq) names.

    dictionary(alias, label, seq): the first definition of an alias wins; the name without its version is tried before
    the name itself. Failing that an entity of known(id, name, aliases, seq) with that name or alias, the first by seq,
    and else a new skill. Joins are equalities on normal forms; Catalyst broadcasts the small sides by their size.
    """
    first = dictionary.select(normalize_name(F.col("alias")).alias("k"), "label", "seq").groupBy("k").agg(F.min_by("label", "seq").alias("label"))
    names = cleaned(raw, generic).groupBy("name", "clean", "key").agg(F.min("seq").alias("seq"))
    names = names.withColumn("bare", normalize_name(strip_version(F.col("clean"))))
    listed = names.join(first.select(F.col("k").alias("bare"), F.col("label").alias("a")), "bare", "left").join(first.select(F.col("k").alias("key"), F.col("label").alias("b")), "key", "left")
    labels = known.select("id", "seq", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    index = labels.select(normalize_name(F.col("n")).alias("key"), "id", "seq").where("key <> ''").groupBy("key").agg(F.min_by("id", "seq").alias("known_id"))
    label = F.coalesce("a", "b")
    return listed.join(index, "key", "left").select(
        "name",
        F.when(label.isNotNull(), F.concat(F.lit("skill:"), slugify(label))).otherwise(F.coalesce("known_id", F.concat(F.lit("skill:"), slugify(F.col("clean"))))).alias("id"),
        F.coalesce(label, F.col("clean")).alias("label"),
        label.isNotNull().alias("in_dictionary"),
        "seq",
    )


def skills(raw: DataFrame, dictionary: DataFrame, known: DataFrame, generic: DataFrame) -> DataFrame:
    """One row a canonical skill: id, first label, the other spellings as aliases (sorted), and whether it is listed."""
    merged = canonical(raw, dictionary, known, generic).groupBy("id").agg(F.min_by("label", F.struct("seq", "name")).alias("label"), F.collect_set("name").alias("_names"), F.bool_or("in_dictionary").alias("known"))
    return merged.select("id", "label", F.array_sort(F.array_remove("_names", F.col("label"))).alias("aliases"), "known")


def implied(used: DataFrame, rules: DataFrame) -> DataFrame:
    """used(source, type, target) and what follows in one hop of rules(skill, also), plus RELATED_TO edges of rules met.

    Implied rows imply nothing further; edges that are there already do not appear again.
    """
    met = used.join(rules.select(F.col("skill").alias("target"), "also"), "target").where("target <> also")
    more = met.select("source", "type", F.col("also").alias("target")).where("source <> target")
    related = met.select(F.col("target").alias("source"), F.lit("RELATED_TO").alias("type"), F.col("also").alias("target"))
    return used.select("source", "type", "target").unionByName(more).unionByName(related).distinct()


def link_domains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """IN_DOMAIN edges for nodes(id, domain) that have none in edges; a null or empty domain links nothing."""
    linked = edges.where("type = 'IN_DOMAIN'").select(F.col("source").alias("id"))
    free = nodes.where("domain <> ''").join(linked, "id", "left_anti")
    return free.select(F.col("id").alias("source"), F.lit("IN_DOMAIN").alias("type"), F.concat(F.lit("domain:"), slugify(F.col("domain"))).alias("target")).distinct()


def dash_aliases(entities: DataFrame) -> DataFrame:
    """``A — B`` as a name also gives the aliases A and B: entities(name, aliases) with those added."""
    parts = F.transform(F.split("name", " — "), lambda p: F.trim(p))
    return entities.withColumn("aliases", F.when(F.size(parts) > 1, F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), parts)).otherwise(F.col("aliases")))


def _in_turn(rows: pd.DataFrame) -> pd.DataFrame:
    """(drop_id, keep_id) of pairs rows(n, a, b, known_a, known_b, said_a, said_b), taken one after another by n."""
    rows = rows.sort_values("n")
    said: dict = {}
    for end in ("a", "b"):
        said.update((i, set(x)) for i, x in zip(rows[end], rows[f"said_{end}"]))
    to: dict = {}
    for a, b, known_a, known_b in zip(rows["a"], rows["b"], rows["known_a"], rows["known_b"]):
        if a in to or b in to or known_a and known_b:
            continue
        drop, keep = (b, a) if known_a or len(said[a]) >= len(said[b]) else (a, b)
        to[drop] = keep
        said[keep] |= said[drop]
    return pd.DataFrame({"drop_id": list(to), "keep_id": list(to.values())})


#: Pairs that one task takes in their order, after each of which all others hear of it.
TURNS = 1 << 16


def merge_similar(skills: DataFrame, pairs: DataFrame) -> DataFrame:
    """(drop_id, keep_id): which of skills(id, known, sources, seq) merge, given pairs(a, b) of near vectors; exactly what one
    pass over the pairs in the order of (earlier seq, later seq) gives.

    Of a pair whose ends are both still there, unless both are known, the earlier is kept if it is known or has as many
    sources as the later, else the later; the kept one takes over the other's sources. keep_id is who is left in the end.

    A pair's outcome depends on the earlier pairs of its two ends alone. So each round settles, all at once, the pairs that
    are the first of both their ends; then the TURNS first of what is left are taken in turn by one task, which ends chains of
    pairs that wait for one another, and all pairs of what was dropped go.
    """
    order = F.struct("seq", "id")
    state = cut(skills.select("id", F.coalesce("known", F.lit(False)).alias("known"), F.array_distinct(F.coalesce("sources", F.array().cast(skills.schema["sources"].dataType))).alias("sources"), order.alias("at")))
    ends = pairs.where("a <> b").select(F.struct("a", "b").alias("p")).select("p.*")
    placed = ends.join(state.select(F.col("id").alias("a"), F.col("at").alias("ta")), "a").join(state.select(F.col("id").alias("b"), F.col("at").alias("tb")), "b")
    swap = F.col("ta") > F.col("tb")
    rest = cut(placed.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.struct(F.least("ta", "tb").alias("x"), F.greatest("ta", "tb").alias("y")).alias("rank")).distinct())
    kinds = f"drop_id {skills.schema['id'].dataType.simpleString()}, keep_id {skills.schema['id'].dataType.simpleString()}"
    found = []

    def settle(taken: DataFrame, gone: DataFrame) -> None:
        """From the pairs ``taken`` came gone(drop_id, keep_id), each end of which is one more link to who is left."""
        nonlocal state, rest
        found.append(gone)
        told = _ends(gone).join(state.select(F.col("id").alias("drop_id"), "sources"), "drop_id").groupBy(F.col("keep_id").alias("id")).agg(F.flatten(F.collect_set("sources")).alias("_more"))  # sources of one skill
        new = cut(state.join(gone.select(F.col("drop_id").alias("id")), "id", "left_anti").join(told, "id", "left").select("id", "known", F.array_union("sources", F.coalesce("_more", "sources")).alias("sources"), "at"))
        left = rest.join(taken.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            left = left.join(gone.select(F.col("drop_id").alias(end)), end, "left_anti")
        left = cut(left)
        drop(state, rest)
        state, rest = new, left

    def judged(ready: DataFrame) -> DataFrame:
        now = lambda end: state.select(F.col("id").alias(end), F.col("known").alias(f"known_{end}"), F.col("sources").alias(f"sources_{end}"))
        return ready.join(now("a"), "a").join(now("b"), "b")

    while (n := rest.count()) > 0:
        if n > TURNS:
            first = rest.select(F.explode(F.array("a", "b")).alias("id"), "rank").groupBy("id").agg(F.min("rank").alias("first"))
            of = lambda end: first.select(F.col("id").alias(end), F.col("first").alias(f"first_{end}"))  # noqa: B023, E731
            ready = cut(rest.join(of("a"), "a").join(of("b"), "b").where((F.col("rank") == F.col("first_a")) & (F.col("rank") == F.col("first_b"))).select("a", "b"))
            earlier = F.col("known_a") | (F.size("sources_a") >= F.size("sources_b"))
            settle(ready, cut(judged(ready).where(~(F.col("known_a") & F.col("known_b"))).select(F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("drop_id"), F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("keep_id"))))
            drop(ready)
        taken = cut(rest.orderBy("rank").limit(TURNS).select("a", "b", F.row_number().over(Window.orderBy("rank")).alias("n")))  # of one task
        said = lambda end: F.transform(f"sources_{end}", lambda s: F.to_json(F.struct(s.alias("s")))).alias(f"said_{end}")
        turns = judged(taken).select(F.lit(0).alias("_all"), "n", "a", "b", "known_a", "known_b", said("a"), said("b"))
        settle(taken, cut(turns.groupBy("_all").applyInPandas(_in_turn, kinds)))
        drop(taken)
    return _ends(reduce(DataFrame.unionByName, found)) if found else rest.select(F.col("a").alias("drop_id"), F.col("b").alias("keep_id"))


def _ends(links: DataFrame) -> DataFrame:
    """(drop_id, keep_id) of links(drop_id, keep_id), keep_id being who is left in the end; each round halves the way."""
    to = cut(links)
    while True:
        further = to.select(F.col("drop_id").alias("keep_id"), F.col("keep_id").alias("_k"))
        if to.join(further, "keep_id", "left_semi").isEmpty():
            return to
        next_ = cut(to.join(further, "keep_id", "left").select("drop_id", F.coalesce("_k", "keep_id").alias("keep_id")))
        drop(to)
        to = next_
