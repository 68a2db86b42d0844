"""Queries that build a graph: names to skills, implications, domains, clean pages, chunks and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import STOP, query_terms, terms
from lodestar.operators import documents, graph, resolve
from lodestar.operators.search import fuzzy_terms as fuzzy
from lodestar.sources.tables import entities, node, relations, spread, table


def _raw(spark, sf):
    p = table(spark, sf, "part")
    kind = F.col("p_partkey") % 4
    spelled = F.when(kind == 0, F.concat(F.lit("* "), "p_name", F.lit(" (optional)"))).when(kind == 1, F.concat(F.upper("p_name"), F.lit(" 3.1"))).when(kind == 2, F.col("p_name")).otherwise(F.initcap("p_name"))
    return p.select(spelled.alias("name"), F.col("p_partkey").alias("seq"))


def canonical_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of part names: a dictionary has the names first seen at an even part, known are the others in plain form."""
    p = table(spark, sf, "part")
    plain = p.groupBy("p_name").agg(F.min("p_partkey").alias("seq"))
    dictionary = plain.where("seq % 2 = 0").select(F.col("p_name").alias("alias"), F.upper("p_name").alias("label"), "seq")
    known = plain.where("seq % 2 = 1").select(F.concat(F.lit("skill:k"), F.col("seq").cast("string")).alias("id"), F.col("p_name").alias("name"), F.array(F.concat("p_name", F.lit(" 3.1"))).alias("aliases"), "seq")
    generic = plain.where("seq % 10 = 5").select(F.col("p_name").alias("name"))
    found = resolve.skills(_raw(spark, sf), dictionary, known, generic)
    return found.select("id", F.upper("label").alias("label"), F.size("aliases").alias("n_aliases"), "known")


def implied_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth part implies the first part of its type; one hop, over distinct order-part pairs."""
    p = table(spark, sf, "part")
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.lit("USES").alias("type"), F.col("l_partkey").alias("target")).distinct()
    first = F.min("p_partkey").over(Window.partitionBy("p_type"))
    rules = p.select(F.col("p_partkey").alias("skill"), first.alias("also")).where("skill % 10 = 0")
    return resolve.implied(used, rules)


def linked_domains(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    have = p.where("p_size > 25").select(node("skill:p", "p_partkey").alias("source"), F.lit("IN_DOMAIN").alias("type"), F.lit("domain:x").alias("target"))
    return resolve.link_domains(p.select(node("skill:p", "p_partkey").alias("id"), F.col("p_type").alias("domain")), have)


def merged_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of odd key merge into the one before: relations are moved, loops and repeats go."""
    gone = table(spark, sf, "customer").where("c_custkey % 2 = 1 and c_custkey > 1").select(node("role:c", "c_custkey").alias("drop_id"), F.concat(F.lit("role:c"), (F.col("c_custkey") - 1).cast("string")).alias("keep_id"))
    moved = graph.remap(relations(spark, sf), gone)
    return graph.merge_relations(moved, entities(spark, sf).select("id")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(documents.clean_markdown(F.col("html")), 256).alias("clean_sha256"))


def _markdown(spark, sf):
    """Documents as Markdown: language and source as headings, a paragraph for each sentence."""
    body = F.regexp_replace("text", r"\.\s+", ".\n\n")
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.concat(F.lit("# "), F.coalesce("lang", F.lit("none")), F.lit("\n\n"), body).alias("text"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return documents.chunk(_markdown(spark, sf))


def first_words(items: DataFrame) -> DataFrame:
    """(entity_id, label, priority): the longest plain word of each benchmark item (the first of equals)."""
    words = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_.-])[a-z]{4,}(?![\p{L}\p{N}_-])"), F.lit(0))
    longest = F.array_sort(F.transform(words, lambda x, i: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return items.select(F.col("item_id").alias("entity_id"), F.get(longest, F.lit(0)).x.alias("label"), F.lit(0).alias("priority")).where("label is not null")


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return documents.mentions(docs, first_words(table(spark, sf, "benchmark")))


def fuzzy_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents one edit or swap from a word that a benchmark item asks for."""
    seen = table(spark, sf, "documents").select(F.explode(terms(F.col("text"))).alias("term")).distinct()
    asked = table(spark, sf, "benchmark").select(F.explode(query_terms(F.col("text"))).alias("term"))
    return fuzzy(seen, asked)


QUERIES = {f.__name__: f for f in (canonical_skills, implied_skills, linked_domains, merged_entities, clean_pages, chunks, mentions, fuzzy_terms)}

_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_TAGS = "|".join(documents.TAGS)
_B = documents.BOX
_TOKEN = r"[\p{L}\p{N}_.+#-]+"
_STOPPED = "', '".join(STOP)
ORACLES = {
    "canonical_skills": f"""WITH plain AS (SELECT p_name, min(p_partkey) AS seq, {_KEY.format('p_name')} AS k FROM part GROUP BY p_name),
raw AS (SELECT p_partkey AS seq, p_name, p_partkey % 4 AS kind, CASE p_partkey % 4 WHEN 0 THEN '* ' || p_name || ' (optional)' WHEN 1 THEN upper(p_name) || ' 3.1' WHEN 2 THEN p_name ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS name FROM part),
used AS (SELECT r.*, p.seq AS s FROM raw r JOIN plain p USING (p_name) WHERE NOT (p.seq % 10 = 5 AND kind <> 1)),
named AS (SELECT name, seq, CASE WHEN s % 2 = 0 THEN 'skill:' || {_SLUG.format('p_name')} ELSE 'skill:k' || s END AS id, CASE WHEN s % 2 = 0 THEN upper(p_name) ELSE CASE WHEN kind = 0 THEN p_name ELSE name END END AS label, s % 2 = 0 AS known FROM used),
one AS (SELECT name, id, min(seq) AS seq, any_value(label) AS label, any_value(known) AS known FROM named GROUP BY 1, 2),
m AS (SELECT id, arg_min(label, seq) AS label, list(name) AS names, bool_or(known) AS known FROM one GROUP BY id)
SELECT id, upper(label) AS label, len(list_filter(names, lambda x: x <> label))::INT AS n_aliases, known FROM m""",
    "implied_skills": """WITH used AS (SELECT DISTINCT l_orderkey AS source, 'USES' AS type, l_partkey AS target FROM lineitem),
rules AS (SELECT * FROM (SELECT p_partkey AS skill, min(p_partkey) OVER (PARTITION BY p_type) AS also FROM part) WHERE skill % 10 = 0 AND skill <> also),
met AS (SELECT source, skill, also FROM used JOIN rules ON target = skill)
SELECT * FROM used UNION SELECT source, 'USES', also FROM met WHERE source <> also UNION SELECT skill, 'RELATED_TO', also FROM met""",
    "linked_domains": f"SELECT 'skill:p' || p_partkey AS source, 'IN_DOMAIN' AS type, 'domain:' || {_SLUG.format('p_type')} AS target FROM part WHERE p_size <= 25",
    "clean_pages": f"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:{_TAGS})[^>]*>', '', 'g'),
 '(?m)^[^\\n]*[{_B}]{{2}}[^\\n]*$\\n?', '', 'g'), '(?m)[^\\S\\n]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+\\z', '', 'g')) AS clean_sha256 FROM pages""",
    "mentions": r"""WITH w AS (SELECT item_id, regexp_replace(unnest(regexp_extract_all(text, '[\p{L}\p{N}_.-]+')), '\.+$', '') AS x FROM benchmark),
l AS (SELECT item_id, arg_min(x, (-len(x), x)) AS label FROM w WHERE regexp_full_match(x, '[a-z]{4,}') GROUP BY 1),
o AS (SELECT label, min(item_id) AS entity_id FROM l GROUP BY 1), c AS (SELECT doc_id, text, label, entity_id FROM documents, o WHERE contains(lower(text), label))
SELECT doc_id AS chunk_id, entity_id FROM c WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_.-])' || label || '($|[^\p{L}\p{N}_-])')""",
    "fuzzy_terms": f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}')) AS match FROM documents),
b AS (SELECT DISTINCT term FROM (SELECT unnest(list_slice(ts, 1, 24)) AS term FROM (SELECT item_id, list(x ORDER BY p) AS ts FROM (SELECT item_id, x, min(p) AS p FROM (SELECT item_id, unnest(f) AS x, generate_subscripts(f, 1) AS p FROM (
 SELECT item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}'), lambda x: len(x) >= 2 AND x NOT IN ('{_STOPPED}')) AS f FROM benchmark)) GROUP BY 1, 2) GROUP BY 1)))
SELECT DISTINCT term, match FROM (SELECT term, match, unnest(range(0, len(term) + 1)) AS i FROM b, v WHERE regexp_full_match(term, '\\p{{L}}{{6,}}') AND abs(len(term) - len(match)) <= 1 AND damerau_levenshtein(term, match) <= 4)
WHERE left(term, i) = left(match, i) AND (substr(term, i + 2) IN (substr(match, i + 2), substr(match, i + 1)) OR substr(term, i + 1) = substr(match, i + 2) OR substr(term, i + 1, 2) = reverse(substr(match, i + 1, 2)) AND substr(term, i + 3) = substr(match, i + 3))""",
}

#: Customers after merging, as in ``merged_entities``.
_KEPT = "CASE WHEN {0} % 2 = 1 AND {0} > 1 THEN {0} - 1 ELSE {0} END"
_CUST, _OCUST = _KEPT.format("c_custkey"), _KEPT.format("o_custkey")
ORACLES["merged_entities"] = f"""WITH raw AS (
 SELECT {_OCUST} AS a, 'DELIVERED' AS type, o_orderkey AS b, o_orderkey AS seq FROM orders
 UNION ALL SELECT l_orderkey, 'USES', l_partkey, l_orderkey * 10 + l_linenumber FROM lineitem
 UNION ALL SELECT {_OCUST}, 'USED', l_partkey, l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT n_regionkey, 'HELD_ROLE', {_CUST}, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT p_partkey, 'IN_DOMAIN', dense_rank() OVER (ORDER BY p_type), p_partkey FROM part
 UNION ALL SELECT {_CUST}, 'LOCATED_IN', c_nationkey, c_custkey FROM customer
 UNION ALL SELECT -s_suppkey, 'LOCATED_IN', s_nationkey, s_suppkey FROM supplier),
m AS (SELECT type, a, b, min(seq) AS seq FROM raw GROUP BY ALL) SELECT type, count(*) AS n, sum(seq)::BIGINT AS seqs FROM m GROUP BY type"""
