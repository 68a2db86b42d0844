"""Queries over files, versions and logged questions, all made from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import detect, guard
from lodestar.sources import publish
from lodestar.sources.tables import entities, relations, table

EXTENSIONS = {"r": "Returned", "a": "Accepted", "n": "New"}


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a repository: its manifest names its parts (package.json or requirements.txt), its lines are files."""
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")  # noqa: E741
    part = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    parts = l.groupBy(F.col("l_orderkey").alias("repo")).agg(F.array_sort(F.collect_set(part)).alias("p"))
    package = F.concat(F.lit('{"name": "x", "dependencies": {'), F.array_join(F.transform("p", lambda n: F.concat(F.lit('"'), n, F.lit('": "^1.0"'))), ", "), F.lit("}}"))
    needs = F.concat(F.lit("# needs\n"), F.array_join(F.transform("p", lambda n: F.concat(n, F.lit(">=1.0"))), "\n"))
    even = F.col("repo") % 2 == 0
    manifests = parts.select("repo", F.when(even, "app/package.json").otherwise("requirements.txt").alias("path"), F.lit(100).cast("long").alias("size"), F.when(even, package).otherwise(needs).alias("text"))
    lines = l.select(F.col("l_orderkey").alias("repo"), F.concat(F.lit("src/"), F.lower("l_linestatus"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("."), F.lower("l_returnflag")).alias("path"), F.col("l_quantity").cast("long").alias("size"), F.lit("").alias("text"))
    readmes = o.select(F.col("o_orderkey").alias("repo"), F.when(F.col("o_orderkey") % 3 == 0, "README.md").otherwise("docs/readme.rst").alias("path"), F.lit(10).cast("long").alias("size"), F.lit("").alias("text"))
    return manifests.unionByName(lines).unionByName(readmes)


def technologies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of brand n are known to ecosystem npm, the others to pypi; a path rule and the main languages come after."""
    files = _files(spark, sf)
    name = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    packages = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, "npm").otherwise("pypi").alias("ecosystem"), name.alias("name"), F.col("p_brand").alias("technology"))
    languages = detect.language_bytes(files, EXTENSIONS).select("repo", F.col("language").alias("technology"))
    found = detect.technologies(detect.manifest_technologies(files, packages), detect.path_technologies(files, {"Open": "^src/o/", "New": r"^src/f/.*\.n$"}), languages)
    return found


def language_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return detect.language_bytes(_files(spark, sf), EXTENSIONS)


def file_routes(spark: SparkSession, sf: str) -> DataFrame:
    routed = detect.route_files(_files(spark, sf))
    return routed.groupBy("repo", F.coalesce("route", F.lit("none")).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


def guard_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item as a logged question, by its number: safe, with a harmless literal, deleting, doubled, or pointless."""
    k = F.col("l_linenumber") % 5
    name = F.concat(F.lit("'set "), F.col("l_partkey").cast("string"), F.lit("; drop'"))
    asked = F.when(k == 0, "MATCH (n) RETURN n LIMIT 5;").when(k == 1, F.concat(F.lit("MATCH (n {name: "), F.lit("'set CREATE "), F.col("l_partkey").cast("string"), F.lit("'}) return n"))).when(k == 2, "MATCH (n) Detach DELETE n RETURN 1").when(k == 3, F.concat(F.lit("MATCH (n) RETURN "), name)).otherwise("MATCH (n)")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(guard.refusal(asked), F.lit("")).alias("reason"))


def _graph(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"entities": entities(spark, sf).where("type = 'Skill'").select("id", "name"), "relations": relations(spark, sf).where("type = 'USES'").select("source", "target")}


def graph_version(spark: SparkSession, sf: str) -> DataFrame:
    return publish.graph_version(_graph(spark, sf))


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return publish.graph_stats({"entities": entities(spark, sf), "relations": relations(spark, sf), "documents": table(spark, sf, "documents")})


QUERIES = {f.__name__: f for f in (technologies, language_bytes, file_routes, guard_audit, graph_version, graph_stats)}

_HALVES = "count(*) AS n, sum(('0x' || substr(k, 1, 15))::BIGINT)::HUGEINT AS high, sum(('0x' || substr(k, 16, 15))::BIGINT)::HUGEINT AS low"
_LANGUAGE = "CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'New' END"
_PATH = "'src/' || lower(l_linestatus) || '/' || l_linenumber || '.' || lower(l_returnflag)"
_MANIFEST = "CASE WHEN {0} % 2 = 0 THEN 'app/package.json' ELSE 'requirements.txt' END"
ORACLES = {
    "technologies": f"""WITH a AS (SELECT l_orderkey AS repo, p_brand AS technology, 0 AS pr, {_MANIFEST.format('l_orderkey')} AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (l_orderkey % 2 = 0) = (p_partkey % 3 = 0)
 UNION ALL SELECT l_orderkey, 'Open', 1, {_PATH} FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, 'New', 1, {_PATH} FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'N'
 UNION ALL SELECT l_orderkey, {_LANGUAGE}, 2, 'language' FROM lineitem)
SELECT repo, technology, arg_min(evidence, (pr, evidence)) AS evidence FROM a GROUP BY 1, 2""",
    "language_bytes": f"SELECT l_orderkey AS repo, {_LANGUAGE} AS language, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY 1, 2",
    "file_routes": f"""WITH f AS (SELECT DISTINCT l_orderkey AS repo, {_MANIFEST.format('l_orderkey')} AS path, 'manifest' AS route FROM lineitem
 UNION ALL SELECT l_orderkey, {_PATH}, 'none' FROM lineitem UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'README.md' ELSE 'docs/readme.rst' END, 'readme' FROM orders)
SELECT repo, route, count(*) AS n, min(path) AS first FROM f GROUP BY 1, 2""",
    "guard_audit": "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 2 THEN 'Forbidden clause: Detach' WHEN 3 THEN 'Multiple statements are not allowed' WHEN 4 THEN 'Query must RETURN something' ELSE '' END AS reason FROM lineitem",
    "graph_version": f"""WITH e AS (SELECT {_HALVES} FROM (SELECT sha256('skill:p' || p_partkey || chr(31) || p_name) AS k FROM part)),
r AS (SELECT {_HALVES} FROM (SELECT sha256('project:o' || l_orderkey || chr(31) || 'skill:p' || l_partkey) AS k FROM lineitem))
SELECT substr(sha256('entities:' || e.n || ':' || e.high || ':' || e.low || chr(31) || 'relations:' || r.n || ':' || r.high || ':' || r.low), 1, 12) AS version FROM e, r""",
    "graph_stats": "SELECT 'entities' AS \"table\", (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT p_type) FROM part) AS n UNION ALL SELECT 'relations', (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'documents', count(*) FROM documents",
}
