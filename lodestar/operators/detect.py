"""Technologies of repositories from their files. Files are (repo, path, size, text); dictionaries are parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANIFESTS = r"(?i)(^|/)(package\.json|composer\.json|requirements[^/]*\.txt|pyproject\.toml|pubspec\.yaml|[^/]*\.gradle(\.kts)?|libs\.versions\.toml|dockerfile[^/]*|[^/]+\.ya?ml)$"
README = r"(?i)(^|/)readme(\.[a-z]+)?$"
DOCS = r"(?i)\.(md|mdx|rst|adoc)$"


def route_files(files: DataFrame) -> DataFrame:
    """files with ``route``: readme (one a repository: the root's README.md before others, by path), docs, manifest or null."""
    readme = F.col("path").rlike(README)
    w = Window.partitionBy("repo").orderBy(~readme, F.lower("path") != "readme.md", F.size(F.split("path", "/")), "path")
    route = F.when(readme & (F.row_number().over(w) == 1), "readme").when(readme | F.col("path").rlike(DOCS), "docs").when(F.col("path").rlike(MANIFESTS), "manifest")
    return files.withColumn("route", route)


def select_repos(repos: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, forks: bool = False, private: bool = False) -> DataFrame:
    """repos(repo, fork, private): those included (all, if no list is given) and not excluded; forks and private ones on request."""
    if include is not None:
        repos = repos.join(include.select("repo"), "repo", "left_semi")
    if exclude is not None:
        repos = repos.join(exclude.select("repo"), "repo", "left_anti")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return repos.where((F.lit(forks) | no("fork")) & (F.lit(private) | no("private")))


def language_bytes(files: DataFrame, extensions: Mapping[str, str]) -> DataFrame:
    """(repo, language, bytes) by file extension; other files do not count."""
    names = F.create_map(*[x for k, v in extensions.items() for x in (F.lit(k), F.lit(v))])
    language = F.try_element_at(names, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return files.select("repo", language.alias("language"), "size").where("language is not null").groupBy("repo", "language").agg(F.sum("size").alias("bytes"))


def _names(path: Column, text: Column) -> Column:
    """(ecosystem, name) declared in a manifest; what cannot be read declares nothing."""
    base = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    found = lambda pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    keys = lambda *fields: F.flatten(F.array(*[F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{f}"), "map<string,string>")), F.array().cast("array<string>")) for f in fields]))
    tagged = lambda eco, names: F.transform(names, lambda n: F.struct(F.lit(eco).alias("ecosystem"), F.lower(n).alias("name")))
    name = r"[A-Za-z0-9][A-Za-z0-9._-]*"
    return (
        F.when(base == "package.json", tagged("npm", keys("dependencies", "devDependencies", "peerDependencies")))
        .when(base == "composer.json", tagged("composer", keys("require", "require-dev")))
        .when(base.rlike(r"^requirements.*\.txt$"), tagged("pypi", found(rf"(?m)^[^\S\n]*({name})")))
        .when(base == "pyproject.toml", F.concat(tagged("pypi", found(rf"""(?m)["']({name})(?:\[[^\]]*\])?[^\S\n]*(?:[<>=!~;][^"'\n]*)?["'][^\S\n]*(?:,|\]|$)""")), tagged("pypi", found(rf"(?m)^({name})[^\S\n]*=[^\S\n]*[\"'{{\^~]"))))
        .when(base == "pubspec.yaml", tagged("pub", found(r"(?m)^  ([a-z0-9_]+):")))
        .when(base.rlike(r"\.gradle(\.kts)?$") | (base == "libs.versions.toml"), tagged("maven", found(r"""["']([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+)""")))
        .when(base.rlike("^dockerfile"), F.concat(tagged("docker", found(r"(?im)^[^\S\n]*FROM[^\S\n]+(?:--\S+[^\S\n]+)?(?:\S*/)?([^\s:@/]+)")), F.array(F.struct(F.lit("file").alias("ecosystem"), F.lit("dockerfile").alias("name")))))
        .when(base.rlike(r"\.ya?ml$") & text.rlike(r"(?m)^apiVersion:") & text.rlike(r"(?m)^kind:"), F.concat(tagged("kind", found(r"(?m)^kind:[^\S\n]*([A-Za-z]+)")), tagged("api", found(r"(?m)^apiVersion:[^\S\n]*[\"']?([A-Za-z0-9.-]+)"))))
        .otherwise(F.array().cast("array<struct<ecosystem:string,name:string>>"))
    )


def manifest_technologies(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, technology, path) of packages(ecosystem, name, technology) declared in manifests; path is the first.

    Files that are no manifests are left out before their text is read.
    """
    declared = files.where(F.col("path").rlike(MANIFESTS)).select("repo", "path", F.explode(F.array_distinct(_names(F.col("path"), F.col("text")))).alias("d")).select("repo", "path", "d.*")
    known = packages.select("ecosystem", F.lower("name").alias("name"), "technology").distinct()
    return declared.join(known, ["ecosystem", "name"]).groupBy("repo", "technology").agg(F.min("path").alias("path"))


def path_technologies(files: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """(repo, technology, path): the first path that a rule's pattern matches. Rules are tested in the scan, without a join."""
    tests = F.filter(F.array(*[F.when(F.col("path").rlike(p), F.lit(t)) for t, p in rules.items()]), lambda t: t.isNotNull())
    return files.select("repo", "path", F.explode(F.array_distinct(tests)).alias("technology")).groupBy("repo", "technology").agg(F.min("path").alias("path"))


def technologies(manifest: DataFrame, paths: DataFrame, languages: DataFrame) -> DataFrame:
    """(repo, technology, evidence): a manifest counts before a path, a path before languages(repo, technology)."""
    parts = manifest.select("repo", "technology", F.struct(F.lit(0).alias("by"), F.col("path").alias("evidence")).alias("e"))
    parts = parts.unionByName(paths.select("repo", "technology", F.struct(F.lit(1).alias("by"), F.col("path").alias("evidence")).alias("e")))
    parts = parts.unionByName(languages.select("repo", "technology", F.struct(F.lit(2).alias("by"), F.lit("language").alias("evidence")).alias("e")))
    return parts.groupBy("repo", "technology").agg(F.min("e").alias("e")).select("repo", "technology", F.col("e.evidence").alias("evidence"))
