"""Repositories into the graph: projects, what they use, and documents about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import normalize_name, slugify, truncate
from lodestar.operators.documents import chunk, mentions

#: Documents that say nothing of a project, languages that tools write, platform folders of an app.
SKIP_DOCS = r"(?i)(LICEN[CS]E|CHANGELOG|CODE_OF_CONDUCT|CONTRIBUTING|SECURITY|SUPPORT|AUTHORS)"
PLATFORM = r"^(android|ios|linux|macos|windows|web)/"
FIRST_DOCS, MOST_FILES = 3, 6
#: The lines of a repository's profile.
HEADING, LANGUAGES, VERIFIED, TOPICS, ACTIVITY = "# Repository ", "Languages (by bytes of code): ", "Technologies verified from the code and manifests: ", "Topics: ", "Activity: "
CREATED, PUSHED, FILES, EXAMPLES = "created ", "last push ", "Source files: ", " (e.g. "


def first_docs(files: DataFrame, most: int = FIRST_DOCS) -> DataFrame:
    """files(repo, path, ...) of route docs, without licences and the like, the first ``most`` a repository by path."""
    w = Window.partitionBy("repo").orderBy("path")
    return files.where((F.col("route") == "docs") & ~F.col("path").rlike(SKIP_DOCS)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def relevant(files: DataFrame, marker: str = "pubspec.yaml") -> DataFrame:
    """files without the platform folders of repositories that hold ``marker`` at their root."""
    apps = files.where(F.col("path") == marker).select("repo", F.lit(True).alias("_app")).distinct()
    return files.join(apps, "repo", "left").where(~(F.coalesce("_app", F.lit(False)) & F.col("path").rlike(PLATFORM))).drop("_app")


def top_languages(sizes: DataFrame, apps: DataFrame, generated: tuple[str, ...], least: float = 0.05) -> DataFrame:
    """(repo, language, bytes, share, position) of sizes(repo, language, bytes): languages of at least ``least`` of a
    repository's bytes, largest first; in apps(repo), generated languages do not count."""
    marked = sizes.join(apps.select("repo", F.lit(True).alias("_app")).distinct(), "repo", "left")
    own = marked.where(~(F.coalesce("_app", F.lit(False)) & F.col("language").isin(*generated))).drop("_app")
    share = own.withColumn("share", F.col("bytes") / F.sum("bytes").over(Window.partitionBy("repo"))).where(F.col("share") >= least)
    return share.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("bytes"), "language")))


def overridden(repos: DataFrame, overrides: DataFrame) -> DataFrame:
    """repos(repo, ...) with project_id and name: overrides(repo, name, project) rename one or merge it into a project."""
    joined = repos.join(overrides.select("repo", F.col("name").alias("_n"), F.col("project").alias("_p")), "repo", "left")
    return joined.select(*repos.columns, F.concat(F.lit("project:"), F.coalesce("_p", slugify(F.col("repo")))).alias("project_id"), F.coalesce("_n", "repo").alias("name"), F.col("_n").isNotNull().alias("renamed"))


def profile_text(repos: DataFrame, languages: DataFrame, technologies: DataFrame, files: DataFrame, source: str) -> DataFrame:
    """(repo, text): what a repository itself shows. repos(repo, description, topics, created_at, pushed_at);
    languages(repo, language, bytes, position); technologies(repo, technology, evidence); ``source``: pattern of code files."""
    gather = lambda df, order, line, sep: df.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x.l), sep).alias("t"))
    whole = F.sum("bytes").over(Window.partitionBy("repo"))
    shares = gather(languages.withColumn("_t", whole), "position", F.concat("language", F.lit(" "), F.bround(100 * F.col("bytes") / F.col("_t")).cast("int").cast("string"), F.lit("%")), ", ").withColumnRenamed("t", "langs")
    techs = gather(technologies, "technology", F.concat("technology", F.lit(" ("), "evidence", F.lit(")")), "; ").withColumnRenamed("t", "techs")
    code = files.where(F.col("path").rlike(source)).withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy("path")))
    counts = code.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    first = gather(code.where(F.col("_n") <= MOST_FILES), "_n", F.col("path"), ", ").withColumnRenamed("t", "some")
    r = repos
    for df in (shares, techs, counts, first):
        r = r.join(df, "repo", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    dates = F.concat_ws(", ", F.concat(F.lit(CREATED), F.substring(some("created_at"), 1, 10)), F.concat(F.lit(PUSHED), F.substring(some("pushed_at"), 1, 10)))
    topics = F.when(F.size("topics") > 0, F.array_join("topics", ", "))
    lines = F.concat_ws(
        "\n", F.concat(F.lit(HEADING), "repo", F.lit("\n")), F.concat(some("description"), F.lit("\n")),
        F.concat(F.lit(LANGUAGES), "langs", F.lit(".")), F.concat(F.lit(VERIFIED), "techs", F.lit(".")),
        F.concat(F.lit(TOPICS), topics, F.lit(".")), F.when(dates != "", F.concat(F.lit(ACTIVITY), dates, F.lit("."))), F.concat(F.lit(FILES), F.col("n").cast("string"), F.lit(EXAMPLES), "some", F.lit(").")),
    )
    return r.select("repo", lines.alias("text"))


def repository_edges(repos: DataFrame, technologies: DataFrame, skills: DataFrame, person: str) -> DataFrame:
    """(source, type, target, via, evidence): BUILT edges from ``person`` to projects, USES edges from projects to skills.

    repos(repo, project_id, topics); technologies(repo, technology, evidence); skills(name, id) are names resolved. What
    code shows comes before a topic of the same skill.
    """
    none = F.lit(None).cast("string")
    built = repos.select(F.lit(person).alias("source"), F.lit("BUILT").alias("type"), F.col("project_id").alias("target"), none.alias("via"), none.alias("evidence")).distinct()
    code = technologies.select("repo", F.col("technology").alias("name"), F.lit("code").alias("via"), "evidence")
    topics = repos.select("repo", F.explode("topics").alias("name"), F.lit("topic").alias("via"), F.lit("topic").alias("evidence"))
    used = code.unionByName(topics).join(skills.select("name", F.col("id").alias("target")), "name").join(repos.select("repo", "project_id"), "repo")
    first = used.groupBy("project_id", "target").agg(F.min(F.struct("via", "evidence", "repo")).alias("f"))  # "code" sorts before "topic"
    return built.unionByName(first.select(F.col("project_id").alias("source"), F.lit("USES").alias("type"), "target", "f.via", "f.evidence"))


def repository_docs(repos: DataFrame, routed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, title, kind, describes, text, extract): the readme, the first documents and the profile of each repository."""
    r = repos.select("repo", "project_id", "name")
    of = lambda df, id_, kind, what, extract: df.join(r, "repo").select(F.concat(F.lit("github:"), "repo", F.lit(":"), id_).alias("id"), F.concat(F.lit("GitHub — "), "name", F.lit(" ("), what, F.lit(")")).alias("title"), F.lit(kind).alias("kind"), F.array("project_id").alias("describes"), "text", extract.alias("extract"))
    readme = routed.where("route = 'readme'").select("repo", "path", "text")
    told = readme.select("repo").distinct().withColumn("_r", F.lit(True))
    own = profiles.join(told, "repo", "left")
    return (
        of(readme, F.lit("readme"), "readme", F.lit("README"), F.lit(True))
        .unionByName(of(first_docs(routed), slugify(F.col("path")), "doc", F.col("path"), F.lit(False)))
        .unionByName(of(own, F.lit("analysis"), "repo", F.lit("code analysis"), F.col("_r").isNull()))
    )


def chunk_table(docs: DataFrame, labels: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, mentions) of docs(id, title, text, describes): ids are ``doc#ord``; a chunk mentions the labels found in
    it and what its document describes, if known(id)."""
    pieces = chunk(docs.select(F.col("id").alias("doc_id"), "title", "text"))
    pieces = pieces.select(F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")).alias("id"), "doc_id", "title", "text", "ord")
    said = pieces.select(F.col("id").alias("chunk_id"), "doc_id").join(docs.select(F.col("id").alias("doc_id"), F.explode("describes").alias("entity_id")), "doc_id").select("chunk_id", "entity_id")
    met = mentions(pieces.select("id", "text"), labels).unionByName(said).distinct()
    return pieces, met.join(known.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def apply_extraction(subjects: DataFrame, extracted: DataFrame) -> DataFrame:
    """subjects(id, type, name, description, aliases, highlights, source, renamed, minor) after extracted(subject, summary,
    highlights, display_name, domains, substantial): of projects only.

    A summary fills an empty description and replaces that of a project known from its repository alone; highlights fill
    missing ones; such a project, if not renamed by hand, takes the name shown (another name, 60 letters at most) and
    keeps the old one as an alias; five domains at most, in lower case; one of no substance is minor.
    """
    j = subjects.join(extracted.withColumnsRenamed({"subject": "id", "highlights": "_h"}), "id", "left").withColumn("_met", F.col("substantial").isNotNull() & (F.col("type") == "Project"))
    alone = F.col("_met") & (F.coalesce("source", F.lit("")) == "github")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    told = F.col("_met") & filled("summary") & (alone | ~filled("description"))
    shown = F.trim("display_name")
    takes = alone & ~F.coalesce("renamed", F.lit(False)) & filled("display_name") & (shown != "") & (F.length(shown) <= 60) & (normalize_name(shown) != normalize_name(F.col("name")))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return j.select(
        "id", "type", F.when(takes, shown).otherwise(F.col("name")).alias("name"),
        F.when(told, F.col("summary")).otherwise(F.col("description")).alias("description"),
        F.when(told & filled("description") & ~F.contains("summary", F.col("description")), F.col("description")).alias("before"),
        F.when(takes, F.array_sort(F.array_union(aliases, F.array("name")))).otherwise(aliases).alias("aliases"),
        F.when(F.col("_met") & (F.size(F.coalesce("highlights", F.array().cast("array<string>"))) == 0) & (F.size("_h") > 0), F.col("_h")).otherwise(F.col("highlights")).alias("highlights"),
        F.when(F.col("_met") & (F.size("domains") > 0), F.transform(F.slice("domains", 1, 5), F.lower)).alias("domains"),
        (F.coalesce("minor", F.lit(False)) | (F.col("_met") & ~F.coalesce("substantial", F.lit(True)))).alias("minor"), "source", "renamed",
    )


def extraction_edges(subjects: DataFrame, skills: DataFrame, related: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source, type, target, how): what extraction says. skills(subject, name, how), related(subject, a, b) between names
    extracted for the same subject, resolved(name, id). A project USES a skill, others USED it; the first ``how`` stays."""
    named = skills.join(resolved.select("name", F.col("id").alias("target")), "name").join(subjects.select(F.col("id").alias("subject"), "type"), "subject")
    used = named.groupBy("subject", F.when(F.col("type") == "Project", "USES").otherwise("USED").alias("kind"), "target").agg(F.min(truncate(F.col("how"), 140)).alias("how"))
    key = named.select("subject", normalize_name(F.col("name")).alias("k"), "target").distinct()
    end = lambda c: key.select("subject", F.col("k").alias(f"_{c}"), F.col("target").alias(f"{c}_id"))
    pairs = related.select("subject", normalize_name(F.col("a")).alias("_a"), normalize_name(F.col("b")).alias("_b")).join(end("a"), ["subject", "_a"]).join(end("b"), ["subject", "_b"]).where("a_id <> b_id")
    edges = used.select(F.col("subject").alias("source"), F.col("kind").alias("type"), "target", "how")
    return edges.unionByName(pairs.select(F.col("a_id").alias("source"), F.lit("RELATED_TO").alias("type"), F.col("b_id").alias("target"), F.lit(None).cast("string").alias("how")).distinct())
