"""Publishing a graph: content versions, all-or-nothing replacement, export, statistics, and caches by content.

A graph is a dict of tables by name. Versions are directories; a reader follows the pointer of the largest number in
``versions``, where each number is given once, so a failed publish leaves the one before in force.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import slugify

#: Columns that do not count as content, by table.
NOT_CONTENT = {"entities": ("embedding",), "chunks": ("embedding",), "relations": ("props",)}


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a unit separator; a null is the empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row (n, high, low) that does not depend on order: rows counted, halves of their keys summed.

    Sums combine before the shuffle, so that no list of keys is ever built; repeats count.
    """
    key = content_key(*[F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in columns])
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring("k", at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.select(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), half(1).alias("high"), half(16).alias("low"))


def graph_version(graph: dict[str, DataFrame]) -> DataFrame:
    """One row (version): 12 hex letters over the content of all tables; embeddings and relation properties do not count."""
    parts = []
    for name in sorted(graph):
        columns = sorted(c for c in graph[name].columns if c not in NOT_CONTENT.get(name, ()))
        parts.append(digest(graph[name], *columns).select(F.concat_ws(":", F.lit(name), *[F.col(c).cast("string") for c in ("n", "high", "low")]).alias("p")))
    every = reduce(DataFrame.unionByName, parts)
    return every.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\x1f"), 256), 1, 12).alias("version"))


def revision(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """One row (revision): 12 hex letters over names and contents of source files."""
    d = digest(files, name, content)
    return d.select(F.substring(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in d.columns]), 256), 1, 12).alias("revision"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Seconds after which a pointer that is still empty is taken for one that a publisher broke off at.
STALE = 600


class Overtaken(RuntimeError):
    """Another publisher has put a version in force since this one looked."""


class Pointer(NamedTuple):
    number: int
    version: str
    folder: str


def _newest(spark: SparkSession, path: str) -> Pointer | None:
    """The pointer with the largest number; one that a publisher left empty when it broke off counts for nothing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True)
    for name in names:
        if name.isdigit():
            stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
            told = bytes(stream.readAllBytes()).decode().split("\n")
            stream.close()
            if len(told) == 3:  # whole
                return Pointer(int(name), told[0], told[1])
    return None


def _point(spark: SparkSession, path: str, number: int, version: str, folder: str) -> None:
    """Put a version in force as ``number``, which nobody may have taken: the file is made only if it is not there, which
    file systems of clusters do in one step."""
    to = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:012d}")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(to, False)
    except Exception as e:  # which exception says so depends on the file system
        if fs.exists(to):
            raise Overtaken(f"version {number} at {path} was published by someone else") from e
        raise
    out.write(bytearray(f"{version}\n{folder}\n".encode()))
    out.close()


def current(spark: SparkSession, path: str) -> str | None:
    """The version in force, if any."""
    newest = _newest(spark, path)
    return newest.version if newest else None


def publish(spark: SparkSession, graph: dict[str, DataFrame], path: str, force: bool = False) -> tuple[str, bool]:
    """(version, written). All tables first, into a folder of their own, then one pointer that puts them in force; unchanged
    content is left alone unless ``force``d, and what is in force is never written over.

    Of two publishers that began from the same version one gets the next number; the other is ``Overtaken`` and has
    changed nothing, so it can look at what is in force and publish again.
    """
    before = _newest(spark, path)
    version = graph_version(graph).first()[0]
    if before and version == before.version and not force:
        return version, False
    folder = f"build-{uuid.uuid4().hex}"
    for name, df in graph.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    _point(spark, path, _after(spark, path, before), version, folder)
    return version, True


def _after(spark: SparkSession, path: str, before: Pointer | None) -> int:
    """The number behind ``before``, past any that a broken publisher has left empty for STALE seconds; one that is younger
    may be about to be written."""
    newest, number = _newest(spark, path), (before.number if before else 0) + 1
    if newest and (before is None or newest.number > before.number):
        raise Overtaken(f"version {newest.number} at {path} was published by someone else")
    while _exists(spark, to := f"{path}/versions/{number:012d}"):
        p = spark._jvm.org.apache.hadoop.fs.Path(to)
        if time.time() - p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() / 1000 < STALE:
            raise Overtaken(f"version {number} at {path} is being published by someone else")
        number += 1
    return number


def tables(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Tables of the version in force, as they were published."""
    newest = _newest(spark, path)
    if newest is None:
        raise FileNotFoundError(f"nothing published at {path}")
    return {n: spark.read.parquet(f"{path}/{newest.folder}/{n}") for n in names}


def load(spark: SparkSession, path: str, names: Iterable[str] = ("entities", "relations")) -> dict[str, DataFrame]:
    """Tables of the version in force; a missing type or name is filled, and edges to unknown nodes are dropped."""
    graph = tables(spark, path, names)
    nodes = graph["entities"].withColumn("type", F.coalesce("type", F.lit("Entity"))).withColumn("name", F.coalesce("name", "id"))
    graph["entities"] = nodes
    for end in ("source", "target"):
        graph["relations"] = graph["relations"].join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return graph


def export_json(graph: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines without its vectors."""
    for name, df in graph.items():
        df.drop("embedding").write.mode("overwrite").json(f"{path}/{name}")


def graph_stats(graph: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of every table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n") for n, df in graph.items()])


def cached_enrich(df: DataFrame, keys: list[str], cache: str, fn: Callable, schema: str) -> tuple[DataFrame, int]:
    """df with the columns of ``schema``, and how many keys were missing from the Parquet cache.

    ``fn`` is a ``mapInPandas`` function from (_key, *keys) to (_key, *schema). Only keys not in the cache run through
    it, each once; their results are appended, then joined back. An interrupted run loses no more than its own results.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", content_key(*[F.col(k) for k in keys]))
    wanted = keyed.select("_key", *keys).dropDuplicates(["_key"])
    missing = wanted.join(spark.read.parquet(cache).select("_key"), "_key", "left_anti") if _exists(spark, cache) else wanted
    before = spark.read.parquet(cache).count() if _exists(spark, cache) else 0
    missing.mapInPandas(fn, f"_key string, {schema}").write.mode("append").parquet(cache)
    known = spark.read.parquet(cache)
    return keyed.join(known.dropDuplicates(["_key"]), "_key", "left").drop("_key"), known.count() - before


def fresh_answers(questions: DataFrame, cache: DataFrame, now: Column, ttl: float = 86_400.0) -> DataFrame:
    """questions(key, revision) with the cached value of the same revision if it is no older than ``ttl`` seconds."""
    age = F.unix_micros(now) - F.unix_micros("created")
    fresh = cache.where(age <= int(ttl * 1_000_000)).groupBy("key", "revision").agg(F.max_by("value", "created").alias("value"))
    return questions.join(fresh, ["key", "revision"], "left")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, kind, text) of the Markdown files in a folder, a file a document, readme.md left out.

    The title is the first line that begins with #, or else the file's name.
    """
    stem = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"\.md$", "")  # names come percent-encoded
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))
    heading = F.when(F.col("text").rlike("(?m)^#"), F.trim(F.regexp_extract("text", r"(?m)^#[# ]*([^\n]*)$", 1)))
    return files.where(F.lower(stem) != "readme").select(F.concat(F.lit("note:"), slugify(stem)).alias("id"), F.concat(F.lit("Note — "), F.coalesce(heading, stem)).alias("title"), F.lit("note").alias("kind"), "text")


#: Directories that hold no source of their own, and the largest file read.
SKIPPED = ("node_modules", "vendor", "dist", "build", ".git", ".next", ".dart_tool", ".gradle", "__pycache__", ".venv", "venv", "coverage", "Pods", ".idea", ".vscode", "out", "target", "bin", "obj")
MOST_BYTES = 200_000


def read_repo_files(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, size, text) below root/<repo>/: directories skipped, large and binary files dropped.

    Paths and lengths are filtered before contents are read. Text is UTF-8, or Latin-1 where that fails.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    inside = F.regexp_extract(F.col("path"), rf"\Q{top}\E/(.+)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    kept = files.select(inside.alias("p"), "length", "content").where(~F.concat(F.lit("/"), "p").rlike("/(" + "|".join(d.replace(".", r"\.") for d in SKIPPED) + ")/") & F.contains("p", F.lit("/")))
    plain = kept.where(F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 4096)), "(..)", "$1 ")) == 0)
    text = F.coalesce(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return plain.select(F.substring_index("p", "/", 1).alias("repo"), F.regexp_replace("p", "^[^/]+/", "").alias("path"), F.col("length").alias("size"), text.alias("text"))


def incremental_enrich(stream: DataFrame, keys: list[str], cache: str, out: str, checkpoint: str, fn: Callable, schema: str):
    """A query that enriches what arrives and appends it to ``out``: content that the cache knows is not computed again.
    Each batch is written whole or again; the cache makes a repeat cheap."""

    def each(batch: DataFrame, number: int) -> None:
        done, _ = cached_enrich(batch, keys, cache, fn, schema)
        done.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_current(stream: DataFrame, path: str, table: str, on: str, sink: Callable, checkpoint: str):
    """A query that joins each batch with ``table`` of the graph version in force when the batch begins; ``sink`` takes
    (rows, version, batch number). A new version is picked up at the next batch, as the pointer is read again."""
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        side = load(spark, path, ["entities", "relations"] if table in ("entities", "relations") else ["entities", "relations", table])[table]
        sink(batch.join(side, on, "left"), current(spark, path), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
