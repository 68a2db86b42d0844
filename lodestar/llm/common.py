"""Shared pieces: reading tables, the shared folder for intermediate results, columns with safe names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest doc_id stands in for a missing one, so that rows without an id sort last.
NO_ID = 9223372036854775807


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local one is set only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestar-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the shared folder, so a lost executor costs a read and no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """As ``cut``, as Parquet: smaller for wide rows. The files stay until the shared folder is cleared."""
    path = f"{shared_dir(df.sparkSession)}/lodestar-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but those that a result of these names replaces."""
    gone = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in gone]


def text_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds: few rows each, as a text can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def utf8(col: Column | str) -> Column:
    """A text as bytes, null as empty."""
    return F.coalesce(F.encode(F.col(col) if isinstance(col, str) else col, "UTF-8"), F.lit(b""))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a missing id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def hash_bound(n: int, total: int) -> int:
    """Of ``total`` evenly hashed rows about 2 n have a signed 64-bit hash up to this; all, if that is most of them."""
    return 2**63 - 1 if total <= 4 * n else -(2**63) + 2**64 * 2 * n // total


def smallest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``by``. A count comes first, so that the task that orders them reads about
    2 n rows however large the input is; rows equal in ``by`` share a hash, and each partition sends n of them at most."""
    order = F.xxhash64(*by)
    return df.where(order <= hash_bound(n, df.count())).orderBy(order).limit(n)
