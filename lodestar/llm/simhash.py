"""SimHash near-duplicates through one-wildcard deletion variants (operator 7).

A text's fingerprint has bit b set if over half of its shingles' hashes have. Fingerprints link at two or fewer
differing bits. Cut into SEGMENTS = 3 parts (22, 21 and 21 bits): of two linked fingerprints, some part can be left
out so that the rest differs in at most one bit. So each distinct fingerprint is indexed, for each part left out,
under (i) the rest as it is and (ii) the rest with one bit made a wildcard, for each bit; equal keys are joined and
the distance verified inside the join. A fingerprint whose wildcard bit is 0 meets only those where it is 1, so each
variant is written once. That is about 131 rows of 16 bytes per *distinct* fingerprint; a key fixes 42 bits, so
accidental meetings stay rare for any number of texts, and a fingerprint has at most 2080 neighbours, so the links
grow with the number of distinct fingerprints and never with the square of a group of copies.

Edge cases: null and empty texts have no words and fingerprint zero, and link like others; one or two words are one
shingle; repeated rows share a fingerprint; a null doc_id counts as larger than every other and gives a null
component_id only if the whole component has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_batches
from .components import components

WORDS, SEED, MOST = 3, 42, 2
#: Distinct fingerprints whose variants one task writes.
PRINTS = 200_000
#: A fingerprint is common beyond this part of all rows, so that fewer than HOT are.
HOT = 1000
#: (mask of the part that is left out, bits of the rest)
_CUTS = [(0, 22), (22, 43), (43, 64)]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: _TABLE[byte] is the byte's eight bits, lowest first.
_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split: exactly [ \t-\r]
    if not words:
        return 0
    # hash slices of the joined words, so that no shingle is built
    joined = b" ".join(words)
    view, ends = memoryview(joined), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[WORDS - 1 :] or [len(joined)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(view[a:b], SEED) for a, b in zip(starts, ends)]), dtype=np.uint8).reshape(-1, 8)
    n, bits = len(hashes), np.empty(64, np.uint8)
    for i in range(8):  # a digest is big-endian: byte 7 holds bits 0 to 7
        bits[8 * i : 8 * i + 8] = 2 * (np.bincount(hashes[:, 7 - i], minlength=256) @ _TABLE) > n
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _rest(a: int, b: int) -> int:
    """Mask, as a signed long, of the bits outside [a, b)."""
    mask = ~(((1 << (b - a)) - 1) << a) & (1 << 64) - 1
    return mask - (1 << 64) if mask >> 63 else mask


def _variants(prints: DataFrame, side: int) -> DataFrame:
    """(key, part, f): with side 0 the variants whose wildcard bit is 0, with side 1 those where it is 1."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))

    def of(part: int, a: int, b: int) -> list:
        rest, at = F.col("f").bitwiseAND(F.lit(_rest(a, b))), F.array(*[F.lit(i) for i in range(64) if not a <= i < b])
        whole = F.array(F.struct(rest.alias("key"), F.lit(100 * part + 64).alias("part")))
        own = F.filter(at, lambda i: F.call_function("shiftrightunsigned", F.col("f"), i.cast("int")).bitwiseAND(F.lit(1)) == side)
        return [whole, F.transform(own, lambda i: F.struct(rest.bitwiseAND(F.bitwise_not(one(i))).alias("key"), (F.lit(100 * part) + i).alias("part")))]

    keys = [k for part, (a, b) in enumerate(_CUTS) for k in of(part, a, b)]
    return prints.select("f", F.explode(F.concat(*keys)).alias("k")).select("k.key", "k.part", "f")


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in column f that differ in one or two bits."""
    low, high = (_variants(prints, side).select("key", "part", F.col("f").alias(name)) for side, name in ((0, "a"), (1, "b")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST
    # a whole key (part % 100 = 64) is on both sides: one order is enough
    once = (F.col("l.part") % 100 < 64) | (F.col("a") < F.col("b"))
    return low.alias("l").join(high.alias("h"), (F.col("l.key") == F.col("h.key")) & (F.col("l.part") == F.col("h.part")) & (F.col("a") != F.col("b")) & near & once).select("a", "b")


def _grouped(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, t (hash of its text), f (fingerprint), component_id and keeper (the row that stays)."""
    text_batches(docs.sparkSession)
    rows = cut(docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"), _fingerprints(F.col("text")).alias("f")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("t")))
    total = rows.count()
    # dealt by number: Spark would join these small partitions, but each row becomes 131 variants
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, total // PRINTS)
    prints = cut(rows.groupBy("f").agg(least.alias("least"), F.count(F.lit(1)).alias("n")).repartition(tasks, "f"))
    roots = components(links(prints.select("f")), "a", "b")
    # over the members' smallest, one row per fingerprint
    rooted = prints.join(roots, prints.f == roots.node, "left").select("f", "n", "least", F.coalesce("root", "f").alias("root"))
    ids = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("keeper")), "root").select("f", "n", "keeper"))
    # a fingerprint that over a HOT-th of the rows have is one of fewer than HOT: its rows are not brought together
    hot = F.col("n") * HOT > total
    marked = rows.join(F.broadcast(ids.where(hot).select("f", "keeper")), "f", "left")
    rest = marked.where("keeper is null").drop("keeper").join(ids.where(~hot).select("f", "keeper"), "f")
    return marked.where("keeper is not null").unionByName(rest).select("doc_id", "t", "f", F.col("keeper.id").alias("component_id"), "keeper")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return _grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, the one with the smallest doc_id of each group (rows equal to it stay too)."""
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("t"))
    gone = _grouped(docs).where(own != F.col("keeper")).select(F.col("doc_id").alias("_gone"), F.col("t").alias("_t")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(F.col("_gone")) & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == F.col("_t")), "left_anti")
