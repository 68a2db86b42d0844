"""Exact deduplication by two passes over a Bloom filter of text hashes (operator 10, native).

A first count sizes the filter: a 64-bit word for every ROWS_A_WORD rows, two to the power MOST_BITS words at most (so the
broadcast has a fixed bound). Pass one sets one bit a row, in the word its text's hash picks, and merges words by OR, XOR
and a count, within each task before anything is shuffled: a bit that is in the OR and not in the XOR was set more than
once, and where the count says that some bit was set three times or more, the whole word counts. What was set more than
once is *possibly repeated*; only those words are kept. Pass two tests each row against them: rows that cannot be
repeated pass straight through, without a shuffle; the others are grouped by the SHA-256 of the normalised text, counted
within each task first. Past MOST_BITS the filter fills up and lets more unique rows into the grouping; results stay exact.

``exact_groups`` hashes each text once and keeps ids and hashes (no texts) in the shared folder, so both passes read the
same numbered rows. ``exact_dedup`` needs no row numbers: of equal texts the least (doc_id, hash of the row) stays, and
each task sends one row a text.

Edge cases: a null text counts as empty; empty texts are equal to each other; a null doc_id sorts after all others;
repeated rows (same id, same text) are members of one group of which one row stays; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words of 16 bytes in the filter: a row for each of 4 words at first, 2**22 words (64 MB) at most.
ROWS_A_WORD, LEAST_BITS, MOST_BITS = 4, 10, 22


def normalised(text: Column) -> Column:
    """White-space runs become one space (a lone space is left alone, which is the same and cheaper)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _word(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1))


def _bit(h: Column) -> Column:
    """The bit of a row in its word, from a part of the hash that does not choose the word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int"))


def possibly_repeated(hashes: DataFrame, h: str, rows: int) -> tuple[DataFrame, int]:
    """(word, bits that were set more than once), and the number of bits that choose a word; from column ``h``."""
    bits = min(MOST_BITS, max(LEAST_BITS, (-(-rows // ROWS_A_WORD)).bit_length()))
    words = hashes.select(_word(F.col(h), bits).alias("_w"), _bit(F.col(h)).alias("_b")).groupBy("_w")
    words = words.agg(F.bit_or("_b").alias("_or"), F.bit_xor("_b").alias("_xor"), F.count(F.lit(1)).alias("_n"))
    often = F.col("_or").bitwiseAND(F.bitwise_not("_xor"))  # an even number of times
    known = F.col("_n") == F.bit_count("_xor") + 2 * F.bit_count(often)
    return words.select("_w", F.when(known, often).otherwise(F.col("_or")).alias("_filter")).where("_filter <> 0"), bits


def _tested(rows: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with _h) plus _maybe; the filter has at most 2**MOST_BITS rows."""
    out = rows.withColumn("_w", _word(F.col("_h"), bits)).join(F.broadcast(repeated), "_w", "left")
    return out.withColumn("_maybe", F.coalesce(F.col("_filter").bitwiseAND(_bit(F.col("_h"))) != 0, F.lit(False))).drop("_w", "_filter")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select("doc_id", normalised(docs["text"]).alias("_norm"))
    # numbered once, on disk: row numbers that are made anew can differ from one branch of a plan to another
    rows = stored(norm.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.xxhash64("_norm").alias("_h"), F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256")))
    tested = _tested(rows, *possibly_repeated(rows, "_h", rows.count()))
    alone = tested.where(~F.col("_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.where("_maybe").select("doc_id", "_row", "text_sha256")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    # written, so that the join is of two plain shuffles and a hot text's rows can be split over tasks
    groups = stored(maybe.groupBy("text_sha256").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size")))
    grouped = maybe.join(groups, "text_sha256").select("doc_id", F.col("_first.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_first.row")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; only possibly repeated rows are shuffled with their text."""
    carry = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(carry.alias("_carry"), normalised(docs["text"]).alias("_norm")).select("_carry", F.xxhash64("_norm").alias("_h"), F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"))
    hashes = stored(rows.select("_h"))
    tested = _tested(rows, *possibly_repeated(hashes, "_h", hashes.count()))
    alone = tested.where(~F.col("_maybe")).select("_carry.*")
    doc_id = F.col("_carry.doc_id")
    order = F.struct(doc_id.isNull(), doc_id, F.xxhash64("_carry"))  # rows equal in it are equal, or as good as
    return alone.unionByName(tested.where("_maybe").groupBy("_sha").agg(F.min_by("_carry", order).alias("_carry")).select("_carry.*"))
