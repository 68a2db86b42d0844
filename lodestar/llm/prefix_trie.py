"""The trie of conversation prefixes, by ROLLUP over positional turn columns (operator 12).

A turn's id is a digest of its role and text, followed by its text's length in bytes. A conversation is written in blocks of
BLOCK turns, a row a block with a column a turn; a block is keyed by the node that ends the block before it. One ROLLUP over
the turn columns then aggregates all prefixes of all blocks together, and grouping_id tells how long each prefix is. A second
ROLLUP over the nodes sums what stands below each. What stands in later blocks is carried to the node where they begin; those
sums take a round for each doubling of the number of blocks, not one for each block.

No text is shuffled, and no members are gathered: n_convs, the smallest member and the exclusive-or of the members (which
names the one that ends at a node) are combined before the shuffle. Nodes where many conversations end have their members
dealt by ranges, joined to strings of CHUNK ids there, and hashed as a stream.

Edge cases: a null role or text is empty; a null turn comes first; rows of one conversation and one turn are ordered by their
digest; rows without a conv_id take no part; repeated rows are turns of their own; a conversation without turns belongs to
the root alone; an empty table gives no rows; other columns are ignored. A conversation's turns are ordered in one task, on
disk where they are many; of one with more than BLOCK turns the blocks' digests (two bytes a turn) meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

BLOCK, CHUNK = 8, 8_192
#: Bytes of a digest, and of a turn's id.
DIGEST, TURN = 16, 24
#: A conversation takes the first turns of the first of its group of FAMILY; MOST is one more than the most that it can take.
FAMILY, MOST = 5, 9


def _digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, DIGEST)


def _binary(text: str) -> Column:
    return F.lit(text.encode())


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id): the turns of each conversation from 1, in order."""
    role, text = (F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8") for c in ("role", "text"))
    size = lambda c: F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(_digest(F.concat(size(role), role, text)), size(text)).alias("id"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "id")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "id")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations that there are, their turns anew): the first h turns of the conversation that heads the family, then
    the own turns behind the first h; h is the id's crc32 modulo MOST."""
    head = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    convs = turns.select("conv_id").distinct()
    fronts = turns.where((F.col("conv_id") == head) & (F.col("pos") < MOST))  # a few rows a family
    taken = convs.select("conv_id", head.alias("head"), h.alias("h")).join(fronts.withColumnRenamed("conv_id", "head"), "head").where("pos <= h").select("conv_id", "pos", "id")
    sizes = fronts.groupBy(F.col("conv_id").alias("head")).agg(F.count(F.lit(1)).cast("int").alias("size"))
    own = turns.where(F.col("pos") > h).select("conv_id", "pos", "id", head.alias("head"), h.alias("h")).join(sizes, "head", "left")
    moved = own.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0)))).alias("pos"), "id")
    return convs, taken.unionByName(moved)


def _in_blocks(convs: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """(conv_id, b, prior, t1, ...): a row a conversation and block; prior is the key of the node before the block."""
    at = F.col("pos") - 1
    placed = turns.select("conv_id", F.floor(at / width).cast("int").alias("b"), (at % width).cast("int").alias("k"), "id")
    every = placed.unionByName(convs.select("conv_id", F.lit(0).alias("b"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("binary").alias("id")))
    blocks = stored(every.groupBy("conv_id", "b").agg(*[F.max(F.when(F.col("k") == i, F.col("id"))).alias(f"t{i + 1}") for i in range(width)]))
    columns = [f"t{i + 1}" for i in range(width)]
    first = blocks.where("b = 0").select("conv_id", "b", _binary("").alias("prior"), *columns)
    long = blocks.where("b > 0").select("conv_id").distinct()
    told = blocks.where(F.col(columns[-1]).isNotNull()).join(long, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("b", _digest(F.concat(*columns)).alias("d")))).alias("full"))
    chain = F.aggregate("full", F.array(_binary("")), lambda found, x: F.array_append(found, _digest(F.concat(F.element_at(found, -1), x.d))))
    priors = told.select("conv_id", F.posexplode(chain).alias("b", "prior"))
    return first.unionByName(blocks.where("b > 0").join(priors, ["conv_id", "b"]).select("conv_id", "b", "prior", *columns))


def _key(columns: list[str]) -> Column:
    """Of a block's row, cut after some turns, the key of the node there."""
    data = F.concat("prior", *[F.coalesce(c, _binary("")) for c in columns])
    full = _digest(F.concat("prior", _digest(F.concat(*columns))))
    return F.when(F.col(columns[0]).isNull(), F.col("prior")).when(F.col(columns[-1]).isNotNull(), full).otherwise(_digest(data))


def _parent(columns: list[str]) -> Column:
    data = F.concat("prior", *[F.coalesce(c, _binary("")) for c in columns])
    return F.when(F.col("d") == 1, F.col("prior")).otherwise(_digest(F.substring(data, F.lit(1), F.octet_length(data) - TURN)))


def _rollup(rows: DataFrame, columns: list[str], measures: str) -> DataFrame:
    """All prefixes of the turn columns within each block, with their length d; turns that a row does not have make none."""
    level = f"{len(columns)} - bit_count(grouping_id())"
    found = rows.sparkSession.sql(f"SELECT b, prior, {', '.join(columns)}, {level} AS d, {measures} FROM {{rows}} GROUP BY b, prior, ROLLUP({', '.join(columns)})", rows=rows)
    ends_there = F.greatest(*[F.when(F.col("d") == i + 1, F.col(c).isNotNull()) for i, c in enumerate(columns)], (F.col("d") == 0) & (F.col("b") == 0))
    return found.where(ends_there)


def _below(nodes: DataFrame, width: int) -> DataFrame:
    """(key, saved, leaves): what the blocks below a node that fills its block hold in all, for nodes with such blocks."""
    own = nodes.where("b > 0").groupBy(F.col("prior").alias("key")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    up = nodes.where(F.col("d") == width).select("key", F.when(F.col("b") > 0, F.col("prior")).alias("up"))
    now = cut(own.join(up, "key"))
    while not now.where("up is not null").isEmpty():  # sums over twice as many generations of blocks a round
        more = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        above = now.select(F.col("key").alias("up"), F.col("up").alias("upper"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        now = cut(now.join(more, "key", "left").join(above, "up", "left").select("key", (F.col("saved") + zero("s")).alias("saved"), (F.col("leaves") + zero("l")).alias("leaves"), F.col("upper").alias("up")))
    return now.select("key", "saved", "leaves")


def _hashed(ends: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of the members (key, conv_id) of each key, ascending and joined by commas. Ranges of members are
    joined to strings where they lie, so the task that hashes a hot key reads a row for CHUNK of them, one after another."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # sorted by key and member
            n = b.groupby("key", sort=False).cumcount() // CHUNK
            yield b.assign(n=n).groupby(["key", "n"], sort=False)["conv_id"].agg(first="min", ids=lambda x: ",".join(map(str, x))).reset_index()[["key", "first", "ids"]]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            done = []
            for key, ids in zip(b["key"], b["ids"]):
                if key == now:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["key", "sha"])
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["key", "sha"])

    ends = ends.select(F.hex("key").alias("key"), "conv_id")
    chunks = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(joined, "key string, first long, ids string")
    found = chunks.repartition("key").sortWithinPartitions("key", "first").mapInPandas(hashed, "key string, sha string")
    return found.select(F.unhex("key").alias("key"), "sha")


def prefix_trie(convs: DataFrame, turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """One row a node of the trie of turns(conv_id, pos from 1 without gaps, id as ``numbered`` makes them) of convs(conv_id)."""
    columns = [f"t{i + 1}" for i in range(width)]
    paths = stored(_in_blocks(convs, turns, width))
    found = _rollup(paths, columns, "count(*) AS n_convs, min(conv_id) AS conv_id, bit_xor(conv_id) AS members")
    last = F.coalesce(*[F.col(c) for c in reversed(columns)])
    size = F.when(F.col("d") > 0, F.conv(F.hex(F.substring(last, DIGEST + 1, TURN - DIGEST)), 16, 10).cast("long")).otherwise(0)
    keyed = stored(found.select("*", _key(columns).alias("key"), F.when((F.col("d") > 0), _parent(columns)).alias("parent"), ((F.col("n_convs") - 1) * size).alias("saved")))
    children = keyed.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_convs").alias("n_further"), F.bit_xor("members").alias("further"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    nodes = keyed.join(children, "key", "left").withColumns({"n_children": zero("n_children"), "n_ends": F.col("n_convs") - zero("n_further"), "ended": F.col("members").bitwiseXOR(zero("further"))})
    nodes = stored(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).drop("members", "n_further", "further"))

    below = _below(nodes, width)
    nodes_up = nodes.join(below.select("key", F.col("saved").alias("s"), F.col("leaves").alias("l")), "key", "left").withColumns({"saved": F.col("saved") + zero("s"), "leaves": F.col("leaves") + zero("l")})
    # of the nodes that a prefix holds, the one of its own length is the shortest
    own = "min(struct(own, key, conv_id, parent, n_convs, n_children, n_ends, ended)) AS node"
    sums = _rollup(nodes_up.withColumnRenamed("d", "own"), columns, f"sum(saved) AS saved_tokens, sum(leaves) AS n_leaves, {own}")
    whole = sums.select("node.*", "saved_tokens", "n_leaves", (F.col("b") * width + F.col("node.own")).cast("long").alias("depth"))

    shared = nodes.where("n_ends > 1").select("key")
    full = F.col(columns[-1]).isNotNull()
    further = paths.where("b > 0").select("conv_id", (F.col("b") - 1).alias("b"))
    ended = paths.where(~full).unionByName(paths.where(full).join(further, ["conv_id", "b"], "left_anti"))
    ends = stored(ended.select(_key(columns).alias("key"), "conv_id").join(shared, "key", "left_semi"))
    sha = F.coalesce("sha", F.sha2(F.when(F.col("n_ends") == 1, F.col("ended").cast("string")).otherwise("").cast("binary"), 256))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(_hashed(ends), "key", "left").join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt."""
    return prefix_trie(*rebuilt(stored(numbered(conversations))))
