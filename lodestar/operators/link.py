"""Entity linking: names looked up by normal form, and names found in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import STOP, normalize_name

#: Types whose names win, in this order; all others come after them.
PRIORITY = ("Skill", "Project", "Organization", "Role", "Domain")
LONGEST, MOST = 4, 8


def _priority(kind: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, PRIORITY)), F.coalesce(kind, F.lit("")))
    return F.when(at > 0, at).otherwise(len(PRIORITY) + 1)


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, id, type): every name and alias of nodes(id, type, name, aliases, seq) in normal form, one entity each: the
    first type by PRIORITY, then the first by seq and id. Names without letters or digits have no key."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keyed = nodes.select("id", "type", "seq", F.explode(names).alias("n")).select("id", "type", "seq", normalize_name(F.col("n")).alias("key")).where("key <> ''")
    first = F.min(F.struct(_priority(F.col("type")).alias("p"), "seq", "id", "type"))
    return keyed.groupBy("key").agg(first.alias("f")).select("key", "f.id", "f.type")


def lookup(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked(name, ...) with the id and type of the entity of that name, else of its plural, else of its singular (names
    over three letters); names that mean nothing go. All other columns of ``asked`` stay."""
    key = normalize_name(F.col("name"))
    tries = F.array(key, F.concat(key, F.lit("s")), F.when(key.endswith("s") & (F.length(key) > 3), F.substring(key, F.lit(1), F.length(key) - 1)))
    rows = asked.withColumn("_row", F.struct(*asked.columns)).where(key != "")
    met = rows.select("_row", F.posexplode(tries).alias("_p", "key")).where("key is not null").join(index, "key")
    return met.groupBy("_row").agg(F.min(F.struct("_p", "id", "type")).alias("f")).select("_row.*", "f.id", "f.type")


def mentioned(questions: DataFrame, index: DataFrame, stop: tuple[str, ...] = STOP) -> DataFrame:
    """(qid, id, position): entities that questions(qid, text) name, at most MOST each, no Person.

    Runs of four words to one are looked up, longer ones first; a single stop word is no name. A run is a row, so a long
    question is many rows and no group: the runs' lookups are joins by equality.
    """
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "?,", "  "), r"\s+"), lambda w: w != "")
    split = questions.select("qid", words.alias("w")).where(F.size("w") > 0)

    def runs_of(n: int) -> Column:
        run = lambda i: F.struct(F.lit(LONGEST - n).alias("shorter"), i.alias("at"), F.array_join(F.slice("w", i, n), " ").alias("name"))
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), run)).otherwise(F.array().cast("array<struct<shorter:int,at:int,name:string>>"))

    runs = [runs_of(n) for n in range(LONGEST, 0, -1)]
    asked = split.select("qid", F.explode(F.concat(*runs)).alias("r")).select("qid", "r.*")
    asked = asked.where((F.length("name") >= 2) & ~((F.col("shorter") == LONGEST - 1) & F.lower("name").isin(*stop)))
    found = lookup(asked, index).where("type <> 'Person'").groupBy("qid", "id").agg(F.min(F.struct("shorter", "at")).alias("at"))
    w = Window.partitionBy("qid").orderBy("at", "id")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= MOST).select("qid", "id", "position")


def hinted(hints: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, id) of hints(qid, name), as often as they are given."""
    return lookup(hints.select("qid", "name", F.monotonically_increasing_id().alias("_n")), index).select("qid", "id")
