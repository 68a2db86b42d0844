"""Which questions may run: an audit of graph queries, and read-only SQL over a graph's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that change data, and prefixes of procedures.
FORBIDDEN = ("CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "LOAD", "FOREACH", "CALL", "ALTER", "RENAME", "GRANT", "DENY", "REVOKE", "TERMINATE", "USE", "FINISH", "INSERT")
PROCEDURES = ("apoc.", "dbms.", "db.")
MOST_ROWS = 50


def refusal(query: Column) -> Column:
    """Why a graph query is not read-only; null if it is. Words in string literals do not count, a null is empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|[\s;]+\z", ""), r"^\s+", "")
    told = F.regexp_replace(bare, r"""'(?:[^'\\]|\\[\s\S])*+'|"(?:[^"\\]|\\[\s\S])*+\"""", "''")
    word = F.regexp_extract(told, rf"(?i)\b(?:{'|'.join(FORBIDDEN)})\b|{'|'.join(p.replace('.', chr(92) + '.') for p in PROCEDURES)}", 0)
    return (
        F.when(bare == "", "Empty query")
        .when(F.contains(bare, F.lit(";")), "Multiple statements are not allowed")
        .when(word != "", F.concat(F.lit("Forbidden clause: "), word))
        .when(~told.rlike(r"(?i)\bRETURN\b"), "Query must RETURN something")
    )


def ask(spark: SparkSession, sql: str, views: dict[str, DataFrame], limit: int = MOST_ROWS) -> DataFrame:
    """At most ``limit`` rows of one SELECT (or WITH) over the views; as a subquery it can be nothing else."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM (\n{sql}\n) LIMIT {int(limit)}")
