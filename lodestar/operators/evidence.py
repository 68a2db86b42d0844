"""Evidence and fit: how strongly skills are shown, and how far requirements are met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import role_years


def skill_evidence(roles: DataFrame, role_skills: DataFrame, project_skills: DataFrame, skills: DataFrame, as_of: Column) -> DataFrame:
    """(id, strength, evidence, years, last_used) by skill.

    roles(id, start, end, current); role_skills and project_skills(source, skill); skills(id, listed, verified).
    """
    spent = role_years(F.col("start"), F.col("end"), as_of)
    by_role = role_skills.distinct().join(roles.select(F.col("id").alias("source"), "start", "end", "current"), "source").groupBy("skill").agg(
        F.sum(0.35 + 0.1 * F.least(spent, F.lit(4.0))).alias("r"), F.count(F.lit(1)).alias("n_roles"), F.sum(spent).alias("years"), F.max(F.date_format("end", "yyyy-MM")).alias("last"), F.bool_or("current").alias("now")
    )
    by_project = project_skills.distinct().groupBy("skill").agg(F.count(F.lit(1)).alias("n_projects"))
    flag = lambda c, x: F.when(F.col(c), x).otherwise(0.0)
    joined = skills.join(by_role, skills.id == by_role.skill, "left").drop("skill").join(by_project, skills.id == by_project.skill, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    strength = zero("r") + F.least(F.lit(0.45), 0.15 * zero("n_projects")) + flag("listed", 0.12) + flag("verified", 0.08)
    return joined.where(strength > 0).select(
        "id", F.round(F.round(F.least(F.lit(1.0), strength), 6), 2).alias("strength"), (zero("n_roles") + zero("n_projects")).alias("evidence"), F.round(F.round(zero("years"), 6), 1).alias("years"), F.when(F.col("now"), "present").otherwise(F.col("last")).alias("last_used")
    )


#: What a status earns, in twentieths of the whole, and what an importance weighs.
EARNED = {"strong": 20, "partial": 12, "transferable": 7, "gap": 0}
MUST, NICE = 2, 1


def fit_score(requirements: DataFrame, grades: DataFrame) -> DataFrame:
    """By job_id: percent (half-even), counts by status and unmet musts; a requirement without a grade is a gap.

    Sums and the division are of whole numbers, so the result is the exact one whatever the order or the partitions; sums
    of floating-point shares would round halves either way.
    """
    status = F.coalesce("status", F.lit("gap"))
    weight = F.when(F.col("importance") == "must", MUST).otherwise(NICE)
    earned = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in EARNED.items() for x in (k, v)]), F.col("status")), F.lit(0))
    graded = requirements.join(grades.select("job_id", "idx", "status"), ["job_id", "idx"], "left").withColumn("status", status)
    sums = graded.groupBy("job_id").agg(
        F.sum(100 // EARNED["strong"] * weight * earned).alias("_n"),
        F.sum(weight).alias("_of"),
        *[F.count_if(F.col("status") == s).alias(s) for s in EARNED],
        F.count_if((F.col("status") == "gap") & (F.col("importance") == "must")).alias("must_have_gaps"),
    )
    whole, twice = F.expr("_n div _of"), 2 * (F.col("_n") % F.col("_of"))
    up = F.when(twice == F.col("_of"), whole % 2).otherwise((twice > F.col("_of")).cast("long"))
    return sums.select("job_id", (whole + up).alias("percent"), *EARNED, "must_have_gaps")


def shares(rows: DataFrame, group: str, kind: str, size: str, least: float = 0.05) -> DataFrame:
    """Kinds that make up at least ``least`` of their group's size."""
    sums = rows.groupBy(group, kind).agg(F.sum(size).alias("size"))
    return sums.withColumn("share", F.round(F.col("size") / F.sum("size").over(Window.partitionBy(group)), 6)).where(F.col("share") >= least)
