"""Profile records, many at once, into graph tables: entities, relations, names of skills, and section documents.

A profile is one row of nested columns (null or missing lists are empty):

    person      struct(id, name, summary, headline, location, email, website, linkedin, github, work_authorization)
    skills      array of struct(group, names)
    experience  array of struct(id, title, organization, organization_description, organization_url, location, start, end, highlights, skills)
    projects    array of struct(id, name, summary, url, featured, period, role, highlights, skills)
    education   array of struct(id, degree, school, location, start, end, honors, note)
    awards      array of struct(id, name, year, project, organization)
    languages   array of struct(name, level)

Everything is a projection of exploded rows: one record never meets another here. Merging by id is ``graph.merge_entities``
and ``graph.merge_relations``; names of skills go through ``resolve.canonical``. A record without a person id gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import period, slugify


@dataclass
class ProfileGraph:
    entities: DataFrame  # id, type, name, description, url, aliases, sources, props, seq
    relations: DataFrame  # source, type, target, seq, level
    skills: DataFrame  # subject, type, name, domain, source, seq: names to resolve; type is null where a domain lists them
    docs: DataFrame  # id, title, kind, url, describes, text, subject, extract


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def _some(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _props(**values: Column) -> Column:
    made = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(made, lambda k, v: F.coalesce(v, F.lit("")) != "")


def _list(highlights: Column, mark: str = "- ") -> Column:
    return F.array_join(F.transform(F.coalesce(highlights, F.array().cast("array<string>")), lambda h: F.concat(F.lit(mark), _flat(h))), "\n")


def profile_graph(profiles: DataFrame, cv_url: str | None = None) -> ProfileGraph:
    """The tables of many profiles. ``seq`` orders what is said of one id: sections in the order above, then items."""
    rows = profiles.where(F.col("person.id").isNotNull()).select("*", F.concat(F.lit("person:"), F.col("person.id").cast("string")).alias("pid"))
    lit, none = F.lit, F.lit(None).cast("string")

    def each(section: str, at: int) -> DataFrame:
        return rows.select("pid", F.posexplode(section).alias("_i", "x")).withColumn("seq", (F.col("_i") + at * 1_000_000).cast("long"))

    def entity(df: DataFrame, id_, kind, name, description=None, url=None, source=None, props=None) -> DataFrame:
        return df.select(
            id_.alias("id"), lit(kind).alias("type"), name.alias("name"), (lit("") if description is None else description).alias("description"), (none if url is None else _some(url)).alias("url"),
            F.array().cast("array<string>").alias("aliases"), (F.array().cast("array<string>") if source is None else F.array(source)).alias("sources"), (F.create_map().cast("map<string,string>") if props is None else props).alias("props"), "seq",
        )

    def edge(df: DataFrame, a, kind, b, level=None) -> DataFrame:
        return df.select(a.alias("source"), lit(kind).alias("type"), b.alias("target"), "seq", (none if level is None else level).alias("level"))

    def doc(df: DataFrame, id_, title, text, describes, url=None, subject=None) -> DataFrame:
        return df.select(id_.alias("id"), title.alias("title"), lit("cv").alias("kind"), (lit(cv_url) if url is None else F.coalesce(_some(url), lit(cv_url))).alias("url"), describes.alias("describes"), text.alias("text"), (none if subject is None else subject).alias("subject"), lit(subject is not None).alias("extract"))

    def names(df: DataFrame, subject, kind, source) -> DataFrame:
        return df.select(subject.alias("subject"), lit(kind).cast("string").alias("type"), F.explode("x.skills").alias("name"), none.alias("domain"), source.alias("source"), "seq")

    x, own = (lambda c: F.col(f"x.{c}")), F.regexp_replace("pid", "^person:", "cv:")
    id_ = lambda prefix, c: F.concat(lit(prefix), c.cast("string"))
    org, place = lambda c: id_("org:", slugify(c)), lambda c: id_("loc:", slugify(c))
    given = lambda df, c: df.where(_some(F.col(c)).isNotNull())
    at = lambda *c: F.concat_ws(":", own, *[y.cast("string") for y in c])
    entities, relations, skills, docs = [], [], [], []

    p = rows.select("pid", F.col("person").alias("x"), "awards", "languages", lit(0).cast("long").alias("seq"))
    kept = ("headline", "location", "email", "website", "linkedin", "github", "work_authorization")
    entities.append(entity(p, F.col("pid"), "Person", x("name"), _flat(x("summary")), x("website"), lit("cv:summary"), _props(**{k: x(k) for k in kept})))
    located = given(p, "x.location")
    entities.append(entity(located, place(x("location")), "Location", x("location")))
    relations.append(edge(located, F.col("pid"), "LOCATED_IN", place(x("location"))))
    text = lambda c: F.coalesce(x(c).cast("string"), lit(""))
    spoken = F.array_join(F.transform(F.coalesce("languages", F.from_json(lit("[]"), p.schema["languages"].dataType)), lambda g: F.concat(g["name"], lit(" ("), F.coalesce(g.level, lit("")), lit(")"))), " | ")
    won = F.array_join(F.transform(F.coalesce("awards", F.from_json(lit("[]"), p.schema["awards"].dataType)), lambda g: F.concat(lit("- "), g["name"])), "\n")
    told = F.concat(
        lit("# "), x("name"), lit("\n\n"), text("headline"), lit("\n\nLocation: "), text("location"), lit(" · Email: "), text("email"), lit(" · "), F.concat_ws(" · ", _some(x("website")), _some(x("linkedin")), _some(x("github"))),
        lit("\n\n## Summary\n\n"), _flat(x("summary")), lit("\n\n## Languages\n\n"), spoken, lit("\n\n## Work authorization\n\n"), text("work_authorization"), lit("\n\n## Awards\n\n"), won,
    )
    docs.append(doc(p, at(lit("summary")), lit("CV — Summary"), told, F.array("pid")))

    s = each("skills", 1)
    domain = id_("domain:", slugify(x("group")))
    entities.append(entity(s, domain, "Domain", x("group"), F.concat(lit("Skill domain: "), x("group"))))
    skills.append(s.select(none.alias("subject"), none.alias("type"), F.explode("x.names").alias("name"), x("group").alias("domain"), lit("cv:skills").alias("source"), "seq"))
    line = F.concat(lit("- **"), x("group"), lit(":** "), F.array_join(x("names"), ", "))
    lines = s.groupBy("pid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda g: g.l), "\n").alias("t"))  # of one profile
    docs.append(doc(lines, at(lit("skills")), lit("CV — Technical skills"), F.concat(lit("# Technical skills\n\n"), "t"), F.array("pid")))

    e = each("experience", 2)
    when, first = period(x("start"), x("end")), F.coalesce(_flat(F.get(x("highlights"), lit(0))), lit(""))
    role, title = id_("role:", x("id")), F.concat_ws(" — ", x("title"), x("organization"))
    entities.append(entity(e, org(x("organization")), "Organization", x("organization"), text("organization_description"), x("organization_url"), lit("cv:summary")))
    entities.append(entity(
        e, role, "Role", title, F.concat(x("title"), lit(" at "), x("organization"), lit(" ("), text("location"), lit(", "), when, lit("). "), first), None, F.concat(lit("cv:experience:"), x("id").cast("string")),
        _props(title=x("title"), organization=x("organization"), start=x("start"), end=x("end"), period=when, current=_some(x("end")).isNull(), location=x("location"), highlights=_list(x("highlights"), "")),
    ))
    relations += [edge(e, F.col("pid"), "HELD_ROLE", role), edge(e, role, "AT", org(x("organization")))]
    seated = given(e, "x.location")
    entities.append(entity(seated, place(x("location")), "Location", x("location")))
    relations += [edge(seated, role, "LOCATED_IN", place(x("location"))), edge(seated, org(x("organization")), "LOCATED_IN", place(x("location")))]
    skills.append(names(e, role, "USED", F.concat(lit("cv:experience:"), x("id").cast("string"))))
    told = F.concat(lit("# "), title, lit("\n\n"), text("location"), lit(" · "), when, lit("\n\n"), text("organization_description"), lit("\n\n"), _list(x("highlights")))
    docs.append(doc(e, at(lit("experience"), x("id")), F.concat(lit("CV — "), x("title"), lit(", "), x("organization")), told, F.array(role, org(x("organization"))), subject=role))

    j = each("projects", 3)
    project = id_("project:", x("id"))
    entities.append(entity(j, project, "Project", x("name"), _flat(x("summary")), x("url"), F.concat(lit("cv:project:"), x("id").cast("string")), _props(featured=F.coalesce(x("featured"), lit(False)), period=x("period"), highlights=_list(x("highlights"), ""), source=lit("cv"))))
    relations += [edge(given(j, "x.role"), id_("role:", x("role")), "DELIVERED", project), edge(j, F.col("pid"), "BUILT", project)]
    skills.append(names(j, project, "USES", F.concat(lit("cv:project:"), x("id").cast("string"))))
    told = F.concat(lit("# Project: "), x("name"), lit("\n\n"), text("summary"), lit("\n\n"), _list(x("highlights")), F.coalesce(F.concat(lit("\n\nLive: "), _some(x("url"))), lit("")))
    docs.append(doc(j, at(lit("project"), x("id")), F.concat(lit("CV — Project: "), x("name")), told, F.array(project), x("url"), project))

    d = each("education", 4)
    degree, span = id_("degree:", x("id")), period(x("start"), x("end"))
    entities.append(entity(d, org(x("school")), "Organization", x("school"), lit("University / school"), None, lit("cv:summary")))
    about = F.concat(x("degree"), lit(", "), x("school"), lit(" ("), span, lit(")"), F.coalesce(F.concat(lit(", "), _some(x("honors"))), lit("")), F.coalesce(F.concat(lit(" — "), _some(x("note"))), lit("")))
    entities.append(entity(d, degree, "Degree", x("degree"), about, None, lit("cv:education"), _props(school=x("school"), start=x("start"), end=x("end"), period=F.coalesce(_some(x("note")), span), honors=x("honors"))))
    relations += [edge(d, F.col("pid"), "STUDIED", degree), edge(d, degree, "AT", org(x("school")))]
    seated = given(d, "x.location")
    entities.append(entity(seated, place(x("location")), "Location", x("location")))
    relations.append(edge(seated, org(x("school")), "LOCATED_IN", place(x("location"))))
    line = F.concat(lit("- "), x("degree"), F.coalesce(F.concat(lit(" — "), _some(x("honors"))), lit("")), lit(" | "), x("school"), lit(" | "), F.coalesce(_some(x("note")), span))
    lines = d.groupBy("pid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda g: g.l), "\n").alias("t"))  # of one profile
    docs.append(doc(lines, at(lit("education")), lit("CV — Education"), F.concat(lit("# Education\n\n"), "t"), F.array("pid")))

    a = each("awards", 5)
    award = id_("award:", x("id"))
    entities.append(entity(a, award, "Award", x("name"), F.concat(x("name"), lit(" ("), text("year"), lit(")")), None, lit("cv:summary"), _props(year=x("year"))))
    giver = given(a, "x.organization")
    entities.append(entity(giver, org(x("organization")), "Organization", x("organization"), None, None, lit("cv:summary")))
    relations += [edge(a, F.col("pid"), "WON", award), edge(given(a, "x.project"), award, "AWARDED_FOR", id_("project:", x("project"))), edge(giver, award, "AWARDED_BY", org(x("organization")))]

    g = each("languages", 6)
    tongue = id_("lang:", slugify(x("name")))
    entities.append(entity(g, tongue, "Language", x("name"), F.concat(x("name"), lit(" — "), text("level")), None, lit("cv:summary"), _props(level=x("level"))))
    relations.append(edge(g, F.col("pid"), "SPEAKS", tongue, x("level")))
    return ProfileGraph(*[reduce(DataFrame.unionByName, t) for t in (entities, relations, skills, docs)])
