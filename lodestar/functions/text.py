"""Text expressions as columns: names, slugs, citations, query terms, snippets. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to, made from Unicode's decompositions.
_FROM = [chr(c) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and ord(d[0]) < 128]
_TO = [unicodedata.normalize("NFKD", c)[0] for c in _FROM]
#: Words that carry no meaning in a question (English and French). Names to leave out are the caller's.
STOP = tuple(
    """
    a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its
    me my of on or our she should so than that the their them then there these they this to was we were what when where
    which who whom why will with would you your about any tell him experience
    le la les l de des du d et en est il elle un une quel quels quelle quelles sur avec pour dans par qu que qui quoi ou
    où son sa ses ce cette ces au aux a-t-il t-il est-ce
    """.split()
)
MOST_TERMS = 24
TERM = r"[\p{L}\p{N}_.+#-]+"


def folded(text: Column) -> Column:
    """Lower case ASCII: accents drop, other letters go."""
    return F.regexp_replace(F.lower(F.translate(text, "".join(_FROM), "".join(_TO))), r"[^\x00-\x7F]", "")


def spelled(text: Column) -> Column:
    """Folded, with ++ and # as letters, so that C, C++ and C# stay apart."""
    return F.replace(F.replace(folded(text), F.lit("++"), F.lit("pp")), F.lit("#"), F.lit("sharp"))


def normalize_name(text: Column) -> Column:
    return F.regexp_replace(spelled(text), "[^a-z0-9]", "")


def slugify(text: Column, most: int = 80) -> Column:
    slug = F.regexp_replace(F.regexp_replace(spelled(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, most), "-+$", ""), F.lit("")), F.lit("item"))


#: Marks around a skill's name, notes behind it, and a version at its end.
AROUND = r"""^[\s\-*•"'`]+|[\s\-*•"'`]+$"""
NOTE = r"(?i)\s*\((optional|coming soon|planned|future)\)\s*$"
VERSION = r"(?i)\s+v?\d+(\.\d+|\.x)*\+?$"


def clean_skill_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, AROUND, ""), NOTE, ""), r"\s+", " "))


def strip_version(text: Column) -> Column:
    return F.regexp_replace(text, VERSION, "")


def snippet(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", ""), F.lit("…")))


#: Fixed value: numbers in brackets, alone, listed or as ranges, with no link after them.
CITATION = r"\[(\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*)\](?!\()"
MOST_SPAN = 12


def citation_refs(text: Column) -> Column:
    """Numbers cited as [3], [2, 16], [2; 16] or [4-6], not when a link follows; distinct, sorted.

    A range that falls, or over MOST_SPAN wide, gives its bounds alone; so does one with three bounds or more.
    """
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda g: F.split(g, "[,;]")))
    bounds = F.transform(listed, lambda p: F.transform(F.split(p, "[–-]"), lambda n: F.trim(n).cast("int")))
    short = lambda b: (F.size(b) == 2) & F.get(b, F.lit(1)).between(F.get(b, F.lit(0)), F.get(b, F.lit(0)) + MOST_SPAN)
    spread = F.transform(bounds, lambda b: F.when(short(b), F.sequence(F.get(b, F.lit(0)), F.greatest(F.get(b, F.lit(0)), F.get(b, F.lit(1))))).otherwise(b))
    return F.array_sort(F.array_distinct(F.flatten(spread)))


def truncate(text: Column, most: int, around: str = r"\s", behind: str = r"\s") -> Column:
    """Trimmed, at most ``most`` letters, the last an ellipsis where something was cut; ``around`` and ``behind`` are the letters
    that go at its ends and before the ellipsis."""
    bare = F.regexp_replace(text, rf"\A{around}+|{around}+\z", "")
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.regexp_replace(F.substring(bare, 1, most - 1), rf"{behind}+\z", ""), F.lit("…")))


def passage_title(doc_title: Column, section: Column) -> Column:
    doc = F.coalesce(F.nullif(doc_title, F.lit("")), F.lit("Document"))
    return F.when((F.coalesce(section, F.lit("")) != "") & (section != doc), F.concat_ws(" › ", doc, section)).otherwise(doc)


def embedding_text(kind: Column, name: Column, aliases: Column, description: Column, highlights: Column) -> Column:
    """What an entity's vector is made of: at most six aliases and four highlights, 4000 letters in all."""
    also = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(F.lit("(also known as "), F.array_join(F.slice(aliases, 1, 6), ", "), F.lit(")")))
    told = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("— "), description))
    return F.substring(F.concat_ws(" ", F.concat_ws(": ", kind, name), also, told, F.when(highlights.isNotNull(), F.array_join(F.slice(highlights, 1, 4), " "))), 1, 4000)


def month(value: Column) -> Column:
    """The first day of a month written YYYY-MM, or of a year; null otherwise."""
    found = lambda i: F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"^(\d{4})(?:-(\d{2}))?", i)
    return F.when(found(1) != "", F.try_make_timestamp(found(1).cast("int"), F.coalesce(F.nullif(found(2), F.lit("")), F.lit("1")).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def period(start: Column, end: Column) -> Column:
    shown = lambda c, empty: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(empty))
    return F.concat_ws(" – ", shown(start, "?"), shown(end, "present"))


def unit(vector: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(x.cast("double")))


def distinctive(alias: Column) -> Column:
    """Whether an alias is telling enough to be looked for in texts."""
    return (F.length(alias) >= 6) & alias.rlike(r"[\d.\-+#/ ]|^\p{Lu}")


#: What a relation is called, seen from its source (out) and its target (in).
LABELS = {
    ("HELD_ROLE", "out"): "Roles",
    ("HELD_ROLE", "in"): "Held by",
    ("AT", "out"): "At",
    ("AT", "in"): "Roles & degrees here",
    ("BUILT", "out"): "Projects",
    ("BUILT", "in"): "Built by",
    ("DELIVERED", "out"): "Delivered projects",
    ("DELIVERED", "in"): "Delivered during",
    ("USES", "out"): "Tech stack",
    ("USES", "in"): "Used in projects",
    ("USED", "out"): "Skills used",
    ("USED", "in"): "Used in roles",
    ("HAS_SKILL", "out"): "Skills",
    ("HAS_SKILL", "in"): "Skill of",
    ("IN_DOMAIN", "out"): "Domain",
    ("IN_DOMAIN", "in"): "Skills in this domain",
    ("RELATED_TO", "out"): "Related",
    ("RELATED_TO", "in"): "Related",
    ("STUDIED", "out"): "Education",
    ("SPEAKS", "out"): "Languages",
    ("WON", "out"): "Awards",
    ("AWARDED_FOR", "out"): "For project",
    ("AWARDED_FOR", "in"): "Awards",
    ("AWARDED_BY", "out"): "Awarded by",
    ("AWARDED_BY", "in"): "Awards given",
    ("LOCATED_IN", "out"): "Location",
    ("LOCATED_IN", "in"): "Located here",
}


def relation_label(kind: Column, direction: Column, node_type: Column) -> Column:
    """A relation's display label; others are their own name in title case."""
    named = F.create_map(*[F.lit(x) for (k, d), v in LABELS.items() for x in (f"{k}|{d}", v)])
    own = F.when((node_type == "Person") & (kind == "HAS_SKILL"), F.lit("Skills"))
    return F.coalesce(own, F.try_element_at(named, F.concat_ws("|", kind, direction)), F.initcap(F.lower(F.replace(kind, F.lit("_"), F.lit(" ")))))


def quota(error: Column) -> Column:
    """(retry_after in seconds, daily) from the JSON of a refused call; what cannot be read says nothing."""
    detail = "array<struct<retryDelay:string,violations:array<struct<quotaId:string>>>>"
    items = F.coalesce(*[F.from_json(F.get_json_object(error, f"$.{at}"), detail) for at in ("error.details", "details")], F.array().cast(detail))
    delays = F.filter(F.transform(items, lambda i: i.retryDelay), lambda d: F.coalesce(d, F.lit("")) != "")
    last = F.regexp_replace(F.get(delays, F.size(delays) - 1), "s+$", "")
    spent = F.exists(items, lambda i: F.exists(F.coalesce(i.violations, F.array().cast("array<struct<quotaId:string>>")), lambda v: F.coalesce(F.contains(v.quotaId, F.lit("PerDay")), F.lit(False))))
    return F.struct(F.when(last.rlike(r"^-?\d+(\.\d+)?$"), last.cast("double")).alias("retry_after"), spent.alias("daily"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct terms of a question, without stop words and single letters, at most MOST_TERMS in order."""
    return F.slice(F.array_distinct(F.filter(terms(text), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP))), 1, MOST_TERMS)


def role_years(start: Column, end: Column, as_of: Column) -> Column:
    """Years of a role from months: at least 0.1; half a year without a start; up to ``as_of`` without an end."""
    last = F.coalesce(end, as_of)
    span = F.year(last) - F.year(start) + (F.month(last) - F.month(start) + 1) / 12
    return F.when(start.isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), span))
