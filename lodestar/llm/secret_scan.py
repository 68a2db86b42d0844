"""Secret scanning with a random forest that removes false positives (operator 5, native).

Candidates are runs of key-like characters, any number in a word: compact JSON, CSV and URLs are cut at their quotes,
separators and ``name=``, and a form of a known issuer inside a longer run is a candidate of its own. A run has LEAST or
more characters, or LEAST_NAMED or more (marks too) where a telling name is assigned to it. Each gets features of its length, character classes and transitions, share covered by dictionary words, path signs and the
neighbouring words. A random forest trained from labelled findings decides; its trees are then written as one Column
expression, so that scanning happens inside each row: no shuffle, no Python.

Fitted are, outside the test fold, the dictionary (the DICTIONARY commonest words of all texts), and, on a bounded sample
and made-up keys and passwords, the forest (the SAMPLE_FINDINGS findings with the smallest hash). Every word of every
text is scanned.

Edge cases: null and empty texts have no findings; a secret that occurs twice is two findings; repeated rows repeat
their findings; with no labelled finding of either kind the forest is that kind alone; an empty table gives no rows;
other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, free, smallest

TREES, DEPTH, SEED, CUT = 15, 5, 7, 0.5
SAMPLE_DOCS, DICTIONARY, SAMPLE_FINDINGS, TASKS = 20_000, 250, 20_000, 24
LEAST, LEAST_NAMED, LEAST_MIXED = 16, 4, 8
FEATURES = ["len", "digits", "uppers", "transitions", "distinct", "hex", "words", "paths", "dots", "assigned", "named", "example", "letters", "strict", "issuer"]
#: Names before a secret, and words beside a made-up one.
NAMES = "secret|token|passw|pwd|api|key|auth|credential|bearer"
EXAMPLES = "example|sample|dummy|placeholder|changeme|xxxx|your"


STRICT = "passw|pwd|secret|credential"
ISSUED = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}"
#: A run (1; after a separator, of all but delimiters) with its padding, and the separator behind it (2).
_SEP, _ENDS = r"""["'\\)\]]*[:=]+>?["'\\]*""", r"""\s,;&<>(){}\[\]|`"""
RUN = rf"""((?:(?<=[:=>]["'\\]{{0,3}})[^"'\\:={_ENDS}]++|[A-Za-z0-9_+/.~-]++)(?:={{1,2}}(?=["'\\]*(?:$|[{_ENDS}])))?)({_SEP})?"""
#: A name at the end of a text, with and without its separator, and a telling name with one anywhere.
_NAME = r"""([A-Za-z0-9_.-]{1,64})["'\\)\]]{0,3}"""
NAMED, LAST = _NAME + r"""\s*[:=]+>?\s*["'\\]*$""", _NAME + "$"
TELLING = rf"""(?i)(?:{NAMES})[A-Za-z0-9_.-]{{0,64}}["'\\)\]]{{0,3}}\s*[:=]"""


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(word: Column, before: Column, before2: Column) -> Column:
    """Array of (v, name) of a word's runs; the name may stand in the words before."""
    name = F.when(word.rlike(r"""^["'\\]*[:=]"""), F.regexp_extract(before, LAST, 1)).otherwise(F.regexp_extract(F.concat_ws(" ", before2, before), NAMED, 1))
    lead = F.when((name == "") | word.rlike(r"""^["'\\]*[:=]"""), name).otherwise(F.concat(name, F.lit("=")))
    part = lambda i: F.regexp_extract_all(F.concat(lead, word), F.lit(RUN), F.lit(i))
    parts = F.struct(part(1).alias("v"), part(2).alias("sep"), (name != "").cast("int").alias("from"))
    bare = lambda v: F.regexp_replace(v, r"^[^A-Za-z0-9/+_$!@#%^*]+|[.~?-]+$", "")
    named = lambda p: F.transform(p.v, lambda v, k: F.struct(k.alias("k"), v.alias("v"), F.when((k > 0) & (F.get(p.sep, k - 1) != ""), F.get(p.v, k - 1)).otherwise("").alias("name")))
    own = rf"(?<![A-Za-z0-9])(?:{ISSUED})"
    pieces = lambda v: F.concat(F.transform(F.split(v, own, -1), bare), F.regexp_extract_all(v, F.lit(own), F.lit(0)))
    every = lambda r: F.transform(pieces(r.v), lambda v: F.struct(v.alias("v"), r["name"].alias("name")))
    return _let(parts, lambda p: F.flatten(F.transform(F.filter(named(p), lambda r: r.k >= p["from"]), every)))


def _candidates(text: Column) -> Column:
    """Array of (at, v, word, name, before, before2, after) of a text."""
    near = lambda ws, i: F.coalesce(F.get(ws, i), F.lit(""))
    key_like = lambda w: (F.length(w) >= LEAST) & w.rlike("[A-Za-z0-9_+/=.-]{%d}" % LEAST)
    told = lambda ws, w, i: w.rlike(TELLING) | F.concat_ws(" ", near(ws, i - 2), near(ws, i - 1)).rlike(TELLING) | (w.rlike(r"""^["'\\]*[:=]""") & F.lower(near(ws, i - 1)).rlike(NAMES))
    some = lambda ws, keep: F.filter(F.transform(ws, lambda w, i: F.when(keep(w, i), i)), lambda i: i.isNotNull())

    def found(ws: Column) -> Column:
        at = F.when(text.rlike(TELLING), some(ws, lambda w, i: key_like(w) | told(ws, w, i))).otherwise(some(ws, lambda w, i: key_like(w)))
        words = F.transform(at, lambda i: F.struct(i.alias("at"), F.get(ws, i).alias("word"), near(ws, i - 1).alias("before"), near(ws, i - 2).alias("before2"), near(ws, i + 1).alias("after")))
        full = lambda x: F.transform(
            _runs(x.word, x.before, x.before2), lambda r: F.struct(x["at"].alias("at"), r.v.alias("v"), x.word.alias("word"), r["name"].alias("name"), x.before.alias("before"), x.before2.alias("before2"), x.after.alias("after"))
        )
        return F.flatten(F.transform(words, full))

    whole = lambda c: (F.length(c.v) >= LEAST) & c.v.rlike("[A-Za-z0-9_+/=.-]{%d}" % LEAST)
    return F.filter(_let(F.split(F.coalesce(text, F.lit("")), r"\s+"), found), lambda c: whole(c) | ((F.length(c.v) >= LEAST_NAMED) & F.lower(c["name"]).rlike(NAMES)))


def _features(c: Column, dictionary: list[str]) -> Column:
    v, n = c.v, F.length(c.v)
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    beside = F.lower(F.concat_ws(" ", c.before2, c.before, c["name"]))
    number = lambda b: b.cast("double")
    covered = F.length(F.regexp_replace(F.lower(v), "|".join(dictionary) or "(?!)", "")) / n
    return F.struct(
        number(n).alias("len"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]").alias("transitions"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct"),
        number(v.rlike("^[0-9a-f]+$")).alias("hex"),
        (1 - covered).alias("words"),
        share("/").alias("paths"),
        share("[.]").alias("dots"),
        number(c["name"] != "").alias("assigned"),
        number(beside.rlike(NAMES)).alias("named"),
        number(F.lower(F.concat_ws(" ", beside, v, c.after)).rlike(EXAMPLES)).alias("example"),
        share("[A-Za-z]").alias("letters"),
        number(F.lower(c["name"]).rlike(STRICT)).alias("strict"),
        number(v.rlike(f"^(?:{ISSUED})$")).alias("issuer"),
    )


def _scanned(text: Column, dictionary: list[str]) -> Column:
    return F.transform(_candidates(text), lambda c: F.struct(c.alias("c"), _features(c, dictionary).alias("f")))


def findings(docs: DataFrame, dictionary: list[str]) -> DataFrame:
    """Every candidate of every text: doc_id, c (word and neighbours), f (features)."""
    return docs.select("doc_id", F.explode(_scanned(F.col("text"), dictionary)).alias("x")).select("doc_id", "x.c", "x.f")


def learn_dictionary(docs: DataFrame) -> list[str]:
    """Commonest words of all texts; each task counts its own before they are shuffled."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w"))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY).collect()  # at most DICTIONARY rows
    return sorted((r.w for r in top), key=lambda w: (-len(w), w))


def rule_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where people gave none: a key with its issuer's form, or a random value assigned to a telling name."""
    c, f = F.col("c"), F.col("f")
    # a short value is random where its name is a password's, or letters and digits are mixed
    fit = (f.len >= LEAST) | (f.strict == 1) | ((f.len >= LEAST_MIXED) & (f.letters > 0) & (f.dots == 0))
    random = (f.assigned == 1) & (f.named == 1) & (f.digits > 0.1) & (f.words < 0.5) & fit
    return found.withColumn("label", (((f.issuer == 1) | random) & (f.example == 0)).cast("int"))


def table_labels(labels: DataFrame):
    """For ``fitted``: labels that people gave, as labels(doc_id, secret_sha256, label); findings not among them teach nothing."""
    given = labels.groupBy("doc_id", "secret_sha256").agg(F.max(F.col("label").cast("int")).alias("label"))

    def of(found: DataFrame) -> DataFrame:
        return found.withColumn("secret_sha256", F.sha2(F.col("c.v").cast("binary"), 256)).join(given, ["doc_id", "secret_sha256"], "left").drop("secret_sha256")

    return of


def issued_examples(spark: SparkSession, n: int = 200) -> DataFrame:
    """Documents holding made-up keys of known issuers, passwords and values that are none: what the sample may lack."""
    body = F.translate(F.sha2(F.concat(F.lit("example"), F.col("id")).cast("binary"), 256), "0123456789abcdef", "Q7C2EFGH3JKL4NOP")
    forms = F.array(F.concat(F.lit("AKIA"), F.substring(body, 1, 16)), F.concat(F.lit("ghp_"), F.initcap(F.substring(body, 1, 36))), F.concat(F.lit("sk_live_"), F.lower(F.substring(body, 1, 24))))
    short = F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, (4 + F.col("id") % 11).cast("int"))
    named = F.array(*[F.concat(F.lit(name), value) for name in ("password=", "api_key: ") for value in (short, F.regexp_replace(short, "[a-f]", "7"), F.translate(short, "0123456789", "ghijklmnop"), F.concat(short, F.lit("."), short))])
    forms = F.concat(forms, F.transform(forms, lambda k: F.concat(F.lit('{"api_key":"'), k, F.lit('","x":1}'))), named)
    return spark.range(n).select((-1 - F.col("id")).alias("doc_id"), F.explode(forms).alias("text"))


class Forest:
    """A trained forest as nested conditions: a leaf is a probability, a node (feature, threshold, low, high)."""

    def __init__(self, trees: list):
        self.trees = trees

    def probability(self, f: Column) -> Column:
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, at, low, high = tree
            return F.when(f.getField(name) <= F.lit(float(at)), of(low)).otherwise(of(high))

        total = of(self.trees[0])
        for t in self.trees[1:]:
            total = total + of(t)
        return total / len(self.trees)


def train(labelled: DataFrame) -> Forest:
    """From labelled findings (f, label); at most SAMPLE_FINDINGS of them, those with the smallest hash."""
    rows = labelled.where("label is not null").select("f.*", F.col("label").cast("double").alias("label"), F.xxhash64("doc_id", "c").alias("_h")).orderBy("_h").limit(SAMPLE_FINDINGS)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label").persist()
    kinds = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if len(kinds) < 2:
        rows.unpersist()
        return Forest([float(next(iter(kinds), 0.0))])
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)
    rows.unpersist()

    def tree(node):
        if node.getClass().getSimpleName() == "LeafNode":
            s = list(node.impurityStats().stats())
            return s[1] / sum(s)
        split = node.split()
        return FEATURES[split.featureIndex()], split.threshold(), tree(node.leftChild()), tree(node.rightChild())

    return Forest([tree(t._java_obj.rootNode()) for t in model.trees])


def fitted(docs: DataFrame, labels=rule_labels) -> tuple[Forest, list[str]]:
    """Forest and dictionary from the rows of ``docs`` outside the test fold (crc32 of the id modulo 5 not 0)."""
    own = docs.where(fold("doc_id", 5) != 0)
    dictionary = learn_dictionary(own)
    few = smallest(own.where("text is not null").select("doc_id", "text"), SAMPLE_DOCS, "doc_id", "text")
    few = few.repartition(TASKS)  # the sample comes from one task
    found = findings(few.unionByName(issued_examples(docs.sparkSession)), dictionary)
    return train(labels(found)), dictionary


def scan(docs: DataFrame, forest: Forest, dictionary: list[str]) -> DataFrame:
    """Every candidate: doc_id, word_index, length, secret_sha256 (the value itself is not shown), probability, is_secret."""
    scored = docs.select(
        "doc_id",
        F.explode(F.transform(_scanned(F.col("text"), dictionary), lambda x: F.struct(x.c.at.alias("at"), x.c.v.alias("v"), forest.probability(x.f).alias("p")))).alias("x"),
    )
    return scored.select(
        "doc_id",
        F.col("x.at").cast("long").alias("word_index"),
        F.length("x.v").cast("long").alias("length"),
        F.sha2(F.col("x.v").cast("binary"), 256).alias("secret_sha256"),
        F.round("x.p", 6).alias("probability"),
        (F.col("x.p") >= CUT).alias("is_secret"),
    )


def redact(docs: DataFrame, forest: Forest, dictionary: list[str], mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced in its text; other texts are unchanged, and no row goes."""
    scored = F.transform(_scanned(F.col("text"), dictionary), lambda x: F.struct((-F.length(x.c.v)).alias("n"), x.c.v.alias("v"), x.c["name"].alias("name"), forest.probability(x.f).alias("p")))
    secrets = F.array_sort(F.array_distinct(F.filter(scored, lambda x: x.p >= CUT)))  # the longest first: one may hold another
    held = free(docs, "_secrets")
    clean = docs.withColumn(held, secrets)
    # a short value goes only where its name is assigned to it
    after_name = lambda s: F.concat(F.lit(r"(\Q"), s["name"], F.lit(r"""\E["'\\)\]]{0,3}\s*[:=]+>?\s*[^\s\w]{0,3}?)\Q"""), s.v, F.lit(r"\E(?![A-Za-z0-9])"))
    shown = mask.replace("\\", "\\\\").replace("$", "\\$")
    masked = lambda t, s: F.when(F.length(s.v) >= LEAST, F.replace(t, s.v, F.lit(mask))).otherwise(F.regexp_replace(t, after_name(s), F.lit("$1" + shown)))
    text = F.when(F.size(held) > 0, F.aggregate(held, F.col("text"), masked)).otherwise(F.col("text"))
    return clean.select(*[text.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])
