"""Format-preserving Feistel pseudonyms for personal numbers and dates (operator 4, native).

Card numbers (Luhn), social security numbers (issued ranges), telephone numbers, IPv4 addresses, calendar dates and the
local parts of e-mail addresses are found by one pattern and validated. Each value is permuted, under a key, within
the values of its own format, by a Feistel network of ROUNDS rounds on a pair (l, r) of Z_a x Z_b: l += F(r) mod a and
r += F(l) mod b in turn, F from SHA-256. That is a bijection for any a and b, so no cycle is walked: pseudonyms stay
valid (check digits, ranges, calendar), equal values stay equal in all documents, however they are punctuated, and
different values stay different. Everything happens inside the row: no shuffle, no Python.

Not looked for: IPv6 addresses, IBANs, telephone numbers without a country code that are not written 3-3-4, names of people.
A local part with letters outside ASCII becomes one of digits and ASCII letters that is twice as long as its bytes.

Edge cases: a null text stays null; what fails its validation is left as it is; repeated rows are treated alike; an
empty table gives no rows; other columns are kept, those of the names that are added are replaced. The key is the
caller's: who has it can undo the pseudonyms, and it is a literal of the plan, so plans and event logs are as secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

ROUNDS = 8
#: The forms that are looked for, the more specific first.
PATTERN = "|".join(
    (
        r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+'-]{0,253}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
        r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
        r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
        r"\+\d(?:[ ./()-]{0,3}(?!\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})\d){7,17}(?!\d)",
        r"(?<![\d(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
    )
)
#: Country codes (ITU); the digits after them are a number's own.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Letters and digits of an address are permuted so many at a time.
LETTERS = 20
#: Days are permuted within blocks of this many from 1600-01-01; the last block ends in 2399.
BLOCK_DAYS, BLOCKS, FIRST_DAY = 73_000, 4, "1600-01-01"


def _power(base: int, n: Column) -> Column:
    """base ** n of a small n, exactly."""
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(11)]), n + 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits with every second one doubled, the last counting as a check digit's neighbour to its right."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)).otherwise(at(i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _date(s: Column) -> Column:
    part = lambda i: F.get(F.split(s, "[/.-]"), F.lit(i)).cast("int")
    made = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.when(s.rlike(r"^\d{4}-"), made(part(0), part(1), part(2))).otherwise(F.coalesce(made(part(2), part(1), part(0)), made(part(2), part(0), part(1))))


def _kind(s: Column) -> Column:
    d = _digits(s)
    octets = F.split(s, r"\.")
    day = F.datediff(_date(s), F.to_date(F.lit(FIRST_DAY)))
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o.cast("int") < 256), "ip"))
        .when(s.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$"), F.when(day.between(0, BLOCKS * BLOCK_DAYS - 1), "date"))
        .when(s.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(s.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"), "ssn"))
        .when(s.rlike(r"^\+|^\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$"), F.when(F.length(d) >= F.when(s.startswith("+"), 8).otherwise(10), "phone"))
        .when(F.length(d).between(13, 19) & ((_luhn(F.substring(d, F.lit(1), F.length(d) - 1)) + F.substring(d, -1, 1).cast("int")) % 10 == 0), "card")
    )


def _local(s: Column) -> Column:
    """Letters and digits of an address before the @."""
    return F.regexp_replace(F.lower(F.regexp_extract(s, "^([^@]*)", 1)), "[^a-z0-9]", "")


def _number(text: Column, base: int) -> Column:
    return F.coalesce(F.conv(F.when(F.length(text) > 0, text).otherwise("0"), base, 10).cast("long"), F.lit(0).cast("long"))


def _pairs(c: Column) -> Column:
    """A value's pairs: one, or of an address one for each LETTERS letters, with the letters before as its tweak."""
    s, d = c.s, _digits(c.s)
    pieces = lambda t: F.transform(F.sequence(F.lit(0), ((F.length(t) - 1) / LETTERS).cast("int")), lambda i: F.struct(F.substring(t, i * LETTERS + 1, F.lit(LETTERS)).alias("w"), F.when(i > 0, F.substring(t, F.lit(1), i * LETTERS)).alias("t")))
    wide = F.when(c.kind == "card", F.substring(d, F.lit(1), F.length(d) - 1)).when((c.kind == "phone") & s.startswith("+"), F.regexp_replace(d, COUNTRY, "")).otherwise(F.substring(d, -10, 10))
    parts = F.when(c.kind == "email", pieces(_local(s))).otherwise(F.array(F.struct(wide.alias("w"), F.lit(None).cast("string").alias("t"))))
    return F.transform(parts, lambda x: _pair(c, x.w, x.t))


def _pair(c: Column, wide: Column, before: Column) -> Column:
    """(l, r, a, b, t): the value as a pair, the two moduli, and what else goes into the tweak."""
    s, d = c.s, _digits(c.s)
    half = (F.length(wide) / 2).cast("int")
    left, right = F.substring(wide, F.lit(1), half), F.substring(wide, half + 1, F.length(wide))
    octet = lambda i: F.get(F.split(s, r"\."), F.lit(i)).cast("long")
    day = F.datediff(_date(s), F.to_date(F.lit(FIRST_DAY))).cast("long") % BLOCK_DAYS
    area = F.substring(d, 1, 3).cast("long")
    area = area - F.when(area > 666, 2).otherwise(1)
    rest = (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
    pair = lambda l, r, a, b: F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"), before.alias("t"))  # noqa: E731, E741
    return (
        F.when(c.kind == "ip", pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536)))
        .when(c.kind == "date", pair(F.floor(day / 250), day % 250, F.lit(BLOCK_DAYS // 250), F.lit(250)))
        .when(c.kind == "ssn", pair(area, rest, F.lit(898), F.lit(99 * 9999)))
        .when(c.kind == "email", pair(_number(left, 36), _number(right, 36), _power(36, F.length(left)), _power(36, F.length(right))))
        .otherwise(pair(_number(left, 10), _number(right, 10), _power(10, F.length(left)), _power(10, F.length(right))))
    )


def _feistel(kind: Column, p: Column, key: str) -> Column:
    tweak = F.concat_ws("|", F.lit(key), kind, p.a.cast("string"), p.b.cast("string"), p.t)
    mixed = lambda i, x, m: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", tweak, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long"), m)
    start = F.struct(p.l.alias("l"), p.r.alias("r"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda acc, i: F.when(i % 2 == 0, F.struct(((acc.l + mixed(i, acc.r, p.a)) % p.a).alias("l"), acc.r.alias("r"))).otherwise(
            F.struct(acc.l.alias("l"), ((acc.r + mixed(i, acc.l, p.b)) % p.b).alias("r"))
        ),
    )


def _refill(s: Column, letters: Column, what: str) -> Column:
    """``s`` with its characters in the class ``what`` replaced by ``letters``, in order; what goes beyond stays."""
    empty = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, ch: F.when(
        ch.rlike(what) & (acc.at <= F.length(letters)), F.struct(F.concat(acc.out, F.substring(letters, acc.at, F.lit(1))).alias("out"), (acc.at + 1).alias("at"))
    ).otherwise(F.struct(F.concat(acc.out, ch).alias("out"), acc.at.alias("at")))
    return F.aggregate(F.filter(F.split(s, ""), lambda ch: ch != ""), empty, step, lambda acc: acc.out)


def _written(c: Column) -> Column:
    """The pseudonym in the form of the original."""
    one, to = F.get(c.p, F.lit(0)), F.get(c.q, F.lit(0))
    s, d, l, r = c.s, _digits(c.s), to.l, to.r  # noqa: E741
    digits = lambda x, m, base: F.when(m > 1, F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), F.round(F.log(float(base), m.cast("double"))).cast("int"), F.lit("0"))).otherwise(F.lit(""))
    padded = lambda p, q, base: F.concat(digits(q.l, p.a, base), digits(q.r, p.b, base))
    ten = padded(one, to, 10)
    body_sum = _luhn(ten)
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (F.floor(F.datediff(_date(s), F.to_date(F.lit(FIRST_DAY))) / BLOCK_DAYS) * BLOCK_DAYS + l * 250 + r).cast("int"))
    area = l + 1 + F.when(l + 1 >= 666, 1).otherwise(0)
    kept = F.substring(d, F.lit(1), F.length(d) - F.length(ten))
    dotted = F.when(s.contains("."), F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return (
        F.when(c.kind == "ip", F.concat_ws(".", F.floor(l / 256), l % 256, F.floor(r / 256), r % 256))
        .when(c.kind == "date", F.when(s.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd")).otherwise(dotted))
        .when(c.kind == "ssn", F.format_string("%03d-%02d-%04d", area, F.floor(r / 9999) + 1, r % 9999 + 1))
        .when(c.kind == "email", F.concat(_refill(F.lower(F.regexp_extract(s, "^([^@]*)", 1)), F.array_join(F.zip_with(c.p, c.q, lambda p, q: padded(p, q, 36)), ""), "[a-z0-9]"), F.regexp_extract(s, "(@.*)$", 1)))
        .when(c.kind == "card", _refill(s, F.concat(ten, ((10 - body_sum % 10) % 10).cast("string")), "[0-9]"))
        .otherwise(_refill(s, F.concat(kept, ten), "[0-9]"))
    )


def _plain(s: Column) -> Column:
    """An address whose local part has letters outside ASCII, with that part's bytes as hexadecimal digits behind ``u-``: no
    letter of it stays, and different parts are written differently."""
    local = F.regexp_extract(s, "^([^@]*)@", 1)
    return F.when(local.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("u-"), F.lower(F.hex(F.encode(F.lower(local), "UTF-8"))), F.regexp_extract(s, "(@.*)$", 1))).otherwise(s)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal values in text replaced, plus pii_found and pii_replaced (array of the kinds replaced)."""
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))
    kinds = F.transform(F.transform(found, _plain), lambda s: F.struct(s.alias("s"), _kind(s).alias("kind")))
    pairs = F.transform(kinds, lambda c: F.struct(c.s.alias("s"), c.kind.alias("kind"), F.when(c.kind.isNotNull(), _pairs(c)).alias("p")))
    mixed = F.transform(pairs, lambda c: F.struct(c.s.alias("s"), c.kind.alias("kind"), c.p.alias("p"), F.when(c.kind.isNotNull(), F.transform(c.p, lambda p: _feistel(c.kind, p, key))).alias("q")))
    done = F.transform(mixed, lambda c: F.struct(F.coalesce(F.when(c.kind.isNotNull(), _written(c)), c.s).alias("to"), c.kind.alias("kind")))
    d = free(docs, "_done")
    marked = docs.withColumn(d, done)
    between = F.split(F.col("text"), PATTERN, -1)
    woven = F.array_join(F.flatten(F.zip_with(between, F.col(f"{d}.to"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    text = F.when(F.size(d) > 0, woven).otherwise(F.col("text"))
    return marked.select(
        *[text.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("pii_found", "pii_replaced")],
        F.coalesce(F.greatest(F.size(d), F.lit(0)), F.lit(0)).cast("long").alias("pii_found"),
        F.coalesce(F.filter(F.col(f"{d}.kind"), lambda k: k.isNotNull()), F.array().cast("array<string>")).alias("pii_replaced"),
    )
