"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Only DataFrame functions are used. For each kind, ``regexp_extract_all`` gives the matches and ``split`` the text between
them; running sums of their lengths (in blocks, so that texts with very many matches stay near linear) give the positions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Score of a confirmed match, before its context.
    score: float
    #: Words nearby that raise the score.
    context: str
    base: bool = True


#: Possessive quantifiers and look-arounds only save work: the matches are those of the plain patterns.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])(?:[0-9][\x20-]?){15,18}[0-9](?![\x20-]?[0-9])", 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.9, "iban|bank|account", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security|taxpayer", False),
    Kind("secret", r"(?<![A-Za-z0-9_])(?i:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9_+/-]{12,}+[\"']?", 0.8, "secret|key|token", False),
)
#: Added kinds count from this score on; base kinds always do.
LEAST = 0.6
BONUS = 0.3
NEAR = 40
_STEP = 256


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.ascii(digits.substr(F.length(digits) - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return _sum(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value)) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 modulo 97."""
    plain = F.regexp_replace(x, " ", "")
    chars = F.split(F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4)), "")
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda a, c: F.when(F.ascii(c) >= 65, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97) == 1


def confirmed(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {
        "ip": F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(x, r"\."), lambda p: p.cast("double") <= 255),
        "card": n.between(16, 19) & luhn(_digits(x)),
        "phone": n.between(8, 15),
        "iban": mod97(x),
        "ssn": ~x.rlike("^(000|666|9)|-00-|-0000$"),
    }.get(kind, F.lit(True))


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match in code points."""
    sizes = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.length(F.get(gaps, i - 1)) + F.length(F.get(found, i - 1)))
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _STEP).cast("int")), lambda b: _sum(F.slice(sizes, b * _STEP + 1, _STEP)))
    return F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: _sum(F.slice(block, F.lit(1), F.floor(i / _STEP).cast("int"))) + _sum(F.slice(sizes, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP)) + F.length(F.get(gaps, i)))


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(k: Kind) -> Column:
    """The confirmed spans of one kind."""
    m, g, s = F.col(f"m_{k.name}"), F.col(f"g_{k.name}"), F.col(f"s_{k.name}")

    def span(i: Column) -> Column:
        near = F.lower(F.concat(F.right(F.get(g, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(g, i + 1), F.lit(NEAR))))
        score = F.least(F.lit(1.0), k.score + F.when(near.rlike(rf"\b(?:{k.context})"), F.lit(BONUS)).otherwise(F.lit(0.0)))
        start = F.get(s, i).cast("int")
        fields = (F.lit(k.name).alias("kind"), start.alias("start"), (start + F.length(F.get(m, i))).alias("end"), score.alias("score"))
        return F.when(confirmed(k.name, F.get(m, i)), F.struct(*fields))

    spans = F.transform(F.sequence(F.lit(0), F.size(m) - 1), span)
    return F.filter(spans, lambda x: x.isNotNull() if k.base else x.isNotNull() & (x["score"] >= LEAST))


def _with_spans(df: DataFrame) -> DataFrame:
    """df (a column text without nulls; others of names that don't clash) with the confirmed spans of its texts."""
    columns = df.columns
    for k in KINDS:
        df = df.withColumn(f"m_{k.name}", F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)))
    for k in KINDS:
        m = F.col(f"m_{k.name}")
        df = df.withColumn(f"g_{k.name}", F.when(F.size(m) > 0, F.split("text", k.pattern, -1)))
    for k in KINDS:
        m, g = F.col(f"m_{k.name}"), F.col(f"g_{k.name}")
        df = df.withColumn(f"s_{k.name}", F.when(F.size(m) > 0, _starts(g, m)))
    for k in KINDS:
        df = df.withColumn(f"x_{k.name}", F.when(F.size(f"m_{k.name}") > 0, _spans(k)).otherwise(F.array().cast(_SPAN)))
    return df.select(*columns, F.concat(*(F.col(f"x_{k.name}") for k in KINDS)).alias("spans"))


def found(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, score; in code points, by kind as listed, then start) of each document.

    A null text is empty; equal rows get equal results. ``end`` is exclusive. Matches of one kind don't overlap, those of
    different kinds may.
    """
    df = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return _with_spans(df).select("doc_id", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans."""
    base = [k.name for k in KINDS if k.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found(docs).select("doc_id", *map(count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once even where use refers to it within a lambda function."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; spans that overlap become one, of the kind that begins first."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(names, x["kind"]).alias("no"), x["end"].alias("end"), x["kind"].alias("kind"))))
    block = lambda i: F.floor(i / _STEP).cast("int")
    least = lambda a: F.coalesce(a, F.lit(0))

    def covered(ends: Column, tops: Column) -> Column:
        """How far the spans before each one reach, and all of them."""
        one = lambda i: F.greatest(least(F.array_max(F.slice(tops, F.lit(1), block(i)))), least(F.array_max(F.slice(ends, block(i) * _STEP + 1, i % _STEP))))
        return F.transform(F.sequence(F.lit(0), F.size(ends)), one)

    def cut(whole: Column, base: Column, start: Column, end: Column) -> Column:
        return F.substring(whole, start - base + 1, end - start)

    def built(s: Column, to: Column) -> Column:
        """The text in blocks of spans, so that many spans don't walk the whole text each."""
        n = F.size(s)

        def joined_block(b: Column) -> Column:
            first, last = b * _STEP, F.least((b + 1) * _STEP, n)
            base = F.get(to, first)

            def piece(part: Column) -> Callable[[Column], Column]:
                return lambda i: F.when(
                    F.get(to, i) <= F.get(s, i)["start"],
                    F.concat(cut(part, base, F.get(to, i), F.get(s, i)["start"]), F.lit("["), F.upper(F.get(s, i)["kind"]), F.lit("]")),
                ).otherwise(F.lit(""))

            return _let(cut(text, F.lit(0), base, F.get(to, last)), lambda part: F.array_join(F.transform(F.sequence(first, last - 1), piece(part)), ""))

        blocks = F.transform(F.sequence(F.lit(0), block(n - 1)), joined_block)
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.get(to, n) + 1, F.length(text)))

    def masked(s: Column) -> Column:
        tops = lambda ends: F.transform(F.sequence(F.lit(0), block(F.size(ends) - 1)), lambda b: F.array_max(F.slice(ends, b * _STEP + 1, _STEP)))
        to = lambda ends: _let(tops(ends), lambda t: covered(ends, t))
        return _let(_let(F.transform(s, lambda x: x["end"]), to), lambda t: built(s, t))

    return _let(ordered, masked)


def redacted(docs: DataFrame) -> DataFrame:
    """docs (all columns) with the spans that ``found`` gives, scores with context included, replaced by their kinds in brackets.

    A null text stays null.
    """
    columns, kind = docs.columns, docs.schema["text"].dataType
    df = docs.select(F.struct(*columns).alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.when(F.size("spans") > 0, _masked(F.col("text"), F.col("spans")).cast(kind)).otherwise(F.col("__row")["text"])
    return _with_spans(df).select(*(text.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in columns))


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, counted anew."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
