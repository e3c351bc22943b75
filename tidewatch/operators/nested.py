"""JSON of any depth as rows of leaves, and back: redaction, shifted times, canonical forms.

A text is parsed to a variant, whose levels are exploded one after the other, as many as the deepest text has; each leaf has
its path. Leaves are changed by column functions, and put together again by text, with keys in order. Exploding doesn't
shuffle; putting together groups a text's leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written

PATH = "array<struct<name:string,place:int>>"

#: Of a leaf's path, its string (null if it is none) and its JSON text, the JSON text that takes its place.
Change = Callable[[Column, Column, Column], Column]


def depth(text: Column) -> Column:
    """How deep brackets lie in each other outside of strings."""
    bare = F.regexp_replace(text, r'"[^"\\]*(?:\\.[^"\\]*)*"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, mark: Column) -> Column:
        now = a["now"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, start, step)["most"]


def quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(text.alias("s")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def number(x: Column) -> Column:
    """A number as the variant that its JSON text gives."""
    return F.when(x.isNotNull(), F.try_parse_json(quoted(x)))


#: Long hexadecimal numbers, the keys whose values are public ones, and those of times.
HEX = r"\b0x[a-fA-F0-9]{8,}\b"
PUBLIC_KEYS = ("condition_id",)
TIME_KEYS = ("captured_at", "trade_time")
MARK = "[wallet_redacted]"


def plainly_redacted(text: Column, mark: str = MARK) -> Column:
    """A text that isn't looked into, without its long hexadecimal numbers."""
    return F.regexp_replace(text.cast("string"), HEX, mark)


def leaves(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The kept columns, path and value (a variant) of each leaf of the JSON texts: scalars and empty containers.

    Texts that aren't JSON, or have a key twice in one object, have a single leaf, a null.
    """
    levels = df.agg(F.max(depth(F.col(column)))).first()[0] or 0
    out = df.select(*keep, F.array().cast(PATH).alias("path"), F.try_parse_json(column).alias("value"))
    for _ in range(levels):
        tvf = df.sparkSession.tvf
        deeper = out.withColumnRenamed("value", "v").lateralJoin(tvf.variant_explode_outer(F.col("v").outer()))
        element = F.struct(F.col("key").alias("name"), F.when(F.col("key").isNull(), F.col("pos")).alias("place"))
        inside = F.col("pos").isNotNull()
        out = deeper.select(*keep, F.when(inside, F.concat("path", F.array(element))).otherwise(F.col("path")).cast(PATH).alias("path"), F.when(inside, F.col("value")).otherwise(F.col("v")).alias("value"))
    return out


def _opened(path: Column) -> Column:
    """The containers of a path's elements, each with the key that leads on."""
    return F.array_join(F.transform(path, lambda e: F.when(e["name"].isNull(), "[").otherwise(F.concat(F.lit("{"), quoted(e["name"]), F.lit(":")))), "")


def _closed(path: Column) -> Column:
    return F.array_join(F.transform(F.reverse(path), lambda e: F.when(e["name"].isNull(), "]").otherwise("}")), "")


def assembled(rows: DataFrame, row: str) -> DataFrame:
    """row and json of leaves (row, path, text): the keys of an object in order, those of an array by place."""
    every = rows.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("all"))

    def piece(x: Column, i: Column) -> Column:
        """What stands between the leaf before and this one, and this one."""
        before = F.get("all", i - 1)["path"]
        path = x["path"]
        shared = F.array_position(F.zip_with(before, path, lambda a, b: a.eqNullSafe(b)), False).cast("int") - 1
        turn = F.get(path, shared)
        key = F.when(turn["name"].isNotNull(), F.concat(quoted(turn["name"]), F.lit(":"))).otherwise("")
        closed = _closed(F.slice(before, shared + 2, F.greatest(F.size(before) - shared - 1, F.lit(0))))
        opened = _opened(F.slice(path, shared + 2, F.greatest(F.size(path) - shared - 1, F.lit(0))))
        return F.concat(F.when(i == 0, _opened(path)).otherwise(F.concat(closed, F.lit(","), key, opened)), x["text"])

    text = F.concat(F.array_join(F.transform("all", piece), ""), _closed(F.element_at("all", -1)["path"]))
    return every.select(row, text.alias("json"))


def changed(df: DataFrame, column: str, change: Change, *beside: str, spare: Column | None = None) -> DataFrame:
    """df with the JSON texts of a column rewritten leaf by leaf; null where a text is no JSON or has a key twice.

    beside: columns of the row that change looks at. Keys are put in order, white space between values goes, and numbers are
    written as Spark writes them (2.50 is 2.5). spare: texts none of whose leaves changes; those without a backslash and
    beyond ASCII aren't taken apart, as a variant writes itself in the same way. Others meet their row by a sorted join:
    what Spark knows of their size, from files of texts that are much alike, is too small to broadcast by.
    """
    base = written(df.withColumn("__row", F.monotonically_increasing_id()))
    whole = F.lit(False) if spare is None else F.coalesce(spare & ~F.col(column).rlike(r"[^\x00-\x5B\x5D-\x7F]"), F.lit(False))
    kept = None if spare is None else base.where(whole).withColumn(column, F.to_json(F.try_parse_json(column))).select(*df.columns)
    base = base.where(~whole)
    each = leaves(base.where(F.try_parse_json(column).isNotNull()), column, "__row", *beside)
    string = F.when(F.schema_of_variant("value") == "STRING", F.expr("try_variant_get(value, '$', 'string')"))
    json = assembled(each.select("__row", "path", change(F.col("path"), string, F.to_json("value")).alias("text")), "__row")
    out = base.drop(column).join(json.withColumnRenamed("json", column).hint("merge"), "__row", "left").select(*df.columns)
    return out if kept is None else kept.unionByName(out)


def redacted(df: DataFrame, column: str, exempt: tuple[str, ...] = PUBLIC_KEYS, mark: str = MARK) -> DataFrame:
    """df with long hexadecimal numbers in the JSON's strings replaced, except below an exempt key.

    A text that is no JSON is redacted as it is: nothing leaves unredacted because it couldn't be read.
    """

    def change(path: Column, string: Column, text: Column) -> Column:
        spared = F.exists(path, lambda e: F.coalesce(e["name"].isin(*exempt), F.lit(False)))
        return F.when(string.isNull() | spared, text).otherwise(quoted(F.regexp_replace(string, HEX, mark)))

    plain = plainly_redacted(F.col(column), mark)
    out = changed(df.withColumn("__plain", plain), column, change, spare=~F.contains(F.col(column), F.lit("0x")))
    return out.withColumn(column, F.coalesce(column, "__plain")).drop("__plain")


def iso(ts: Column) -> Column:
    """A time in UTC with its offset; fractions only where there are any, to the microsecond."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def shifted(df: DataFrame, column: str, seconds: Column, keys: tuple[str, ...] = TIME_KEYS) -> DataFrame:
    """df with the times at these keys of the JSON moved by seconds of the row, and written in UTC; other strings stay.

    A text that is no JSON stays as it is, as does one whose seconds are null.
    """
    last = lambda path: F.coalesce(F.get(path, F.size(path) - 1)["name"].isin(*keys), F.lit(False))

    def change(path: Column, string: Column, text: Column) -> Column:
        moved = F.timestamp_micros(F.unix_micros(S.detector_timestamp(F.when(last(path), string))) + F.col("__by"))
        return F.when(moved.isNotNull(), quoted(iso(moved))).otherwise(text)

    base = df.withColumn("__by", (seconds.cast("double") * 1_000_000).cast("long")).withColumn("__plain", F.col(column))
    return changed(base, column, change, "__by").withColumn(column, F.coalesce(column, "__plain")).select(*df.columns)


def canonical(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a digest of the JSON's canonical form: keys in order, nulls kept, no white space, in UTF-8.

    Null where the text is no JSON.
    """
    made = changed(df.withColumn("__copy", F.col(column)), "__copy", lambda path, string, text: text)
    return made.withColumn(name, F.sha2("__copy", 256)).drop("__copy")
