"""The durable event log: JSON envelopes in hourly partitions, as a batch table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.folds import numbered
from ..operators.nested import iso

ENVELOPE = "envelope_id string, schema_version string, source_system string, entity_type string, event_type string, captured_at string, ordering_key string, payload string, _corrupt_record string"
TRADE = "struct<trade_id:string,market_id:string,proxy_wallet:string,side:string,outcome_side:string,price:string,size:string,usdc_notional:string,trade_time:string,captured_at:string>"
QUOTE = "struct<market_id:string,captured_at:string,yes_price:double,mid_price:double,best_bid:double>"
KEYS = ("year", "month", "day", "hour")


def append(envelopes: DataFrame, root: str) -> None:
    """Adds envelopes to the partitions of their hours and sources. Files are never changed once written."""
    ts = S.detector_timestamp(F.col("captured_at"))
    parts = {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd"), "hour": F.date_format(ts, "HH")}
    named = envelopes.withColumns(parts).withColumn("source", S.source_name(F.col("source_system")))
    named.write.partitionBy(*KEYS, "source").mode("append").json(root)


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.where("_corrupt_record is null").drop("_corrupt_record").withColumn("ts", S.detector_timestamp(F.col("captured_at")))


def read(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Envelopes captured in [start, end); only the partitions of those hours are read. Broken lines are skipped."""
    raw = spark.read.schema(ENVELOPE + ", year int, month int, day int, hour int").option("mode", "PERMISSIVE").json(root)
    hour = F.make_timestamp("year", "month", "day", "hour", F.lit(0), F.lit(0))
    if start:
        raw = raw.where(hour >= F.date_trunc("hour", F.lit(start).cast("timestamp")))
    if end:
        raw = raw.where(hour < F.lit(end).cast("timestamp"))
    out = _parsed(raw)
    out = out.where(F.col("ts") >= F.lit(start).cast("timestamp")) if start else out
    return out.where(F.col("ts") < F.lit(end).cast("timestamp")) if end else out


ORDER = ("captured_at", "ordering_key", "envelope_id")


def ordered(envelopes: DataFrame, limit: int | None = None) -> DataFrame:
    """envelopes with ``seq``, from 1, in the order in which the detector takes them: time, key and id, as texts, null as ''.

    limit: only the first ones, of all sources together (a top-k: tasks keep as many rows each).
    """
    keys = [F.coalesce(c, F.lit("")) for c in ORDER]
    if limit is not None:
        envelopes = envelopes.orderBy(*keys).limit(limit)
    return numbered(envelopes, *keys)


def scan(spark: SparkSession, root: str, sources: tuple[str, ...], start: str, end: str, limit: int | None = None) -> DataFrame:
    """What the sources captured in [start, end), ``ordered``. Only the folders of these sources and hours are read."""
    folders = [S.source_name(F.lit(s)) for s in sources]
    return ordered(read(spark, root, start, end).where(F.col("source").isin(*folders)), limit)


def republished(envelopes: DataFrame, run: str, at: Column) -> DataFrame:
    """envelopes wrapped once more for a replay: key, origin, and the whole envelope as the payload.

    The key, captured_at::envelope_id, orders a replay by the time of capture. Envelopes without such a time are left out.
    The hour's folder is named in raw_partition.
    """
    shown = iso(F.col("ts"))
    own = [c for c in ("envelope_id", "schema_version", "source_system", "entity_type", "event_type", "captured_at", "ordering_key", "payload") if c in envelopes.columns]
    return envelopes.where("ts is not null").select(
        F.lit(run).alias("replay_run_id"), shown.alias("captured_at"), iso(at).alias("replayed_at"), "source_system", F.lit("replay_raw_event").alias("entity_type"),
        F.concat(shown, F.lit("::"), F.coalesce("envelope_id", F.lit(""))).alias("ordering_key"),
        F.concat(F.date_format("ts", "'year='yyyy'/month='MM'/day='dd'/hour='HH"), F.lit("/source="), S.source_name(F.col("source_system"))).alias("raw_partition"),
        F.col("envelope_id").alias("original_envelope_id"), F.col("event_type").alias("original_event_type"), F.col("schema_version").alias("original_schema_version"),
        F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("payload"))


def stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    return _parsed(spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").json(root))


def tail(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Envelopes of the log's current and previous hours as their lines come in (see ``tail.Tail`` for the options).

    Broken lines and blank ones are skipped; file and position, in bytes, order the lines of a source.
    """
    from .tail import Tail

    spark.dataSource.register(Tail)
    lines = spark.readStream.format(Tail.name()).options(path=root, **options).load()
    parsed = F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.where(F.trim("value") != "").select("file", "position", parsed.alias("e")).select("file", "position", "e.*")
    return _parsed(rows)


def _key() -> Column:
    return F.concat_ws("\x00", "captured_at", "ordering_key", "envelope_id")


def _trade_time(trade: Column) -> Column:
    """The time of a trade, or of its capture where that is blank, as the detector reads times."""
    return S.detector_timestamp(F.coalesce(S.blank_to_null(trade["trade_time"]), trade["captured_at"]))


def points(envelopes: DataFrame) -> DataFrame:
    """Trades and quotes of the detector, from pages of trades, batches of prices and pushed frames; other envelopes have none.

    order_key, then pos, sorts them as they are to be processed. A trade without an amount counts as 0; those without a market
    or a time, which the detector leaves out, stay here with a null.
    """
    trades = envelopes.where(F.col("entity_type").isin("recent_trades_page", "historical_trades_page"))
    t = trades.select(_key().alias("order_key"), F.posexplode(F.from_json(F.get_json_object("payload", "$.trades"), f"array<{TRADE}>")).alias("pos", "t"))
    number = lambda c: F.col(c).try_cast("double")
    t = t.select(
        "order_key", "pos", F.lit("trade").alias("kind"), F.col("t.market_id").alias("market_id"), _trade_time(F.col("t")).alias("ts"), F.lower(S.blank_to_null(F.col("t.proxy_wallet"))).alias("wallet"),
        F.upper("t.side").alias("side"), F.upper("t.outcome_side").alias("outcome_side"), F.coalesce(number("t.usdc_notional"), F.lit(0.0)).alias("notional"), F.lit(None).cast("double").alias("price"))
    quotes = envelopes.where(F.col("entity_type").isin("prices_batch", "books_batch"))
    q = quotes.select(_key().alias("order_key"), F.posexplode(F.from_json(F.get_json_object("payload", "$.market_snapshots"), f"array<{QUOTE}>")).alias("pos", "q"))
    none = F.lit(None)
    q = q.select(
        "order_key", "pos", F.lit("quote").alias("kind"), F.col("q.market_id").alias("market_id"), S.detector_timestamp(F.col("q.captured_at")).alias("ts"), none.cast("string").alias("wallet"), none.cast("string").alias("side"),
        none.cast("string").alias("outcome_side"), none.cast("double").alias("notional"), F.coalesce("q.yes_price", "q.mid_price", "q.best_bid").alias("price"))
    return t.unionByName(q).unionByName(_frames(envelopes))


_PAGES = ("recent_trades_page", "historical_trades_page", "prices_batch", "books_batch")
_LEVEL = "struct<best_bid:double,best_ask:double,spread:double>"
_CHANGE = "struct<market_id:string,price:string,outcome_side:string>"
FRAME = f"struct<event_type:string,market_id:string,captured_at:string,outcome_side:string,trade:{TRADE},price_changes:array<{_CHANGE}>,best_bid_ask:{_LEVEL},book:{_LEVEL}>"


def _is_frame() -> Column:
    return F.col("entity_type").startswith("ws_frame::")


def _frames(envelopes: DataFrame) -> DataFrame:
    """Points of pushed frames: trades, and of price changes and best bids those of the YES side, which sets the price.

    Events without a market or a time, and of other types, have no points.
    """
    kind = "array<struct<kind:string,market_id:string,ts:timestamp,wallet:string,side:string,outcome_side:string,notional:double,price:double>>"
    e, none = F.col("e"), F.lit(None)

    def quote(market: Column, side: Column, price: Column) -> Column:
        point = F.struct(F.lit("quote"), market, S.detector_timestamp(e["captured_at"]), none, none, none, none, price.try_cast("double"))
        return F.when(side == "YES", point)

    number = lambda c: e["trade"][c].try_cast("double")
    trade = F.struct(
        F.lit("trade"), e["trade"]["market_id"], _trade_time(e["trade"]), F.lower(S.blank_to_null(e["trade"]["proxy_wallet"])),
        F.upper(e["trade"]["side"]), F.upper(e["trade"]["outcome_side"]), F.coalesce(number("usdc_notional"), F.lit(0.0)), none)
    changes = F.transform(e["price_changes"], lambda c: quote(c["market_id"], c["outcome_side"], c["price"]))
    level = lambda c: F.array(quote(e["market_id"], e["outcome_side"], e[c]["best_bid"]))
    cast = lambda c: c.cast(kind)
    made = (
        F.when(e["event_type"] == "last_trade_price", F.when(e["trade"].isNotNull(), cast(F.array(trade)))).when(e["event_type"] == "price_change", cast(changes))
        .when(e["event_type"] == "best_bid_ask", cast(level("best_bid_ask"))).when(e["event_type"] == "book", cast(level("book")))
    )
    events = envelopes.where(_is_frame()).select(_key().alias("order_key"), F.posexplode(F.from_json(F.get_json_object("payload", "$.events"), f"array<{FRAME}>")).alias("at", "e"))
    each = events.select("order_key", "at", F.posexplode(made).alias("n", "p")).where(S.is_present(F.col("p.market_id")) & F.col("p.ts").isNotNull())
    each = each.where("p.kind = 'trade' or p.price is not null")
    return each.select("order_key", (F.col("at") * 65536 + F.col("n")).alias("pos"), "p.*")


def ignored(envelopes: DataFrame) -> DataFrame:
    """Number of envelopes that have no points, by their entity type."""
    return envelopes.where(~(F.col("entity_type").isin(*_PAGES) | _is_frame()) | F.col("entity_type").isNull()).groupBy("entity_type").agg(F.count("*").alias("n"))
