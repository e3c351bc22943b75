"""Work in an order that spans the whole table: folds with a small state, and tables cut into ordered blocks."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows of a block, some more or less: a task of a fold holds one block of narrow rows.
BLOCK_ROWS = 500_000

Step = Callable[[Any, dict[str, Any]], tuple[Any, bool]]


def blocks(rows: DataFrame, *order: Column | str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows as a written table with ``__block`` and ``__place``: blocks are ranges of the order, places ascend along it.

    rows are counted first, so they should be cheap to read (a written table). Only rows that are equal in all of the order
    are kept in one block whatever their number.
    """
    n = max(1, math.ceil(rows.count() / block_rows))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    return written(placed.withColumn("__block", F.shiftright("__place", 33).cast("int")), "__block")


def ranked(keys: DataFrame, column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The distinct values of a column with ``rank``, from 1 in their order: places in blocks, and the sizes of the blocks
    before, of which only there is one for each block.
    """
    placed = blocks(keys.select(column).distinct(), column, block_rows=block_rows)
    sizes = placed.groupBy("__block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__block", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(offsets, "__block").select(column, (own + F.col("__before")).alias("rank"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with their place in the order, from 1, over the whole table: places in blocks on top of the blocks before.

    The order must tell all rows apart for numbers that are the same in every run. rows are computed once, as a table.
    """
    placed = blocks(written(rows), *order, block_rows=block_rows)
    sizes = placed.groupBy("__block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__block", F.coalesce(before, F.lit(0)).alias("__before"))  # a row for each block
    own = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), "__block").select(*rows.columns, (own + F.col("__before")).alias(name))


def key(*columns: str) -> Column:
    """The columns as one value; nulls are equal to each other, and no columns are one key of all rows."""
    return F.struct(F.lit(0).alias("all"), *columns)


def folded(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], needs: dict[str, Column], step: Step, flag: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with the boolean column ``flag`` that ``step`` gives to each row of a key, in order.

    step takes the state (None before a key's first row) and the row's ``needs`` as a dict, and returns the next state and the
    flag. A state must be small, comparable by ==, and is never changed in place.

    All blocks of the order are folded at once, each as if its first key began there. Then blocks whose first key came in
    from the block before, with another state than they took, are folded again; they alone are read. States that soon forget
    the past are right then. Those that aren't are followed by one task for each key that still has wrong blocks, from its
    first wrong one on, batch by batch: so no row is folded more than three times. Only states, one for each block, come to
    the driver. rows are computed once; equal rows in the order come in any order.
    """
    base = written(rows.withColumn("__row", F.monotonically_increasing_id()))
    narrow = base.select("__row", key(*keys).alias("__key"), F.struct(*order).alias("__order"), F.struct(*(c.alias(n) for n, c in needs.items())).alias("__x"))
    ordered = blocks(narrow, "__key", "__order", block_rows=block_rows).drop("__order")
    kind = "__block int, __row long, flag boolean, state binary"
    starts: dict[int, Any] = {}
    used: dict[int, Any] = {}
    ends: dict[int, tuple[Any, Any, Any]] = {}
    rounds: list[tuple[DataFrame, list[int]]] = []
    todo: list[int] | None = None
    for _ in range(2):
        part = ordered if todo is None else ordered.where(F.col("__block").isin(todo))
        out = written(part.groupBy("__block").applyInArrow(_fold(step, dict(starts)), kind))
        for block, state in out.where("state is not null").select("__block", "state").collect():
            ends[block], used[block] = pickle.loads(state), starts.get(block)
        rounds.append((out, todo or []))
        todo, chains, before = [], {}, None
        for block in sorted(ends):
            linked = before is not None and ends[before][1] == ends[block][0]
            came = ends[before][2] if linked else None
            if linked and before in chains:  # what it took may be right, but isn't known to be
                chains[block] = chains[before]
            elif came != used[block]:
                chains[block] = block
            if came != used[block]:
                starts[block] = came
                todo.append(block)
            before = block
        if not todo:
            break
    else:
        chain = F.create_map(*(F.lit(x) for pair in chains.items() for x in pair))[F.col("__block")]
        rest = ordered.where(F.col("__block").isin(list(chains))).withColumn("__chain", chain)
        rest = rest.repartition(len(set(chains.values())), "__chain").sortWithinPartitions("__chain", "__place")
        first = {c: starts[c] for c in set(chains.values())}
        rounds.append((written(rest.mapInArrow(_followed(step, first), kind)), list(chains)))
    flags, later = None, set()
    for out, again in reversed(rounds):
        last = out.where(~F.col("__block").isin(sorted(later))) if later else out
        flags = last if flags is None else flags.unionByName(last)
        later |= set(again)
    return base.join(flags.select("__row", F.col("flag").alias(flag)), "__row").drop("__row")


def _followed(step: Step, starts: dict[int, Any]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds chains of blocks, each from its own start, as their rows come in order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = key_now = state = None
        for batch in batches:
            flags = []
            for c, k, x in zip(*(batch.column(n).to_pylist() for n in ("__chain", "__key", "__x")), strict=True):
                if c != chain:
                    chain, key_now, state = c, k, starts[c]
                elif k != key_now:
                    key_now, state = k, None
                state, flag = step(state, x)
                flags.append(flag)
            nothing = pa.nulls(len(flags), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__block").cast(pa.int32()), batch.column("__row"), pa.array(flags, pa.bool_()), nothing], ["__block", "__row", "flag", "state"])

    return of


def _fold(step: Step, starts: dict[int, Any]) -> Callable[[pa.Table], pa.Table]:
    """Folds a block: flags of its rows and, beside the last one, its first key, last key and last state."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["__place"]))
        block, rows = table["__block"][0].as_py(), table["__row"].combine_chunks()
        first = last = table["__key"][0].as_py()
        state, flags = starts.get(block), []
        for batch in table.select(["__key", "__x"]).to_batches(max_chunksize=10_000):
            for k, x in zip(batch["__key"].to_pylist(), batch["__x"].to_pylist()):
                if k != last:
                    last, state = k, None
                state, flag = step(state, x)
                flags.append(flag)
        states = [None] * (len(flags) - 1) + [pickle.dumps((first, last, state))]
        return pa.table({"__block": pa.array([block] * len(flags), pa.int32()), "__row": rows, "flag": pa.array(flags, pa.bool_()), "state": pa.array(states, pa.binary())})

    return fold
