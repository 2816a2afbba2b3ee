"""Panels of bars in long form: dense grids, fills, guarded windows, returns.

Lags, rolling windows and fills act on the panel's rows (every date), not on a
ticker's own: a panel is made dense first. Windows carry a key, so they run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floats with NaN as null: Spark ranks NaN above all and lets it into sums."""
    floats = {c for c, k in df.dtypes if k in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def over(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def back(n: int, *keys: str, order: str = "date") -> WindowSpec:
    """The last n rows, this one included."""
    return over(*keys, order=order).rowsBetween(1 - n, 0)


def rolling(fn, x: Column, n: int, *keys: str, least: int | None = None, order: str = "date") -> Column:
    """fn over the last n rows; null with fewer than ``least`` (all n) values."""
    w = back(n, *keys, order=order)
    return F.when(F.count(x).over(w) >= (n if least is None else least), fn(x).over(w))


def expanding(fn, x: Column, *keys: str, least: int = 1, order: str = "date") -> Column:
    w = over(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(x).over(w) >= least, fn(x).over(w))


def filled(x: Column, *keys: str, limit: int | None = None, order: str = "date") -> Column:
    """The last value seen, at most ``limit`` rows back."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(x, ignorenulls=True).over(over(*keys, order=order).rowsBetween(start, 0))


def folded(df: DataFrame, keys: Sequence[str], columns: Sequence[str], step: Callable, start, out: str, kind: T.DataType | None = None, order: str = "date") -> DataFrame:
    """df with the column ``out``: ``step(state, *columns)`` gives the next state and the row's value, over each group's rows in order.

    For rules that no window expresses. Rows are dealt by group, sorted and streamed: a task holds a batch and one
    state, however long a history is. ``kind`` is double if not given. A group's state starts from ``start``; null keys are a group, null dates come first.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != out]).add(out, kind or T.DoubleType())
    made_of = to_arrow_type(schema[out].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for b in batches:
            values = []
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, *columns)), strict=True):
                if row[: len(keys)] != key:
                    key, state = row[: len(keys)], start
                state, value = step(state, *row[len(keys) :])
                values.append(value)
            names = [n for n in b.schema.names if n != out]
            yield pa.record_batch([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(values, made_of)], [*names, out])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def calendar(df: DataFrame) -> DataFrame:
    """(date, pos): the dates in order from 0. A row a date: a table of days, however many rows there are."""
    return df.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def densify(bars: DataFrame) -> DataFrame:
    """Every (date, ticker) with what is known of it: one row of all dates is spread over the tickers."""
    days = bars.agg(F.array_sort(F.collect_set("date")).alias("days"))
    return _spread(bars, days).join(bars, ["date", "ticker"], "left")


def _spread(bars: DataFrame, days: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct().join(days, F.lit(True)).select("ticker", F.explode("days").alias("date"))


def align(bars: DataFrame, limit: int = 3) -> DataFrame:
    """date, ticker, close, open, volume: dense, gaps filled at most ``limit`` rows forward, never back.

    Tickers and dates without any close go. ``open`` stays only if every surviving ticker has one.
    """
    require_columns(bars, ("ticker", "date", "close", "volume"))
    if "open" not in bars.columns:
        bars = bars.withColumn("open", F.lit(None).cast("double"))
    known = bars.groupBy("ticker").agg(F.count("close").alias("n"), F.count("open").alias("o")).where("n > 0")
    gate = known.agg(F.bool_and(F.col("o") > 0).alias("opens"))
    dense = densify(bars.join(known.select("ticker"), "ticker", "left_semi"))
    cols = [filled(F.col(c), "ticker", limit=limit).alias(c) for c in ("close", "open", "volume")]
    dense = dense.select("date", "ticker", *cols)
    live = F.max(F.col("close").isNotNull()).over(Window.partitionBy("date"))
    dense = dense.withColumn("live", live).where("live").drop("live")
    return dense.join(gate, F.lit(True)).select("date", "ticker", "close", F.when(F.col("opens"), F.col("open")).alias("open"), "volume")


def returns(panel: DataFrame, kind: str = "simple", column: str = "r") -> DataFrame:
    """panel with the return of ``close`` on the row before; gaps stay null."""
    before = F.lag("close").over(over("ticker"))
    if kind == "simple":
        return panel.withColumn(column, F.try_divide(F.col("close"), before) - 1)
    if kind == "log":
        return panel.withColumn(column, F.ln("close") - F.ln(before))
    raise ValueError(f"unknown kind of return: {kind!r}")


def coverage(bars: DataFrame, wanted: DataFrame, start: str, end: str) -> DataFrame:
    """ticker, first, last, reason of the wanted tickers that are absent or do not span [start, end]."""
    span = bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    at = wanted.select("ticker").distinct().join(span, "ticker", "left")
    reason = F.when(F.col("first").isNull(), "absent").when(F.col("first") > F.lit(start).cast("date"), "starts late").when(F.col("last") < F.lit(end).cast("date"), "ends early")
    return at.withColumn("reason", reason).where("reason IS NOT NULL")


def in_universe(bars: DataFrame, universe: DataFrame, name: str) -> DataFrame:
    """The bars of a universe's tickers, with each one's place in it (the first, where it is listed twice)."""
    own = universe.where(F.col("universe") == name).groupBy("ticker").agg(F.min("ord").alias("ord"))
    return bars.join(own, "ticker")


def spread_sample(df: DataFrame, value: str, count: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is one of ``count`` evenly spread distinct values of its key, first and last included."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_k", F.dense_rank().over(w.orderBy(value)) - 1).withColumn("_n", F.max("_k").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * F.col("_n") / max(1, count - 1)))
    return ranked.where((F.col("_n") < count) | F.array_contains(picks, F.col("_k").cast("long"))).drop("_k", "_n")
