"""Portfolio accounting over tables of weights: one pass for all books.

``weights`` are (book, date, ticker, w), targets formed at the close of a date. The one
place of the execution lag is ``held``. Market rows are a panel (date, ticker, close, open,
volume, r). Every window is keyed by (book, ticker) or ticker, every sum by (book, date).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.panel import expanding, filled, folded, over, rolling


@dataclass(frozen=True)
class Costs:
    half_spread_bps: float = 1.0
    impact_eta: float = 0.1
    capital: float = 1e6
    adv_lookback: int = 21
    vol_lookback: int = 21
    default_vol: float = 0.015


def problems(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """book, date, ticker, problem: weights on unknown dates or tickers, or given twice. Empty for a sound book."""
    dates = weights.join(panel.select("date").distinct(), "date", "left_anti").withColumn("problem", F.lit("unknown date"))
    names = weights.join(panel.select("ticker").distinct(), "ticker", "left_anti").withColumn("problem", F.lit("unknown ticker"))
    twice = weights.groupBy("book", "date", "ticker").count().where("count > 1").withColumn("problem", F.lit("given twice"))
    cols = ["book", "date", "ticker", "problem"]
    return dates.select(cols).unionByName(names.select(cols)).unionByName(twice.select(cols)).distinct()


def held(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """The panel's rows for each book with ``target``, the weight of the row before (the last one set): the execution lag."""
    books = weights.agg(F.array_sort(F.collect_set("book")).alias("books"))  # one row of names, spread over the panel
    grid = panel.join(books, F.lit(True)).withColumn("book", F.explode("books")).drop("books")
    at = grid.join(weights.select("book", "date", "ticker", "w"), ["book", "date", "ticker"], "left")
    at = at.withColumn("_w", filled(F.col("w"), "book", "ticker"))
    return at.withColumn("target", F.coalesce(F.lag("_w").over(over("book", "ticker")), F.lit(0.0))).drop("_w", "w")


def with_liquidity(panel: DataFrame, costs: Costs) -> DataFrame:
    """panel with adv and sigma of the rows before each one; expanding until the windows fill."""
    w = over("ticker")
    adv = F.coalesce(rolling(F.avg, F.col("volume"), costs.adv_lookback, "ticker", least=5), expanding(F.avg, F.col("volume"), "ticker"))
    vol = F.coalesce(rolling(F.stddev_samp, F.col("r"), costs.vol_lookback, "ticker", least=5), expanding(F.stddev_samp, F.col("r"), "ticker", least=2))
    at = panel.withColumn("_adv", adv).withColumn("_vol", vol)
    return at.withColumn("adv", F.lag("_adv").over(w)).withColumn("sigma", F.lag("_vol").over(w)).drop("_adv", "_vol")


def participation_cap(close: Column, adv: Column, capital: float, most: float) -> Column:
    """The largest trade as a weight; null is no cap."""
    cap = most * adv * close / capital
    return F.when(cap > 0, cap)


def chased(at: DataFrame, cap: str = "cap") -> DataFrame:
    """at (book, ticker, date, target, cap) with ``held``: the target approached by at most the cap a row, the rest carried.

    A null cap is no cap; a null target trades nothing.
    """

    def step(now: float, target: float | None, most: float | None) -> tuple[float, float]:
        gap = 0.0 if target is None else target - now
        now += gap if most is None else max(-most, min(most, gap))
        return now, now

    return folded(at, ("book", "ticker"), ("target", cap), step, 0.0, "held")


def half_spread(turnover: Column, bps: float) -> Column:
    return turnover * (bps / 1e4)


def square_root_impact(participation: Column, sigma: Column, eta: float) -> Column:
    return eta * F.coalesce(sigma, F.lit(0.0)) * F.sqrt(F.greatest(F.lit(0.0), participation))


def trade_cost(dw: Column, capital: Column | float, costs: Costs) -> Column:
    """The cost of a trade of dw (a weight) as a share of the portfolio."""
    capital = capital if isinstance(capital, Column) else F.lit(float(capital))
    size = F.abs(dw)
    shares = F.when(F.col("close") > 0, size * capital / F.col("close")).otherwise(0.0)
    part = F.when(F.col("adv") > 0, shares / F.col("adv")).otherwise(0.0)
    sigma = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(costs.default_vol)
    return F.when(size > 0, half_spread(size, costs.half_spread_bps) + size * square_root_impact(part, sigma, costs.impact_eta))


def positions(weights: DataFrame, panel: DataFrame, costs: Costs | None = None, max_participation: float | None = None, fill: str = "close") -> DataFrame:
    """book, date, ticker, target, held, trade, pnl and the market columns that costs need."""
    market = with_liquidity(panel, costs or Costs())
    at = held(weights, market)
    if max_participation is None:
        at = at.withColumn("held", F.col("target"))
    else:
        at = chased(at.withColumn("cap", participation_cap(F.col("close"), F.col("adv"), (costs or Costs()).capital, max_participation)))
    w = over("book", "ticker")
    if fill == "next_open":
        earned = F.try_divide(F.lead("open").over(w), F.col("open")) - 1
    elif fill == "close":
        earned = F.col("r")
    else:
        raise ValueError(f"unknown fill: {fill!r}")
    return at.withColumn("trade", F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))).withColumn("pnl", F.col("held") * earned)


def account(weights: DataFrame, panel: DataFrame, costs: Costs | None = None, max_participation: float | None = None, fill: str = "close") -> DataFrame:
    """book, date, gross, cost, ret, turnover, fill_gap, equity. Without costs exactly nothing is charged."""
    at = positions(weights, panel, costs, max_participation, fill)
    cost = F.coalesce(F.sum(trade_cost(F.col("trade"), costs.capital, costs)), F.lit(0.0)) if costs else F.lit(0.0)
    daily = at.groupBy("book", "date").agg(
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("gross"),
        cost.alias("cost"),
        F.sum(F.abs("trade")).alias("turnover"),
        F.sum(F.abs(F.col("target") - F.col("held"))).alias("fill_gap"),
    )
    daily = daily.withColumn("ret", F.col("gross") - F.col("cost"))
    return with_equity(daily)


def with_equity(daily: DataFrame, *keys: str, r: str = "ret") -> DataFrame:
    """daily with equity, the running product of 1 + ret (0 from a return of -100% on)."""
    keys = keys or ("book",)
    w = over(*keys).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.exp(F.sum(F.ln(1 + F.coalesce(F.col(r), F.lit(0.0)))).over(w))
    lost = F.max(F.when(F.col(r) <= -1, 1).otherwise(0)).over(w) == 1
    return daily.withColumn("equity", F.when(lost, F.lit(0.0)).otherwise(grown))


def folds(calendar: DataFrame, in_sample: int = 252, out_sample: int = 63, step: int | None = None, expanding_: bool = True) -> DataFrame:
    """fold, train_start, fit_end, oos_start, oos_end (dates) of a calendar (date, pos): oos windows tile it."""
    step = step or out_sample
    n = F.max("pos") + 1
    starts = calendar.agg(n.alias("n")).where(F.col("n") >= in_sample + out_sample)
    starts = starts.select(F.explode(F.sequence(F.lit(in_sample).cast("long"), (F.col("n") - out_sample).cast("long"), F.lit(step).cast("long"))).alias("s"))
    first = F.lit(0) if expanding_ else F.col("s") - in_sample
    at = starts.select(((F.col("s") - in_sample) / step).cast("int").alias("fold"), first.cast("long").alias("a"), (F.col("s") - 1).alias("b"), F.col("s").alias("c"), (F.col("s") + out_sample - 1).alias("d"))
    for column, name in (("a", "train_start"), ("b", "fit_end"), ("c", "oos_start"), ("d", "oos_end")):
        at = at.join(calendar.select(F.col("date").alias(name), F.col("pos").cast("long").alias(column)), column)
    return at.select("fold", "train_start", "fit_end", "oos_start", "oos_end")


def walk_forward(daily: DataFrame, spans: DataFrame, book_of_fold: str | None = None) -> DataFrame:
    """book, fold, date, ret, equity: each fold's out-of-sample rows of an accounted table, stitched.

    ``daily`` is accounted once. If weights differ by fold, ``book_of_fold`` is the column that says which fold a row's book is for.
    """
    inside = (F.col("date") >= F.col("oos_start")) & (F.col("date") <= F.col("oos_end"))
    if book_of_fold:
        inside &= F.col(book_of_fold) == F.col("fold")
    at = daily.join(F.broadcast(spans.select("fold", "oos_start", "oos_end")), inside)  # a row a fold
    first = F.row_number().over(Window.partitionBy("book", "date").orderBy("fold"))
    return with_equity(at.withColumn("_k", first).where("_k = 1").select("book", "fold", "date", "ret", "turnover"))


def walk_forward_with(make_weights: Callable[[DataFrame, object], DataFrame], name: str, panel: DataFrame, spans: DataFrame, costs: Costs | None = None) -> DataFrame:
    """book, fold, date, ret, turnover, equity of a callback ``make_weights(panel, fit_end)`` -> (date, ticker, w), asked once a fold.

    The folds are a short list on the driver; all folds' weights are accounted in one job on the full
    panel, each as a book of its own, and only out-of-sample rows are kept.
    """
    weights = None
    for f in spans.orderBy("fold").collect():
        own = make_weights(panel, f.fit_end).select(F.lit(f"{f.fold}").alias("book"), "date", "ticker", "w")
        weights = own if weights is None else weights.unionByName(own)
    if weights is None:
        raise ValueError("no fold fits the calendar")
    daily = account(weights, panel, costs).select(F.lit(name).alias("book"), F.col("book").cast("int").alias("of_fold"), "date", "ret", "turnover")
    return walk_forward(daily, spans, "of_fold")


def fold_report(stitched: DataFrame, periods: int = 252) -> DataFrame:
    """book, fold, days, sharpe, compound of each fold."""
    sharpe = F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * math.sqrt(periods)
    return stitched.groupBy("book", "fold").agg(F.count("*").alias("days"), sharpe.alias("sharpe"), (F.product(1 + F.col("ret")) - 1).alias("compound"))


def capital_sweep(weights: DataFrame, panel: DataFrame, costs: Costs, capitals: Sequence[float], periods: int = 252) -> DataFrame:
    """book, capital, net_ann_return, net_sharpe, cost_drag_ann, ann_cost, gross_sharpe. Trades are made once; only their cost depends on capital."""
    spark = panel.sparkSession
    at = positions(weights, panel, costs)
    grid = spark.createDataFrame([(float(c),) for c in capitals], "capital double")
    cost = F.coalesce(F.sum(trade_cost(F.col("trade"), F.col("capital"), costs)), F.lit(0.0))
    daily = at.join(F.broadcast(grid), F.lit(True)).groupBy("book", "capital", "date").agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("gross"), cost.alias("cost"))
    net = F.col("gross") - F.col("cost")
    ann = lambda x: F.pow(F.product(1 + x), F.lit(float(periods)) / F.count("*")) - 1
    sharpe = lambda x: F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))) * math.sqrt(periods)
    return daily.groupBy("book", "capital").agg(
        ann(net).alias("net_ann_return"), sharpe(net).alias("net_sharpe"), (ann(F.col("gross")) - ann(net)).alias("cost_drag_ann"), (F.sum("cost") * periods / F.count("*")).alias("ann_cost"), sharpe(F.col("gross")).alias("gross_sharpe")
    )


def capacity(sweep: DataFrame, half: bool = True) -> DataFrame:
    """book, gross_sharpe, threshold, capacity, note: where the net Sharpe first falls below the threshold, log-linear between capitals."""
    level = F.col("gross_sharpe") * (0.5 if half else 1.0)
    w = Window.partitionBy("book").orderBy("capital")
    at = sweep.withColumn("threshold", level).withColumn("_x0", F.lag("capital").over(w)).withColumn("_y0", F.lag("net_sharpe").over(w))
    crossing = F.min(F.when(F.col("net_sharpe") < F.col("threshold"), F.struct("capital", "net_sharpe", "_x0", "_y0")))
    one = at.groupBy("book").agg(F.first("gross_sharpe").alias("gross_sharpe"), F.first("threshold").alias("threshold"), crossing.alias("c"))
    x0, x1 = F.log10("c._x0"), F.log10("c.capital")
    share = F.coalesce(F.try_divide(F.col("threshold") - F.col("c._y0"), F.col("c.net_sharpe") - F.col("c._y0")), F.lit(0.0))
    none = F.col("gross_sharpe").isNull() | (F.col("gross_sharpe") <= 0)
    note = F.when(none, "frictionless Sharpe not positive").when(F.col("c").isNull(), "above the threshold throughout").when(F.col("c._x0").isNull(), "below the threshold from the first").otherwise("")
    value = F.when(none | F.col("c").isNull(), F.lit(None).cast("double")).when(F.col("c._x0").isNull(), F.col("c.capital")).otherwise(F.pow(F.lit(10.0), x0 + share * (x1 - x0)))
    return one.select("book", "gross_sharpe", F.when(~none, F.col("threshold")).alias("threshold"), value.alias("capacity"), note.alias("note"))
