"""Alerts and incremental state over streams of filings, assessments and bars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelforge.sources import files

# Forms that announce or register new shares.
DILUTION_FORMS = ("S-1", "S-3", "S-3ASR", "F-1", "F-3", "424B2", "424B3", "424B4", "424B5", "EFFECT")


def filing_alerts(filings: DataFrame, forms=DILUTION_FORMS, lookback: str = "7 days", key: str = "accession", ts: str = "filing_ts") -> DataFrame:
    """Each dilution filing once. On a stream, late ones beyond the lookback go; a batch is treated alike but for lateness."""
    at = filings.where(F.col("form").isin(list(forms)) & F.col(ts).isNotNull())
    if at.isStreaming:
        return at.withWatermark(ts, lookback).dropDuplicatesWithinWatermark([key])
    return at.dropDuplicates([key])


def recent_filings(filings: DataFrame, forms=DILUTION_FORMS, lookback_days: int = 7, polled: str = "polled", date: str = "filing_date") -> DataFrame:
    """The filings of these forms (in any case) dated at most ``lookback_days`` before they were polled; a malformed (null) date is none."""
    wanted = F.upper("form").isin([f.upper() for f in forms])
    return filings.where(wanted & (F.col(date) >= F.date_sub(F.col(polled), lookback_days)))


def filing_stream(documents: DataFrame, forms=DILUTION_FORMS, lookback: str = "7 days", column: str = "json") -> DataFrame:
    """A stream of JSON documents of companies' recent filings as alerts: each accession once, the first time that it is seen;
    filings dated more than the lookback before the latest one seen in earlier batches are late and go, with their state."""
    at = files.filings(documents, column)
    at = at.withColumn("form", F.upper("form")).withColumn("filing_ts", F.col("filing_date").cast("timestamp"))
    return filing_alerts(at, [f.upper() for f in forms], lookback)


def threshold_alerts(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows with a value at or above its limit, with the reasons."""
    reasons = F.array_compact(F.array(*(F.when(F.col(c) >= v, F.lit(c)) for c, v in limits.items())))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)


class _Chase(StatefulProcessor):
    """The held weight of one (book, ticker), approached by at most the cap a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "held double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = float(self.now.get()[0]) if self.now.exists() else 0.0
        at = pd.concat(list(rows)).sort_values("date")
        held = []
        for target, cap in zip(at["target"], at["cap"], strict=True):
            gap = target - now
            now += gap if pd.isna(cap) else max(-cap, min(cap, gap))
            held.append(now)
        self.now.update((now,))
        yield pd.DataFrame({"book": key[0], "ticker": key[1], "date": at["date"], "held": held})

    def close(self) -> None:
        pass


class _OrderedChase(StatefulProcessor):
    """As ``_Chase``, for rows in any order: they wait in the state until the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "held double")
        self.waiting = handle.getListState("waiting", "ms long, target double, cap double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = pd.concat(list(rows))
        ms = (at["ts"] - pd.Timestamp(0)).dt.total_seconds().mul(1000).round().astype("int64")
        self.waiting.appendList([(int(m), None if pd.isna(t) else float(t), None if pd.isna(c) else float(c)) for m, t, c in zip(ms, at["target"], at["cap"], strict=True)])
        self.handle.registerTimer(int(ms.max()))  # one a batch: when the watermark has passed its last row, it has passed all up to there
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, rows = expiredTimerInfo.getExpiryTimeInMs(), list(self.waiting.get())
        due, rest = sorted((r for r in rows if r[0] <= upto), key=lambda r: r[0]), [r for r in rows if r[0] > upto]
        if not due:
            return
        now, held = float(self.now.get()[0]) if self.now.exists() else 0.0, []
        for _, target, cap in due:
            gap = 0.0 if target is None else target - now
            now += gap if cap is None else max(-cap, min(cap, gap))
            held.append(now)
        self.now.update((now,))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame({"book": key[0], "ticker": key[1], "date": [pd.Timestamp(r[0], unit="ms").date() for r in due], "held": held})

    def close(self) -> None:
        pass


class _Stop(StatefulProcessor):
    """The drawdown stop of one book."""

    def __init__(self, limit: float, cooldown: int):
        self.limit, self.cooldown = limit, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "equity double, peak double, left int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        equity, peak, left = self.state.get() if self.state.exists() else (1.0, 1.0, 0)
        at = pd.concat(list(rows)).sort_values("date")
        out = []
        for r in at["ret"].fillna(0.0):
            if left == 0:
                out.append(r)
                equity *= 1 + r
                peak = max(peak, equity)
                left = self.cooldown if equity / peak - 1 <= -self.limit else 0
            else:
                out.append(0.0)
                left -= 1
                peak = equity if left == 0 else peak
        self.state.update((float(equity), float(peak), int(left)))
        yield pd.DataFrame({"book": key[0], "date": at["date"], "stopped": out})

    def close(self) -> None:
        pass


def chased_stream(rows: DataFrame) -> DataFrame:
    """rows (book, ticker, date, target, cap) with held, across micro-batches."""
    return rows.groupBy("book", "ticker").transformWithStateInPandas(_Chase(), "book string, ticker string, date date, held double", "append", "none")


def ordered_chase(rows: DataFrame, lateness: str = "60 days") -> DataFrame:
    """rows (book, ticker, date, target, cap), up to ``lateness`` out of order, with held: a row is taken once the watermark has passed its date."""
    at = rows.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", lateness).select("book", "ticker", "ts", "target", "cap")
    return at.groupBy("book", "ticker").transformWithStateInPandas(_OrderedChase(), "book string, ticker string, date date, held double", "append", "eventTime")


def stopped_stream(rows: DataFrame, limit: float = 0.20, cooldown: int = 21) -> DataFrame:
    """rows (book, date, ret) with stopped, across micro-batches."""
    return rows.groupBy("book").transformWithStateInPandas(_Stop(limit, cooldown), "book string, date date, stopped double", "append", "none")
