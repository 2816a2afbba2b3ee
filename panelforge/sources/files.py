"""Bars, quote files and filings: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.panel import nan_to_null, require_columns

BARS = T.StructType([T.StructField("date", T.DateType()), T.StructField("open", T.DoubleType()), T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()), T.StructField("ticker", T.StringType())])


def write_bars(bars: DataFrame, path: str) -> None:
    """A folder a ticker; only the tickers at hand are replaced."""
    at = require_columns(bars, ("ticker", "date", "close", "volume"))
    at.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def read_bars(spark: SparkSession, path: str, tickers=None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Cached bars: tickers prune folders, dates are pushed to the scan."""
    at = nan_to_null(spark.read.schema(BARS).parquet(path))
    if tickers is not None:
        at = at.where(F.col("ticker").isin(list(tickers)))
    if start:
        at = at.where(F.col("date") >= F.lit(start).cast("date"))
    return at.where(F.col("date") <= F.lit(end).cast("date")) if end else at


REQUIRED = ("QUOTE_DATE", "QUOTE_TIME_HOURS", "UNDERLYING_LAST", "EXPIRE_DATE", "DTE", "STRIKE", "C_BID", "C_ASK", "P_BID", "P_ASK")


def read_option_days(spark: SparkSession, path: str, underlying: str, single_day: bool = False) -> DataFrame:
    """Long quotes of wide files (a call and a put a row): headers are normalised, bad numbers null, open interest unknown."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip().strip("[]").strip().upper() for c in raw.columns))
    require_columns(raw, REQUIRED)
    if single_day and raw.select(F.trim("QUOTE_DATE").try_cast("date").alias("d")).distinct().limit(2).count() != 1:
        raise ValueError("one trading date is expected")
    num = lambda c: F.trim(F.col(c)).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    side = lambda p, kind: F.struct(F.lit(kind).alias("option_type"), num(f"{p}_BID").alias("bid"), num(f"{p}_ASK").alias("ask"), num(f"{p}_VOLUME").alias("volume"), num(f"{p}_IV").alias("vendor_iv"), num(f"{p}_DELTA").alias("vendor_delta"))
    at = raw.select(
        F.lit(underlying).alias("underlying"), F.trim("QUOTE_DATE").try_cast("date").alias("quote_date"), num("QUOTE_TIME_HOURS").alias("snapshot"), num("UNDERLYING_LAST").alias("spot"),
        F.trim("EXPIRE_DATE").try_cast("date").alias("expiry"), (num("DTE") / 365).alias("tte"), num("STRIKE").alias("strike"), F.explode(F.array(side("C", "call"), side("P", "put"))).alias("x"),
    )
    return nan_to_null(at.select("*", "x.*").drop("x").withColumn("open_interest", F.lit(None).cast("long")))


def audit_option_days(quotes: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """underlying, quote_date, rows, and how many expiries disagree with their day count."""
    off = F.abs(F.col("tte") * 365 - F.datediff("expiry", "quote_date")) > tolerance
    return quotes.groupBy("underlying", "quote_date").agg(F.count("*").alias("n"), F.count_if(off).alias("n_day_count_off"))


def snapshots(quotes: DataFrame) -> DataFrame:
    return quotes.select("underlying", "quote_date", "snapshot").distinct()


def last_times(quotes: DataFrame) -> DataFrame:
    """underlying, quote_date and the last snapshot of each day."""
    return quotes.groupBy("underlying", "quote_date").agg(F.max("snapshot").alias("snapshot"))


def last_snapshots(quotes: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The quotes of each day's last snapshot; ``last`` may hold ``last_times``."""
    last = last_times(quotes) if last is None else last
    return quotes.join(last, ["underlying", "quote_date", "snapshot"], "left_semi")


FILINGS = "cik string, recent struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>"


def filings(raw: DataFrame, column: str = "json", base: str = "https://example.org/filings") -> DataFrame:
    """cik, form, filing_date, accession, document, url: parallel arrays zipped to rows. A malformed date is null."""
    at = raw.select(F.from_json(column, FILINGS).alias("j")).select("j.cik", F.explode(F.arrays_zip("j.recent.form", "j.recent.filingDate", "j.recent.accessionNumber", "j.recent.primaryDocument")).alias("x"))
    at = at.select("cik", F.col("x.form").alias("form"), F.col("x.filingDate").try_cast("date").alias("filing_date"), F.col("x.accessionNumber").alias("accession"), F.col("x.primaryDocument").alias("document"))
    return at.withColumn("url", F.concat_ws("/", F.lit(base), F.expr("ltrim('0', cik)"), F.regexp_replace("accession", "-", ""), "document"))


def padded_cik(tickers: DataFrame, known: DataFrame) -> DataFrame:
    """tickers with cik, ten digits: known is (ticker, cik)."""
    k = known.select(F.upper("ticker").alias("_t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    return tickers.join(k, F.upper("ticker") == F.col("_t"), "left").drop("_t")
