"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import account, signals
from panelforge.plans import closed, files, fits, market, quotes, views


#: The JVM leaves methods above 8,000 bytecodes to its interpreter, several times slower; Spark gives such a stage's expressions methods of their own instead.
#: Panels and quotes compress tenfold in a shuffle: a task's share of the usual 64 MB would be most of a GB of rows to sort.
METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"
SETTINGS = {METHOD_SETTING: "8000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000"}


def _tuned(f):
    """The query in a session with SETTINGS: its result is lazy, so they stay."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return f(spark, sf_dir)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum over monthly bars: date, ret of the lagged book."""
    m = views.market(spark, sf_dir, "month")
    w = signals.cross_sectional_momentum(m, 12, 1, 0.2, 1)
    return views.rounded(account.account(w.withColumn("book", F.lit("mom")), m).select("date", "ret", "turnover", "equity"))


def queries() -> dict:
    made = {**market.QUERIES, **quotes.QUERIES, **fits.QUERIES, **files.QUERIES, **closed.QUERIES}
    return {name: _tuned(f) for name, f in made.items()}


def oracle_sql() -> dict[str, str]:
    return {**market.SQL, **quotes.SQL, **fits.SQL, **files.SQL, **closed.SQL}
