import datetime as dt
import json
import os

from pyspark.sql import functions as F

from panelforge.sources import files
from panelforge.streaming import alerts


def test_bars_are_written_a_folder_a_ticker(spark, tmp_path):
    rows = [("A", dt.date(2020, 1, d), 1.0, float(d), 10.0) for d in (1, 2, 3)] + [("B", dt.date(2020, 1, 1), float("nan"), 5.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, close double, volume double")
    files.write_bars(df, str(tmp_path / "bars"))
    files.write_bars(df.where("ticker = 'B'").withColumn("close", F.lit(6.0)), str(tmp_path / "bars"))
    got = files.read_bars(spark, str(tmp_path / "bars"), start="2020-01-01", end="2020-01-02")
    assert sorted((r.ticker, r.close, r.open) for r in got.collect()) == [("A", 1.0, 1.0), ("A", 2.0, 1.0), ("B", 6.0, None)]
    assert files.read_bars(spark, str(tmp_path / "bars"), ["A"]).count() == 3


def test_option_days(spark, tmp_path):
    head = " [QUOTE_DATE], [QUOTE_TIME_HOURS],[UNDERLYING_LAST], [EXPIRE_DATE],[DTE],[C_BID],[C_ASK],[C_IV],[STRIKE],[P_BID],[P_ASK]"
    (tmp_path / "day.csv").write_text(head + "\n2020-01-02,9.5,100,2020-02-01,30.0,1.0,1.2, ,100,0.9,1.1\n2020-01-02,16.0,101,2020-02-01,99,x,1.2,0.2,100,0.9,1.1\n")
    q = files.read_option_days(spark, str(tmp_path / "day.csv"), "U", single_day=True)
    assert q.count() == 4 and q.where("bid IS NULL").count() == 1 and q.where("vendor_iv = 0.2").count() == 1
    assert files.last_snapshots(q).count() == 2 and files.snapshots(q).count() == 2
    assert files.audit_option_days(q).first().n_day_count_off == 2


def test_filings(spark):
    doc = {"cik": "0000012", "recent": {"form": ["S-3", "8-K"], "filingDate": ["2020-01-05", "bad"], "accessionNumber": ["1-2-3", "4"], "primaryDocument": ["a.htm", "b.htm"]}}
    got = files.filings(spark.createDataFrame([(json.dumps(doc),)], "json string")).orderBy("form").collect()
    assert got[1].url.endswith("/12/123/a.htm") and got[0].filing_date is None
    known = spark.createDataFrame([("abc", 77)], "ticker string, cik int")
    assert files.padded_cik(spark.createDataFrame([("ABC",), ("D",)], "ticker string"), known).orderBy("ticker").first().cik == "0000000077"


def test_threshold_alerts(spark):
    got = alerts.threshold_alerts(spark.createDataFrame([(1, 5.0, 1.0), (2, 0.0, 0.0)], "id int, a double, b double"), {"a": 3.0, "b": 1.0}).collect()
    assert [(r.id, r.reasons) for r in got] == [(1, ["a", "b"])]


def test_stream_emits_each_filing_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [{"accession": "a", "form": "S-3", "filing_ts": "2020-01-05T00:00:00"}, {"accession": "a", "form": "S-3", "filing_ts": "2020-01-05T00:00:00"}, {"accession": "b", "form": "10-K", "filing_ts": "2020-01-05T00:00:00"}]
    for k in range(2):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("accession string, form string, filing_ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    q = alerts.filing_alerts(stream).writeStream.foreachBatch(lambda df, k: df.write.mode("append").parquet(str(out))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.accession for r in spark.read.parquet(str(out)).collect()] == ["a"]


def test_state_crosses_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text(json.dumps({"book": "b", "ticker": "x", "date": f"2020-01-0{k + 1}", "target": 1.0, "cap": 0.25}))
        os.utime(src / f"{k}.json", (1_600_000_000 + k, 1_600_000_000 + k))
    rows = spark.readStream.schema("book string, ticker string, date date, target double, cap double").option("maxFilesPerTrigger", 1).json(str(src))
    q = alerts.chased_stream(rows).writeStream.foreachBatch(lambda df, k: df.write.mode("append").parquet(str(out))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.held for r in spark.read.parquet(str(out)).orderBy("date").collect()] == [0.25, 0.5, 0.75]


def test_drawdown_stop_crosses_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for k, r in enumerate((-0.3, 0.1, 0.1, 0.1)):
        (src / f"{k}.json").write_text(json.dumps({"book": "b", "date": f"2020-01-0{k + 1}", "ret": r}))
        os.utime(src / f"{k}.json", (1_600_000_000 + k, 1_600_000_000 + k))
    rows = spark.readStream.schema("book string, date date, ret double").option("maxFilesPerTrigger", 1).json(str(src))
    q = alerts.stopped_stream(rows, 0.2, 2).writeStream.foreachBatch(lambda df, k: df.write.mode("append").parquet(str(out))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.stopped for r in spark.read.parquet(str(out)).orderBy("date").collect()] == [-0.3, 0.0, 0.0, 0.1]


def test_recent_filings_look_back(spark):
    rows = [("a", "s-3", "2020-01-03", "2020-01-10"), ("b", "S-3", "2020-01-02", "2020-01-10"), ("c", "10-K", "2020-01-09", "2020-01-10"), ("d", "S-3", None, "2020-01-10")]
    df = spark.createDataFrame(rows, "accession string, form string, d string, p string").selectExpr("accession", "form", "CAST(d AS date) AS filing_date", "CAST(p AS date) AS polled")
    assert [r.accession for r in alerts.recent_filings(df).collect()] == ["a"]


def test_late_and_repeated_filings_go(spark, tmp_path):
    """Each run takes what has arrived; the watermark is a week before the latest filing of the runs before."""
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")

    def poll(*found):
        doc = {"cik": "0000000001", "recent": {"form": [f for _, f, _ in found], "filingDate": [d for _, _, d in found], "accessionNumber": [a for a, _, _ in found], "primaryDocument": ["x.htm"] * len(found)}}
        spark.createDataFrame([(json.dumps(doc),)], "json string").write.mode("append").parquet(src)
        stream = alerts.filing_stream(spark.readStream.schema("json string").parquet(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)

    poll(("a", "S-3", "2020-01-20"), ("b", "8-K", "2020-01-20"), ("c", "s-3", "soon"))
    poll(("a", "S-3", "2020-01-20"), ("d", "424b5", "2020-01-14"), ("e", "S-3", "2020-01-13"), ("f", "S-3", "2020-01-02"))
    assert sorted((r.accession, r.form) for r in spark.read.parquet(out).collect()) == [("a", "S-3"), ("d", "424B5")]


def test_ordered_chase_waits_for_the_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    kinds = "book string, ticker string, d string, target double, cap double"

    def feed(*rows):
        spark.createDataFrame(rows, kinds).selectExpr("book", "ticker", "CAST(d AS date) AS date", "target", "cap").write.mode("append").parquet(src)
        stream = alerts.ordered_chase(spark.readStream.schema("book string, ticker string, date date, target double, cap double").parquet(src), "10 days")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)

    feed(("b", "x", "2020-01-04", 1.0, 0.25), ("b", "x", "2020-01-02", -1.0, 0.25), ("b", "x", "2020-01-05", None, 0.25))
    feed(("b", "x", "2020-01-03", 1.0, 0.5), ("b", "x", "2020-01-06", 1.0, None))
    feed(("~", "~", "2021-01-01", 0.0, None))
    got = [(str(r.date), r.held) for r in spark.read.parquet(out).where("book = 'b'").orderBy("date").collect()]
    assert got == [("2020-01-02", -0.25), ("2020-01-03", 0.25), ("2020-01-04", 0.5), ("2020-01-05", 0.5), ("2020-01-06", 1.0)]
