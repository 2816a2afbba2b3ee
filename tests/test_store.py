"""Views that are written once a session."""

import time

from panelforge.plans import store


def test_a_view_is_built_again_when_a_table_changes(spark, tmp_path):
    tables, built = str(tmp_path / "tables"), []

    def view():
        def build():
            built.append(1)
            return spark.read.parquet(f"{tables}/t.parquet")

        return store.stored(spark, tables, "t", build)

    spark.range(3).write.parquet(f"{tables}/t.parquet")
    assert view().count() == 3 and view().count() == 3 and len(built) == 1
    old = store._PATHS[spark.sparkContext.applicationId, tables, "t"][1]
    time.sleep(0.01)
    spark.range(5).write.mode("overwrite").parquet(f"{tables}/t.parquet")
    assert view().count() == 5 and len(built) == 2
    fs, at = store._files(spark, old)
    assert not fs.exists(at)


def test_equal_quotes_are_priced_once(spark, tmp_path):
    from panelforge.plans import registry, views

    spark.createDataFrame([(k, 901.0) for k in (11, 21, 31, 41)], "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    queries = registry.queries()
    for name, view in (("o4_american", "american"), ("o5_american_greeks", "american-greeks"), ("o5_bumped_greeks", "bumped")):
        got = queries[name](spark, str(tmp_path)).collect()
        priced = spark.read.parquet(store._PATHS[spark.sparkContext.applicationId, str(tmp_path), view][1])
        assert len(got) == 4 * priced.count() and priced.count() == priced.select(*views.TERMS).distinct().count()
        by = {}
        for r in got:
            by.setdefault((r.expiry, r.strike, r.option_type), set()).add(tuple(r)[4:])
        assert all(len(x) == 1 for x in by.values())


def test_generated_methods_are_small_enough_to_be_compiled(spark, tmp_path):
    from panelforge.plans import registry

    spark.createDataFrame([(1, 901.0)], "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    assert registry.queries()["o3_greeks"](spark, str(tmp_path)).count() > 0
    assert int(spark.conf.get(registry.METHOD_SETTING)) <= 8000


def test_points_are_made_where_their_part_is(spark, tmp_path, monkeypatch):
    """Neither are all quotes written for the points, nor is a row of them shuffled; tasks grow with the parts."""
    from panelforge.operators import options
    from panelforge.plans import quotes, views

    d = str(tmp_path)
    spark.createDataFrame([(k, 900.0 + k) for k in range(60)], "p_partkey long, p_retailprice double").write.parquet(f"{d}/part.parquet")
    built = []
    monkeypatch.setattr(quotes, "stored", lambda spark, d, name, build: built.append(build()) or built[-1])
    points = quotes.true_points(spark, d)
    assert (spark.sparkContext.applicationId, d, "quotes") not in store._PATHS
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in plan[: plan.index("Generate")]
    before = options.points(options.with_forward(options.clean(views.quotes(spark, d)), views.RATE), views.RATE, vol="true_vol")
    assert sorted(points.collect()) == sorted(before.collect()) and before.count() > 1000
    monkeypatch.setattr(views, "PARTS_A_TASK", 2)
    assert views.wide_quotes(spark, d).rdd.getNumPartitions() == 30
