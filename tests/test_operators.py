import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridrisk.functions import exprs as E
from gridrisk.functions.projection import to_metres
from gridrisk.operators import events, profile, risk, sample, static, weather
from gridrisk.plans import fixtures as fx
from gridrisk.sources import readers, sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["month_summary", "lag_gap_guard", "exposure_score", "event_cells", "iqr_outliers", "moments", "top_rest", "describe", "box_stats", "corr_matrix", "corr_pairs", "dry_streak", "dry_streak_reset", "buffer_report", "lift", "sample_feature_summary", "sample_month_summary", "corr_matrix_final"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "nation", "customer", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    key = lambda df: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "") for v in r) for r in df[sorted(df.columns)].fillna("none").itertuples(index=False))
    assert key(ours) == key(theirs)


def test_every_query_has_sql():
    core = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"}
    assert core == {k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"}


def test_breaks_and_nulls(spark):
    rows = spark.createDataFrame([(0.1183, 0.99), (0.1184, 1.0), (None, None)], "p double, rain double")
    found = rows.select(E.weather_class(F.col("p")).alias("c"), E.rain_grade(F.col("rain")).alias("g")).collect()
    assert [tuple(r) for r in found] == [(1, 0), (2, 1), (10, 3)]
    got = spark.range(1).select(E.unit(F.lit(None).cast("double")).alias("u"), E.day_weight(F.lit("2024-03-11").cast("date")).alias("w")).first()
    assert tuple(got) == (0.0, 0.95)


def test_one_pass_keeps_cells_outside_the_grid(spark):
    w = fx.weather(spark, SF).where("grid_id in ('10001_19500', '10002_19500')")
    m = fx.master_grid(spark, SF).where("grid_id = '10001_19500'")
    w, cells = weather.features(w), static.terrain_cells(m, fx.FULL_WEIGHT, fx.HALF_WEIGHT)
    forest, exposure, terrain = static.forest(m), static.exposure(m), risk.terrain_wind(w, cells)
    want = risk.final_dataset(w, forest, terrain, exposure, risk.index(w, forest, terrain, exposure))
    got = risk.in_one_pass(w, forest, cells, exposure)
    rows = lambda df: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(sorted(want.columns)).collect())
    assert set(got.columns) == set(want.columns) and rows(got) == rows(want)
    assert got.where("grid_id = '10002_19500' AND tmi_p IS NULL").count() > 0


def _days(spark, days):
    rows = [("a", dt.date.fromisoformat(d), h, 0) for d, h in days]
    df = spark.createDataFrame(rows, "grid_id string, date date, hm_mean int, rn_day_mean int")
    return df.select("*", *[F.lit(0).alias(c) for c in weather.REALS if c not in df.columns])


def test_gap_guard_and_chunks(spark):
    df = _days(spark, [("2024-03-30", 100), ("2024-03-31", 200), ("2024-04-01", 300), ("2024-04-05", 400)])
    lags = weather.with_lags(weather.base(df)).orderBy("date").select("hm_lag1_used").collect()
    assert [r[0] for r in lags] == [10.0, 10.0, 20.0, 40.0]
    whole = {r.date: r.effective_humidity for r in weather.features(df).collect()}
    chunked = {r.date: r.effective_humidity for r in weather.features_by_chunk(df).collect()}
    assert [str(d) for d in whole if abs(whole[d] - chunked[d]) > 1e-9] == ["2024-04-01"]


def test_one_exchange_for_lags(spark):
    plan = weather.features(_days(spark, [("2024-03-30", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_projection(spark):
    x, y = to_metres(F.lit(127.5), F.lit(38.0))
    u, v = to_metres(F.lit(126.9784), F.lit(37.5666))
    r = spark.range(1).select(x, y, u, v).first()
    assert [round(c, 1) for c in r] == [1_000_000.0, 2_000_000.0, 953_936.6, 1_952_043.0]


def test_months_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-03"), (2, "2024-04")], "v int, month string")
    path = str(tmp_path / "m")
    sinks.write_months(df, path, "all")
    sinks.write_months(df.where("v = 2").withColumn("v", F.lit(5)), path)
    assert sorted(r.v for r in readers.read_tree(spark, path).collect()) == [1, 5]
    pruned = readers.in_dates(readers.read_tree(spark, path), months=["2024-03"])
    assert "PartitionFilters: [isnotnull(month" in pruned._jdf.queryExecution().executedPlan().toString()


def test_part_files_and_contract(spark, tmp_path):
    for k in (1, 2, 10):
        spark.range(k, k + 1).coalesce(1).toPandas().to_parquet(tmp_path / f"part.{k}.parquet")
    assert sorted(r.id for r in readers.read_parts(spark, str(tmp_path), 2).collect()) == [1, 2]
    with pytest.raises(KeyError):
        readers.require_columns(spark.range(1), ["x"], "t")


def test_threshold_and_lift(spark):
    assert (sample.threshold(100, 0), sample.threshold(1000, 1), sample.threshold(10**9, 1)) == (0, 10_000, 1)
    df = spark.createDataFrame([(float(k), int(k >= 9)) for k in range(10)], "s double, fire_label int")
    r = profile.lift(df, ["s"]).first()
    assert (r.top10_capture, r.top20_capture) == (1.0, 1.0)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert profile.correlations(df, ["a"], ["b"]).first().r is None


def test_target_of_every_event(spark):
    """The label comes from all events of the season and all cells within five of one."""
    m, fires = fx.master_grid(spark, "/root/testdata/sf0.01"), events.project(events.seasonal(fx.fire_history(spark, "/root/testdata/sf0.01"), fx.START_YEAR, fx.END_YEAR))
    near = {(x.cx + i, x.cy + j) for x in events._spot(fires).distinct().collect() for i in range(-5, 6) for j in range(-5, 6) if i * i + j * j <= 25}
    days = {r.grid_id: r.n for r in fx.weather(spark, "/root/testdata/sf0.01").groupBy("grid_id").agg(F.count("*").alias("n")).collect()}
    want = {}
    for cell in {r.grid_id for r in m.select("grid_id").collect()}:
        label = int(tuple(map(int, cell.split("_"))) in near)
        want[label] = want.get(label, 0) + days.get(cell, 0)
    assert {r.fire_label: r.n for r in entry.queries()["final_with_target"](spark, "/root/testdata/sf0.01").collect()} == want
