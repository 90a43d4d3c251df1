"""Sources, sinks and the full run in a temporary directory."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from gridrisk.operators import full_run, risk, static, weather
from gridrisk.plans import fixtures as fx
from gridrisk.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("run"))
    days = fx.weather(spark, SF).where("month BETWEEN '1996-01' AND '1996-06'")
    sinks.write_months(days, f"{base}/weather", "all")
    sinks.write_parquet(fx.master_grid(spark, SF), f"{base}/master")
    sinks.write_csv(fx.fire_history(spark, SF), f"{base}/events")
    return full_run.Run(f"{base}/weather", f"{base}/master", f"{base}/out", fx.FULL_WEIGHT, fx.HALF_WEIGHT, f"{base}/events", start_year=1992, end_year=1998)


DAILY = ("feat_weather_daily", "feat_terrain_ywi_daily", "feat_pffdri_daily", "final_feature_daily")


def contents(spark, out):
    return {n: rows(spark.read.parquet(w.path)) for n, w in out.items() if n != "repeated"}


@pytest.fixture(scope="module")
def ran(spark, sources):
    """What the whole run wrote, and its contents."""
    out = full_run.run_all(spark, sources)
    return out, contents(spark, out)


def test_outputs_equal_the_join_forms(spark, sources, ran):
    fact, master = readers.read_tree(spark, sources.weather), spark.read.parquet(sources.master)
    days, forest, exposure = weather.features(fact), static.forest(master), static.exposure(master)
    terrain = risk.terrain_wind(days, static.terrain_cells(master, sources.full_weight, sources.half_weight))
    index = risk.index(days, forest, terrain, exposure)
    want = {
        "feat_weather_daily": days, "feat_terrain_ywi_daily": terrain, "feat_pffdri_daily": index, "feat_forest_static": forest,
        "feat_power_access_static": exposure, "final_feature_daily": risk.final_dataset(days, forest, terrain, exposure, index),
    }
    out, found = ran
    assert all(found[name] == rows(df) for name, df in want.items()) and len(found["final_feature_daily"]) > 100
    assert len(out) == 10 and all(found[n] for n in found)
    made = out["final_feature_daily"]
    first, last = days.agg(F.min("date"), F.max("date")).first()
    assert (made.rows, made.first, made.last) == (len(found["final_feature_daily"]), first, last) and out["repeated"] == 0
    assert made.months == tuple(f"1996-0{k}" for k in range(1, 7)) and abs(made.cells - days.select("grid_id").distinct().count()) <= 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("gridrisk_stage")]


@pytest.mark.parametrize("part", [{"months": ["1996-03"]}, {"start": "1996-02-11", "end": "1996-04-09"}, {"months": ["1996-03", "1996-05"], "start": "1996-03-20", "end": "1996-05-02"}])
def test_days_outside_a_run_stay_and_its_days_are_there_once(spark, sources, ran, part):
    again = full_run.run_all(spark, dataclasses.replace(sources, **part))
    assert contents(spark, again) == ran[1]


def test_a_month_that_is_empty_now_is_emptied(spark, sources, tmp_path):
    run = dataclasses.replace(sources, weather=f"{tmp_path}/weather", out=f"{tmp_path}/out", target_sizes=(500,))
    fact = readers.read_tree(spark, sources.weather)
    sinks.write_months(fact, run.weather, "all")
    before = contents(spark, full_run.run_all(spark, run))
    sinks.write_months(fact.where("month <> '1996-04' AND date <> '1996-03-05'"), run.weather, "all")
    full_run.run_all(spark, dataclasses.replace(run, months=["1996-04"]))
    out = full_run.run_all(spark, dataclasses.replace(run, start="1996-03-05", end="1996-03-05"))
    left = spark.read.parquet(out["final_feature_daily"].path)
    assert left.where("month = '1996-04' OR date = '1996-03-05'").isEmpty()
    assert left.count() == spark.read.parquet(sources.weather).where("month <> '1996-04' AND date <> '1996-03-05'").count()
    assert set(map(str, before["feat_forest_static"])) == set(map(str, contents(spark, out)["feat_forest_static"]))


def test_stage_shuffles_the_fact_once(spark, sources):
    fact, master = readers.read_tree(spark, sources.weather), spark.read.parquet(sources.master)
    parts = static.forest(master), static.terrain_cells(master, sources.full_weight, sources.half_weight), static.exposure(master)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for few in (True, False):
            plan = full_run.stage_of(fact, *parts, sources, few)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("weather]") == 1 and ("SortMergeJoin [grid_id" in plan) != few
            above = plan[: plan.index("weather]")].rsplit("Window", 1)[1]
            assert above.count("Exchange") == 1, above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_stored_fact_needs_no_exchange(spark, sources, ran, tmp_path):
    fact, master = readers.read_tree(spark, sources.weather), spark.read.parquet(sources.master)
    parts = static.forest(master), static.terrain_cells(master, sources.full_weight, sources.half_weight), static.exposure(master)
    sinks.replace_fact(fact, "gridrisk_fact_test", 4)
    sinks.replace_fact(weather.features(fact), "gridrisk_features_test", 4)
    try:
        stored = spark.table("gridrisk_fact_test")
        scan = "gridrisk_fact_test"
        for months in (None, ["1996-03"]):
            plan = weather.features(stored, months=months)._jdf.queryExecution().executedPlan().toString()
            assert scan in plan and "Exchange" not in plan and (months is None or "PartitionFilters: [month" in plan or "PartitionFilters: [((month" in plan)
        plan = full_run.stage_of(stored, *parts, sources, True)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index(scan)].rsplit("Window", 1)[1]
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        both = stored.hint("merge").join(spark.table("gridrisk_features_test").select("grid_id", "date", "dwi"), ["grid_id", "date"])
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == fact.count()
        run = dataclasses.replace(sources, weather="gridrisk_fact_test", fact_table=True, out=f"{tmp_path}/out", events=None)
        got = contents(spark, full_run.run_all(spark, run))
        assert all(got[n] == ran[1][n] for n in got)
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for name in ("gridrisk_fact_test", "gridrisk_features_test"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_static_duplicates_fan_out_in_indices_only(spark, sources, tmp_path):
    master = spark.read.parquet(sources.master)
    twice = master.unionByName(master.withColumn("pole_count", F.coalesce("pole_count", F.lit(0)) + 1).where("grid_id LIKE '10003%'"))
    sinks.write_parquet(twice, f"{tmp_path}/master")
    assert twice.count() > master.count()
    out = full_run.run_all(spark, dataclasses.replace(sources, master=f"{tmp_path}/master", out=f"{tmp_path}/out", events=None))
    days = readers.read_tree(spark, sources.weather).count()
    assert out["feat_weather_daily"].rows == out["feat_terrain_ywi_daily"].rows == days < out["feat_pffdri_daily"].rows == out["final_feature_daily"].rows


def test_repeated_days_are_counted_or_refused(spark, sources, tmp_path):
    fact = readers.read_tree(spark, sources.weather)
    sinks.write_months(fact.unionByName(fact.where("date = '1996-03-07'")), f"{tmp_path}/weather", "all")
    run = dataclasses.replace(sources, weather=f"{tmp_path}/weather", out=f"{tmp_path}/out", events=None)
    assert full_run.run_all(spark, run)["repeated"] == fact.where("date = '1996-03-07'").count() > 0
    with pytest.raises(Exception, match="two rows of a cell and date"):
        full_run.run_all(spark, dataclasses.replace(run, repeats="fail", out=f"{tmp_path}/other"))


def test_part_files_are_loaded_first(spark, sources, tmp_path, ran):
    fact = readers.read_tree(spark, sources.weather).drop("month")
    for k, part in enumerate(("date < '1996-04-01'", "date >= '1996-04-01'", "date < '1996-02-01'")):
        fact.where(part).coalesce(1).write.parquet(f"{tmp_path}/made/{k}")
        (tmp_path / "parts").mkdir(exist_ok=True)
        next((tmp_path / "made" / str(k)).glob("*.parquet")).rename(tmp_path / "parts" / f"part.{k}.parquet")
    run = dataclasses.replace(sources, parts=f"{tmp_path}/parts", most_part=1, weather=f"{tmp_path}/weather", out=f"{tmp_path}/out", events=None)
    got = contents(spark, full_run.run_all(spark, run))
    assert all(got[n] == ran[1][n] for n in got)


def test_one_month_reads_its_days_and_four_before(spark, sources):
    fact = readers.read_tree(spark, sources.weather)
    part = weather.features(fact, months=["1996-03"])
    assert rows(part) == rows(weather.features(fact).where("month = '1996-03'"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan and "1996-02" in plan


def test_chunks_see_no_earlier_month(spark, sources):
    run = dataclasses.replace(sources, chunk="month")
    fact, master = readers.read_tree(spark, run.weather), spark.read.parquet(run.master)
    one, all_ = (full_run.final_of(fact, master, r) for r in (run, sources))
    later = F.dayofmonth("date") > 4
    assert rows(one.where(later)) == rows(all_.where(later)) and rows(one) != rows(all_)
    year = weather.features(fact, months=["1996-03", "1996-04"], chunk="year")
    assert rows(year) == rows(weather.features(fact.where("month IN ('1996-03', '1996-04')")))
    named = fact.withColumn("grid_id", F.concat(F.lit("a@"), "grid_id"))
    assert weather.features_by_chunk(named).where("grid_id NOT LIKE 'a@%\\_%'").isEmpty()


def test_windows(spark, sources):
    run = dataclasses.replace(sources, start="1996-03-10", end="1996-04-02")
    fact, master = readers.read_tree(spark, run.weather), spark.read.parquet(run.master)
    whole = full_run.final_of(fact, master, sources).where("date BETWEEN '1996-03-10' AND '1996-04-02'")
    assert rows(full_run.final_of(fact, master, run)) == rows(whole)


@pytest.mark.parametrize(("encoding", "codec"), [("utf-8-sig", "utf-8-sig"), ("cp949", "cp949"), ("euc-kr", "euc-kr")])
def test_event_encodings(spark, tmp_path, encoding, codec):
    text = "objt_id,adres\n1,강원도 원주시\n2,\"강원, 춘천\"\n"
    (tmp_path / "events.csv").write_bytes(text.encode(codec))
    got = readers.read_events_csv(spark, str(tmp_path / "events.csv")).collect()
    assert [tuple(r) for r in got] == [("1", "강원도 원주시"), ("2", "강원, 춘천")]


def test_each_file_has_its_own_encoding(spark, tmp_path):
    texts = {"utf-8-sig": "objt_id,adres\n1,강원도 원주시\n", "cp949": 'objt_id,adres,resn\n2,"강원\n춘천 ""뷁""",담배\n', "euc-kr": "objt_id,adres\n3,강원 강릉\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode(name))
    got = sorted(tuple(r) for r in readers.read_events_csv(spark, str(tmp_path)).select("objt_id", "adres", "resn").collect())
    assert got == [("1", "강원도 원주시", None), ("2", '강원\n춘천 "뷁"', "담배"), ("3", "강원 강릉", None)]


def test_tables_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.replace_table(df, "gridrisk_sink_test")
    sinks.append_table(df.where("k = 2"), "gridrisk_sink_test")
    assert rows(readers.read_source(spark, "gridrisk_sink_test")) == rows(df.unionByName(df.where("k = 2")))
    sinks.replace_table(df, "gridrisk_sink_test")
    assert readers.read_source(spark, "gridrisk_sink_test").count() == 2
    spark.sql("DROP TABLE gridrisk_sink_test")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["k", "v"]


@pytest.mark.parametrize(("codec", "level"), [("zstd", 6), ("gzip", 9), ("snappy", None), ("snappy", 6), ("lz4", 3)])
def test_codecs(spark, tmp_path, codec, level):
    df = spark.range(100)
    sinks.write_parquet(df, str(tmp_path / codec), codec, level)
    assert rows(readers.read_source(spark, "", str(tmp_path / codec))) == rows(df)
    assert any(codec in f for f in map(str, (tmp_path / codec).iterdir()))
    assert sinks.write_parquet(df.limit(0), str(tmp_path / "none"), codec, level).rows == 0


def test_append_adds_rows_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-03")], "v int, month string")
    for _ in range(2):
        sinks.write_months(df, str(tmp_path / "m"), "append")
    assert readers.read_tree(spark, str(tmp_path / "m")).count() == 2


def test_many_cells_are_a_join(spark):
    df = fx.weather(spark, SF)
    few = [r.grid_id for r in df.select("grid_id").distinct().orderBy("grid_id").limit(3).collect()]
    long = few + [f"x{k}" for k in range(readers.MOST_LISTED)]
    got, want = (readers.weather(df, cells=cells, columns=["grid_id", "date"]) for cells in (long, few))
    assert rows(got) == rows(want)
    assert "Join" in got._jdf.queryExecution().executedPlan().toString()


def test_whole_numbers_round_as_a_database_does(spark):
    from gridrisk.functions import exprs as E

    texts = spark.createDataFrame([("2.5",), ("0.5",), ("-2.5",), ("x",), (None,)], "v string").select(E.whole("v").alias("v"))
    numbers = spark.createDataFrame([(2.5,), (0.5,), (-2.5,), (3.5,)], "v double").select(E.whole("v").alias("v"))
    assert [r.v for r in texts.collect()] == [3, 1, -3, None, None] and [r.v for r in numbers.collect()] == [2, 0, -2, 4]
    decimals = spark.sql("SELECT CAST(v AS DECIMAL(12, 2)) AS v FROM VALUES (2.5), (0.5), (-2.5), (3.49), (NULL) t(v)").select(E.whole("v").alias("v"))
    assert [r.v for r in decimals.collect()] == [3, 1, -3, 3, None]


def test_static_features_once_per_cell(spark):
    master = fx.master_grid(spark, SF)
    cells = static.terrain_cells(master, fx.FULL_WEIGHT, fx.HALF_WEIGHT)
    assert cells.count() == master.select("grid_id").distinct().count() < master.count()


def test_a_month_may_come_in_several_batches(spark, tmp_path):
    from gridrisk.streaming.months import ingest_months

    days = fx.weather(spark, SF).where("month BETWEEN '1996-02' AND '1996-04'")
    for k, part in enumerate(("date < '1996-03-15'", "date >= '1996-03-15'")):
        days.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(days.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        build = lambda rows, months: weather.features(rows, months=months)
        ingest_months(stream, build, f"{tmp_path}/raw", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out").withColumn("month", F.col("month").cast("string"))) == rows(weather.features(days))


def test_entry_without_the_optional_parts(monkeypatch):
    import sys

    import __spark_entry__ as entry

    every = set(entry.queries())
    monkeypatch.setitem(sys.modules, "gridrisk.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    left = set(entry.queries())
    assert left and not any(k.startswith("op") or k == "pipeline" for k in left) and left <= every and set(entry.oracle_sql()) == left
