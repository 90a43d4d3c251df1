"""Quantiles, lift and correlations against numpy and pandas, and reports as files."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridrisk.operators import profile, reports, risk, sample
from gridrisk.sources import sinks

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def values(spark):
    """Columns of many kinds: ties, one value, few rows, heavy tails."""
    n = 3000
    df = pd.DataFrame({
        "normal": RNG.normal(size=n), "ties": RNG.integers(0, 3, n) * 1.0, "one": 5.0, "tail": RNG.pareto(0.5, n), "rare": np.where(np.arange(n) % 700 == 0, RNG.normal(size=n), np.nan),
        "none": np.nan, "signed": RNG.integers(-2, 2, n) * 0.1,
    })
    df["label"] = (RNG.random(n) < 0.1 + 0.2 * (df["normal"] > 1)).astype(int)
    return df, spark.createDataFrame(df.replace({np.nan: None}).astype(object).where(df.notna(), None), ", ".join(f"{c} {'int' if c == 'label' else 'double'}" for c in df)).repartition(7)


COLUMNS = ["normal", "ties", "one", "tail", "rare", "none", "signed"]


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_are_exact_whatever_the_sketch(values, monkeypatch, accuracy):
    monkeypatch.setattr(profile, "ACCURACY", accuracy)
    plain, df = values
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {(r.variable, r.p): r.q for r in profile.quantiles(profile.long_form(df, COLUMNS), ["variable"], shares).collect()}
    want = {(c, p): plain[c].quantile(p) for c in COLUMNS for p in shares if c != "none"}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1e-12 * max(1, abs(want[k])) for k in want)


def test_quantiles_of_few_rows(spark):
    rows = [(str(n), float(k * k)) for n in range(1, 13) for k in range(n)]
    df = spark.createDataFrame(rows, "variable string, value double")
    shares = [0.1, 0.25, 1 / 3, 0.5, 0.75, 0.95]
    got = {(r.variable, r.p): r.q for r in profile.quantiles(df, ["variable"], shares).collect()}
    assert all(abs(got[str(n), p] - np.quantile([k * k for k in range(n)], p)) < 1e-9 for n in range(1, 13) for p in shares)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_lift_and_hit_rates(values, monkeypatch, accuracy):
    monkeypatch.setattr(profile, "ACCURACY", accuracy)
    plain, df = values
    got = {r.variable: r for r in profile.lift(df, COLUMNS, "label", counted=True).collect()}
    for c in COLUMNS:
        some = plain[plain[c].notna()]
        if c == "none":
            assert c not in got
            continue
        cume = some[c].rank(method="max", ascending=False) / len(some)
        for p, share in ((0.1, got[c].top10_capture), (0.2, got[c].top20_capture)):
            assert share == ((cume <= p) & (some["label"] == 1)).sum() / (some["label"] == 1).sum() if (some["label"] == 1).any() else share is None
        assert (got[c].row_count, got[c].positives) == (len(some), (some["label"] == 1).sum())
    rates = {r.share: r.hit_rate for r in risk.top_hit_rate(df, "normal", "label", (0.05, 0.3)).collect()}
    cume = plain["normal"].rank(method="max", ascending=False) / len(plain)
    assert all(abs(v - ((cume <= k) & (plain["label"] == 1)).sum() / plain["label"].sum()) < 1e-12 for k, v in rates.items())


def test_only_brackets_go_through_exchanges(spark, values):
    """Of 3,000 distinct values an exchange gets those of a bracket, and no exchange gets the rows themselves."""
    near = profile.refined(profile.long_form(values[1], ["normal"]), ["variable"], [0.5])
    assert near.count() < 60
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_describe_and_outliers(values):
    plain, df = values
    got = {r.variable: r for r in profile.describe(df, COLUMNS).collect()}
    for c in set(COLUMNS) - {"none"}:
        want = plain[c].describe()
        assert np.allclose([got[c][x] for x in ("n", "mean", "std", "min", "q25", "q50", "q75", "max")], want.to_numpy(), equal_nan=True)
    out = {r.variable: r for r in profile.iqr_outliers(df, COLUMNS).collect()}
    q1, q3 = plain["tail"].quantile([0.25, 0.75])
    assert out["tail"].outliers == ((plain["tail"] < q1 - 1.5 * (q3 - q1)) | (plain["tail"] > q3 + 1.5 * (q3 - q1))).sum() and out["none"].outliers == 0 and out["none"].q1 is None


@pytest.mark.parametrize("n_columns", [1, 4, 9, 45])
def test_correlations_of_many_columns(spark, n_columns):
    n = 400
    plain = pd.DataFrame({f"c{k}": RNG.normal(1e6 if k == 1 else 0, 1 + k, n) for k in range(n_columns)})
    for k in range(0, n_columns, 3):
        plain.loc[RNG.random(n) < 0.2, f"c{k}"] = np.nan
    if n_columns > 4:
        plain["c3"], plain["c4"] = 7.1, plain["c2"] * -2 + 1
    df = spark.createDataFrame(plain.astype(object).where(plain.notna(), None), ", ".join(f"{c} double" for c in plain))
    want = plain.corr()
    got = {(r.x, r.y): r.r for r in profile.correlation_matrix(df, list(plain)).collect()}
    assert len(got) == n_columns**2
    for (x, y), r in got.items():
        assert (r is None) if np.isnan(want.loc[x, y]) else abs(r - want.loc[x, y]) < 1e-9, (x, y, r, want.loc[x, y])
    plan = profile.correlations(df, list(plain))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 2 and plan.count("Exchange SinglePartition") <= 1
    pairs = profile.correlations(df, list(plain)[:2], ["c0"]).collect()
    assert sorted((r.x, r.y) for r in pairs) == sorted({(x, "c0") for x in list(plain)[:2]})


def test_tiles_are_code_generated(values):
    df = profile.correlations(values[1], COLUMNS)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sums = [line for line in text.splitlines() if "HashAggregate(keys=[i#" in line]
    assert sums and all("*(" in line for line in sums), sums


@pytest.mark.parametrize("reset", [False, True])
@pytest.mark.parametrize("days", [1, 3, 7, 1024])
def test_streaks_cut_at_ranges_equal_a_loop(spark, reset, days):
    rng, rows = np.random.default_rng(days), []
    for cell in "abcd":
        at, wet = 9000, {"a": 0.0, "b": 0.05, "c": 0.3, "d": 0.9}[cell]
        for _ in range(60):
            at += 1 if rng.random() < 0.9 else int(rng.integers(2, 9))
            rows.append((cell, at, None if rng.random() < 0.02 else float(5 * (rng.random() < wet))))
    df = spark.createDataFrame(rows, "grid_id string, day int, rn_day_mean double").withColumn("date", F.date_from_unix_date("day")).repartition(5)
    got = {(r.grid_id, r.day): r.streak for r in profile.dry_streak(df, reset_at_gaps=reset, days=days).collect()}
    last, streak = None, 0
    for cell, at, rain in rows:
        if last is None or last[0] != cell or (reset and at - last[1] > 1):
            streak = 0
        streak = streak + 1 if rain is not None and rain < 1 else 0
        assert got[cell, at] == streak, (cell, at)
        last = cell, at
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def reported(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("report")
    n = 2500
    days = pd.DataFrame({"grid_id": [f"{k % 50}_1" for k in range(n)], "day": [k // 50 for k in range(n)], "pffdri": RNG.normal(50, 9, n).round(3), "ffdri": RNG.normal(40, 9, n), "dwi": RNG.integers(0, 5, n) * 1.0, "fmi": 2.5})
    final = spark.createDataFrame(days).withColumn("date", F.date_add(F.lit("1996-02-01").cast("date"), F.col("day").cast("int"))).drop("day").withColumn("month", F.date_format("date", "yyyy-MM"))
    sinks.write_months(final, f"{base}/final", "all")
    fires = final.where("pmod(hash(grid_id, date), 40) = 0").select("date", "grid_id", "month", F.lit("t").alias("target_grid_id"), F.lit(1).alias("fire_label"), F.lit(2).cast("long").alias("fire_count"))
    sinks.write_months(fires, f"{base}/target", "all")
    report = reports.Report(f"{base}/final", {"1km": f"{base}/target"}, f"{base}/out", ratio=5, columns=3, top=7)
    return report, reports.run_reports(spark, report), final, fires


def csv(paths, name):
    from pathlib import Path

    files = list(Path(paths[name]).glob("*.csv"))
    assert len(files) == 1, name
    return pd.read_csv(files[0])


def test_reports(spark, reported):
    report, paths, final, fires = reported
    rows = spark.read.parquet(paths["eda_sample_1km"])
    want = sample.labelled(final, fires.drop("month"), 5, report.most, report.seed)
    assert sorted(map(str, rows.select(sorted(rows.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))
    plain = rows.toPandas()
    assert spark.read.parquet(paths["eda_positive_1km"]).count() == (plain.fire_label == 1).sum() == fires.count() > 20
    counts = csv(paths, "eda_label_counts_1km")
    assert counts.fire_label.tolist() == [1, 0] and counts.row_count.tolist() == [(plain.fire_label == k).sum() for k in (1, 0)]
    months = csv(paths, "eda_monthly_counts_1km")
    assert list(zip(months.month, months.fire_label, strict=True)) == sorted(zip(months.month, months.fire_label, strict=True), key=lambda x: (x[0], -x[1]))
    summary = csv(paths, "feature_summary_1km")
    assert list(zip(summary.variable, summary.fire_label, strict=True)) == list(itertools.product(["pffdri", "ffdri", "dwi", "fmi"], (1, 0)))
    assert np.isclose(summary["median"][0], plain[plain.fire_label == 1].pffdri.median()) and list(summary)[2:] == ["row_count", "mean", "std", "min", "q25", "median", "q75", "max"]
    r = csv(paths, "pearson_fire_label_1km")
    label = plain[["pffdri", "ffdri", "dwi"]].corrwith(plain.fire_label)
    assert r.variable.tolist() == [*label.abs().sort_values(ascending=False).index, "fmi"] and np.isnan(r.pearson_corr_fire_label.iloc[-1])
    matrix = csv(paths, "feature_corr_matrix_1km").set_index("variable")
    assert list(matrix) == matrix.index.tolist() == r.variable.tolist()[:3] and np.allclose(matrix, plain[list(matrix)].corr())
    assert csv(paths, "lift_summary_1km").variable.tolist() == ["pffdri", "ffdri", "dwi", "fmi"]
    top = csv(paths, "grid_summary_1km")
    order = plain.groupby("grid_id").fire_label.agg(["sum", "mean", "size"]).sort_values(["sum", "mean", "size"], ascending=False)
    assert len(top) == 7 and top[["positive_rows", "row_count"]].to_numpy().tolist() == order[["sum", "size"]].head(7).to_numpy().tolist()
    assert len(paths) == 12 and {"rankings_1km", "label_counts_1km", "month_summary_1km"} <= set(paths)


def test_reports_replace_earlier_ones_and_refuse_an_empty_window(spark, reported):
    report, paths, *_ = reported
    again = reports.run_reports(spark, report)
    assert again == paths and len(csv(paths, "label_counts_1km")) == 2
    import dataclasses

    with pytest.raises(ValueError, match="no rows"):
        reports.run_reports(spark, dataclasses.replace(report, start="2001-01-01"))


def test_constant_over_many_rows(spark):
    """One column is constant where the other is present, over so many rows that rounding adds up."""
    def r(third):
        rows = spark.range(0, 3_000_000, 1, 3).selectExpr(f"CASE WHEN id % {third} = 0 THEN 0 WHEN id % 31 = 5 THEN NULL ELSE 1 END AS flag", f"CASE WHEN id % {third} != 0 THEN id % 5 END AS code")
        return [x.r for x in profile.correlations(rows, ["flag"], ["code"]).collect()]

    assert [r(k) for k in range(3, 9)] == [[None]] * 6


def test_correlations_read_rows_once(spark):
    """No row is repeated for pairs of columns, whatever their number: tasks send their moments of each pair only."""
    rows, names = spark.range(0, 30_000, 1, 3), [f"c{k}" for k in range(42)]
    df = rows.select(*[(F.xxhash64(F.lit(k), "id") % 1000).alias(c) for k, c in enumerate(names)])
    out = profile.correlations(df, names)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Range (") == 1 and "Generate" not in plan, plan
    assert out.count() == 42 * 43 // 2


def test_correlation_matrix_of_final_is_compiled(spark):
    """Java leaves methods of more than 8,000 bytes to its interpreter; joins that become broadcasts make longer ones."""
    import contextlib
    import io
    import re

    from gridrisk.plans import queries as Q

    df, text = profile.correlations(Q._final(spark, "/root/testdata/sf0.001"), Q.FINAL_NUMBERS), io.StringIO()
    df.collect()
    with contextlib.redirect_stdout(text):
        df.explain("codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue()))) < 8000


def test_correlations_of_uneven_tasks(spark):
    """Tasks of several batches whose means lie far apart, values that are seen to vary in one row only, pairs that are
    never both present, and values that are not finite where the other column is absent or present."""
    n = 9000
    at = np.arange(n)
    plain = pd.DataFrame({
        "far": 1e9 + np.where(at < 6000, 0.0, 1e3) + RNG.normal(size=n), "late": np.where(at == 1777, 1.0, 0.0), "same": 0.1, "first": np.where(at < 3000, at, np.nan),
        "last": np.where(at >= 6000, RNG.normal(size=n), np.nan), "level": np.where(at < 3000, 2.5, RNG.normal(size=n)), "odd": RNG.normal(size=n),
    })
    plain["near"] = plain["far"] + RNG.normal(size=n)
    plain.loc[7000, "odd"] = np.inf
    columns = ", ".join(f"{c} double" for c in plain)
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in plain.itertuples(index=False)], columns).coalesce(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {(r.x, r.y): r.r for r in profile.correlations(df, list(plain)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 36
    for (x, y), r in got.items():
        both = plain[[x, y]].dropna() if x != y else plain[[x]].dropna().assign(again=lambda d: d[x])  # noqa: B023
        a, b = (both.iloc[:, k].to_numpy() for k in (0, 1))
        if len(a) == 0 or not np.isfinite(both.to_numpy()).all() or a.min() == a.max() or b.min() == b.max():
            assert r is None, (x, y, r)
        else:
            assert abs(r - np.corrcoef(a, b)[0, 1]) < 1e-9, (x, y, r)
    assert got["first", "odd"] is not None and got["last", "odd"] is None and got["first", "level"] is None and got["late", "level"] is not None


def test_moments_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from gridrisk.operators import pairs

    sent = cloudpickle.dumps(pairs.moments([0, 1], [0, 1], True))
    code = "import pickle, sys, pyarrow as pa; task = pickle.load(sys.stdin.buffer); b = pa.record_batch([pa.array([[1.0, 2.0], [2.0, 5.0]])], ['value']); print(next(task(iter([b]))).num_rows, 'gridrisk' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd=tmp_path, env=env)
    assert out.stdout.split() == [b"3", b"False"], out.stderr
