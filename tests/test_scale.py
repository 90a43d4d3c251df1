"""What keeps the daily queries within their time on larger tables."""

import io
import re
from contextlib import redirect_stdout

import duckdb
import __spark_entry__ as entry
from pyspark.sql import functions as F

from gridrisk.operators import sample
from gridrisk.plans import fixtures as fx
from gridrisk.plans import queries as Q

SF = "/root/testdata/sf0.001"


def _plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_rounds_as_sql(spark):
    values = [k + 0.0000005 for k in range(200)] + [-0.0000005, -0.0, 0.1 + 0.2, 2.0**-7, -(2.0**-7), 123456.7890125, 5e8 + 0.1234565, 3e15, -7e300, 1e-300]
    got = [r.v for r in Q.rounded(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0", [v]).fetchone()[0] for v in values]
    odd = Q.rounded(spark.createDataFrame([(None, 1), (float("inf"), 2), (float("nan"), 3)], "v double, k int")).orderBy("k").collect()
    assert odd[0].v is None and odd[1].v == float("inf") and odd[2].v != odd[2].v


def test_methods_short_enough_to_compile(spark):
    """Java leaves methods of more than 8,000 bytes to its interpreter."""
    text, before = io.StringIO(), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with redirect_stdout(text):
            entry.queries()["final_in_one_pass"](spark, SF).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue()))) < 8000


def test_final_dataset_joins_days_once(spark):
    plan = _plan(entry.queries()["final_dataset"](spark, SF))
    assert len(re.findall(r"Join \[grid_id#\d+, date#\d+\]", plan)) == 1


def test_reports_read_a_stored_sample(spark):
    for name in ("rankings", "sample_feature_summary"):
        assert "lineitem" not in _plan(entry.queries()[name](spark, SF))


def test_sample_sends_rows_of_event_cells_only(spark):
    final, target = Q._final(spark, SF).select("grid_id", "date", "ffdri"), Q._target(spark, SF, 500)
    out = sample.labelled(final, target, ratio=2, keys=fx.weather(spark, SF))
    assert "__near" in out._jdf.queryExecution().optimizedPlan().toString()
    # A cell and date with two targets counts twice, as its rows do.
    days = final.select("grid_id", "date").limit(40).localCheckpoint()
    twice = days.limit(3).localCheckpoint().crossJoin(spark.range(2)).select("date", "grid_id", F.lit(1).alias("fire_label"), F.lit(1).cast("long").alias("fire_count"))
    assert sample.labelled(days, twice, ratio=1000).count() == 43
