"""Profiles of tables: quantiles, lift, correlation, categories, missing values, outliers, moments, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.functions import exprs as E
from gridrisk.operators import pairs


def numeric_columns(df: DataFrame, skip: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep, variable, value): one scan for any number of columns."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keep), columns, "variable", "value")


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with the other columns of b where the keys agree, nulls too."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(b, same).drop(*[f"__{k}" for k in keys])


#: Approximate quantiles are wrong by at most one of so many parts of a group's rows; brackets are three such parts wide
#: on either side.
ACCURACY = 10_000


def refined(rows: DataFrame, by: list[str], shares: list[float], few: bool = True, whole: dict[str, Column] | None = None, **sums: Column) -> DataFrame:
    """Per group and share p of its rows the values around the exact quantile, in two passes over rows, with columns p,
    value, n, ``below`` (rows of the group with less) and ``total`` (rows of the group), and each of the named sums, with
    ``below_`` and ``total_`` of it. Nulls are left out.

    The first pass brackets each quantile by approximate ones and totals the groups. The second counts each value within a
    bracket, and what lies on either side of it as one row: that row's value is the one next to the bracket. Tasks count
    before anything is sent, so all that goes through exchanges are sketches and the distinct values inside brackets, at
    most 6 in ACCURACY of a group's rows for each share; no task gets more than these. few: the groups are columns, or
    columns by a label, so their brackets are broadcast; other groups join by a shuffle. whole: further aggregates over a
    group's values, which every row of the group gets.
    """
    rows, after = rows.where("value IS NOT NULL"), {"n": "", **{name: f"_{name}" for name in sums}}  # behind below and total
    around = {p: (max(p - 3 / ACCURACY, 0.0), min(p + 3 / ACCURACY, 1.0)) for p in shares}
    edges = sorted({e for ends in around.values() for e in ends})
    counted = {"n": F.count("*"), **sums}
    over = {f"total{after[name]}": c for name, c in counted.items()} | (whole or {})
    groups = rows.groupBy(*by).agg(F.expr(f"percentile_approx(value, array({', '.join(f'{e!r}D' for e in edges)}), {ACCURACY}) AS edges"), *[c.alias(name) for name, c in over.items()])
    ends = ", ".join(f"named_struct('p', {p!r}D, 'low', edges[{edges.index(low)}], 'high', edges[{edges.index(high)}])" for p, (low, high) in around.items())
    brackets = groups.select(*by, *over, F.expr(f"inline(array({ends}))"))
    near = _beside(rows, F.broadcast(brackets) if few else brackets, by).withColumn("side", F.expr("CASE WHEN value < low THEN -1 WHEN value > high THEN 1 ELSE 0 END"))
    near = near.groupBy(*by, "p", "side", F.expr("CASE WHEN side = 0 THEN value END AS inside")).agg(
        F.expr("CASE WHEN side < 0 THEN max(value) ELSE min(value) END AS value"), *[c.alias(name) for name, c in counted.items()], *[F.max(name).alias(name) for name in over]
    )
    lower = ", ".join(f"`{k}`" for k in [*by, "p"])
    below = [F.expr(f"sum({name}) OVER (PARTITION BY {lower} ORDER BY value ROWS UNBOUNDED PRECEDING) - {name} AS below{x}") for name, x in after.items()]
    return near.select(*by, "p", "side", "value", *after, *over, *below)


def quantile_columns(shares: dict[str, float]) -> list[Column]:
    """Aggregates over ``refined`` rows of a group: exact quantiles, linear between neighbours, by name. The row of all
    values on one side of a bracket stands for the one next to it only."""

    def at(p: float, rank: str) -> str:
        sure = f"side = 0 OR (side < 0 AND {rank} = below + n - 1) OR (side > 0 AND {rank} = below)"
        return f"max(CASE WHEN p = {p!r}D AND below <= {rank} AND {rank} < below + n THEN CASE WHEN {sure} THEN value ELSE raise_error('a quantile lies outside its bracket') END END)"

    out = []
    for name, p in shares.items():
        rank = f"({p!r}D * (total - 1))"
        low, high, part = at(p, f"floor({rank})"), at(p, f"ceil({rank})"), f"max(CASE WHEN p = {p!r}D THEN {rank} - floor({rank}) END)"
        out.append(F.expr(f"{low} + ({high} - {low}) * {part}").alias(name))
    return out


def quantiles(rows: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """Per group and share ``p`` the exact quantile ``q`` of value."""
    named = {f"q{k}": p for k, p in enumerate(shares)}
    wide = refined(rows, by, shares).groupBy(*by).agg(*quantile_columns(named))
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(n).alias("q")) for n, p in named.items()])))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Per variable (and group, of few): n, mean, std, min, quartiles, max of the values present."""
    keys = ["variable", *by]
    spread = {"mean": F.avg("value"), "std": F.stddev_samp("value"), "min": F.min("value"), "max": F.max("value")}
    near = refined(long_form(df, columns, by), keys, [*QUARTILES.values()], whole=spread)
    return near.groupBy(*keys).agg(F.max("total").alias("n"), *[F.max(x).alias(x) for x in ("mean", "std", "min")], *quantile_columns(QUARTILES), F.max("max").alias("max"))


def captured(share: float) -> Column:
    """Aggregate over rows ``refined`` around 1 - share, with pos: the positives in the top share."""
    top = (F.col("total") - F.col("below")) / F.col("total")
    return F.coalesce(F.max(F.when((F.col("p") == 1 - share) & (top <= share), F.col("total_pos") - F.col("below_pos"))), F.lit(0))


def lift(df: DataFrame, columns: list[str], label: str = "fire_label", shares: tuple = (0.1, 0.2), counted: bool = False) -> DataFrame:
    """Share of positives in the top shares by score. A row is in the top p if the rows scored as high or higher are at
    most p of all. counted: also the rows that have a value, as row_count."""
    positive = F.col(label) == 1
    means = {"positive_mean": F.avg(F.when(positive, F.col("value"))), "negative_mean": F.avg(F.when(positive, None).otherwise(F.col("value")))}
    near = refined(long_form(df, columns, [label]), ["variable"], [1 - p for p in shares], whole=means, pos=F.count_if(positive))
    total = F.max("total_pos")
    out = [F.try_divide(captured(p), total).alias(f"top{int(p * 100)}_capture") for p in shares]
    rows = [F.max("total").alias("row_count")] if counted else []
    return near.groupBy("variable").agg(*rows, total.alias("positives"), *out, *[F.max(m).alias(m) for m in means])


#: Pearson of moments; only the ends tell for sure that a column does not vary: what rounding leaves of its variance grows
#: with the rows.
_R = "CASE WHEN x0 < x1 AND y0 < y1 AND xx > 0 AND yy > 0 THEN xy / (sqrt(xx) * sqrt(yy)) END"


def correlations(df: DataFrame, xs: list[str], ys: list[str] | None = None) -> DataFrame:
    """(x, y, r): Pearson of each of xs with each of ys, or without these of all pairs of xs, each once, x before y. A pair
    counts the rows where both are present; r is null where one does not vary there, or where a value is not finite.

    One pass: tasks add up the moments of all pairs by products of matrices and send a row per pair, whatever their number
    of rows. These rows are joined about the means of all tasks, so no difference of great sums is taken.
    """
    names = [*xs, *(y for y in ys or () if y not in xs)]
    right = xs if ys is None else ys
    # Taken through a function, the array is made by methods of its own: beside what makes its values, Java may find one too
    # long to compile.
    value = df.select(F.transform(F.array(*[F.col(c).cast("double") for c in names]), lambda v: v).alias("value"))
    tasks = value.mapInArrow(pairs.moments([names.index(x) for x in xs], [names.index(y) for y in right], ys is None), pairs.SCHEMA)
    pair = Window.partitionBy("i", "j")
    base = lambda c: F.min(F.when(F.col("n") > 0, F.col(f"base_{c}"))).over(pair)
    tasks = tasks.withColumns({c: F.col(c) + (F.col(f"base_{c}") - base(c)) for c in ("x", "y")})
    off = {f"d{c}": F.col(c) - F.try_divide(F.sum(F.col("n") * F.col(c)).over(pair), F.sum("n").over(pair)) for c in ("x", "y")}
    about = {a + b: F.sum(F.col(a + b) + F.col("n") * F.col(f"d{a}") * F.col(f"d{b}")) for a, b in ("xx", "yy", "xy")}
    ends = {"x0": F.min("x0"), "x1": F.max("x1"), "y0": F.min("y0"), "y1": F.max("y1")}
    out = tasks.withColumns(off).groupBy("i", "j").agg(*[a.alias(c) for c, a in (about | ends).items()])
    listed = lambda side: F.array(*[F.lit(c) for c in side])
    r = F.expr(_R)
    return out.select(F.get(listed(xs), F.col("i")).alias("x"), F.get(listed(right), F.col("j")).alias("y"), F.when(F.abs(r) < float("inf"), r).alias("r"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    half = correlations(df, columns)
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y"))).otherwise(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return half.select("r", F.inline(both)).select("x", "y", "r")


def strong_pairs(df: DataFrame, columns: list[str], least: float = 0.3) -> DataFrame:
    return correlations(df, columns).where((F.col("x") != F.col("y")) & (F.abs("r") >= least))


def categories(df: DataFrame, column: str, scores: list[str], label: str = "fire_label", top: int = 20) -> DataFrame:
    out = df.groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("row_count"), F.count_if(F.col(label) == 1).alias("positive_count"), *[F.avg(s).alias(f"avg_{s}") for s in scores])
    out = out.withColumn("positive_rate", F.col("positive_count") / F.col("row_count"))
    return out.orderBy(F.desc("positive_count"), F.desc("positive_rate"), F.desc("row_count"), "category").limit(top)


def missing(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.isnull(c)).alias(c) for c in df.columns], F.count("*").alias("__n"))
    out = counts.unpivot(["__n"], df.columns, "variable", "missing").where("missing > 0")
    return out.select("variable", "missing", (100.0 * F.col("missing") / F.col("__n")).alias("missing_pct"))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fences at 1.5 IQR; the ratio is over all rows, nulls included."""
    rows = long_form(df, columns)
    q = refined(rows, ["variable"], [0.25, 0.75]).groupBy("variable").agg(*quantile_columns({"q1": 0.25, "q3": 0.75}))
    q = q.withColumns({"iqr": F.col("q3") - F.col("q1")}).withColumns({"lower": F.col("q1") - 1.5 * F.col("iqr"), "upper": F.col("q3") + 1.5 * F.col("iqr")})
    fences, outside = ("q1", "q3", "iqr", "lower", "upper"), (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    # One row per column: the fences are small by construction.
    out = rows.join(F.broadcast(q), "variable", "left").groupBy("variable").agg(*[F.max(c).alias(c) for c in fences], F.count_if(outside).alias("outliers"), F.count("*").alias("rows"))
    return out.withColumn("outlier_pct", 100.0 * F.col("outliers") / F.col("rows")).drop("rows")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    whole, part = F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in key])
    return df.agg((F.count("*") - F.count_distinct(whole)).alias("duplicate_rows"), (F.count("*") - F.count_distinct(part)).alias("duplicate_keys"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, biased skewness, excess kurtosis, and a word for the skew."""
    shape = {"mean": F.avg("value"), "skew": F.skewness("value"), "kurt": F.kurtosis("value")}
    out = refined(long_form(df, columns), ["variable"], [0.5], whole=shape).groupBy("variable")
    out = out.agg(F.max("mean").alias("mean"), *quantile_columns({"median": 0.5}), F.max("skew").alias("skew"), F.max("kurt").alias("kurt"))
    return out.withColumn("shape", E.cases([(F.col("skew") > 0.5, "right"), (F.col("skew") < -0.5, "left")], "symmetric"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal widths over [min, max]; the last bin is closed."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    lo, hi = x.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return x.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    place = F.least(F.width_bucket("x", F.lit(lo), F.lit(hi), F.lit(bins)).cast("int"), F.lit(bins)) if hi > lo else F.lit(1)
    return x.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def shares(df: DataFrame, column: str) -> DataFrame:
    out = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("category", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, the last values inside 1.5 IQR, and the count outside, per group."""
    rows = df.select(F.col(by).alias("grp"), F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    q = refined(rows, ["grp"], [*QUARTILES.values()], few=False).groupBy("grp").agg(*quantile_columns(QUARTILES))
    q = q.withColumns({"lo": F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), "hi": F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))})
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    return rows.join(q, "grp").groupBy("grp", "q25", "q50", "q75").agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def dry_streak(daily: DataFrame, rain: str = "rn_day_mean", limit: float = 1.0, *, reset_at_gaps: bool = False, days: int = 1024) -> DataFrame:
    """``streak``: consecutive rows with less rain than limit up to each row, by ``grid_id`` and ``date``; a missing value
    ends a streak, and with reset_at_gaps a missing day does.

    A series is cut into ranges of so many days, which are counted apart; what a range carries into the next comes from one
    row per range. So tasks follow the rows, not the series, however long one is."""
    row, wet = Window.partitionBy("grid_id", "range").orderBy("date"), F.when(F.col(rain) < limit, 0).otherwise(1)
    df = daily.withColumns({"range": F.floor(F.unix_date("date") / days), "wet": wet})
    missed = F.datediff("date", F.lag("date").over(row)) > 1 if reset_at_gaps else F.lit(False)
    df = df.withColumn("break", F.when((F.col("wet") == 1) | missed, 1).otherwise(0)).withColumn("island", F.sum("break").over(row))
    island = Window.partitionBy("grid_id", "range", "island").orderBy("date")
    df = df.withColumn("streak", F.sum(1 - F.col("wet")).over(island))
    ranges = df.groupBy("grid_id", "range").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("streak", "date").alias("tail"), (F.max("island") > 0).alias("broken"))
    # A row per range: the carry of a range is the last broken range's tail and the rows of the whole ranges since.
    before = Window.partitionBy("grid_id").orderBy("range")
    follows = F.datediff("first", F.lag("last").over(before)) == 1 if reset_at_gaps else F.lag("last").over(before).isNotNull()
    after = F.lag("broken").over(before)
    step = F.when(F.coalesce(follows, F.lit(False)), F.when(after, F.lag("tail").over(before)).otherwise(F.lag("n").over(before))).otherwise(0)
    ranges = ranges.withColumns({"step": step, "new": F.when(F.coalesce(follows & ~after, F.lit(False)), 0).otherwise(1)}).withColumn("chain", F.sum("new").over(before))
    carry = ranges.select("grid_id", "range", F.sum("step").over(Window.partitionBy("grid_id", "chain").orderBy("range")).alias("carry"))
    out = _beside(df, carry, ["grid_id", "range"])
    return out.withColumn("streak", F.col("streak") + F.when(F.col("island") == 0, F.col("carry")).otherwise(0)).drop("range", "wet", "break", "island", "carry")


def binned_rate(df: DataFrame, bin_: Column, label: str) -> DataFrame:
    out = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("row_count"), F.sum(label).alias("positive_count"))
    return out.withColumn("rate_pct", 100.0 * F.col("positive_count") / F.col("row_count"))


def top_and_rest(df: DataFrame, column: str, top: int = 8, rest: str = "rest") -> DataFrame:
    """The top categories by count; all others together. Counts are few, so ranking them needs no sort of rows."""
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "category").limit(top)
    others = counts.join(best.select("category"), "category", "left_anti").agg(F.lit(rest).alias("category"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return best.unionByName(others)
