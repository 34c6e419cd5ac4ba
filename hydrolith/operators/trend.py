"""Trends, counts and statistics of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S

DAYS_A_YEAR = 365.25


def years(date: Column) -> Column:
    """Years since 1970 of 365.25 days."""
    return F.unix_date(date) / F.lit(DAYS_A_YEAR)


def line_fit(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Least-squares slope and intercept of each key, null for fewer than two rows or one x [A08, A09].

    x is taken about its mean, found in the same pass over partial sums, so that large x costs no digits.
    """
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("sxy"), F.var_pop(x).alias("sxx"), F.min(x).alias("x0"), F.max(x).alias("x1")
    )
    slope = F.when((F.col("n") >= 2) & (F.col("sxx") > 0), F.col("sxy") / F.col("sxx"))
    return sums.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).select(*keys, "n", "slope", "intercept", "x0", "x1")


def well_trends(measurements: DataFrame, keys: list[str], now: str | None = None, window_years: int | None = None) -> DataFrame:
    """Yearly slope of each well, from the years before ``now`` if asked [A08, A12]."""
    if window_years is not None:
        measurements = measurements.where(F.col("obs_date") >= F.add_months(F.lit(now).cast("date"), -12 * window_years))
    return line_fit(measurements, keys, years(F.col("obs_date")), F.col("value"))


def aquifer_trends(trends: DataFrame, keys: list[str], extreme: float = 1.0, moderate: float = 0.25) -> DataFrame:
    """Median slope of the wells of each aquifer, and its class [A10, A11]."""
    grouped = trends.groupBy(*keys).agg(F.median("slope").alias("slope"), F.count("slope").alias("n_wells"))
    return grouped.withColumn("trend", S.trend_class(F.col("slope"), extreme, moderate))


def months_with_data(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct months of each key [A03]."""
    return df.groupBy(*keys).agg(F.countDistinct(F.date_format("obs_date", "yyyy-MM")).alias("n_months"))


def qualified(df: DataFrame, keys: list[str], least: int, span_years: float) -> DataFrame:
    """Keys with rows and span, and whether both suffice: two rows at least [A04]."""
    grouped = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.datediff(F.max("obs_date"), F.min("obs_date")) / DAYS_A_YEAR).alias("span"))
    return grouped.withColumn("qualified", (F.col("n") >= max(2, least)) & (F.col("span") >= span_years))


def density(df: DataFrame, key: str, start: str, bins: int) -> DataFrame:
    """Distinct keys with data in each half year from start on, those without none as 0 [A05]."""
    spark = df.sparkSession
    calendar = spark.range(bins).select(F.col("id").cast("int").alias("bin"), F.add_months(F.lit(start).cast("date"), (6 * F.col("id")).cast("int")).alias("bin_start"))
    months = F.months_between(F.trunc("obs_date", "month"), F.trunc(F.lit(start).cast("date"), "month"))
    counts = df.withColumn("bin", F.floor(months / 6).cast("int")).groupBy("bin").agg(F.countDistinct(key).alias("n"))
    return calendar.join(counts, "bin", "left").select("bin", "bin_start", F.coalesce("n", F.lit(0)).alias("n_wells"))


def default_range(df: DataFrame, key: str, least: int = 10, share: float = 0.05) -> DataFrame:
    """First and last year whose first day lies in the span of enough wells [A06]."""
    first_last = df.groupBy(key).agg(F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi"))
    first_year = F.year("lo") + F.when(F.col("lo") > F.trunc("lo", "year"), 1).otherwise(0)
    spanned = first_last.withColumn("y0", first_year).where(F.col("y0") <= F.year("hi")).select(F.explode(F.sequence("y0", F.year("hi"))).alias("year"))
    counts = spanned.groupBy("year").agg(F.count("*").alias("n"))
    limit = first_last.agg(F.greatest(F.lit(least), F.ceil(F.count("*") * share)).alias("need"))
    return counts.crossJoin(F.broadcast(limit)).where("n >= need").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def frame_statistics(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, extremes, mean, population deviation and quartiles to two digits; zeros where there are no values [A13]."""
    v = F.col(value)
    p = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    grouped = df.groupBy(*keys).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), p.alias("__p"))
    named = {"min": "min", "max": "max", "mean": "mean", "std": "std"}
    out = [S.js_round(F.coalesce(F.col(c), F.lit(0.0)), 2).alias(c) for c in named]
    out += [S.js_round(F.coalesce(F.col("__p")[i], F.lit(0.0)), 2).alias(c) for i, c in enumerate(("p25", "median", "p75"))]
    return grouped.select(*keys, F.col("count").cast("long").alias("count"), *out)


def color_range(df: DataFrame, keys: list[str]) -> DataFrame:
    """The values at floor(.02 n) and ceil(.98 n) - 1 in order [A14]."""
    w = Window.partitionBy(*keys)
    ranked = df.where("value is not null").withColumn("r", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count("*").over(w))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("r") == F.floor(0.02 * F.col("n")), F.col("value"))).alias("p2"), F.max(F.when(F.col("r") == F.ceil(0.98 * F.col("n")) - 1, F.col("value"))).alias("p98")
    )


def monthly_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean value of each key and month [A17]."""
    return df.groupBy(*keys, F.trunc("obs_date", "month").alias("month")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def top_wells(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys of most rows, ties by key [A24]."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def group_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, median and count of a metric [A16, A23]."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.count(v).alias("count"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in an order [W07]. The group limit is pushed below the shuffle by the optimiser."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= n).drop("__k")
