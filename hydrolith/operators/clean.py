"""Filters, checks and repairs of wells and measurements. Order always comes from an explicit column ``pos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order [W02]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def in_dates(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows dated from start to end, both included and either open [F02]."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def clamp_range(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """[start, end] within [low, high]; both null if they are apart [F03]."""
    meets = (start <= high) & (end >= low)
    return F.when(meets, F.greatest(start, low)), F.when(meets, F.least(end, high))


def spans(df: DataFrame, keys: list[str], date: str = "obs_date") -> DataFrame:
    """First and last date and number of rows of each key [A01]."""
    return df.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"))


def overlapping_spans(df: DataFrame, keys: list[str], first_year: int, last_year: int) -> DataFrame:
    """Keys whose span meets the years [F04]."""
    return spans(df, keys).where((F.col("first_date") <= F.make_date(F.lit(last_year), F.lit(12), F.lit(31))) & (F.col("last_date") >= F.make_date(F.lit(first_year), F.lit(1), F.lit(1))))


def count_classes(wells: DataFrame, measurements: DataFrame, key: str, least: int) -> DataFrame:
    """Wells with at least ``least`` rows, and a class by their number: 0, 1 or 2 [F05]."""
    counts = measurements.groupBy(key).agg(F.count("*").alias("n"))
    both = wells.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return both.where(F.col("n") >= least).withColumn("count_class", F.least("n", F.lit(2)).cast("int"))


def search(df: DataFrame, text: str, columns: list[str], order: str, most: int = 8) -> DataFrame:
    """The first rows in which a column holds a text in either case [F06, W07]."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c).cast("string")).contains(text.lower())
    return df.where(hit).orderBy(order).limit(most)


def validate_measurements(df: DataFrame, low: float = -10_000.0, high: float = 100_000.0) -> DataFrame:
    """Rows (site, date, value, pos) with the reason why each is dropped, or null: a bad date, value or a repeat [F10, F11]."""
    dated = df.withColumn("iso_date", S.validate_date(F.col("date")))
    sane = dated.withColumn("sane", F.col("iso_date").isNotNull() & F.col("value").between(low, high))
    w = Window.partitionBy("site", "iso_date", "sane").orderBy("pos")
    return sane.withColumn("turn", F.row_number().over(w)).select(
        "site",
        "iso_date",
        "value",
        "pos",
        F.when(F.col("iso_date").isNull(), "bad date").when(~F.coalesce("sane", F.lit(False)), "out of range").when(F.col("turn") > 1, "duplicate").alias("reason"),
    )


def dedup_by_catalog(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Results (site, date, characteristic, fraction, value, pos) of catalogued parameters, the first a site, date and code [F12]."""
    joined = results.join(catalog, F.lower("characteristic") == F.lower("characteristic_name"))
    fits = joined.where(F.col("sample_fraction").isNull() | (F.col("fraction") == F.col("sample_fraction")))
    return first_by(fits, ["site", "date", "code"], ["pos"]).select("site", "date", "code", "value")


def merge_duplicates(df: DataFrame, keys: list[str], how: str) -> DataFrame:
    """One row a key: the average to three digits or the maximum of values; the first where none is a number [F13].

    Averages are taken of six decimals, exactly, so that ties of rounding don't hang on the order of rows.
    """
    value = {"average": S.js_round(F.avg(F.col("value").cast("decimal(20,6)")).cast("double"), 3), "maximum": F.max("value")}[how]
    return df.groupBy(*keys).agg(value.alias("value"), F.min_by("pos", "pos").alias("pos"))


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of repeated keys and of rows beyond their first [F14]."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_extra"))


def iqr_outliers(df: DataFrame, key: str, k: float = 3.0) -> DataFrame:
    """Rows beyond k interquartile ranges; quartiles are the values at floor(n/4) and floor(3n/4), none for fewer than 4 [F16]."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy("value", "pos")) - 1).withColumn("__n", F.count("*").over(w))
    q = ranked.groupBy(key).agg(
        F.max(F.when(F.col("__r") == F.floor(F.col("__n") * 0.25), F.col("value"))).alias("q1"),
        F.max(F.when(F.col("__r") == F.floor(F.col("__n") * 0.75), F.col("value"))).alias("q3"),
        F.count("*").alias("__n"),
    )
    out = df.join(q.where("__n >= 4"), key)
    reach = k * (F.col("q3") - F.col("q1"))
    return out.where((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)).drop("__n")


def z_outliers(df: DataFrame, key: str, most: float = 2.5, least: int = 5) -> DataFrame:
    """Rows whose z-score by the sample deviation is beyond a limit, of keys with enough rows [F17]."""
    w = Window.partitionBy(key)
    z = (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)
    return df.withColumn("z", z).withColumn("__n", F.count("value").over(w)).where((F.col("__n") >= least) & (F.abs("z") > most)).drop("__n")


def log_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whether values rule out a logarithm, and their maximum rounded up [F18]."""
    return df.groupBy(*keys).agg(F.bool_or(F.col("value") <= 0).alias("has_nonpositive"), F.ceil(F.max("value")).cast("long").alias("ceil_max"))


def unmatched(df: DataFrame, wells: DataFrame, key: str) -> DataFrame:
    """Keys that are no well's, with their rows [F21]."""
    return df.join(wells.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
