"""Measures of fit and holdouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_metrics(df: DataFrame, keys: list[str], observed: str = "obs", predicted: str = "pred") -> DataFrame:
    """r, R2, KGE, RMSE, NRMSE, MAE, ME, PBIAS, NSE and index of agreement by key, over rows with both values [V01-V05].

    A correlation without variance and an R2 without spread are 0; KGE is null where the mean of observations is 0.
    """
    o, p = F.col(observed), F.col(predicted)
    rows = df.where(o.isNotNull() & p.isNotNull()).withColumn("__m", F.avg(observed).over(Window.partitionBy(*keys)))
    e = p - o
    m = F.col("__m")
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.nanvl(F.corr(o, p), F.lit(0.0)).alias("__r"),
        F.sum(e * e).alias("__sse"),
        F.sum((o - m) * (o - m)).alias("__sst"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("me"),
        F.sum(e).alias("__se"),
        F.sum(o).alias("__so"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(o).alias("__mo"),
        F.avg(p).alias("__mp"),
        F.stddev_samp(o).alias("__sdo"),
        F.stddev_samp(p).alias("__sdp"),
        F.sum(F.pow(F.abs(p - m) + F.abs(o - m), F.lit(2.0))).alias("__pot"),
    )
    r = F.coalesce("__r", F.lit(0.0))
    alpha = F.when(F.col("__sdo") > 0, F.col("__sdp") / F.col("__sdo")).otherwise(0.0)
    beta = F.when(F.col("__mo") != 0, F.col("__mp") / F.col("__mo"))
    return g.select(
        *keys,
        "n",
        r.alias("r"),
        F.when(F.col("__sst") > 0, 1 - F.col("__sse") / F.col("__sst")).otherwise(0.0).alias("r2"),
        (1 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))).alias("kge"),
        F.sqrt(F.col("__sse") / F.col("n")).alias("rmse"),
        F.when(F.col("__sdo") > 0, F.sqrt(F.col("__sse") / F.col("n")) / F.col("__sdo")).alias("nrmse"),
        "mae",
        "me",
        "max_error",
        F.when(F.col("__so") != 0, 100 * F.col("__se") / F.col("__so")).alias("pbias"),
        F.when(F.col("__pot") > 0, 1 - F.col("__sse") / F.col("__pot")).alias("agreement"),
    )


def random_holdout(df: DataFrame, keys: list[str], time: str, share: float, seed: int, keep: int = 5) -> DataFrame:
    """df with ``held_out``: a share of each key's rows by a hash of seed, key and time, which leaves at least ``keep`` [V06, V09]."""
    w = Window.partitionBy(*keys)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*keys, time]]))
    ranked = df.withColumn("__k", F.row_number().over(w.orderBy(draw, time))).withColumn("__n", F.count("*").over(w))
    most = F.least(F.floor(F.col("__n") * share), F.greatest(F.col("__n") - keep, F.lit(0)))
    return ranked.withColumn("held_out", F.col("__k") <= most).drop("__k", "__n")


def window_holdout(df: DataFrame, keys: list[str], date: str, start: str, years: int) -> DataFrame:
    """df with ``held_out``: rows of so many years from a date on [V06]."""
    end = F.add_months(F.lit(start).cast("date"), 12 * years)
    return df.withColumn("held_out", (F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < end))
