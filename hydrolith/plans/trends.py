"""Queries of counts, trends and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.operators import clean, metrics, trend
from hydrolith.plans.registry import query, r, sql

KEY = ["region_id", "aquifer_id", "well_id"]
X = "date_diff('day', DATE '1970-01-01', obs_date) / 365.25::DOUBLE"
FIT = f"""fit AS (SELECT region_id, aquifer_id, well_id, count(*) AS n, CASE WHEN count(*) >= 2 AND var_pop({X}) > 0 THEN covar_pop(value, {X}) / var_pop({X}) END AS slope, avg(value) AS my, avg({X}) AS mx FROM meas JOIN well USING (well_id) GROUP BY ALL)"""
CLASS = "CASE WHEN {0} IS NULL THEN 'Insufficient' WHEN {0} < -{1} THEN 'Extreme Decline' WHEN {0} < -{2} THEN 'Decline' WHEN {0} <= {2} THEN 'Static' WHEN {0} <= {1} THEN 'Increase' ELSE 'Extreme Increase' END"


def series(t):
    return t.measurements.join(t.wells.select(*KEY), "well_id")


@query("A01_group", "SELECT l_suppkey AS well_id, count(*) AS n, min(l_shipdate::DATE) AS first_date, max(l_shipdate::DATE) AS last_date FROM lineitem GROUP BY l_suppkey")
def _(t):
    return clean.spans(t.measurements, ["well_id"])


@query("A02_entity_counts", sql("SELECT region_id, data_type, count(DISTINCT aquifer_id) AS n_aquifers, count(DISTINCT m.well_id) AS n_wells, count(*) AS n FROM meas m JOIN well USING (well_id) GROUP BY ALL", "meas", "well"))
def _(t):
    return series(t).groupBy("region_id", "data_type").agg(F.countDistinct("aquifer_id").alias("n_aquifers"), F.countDistinct("well_id").alias("n_wells"), F.count("*").alias("n"))


@query("A03_months", sql("SELECT well_id, count(DISTINCT strftime(obs_date, '%Y-%m')) AS n_months FROM meas GROUP BY well_id", "meas"))
def _(t):
    return trend.months_with_data(t.measurements, ["well_id"])


@query("A04_qualified", sql(f"SELECT well_id, count(*) AS n, {r("date_diff('day', min(obs_date), max(obs_date)) / 365.25::DOUBLE", 6)} AS span, count(*) >= 300 AND date_diff('day', min(obs_date), max(obs_date)) / 365.25 >= 6.7 AS qualified FROM meas WHERE data_type = 'N' GROUP BY well_id", "meas"))
def _(t):
    return trend.qualified(t.measurements.where("data_type = 'N'"), ["well_id"], 300, 6.7).withColumn("span", S.js_round(F.col("span"), 6))


@query("A05_density", sql("""b AS (SELECT i::INTEGER AS bin, (DATE '1994-01-01' + to_months(6 * i::INTEGER))::DATE AS bin_start FROM range(20) g(i)),
c AS (SELECT floor(((year(obs_date) - 1994) * 12 + month(obs_date) - 1) / 6)::INTEGER AS bin, count(DISTINCT well_id) AS n FROM meas GROUP BY 1)
SELECT bin, bin_start, coalesce(n, 0) AS n_wells FROM b LEFT JOIN c USING (bin)""", "meas"))
def _(t):
    return trend.density(t.measurements, "well_id", "1994-01-01", 20)


@query("A06_default_range", sql("""s AS (SELECT well_id, min(obs_date) AS lo, max(obs_date) AS hi FROM meas GROUP BY 1),
c AS (SELECT y, count(*) AS n FROM s, range(1990, 2005) g(y) WHERE make_date(y, 1, 1) BETWEEN lo AND hi GROUP BY y)
SELECT min(y)::INTEGER AS first_year, max(y)::INTEGER AS last_year FROM c WHERE n >= greatest(10, (SELECT ceil(count(*) * 0.05) FROM s))""", "meas"))
def _(t):
    return trend.default_range(t.measurements, "well_id")


@query("A07_data_span", sql("SELECT min(obs_date) AS first_date, max(obs_date) AS last_date, count(*) AS n, count(DISTINCT well_id) AS n_sites FROM meas", "meas"))
def _(t):
    return t.measurements.agg(F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"), F.count("*").alias("n"), F.countDistinct("well_id").alias("n_sites"))


@query("A08_slope", sql(f"{FIT} SELECT region_id, aquifer_id, well_id, n, {r('slope')} AS slope FROM fit", "meas", "well"))
def _(t):
    return trend.well_trends(series(t), KEY).select(*KEY, "n", S.js_round(F.col("slope"), 4).alias("slope"))


@query("A09_trend_line", sql(f"{FIT} SELECT well_id, {r('slope')} AS slope, {r('my - slope * mx', 3)} AS intercept, {r('my - slope * mx + slope * 25', 3)} AS at_1995 FROM fit", "meas", "well"))
def _(t):
    at = F.col("intercept") + F.col("slope") * 25
    return trend.well_trends(series(t), KEY).select("well_id", S.js_round(F.col("slope"), 4).alias("slope"), S.js_round(F.col("intercept"), 3).alias("intercept"), S.js_round(at, 3).alias("at_1995"))


@query("A10_trend_class", sql(f"{FIT} SELECT well_id, {CLASS.format('slope', '600.0', '150.0')} AS trend FROM fit", "meas", "well"))
def _(t):
    return trend.well_trends(series(t), KEY).select("well_id", S.trend_class(F.col("slope"), 600.0, 150.0).alias("trend"))


@query("A11_aquifer_trend", sql(f"{FIT}, a AS (SELECT region_id, aquifer_id, median(slope) AS s, count(slope) AS n_wells FROM fit GROUP BY ALL) SELECT region_id, aquifer_id, {r('s')} AS slope, n_wells, {CLASS.format('s', '300.0', '75.0')} AS trend FROM a", "meas", "well"))
def _(t):
    a = trend.aquifer_trends(trend.well_trends(series(t), KEY), ["region_id", "aquifer_id"], 300.0, 75.0)
    return a.withColumn("slope", S.js_round(F.col("slope"), 4))


@query("A12_window_trend", sql(f"m AS (SELECT * FROM meas WHERE obs_date >= DATE '2001-11-04' - INTERVAL 24 MONTH) SELECT well_id, count(*) AS n, {r(f'covar_pop(value, {X}) / var_pop({X})')} AS slope FROM m GROUP BY well_id", "meas"))
def _(t):
    w = trend.well_trends(t.measurements, ["well_id"], "2001-11-04", 2)
    return w.select("well_id", "n", S.js_round(F.col("slope"), 4).alias("slope"))


STATS = ", ".join([f"count(value) AS count", *(f"{r(f'{f}(value)', 2)} AS {n}" for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"))), *(f"{r(f'quantile_cont(value, {p})', 2)} AS {n}" for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)))])


@query("A13_frame_statistics", sql(f"SELECT raster, frame_date, {STATS} FROM frame GROUP BY raster, frame_date", "frame"))
def _(t):
    return trend.frame_statistics(t.frames, ["raster", "frame_date"])


@query("A14_color_range", sql("k AS (SELECT raster, value, row_number() OVER (PARTITION BY raster ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY raster) AS n FROM frame) SELECT raster, max(CASE WHEN r = floor(0.02 * n) THEN value END) AS p2, max(CASE WHEN r = ceil(0.98 * n) - 1 THEN value END) AS p98 FROM k GROUP BY raster", "frame"))
def _(t):
    return trend.color_range(t.frames, ["raster"])


@query("A15_bands", sql(f"SELECT raster, frame_date, {r('avg(value) - stddev_pop(value)', 2)} AS low, {r('avg(value) + stddev_pop(value)', 2)} AS high FROM frame GROUP BY ALL", "frame"))
def _(t):
    m, s = F.avg("value"), F.stddev_pop("value")
    return t.frames.groupBy("raster", "frame_date").agg(S.js_round(m - s, 2).alias("low"), S.js_round(m + s, 2).alias("high"))


@query("A17_monthly_mean", sql(f"SELECT well_id, date_trunc('month', obs_date)::DATE AS month, {r('avg(value)')} AS value, count(*) AS n FROM meas GROUP BY 1, 2", "meas"))
def _(t):
    return trend.monthly_mean(t.measurements, ["well_id"]).withColumn("value", S.js_round(F.col("value"), 4))


@query("A18_pivot", sql("SELECT well_id, obs_date, max(value) FILTER (WHERE data_type = 'A') AS A, max(value) FILTER (WHERE data_type = 'N') AS N, max(value) FILTER (WHERE data_type = 'R') AS R FROM meas GROUP BY ALL", "meas"))
def _(t):
    return t.measurements.groupBy("well_id", "obs_date").pivot("data_type", ["A", "N", "R"]).agg(F.max("value"))


@query("A19_unpivot", "SELECT l_orderkey, l_linenumber, parameter, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR parameter IN (l_quantity, l_discount, l_tax)) WHERE value <> 0")
def _(t):
    return t.read("lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "parameter", "value").where("value is not null and value <> 0")


@query("A23_metric_summary", sql(f"{FIT} SELECT region_id, {r('avg(slope)', 3)} AS mean, {r('stddev_samp(slope)', 3)} AS std, {r('median(slope)', 3)} AS median, count(slope) AS count FROM fit GROUP BY region_id", "meas", "well"))
def _(t):
    g = trend.group_summary(trend.well_trends(series(t), KEY), ["region_id"], "slope")
    return g.select("region_id", *[S.js_round(F.col(c), 3).alias(c) for c in ("mean", "std", "median")], "count")


@query("A16_metric_counts", sql(f"{FIT} SELECT aquifer_id, {r('avg(slope)', 3)} AS mean_slope, count(slope) AS n_finite, count(*) AS n FROM fit GROUP BY aquifer_id", "meas", "well"))
def _(t):
    g = trend.well_trends(series(t), KEY).groupBy("aquifer_id")
    return g.agg(S.js_round(F.avg("slope"), 3).alias("mean_slope"), F.count("slope").alias("n_finite"), F.count("*").alias("n"))


@query("A24_top_wells", sql("SELECT well_id, count(*) AS n FROM meas GROUP BY well_id ORDER BY n DESC, well_id LIMIT 25", "meas"))
def _(t):
    return trend.top_wells(t.measurements, "well_id", 25)


@query("A25_effective_types", "SELECT DISTINCT code FROM (SELECT 'wte' AS code UNION SELECT lower(l_returnflag) FROM lineitem WHERE l_returnflag IN ('A', 'R') UNION SELECT lower(l_linestatus) FROM lineitem WHERE lower(l_linestatus) NOT IN ('a', 'r'))")
def _(t):
    line = t.read("lineitem")
    catalog = line.select(F.lower("l_returnflag").alias("code")).where("code in ('a', 'r')").distinct()
    custom = line.select(F.lower("l_linestatus").alias("code")).distinct().where("code not in ('a', 'r')")
    return t.spark.range(1).select(F.lit("wte").alias("code")).union(catalog).union(custom).distinct()


@query("S21_study_wells", sql("SELECT well_id, count(*) AS n FROM meas WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY well_id HAVING count(*) >= 10 ORDER BY n DESC, well_id LIMIT 50", "meas"))
def _(t):
    m = clean.in_dates(t.measurements, "obs_date", "1996-01-01", "1999-12-31")
    return m.groupBy("well_id").agg(F.count("*").alias("n")).where("n >= 10").orderBy(F.desc("n"), "well_id").limit(50)


@query("S19_monthly_sums", sql(f"SELECT date_trunc('month', obs_date)::DATE AS month, {r('sum(value)', 2)} AS total FROM meas GROUP BY 1", "meas"))
def _(t):
    return t.measurements.groupBy(F.trunc("obs_date", "month").alias("month")).agg(S.js_round(F.sum("value"), 2).alias("total"))


FITTED = "f AS (SELECT l_suppkey AS key, l_extendedprice AS obs, l_quantity * 1500.0 AS pred FROM lineitem), g AS (SELECT *, avg(obs) OVER (PARTITION BY key) AS m FROM f)"
SSE, SST = "sum((pred - obs) * (pred - obs))", "sum((obs - m) * (obs - m))"
METRICS = {
    "r": "coalesce(corr(obs, pred), 0)",
    "r2": f"1 - {SSE} / {SST}",
    "kge": "1 - sqrt(pow(corr(obs, pred) - 1, 2) + pow(stddev_samp(pred) / stddev_samp(obs) - 1, 2) + pow(avg(pred) / avg(obs) - 1, 2))",
    "rmse": f"sqrt({SSE} / count(*))",
    "nrmse": f"sqrt({SSE} / count(*)) / stddev_samp(obs)",
    "mae": "avg(abs(pred - obs))",
    "me": "avg(pred - obs)",
    "max_error": "max(abs(pred - obs))",
    "pbias": "100 * sum(pred - obs) / sum(obs)",
    "agreement": f"1 - {SSE} / sum(pow(abs(pred - m) + abs(obs - m), 2))",
}


@query("V04_fit_metrics", sql(f"{FITTED} SELECT key, count(*) AS n, {', '.join(f'{r(e, 5)} AS {k}' for k, e in METRICS.items())} FROM g GROUP BY key"))
def _(t):
    f = t.read("lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * 1500.0).alias("pred"))
    g = metrics.fit_metrics(f, ["key"])
    return g.select("key", "n", *[S.js_round(F.col(c), 5).alias(c) for c in METRICS])


@query("V06_random_holdout", sql("k AS (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY md5('7|' || key || '|' || x), x) AS k, count(*) OVER (PARTITION BY key) AS n FROM daily) SELECT key, x, k <= least(floor(n * 0.2), greatest(n - 5, 0)) AS held_out FROM k", "daily"))
def _(t):
    return metrics.random_holdout(t.daily.select("key", "x"), ["key"], "x", 0.2, 7)


@query("V06_window_holdout", sql("SELECT well_id, count(*) AS n FROM meas WHERE obs_date >= DATE '1998-03-01' AND obs_date < DATE '2000-03-01' GROUP BY well_id", "meas"))
def _(t):
    h = metrics.window_holdout(t.measurements, ["well_id"], "obs_date", "1998-03-01", 2)
    return h.where("held_out").groupBy("well_id").agg(F.count("*").alias("n"))


def _measure(name, column):
    @query(name, sql(f"{FITTED} SELECT key, {r(METRICS[column], 5)} AS {column} FROM g GROUP BY key"))
    def _(t):
        f = t.read("lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * 1500.0).alias("pred"))
        return metrics.fit_metrics(f, ["key"]).select("key", S.js_round(F.col(column), 5).alias(column))


for _name, _column in {"V01_pearson": "r", "V02_r2": "r2", "V03_kge": "kge", "V05_nrmse": "nrmse"}.items():
    _measure(_name, _column)


@query("W07_top_per_group", sql("c AS (SELECT aquifer_id, well_id, count(*) AS n FROM meas JOIN well USING (well_id) GROUP BY ALL) SELECT aquifer_id, well_id, n FROM (SELECT *, row_number() OVER (PARTITION BY aquifer_id ORDER BY n DESC, well_id) AS k FROM c) WHERE k <= 8", "meas", "well"))
def _(t):
    counts = t.measurements.groupBy("well_id").agg(F.count("*").alias("n")).join(t.wells.select("well_id", "aquifer_id"), "well_id")
    return trend.top_per_group(counts, ["aquifer_id"], [F.desc("n"), F.col("well_id")], 8).select("aquifer_id", "well_id", "n")
