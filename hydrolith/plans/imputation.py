"""Queries of imputation and matrix kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.operators import impute, metrics, spatial
from hydrolith.plans.registry import query, r, sql
from hydrolith.plans.text import HAV


@query("M03_donors", sql(f"""pr AS (SELECT a.grp, a.key AS a, b.key AS b, corr(a.value, b.value) AS r, avg(a.value) AS mx, avg(b.value) AS my, covar_pop(a.value, b.value) AS c, var_pop(b.value) AS v FROM monthly a JOIN monthly b ON a.grp = b.grp AND a.m = b.m AND a.key <> b.key GROUP BY ALL HAVING count(*) >= 8 AND var_pop(b.value) > 0),
bp AS (SELECT *, row_number() OVER (PARTITION BY grp, a ORDER BY abs(r) DESC, b) AS k FROM pr WHERE NOT isnan(r))
SELECT p.grp, p.a AS key, m.m AS t, {r('sum(r * r * (mx + c / v * (m.value - my))) / sum(r * r)', 2)} AS value, count(*) AS n_donors FROM bp p JOIN monthly m ON m.grp = p.grp AND m.key = p.b WHERE k <= 50 GROUP BY ALL""", "monthly"))
def _(t):
    d = impute.donor_estimates(t.monthly.withColumnRenamed("m", "t"))
    return d.withColumn("value", S.js_round(F.col("value"), 2))


@query("I09_soft_impute")
def _(t):
    return impute.complete_matrix(t.monthly, "grp")


@query("I11_eof_modes")
def _(t):
    return impute.eof_modes(t.monthly, "grp")


@query("M02_elm")
def _(t):
    return impute.impute_series(t.monthly.select("key", "m", "value"), "elm")


@query("M06_reservoir")
def _(t):
    return impute.impute_series(t.monthly.select("key", "m", "value"), "reservoir")


@query("M12_ridge")
def _(t):
    return impute.impute_series(t.monthly.select("key", "m", "value"), "ridge")


def _series(t):
    return t.monthly.select("key", "m", "value")


@query("M07_search")
def _(t):
    return impute.impute_series(_series(t), "search")


@query("M16_euler_reservoir")
def _(t):
    return impute.impute_series(_series(t), "euler")


@query("M17_ensemble")
def _(t):
    return impute.impute_series(_series(t), "ensemble")


@query("M19_polynomial")
def _(t):
    return impute.impute_series(_series(t), "polynomial")


@query("M21_process")
def _(t):
    return impute.impute_series(_series(t), "process")


@query("M22_residual_process")
def _(t):
    return impute.impute_series(_series(t), "residual")


@query("M25_denoised")
def _(t):
    return impute.impute_series(_series(t), "denoised")


@query("M04_donor_matrix")
def _(t):
    return impute.impute_with_donors(t.monthly, "grp")


@query("M10_support_loop")
def _(t):
    return impute.impute_supported(t.monthly, "grp")


@query("V08_holdout_benchmark")
def _(t):
    return metrics.fit_metrics(impute.holdout_benchmark(_series(t), ["elm", "euler", "ridge"]), ["method"])


@query("M01_elm_fit")
def _(t):
    return metrics.fit_metrics(impute.holdout_benchmark(_series(t), ["elm"]), ["key"])


@query("M20_liquid_reservoir")
def _(t):
    return impute.impute_series(_series(t), "liquid")


@query("M11_full_series")
def _(t):
    return impute.full_series(t.monthly, "grp", 2, 0)


@query("M13_auxiliary_weights", sql(f"""ax AS (SELECT well_id AS key, (year(obs_date) * 12 + month(obs_date) - 1)::BIGINT AS m, data_type AS aux, max(value) AS x FROM meas WHERE data_type <> 'A' GROUP BY ALL),
c AS (SELECT key, aux, coalesce(corr(value, x), 0) AS r FROM monthly JOIN ax USING (key, m) GROUP BY ALL), k AS (SELECT *, max(abs(r)) OVER (PARTITION BY key) >= 0.15 AS has, row_number() OVER (PARTITION BY key ORDER BY abs(r) DESC, aux) AS n FROM c),
w AS (SELECT *, CASE WHEN abs(r) >= 0.15 OR NOT has AND n = 1 THEN r * r ELSE 0 END AS w FROM k) SELECT key, aux, {r('r', 6)} AS r, {r('CASE WHEN max(w) OVER (PARTITION BY key) > 0 THEN w / max(w) OVER (PARTITION BY key) ELSE 0 END', 6)} AS weight FROM w""", "monthly"))
def _(t):
    m = (F.year("obs_date") * 12 + F.month("obs_date") - 1).cast("long")
    aux = t.measurements.where("data_type <> 'A'").groupBy(F.col("well_id").alias("key"), m.alias("m"), F.col("data_type").alias("aux")).agg(F.max("value").alias("x"))
    w = impute.auxiliary_weights(_series(t), aux)
    return w.select("key", "aux", S.js_round(F.col("r"), 6).alias("r"), S.js_round(F.col("weight"), 6).alias("weight"))


@query("M23_graph_means", sql(f"n AS (SELECT a.well_id AS key, b.well_id AS site, {HAV.format('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d, row_number() OVER (PARTITION BY a.well_id ORDER BY {HAV.format('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.well_id) AS k FROM well a JOIN well b ON a.region_id = b.region_id AND a.well_id <> b.well_id), g AS (SELECT key, site, 1 / (1 + d / 1000) AS w, sum(1 / (1 + d / 1000)) OVER (PARTITION BY key) AS total FROM n WHERE k <= 5) SELECT g.key, m, {r('sum(w * value) / any_value(total)', 3)} AS value FROM g JOIN monthly ON site = monthly.key GROUP BY ALL", "monthly"))
def _(t):
    p = t.wells.select("region_id", F.col("well_id").alias("id"), "lat", "lng")
    s = t.wells.select("region_id", F.col("well_id").alias("site_id"), F.col("lat").alias("site_lat"), F.col("lng").alias("site_lng"))
    near = spatial.k_nearest(p, s, "region_id", 5)
    return impute.neighbour_means(_series(t), near).withColumn("value", S.js_round(F.col("value"), 3))


@query("M05_row_means")
def _(t):
    return impute.complete_matrix(t.monthly, "grp", start="row", stop="cell")
