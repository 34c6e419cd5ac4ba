"""Queries of polygons, grids, interpolation and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.operators import impute, merge, metrics, raster, series, spatial
from hydrolith.plans.registry import query, r, sql
from hydrolith.plans.text import HAV

HIT = "((y1 > lat) <> (y0 > lat)) AND lng < (x0 - x1) * (lat - y1) / (y0 - y1) + x1"
INSIDE = f"ins AS (SELECT w.well_id, e.aquifer_id, count(*) FILTER (WHERE {HIT}) % 2 = 1 AS inside FROM well w, edge e GROUP BY ALL)"


@query("J07_inside", sql(f"{INSIDE} SELECT well_id, aquifer_id FROM ins WHERE inside", "well", "edge"))
def _(t):
    points = t.wells.select(F.col("well_id").alias("id"), "lat", "lng")
    return spatial.holding_polygons(points, t.aquifers.drop("region_id"), "aquifer_id").select(F.col("id").alias("well_id"), "aquifer_id")


@query("J08_first_polygon", sql(f"{INSIDE} SELECT w.well_id AS id, min(i.aquifer_id) AS aquifer_id FROM well w LEFT JOIN ins i ON i.well_id = w.well_id AND inside GROUP BY w.well_id", "well", "edge"))
def _(t):
    return spatial.assign_polygon(t.wells.select(F.col("well_id").alias("id"), "lat", "lng"), t.aquifers.drop("region_id"), "aquifer_id").select("id", "aquifer_id")


@query("J09_clip_cascade", sql(f"{INSIDE} SELECT well_id, count(*) AS n FROM meas WHERE well_id IN (SELECT well_id FROM ins WHERE inside AND aquifer_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)) GROUP BY well_id", "well", "meas", "edge"))
def _(t):
    held = spatial.assign_polygon(t.wells.select(F.col("well_id").alias("id"), "lat", "lng"), t.aquifers.where("region_id = 2").drop("region_id"), "aquifer_id")
    keep = held.where("aquifer_id is not null").select(F.col("id").alias("well_id"))
    return t.measurements.join(keep, "well_id", "left_semi").groupBy("well_id").agg(F.count("*").alias("n"))


@query("J13_k_nearest", sql(f"n AS (SELECT a.well_id AS id, b.well_id AS site_id, row_number() OVER (PARTITION BY a.well_id ORDER BY {HAV.format('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.well_id) AS rank, {r(HAV.format('a.lat', 'a.lng', 'b.lat', 'b.lng'), 2)} AS distance FROM well a JOIN well b ON a.aquifer_id = b.aquifer_id AND a.well_id <> b.well_id) SELECT id, site_id, rank::INTEGER AS rank, distance FROM n WHERE rank <= 3", "well"))
def _(t):
    p = t.wells.select("aquifer_id", F.col("well_id").alias("id"), "lat", "lng")
    s = t.wells.select("aquifer_id", F.col("well_id").alias("site_id"), F.col("lat").alias("site_lat"), F.col("lng").alias("site_lng"))
    return spatial.k_nearest(p, s, "aquifer_id", 3).select("id", "site_id", "rank", S.js_round(F.col("distance"), 2).alias("distance"))


@query("A20_bounds", sql("SELECT aquifer_id, min(x0) AS min_lng, max(x0) AS max_lng, min(y0) AS min_lat, max(y0) AS max_lat FROM edge GROUP BY aquifer_id", "edge"))
def _(t):
    return spatial.bounds(t.aquifers).select("aquifer_id", "min_lng", "max_lng", "min_lat", "max_lat")


@query("A21_centroid", sql(f"SELECT aquifer_id, {r('avg(x0)', 6)} AS lng, {r('avg(y0)', 6)} AS lat, {r('abs(sum(x0 * y1 - x1 * y0) / 2)', 6)} AS area FROM edge GROUP BY aquifer_id", "edge"))
def _(t):
    c = spatial.centroid(t.aquifers, "aquifer_id")
    return c.select("aquifer_id", *[S.js_round(F.col(x), 6).alias(x) for x in ("lng", "lat", "area")])


NX = 20
BOX = f"bx AS (SELECT aquifer_id, min(x0) AS x0, min(y0) AS y0, max(y0) AS y9, (max(x0) - min(x0)) / {NX} AS dx, (max(x0) - min(x0)) / {NX} * cos(radians((min(y0) + max(y0)) / 2)) AS dy FROM edge GROUP BY 1)"
GRID = f"""{BOX}, cl AS (SELECT aquifer_id, c::INTEGER AS cell_id, x0 + (c % {NX} + 0.5::DOUBLE) * dx AS lng, y0 + (c // {NX} + 0.5::DOUBLE) * dy AS lat FROM bx, range(0, {NX} * 60) g(c) WHERE c < {NX} * ceil((y9 - y0) / dy))"""


def cells(t):
    b = spatial.bounds(t.aquifers).select("aquifer_id", "ring", "min_lng", "max_lng", "min_lat", "max_lat")
    return spatial.grid_cells(b, "aquifer_id", NX)


@query("I01_grid", sql(f"{GRID} SELECT cl.aquifer_id, cell_id, {r('lng', 8)} AS lng, {r('lat', 8)} AS lat, count(*) FILTER (WHERE {HIT}) % 2 = 1 AS in_mask FROM cl JOIN edge e ON e.aquifer_id = cl.aquifer_id GROUP BY ALL", "edge"))
def _(t):
    return cells(t).select("aquifer_id", "cell_id", S.js_round(F.col("lng"), 8).alias("lng"), S.js_round(F.col("lat"), 8).alias("lat"), "in_mask")


@query("I02_variogram", sql(f"SELECT aquifer_id, {r('greatest(var_pop(value), 0.01)', 2)} AS sill, {r('greatest(' + HAV.format('min(w_lat)', 'min(w_lng)', 'max(w_lat)', 'max(w_lng)') + ' / 3, 100)', 2)} AS reach, {r('CASE WHEN var_pop(value) > 0 THEN 0.05 * var_pop(value) ELSE 0.001 END', 3)} AS nugget FROM topwell GROUP BY aquifer_id", "topwell"))
def _(t):
    v = spatial.variogram(t.mean_wells, "aquifer_id")
    return v.select("aquifer_id", S.js_round(F.col("sill"), 2).alias("sill"), S.js_round(F.col("reach"), 2).alias("reach"), S.js_round(F.col("nugget"), 3).alias("nugget"))


@query("I03_covariance", f"SELECT s_suppkey, {r('CASE WHEN h <= 0 THEN 9.0 ELSE 9.0 * exp(-(h / 4000) * (h / 4000)) END', 8)} AS gaussian, {r('CASE WHEN h <= 0 THEN 9.0 ELSE 9.0 * exp(-(h / 4000)) END', 8)} AS exponential, {r('CASE WHEN h <= 0 THEN 9.0 WHEN h / 4000 < 1 THEN 9.0 * (1 - 1.5 * (h / 4000) + 0.5 * (h / 4000) * (h / 4000) * (h / 4000)) ELSE 0 END', 8)} AS spherical FROM (SELECT s_suppkey, s_acctbal AS h FROM supplier)")
def _(t):
    return t.read("supplier").select("s_suppkey", *[S.js_round(S.covariance(F.col("s_acctbal"), 10.0, 4000.0, 1.0, m), 8).alias(m) for m in ("gaussian", "exponential", "spherical")])


DEG = "sqrt(pow((w_lng - lng) * cos(radians((lat + w_lat) / 2)), 2) + pow(w_lat - lat, 2))"


@query("I08_power_idw", sql(f"{GRID}, nn AS (SELECT cl.aquifer_id, cell_id, value, {DEG} AS d, row_number() OVER (PARTITION BY cl.aquifer_id, cell_id ORDER BY {DEG}, well_id) AS k FROM cl JOIN topwell w ON w.aquifer_id = cl.aquifer_id) SELECT aquifer_id, cell_id, {r('sum(value / (d * d + 1e-6)) / sum(1 / (d * d + 1e-6))', 3)} AS value FROM nn WHERE k <= 8 GROUP BY ALL", "edge", "topwell"))
def _(t):
    c = cells(t).select("aquifer_id", "cell_id", "lat", "lng")
    return spatial.power_idw(c, t.mean_wells, "aquifer_id").withColumn("value", S.js_round(F.col("value"), 3))


@query("I06_shepard_idw", sql(f"{GRID}, nn AS (SELECT cl.aquifer_id, cell_id, value, {HAV.format('lat', 'lng', 'w_lat', 'w_lng')} AS h FROM cl JOIN topwell w ON w.aquifer_id = cl.aquifer_id), rr AS (SELECT *, max(h) OVER (PARTITION BY aquifer_id, cell_id) AS R FROM nn) SELECT aquifer_id, cell_id, {r('coalesce(sum(pow((R - h) / (R * h), 2) * value) FILTER (WHERE h < R) / sum(pow((R - h) / (R * h), 2)) FILTER (WHERE h < R), avg(value))', 3)} AS value FROM rr GROUP BY ALL", "edge", "topwell"))
def _(t):
    c = cells(t).select("aquifer_id", "cell_id", "lat", "lng")
    return spatial.shepard_idw(c, t.mean_wells, "aquifer_id").withColumn("value", S.js_round(F.col("value"), 3))


@query("I05_kriging")
def _(t):
    return spatial.kriging(t.mean_wells, cells(t).where("in_mask").select("aquifer_id", "cell_id", "lat", "lng"), "aquifer_id")


@query("G07_crs_votes", sql("bb AS (SELECT aquifer_id, min(x0) AS a, max(x0) AS b, min(y0) AS c, max(y0) AS d FROM edge GROUP BY 1), cd AS (SELECT well_id, aquifer_id, 'swapped' AS crs, 1 AS pos, lat AS lng, lng AS lat FROM well UNION ALL SELECT well_id, aquifer_id, 'wgs84', 2, lng, lat FROM well), v AS (SELECT aquifer_id, crs, pos, avg((lng BETWEEN a - greatest(0.1, 2 * (b - a)) AND b + greatest(0.1, 2 * (b - a)) AND lat BETWEEN c - greatest(0.1, 2 * (d - c)) AND d + greatest(0.1, 2 * (d - c)))::INT) AS share FROM cd JOIN bb USING (aquifer_id) GROUP BY ALL) SELECT aquifer_id, arg_min(crs, pos) AS crs, arg_min(share, pos)::DOUBLE AS share FROM v WHERE share >= 0.5 GROUP BY aquifer_id", "edge", "well"))
def _(t):
    w = t.wells
    swapped = w.select("aquifer_id", F.lit("swapped").alias("crs"), F.lit(1).alias("pos"), F.col("lat").alias("lng"), F.col("lng").alias("lat"))
    plain = w.select("aquifer_id", F.lit("wgs84").alias("crs"), F.lit(2).alias("pos"), "lng", "lat")
    box = spatial.bounds(t.aquifers).select("aquifer_id", "min_lng", "max_lng", "min_lat", "max_lat")
    return spatial.crs_votes(swapped.union(plain), box, "aquifer_id")


@query("R01_cross_section", sql(f"""s AS (SELECT i AS sample_idx, 1.2 + 16.3 * (i / 49.0::DOUBLE) AS fx, 0.7 + 7.9 * (i / 49.0::DOUBLE) AS fy FROM range(50) g(i)), q AS (SELECT *, floor(fx)::INT AS c, floor(fy)::INT AS r, fx - floor(fx) AS u, fy - floor(fy) AS v FROM s),
k AS (SELECT sample_idx, ((r + j) * 20 + c + i)::INT AS cell_id, (CASE i WHEN 1 THEN u ELSE 1 - u END) * (CASE j WHEN 1 THEN v ELSE 1 - v END) AS w FROM q, range(2) a(i), range(2) b(j) WHERE c + 1 < 20 AND r + 1 < 10)
SELECT raster, frame_date, sample_idx::INTEGER AS sample_idx, {r('sum(w * value)', 3)} AS value FROM frame JOIN k USING (cell_id) GROUP BY ALL HAVING count(*) = 4""", "frame"))
def _(t):
    s = raster.cross_section(t.frames, (1.2, 0.7, 17.5, 8.6), 50, (0.0, 0.0, 1.0, 1.0, 20, 10))
    return s.withColumn("value", S.js_round(F.col("value"), 3))


@query("R02_cell_at", sql("SELECT raster, frame_date, value FROM frame WHERE cell_id = 3 * 20 + 7", "frame"))
def _(t):
    return raster.cell_at(t.frames, 7.5, 3.25, (0.0, 0.0, 1.0, 1.0, 20, 10))


@query("R03_contours")
def _(t):
    return raster.contour_segments(t.frames, 20)


@query("R04_storage_change", sql(f"""d AS (SELECT raster, frame_date, cell_id, value - lag(value) OVER (PARTITION BY raster, cell_id ORDER BY frame_date) AS dh FROM frame), c AS (SELECT raster, frame_date, coalesce(sum(dh * (1000.0::DOUBLE + cell_id)), 0) * 0.15 / 1e6 AS change FROM d GROUP BY ALL)
SELECT raster, frame_date, {r('change', 5)} AS change, {r('sum(change) OVER (PARTITION BY raster ORDER BY frame_date)', 5)} AS cumulative FROM c""", "frame"))
def _(t):
    areas = t.spark.range(200).select(F.col("id").cast("int").alias("cell_id"), (F.col("id") + 1000.0).alias("area"))
    s = raster.storage_change(t.frames, areas, 0.15, "MCM")
    return s.select("raster", "frame_date", S.js_round(F.col("change"), 5).alias("change"), S.js_round(F.col("cumulative"), 5).alias("cumulative"))


def inner_cells(t):
    return cells(t).where("in_mask").select("aquifer_id", "cell_id", "lat", "lng")


@query("I04_merged_wells")
def _(t):
    return spatial.merged_wells(t.mean_wells, "aquifer_id")


@query("I07_gradient")
def _(t):
    return spatial.by_group(t.mean_wells, inner_cells(t), "aquifer_id", lambda *x: spatial.nodal_shepard(*x, "gradient"))


@query("I07_quadratic")
def _(t):
    return spatial.by_group(t.mean_wells, inner_cells(t), "aquifer_id", lambda *x: spatial.nodal_shepard(*x, "quadratic"))


@query("I16_stable_kriging")
def _(t):
    return spatial.kriging(t.mean_wells, inner_cells(t), "aquifer_id", "stable")


def _surfaces(t, method):
    wells = t.wells.select(F.col("aquifer_id").alias("grp"), "well_id", F.col("lat").alias("w_lat"), F.col("lng").alias("w_lng"))
    return impute.surfaces(t.monthly, wells, inner_cells(t).withColumnRenamed("aquifer_id", "grp"), "grp", method)


@query("I10_matrix_surfaces")
def _(t):
    return _surfaces(t, "matrix")


@query("I12_mode_surfaces")
def _(t):
    return _surfaces(t, "modes")


@query("I14_grid_completion")
def _(t):
    return _surfaces(t, "grid")


@query("I15_donor_transfer")
def _(t):
    return _surfaces(t, "transfer")


FRAMED = """yr AS (SELECT m.well_id, aquifer_id, lat AS w_lat, lng AS w_lng, date_trunc('year', obs_date)::DATE AS frame_date, max(value) AS value FROM meas m JOIN well w USING (well_id) WHERE data_type = 'R' GROUP BY ALL)"""
MASKED = f"mk AS (SELECT cl.aquifer_id, cell_id, lng, lat FROM cl JOIN edge e ON e.aquifer_id = cl.aquifer_id GROUP BY ALL HAVING count(*) FILTER (WHERE {HIT}) % 2 = 1)"


@query("I13_raster_frames", sql(f"{GRID}, {MASKED}, {FRAMED}, nn AS (SELECT mk.aquifer_id, frame_date, cell_id, value, {HAV.format('lat', 'lng', 'w_lat', 'w_lng')} AS h FROM mk JOIN yr ON yr.aquifer_id = mk.aquifer_id), rr AS (SELECT *, max(h) OVER (PARTITION BY aquifer_id, frame_date, cell_id) AS R FROM nn) SELECT aquifer_id, frame_date, cell_id, {r('coalesce(sum(pow((R - h) / (R * h), 2) * value) FILTER (WHERE h < R) / sum(pow((R - h) / (R * h), 2)) FILTER (WHERE h < R), avg(value))', 3)} AS value FROM rr GROUP BY ALL", "edge", "well", "meas"))
def _(t):
    top = t.measurements.where("data_type = 'R'").groupBy(F.col("well_id").alias("key"), F.trunc("obs_date", "year").alias("frame_date")).agg(F.max("value").alias("value"))
    wells = t.wells.select("aquifer_id", "well_id", F.col("lat").alias("w_lat"), F.col("lng").alias("w_lng"))
    return spatial.raster_frames(top, wells, cells(t), "aquifer_id").withColumn("value", S.js_round(F.col("value"), 3))


@query("I13_raster_pipeline")
def _(t):
    frames = series.temporal_step(t.daily, "1996-01-01", "1999-01-01", 12, "pchip", 10, 2.0)
    wells = t.wells.select("aquifer_id", "well_id", F.col("lat").alias("w_lat"), F.col("lng").alias("w_lng"))
    return spatial.raster_frames(frames, wells, cells(t), "aquifer_id", log=True, low=0.0, high=200_000.0)


@query("V07_leave_one_out", sql(f"p AS (SELECT a.aquifer_id, a.well_id, a.value AS obs, b.value, greatest({HAV.format('a.w_lat', 'a.w_lng', 'b.w_lat', 'b.w_lng')}, 1e-6) AS h FROM topwell a JOIN topwell b ON a.aquifer_id = b.aquifer_id AND a.well_id <> b.well_id), q AS (SELECT *, max(h) OVER (PARTITION BY aquifer_id, well_id) AS R FROM p) SELECT aquifer_id, well_id, obs, {r('coalesce(sum(pow((R - h) / (R * h), 2) * value) FILTER (WHERE h < R) / sum(pow((R - h) / (R * h), 2)) FILTER (WHERE h < R), avg(value))', 3)} AS pred FROM q GROUP BY ALL", "topwell"))
def _(t):
    return spatial.leave_one_out(t.mean_wells, "aquifer_id").withColumn("pred", S.js_round(F.col("pred"), 3))


@query("V07_leave_one_out_metrics")
def _(t):
    return metrics.fit_metrics(spatial.leave_one_out(t.mean_wells, "aquifer_id"), ["aquifer_id"])


@query("A22_label_points")
def _(t):
    return spatial.label_points(t.aquifers, "aquifer_id")


@query("G10_band_area", sql(f"{GRID}, {MASKED}, ar AS (SELECT mk.aquifer_id, radians(dx) * abs(sin(radians(lat - dy / 2)) - sin(radians(lat + dy / 2))) AS part, 6356752.3142 / sqrt(1 - (1 - pow(6356752.3142 / 6378137.0, 2)) * pow(cos(atan(pow(6356752.3142 / 6378137.0, 2) * tan(radians(lat)))), 2)) AS r FROM mk JOIN bx USING (aquifer_id)) SELECT aquifer_id, {r('sum(part * r * r)', 0)} AS area, count(*) AS n_cells FROM ar GROUP BY aquifer_id", "edge"))
def _(t):
    b = spatial.bounds(t.aquifers)
    dx = (F.col("max_lng") - F.col("min_lng")) / NX
    size = b.select("aquifer_id", dx.alias("dx"), (dx * F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))).alias("dy"))
    c = cells(t).select("aquifer_id", "lat", "in_mask").join(size, "aquifer_id")
    return spatial.band_area(c, ["aquifer_id"]).withColumn("area", S.js_round(F.col("area"), 0))


@query("G04_degree_distance", sql(f"SELECT well_id, {r('sqrt(pow((-112 - lng) * cos(radians((lat + 42) / 2)), 2) + pow(42 - lat, 2))', 8)} AS degrees FROM well", "well"))
def _(t):
    return t.wells.select("well_id", S.js_round(S.degree_distance(F.col("lat"), F.col("lng"), F.lit(42.0), F.lit(-112.0)), 8).alias("degrees"))


@query("R05_storage_comparison", sql(f"""d AS (SELECT raster, frame_date, cell_id, value - lag(value) OVER (PARTITION BY raster, cell_id ORDER BY frame_date) AS dh FROM frame), c AS (SELECT raster, frame_date, coalesce(sum(dh * (1000.0::DOUBLE + cell_id)), 0) * 0.15 / 1e6 AS change FROM d GROUP BY ALL), s AS (SELECT raster, frame_date, {r('sum(change) OVER (PARTITION BY raster ORDER BY frame_date)', 5)} AS v FROM c)
SELECT frame_date::VARCHAR AS t, {', '.join(f'max(v) FILTER (WHERE raster = {k}) AS value_{k}' for k in range(5))} FROM s GROUP BY frame_date""", "frame"))
def _(t):
    areas = t.spark.range(200).select(F.col("id").cast("int").alias("cell_id"), (F.col("id") + 1000.0).alias("area"))
    s = raster.storage_change(t.frames, areas, 0.15, "MCM")
    long = s.select(F.col("frame_date").cast("string").alias("t"), F.concat(F.lit("value_"), F.col("raster").cast("string")).alias("series"), S.js_round(F.col("cumulative"), 5).alias("value"), F.lit(0).alias("pos"))
    return merge.wide_times(long, [f"value_{k}" for k in range(5)], [])


@query("W06_nearest_ranks", sql(f"n AS (SELECT a.well_id AS id, b.well_id AS site_id, row_number() OVER (PARTITION BY a.well_id ORDER BY {HAV.format('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.well_id) AS rank FROM well a JOIN well b ON a.region_id = b.region_id AND a.well_id <> b.well_id) SELECT id, site_id, rank::INTEGER AS rank FROM n WHERE rank <= 5", "well"))
def _(t):
    p = t.wells.select("region_id", F.col("well_id").alias("id"), "lat", "lng")
    s = t.wells.select("region_id", F.col("well_id").alias("site_id"), F.col("lat").alias("site_lat"), F.col("lng").alias("site_lng"))
    return spatial.k_nearest(p, s, "region_id", 5).select("id", "site_id", "rank")
