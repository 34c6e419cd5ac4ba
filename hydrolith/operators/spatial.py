"""Polygons, grids and interpolation between wells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.operators.clean import first_by


def edges(polygons: DataFrame, key: str) -> DataFrame:
    """(key, pos, x0, y0, x1, y1) of the outer rings: polygons (key, pos, ring), a ring an array of [lng, lat] [J07]."""
    at = polygons.select(key, "pos", "ring", F.explode(F.sequence(F.lit(0), F.size("ring") - 1)).alias("k"))
    nxt = F.get("ring", F.pmod(F.col("k") + 1, F.size("ring")))
    here = F.get("ring", F.col("k"))
    return at.select(key, "pos", here[0].alias("x0"), here[1].alias("y0"), nxt[0].alias("x1"), nxt[1].alias("y1"))


def inside(lng, lat, ring):
    """Even-odd test of a point against a ring, as one expression over its edges [J07]."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossings = F.zip_with(
        ring,
        nxt,
        lambda a, b: (((b[1] > lat) != (a[1] > lat)) & (lng < (a[0] - b[0]) * (lat - b[1]) / (a[1] - b[1]) + b[0])).cast("int"),
    )
    return F.coalesce(F.aggregate(crossings, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))), F.lit(0)) % 2 == 1


def bounds(polygons: DataFrame) -> DataFrame:
    """polygons with the extent of their ring [A20]."""
    lng, lat = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    return polygons.withColumns({"min_lng": F.array_min(lng), "max_lng": F.array_max(lng), "min_lat": F.array_min(lat), "max_lat": F.array_max(lat)})


def centroid(polygons: DataFrame, key: str) -> DataFrame:
    """Mean of the vertices of a ring, and its area by the shoelace rule in square degrees [A21, A22]."""
    e = edges(polygons, key)
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    return e.groupBy(key).agg(F.avg("x0").alias("lng"), F.avg("y0").alias("lat"), F.abs(F.sum(cross) / 2).alias("area"))


def holding_polygons(points: DataFrame, polygons: DataFrame, key: str, cell: float = 0.5) -> DataFrame:
    """(id, key, pos) of all polygons that hold each point (id, lat, lng) [J07].

    Polygons are listed in the cells of their extent, points in their own, and meet by equality before the exact test.
    """
    b = bounds(polygons)
    cx = F.sequence(F.floor(F.col("min_lng") / cell), F.floor(F.col("max_lng") / cell))
    cy = F.sequence(F.floor(F.col("min_lat") / cell), F.floor(F.col("max_lat") / cell))
    tiles = b.withColumn("cx", F.explode(cx)).withColumn("cy", F.explode(cy))
    placed = points.select("id", "lat", "lng", F.floor(F.col("lng") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    return placed.join(tiles, ["cx", "cy"]).where(inside(F.col("lng"), F.col("lat"), F.col("ring"))).select("id", key, "pos")


def assign_polygon(points: DataFrame, polygons: DataFrame, key: str, cell: float = 0.5) -> DataFrame:
    """The first polygon by pos that holds each point (id, lat, lng), null if none does [J08]."""
    hit = holding_polygons(points, polygons, key, cell)
    first = hit.groupBy("id").agg(F.min_by(key, "pos").alias(key))
    return points.join(first, "id", "left")


def grid_cells(extents: DataFrame, key: str, nx: int) -> DataFrame:
    """Cells of a grid of nx columns over each extent: dy is dx shrunk by the cosine of the middle latitude [I01].

    extents (key, min_lng, max_lng, min_lat, max_lat[, ring]); returns key, cell_id, row, col, lng, lat, in_mask.
    """
    g = extents.withColumn("dx", (F.col("max_lng") - F.col("min_lng")) / nx)
    g = g.withColumn("dy", F.col("dx") * F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2)))
    g = g.withColumn("ny", F.ceil((F.col("max_lat") - F.col("min_lat")) / F.col("dy")).cast("int"))
    c = g.withColumn("cell_id", F.explode(F.sequence(F.lit(0), F.col("ny") * nx - 1)))
    c = c.withColumns({"row": F.floor(F.col("cell_id") / nx).cast("int"), "col": F.col("cell_id") % nx})
    c = c.withColumns({"lng": F.col("min_lng") + (F.col("col") + 0.5) * F.col("dx"), "lat": F.col("min_lat") + (F.col("row") + 0.5) * F.col("dy")})
    return c.withColumn("in_mask", inside(F.col("lng"), F.col("lat"), F.col("ring")) if "ring" in extents.columns else F.lit(True))


def k_nearest(points: DataFrame, sites: DataFrame, group: str, k: int) -> DataFrame:
    """The k nearest sites (site_id, site_lat, site_lng) of the same group of each point (id, lat, lng) [J13, W06]."""
    d = S.haversine(F.col("lat"), F.col("lng"), F.col("site_lat"), F.col("site_lng"))
    both = points.join(sites, group).where("id <> site_id").withColumn("distance", d)
    w = Window.partitionBy(group, "id").orderBy("distance", "site_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def power_idw(cells: DataFrame, wells: DataFrame, group: str, power: float = 2.0, k: int = 8, add: float = 1e-6) -> DataFrame:
    """Mean of the k nearest wells' values (well_id, w_lat, w_lng, value) by 1 / (d^power + add), d in degrees [I08, G04]."""
    d = S.degree_distance(F.col("lat"), F.col("lng"), F.col("w_lat"), F.col("w_lng"))
    w = Window.partitionBy(group, "cell_id").orderBy("distance", "well_id")
    near = cells.join(wells, group).withColumn("distance", d).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    weight = 1 / (F.pow(F.col("distance"), F.lit(power)) + add)
    return near.groupBy(group, "cell_id").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))


def shepard_idw(cells: DataFrame, wells: DataFrame, group: str | list[str], power: float = 2.0) -> DataFrame:
    """Modified Shepard: weights ((R - h) / (R h))^power, R the farthest well's distance; a well within 1e-10 m decides [I06].

    A single well gives its value everywhere; cells of a group without wells have none.
    """
    keys = [group] if isinstance(group, str) else group
    h = S.haversine(F.col("lat"), F.col("lng"), F.col("w_lat"), F.col("w_lng"))
    both = cells.join(wells, keys).withColumn("h", h)
    both = both.withColumn("R", F.max("h").over(Window.partitionBy(*keys, "cell_id")))
    weight = F.when((F.col("h") < F.col("R")) & (F.col("h") >= 1e-10), F.pow((F.col("R") - F.col("h")) / (F.col("R") * F.col("h")), F.lit(power)))
    out = both.groupBy(*keys, "cell_id").agg(
        F.min_by(F.when(F.col("h") < 1e-10, F.col("value")), "h").alias("__own"), (F.sum(weight * F.col("value")) / F.sum(weight)).alias("__mean"), F.avg("value").alias("__all")
    )
    return out.select(*keys, "cell_id", F.coalesce("__own", "__mean", "__all").alias("value"))


def variogram(wells: DataFrame, group: str) -> DataFrame:
    """Sill, range and nugget of each group by the rule of thumb [I02]."""
    g = wells.groupBy(group).agg(F.var_pop("value").alias("v"), F.min("w_lat").alias("a"), F.max("w_lat").alias("b"), F.min("w_lng").alias("c"), F.max("w_lng").alias("d"))
    diagonal = S.haversine(F.col("a"), F.col("c"), F.col("b"), F.col("d"))
    return g.select(group, F.greatest("v", F.lit(0.01)).alias("sill"), F.greatest(diagonal / 3, F.lit(100.0)).alias("reach"), F.when(F.col("v") > 0, 0.05 * F.col("v")).otherwise(0.001).alias("nugget"))


def merge_close(lat: np.ndarray, lng: np.ndarray, value: np.ndarray, metres: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wells within ``metres`` of an earlier one join it; position and value are means [I04]."""
    groups: list[list[int]] = []
    for i in range(len(lat)):
        for g in groups:
            if _metres(lat[g[0]], lng[g[0]], lat[i], lng[i]) < metres:
                g.append(i)
                break
        else:
            groups.append([i])
    return tuple(np.array([x[g].mean() for g in groups]) for x in (lat, lng, value))


def _metres(lat1, lng1, lat2, lng2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * S.EARTH * np.arcsin(np.sqrt(np.minimum(a, 1)))


def krige(lat, lng, value, cell_lat, cell_lng, model: str = "gaussian") -> np.ndarray:
    """Ordinary kriging at all cells with one factorisation; nan where nothing can be said [I03, I05]."""
    lat, lng, value = merge_close(np.asarray(lat, float), np.asarray(lng, float), np.asarray(value, float))
    n = len(lat)
    if n == 0:
        return np.full(len(cell_lat), np.nan)
    if n == 1:
        return np.full(len(cell_lat), value[0])
    variance = value.var()
    sill, nugget = max(variance, 0.01), 0.05 * variance if variance > 0 else 0.001
    reach = max(float(_metres(lat.min(), lng.min(), lat.max(), lng.max())) / 3, 100.0)

    def cov(h: np.ndarray) -> np.ndarray:
        r = h / reach
        part = {"gaussian": np.exp(-r * r), "exponential": np.exp(-r), "spherical": np.where(r < 1, 1 - 1.5 * r + 0.5 * r**3, 0.0)}[model]
        return (sill - nugget) * part

    return _ordinary(lat, lng, value, cell_lat, cell_lng, lambda a, b, c, d: cov(_metres(a, b, c, d)), sill)


def _ordinary(lat, lng, value, cell_lat, cell_lng, cov, diagonal: float) -> np.ndarray:
    """Ordinary kriging with covariances cov(lat, lng, lat, lng) between places and ``diagonal`` of a well with itself."""
    n = len(lat)
    k = np.ones((n + 1, n + 1))
    k[:n, :n] = cov(lat[:, None], lng[:, None], lat, lng)
    k[np.arange(n), np.arange(n)] = diagonal
    k[n, n] = 0
    right = np.ones((n + 1, len(cell_lat)))
    right[:n] = cov(lat[:, None], lng[:, None], np.asarray(cell_lat, float), np.asarray(cell_lng, float))
    try:
        weights = np.linalg.solve(k, right)
    except np.linalg.LinAlgError:
        weights = np.linalg.lstsq(k, right, rcond=None)[0]
    out = weights[:n].T @ value
    return np.where(np.isfinite(out), out, np.nan)


def krige_stable(lat, lng, value, cell_lat, cell_lng, shape: float = 1.5) -> np.ndarray:
    """Ordinary kriging in degrees with covariance variance x exp(-(h / length)^shape) [I16].

    The length is a quarter of the sum of the wells' extents, the nugget the values' deviation.
    """
    lat, lng, value = np.asarray(lat, float), np.asarray(lng, float), np.asarray(value, float)
    if len(lat) < 2:
        return np.full(len(cell_lat), value[0] if len(lat) else np.nan)
    length = max((np.ptp(lat) + np.ptp(lng)) / 4, 1e-9)
    variance, nugget = value.var(), value.std()

    def cov(a, b, c, d):
        return variance * np.exp(-((np.hypot(c - a, d - b) / length) ** shape))

    return _ordinary(lat, lng, value, cell_lat, cell_lng, cov, variance + nugget)


def by_group(wells: DataFrame, cells: DataFrame, group: str, kernel) -> DataFrame:
    """(group, cell_id, value) by a kernel(lat, lng, value, cell_lat, cell_lng) over each group's wells in order [I05, I07, I16]."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("well_id")
        value = kernel(*(left[c].to_numpy(float) for c in ("w_lat", "w_lng", "value")), *(right[c].to_numpy(float) for c in ("lat", "lng")))
        return pd.DataFrame({group: key[0], "cell_id": right["cell_id"], "value": value})

    kind = dict(cells.dtypes)[group]
    return wells.groupBy(group).cogroup(cells.groupBy(group)).applyInPandas(run, f"{group} {kind}, cell_id int, value double")


def kriging(wells: DataFrame, cells: DataFrame, group: str, model: str = "gaussian") -> DataFrame:
    """(group, cell_id, value) by ordinary kriging of wells (w_lat, w_lng, value), groups apart [I05]; 'stable' is that of krige_stable [I16]."""
    return by_group(wells, cells, group, krige_stable if model == "stable" else lambda *x: krige(*x, model))


def merged_wells(wells: DataFrame, group: str, metres: float = 10.0) -> DataFrame:
    """(group, w_lat, w_lng, value) with wells near an earlier one merged [I04]."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("well_id")
        lat, lng, value = merge_close(*(pdf[c].to_numpy(float) for c in ("w_lat", "w_lng", "value")), metres)
        return pd.DataFrame({group: pdf[group].iloc[0], "w_lat": lat, "w_lng": lng, "value": value})

    return wells.groupBy(group).applyInPandas(run, f"{group} {dict(wells.dtypes)[group]}, w_lat double, w_lng double, value double")


def nodal_shepard(lat, lng, value, cell_lat, cell_lng, form: str = "gradient", power: float = 2.0, neighbours: int = 8) -> np.ndarray:
    """Modified Shepard of nodal functions: a plane or a quadratic through each well, fitted to its nearest wells [I07].

    A well's weight is ((R - d) / (R d))^power, R the farthest of the wells that count. A quadratic needs five
    neighbours; where a system is singular the plane takes its place, and the well's value that of the plane.
    """
    n = len(lat)
    if n == 0:
        return np.full(len(cell_lat), np.nan)
    lat0, lng0 = lat.mean(), lng.mean()
    scale = np.radians(1.0) * S.EARTH

    def plane(a, b):
        return (b - lng0) * scale * np.cos(np.radians(lat0)), (a - lat0) * scale

    x, y = plane(lat, lng)
    fitted = min(n - 1, max(8 if form == "quadratic" else 5, neighbours))
    slopes = np.zeros((n, 5))
    for i in range(n):
        near = np.argsort(np.hypot(x - x[i], y - y[i]), kind="stable")
        near = near[near != i][:fitted]
        if not len(near):
            continue
        dx, dy, df = x[near] - x[i], y[near] - y[i], value[near] - value[i]
        w = _shepard_weights(np.hypot(dx, dy), power)
        w = w / w.sum() if w.sum() > 0 else w
        for columns in ([dx, dy, dx * dx, dx * dy, dy * dy], [dx, dy]):
            if len(columns) == 5 and (form != "quadratic" or len(near) < 5):
                continue
            phi = np.column_stack(columns)
            size = np.abs(phi).max(axis=0)
            if (size == 0).any():
                continue
            phi = phi / size
            a = phi.T @ (phi * w[:, None])
            if np.linalg.matrix_rank(a) == len(columns):
                slopes[i, : len(columns)] = np.linalg.solve(a, phi.T @ (w * df)) / size
                break
    px, py = plane(np.asarray(cell_lat, float), np.asarray(cell_lng, float))
    dx, dy = px[:, None] - x, py[:, None] - y
    w = _shepard_weights(np.hypot(dx, dy), power)
    node = value + slopes[:, 0] * dx + slopes[:, 1] * dy + slopes[:, 2] * dx * dx + slopes[:, 3] * dx * dy + slopes[:, 4] * dy * dy
    total = w.sum(axis=1)
    return np.where(total > 0, (w * node).sum(axis=1) / np.where(total > 0, total, 1), node.mean(axis=1))


def _shepard_weights(d: np.ndarray, power: float) -> np.ndarray:
    """((R - d) / (R d))^power along the last axis, R the largest distance; very large at distance 0."""
    reach = d.max(axis=-1, keepdims=True)
    safe = np.maximum(d, 1e-10)
    return np.where(d < 1e-10, 1e10, np.where(d < reach, ((reach - d) / np.maximum(reach * safe, 1e-300)) ** power, 0.0))


def idw_matrix(lat, lng, cell_lat, cell_lng, power: float = 2.0, most: int = 15) -> np.ndarray:
    """Weights, cells x wells, of the nearest wells by 1 / d^power in degrees shrunk at the cell's latitude; a well at the cell decides [I14]."""
    d = np.hypot(lat - cell_lat[:, None], (lng - cell_lng[:, None]) * np.cos(np.radians(cell_lat[:, None])))
    rank = d.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    w = np.where(rank < most, 1 / (d**power + 1e-12), 0.0)
    w = np.where((d < 1e-8).any(axis=1, keepdims=True), (rank == 0).astype(float), w)
    return w / w.sum(axis=1, keepdims=True)


def pole_of_inaccessibility(ring: list[list[float]], precision: float = 0.001) -> tuple[float, float]:
    """The point (lng, lat) in a ring that lies farthest from its edges, within ``precision`` of the best distance [A22].

    Squares over the extent are split in four as long as their centre's distance and half diagonal promise more.
    """
    p = np.asarray(ring, float)
    a, b = p, np.roll(p, -1, axis=0)
    d = b - a
    squared = np.maximum((d * d).sum(axis=1), 1e-300)

    def distance(points: np.ndarray) -> np.ndarray:
        v = points[:, None] - a
        t = np.clip((v * d).sum(axis=2) / squared, 0, 1)
        far = np.sqrt((((v - t[..., None] * d) ** 2).sum(axis=2)).min(axis=1))
        x, y = points[:, :1], points[:, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((a[:, 1] > y) != (b[:, 1] > y)) & (x < d[:, 0] * (y - a[:, 1]) / d[:, 1] + a[:, 0])
        return np.where(crossed.sum(axis=1) % 2 == 1, far, -far)

    low, high = p.min(axis=0), p.max(axis=0)
    half = (high - low).min() / 2
    if half <= 0:
        return float(low[0]), float(low[1])
    axes = [np.arange(low[k] + half, high[k] + half, 2 * half) for k in (0, 1)]
    centres = np.vstack([p.mean(axis=0), np.stack(np.meshgrid(*axes), -1).reshape(-1, 2)])
    best, where = -np.inf, centres[0]
    while len(centres):
        far = distance(centres)
        if far.max() > best:
            best, where = far.max(), centres[far.argmax()]
        open_ = centres[far + half * np.sqrt(2) > best + precision]
        half /= 2
        centres = np.concatenate([open_ + half * np.array(k) for k in ((-1, -1), (-1, 1), (1, -1), (1, 1))]) if len(open_) else open_
    return float(where[0]), float(where[1])


def label_points(polygons: DataFrame, key: str, precision: float = 0.001) -> DataFrame:
    """(key, lng, lat): the pole of the largest ring of each key [A22]. polygons: key, pos, ring."""
    nxt = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    cross = F.zip_with("ring", nxt, lambda a, b: a[0] * b[1] - b[0] * a[1])
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v))
    largest = first_by(polygons.withColumn("__area", area), [key], [F.col("__area").desc(), F.col("pos")]).select(key, "ring")

    def run(batches):
        for pdf in batches:
            at = [pole_of_inaccessibility([list(p) for p in ring], precision) for ring in pdf["ring"]]
            yield pd.DataFrame({key: pdf[key], "lng": [x for x, _ in at], "lat": [y for _, y in at]})

    return largest.mapInPandas(run, f"{key} {dict(polygons.dtypes)[key]}, lng double, lat double")


def band_area(cells: DataFrame, keys: list[str], dx: str = "dx", dy: str = "dy") -> DataFrame:
    """Square metres of the cells in mask, by bands of latitude on the WGS84 ellipsoid [G10]."""
    top, bottom = F.radians(F.col("lat") + F.col(dy) / 2), F.radians(F.col("lat") - F.col(dy) / 2)
    radius = S.ellipsoid_radius(F.col("lat"))
    area = radius * radius * F.radians(dx) * F.abs(F.sin(bottom) - F.sin(top))
    return cells.where("in_mask").groupBy(*keys).agg(F.sum(area).alias("area"), F.count("*").alias("n_cells"))


def leave_one_out(wells: DataFrame, group: str, power: float = 2.0) -> DataFrame:
    """(group, well_id, obs, pred): each well's value from the others of its group by modified Shepard [V07].

    wells: group, well_id, w_lat, w_lng, value. Pairs meet within a group only.
    """
    held = wells.select(group, F.col("well_id").alias("cell_id"), F.col("w_lat").alias("lat"), F.col("w_lng").alias("lng"), F.col("value").alias("obs"))
    h = S.haversine(F.col("lat"), F.col("lng"), F.col("w_lat"), F.col("w_lng"))
    both = held.join(wells, group).where("cell_id <> well_id").withColumn("h", F.greatest(h, F.lit(1e-6)))
    both = both.withColumn("R", F.max("h").over(Window.partitionBy(group, "cell_id")))
    weight = F.when(F.col("h") < F.col("R"), F.pow((F.col("R") - F.col("h")) / (F.col("R") * F.col("h")), F.lit(power)))
    out = both.groupBy(group, "cell_id", "obs").agg(F.coalesce(F.sum(weight * F.col("value")) / F.sum(weight), F.avg("value")).alias("pred"))
    return out.withColumnRenamed("cell_id", "well_id")


def raster_frames(frames: DataFrame, wells: DataFrame, cells: DataFrame, group: str, power: float = 2.0, log: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """(group, frame_date, cell_id, value): a surface for each frame from its wells by modified Shepard [I13].

    frames (key, frame_date, value) are joined with wells (group, well_id, w_lat, w_lng); cells (group, cell_id, lat,
    lng, in_mask). With ``log`` the logarithms are interpolated and values of 0 or less don't count. Results are
    kept within low and high. A frame of one well is constant; a frame without wells has no rows.
    """
    value = S.log_or_null(F.col("value")) if log else F.col("value")
    placed = frames.join(wells.select(group, F.col("well_id").alias("key"), "w_lat", "w_lng"), "key").withColumn("value", value).where("value is not null")
    dates = placed.select(group, "frame_date").distinct()
    own = cells.where("in_mask").select(group, "cell_id", "lat", "lng").join(dates, group)
    out = shepard_idw(own, placed.drop("key"), [group, "frame_date"], power)
    return out.withColumn("value", S.truncated(F.exp("value") if log else F.col("value"), low, high))


def crs_votes(samples: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """Candidates (crs, pos, lng, lat per sample) of which half or more lie in the extent widened by 0.1 degree or twice its size [G07]."""
    pad_x = F.greatest(F.lit(0.1), 2 * (F.col("max_lng") - F.col("min_lng")))
    pad_y = F.greatest(F.lit(0.1), 2 * (F.col("max_lat") - F.col("min_lat")))
    hit = F.col("lng").between(F.col("min_lng") - pad_x, F.col("max_lng") + pad_x) & F.col("lat").between(F.col("min_lat") - pad_y, F.col("max_lat") + pad_y)
    votes = samples.join(candidates, group).groupBy(group, "crs", "pos").agg(F.avg(hit.cast("double")).alias("share"))
    return first_by(votes.where("share >= 0.5"), [group], ["pos"]).select(group, "crs", "share")
