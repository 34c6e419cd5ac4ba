"""Positions: nearest sites anywhere on the globe, known systems of coordinates, plans without nested loops."""

from __future__ import annotations

import contextlib
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.operators import merge, spatial

POINT, SITE = "id long, lat double, lng double", "site_id long, site_lat double, site_lng double, site_pos long"


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("radius", [100.0, 30_000.0, 900_000.0])
def test_nearest_sites_as_by_brute_force(spark, radius):
    rng = random.Random(1)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(0.0, 179.9999), (60.0, -180.0), (89.9999, 10.0), (-89.99, 0.0), (5.0, 180.0)]
    near = [(max(-90.0, min(90.0, a + rng.uniform(-1, 1) * radius / 150_000)), (b + rng.uniform(-1, 1) * radius / 150_000 + 540) % 360 - 180) for a, b in places]
    near += [(0.0, -179.9999), (60.0, 179.9995), (89.9999, -170.0)]
    found = merge.nearest_within(spark.createDataFrame([(i, *p) for i, p in enumerate(places)], POINT), spark.createDataFrame([(i, *p, i) for i, p in enumerate(near)], SITE), radius)
    want = {}
    for i, p in enumerate(places):
        best = min((metres(*p, *q), j) for j, q in enumerate(near))
        if best[0] <= radius:
            want[i] = best[1]
    assert {r["id"]: r["site_id"] for r in found.collect()} == want
    assert "NestedLoop" not in plan(found)


def test_points_meet_polygons_by_cells(spark):
    ring = [[0.0, 0.0], [3.0, 0.0], [3.0, 3.0], [0.0, 3.0]]
    polygons = spark.createDataFrame([(1, 0, ring), (2, 1, [[x + 2, y + 2] for x, y in ring])], "aquifer_id int, pos int, ring array<array<double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.5, 2.5), (3, 9.0, 9.0)], POINT)
    found = spatial.holding_polygons(points, polygons, "aquifer_id")
    assert {(r["id"], r["aquifer_id"]) for r in found.collect()} == {(1, 1), (2, 1), (2, 2)}
    assert "NestedLoop" not in plan(found)


def lambert(lat, lng):
    """Metres of the Jamaica Metric Grid by the closed formulas of the projection."""
    a, f = 6_378_137.0, 1 / 298.257223563
    e = math.sqrt(f * (2 - f))
    n = math.sin(math.radians(18))

    def t(phi):
        s = math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    m = math.cos(math.radians(18)) / math.sqrt(1 - e * e * n * n)
    rho, rho0 = (a * m / n * (t(math.radians(x)) / t(math.radians(18))) ** n for x in (lat, 18.0))
    theta = n * math.radians(lng + 77)
    return 750_000 + rho * math.sin(theta), 650_000 + rho0 - rho * math.cos(theta)


@pytest.mark.parametrize(
    ("epsg", "x", "y", "lat", "lng"),
    [
        (4326, 3.0, 4.0, 4.0, 3.0),
        (3857, 1_113_194.9079327357, 5_621_521.486192066, 45.0, 10.0),
        (32631, 500_000.0, 0.0, 0.0, 3.0),
        (32617, 630_084.30, 4_833_438.55, 43.642567, -79.387139),
        (32717, 500_000.0, 10_000_000.0, 0.0, -81.0),
        (3448, *lambert(18.0, -77.0), 18.0, -77.0),
        (3448, *lambert(17.95, -76.8), 17.95, -76.8),
        (3448, *lambert(18.5, -78.3), 18.5, -78.3),
    ],
)
def test_known_systems(spark, epsg, x, y, lat, lng):
    found = spark.range(1).select(*S.to_degrees(F.lit(x), F.lit(y), epsg)).first()
    assert found[0] == pytest.approx(lat, abs=1e-6)
    assert found[1] == pytest.approx(lng, abs=1e-6)


def test_unknown_systems_are_refused(spark):
    with pytest.raises(ValueError, match="EPSG:9999"):
        S.to_degrees(F.lit(0.0), F.lit(0.0), 9999)


def test_formulas_name_parameters(spark):
    headers = spark.createDataFrame([("NO3 (mg/L)",), ("Iron",), ("Sulphate",), ("zzz",)], "header string")
    known = spark.createDataFrame([("nitrate", "Nitrate", 0), ("iron", "Iron", 1), ("sulfate", "Sulfate", 2)], "code string, name string, pos int")
    found = {r["header"]: (r["code"], r["tier"]) for r in merge.fuzzy_parameters(headers, known).collect()}
    assert found == {"NO3 (mg/L)": ("nitrate", 1), "Iron": ("iron", 1), "Sulphate": ("sulfate", 2)}
