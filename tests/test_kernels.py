"""Kernels against independent formulas and properties."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith.operators import impute, raster, series, spatial
from hydrolith.sources import files
from hydrolith.streaming import ingest


def test_kriging_meets_the_values_that_far_wells_allow():
    lat, lng = np.array([40.0, 40.2, 40.4, 40.1]), np.array([-112.0, -112.3, -112.1, -112.6])
    value = np.array([1.0, 3.0, 2.0, 5.0])
    got = spatial.krige(lat, lng, value, lat, lng)
    assert np.abs(got - value).max() < 0.8  # the nugget smooths
    assert spatial.krige(lat[:1], lng[:1], value[:1], lat, lng).tolist() == [1.0] * 4
    assert np.isnan(spatial.krige(lat[:0], lng[:0], value[:0], lat, lng)).all()
    same = spatial.krige(lat, lng, np.full(4, 7.0), lat + 0.05, lng)
    assert same == pytest.approx(np.full(4, 7.0))  # weights sum to one


def test_wells_close_to_each_other_are_merged():
    lat, lng, value = spatial.merge_close(np.array([40.0, 40.00001, 41.0]), np.array([-112.0, -112.0, -112.0]), np.array([1.0, 3.0, 9.0]))
    assert len(lat) == 2
    assert value.tolist() == [2.0, 9.0]


def test_soft_impute_keeps_observed_cells_and_restores_rank_one():
    u, v = np.arange(1.0, 9.0), np.linspace(1, 2, 12)
    x = np.outer(u, v)
    holes = x.copy()
    holes[::3, ::4] = np.nan
    got = impute.soft_impute(holes, 1, rounds=3000, tol=1e-10)
    seen = np.isfinite(holes)
    assert (got[seen] == x[seen]).all()
    assert got == pytest.approx(x, rel=1e-2)


def test_imputers_restore_a_season():
    m = np.arange(120)
    y = 10 + 3 * np.cos(2 * np.pi * m / 12)
    x = impute.seasonal_features(m)
    seen = m % 7 > 1
    for guess in (impute.elm(x[seen], y[seen] - 10, impute.rng_for(1), 100, 1.0)(x) + 10, impute.reservoir(x, np.where(seen, y, np.nan), impute.rng_for(2)), x @ impute.ridge(x[seen], y[seen], 0.01)):
        assert np.corrcoef(guess[~seen], y[~seen])[0, 1] > 0.9


def test_pchip_is_monotone_and_meets_its_knots(spark):
    rows = [(1, 0, 0.0), (1, 30, 1.0), (1, 45, 1.0), (1, 90, 8.0), (1, 120, 9.0), (2, 30, 5.0), (3, 0, 0.0), (3, 60, 6.0), (4, 31, 1.0)]
    got = {(r["key"], r["t"]): r["y"] for r in series.pchip(spark.createDataFrame(rows, "key long, x long, y double"), 30).collect()}
    assert got[1, 0] == 0 and got[1, 30] == 1 and got[1, 90] == 8 and got[1, 120] == 9
    line = [got[1, t] for t in (0, 30, 60, 90, 120)]
    assert line == sorted(line)
    assert got[2, 30] == 5 and got[3, 30] == pytest.approx(3) and (4, 30) not in got


def test_contours_of_a_slope_are_straight(spark):
    frame = spark.range(12).select(F.lit(0).alias("raster"), F.lit("a").alias("frame_date"), F.col("id").cast("int").alias("cell_id"), (F.col("id") % 4).cast("double").alias("value"))
    got = raster.contour_segments(frame, 4, 1).collect()
    assert len(got) == 2
    assert {(r["x0"], r["x1"]) for r in got} == {(1.5, 1.5)}


def test_region_files_are_read(spark, tmp_path):
    (tmp_path / "wells.csv").write_text('well_id,well_name,lat,long,gse,aquifer_id\nA,"One, two",40.5,-112,12ft,1\nB,,41,-111,,1\n,x,1,1,1,1\nC,c,0,5,1,1\n')
    (tmp_path / "data_wte.csv").write_text("well_id,date,value,aquifer_id\nA,2001-02,3.5m,1\nA,5/7/2001,<1,1\nB,2001-03-04,2,1\n")
    assert [tuple(r) for r in files.wells(spark, str(tmp_path / "wells.csv"), "r").select("well_id", "well_name", "gse").orderBy("well_id").collect()] == [("A", "One, two", 12.0), ("B", "B", 0.0)]
    assert [(r["data_type"], str(r["obs_date"]), r["value"]) for r in files.measurements(spark, str(tmp_path), "r").orderBy("value").collect()] == [("wte", "2001-03-04", 2.0), ("wte", "2001-02-01", 3.5)]
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]
    shape = {"features": [{"properties": {"aquifer_id": "7"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(shape))
    got = files.polygons(spark, str(tmp_path / "a.geojson")).collect()
    assert [(r["aquifer_id"], r["aquifer_name"], r["ring"]) for r in got] == [("7", "Aquifer 7", ring), ("unknown", "Aquifer unknown", ring), ("unknown", "Aquifer unknown", ring)]


def test_streams_count_and_append_once(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 20:02d} 00:00:00", i % 3, "view", float(i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "event_id long, s string, user_id long, event_type string, value double")
    frame.select("event_id", F.col("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).write.parquet(str(tmp_path / "in"))
    stream = ingest.events(spark, str(tmp_path / "in"))
    query = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 40
    for k in (1, 2):
        ingest.append_new_keys(ingest.events(spark, str(tmp_path / "in")), str(tmp_path / "store"), ["event_id"], str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 40


def test_nodal_shepard_restores_planes_and_quadratics():
    rng = np.random.default_rng(1)
    lat, lng = 40 + rng.random(14), -112 + rng.random(14)
    plane = 3 * lat + 2 * lng
    at_lat, at_lng = lat[:5] + 0.02, lng[:5] - 0.03
    for form in ("gradient", "quadratic"):
        assert spatial.nodal_shepard(lat, lng, plane, at_lat, at_lng, form) == pytest.approx(3 * at_lat + 2 * at_lng, abs=1e-6)
    assert spatial.nodal_shepard(lat, lng, plane, lat, lng) == pytest.approx(plane, rel=1e-6)
    assert spatial.nodal_shepard(lat[:1], lng[:1], plane[:1], lat, lng).tolist() == [plane[0]] * 14
    assert np.isnan(spatial.nodal_shepard(lat[:0], lng[:0], plane[:0], lat, lng)).all()


def test_poles_of_a_square_and_a_corner():
    assert spatial.pole_of_inaccessibility([[0, 0], [2, 0], [2, 2], [0, 2]]) == pytest.approx((1, 1), abs=0.002)
    x, y = spatial.pole_of_inaccessibility([[0, 0], [4, 0], [4, 1], [1, 1], [1, 4], [0, 4]])
    assert x == pytest.approx(y) == pytest.approx(2 - np.sqrt(2), abs=0.01)


def test_label_points_take_the_largest_ring(spark):
    small, large = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], [[5.0, 5.0], [7.0, 5.0], [7.0, 7.0], [5.0, 7.0]]
    got = spatial.label_points(spark.createDataFrame([("a", 0, small), ("a", 1, large)], "k string, pos int, ring array<array<double>>"), "k").collect()
    assert [(r["k"], round(r["lng"], 2), round(r["lat"], 2)) for r in got] == [("a", 6.0, 6.0)]


def test_every_imputer_keeps_the_season():
    m = np.arange(120)
    y = 10 + 3 * np.cos(2 * np.pi * m / 12) + 0.02 * m
    x = impute.seasonal_features(m)
    seen = m % 7 > 1
    for name, fit in impute.METHODS.items():
        guess = fit(x, np.where(seen, y, np.nan), m.astype(float), impute.rng_for(1))
        assert np.corrcoef(guess[~seen], y[~seen])[0, 1] > 0.9, name
    wells = np.vstack([np.where((m > 30) & (m < 60), np.nan, y + 1), 2 * y, 5 - y, np.random.default_rng(0).normal(size=120)])
    for got in (impute.complete_with_donors(wells, 0, m), impute.supported(wells, 0, m, impute.rng_for(3))):
        assert np.abs(got - y - 1).max() < 1


def test_monthly_times_run_over_short_months(spark):
    def day(s):
        return (np.datetime64(s) - np.datetime64("1970-01-01")).astype(int).item()

    rows = [(1, day("2001-01-31"), 0.0), (1, day("2001-04-30"), 1.0), (2, day("2001-05-05"), 0.0), (2, day("2001-07-05"), 1.0), (3, 5, 1.0)]
    got = series.monthly_times(spark.createDataFrame(rows, "key long, x long, y double")).collect()
    assert sorted((r["key"], r["t"]) for r in got) == [(1, day("2001-01-31")), (1, day("2001-03-03")), (1, day("2001-04-03")), (2, day("2001-05-05")), (2, day("2001-06-05")), (2, day("2001-07-05"))]


def test_small_gaps_are_filled_and_large_ones_blank_inside(spark):
    rows = [(1, m, float(m)) for m in (0, 1, 3, 10, 11)] + [(2, 0, 1.0), (2, 2, 3.0)]
    got = {(r["key"], r["m"]): r["value"] for r in series.fill_small_gaps(spark.createDataFrame(rows, "key long, m long, value double"), 3, 1).collect()}
    assert got[1, 2] == pytest.approx(2) and got[1, 4] == pytest.approx(4) and got[1, 9] == pytest.approx(9)
    assert all(got[1, m] is None for m in range(5, 9))
    assert got[2, 1] is None and len(got) == 15


def test_counterparts_and_resolved_wells(spark):
    from hydrolith.operators import merge

    models = spark.createDataFrame([("a", "x", 1, 0, "s"), ("b", "y", 2, 1, "s"), ("c", "y", 1, 2, "s"), ("d", "x", 1, 3, "t")], "path string, method string, min_samples long, pos long, scope string")
    assert dict(map(tuple, merge.counterparts(models, ["scope"]).collect())) == {"a": "c", "b": "a", "c": "a", "d": None}
    points = spark.createDataFrame([("1", "A", 1.0, 2.0, 0), ("2", "A", 1.0, 2.0, 1), ("3", None, 1.0, 2.0, 2), ("4", "z", None, None, 3), ("5", "q", 1.0, 1.0, 4)], "id string, name string, lat double, lng double, pos long")
    matches = spark.createDataFrame([("1", "new", None), ("2", "new", None), ("3", "new", None), ("4", "unmatched", None), ("5", "id", "w5")], "id string, kind string, well_id string")
    wells = spark.createDataFrame([("w5",)], "well_id string")
    got = {r["id"]: r["well_id"] for r in merge.resolve_wells(points, matches, wells).collect()}
    assert got["5"] == "w5" and "4" not in got and got["2"] == got["1"] + "-2" and got["3"].startswith("aqx-1.00N")


def test_columns_are_mapped_by_name():
    assert files.map_columns(["Well ID", "Station", "Sample Date", "Latitude (deg)", "lon", "v"], "measurements") == {"well_id": "Well ID", "well_name": "Station", "date": "Sample Date", "lat": "Latitude (deg)", "long": "lon"}
    assert files.map_columns(["id", "Aquifer Name"], "aquifer") == {"aquifer_id": "id", "aquifer_name": "Aquifer Name"}
    assert files.map_columns([], "wells") == {}


def test_region_folders_are_loaded_renamed_and_deleted(spark, tmp_path):
    for name in ("guam", "oregon"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "region.json").write_text(json.dumps({"id": name, "name": name.title(), "lengthUnit": "ft", "singleUnit": True}))
        (tmp_path / name / "wells.csv").write_text("well_id,well_name,lat,long,gse,aquifer_id\nA,,40.5,-112,12,1\n")
        (tmp_path / name / "data_wte.csv").write_text("well_id,date,value,aquifer_id\nA,2001-02-03,3.5,1\n")
    (tmp_path / "guam" / "raster_wte_old.json").write_text(json.dumps({"title": "Old", "code": "old", "frames": [{"date": "2001-01-01", "values": [1, None]}]}))
    (tmp_path / "guam" / "raster_salt_new.json").write_text("{}")
    found = files.load_all(spark, str(tmp_path))
    assert {(r["region_id"], r["well_id"]) for r in found["wells"].collect()} == {("guam", "A"), ("oregon", "A")}
    assert {(r["region_id"], r["data_type"], r["value"]) for r in found["measurements"].collect()} == {("guam", "wte", 3.5), ("oregon", "wte", 3.5)}
    assert found["regions"].count() == 2
    assert files.rename(spark, str(tmp_path / "guam"), "raster", "wte", "old", "Fresh Map") == "raster_wte_fresh_map.json"
    kept = json.loads((tmp_path / "guam" / "raster_wte_fresh_map.json").read_text())
    assert kept == {"title": "Fresh Map", "code": "fresh_map", "frames": [{"date": "2001-01-01", "values": [1, None]}]}
    got = {(r["file"], r["code"], r["data_type"]) for r in files.metadata(spark, str(tmp_path), "raster").collect()}
    assert got == {("raster_wte_fresh_map.json", "fresh_map", "wte"), ("raster_salt_new.json", "new", "salt")}
    assert files.delete(spark, str(tmp_path), "oregon") and not (tmp_path / "oregon").exists()
    with pytest.raises(ValueError):
        files.delete(spark, str(tmp_path), "../x")
    region, aquifers = files.new_region(spark, "Great Basin", "ft", True)
    assert region.first()["id"] == "great_basin" and aquifers.first()["aquifer_id"] == "0"
    with pytest.raises(ValueError):
        files.uploaded(spark, "a.exe")


def test_zipped_shapefiles_are_read(spark, tmp_path):
    import struct
    import zipfile

    from hydrolith.sources import shapefile

    outer, hole = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    points = [v for p in outer + hole for v in p]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 9, 0, 5) + struct.pack(f"<{len(points)}d", *points)
    shp = bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body + struct.pack(">2i", 2, 2) + struct.pack("<i", 0)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6]) + bytes(15)
    dbf = struct.pack("<4sihh", b"\x03\x01\x01\x01", 2, 32 + 32 + 1, 7).ljust(32, b"\0") + field + b"\x0d" + b" basin " + b" none  "
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.shp", shp)
        z.writestr("a.dbf", dbf)
        z.writestr("a.prj", "GEOGCS")
    got = shapefile.shapefiles(spark, str(tmp_path / "a.zip")).collect()
    assert [(r["pos"], [tuple(p) for p in r["ring"]], r["properties"], r["prj"]) for r in got] == [(0, outer, {"NAME": "basin"}, "GEOGCS")]


def test_full_series_say_where_values_come_from(spark):
    rows = [(1, k, m, 10 + k + np.sin(m / 2)) for k in (1, 2) for m in range(60) if not (k == 1 and (m in (5, 6) or 20 <= m < 40))]
    got = impute.full_series(spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "grp long, key long, m long, value double"), "grp", 6, 1).collect()
    stages = {(r["key"], r["m"]): r["fill_stage"] for r in got}
    assert len(stages) == len(got) == 120
    assert stages[1, 4] == "observed" and stages[1, 5] == "small_gap_pchip" and stages[1, 20] == "small_gap_pchip" and stages[1, 30] == "large_gap_mc_lnn_iterative"
    assert max(abs(r["value"] - (10 + r["key"] + np.sin(r["m"] / 2))) for r in got) < 1


def test_surfaces_meet_series_at_their_wells(spark):
    rng = np.random.default_rng(5)
    places = [(1, k, float(40 + rng.random()), float(-112 + rng.random())) for k in range(6)]
    values = [(1, k, m, float(100 + k + np.sin(m / 3 + k))) for k in range(6) for m in range(12) if (k, m) != (2, 5)]
    monthly = spark.createDataFrame(values, "grp long, key long, m long, value double")
    wells = spark.createDataFrame(places, "grp long, well_id long, w_lat double, w_lng double")
    cells = spark.createDataFrame([(1, i, a, b) for _, i, a, b in places], "grp long, cell_id int, lat double, lng double")
    known = {(k, m): v for _, k, m, v in values}
    for method in ("matrix", "grid", "transfer", "modes"):
        got = impute.surfaces(monthly, wells, cells, "grp", method, 6).collect()
        assert len(got) == 72
        for r in got:
            if (r["cell_id"], r["m"]) in known:
                assert r["value"] == pytest.approx(known[r["cell_id"], r["m"]], abs=1e-3), method
