"""Connectors against answers that need no network."""

from __future__ import annotations

import json
import urllib.parse

import pytest

from hydrolith.sources import services


def answer(url, body=None):
    asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
    if "monitoring-locations" in url:
        n = 1000 if asked["offset"] == "0" else 3
        first = int(asked["offset"])
        return json.dumps({"features": [{"properties": {"id": f"s{first + i}", "monitoring_location_name": "n", "altitude": 10}, "geometry": {"coordinates": [-111.0, 40.0]}} for i in range(n)]})
    if "field-measurements" in url:
        ids = body["args"][0]["args"][1]
        if len(ids) > 60:
            raise services.Refused(413)
        return json.dumps({"features": [{"properties": {"monitoring_location_id": i, "time": "2001-02-03T04:05:06Z", "value": "1.5" if i != "s1" else "dry"}} for i in ids]})
    if "Station" in url:
        return 'MonitoringLocationIdentifier,MonitoringLocationName,LatitudeMeasure,LongitudeMeasure\nA,"x, y",40,-111\nB,z,,1\n'
    if "Result" in url:
        return "MonitoringLocationIdentifier,ActivityStartDate,CharacteristicName,ResultMeasureValue\nA,2001-01-01,Iron,0.5\nA,2001-01-02,Iron,<0.05\nA,,Iron,3\n"
    if "thredds" in url:
        return "# a\nTime (UTC),v\n1974-01-01T00:00:00.000Z,567.5\n1974-02-01T00:00:00.000Z,none\n"
    if "open-meteo" in url:
        return json.dumps({"elevation": [12.345 if x != "0.0" else None for x in asked["latitude"].split(",")]})
    return json.dumps({"value": "100.0"})


def test_wells_are_read_page_by_page(spark):
    got = services.usgs_wells(spark, (-112, 39, -110, 41), answer)
    assert got.count() == 1003
    row = got.first()
    assert row["gse"] == pytest.approx(3.048) and row["lat"] == 40 and row["lng"] == -111
    assert services.usgs_wells(spark, (-112, 39, -110, 41), answer, 2).count() == 1003


def test_refused_batches_are_halved(spark):
    sites = spark.createDataFrame([(f"s{i}",) for i in range(200)], "site_id string").coalesce(1)
    got = services.usgs_measurements(spark, sites, answer)
    assert got.count() == 199 and got.select("date").distinct().first()[0] == "2001-02-03"


def test_stations_and_results(spark):
    url = services.wqp_url("Station", (-1, 2, 3, 4), ["Iron", "Nitrate as N"], "2001-02-03")
    assert "characteristicName=Iron;Nitrate%20as%20N" in url and "startDateLo=02-03-2001" in url
    assert [r["site_name"] for r in services.wqp_stations(spark, [url], answer).collect()] == ["x, y"]
    assert [r["value"] for r in services.wqp_results(spark, [services.wqp_url("Result", (-1, 2, 3, 4))], answer).collect()] == [0.5]


def test_moisture_and_elevations(spark):
    places = spark.createDataFrame([("a", 40.0, -111.0)], "aquifer_id string, lat double, lng double")
    assert [tuple(r) for r in services.soil_moisture(spark, places, "1974-01-01", "1974-03-01", answer).collect()] == [("a", "1974-01-01", 567.5)]
    points = spark.createDataFrame([(1, 40.0, -111.0)], "id long, lat double, lng double")
    assert [tuple(r) for r in services.elevations(spark, points, "ft", answer).collect()] == [(1, 328.08)]
    abroad = spark.createDataFrame([(1, 40.0, -111.0), (2, 31.0, 36.0), (3, 0.0, 36.0)], "id long, lat double, lng double")
    assert sorted(map(tuple, services.elevations(spark, abroad, "m", answer).collect())) == [(1, 12.35), (2, 12.35)]


def test_tries_end(monkeypatch):
    waits, sent = [], []
    monkeypatch.setattr(services.time, "sleep", waits.append)

    def busy(url, body=None):
        sent.append(url)
        raise services.Refused(429 if len(sent) < 9 else 404)

    with pytest.raises(services.Refused):
        services.retrying(busy)("u")
    assert waits == [2.0, 4.0] and len(sent) == 3
    sent += [""] * 8
    with pytest.raises(services.Refused):
        services.retrying(busy)("u")
    assert len(waits) == 2
