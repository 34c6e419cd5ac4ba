"""Public web services as DataFrames: each task sends its own requests, and what they answer is parsed by column functions.

``send(url, body)`` returns the text of an answer; tests give one that needs no network.
"""

from __future__ import annotations

import csv
import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S

Send = Callable[[str, "dict | None"], str]

#: Addresses of the services.
USGS = "https://api.waterdata.usgs.gov/ogcapi/v0/collections"
WQP = "https://www.waterqualitydata.us/data"
GLDAS = "https://apps.geoglows.org/thredds/wms/geoglows_data/soilw.mon.mean.v2.nc"
EPQS, METEO = "https://epqs.nationalmap.gov/v1/json", "https://api.open-meteo.com/v1/elevation"
#: Features of a page of wells and of measurements, sites of a batch at first and at least, the code of depth to water.
WELLS, VALUES, SITES, FEWEST, DEPTH = 1000, 10_000, 1000, 50, "72019"


class Refused(Exception):
    """An answer with a status that isn't success."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def send(url: str, body: dict | None = None) -> str:
    """GET, or POST of a query in CQL2 JSON."""
    data = json.dumps(body).encode() if body is not None else None
    kind = {"Content-Type": "application/query-cql-json"} if body is not None else {}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, kind), timeout=120) as answer:
            return answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise Refused(e.code) from e


def retrying(send: Send, tries: int = 3, wait: float = 2.0) -> Send:
    """Sends again after 429 and 5xx, waiting twice as long each time; other refusals are raised at once [S20]."""

    def again(url: str, body: dict | None = None) -> str:
        for k in range(tries):
            try:
                return send(url, body)
            except Refused as e:
                if k == tries - 1 or not (e.status == 429 or e.status >= 500):
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError("no try was made")

    return again


def _pages(send: Send, url: str, limit: int, body: dict | None = None) -> Iterator[str]:
    """Pages of features, until one isn't full."""
    offset = 0
    while True:
        text = send(f"{url}&limit={limit}&offset={offset}&f=json", body)
        yield text
        if len(json.loads(text).get("features") or []) < limit:
            return
        offset += limit


def _answers(spark: SparkSession, requests: list[str], ask: Callable[[str], Iterator[str]]) -> DataFrame:
    """(answer): texts that ask() yields for each request, a task a request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for request in pdf["request"]:
                for text in ask(request):
                    yield pd.DataFrame({"answer": [text]})

    frame = spark.createDataFrame([(r,) for r in requests], "request string")
    return frame.repartition(max(len(requests), 1), "request").mapInPandas(run, "answer string")


def tiles(box: tuple[float, float, float, float], n: int) -> list[tuple[float, float, float, float]]:
    """n x n parts of a box (west, south, east, north), to be read side by side."""
    w, s, e, t = box
    x, y = [w + (e - w) * k / n for k in range(n + 1)], [s + (t - s) * k / n for k in range(n + 1)]
    return [(x[i], y[j], x[i + 1], y[j + 1]) for i in range(n) for j in range(n)]


def usgs_wells(spark: SparkSession, box: tuple[float, float, float, float], send: Send = send, parts: int = 1) -> DataFrame:
    """(site_id, site_name, lat, lng, gse in metres) of groundwater sites in a box; parts x parts tasks [S13]."""
    again = retrying(send)
    asked = [f"{USGS}/monitoring-locations/items?bbox={','.join(map(str, b))}&site_type_code=GW" for b in tiles(box, parts)]
    properties = "struct<id:string,monitoring_location_identifier:string,monitoring_location_name:string,altitude:string,altitude_of_gage_or_measuring_point:string>"
    schema = f"features array<struct<properties:{properties},geometry:struct<coordinates:array<double>>>>"
    texts = _answers(spark, asked, lambda url: _pages(again, url, WELLS))
    f = texts.select(F.explode(F.from_json("answer", f"struct<{schema.replace(' ', ':', 1)}>")["features"]).alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("at"))
    feet = F.coalesce(S.number_prefix(F.coalesce("altitude", "altitude_of_gage_or_measuring_point")), F.lit(0.0))
    site = F.coalesce("id", "monitoring_location_identifier", F.lit(""))
    found = f.where(F.size("at") >= 2).select(site.alias("site_id"), F.coalesce("monitoring_location_name", F.lit("")).alias("site_name"), F.col("at")[1].alias("lat"), F.col("at")[0].alias("lng"), (feet * 0.3048).alias("gse"))
    return found.dropDuplicates(["site_id", "lat", "lng"])  # sites on the edge of two parts come twice


def usgs_measurements(spark: SparkSession, sites: DataFrame, send: Send = send) -> DataFrame:
    """(site_id, date, value) of depths to water at sites (site_id); batches of sites that are refused as too large are halved [S14]."""
    again = retrying(send)

    def ask(ids: list[str]) -> Iterator[str]:
        body = {"op": "and", "args": [{"op": "in", "args": [{"property": "monitoring_location_id"}, ids]}, {"op": "=", "args": [{"property": "parameter_code"}, DEPTH]}]}
        try:
            found = list(_pages(again, f"{USGS}/field-measurements/items?", VALUES, body))
        except Refused as e:
            if e.status not in (400, 413) or len(ids) <= FEWEST:
                raise
            half = max(FEWEST, len(ids) // 2)
            for k in range(0, len(ids), half):
                yield from ask(ids[k : k + half])
            return
        yield from found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["site_id"].to_list()
            for k in range(0, len(ids), SITES):
                for text in ask(ids[k : k + SITES]):
                    yield pd.DataFrame({"answer": [text]})

    properties = "struct<monitoring_location_id:string,id:string,time:string,activity_start_date:string,value:string,result_measure_value:string>"
    texts = sites.select("site_id").distinct().mapInPandas(run, "answer string")
    p = texts.select(F.explode(F.from_json("answer", f"struct<features:array<struct<properties:{properties}>>>")["features"]).alias("f")).select("f.properties.*")
    date = F.substring_index(F.coalesce("time", "activity_start_date", F.lit("")), "T", 1)
    found = p.select(F.coalesce("monitoring_location_id", "id", F.lit("")).alias("site_id"), date.alias("date"), S.number_prefix(F.coalesce("value", "result_measure_value")).alias("value"))
    return found.where("site_id <> '' and date <> '' and value is not null")


def wqp_url(kind: str, box: tuple[float, float, float, float], names: list[str] = (), start: str | None = None, end: str | None = None, site_type: str = "Well") -> str:
    """Address of stations ('Station') or results ('Result') in a box; dates from ISO form [S15]."""

    def american(iso: str) -> str:
        y, m, d = iso.split("-")
        return f"{m}-{d}-{y}"

    parts = [f"bBox={','.join(map(str, box))}", f"siteType={urllib.parse.quote(site_type, safe='')}"]
    parts += [f"characteristicName={';'.join(urllib.parse.quote(n, safe='') for n in names)}"] if names else []
    parts += [f"startDateLo={american(start)}"] if start else []
    parts += [f"startDateHi={american(end)}"] if end else []
    return f"{WQP}/{kind}/search?{'&'.join([*parts, 'mimeType=csv', 'zip=no'])}"


def _wqp_rows(spark: SparkSession, urls: list[str], columns: dict[str, str], send: Send) -> DataFrame:
    """The named columns of the answers' CSV, all text, '' where there are none."""
    again = retrying(send)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["request"]:
                rows = []
                for row in csv.DictReader(io.StringIO(again(url, None))):
                    rows.append([row.get(c) or "" for c in columns.values()])
                    if len(rows) == VALUES:
                        yield pd.DataFrame(rows, columns=list(columns))
                        rows = []
                yield pd.DataFrame(rows, columns=list(columns))

    frame = spark.createDataFrame([(u,) for u in urls], "request string").repartition(max(len(urls), 1), "request")
    return frame.mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def wqp_stations(spark: SparkSession, urls: list[str], send: Send = send) -> DataFrame:
    """Stations with a place [S15]."""
    names = {"site_id": "MonitoringLocationIdentifier", "site_name": "MonitoringLocationName", "lat": "LatitudeMeasure", "lng": "LongitudeMeasure", "site_type": "MonitoringLocationTypeName", "organization": "OrganizationFormalName"}
    rows = _wqp_rows(spark, urls, names, send)
    return rows.withColumns({c: S.number_prefix(F.col(c)) for c in ("lat", "lng")}).where("site_id <> '' and lat is not null and lng is not null")


def wqp_results(spark: SparkSession, urls: list[str], send: Send = send) -> DataFrame:
    """Results that are numbers: censored ones, as '<0.05', are left out [S15]."""
    names = {
        "site_id": "MonitoringLocationIdentifier",
        "date": "ActivityStartDate",
        "characteristic_name": "CharacteristicName",
        "value": "ResultMeasureValue",
        "unit": "ResultMeasure/MeasureUnitCode",
        "sample_fraction": "ResultSampleFractionText",
        "organization": "OrganizationFormalName",
    }
    rows = _wqp_rows(spark, urls, names, send).withColumn("value", S.number_prefix(F.col("value")))
    return rows.where("site_id <> '' and date <> '' and characteristic_name <> '' and value is not null")


def soil_moisture(spark: SparkSession, centroids: DataFrame, start: str, end: str, send: Send = send) -> DataFrame:
    """(aquifer_id, date, value) by month at centroids (aquifer_id, lat, lng) [S16]."""
    again = retrying(send)
    kind = dict(centroids.dtypes)["aquifer_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, lat, lng in pdf[["aquifer_id", "lat", "lng"]].itertuples(index=False):
                box = f"{lng - 0.125},{lat - 0.125},{lng + 0.125},{lat + 0.125}"
                url = f"{GLDAS}?service=WMS&version=1.3.0&request=GetTimeseries&CRS=CRS:84&QUERY_LAYERS=soilw&X=0&Y=0&I=0&J=0&BBOX={box}&LAYER=soilw&WIDTH=1&HEIGHT=1&INFO_FORMAT=text/csv&STYLES=raster/default&TIME={start}T00:00:00.000Z/{end}T00:00:00.000Z"
                yield pd.DataFrame({"aquifer_id": [key], "answer": [again(url, None)]})

    texts = centroids.select("aquifer_id", "lat", "lng").mapInPandas(run, f"aquifer_id {kind}, answer string")
    lines = texts.select("aquifer_id", F.explode(F.split("answer", "\r?\n")).alias("line")).withColumn("line", F.trim("line"))
    parts = F.split("line", ",")
    kept = lines.where("line <> '' and not startswith(line, '#') and not startswith(line, 'Time')").where(F.size(parts) >= 2)
    value = S.number_prefix(F.trim(F.element_at(parts, -1)))
    return kept.select("aquifer_id", F.substring(F.trim(parts[0]), 1, 10).alias("date"), value.alias("value")).where("date <> '' and value is not null")


def elevations(spark: SparkSession, points: DataFrame, unit: str = "m", send: Send = send) -> DataFrame:
    """(id, elevation) of points (id, lat, lng), to two digits: one service if all lie in the United States, else another by hundreds [S17].

    Points for which a service has no answer are left out.
    """
    again = retrying(send)
    domestic = points.where(~S.in_us(F.col("lat"), F.col("lng"))).isEmpty()
    kind = dict(points.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 100):
                part = pdf.iloc[k : k + 100]
                try:
                    if domestic:
                        found = [json.loads(again(f"{EPQS}?x={x}&y={y}&units=Meters&wkid=4326", None)).get("value") for y, x in zip(part["lat"], part["lng"])]
                    else:
                        found = json.loads(again(f"{METEO}?latitude={','.join(map(str, part['lat']))}&longitude={','.join(map(str, part['lng']))}", None))["elevation"]
                except (Refused, OSError):
                    continue
                yield pd.DataFrame({"id": part["id"], "metres": pd.to_numeric(pd.Series(found, index=part.index), errors="coerce").astype(float)})

    found = points.select("id", "lat", "lng").mapInPandas(run, f"id {kind}, metres double")
    factor = 3.28084 if unit == "ft" else 1.0
    return found.where(f"metres > {-100 if domestic else -1000} and not isnan(metres)").select("id", S.js_round(F.col("metres") * factor, 2).alias("elevation"))
