"""Region folders: CSV, GeoJSON and JSON in, CSV and Parquet out."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.sources.shapefile import shapefiles

RINGS = "array<array<array<double>>>"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header, all text; a tab in the header makes tabs the delimiter; missing cells are '' [S01, S02]."""
    head = spark.read.text(path).limit(1).collect()
    separator = "\t" if head and "\t" in head[0][0] else ","
    options = {"header": True, "sep": separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    return spark.read.options(**options).csv(path).na.fill("")


def wells(spark: SparkSession, path: str, region_id: str) -> DataFrame:
    """Wells of a region: the name falls back on the id, the surface on 0; those without id or place are left out [S04]."""
    return _clean_wells(read_table(spark, path).withColumn("region_id", F.lit(region_id)))


def _clean_wells(raw: DataFrame) -> DataFrame:
    lat, lng = S.number_prefix(F.col("lat")), S.number_prefix(F.col("long"))
    name = F.coalesce(F.nullif(F.col("well_name"), F.lit("")), F.col("well_id"))
    gse = F.coalesce(S.number_prefix(F.col("gse")), F.lit(0.0))
    found = raw.select("region_id", "aquifer_id", "well_id", name.alias("well_name"), lat.alias("lat"), lng.alias("lng"), gse.alias("gse"))
    return found.where("well_id <> '' and lat <> 0 and lng <> 0")


def measurements(spark: SparkSession, folder: str, region_id: str) -> DataFrame:
    """Measurements in data_<code>.csv of a folder, their code from the file's name; rows without number are left out [S05]."""
    raw = spark.read.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(f"{folder}/data_*.csv")
    code = F.regexp_extract(F.input_file_name(), r"data_([^/]+)\.csv", 1)
    return _clean_measurements(raw.select("*", F.lit(region_id).alias("region_id"), code.alias("data_type")))


def _clean_measurements(raw: DataFrame) -> DataFrame:
    date = S.validate_date(F.col("date")).try_cast("date")
    found = raw.select("region_id", "aquifer_id", "well_id", "data_type", date.alias("obs_date"), S.number_prefix(F.col("value")).alias("value"))
    return found.where("well_id <> '' and obs_date is not null and value is not null")


def regions(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all regions below a folder; broken ones are left out [S03]."""
    schema = "id string, name string, lengthUnit string, singleUnit boolean, customDataTypes array<struct<code:string,name:string,unit:string>>"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/*/region.json").where("id is not null")


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Outer rings of a GeoJSON file of polygons, by aquifer: (aquifer_id, aquifer_name, pos, ring) [S06, S08]."""
    geometry = "struct<type:string,coordinates:string>"
    properties = "struct<aquifer_id:string,aquifer_name:string>"
    raw = spark.read.schema(f"features array<struct<properties:{properties},geometry:{geometry}>>").option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("pos", "f"))
    single = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", RINGS)))
    many = single.otherwise(F.from_json("f.geometry.coordinates", f"array<{RINGS}>"))
    key = F.coalesce("f.properties.aquifer_id", F.lit("unknown"))
    named = f.select(key.alias("aquifer_id"), F.coalesce("f.properties.aquifer_name", F.concat(F.lit("Aquifer "), key)).alias("aquifer_name"), "pos", F.explode(many).alias("rings"))
    return named.select("aquifer_id", "aquifer_name", "pos", F.get("rings", F.lit(0)).alias("ring"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The parameter catalog as rows [S11]."""
    entry = "struct<name:string,unit:string,group:string,mcl:double,who:double,wqp:struct<characteristicName:string,sampleFraction:string>>"
    raw = spark.read.schema(f"parameters map<string,{entry}>").option("multiLine", True).json(path)
    return raw.select(F.explode("parameters").alias("code", "p")).select("code", "p.name", "p.unit", "p.group", "p.mcl", "p.who", F.col("p.wqp.characteristicName").alias("characteristic_name"), F.col("p.wqp.sampleFraction").alias("sample_fraction"))


def write_measurements(df: DataFrame, path: str) -> None:
    """A store by region and type, whose partitions are replaced where df has rows [K01]."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_id", "data_type").parquet(path)


def export_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order as CSV files whose names ascend with it [K04]."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def to_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key as one JSON document [K11]."""
    rest = [c for c in df.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*rest)))
    return df.groupBy(*keys).agg(F.to_json(F.struct(rows.alias("rows"))).alias("document"))


def bare_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Outer rings (pos, ring) of a GeoJSON file, be it a collection, one feature or a bare geometry [S08]."""
    geometry = "struct<type:string,coordinates:string>"
    raw = spark.read.schema(f"type string, coordinates string, geometry {geometry}, features array<struct<geometry:{geometry}>>").option("multiLine", True).json(path)
    own = F.struct(F.col("type").alias("type"), F.col("coordinates").alias("coordinates"))
    listed = F.when(F.col("type") == "FeatureCollection", F.col("features.geometry")).when(F.col("type") == "Feature", F.array("geometry")).otherwise(F.array(own))
    g = raw.select(F.posexplode(listed).alias("pos", "g"))
    single = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", RINGS)))
    many = single.when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{RINGS}>"))
    return g.select("pos", F.explode(many).alias("rings")).select("pos", F.get("rings", F.lit(0)).alias("ring"))


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """A file by its extension: .csv and .txt as tables, .json and .geojson as outer rings, .zip as shapefiles; others are refused [S10]."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt"):
        return read_table(spark, path)
    if kind in ("json", "geojson"):
        return bare_polygons(spark, path)
    if kind == "zip":
        return shapefiles(spark, path)
    raise ValueError(f"no reader for files that end in .{kind}")


def fallback_aquifers(wells: DataFrame, known: DataFrame, margin: float = 0.1) -> DataFrame:
    """(region_id, aquifer_id, min_lat, max_lat, min_lng, max_lng) of aquifers that only wells name: their extent and a margin [S06]."""
    lost = wells.join(known.select("aquifer_id"), "aquifer_id", "left_anti").groupBy("region_id", "aquifer_id")
    return lost.agg((F.min("lat") - margin).alias("min_lat"), (F.max("lat") + margin).alias("max_lat"), (F.min("lng") - margin).alias("min_lng"), (F.max("lng") + margin).alias("max_lng"))


def load_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Regions, wells and measurements of all region folders below root, each in one scan [S03-S05, S07].

    A row's region is the folder that its file lies in.
    """
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    options = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    raw = spark.read.options(**options).csv(f"{root}/*/wells.csv").select("*", folder.alias("region_id"))
    found = _clean_wells(raw)
    values = spark.read.options(**options).csv(f"{root}/*/data_*.csv").select("*", folder.alias("region_id"), F.regexp_extract(F.input_file_name(), r"data_([^/]+)\.csv", 1).alias("data_type"))
    return {"regions": regions(spark, root), "wells": found, "measurements": _clean_measurements(values)}


def metadata(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(region_id, file, code, title, data_type, aquifer_id, params) of the raster_*.json or model_*.json below root [S12].

    Only these fields are read, not the frames. Where a file lacks a data type or code its name gives them.
    """
    fields = "code string, title string, dataType string, aquiferId string, params string"
    raw = spark.read.schema(fields).option("multiLine", True).json(f"{root}/*/{kind}_*.json")
    parts = F.split(F.input_file_name(), "/")
    named = raw.select("*", F.element_at(parts, -2).alias("region_id"), F.element_at(parts, -1).alias("file"))
    form = f"^{kind}_([a-z0-9_]+?)_(.+)\\.json$"
    code, type_ = (F.nullif(F.regexp_extract("file", form, k), F.lit("")) for k in (2, 1))
    return named.select("region_id", "file", F.coalesce("code", code).alias("code"), F.coalesce("title", code).alias("title"), F.coalesce("dataType", type_).alias("data_type"), F.col("aquiferId").alias("aquifer_id"), "params")


#: Which columns of a file, in lower case, stand for which field: words of which all occur in one, and whole names.
COLUMN_RULES: dict[str, dict[str, tuple[list[tuple[str, ...]], list[str]]]] = {
    "aquifer": {"aquifer_id": ([("aquifer", "id")], ["id"]), "aquifer_name": ([("aquifer", "name")], ["name", "full_name"])},
    "wells": {
        "well_id": ([("well", "id")], []),
        "well_name": ([("well", "name")], ["name"]),
        "lat": ([("latitude",)], ["lat", "lat_dec", "northing", "y"]),
        "long": ([("longitude",)], ["long", "lng", "long_dec", "easting", "x"]),
        "gse": ([], ["gse", "ground_surface_elevation", "elevation", "surface_elevation"]),
        "aquifer_id": ([("aquifer", "id")], []),
    },
    "measurements": {
        "well_id": ([("well", "id")], []),
        "well_name": ([("well", "name")], ["name", "station", "station_name"]),
        "date": ([("date",)], []),
        "lat": ([("latitude",)], ["lat", "lat_dec", "northing", "y"]),
        "long": ([("longitude",)], ["long", "lng", "lon", "long_dec", "easting", "x"]),
        "aquifer_id": ([("aquifer", "id")], []),
    },
}


def map_columns(columns: list[str], kind: str) -> dict[str, str]:
    """The first column that stands for each field of a kind of file; fields without one are left out [P09]."""
    out = {}
    for field, (parts, names) in COLUMN_RULES[kind].items():
        for column in columns:
            lower = column.lower()
            if lower in names or any(all(p in lower for p in words) for words in parts):
                out[field] = column
                break
    return out


def new_region(spark: SparkSession, name: str, unit: str, single: bool) -> tuple[DataFrame, DataFrame]:
    """A region whose id is the slug of its name, and its aquifers: '0' if it is a single unit, else none [K09]."""
    row = spark.range(1).select(S.slugify(F.lit(name)).alias("id"), F.lit(name).alias("name"), F.lit(unit).alias("lengthUnit"), F.lit(single).alias("singleUnit"))
    aquifers = row.where("singleUnit").select(F.col("id").alias("region_id"), F.lit("0").alias("aquifer_id"), F.col("name").alias("aquifer_name"))
    return row, aquifers


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it: stores are managed where Spark reads them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, root: str, name: str) -> bool:
    """Deletes a file or folder below root, and its folder if that is empty then; False if there is none [K02]."""
    if re.search(r"(^|/)\.\.(/|$)", name) or name.startswith("/") or not name.strip("/"):
        raise ValueError("the path leaves its root")
    fs, at = _file_system(spark, f"{root}/{name}")
    found = fs.delete(at, True)
    parent = at.getParent()
    if found and parent != spark._jvm.org.apache.hadoop.fs.Path(root) and not fs.listStatus(parent):
        fs.delete(parent, False)
    return found


def rename(spark: SparkSession, folder: str, kind: str, data_type: str, old: str, title: str) -> str:
    """Gives a raster or model document another title and the code that follows from it; returns its file name [K03]."""
    code = spark.range(1).select(S.slugify(F.lit(title))).first()[0]
    name = f"{kind}_{data_type}_{code}.json"
    fs, source = _file_system(spark, f"{folder}/{kind}_{data_type}_{old}.json")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if target != source and fs.exists(target):
        raise FileExistsError(name)
    document = json.loads(spark.read.text(source.toString(), wholetext=True).first()[0])
    out = fs.create(target, True)
    out.write(bytearray(json.dumps(document | {"code": code, "title": title}).encode()))
    out.close()
    if target != source:
        fs.delete(source, False)
    return name
