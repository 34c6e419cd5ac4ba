"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.plans.registry import Tables, query, r, sql

PART = "p_partkey"
SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_', ''), '_$', '')"
NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def parts(t: Tables):
    return t.read("part").withColumn("label", F.concat_ws("", F.lit(" "), "p_name", F.lit("-"), "p_brand", F.lit(" ("), "p_type", F.lit(")")))


LABEL = "p AS (SELECT *, ' ' || p_name || '-' || p_brand || ' (' || p_type || ')' AS label FROM part)"


@query("P01_slugify", sql(f"{LABEL} SELECT p_partkey, {SLUG.format('label')} AS slug FROM p"))
def _(t):
    return parts(t).select(PART, S.slugify(F.col("label")).alias("slug"))


@query("P02_normalize_name", sql(f"{LABEL} SELECT p_partkey, {NORM.format('label')} AS name FROM p"))
def _(t):
    return parts(t).select(PART, S.normalize_name(F.col("label")).alias("name"))


@query(
    "P03_column_header",
    sql(rf"{LABEL} SELECT p_partkey, trim(regexp_replace(label, '\s*[(\[][^)\]]*[)\]]\s*$', '')) AS base, trim(regexp_extract(label, '[(\[]([^)\]]*)[)\]]\s*$', 1)) AS unit FROM p"),
)
def _(t):
    return parts(t).select(PART, S.header_name(F.col("label")).alias("base"), S.header_unit(F.col("label")).alias("unit"))


@query(
    "P04_acronym",
    sql(f"""{LABEL}, w AS (SELECT p_partkey, string_split({NORM.format('label')}, ' ') AS w FROM p)
SELECT p_partkey, CASE WHEN len(w) > 1 THEN array_to_string(list_transform(w, lambda x: x[1:1]), '') ELSE '' END AS acronym FROM w"""),
)
def _(t):
    return parts(t).select(PART, S.acronym(F.col("label")).alias("acronym"))


@query("P05_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS edits FROM part")
def _(t):
    return t.read("part").select(PART, F.levenshtein("p_name", "p_type").cast("long").alias("edits"))


HEADERS = ["Well_ID", " Latitude ", "date", "Water Level", "WTE", "NO3", "Fe (mg/L)", "E. coli", "Aquifer_Name", "lon", "Head", "HCO3 [mg/L]", "Chloride", "surface_elevation"]


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(
    "P06_reserved_names",
    sql(rf"""h AS (SELECT p_partkey, [{quoted(HEADERS)}][p_partkey % {len(HEADERS)} + 1] AS h FROM part),
c AS (SELECT unnest([{quoted(S.CHEMICAL)}]) AS formula, unnest([{quoted(S.CHEMICAL.values())}]) AS code)
SELECT p_partkey, CASE WHEN lower(trim(h)) IN ({quoted(S.RESERVED)}) THEN 'reserved' WHEN lower(trim(h)) IN ({quoted(S.WATER_LEVEL)}) THEN 'water_level' ELSE 'other' END AS kind, code
FROM h LEFT JOIN c ON formula = trim(regexp_replace(lower(trim(regexp_replace(h, '\s*[(\[][^)\]]*[)\]]\s*$', ''))), '[^a-z0-9]+', ' ', 'g'))"""),
)
def _(t):
    header = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col(PART) % len(HEADERS) + 1).cast("int"))
    return t.read("part").select(PART, S.column_kind(header).alias("kind"), S.chemical_code(header).alias("code"))


TEXTS = """d AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y')
  WHEN 3 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) WHEN 4 THEN strftime(o_orderdate, '%Y') || '-13-01' WHEN 5 THEN o_orderpriority ELSE year(o_orderdate) || '-2-31' END AS s FROM orders)"""


def date_texts(t: Tables):
    d = F.col("o_orderdate")
    m = F.pmod("o_orderkey", F.lit(7))
    slash = F.concat_ws("/", F.month(d), F.dayofmonth(d), F.year(d))
    s = F.when(m == 0, F.date_format(d, "yyyy-MM-dd")).when(m == 1, F.date_format(d, "yyyy-MM")).when(m == 2, F.date_format(d, "yyyy")).when(m == 3, slash)
    s = s.when(m == 4, F.concat(F.date_format(d, "yyyy"), F.lit("-13-01"))).when(m == 5, F.col("o_orderpriority")).otherwise(F.concat(F.year(d), F.lit("-2-31")))
    return t.read("orders").select("o_orderkey", s.alias("s"))


VALID = r"""CASE WHEN regexp_full_match(s, '\d{4}-\d{1,2}-\d{1,2}') THEN CASE WHEN split_part(s, '-', 2)::INT BETWEEN 1 AND 12 AND split_part(s, '-', 3)::INT BETWEEN 1 AND 31
    THEN split_part(s, '-', 1) || '-' || lpad(split_part(s, '-', 2), 2, '0') || '-' || lpad(split_part(s, '-', 3), 2, '0') END
  WHEN regexp_full_match(s, '\d{4}-\d{2}') THEN CASE WHEN split_part(s, '-', 2)::INT BETWEEN 1 AND 12 THEN s || '-01' END
  WHEN regexp_full_match(s, '\d{4}') THEN CASE WHEN s::INT > 1800 AND s::INT < 2100 THEN s || '-01-01' END
  WHEN regexp_full_match(s, '\d{1,2}/\d{1,2}/\d{4}') THEN CASE WHEN split_part(s, '/', 1)::INT BETWEEN 1 AND 12 AND split_part(s, '/', 2)::INT BETWEEN 1 AND 31
    THEN split_part(s, '/', 3) || '-' || lpad(split_part(s, '/', 1), 2, '0') || '-' || lpad(split_part(s, '/', 2), 2, '0') END END"""


@query("F10_validate_date", sql(f"{TEXTS} SELECT o_orderkey, s, {VALID} AS iso FROM d"))
def _(t):
    return date_texts(t).withColumn("iso", S.validate_date(F.col("s")))


@query(
    "P07_parse_date",
    """SELECT o_orderkey, CASE WHEN len(x) = 3 THEN (CASE WHEN length(x[3]) = 2 THEN (CASE WHEN x[3]::INT > 50 THEN 1900 ELSE 2000 END + x[3]::INT)::VARCHAR ELSE x[3] END) || '-' || lpad(x[1], 2, '0') || '-' || lpad(x[2], 2, '0') ELSE s END AS iso
FROM (SELECT o_orderkey, s, string_split(s, '/') AS x FROM (SELECT o_orderkey, month(o_orderdate) || '/' || day(o_orderdate) || '/' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%y') ELSE strftime(o_orderdate, '%Y') END AS s FROM orders))""",
)
def _(t):
    d = F.col("o_orderdate")
    year = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yy")).otherwise(F.date_format(d, "yyyy"))
    return t.read("orders").select("o_orderkey", S.parse_date(F.concat_ws("/", F.month(d), F.dayofmonth(d), year), "us").alias("iso"))


@query(
    "P08_detect_date_format",
    """SELECT o_orderpriority, CASE WHEN max(day(o_orderdate)) > 12 THEN 'us' ELSE 'eu' END AS format, count(*) AS n FROM orders GROUP BY o_orderpriority""",
)
def _(t):
    d = F.col("o_orderdate")
    parts_ = F.split(F.concat_ws("/", F.month(d), F.dayofmonth(d), F.year(d)), "/")
    first, second = parts_[0].cast("int"), parts_[1].cast("int")
    kind = F.when(F.bool_or(first > 12), "eu").when(F.bool_or(second > 12), "us").otherwise("eu")
    return t.read("orders").groupBy("o_orderpriority").agg(kind.alias("format"), F.count("*").alias("n"))


@query("P10_us_date", "SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS us FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", F.regexp_replace(F.date_format("o_orderdate", "yyyy-MM-dd"), r"(\d{4})-(\d{2})-(\d{2})", "$2-$3-$1").alias("us"))


AQX = """CASE WHEN trim(s_name) <> '' THEN 'aqx-' || regexp_replace(SLUG, '_', '-', 'g')[1:24] || '-' ELSE 'aqx-' END""".replace("SLUG", SLUG.format("s_name"))


@query(
    "P11_generated_ids",
    sql(f"""b AS (SELECT well_id, {AQX.replace('s_name', 'well_name')} || printf('%.2f', abs(lat)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || printf('%.2f', abs(lng)) || CASE WHEN lng >= 0 THEN 'E' ELSE 'W' END AS id FROM well)
SELECT well_id, id || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY well_id) AS k FROM b)""", "well"),
)
def _(t):
    from pyspark.sql import Window

    b = t.wells.select("well_id", S.aqx_id(F.col("well_name"), F.col("lat"), F.col("lng")).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("well_id"))
    return b.select("well_id", F.concat("base", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise("")).alias("id"))


@query("P12_site_id", "SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(s, '[A-Za-z]+-.*') THEN s WHEN regexp_full_match(s, '\\d{8,15}') THEN 'USGS-' || s ELSE s END AS site FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'AB-' || l_orderkey WHEN 1 THEN (l_orderkey + 40000000)::VARCHAR ELSE l_orderkey::VARCHAR END AS s FROM lineitem)")
def _(t):
    n, k = F.col("l_linenumber") % 3, F.col("l_orderkey")
    s = F.when(n == 0, F.concat(F.lit("AB-"), k.cast("string"))).when(n == 1, (k + 40000000).cast("string")).otherwise(k.cast("string"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", S.usgs_id(s).alias("site"))


@query("P13_units", "SELECT s_suppkey, s_acctbal * 3.28084::DOUBLE AS feet, s_acctbal * 0.3048::DOUBLE AS metres FROM supplier")
def _(t):
    return t.read("supplier").select("s_suppkey", (F.col("s_acctbal") * S.FEET).alias("feet"), (F.col("s_acctbal") * 0.3048).alias("metres"))


@query("P15_json", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    return t.read("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "P17_labels",
    "SELECT event_type, CASE event_type WHEN 'click' THEN 'Method: click' WHEN 'view' THEN 'Method: view' ELSE 'Method: other' END AS label, count(*) AS n FROM events GROUP BY event_type",
)
def _(t):
    e = F.col("event_type")
    label = F.concat(F.lit("Method: "), F.when(e.isin("click", "view"), e).otherwise("other"))
    return t.read("events").groupBy("event_type").agg(F.first(label).alias("label"), F.count("*").alias("n"))


@query("F09_in_us", sql("SELECT well_id, (lat BETWEEN 24.4 AND 49.4 AND lng BETWEEN -125.0 AND -66.9) OR (lat BETWEEN 51.0 AND 71.5 AND lng BETWEEN -180.0 AND -129.0) OR (lat BETWEEN 18.9 AND 22.3 AND lng BETWEEN -160.3 AND -154.8) OR (lat BETWEEN 17.6 AND 18.6 AND lng BETWEEN -67.3 AND -64.5) OR (lat BETWEEN 13.2 AND 13.7 AND lng BETWEEN 144.6 AND 145.0) AS in_us FROM well", "well"))
def _(t):
    return t.wells.select("well_id", S.in_us(F.col("lat"), F.col("lng")).alias("in_us"))


@query("F15_depth_to_elevation", sql(f"SELECT m.pos, CASE WHEN gse > 0 THEN {r('gse - abs(value)', 2)} ELSE value END AS elevation FROM meas m JOIN well w USING (well_id)", "meas", "well"))
def _(t):
    both = t.measurements.join(t.wells.select("well_id", "gse"), "well_id")
    return both.select("pos", S.elevation_of_depth(F.col("gse"), F.col("value")).alias("elevation"))


@query("F19_transforms", f"SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 WHEN s_acctbal > 5000 THEN 5000.0 ELSE s_acctbal END::DOUBLE AS cut, CASE WHEN s_acctbal > 0 THEN {r('ln(s_acctbal)', 9)} END AS log_value FROM supplier")
def _(t):
    b = F.col("s_acctbal")
    return t.read("supplier").select("s_suppkey", S.truncated(b, 0.0, 5000.0).alias("cut"), S.js_round(S.log_or_null(b), 9).alias("log_value"))


@query("F20_round", "SELECT event_id, floor(value * 1e1 + 0.5) / 1e1 AS rounded FROM events")
def _(t):
    return t.read("events").select("event_id", S.js_round(F.col("value"), 1).alias("rounded"))


@query("F22_valid_codes", "SELECT p_partkey, regexp_full_match(p_name, '[a-z0-9_]{1,20}') AS plain, regexp_full_match(SLUG, '[a-z0-9_]{1,20}') AS slugged FROM part".replace("SLUG", SLUG.format("p_name")))
def _(t):
    return t.read("part").select(PART, F.col("p_name").rlike("^[a-z0-9_]{1,20}$").alias("plain"), S.slugify(F.col("p_name")).rlike("^[a-z0-9_]{1,20}$").alias("slugged"))


@query("F23_number_prefix", r"SELECT o_orderkey, try_cast(nullif(regexp_extract(trim(s), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?', 0), '') AS DOUBLE) AS x FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_orderkey || 'abc' WHEN 1 THEN '<0.05' WHEN 2 THEN '-1.5e2x' ELSE o_orderpriority END AS s FROM orders)")
def _(t):
    k = F.col("o_orderkey")
    s = F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit("abc"))).when(k % 4 == 1, "<0.05").when(k % 4 == 2, "-1.5e2x").otherwise(F.col("o_orderpriority"))
    return t.read("orders").select("o_orderkey", S.number_prefix(s).alias("x"))


HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


@query("G01_haversine", sql(f"SELECT a.well_id AS a, b.well_id AS b, {r(HAV.format('a.lat', 'a.lng', 'b.lat', 'b.lng'), 3)} AS metres FROM well a JOIN well b ON a.aquifer_id = b.aquifer_id AND a.well_id < b.well_id", "well"))
def _(t):
    a = t.wells.select("aquifer_id", F.col("well_id").alias("a"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    b = t.wells.select("aquifer_id", F.col("well_id").alias("b"), "lat", "lng")
    d = S.haversine(F.col("lat1"), F.col("lng1"), F.col("lat"), F.col("lng"))
    return a.join(b, "aquifer_id").where("a < b").select("a", "b", S.js_round(d, 3).alias("metres"))


@query("G02_cell_area", sql(f"SELECT well_id, {r('6371000.0::DOUBLE * radians(0.1::DOUBLE) * cos(radians(lat)) * 6371000.0::DOUBLE * radians(0.2::DOUBLE)', 1)} AS area FROM well", "well"))
def _(t):
    return t.wells.select("well_id", S.js_round(S.cell_area(F.col("lat"), 0.1, 0.2), 1).alias("area"))


@query("G03_planar", sql(f"c AS (SELECT *, avg(lat) OVER (PARTITION BY aquifer_id) AS lat0, avg(lng) OVER (PARTITION BY aquifer_id) AS lng0 FROM well) SELECT well_id, {r('radians(lng - lng0) * cos(radians(lat0)) * 6371000.0', 2)} AS east, {r('radians(lat - lat0) * 6371000.0', 2)} AS north FROM c", "well"))
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("aquifer_id")
    east, north = S.planar(F.col("lat"), F.col("lng"), F.avg("lat").over(w), F.avg("lng").over(w))
    # half a centimetre aside, so that means which differ in the last bit round alike
    return t.wells.select("well_id", S.js_round(east, 2).alias("east"), S.js_round(north, 2).alias("north"))


@query("G05_web_mercator", sql(f"SELECT well_id, {r('6378137.0 * radians(lng)', 2)} AS x, {r('6378137.0 * ln(tan(0.7853981633974483::DOUBLE + radians(lat) / 2))', 2)} AS y FROM well", "well"))
def _(t):
    x, y = S.web_mercator(F.col("lat"), F.col("lng"))
    return t.wells.select("well_id", S.js_round(x, 2).alias("x"), S.js_round(y, 2).alias("y"))


@query("G06_utm_zone", sql("SELECT well_id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lng + 180) / 6) + 1)::INTEGER AS epsg FROM well", "well"))
def _(t):
    return t.wells.select("well_id", S.utm_epsg(F.col("lat"), F.col("lng")).cast("int").alias("epsg"))


@query("G08_valid_point", "SELECT c_custkey, coalesce(c_acctbal / 50 BETWEEN -90 AND 90 AND c_acctbal / 25 BETWEEN -180 AND 180, false) AS valid FROM customer")
def _(t):
    return t.read("customer").select("c_custkey", S.valid_point(F.col("c_acctbal") / 50, F.col("c_acctbal") / 25).alias("valid"))


@query("G09_epsg", r"SELECT c_custkey, CASE WHEN m <> '' THEN 'EPSG:' || m END AS code FROM (SELECT c_custkey, regexp_extract(trim(s), '^(?i:epsg:?)?\s*(\d{2,6})$', 1) AS m FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'epsg:' || (c_custkey + 3000) WHEN 1 THEN ' ' || c_custkey || ' ' WHEN 2 THEN 'EPSG ' || c_custkey ELSE c_mktsegment END AS s FROM customer))")
def _(t):
    k = F.col("c_custkey")
    s = F.when(k % 4 == 0, F.concat(F.lit("epsg:"), (k + 3000).cast("string"))).when(k % 4 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("EPSG "), k.cast("string"))).otherwise(F.col("c_mktsegment"))
    return t.read("customer").select("c_custkey", S.epsg(s).alias("code"))


@query("R06_ramp_index", "SELECT event_id, floor(CASE WHEN value / 100 < 0 THEN 0 WHEN value / 100 > 1 THEN 1 ELSE value / 100 END * 63 + 0.5)::INTEGER AS idx FROM events")
def _(t):
    return t.read("events").select("event_id", S.ramp_index(F.col("value") / 100).alias("idx"))


@query("P14_csv_field", """SELECT o_orderkey, CASE WHEN contains(s, ',') OR contains(s, '"') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS field FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || ', ' || o_orderstatus WHEN 1 THEN 'a "' || o_orderstatus || '"' ELSE o_orderpriority END AS s FROM orders)""")
def _(t):
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.concat("o_orderpriority", F.lit(", "), "o_orderstatus")).when(k == 1, F.concat(F.lit('a "'), "o_orderstatus", F.lit('"'))).otherwise(F.col("o_orderpriority"))
    return t.read("orders").select("o_orderkey", S.csv_field(s).alias("field"))


@query("P16_mathematics", f"SELECT l_orderkey, l_linenumber, {r('ln(l_quantity)', 8)} AS log, {r('exp(-l_discount)', 8)} AS exp, {r('(exp(2 * l_tax) - 1) / (exp(2 * l_tax) + 1)', 8)} AS tanh, {r('sqrt(l_extendedprice)', 6)} AS sqrt, {r('sqrt(l_quantity * l_quantity + l_discount * l_discount)', 6)} AS hypot, {r('sin(l_quantity)', 8)} AS sin, {r('cos(l_quantity)', 8)} AS cos, ceil(l_extendedprice)::BIGINT AS ceil, floor(l_extendedprice)::BIGINT AS floor, sign(l_discount - 0.05)::DOUBLE AS sign FROM lineitem")
def _(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    parts = {"log": (F.log(q), 8), "exp": (F.exp(-d), 8), "tanh": (F.tanh("l_tax"), 8), "sqrt": (F.sqrt("l_extendedprice"), 6), "hypot": (F.hypot(q, d), 6), "sin": (F.sin(q), 8), "cos": (F.cos(q), 8)}
    whole = [F.ceil("l_extendedprice").alias("ceil"), F.floor("l_extendedprice").alias("floor"), F.signum(d - 0.05).alias("sign")]
    return t.read("lineitem").select("l_orderkey", "l_linenumber", *[S.js_round(c, n).alias(k) for k, (c, n) in parts.items()], *whole)
