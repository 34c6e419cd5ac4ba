"""Column functions: text, dates, numbers and geography. IDs of the inventory stand in brackets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0
FEET = 3.28084


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds half towards +infinity [F20]."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def slugify(s: Column) -> Column:
    """Lower case, other runs than letters and digits as one underscore, none at the ends [P01]."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), "^_", ""), "_$", "")


def normalize_name(s: Column) -> Column:
    """Lower case words of letters and digits between single spaces [P02]."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def header_name(s: Column) -> Column:
    """The name in 'Name (unit)' or 'Name [unit]' [P03]."""
    return F.trim(F.regexp_replace(s, r"\s*[(\[][^)\]]*[)\]]\s*$", ""))


def header_unit(s: Column) -> Column:
    """The unit in 'Name (unit)', or an empty string [P03]."""
    return F.trim(F.regexp_extract(s, r"[(\[]([^)\]]*)[)\]]\s*$", 1))


def acronym(s: Column) -> Column:
    """Initials of a name of several words, else an empty string [P04]."""
    words = F.split(normalize_name(s), " ")
    return F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).otherwise("")


#: Names of columns that are no data type, names of the water level, and formulas with the codes they stand for.
RESERVED = (
    "well_id wellid site site_id siteid well_name wellname name date datetime timestamp time lat latitude lat_dec long lng longitude long_dec lon "
    "aquifer_id aquifer aquifer_name gse ground_surface_elevation surface_elevation"
).split() + ["well id", "well name"]
WATER_LEVEL = "value wte water_table_elevation water_level elevation level measurement reading head".split() + ["water table elevation", "water level", "water head"]
CHEMICAL = {
    "no3": "nitrate", "no2": "nitrite", "nh3": "ammonia", "nh4": "ammonia", "po4": "phosphorus", "so4": "sulfate", "hco3": "bicarbonate", "co3": "carbonate",
    "ca": "calcium", "mg": "magnesium", "na": "sodium", "k": "potassium", "fe": "iron", "mn": "manganese", "cl": "chloride", "as": "arsenic", "pb": "lead",
    "cu": "copper", "zn": "zinc", "cr": "chromium", "se": "selenium", "b": "boron", "si": "silica", "f": "fluoride", "ecoli": "e_coli", "e coli": "e_coli",
}


def column_kind(header: Column) -> Column:
    """reserved, water_level or other: what a column of a file holds by its name [P06]."""
    key = F.lower(F.trim(header))
    return F.when(key.isin(RESERVED), "reserved").when(key.isin(WATER_LEVEL), "water_level").otherwise("other")


def chemical_code(header: Column) -> Column:
    """The code that a formula stands for, null for other names [P06]."""
    known = F.create_map(*(F.lit(x) for pair in CHEMICAL.items() for x in pair))
    return F.element_at(known, normalize_name(header_name(header)))


def number_prefix(s: Column) -> Column:
    """The number that a text begins with, null without one [F23]."""
    return F.nullif(F.regexp_extract(F.trim(s), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def validate_date(s: Column) -> Column:
    """ISO form of a date text: whole, by month or year, or M/D/YYYY; null if none. Days up to 31 pass for any month [F10]."""
    t = F.trim(s)
    year, month, day = (F.regexp_extract(t, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", i) for i in (1, 2, 3))
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    m, d, y = (F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i) for i in (1, 2, 3))
    american = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    def fits(mm: Column, dd: Column) -> Column:
        return mm.try_cast("int").between(1, 12) & dd.try_cast("int").between(1, 31)

    month_only = F.regexp_extract(t, r"^\d{4}-(\d{2})$", 1)
    return (
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.when(fits(month, day), iso))
        .when(t.rlike(r"^\d{4}-\d{2}$"), F.when(month_only.try_cast("int").between(1, 12), F.concat(t, F.lit("-01"))))
        .when(t.rlike(r"^\d{4}$"), F.when((t.try_cast("int") > 1800) & (t.try_cast("int") < 2100), F.concat(t, F.lit("-01-01"))))
        .when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.when(fits(m, d), american))
    )


def parse_date(s: Column, order: str) -> Column:
    """ISO form of a date whose parts stand in order 'iso', 'us' or 'eu'; two-digit years pivot at 50; other texts stay [P07]."""
    parts = F.split(F.trim(s), "[/.-]")
    at = {"iso": (0, 1, 2), "us": (2, 0, 1), "eu": (2, 1, 0)}[order]
    y, m, d = (F.get(parts, F.lit(i)) for i in at)
    short = y.try_cast("int")
    year = F.when(F.length(y) == 2, F.when(short > 50, 1900 + short).otherwise(2000 + short).cast("string")).otherwise(y)
    return F.when(F.size(parts) == 3, F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(s)


def usgs_id(s: Column) -> Column:
    """A site number with its agency prefix; texts that are none stay [P12]."""
    return F.when(s.rlike(r"^[A-Za-z]+-"), s).when(s.rlike(r"^\d{8,15}$"), F.concat(F.lit("USGS-"), s)).otherwise(s)


def epsg(s: Column) -> Column:
    """'EPSG:n' of a text that is a code of two to six digits, with or without that prefix; else null [G09]."""
    code = F.regexp_extract(F.trim(s), r"^(?:[eE][pP][sS][gG]:?)?\s*(\d{2,6})$", 1)
    return F.when(code != "", F.concat(F.lit("EPSG:"), code))


def elevation_of_depth(gse: Column, depth: Column) -> Column:
    """Surface less depth, to two digits, where the surface is known; else the value [F15]."""
    return F.when(gse > 0, js_round(gse - F.abs(depth), 2)).otherwise(depth)


def truncated(x: Column, low: float | None, high: float | None) -> Column:
    """x within limits; null stays null [F19]."""
    out = x if low is None else F.when(x < low, F.lit(low)).otherwise(x)
    return out if high is None else F.when(out > high, F.lit(high)).otherwise(out)


def log_or_null(x: Column) -> Column:
    """Natural logarithm of positive numbers [F19]."""
    return F.when(x > 0, F.log(x))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between points in degrees [G01]."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def degree_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance in degrees with longitudes shrunk by the cosine of the mean latitude [G04]."""
    dx = (lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + (lat2 - lat1) * (lat2 - lat1))


def cell_area(lat: Column, dx: float, dy: float) -> Column:
    """Square metres of a cell of dx by dy degrees [G02]."""
    return F.lit(EARTH) * F.radians(F.lit(dx)) * F.cos(F.radians(lat)) * F.lit(EARTH) * F.radians(F.lit(dy))


def ellipsoid_radius(lat: Column) -> Column:
    """Metres from the centre to the surface of the WGS84 ellipsoid at a geodetic latitude [G10]."""
    major, minor = 6_378_137.0, 6_356_752.3142
    rest = (minor / major) ** 2
    geocentric = F.atan(F.lit(rest) * F.tan(F.radians(lat)))
    return F.lit(minor) / F.sqrt(1 - (1 - rest) * F.pow(F.cos(geocentric), F.lit(2.0)))


def csv_field(s: Column) -> Column:
    """A field of a CSV line: quoted, with its quotes doubled, if it holds a comma, a quote or a line end [P14]."""
    return F.when(s.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(s, F.lit("")))


def planar(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """Metres east and north of a centre [G03]."""
    return F.radians(lng - lng0) * F.cos(F.radians(lat0)) * EARTH, F.radians(lat - lat0) * EARTH


def web_mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres [G05]."""
    radius = F.lit(6_378_137.0)
    return radius * F.radians(lng), radius * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


#: The WGS84 ellipsoid.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def web_mercator_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lng) of spherical Mercator metres [G05]."""
    return F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - F.lit(math.pi / 2)), F.degrees(x / WGS84_A)


def utm_degrees(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(lat, lng) of UTM metres on WGS84, by the series of fourth order in the third flattening [G05]."""
    n = WGS84_F / (2 - WGS84_F)
    scale = 0.9996 * WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    north, east = (y - (10_000_000.0 if south else 0.0)) / scale, (x - 500_000.0) / scale
    xi, eta = north, east
    for j, b in enumerate(beta, 1):
        xi, eta = xi - b * F.sin(2 * j * north) * F.cosh(2 * j * east), eta - b * F.cos(2 * j * north) * F.sinh(2 * j * east)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6.0 * zone - 183.0)


def lambert_degrees(x: Column, y: Column, lat0: float, lng0: float, x0: float, y0: float, k0: float = 1.0) -> tuple[Column, Column]:
    """(lat, lng) of metres of a Lambert conformal conic with one parallel on WGS84 [G05]."""
    e2 = WGS84_F * (2 - WGS84_F)
    e, n, phi = math.sqrt(e2), math.sin(math.radians(lat0)), math.radians(lat0)
    m = math.cos(phi) / math.sqrt(1 - e2 * n * n)
    t0 = math.tan(math.pi / 4 - phi / 2) / ((1 - e * n) / (1 + e * n)) ** (e / 2)
    size = WGS84_A * k0 * m / (n * t0**n)
    east, north = x - x0, size * t0**n - (y - y0)
    chi = F.lit(math.pi / 2) - 2 * F.atan(F.pow(F.sqrt(east * east + north * north) / size, F.lit(1 / n)))
    terms = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
    lat = chi
    for j, c in enumerate(terms, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(east, north) / n) + lng0


def to_degrees(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """(lat, lng) of a point in a known system: WGS84, Web Mercator, its UTM zones or the Jamaica Metric Grid [G05, S18]."""
    if epsg == 4326:
        return y, x
    if epsg == 3857:
        return web_mercator_degrees(x, y)
    if epsg == 3448:  # fixed values of JAD2001
        return lambert_degrees(x, y, 18.0, -77.0, 750_000.0, 650_000.0)
    if 1 <= epsg % 100 <= 60 and epsg // 100 in (326, 327):
        return utm_degrees(x, y, epsg % 100, epsg // 100 == 327)
    raise ValueError(f"EPSG:{epsg} isn't known")


def utm_epsg(lat: Column, lng: Column) -> Column:
    """EPSG code of the UTM zone at a point [G06]."""
    zone = F.floor((lng + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone


def valid_point(lat: Column, lng: Column) -> Column:
    """Whether degrees are those of a point [G08]."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


#: Boxes (south, north, west, east) of the United States and its territories.
US_BOXES = ((24.4, 49.4, -125.0, -66.9), (51.0, 71.5, -180.0, -129.0), (18.9, 22.3, -160.3, -154.8), (17.6, 18.6, -67.3, -64.5), (13.2, 13.7, 144.6, 145.0))


def in_us(lat: Column, lng: Column) -> Column:
    """Whether a point lies in a box of the United States [F09]."""
    out = F.lit(False)
    for s, n, w, e in US_BOXES:
        out = out | (lat.between(s, n) & lng.between(w, e))
    return out


def trend_class(slope: Column, extreme: float, moderate: float) -> Column:
    """Class of a yearly slope by two thresholds [A10]."""
    return (
        F.when(slope.isNull(), "Insufficient")
        .when(slope < -extreme, "Extreme Decline")
        .when(slope < -moderate, "Decline")
        .when(slope <= moderate, "Static")
        .when(slope <= extreme, "Increase")
        .otherwise("Extreme Increase")
    )


def covariance(h: Column, sill: float, reach: float, nugget: float, model: str) -> Column:
    """Covariance at distance h: gaussian, exponential or spherical [I03]."""
    part, r = F.lit(sill - nugget), h / F.lit(reach)
    forms = {
        "gaussian": part * F.exp(-r * r),
        "exponential": part * F.exp(-r),
        "spherical": F.when(r < 1, part * (1 - 1.5 * r + 0.5 * r * r * r)).otherwise(0.0),
    }
    return F.when(h <= 0, part).otherwise(forms[model])


def aqx_id(name: Column, lat: Column, lng: Column) -> Column:
    """Generated id of a well: name and rounded position [P11]."""
    slug = F.substring(F.regexp_replace(slugify(name), "_", "-"), 1, 24)
    named = F.when(F.trim(name) != "", F.concat(slug, F.lit("-"))).otherwise("")
    return F.concat(F.lit("aqx-"), named, F.format_string("%.2f", F.abs(lat)), F.when(lat >= 0, "N").otherwise("S"), F.format_string("%.2f", F.abs(lng)), F.when(lng >= 0, "E").otherwise("W"))


def ramp_index(t: Column) -> Column:
    """Index of a colour in a ramp of 64 [R06]."""
    return F.floor(truncated(t, 0.0, 1.0) * 63 + 0.5).cast("int")
