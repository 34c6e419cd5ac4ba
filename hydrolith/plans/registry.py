"""Registry of queries: a name, a plan over the tables of a folder, and the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[["Tables"], DataFrame]
_plans: dict[str, Plan] = {}
_sql: dict[str, str] = {}


class Tables:
    """The tables of a folder, seen as wells, aquifers and measurements."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def wells(self) -> DataFrame:
        k, s = F.col("s_nationkey"), F.col("s_suppkey")
        nation = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region_id"))
        return self.read("supplier").join(nation, "s_nationkey").select(
            s.alias("well_id"),
            F.col("s_name").alias("well_name"),
            k.alias("aquifer_id"),
            "region_id",
            F.col("s_acctbal").alias("gse"),
            (37 + k * 0.5 + (s % 10) * 0.03).alias("lat"),
            (-113 + (k % 5) * 0.6 + (s % 7) * 0.04).alias("lng"),
            s.alias("pos"),
        )

    @cached_property
    def measurements(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("well_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
            F.col("l_shipdate").cast("date").alias("obs_date"),
            F.col("l_extendedprice").alias("value"),
            F.col("l_returnflag").alias("data_type"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """The highest value of each well and day: (key, x, y)."""
        return self.measurements.groupBy(F.col("well_id").alias("key"), F.unix_date("obs_date").cast("long").alias("x")).agg(F.max("value").alias("y"))

    @cached_property
    def monthly(self) -> DataFrame:
        """The highest value of each well and month of type A, with the aquifer as group: (grp, key, m, value)."""
        m = (F.year("obs_date") * 12 + F.month("obs_date") - 1).cast("long")
        top = self.measurements.where("data_type = 'A'").groupBy("well_id", m.alias("m")).agg(F.max("value").alias("value"))
        return top.join(self.wells.select("well_id", F.col("aquifer_id").alias("grp")), "well_id").select("grp", F.col("well_id").alias("key"), "m", "value")

    @cached_property
    def aquifers(self) -> DataFrame:
        """A hexagon for each nation: (aquifer_id, aquifer_name, region_id, pos, ring)."""
        k = F.col("n_nationkey")
        x, y = -113 + (k % 5) * 0.6 + 0.12, 37 + k * 0.5 + 0.15
        ring = F.array(*[F.array(x + dx, y + dy) for dx, dy in HEXAGON])
        return self.read("nation").select(k.alias("aquifer_id"), F.col("n_name").alias("aquifer_name"), F.col("n_regionkey").alias("region_id"), k.alias("pos"), ring.alias("ring"))

    @cached_property
    def mean_wells(self) -> DataFrame:
        """Each well with its highest value of type R: (aquifer_id, well_id, w_lat, w_lng, value)."""
        top = self.measurements.where("data_type = 'R'").groupBy("well_id").agg(F.max("value").alias("value"))
        return self.wells.join(top, "well_id").select("aquifer_id", "well_id", F.col("lat").alias("w_lat"), F.col("lng").alias("w_lng"), "value")

    @cached_property
    def frames(self) -> DataFrame:
        """Rasters of 20 x 10 cells: a raster a region, a frame a year, sums of order prices: (raster, frame_date, cell_id, value)."""
        c = self.read("customer").join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        o = self.read("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
        cell = (F.col("o_custkey") % 200).cast("int")
        return o.groupBy(F.col("n_regionkey").alias("raster"), F.trunc("o_orderdate", "year").alias("frame_date"), cell.alias("cell_id")).agg(F.max("o_totalprice").alias("value"))


HEXAGON = ((0.3, 0.0), (0.15, 0.25), (-0.15, 0.25), (-0.3, 0.0), (-0.15, -0.25), (0.15, -0.25))

#: The same tables for the SQL side.
CTES = {
    "well": """well AS (SELECT s_suppkey AS well_id, s_name AS well_name, s_nationkey AS aquifer_id, n_regionkey AS region_id, s_acctbal AS gse,
  37 + s_nationkey * 0.5::DOUBLE + (s_suppkey % 10) * 0.03::DOUBLE AS lat, -113 + (s_nationkey % 5) * 0.6::DOUBLE + (s_suppkey % 7) * 0.04::DOUBLE AS lng, s_suppkey AS pos
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "meas": """meas AS (SELECT l_suppkey AS well_id, l_orderkey * 10 + l_linenumber AS pos, l_shipdate::DATE AS obs_date, l_extendedprice AS value, l_returnflag AS data_type FROM lineitem)""",
    "daily": """daily AS (SELECT well_id AS key, date_diff('day', DATE '1970-01-01', obs_date) AS x, max(value) AS y FROM meas GROUP BY 1, 2)""",
    "monthly": """monthly AS (SELECT aquifer_id AS grp, m.well_id AS key, (year(obs_date) * 12 + month(obs_date) - 1)::BIGINT AS m, max(value) AS value
  FROM meas m JOIN well USING (well_id) WHERE data_type = 'A' GROUP BY 1, 2, 3)""",
    "edge": """hexa AS (SELECT n_nationkey AS aquifer_id, n_name AS aquifer_name, n_regionkey AS region_id, -113 + (n_nationkey % 5) * 0.6::DOUBLE + 0.12::DOUBLE AS x, 37 + n_nationkey * 0.5::DOUBLE + 0.15::DOUBLE AS y FROM nation),
corner AS (SELECT * FROM (VALUES (0, 0.3::DOUBLE, 0.0::DOUBLE), (1, 0.15, 0.25), (2, -0.15, 0.25), (3, -0.3, 0.0), (4, -0.15, -0.25), (5, 0.15, -0.25)) v(k, dx, dy)),
edge AS (SELECT aquifer_id, region_id, a.k, x + a.dx AS x0, y + a.dy AS y0, x + b.dx AS x1, y + b.dy AS y1 FROM hexa, corner a, corner b WHERE b.k = (a.k + 1) % 6)""",
    "topwell": """topwell AS (SELECT aquifer_id, w.well_id, lat AS w_lat, lng AS w_lng, max(value) AS value FROM well w JOIN meas m USING (well_id) WHERE data_type = 'R' GROUP BY ALL)""",
    "frame": """frame AS (SELECT n_regionkey AS raster, date_trunc('year', o_orderdate)::DATE AS frame_date, (o_custkey % 200)::INTEGER AS cell_id, max(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""",
}
NEEDS = {"daily": ["meas"], "monthly": ["meas", "well"], "topwell": ["meas", "well"]}


def r(expression: str, digits: int = 4) -> str:
    """SQL of scalars.js_round."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def sql(body: str, *tables: str) -> str:
    """A query over the tables named; body may begin with further common tables ('name AS (...), ... SELECT')."""
    wanted: list[str] = []
    for t in tables:
        wanted += [x for x in [*NEEDS.get(t, []), t] if x not in wanted]
    ctes = ",\n".join(CTES[t] for t in wanted)
    joint = "" if body.lstrip().upper().startswith("SELECT") else ",\n"
    return (f"WITH {ctes}{joint} {body}" if ctes else (body if not joint else f"WITH {body}")).strip()


#: Queries that return dates; both sides give them as text.
DATED = {
    "F02_date_range": "obs_date",
    "F03_clamp_range": "lo hi",
    "F04_span_overlap": "first_date last_date",
    "F12_dedup_catalog": "date",
    "F13_average_duplicates": "obs_date",
    "F13_maximum_duplicates": "obs_date",
    "J04_upsert": "obs_date",
    "J16_nearest_month": "month",
    "J18_active_wells": "frame_date",
    "J19_wide_times": "t",
    "W02_first_by_key": "obs_date",
    "W09_union": "obs_date",
    "W10_intersect_except": "obs_date",
    "T08_month_grid": "month",
    "T15_temporal_smooth": "frame_date",
    "T16_temporal_linear": "frame_date",
    "T16_temporal_step": "frame_date",
    "T20_resample": "month",
    "I13_raster_frames": "frame_date",
    "I13_raster_pipeline": "frame_date",
    "R01_cross_section": "frame_date",
    "R02_cell_at": "frame_date",
    "R03_contours": "frame_date",
    "R04_storage_change": "frame_date",
    "A01_group": "first_date last_date",
    "A05_density": "bin_start",
    "A07_data_span": "first_date last_date",
    "A13_frame_statistics": "frame_date",
    "A15_bands": "frame_date",
    "A17_monthly_mean": "month",
    "A18_pivot": "obs_date",
    "S19_monthly_sums": "month",
}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under a name of the inventory."""

    def add(plan: Plan) -> Plan:
        if name in _plans:
            raise ValueError(f"{name} is registered already")
        _plans[name] = plan
        if oracle is not None:
            texts = ", ".join(f"{c}::VARCHAR AS {c}" for c in DATED.get(name, "").split())
            _sql[name] = f"SELECT * REPLACE ({texts}) FROM ({oracle})" if texts else oracle
        return plan

    return add


def _load() -> None:
    from hydrolith.plans import cleaning, imputation, series, spatial, text, trends  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bound(name: str, plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        dates = DATED.get(name, "").split()
        return lambda spark, folder: plan(Tables(spark, folder)).withColumns({c: F.col(c).cast("string") for c in dates})

    return {name: bound(name, plan) for name, plan in _plans.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
