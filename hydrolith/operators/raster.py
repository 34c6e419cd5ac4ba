"""Products of rasters in long form: (raster, frame_date, cell_id, value) on a grid of nx columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cubic metres in a unit of volume.
CUBIC_METRES = {"m3": 1.0, "ft3": 0.3048**3, "acre-ft": 1233.48, "MCM": 1e6, "km3": 1e9}


def storage_change(frames: DataFrame, areas: DataFrame, storativity: float, unit: str = "m3") -> DataFrame:
    """Change of storage between frames over cells with both values, and its running sum: frames, areas (cell_id, area) [R04, W05]."""
    cell = Window.partitionBy("raster", "cell_id").orderBy("frame_date")
    change = frames.withColumn("dh", F.col("value") - F.lag("value").over(cell)).join(areas, "cell_id")
    per = change.groupBy("raster", "frame_date").agg((F.coalesce(F.sum(F.col("dh") * F.col("area")), F.lit(0.0)) * storativity / CUBIC_METRES[unit]).alias("change"))
    return per.withColumn("cumulative", F.sum("change").over(Window.partitionBy("raster").orderBy("frame_date")))


def cross_section(frames: DataFrame, line: tuple[float, float, float, float], samples: int, grid: tuple[float, float, float, float, int, int]) -> DataFrame:
    """Bilinear values at samples along a line through each frame, null unless all four cells have one [R01].

    line: lng0, lat0, lng1, lat1. grid: min_lng, min_lat, dx, dy, nx, ny; indices count from the corner of the grid.
    """
    x0, y0, x1, y1 = line
    left, low, dx, dy, nx, ny = grid
    t = F.col("id") / F.lit(samples - 1)
    s = frames.sparkSession.range(samples).select(F.col("id").cast("int").alias("sample_idx"), ((x0 + (x1 - x0) * t - left) / dx).alias("fx"), ((y0 + (y1 - y0) * t - low) / dy).alias("fy"))
    s = s.withColumns({"c": F.floor("fx").cast("int"), "r": F.floor("fy").cast("int")}).withColumns({"u": F.col("fx") - F.col("c"), "v": F.col("fy") - F.col("r")})
    s = s.where((F.col("c") >= 0) & (F.col("r") >= 0) & (F.col("c") + 1 < nx) & (F.col("r") + 1 < ny))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)])
    s = s.withColumn("k", F.explode(corners)).withColumn("cell_id", ((F.col("r") + F.col("k.j")) * nx + F.col("c") + F.col("k.i")).cast("int"))
    weight = F.when(F.col("k.i") == 1, F.col("u")).otherwise(1 - F.col("u")) * F.when(F.col("k.j") == 1, F.col("v")).otherwise(1 - F.col("v"))
    both = frames.where("value is not null").join(F.broadcast(s.withColumn("w", weight)), "cell_id")
    return both.groupBy("raster", "frame_date", "sample_idx").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count("*").alias("n")).where("n = 4").drop("n")


def contour_segments(frames: DataFrame, nx: int, levels: int = 8) -> DataFrame:
    """Marching squares: segments (raster, frame_date, level, x0, y0, x1, y1) in cell units, at levels i / (levels + 1) of the range [R03].

    A square is coded by which corners reach the level (top left 8, top right 4, bottom right 2, bottom left 1);
    the two saddles are told apart by the mean of the corners.
    """
    f = frames.where("value is not null")
    limits = f.groupBy("raster", "frame_date").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    c = f.select("raster", "frame_date", "cell_id", "value")

    def shifted(by: int, name: str) -> DataFrame:
        return c.select("raster", "frame_date", (F.col("cell_id") - by).alias("cell_id"), F.col("value").alias(name))

    keys = ["raster", "frame_date", "cell_id"]
    sq = c.withColumnRenamed("value", "bl").join(shifted(1, "br"), keys).join(shifted(nx, "tl"), keys).join(shifted(nx + 1, "tr"), keys).where(F.col("cell_id") % nx < nx - 1)
    sq = sq.join(limits, ["raster", "frame_date"]).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(levels)))).withColumn("level", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (levels + 1))
    at = lambda c: (F.col(c) >= F.col("level")).cast("int")
    sq = sq.withColumn("code", at("tl") * 8 + at("tr") * 4 + at("br") * 2 + at("bl"))
    high = (F.col("tl") + F.col("tr") + F.col("bl") + F.col("br")) / 4 >= F.col("level")

    def part(a: str, b: str):
        d = F.col(b) - F.col(a)
        return F.when(F.abs(d) < 1e-10, 0.5).otherwise((F.col("level") - F.col(a)) / d)

    x, y = (F.col("cell_id") % nx).cast("double"), F.floor(F.col("cell_id") / nx).cast("double")
    points = {"B": (x + part("bl", "br"), y), "T": (x + part("tl", "tr"), y + 1), "L": (x, y + part("bl", "tl")), "R": (x + 1, y + part("br", "tr"))}
    # fixed values: the sides that a contour joins for each code
    joins = {1: ["LB"], 2: ["BR"], 3: ["LR"], 4: ["TR"], 6: ["TB"], 7: ["LT"], 8: ["LT"], 9: ["TB"], 11: ["TR"], 12: ["LR"], 13: ["BR"], 14: ["LB"]}
    seg = lambda s: F.struct(points[s[0]][0].alias("x0"), points[s[0]][1].alias("y0"), points[s[1]][0].alias("x1"), points[s[1]][1].alias("y1"))
    pairs = lambda s: F.array(*[seg(k) for k in s])
    out = F.when(F.col("code") == 5, F.when(high, pairs(["LT", "BR"])).otherwise(pairs(["LB", "TR"])))
    out = out.when(F.col("code") == 10, F.when(high, pairs(["LB", "TR"])).otherwise(pairs(["LT", "BR"])))
    for code, sides in joins.items():
        out = out.when(F.col("code") == code, pairs(sides))
    return sq.withColumn("s", F.explode(out)).select("raster", "frame_date", "i", "level", "s.x0", "s.y0", "s.x1", "s.y1")


def cell_at(frames: DataFrame, lng: float, lat: float, grid: tuple[float, float, float, float, int, int]) -> DataFrame:
    """The value of the cell that holds a point, frame by frame [R02]."""
    left, low, dx, dy, nx, ny = grid
    c, r = int((lng - left) // dx), int((lat - low) // dy)
    return frames.where(F.lit(0 <= c < nx and 0 <= r < ny) & (F.col("cell_id") == r * nx + c)).select("raster", "frame_date", "value")
