"""Series in time: interpolation, smoothing, grids, gaps and features. Series have (key, x, y): x in days, one row an x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_A_MONTH = 30.4375


def segments(series: DataFrame, key: str = "key") -> DataFrame:
    """Knots with the width h and slope d of the segment to the next, n, and i from 1 [W03]."""
    w = Window.partitionBy(key).orderBy("x")
    s = series.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    s = s.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w))
    return s.withColumn("h", (F.col("x1") - F.col("x")).cast("double")).withColumn("d", (F.col("y1") - F.col("y")) / F.col("h"))


def _end(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Derivative at an end from its two segments."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.sign(s) != F.sign(d0), 0.0).when((F.sign(d0) != F.sign(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def pchip_segments(series: DataFrame, key: str = "key") -> DataFrame:
    """Segments with the derivatives m0 and m1 at their ends of the monotone cubic [T02]."""
    w = Window.partitionBy(key).orderBy("x")
    s = segments(series, key)
    hb, db = F.lag("h").over(w), F.lag("d").over(w)
    hb2, db2 = F.lag("h", 2).over(w), F.lag("d", 2).over(w)
    hn, dn = F.lead("h").over(w), F.lead("d").over(w)
    s = s.withColumns({"hb": hb, "db": db, "hb2": hb2, "db2": db2, "hn": hn, "dn": dn})
    w1, w2 = 2 * F.col("h") + F.col("hb"), F.col("h") + 2 * F.col("hb")
    inner = F.when(F.col("db") * F.col("d") <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.col("db") + w2 / F.col("d")))
    m = (
        F.when(F.col("n") == 1, 0.0)
        .when(F.col("n") == 2, F.coalesce("d", "db"))
        .when(F.col("i") == 1, _end(F.col("h"), F.col("hn"), F.col("d"), F.col("dn")))
        .when(F.col("i") == F.col("n"), _end(F.col("hb"), F.col("hb2"), F.col("db"), F.col("db2")))
        .otherwise(inner)
    )
    s = s.withColumn("m0", m)
    return s.withColumn("m1", F.lead("m0").over(w)).select(key, "i", "n", "x", "y", "x1", "y1", "h", "d", "m0", "m1")


def on_grid(knots: DataFrame, step: int) -> DataFrame:
    """Each segment with the multiples of step in it, the last knot's own with the last segment [T03, J17].

    Targets are made from the segment itself, so no range join is needed: that is a map.
    """
    last = F.col("i") == F.col("n") - 1
    first = (F.ceil(F.col("x") / step) * step).cast("long")
    stop = F.when(last, F.floor(F.col("x1") / step) * step).otherwise(F.ceil(F.col("x1") / step) * step - step).cast("long")
    only = (F.col("n") == 1) & (F.col("x") % step == 0)
    grid = F.when(only, F.array(F.col("x").cast("long"))).when(F.col("x1").isNotNull() & (first <= stop), F.sequence(first, stop, F.lit(step).cast("long")))
    return knots.withColumn("t", F.explode(grid))


def linear(series: DataFrame, step: int, key: str = "key") -> DataFrame:
    """(key, t, y) by straight lines at multiples of step within the span [T01]."""
    g = on_grid(segments(series, key), step)
    return g.select(key, "t", F.when(F.col("x1").isNull(), F.col("y")).otherwise(F.col("y") + F.col("d") * (F.col("t") - F.col("x"))).alias("y"))


def pchip(series: DataFrame, step: int, key: str = "key") -> DataFrame:
    """(key, t, y) by monotone cubics at multiples of step within the span [T02, T03]."""
    return on_grid(pchip_segments(series, key), step).select(key, "t", _cubic().alias("y"))


def _cubic() -> Column:
    """Value at t of the cubic of the segment that it falls in; the knot's own where the segment has no end."""
    u = (F.col("t") - F.col("x")) / F.col("h")
    u2, u3 = u * u, u * u * u
    value = (2 * u3 - 3 * u2 + 1) * F.col("y") + (u3 - 2 * u2 + u) * F.col("h") * F.col("m0") + (-2 * u3 + 3 * u2) * F.col("y1") + (u3 - u2) * F.col("h") * F.col("m1")
    return F.when(F.col("x1").isNull(), F.col("y")).otherwise(value)


def at_times(knots: DataFrame, times: DataFrame, key: str = "key") -> DataFrame:
    """times (key, t, …) with the columns of the last knot at or before t; times outside the span of knots go [J17, T03].

    One ordered pass over knots and times, so any times do and no range join is needed.
    """
    own = [c for c in times.columns if c not in (key, "t")]
    held = F.struct(*[c for c in knots.columns if c != key])
    left = knots.select(key, F.col("x").cast("double").alias("t"), held.alias("__knot"), F.lit(0).alias("__side"))
    right = times.select(key, F.col("t").cast("double").alias("t"), F.lit(1).alias("__side"), *own)
    w = Window.partitionBy(key).orderBy("t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__knot", F.last("__knot", True).over(w))
    both = both.where("__side = 1 and (__knot.x1 is not null or t = __knot.x)")
    return both.select(key, "t", *own, "__knot.*")


def pchip_at(series: DataFrame, times: DataFrame, key: str = "key") -> DataFrame:
    """times (key, t, …) within the span with y by monotone cubics [T02, T03]."""
    own = [c for c in times.columns if c != key and c != "t"]
    return at_times(pchip_segments(series, key), times, key).select(key, "t", *own, _cubic().alias("y"))


def linear_at(series: DataFrame, times: DataFrame, key: str = "key") -> DataFrame:
    """times (key, t, …) within the span with y by straight lines [T01, T03]."""
    own = [c for c in times.columns if c != key and c != "t"]
    y = F.when(F.col("x1").isNull(), F.col("y")).otherwise(F.col("y") + F.col("d") * (F.col("t") - F.col("x")))
    return at_times(segments(series, key), times, key).select(key, "t", *own, y.alias("y"))


def open_ended(grid: DataFrame, series: DataFrame, key: str = "key") -> DataFrame:
    """grid (key, t, …) without times at or after the last knot [T03]."""
    last = series.groupBy(key).agg(F.max("x").alias("__last"))
    return grid.join(last, key).where("t < __last").drop("__last")


def smooth_at(series: DataFrame, times: DataFrame, months: float, key: str = "key") -> DataFrame:
    """times (key, t, …) within the span: Gaussian means at the knots, monotone cubics between them [T04, T05]."""
    return pchip_at(kernel_smooth(series, months, key), times, key)


def monthly_times(series: DataFrame, key: str = "key") -> DataFrame:
    """(key, t) every month from the first knot to the last [T07]. Days that a month lacks run into the next month and stay there."""
    span = series.groupBy(key).agg(F.min("x").alias("a"), F.max("x").alias("z"), F.count("*").alias("n")).where("n >= 2")
    first, month = F.date_from_unix_date(F.col("a").cast("int")), F.trunc(F.date_from_unix_date(F.col("a").cast("int")), "month")
    short = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda k: F.day(first) > F.day(F.last_day(F.add_months(month, k))))
    span = span.withColumns({"first": first, "month": month, "short": F.get(short, F.lit(0))})
    over = F.last_day(F.add_months("month", F.col("short")))
    span = span.withColumn("moved", F.date_add(over, (F.day("first") - F.day(over)).cast("int")))
    count = F.floor((F.col("z") - F.col("a")) / 28).cast("int") + 1
    k = span.withColumn("k", F.explode(F.sequence(F.lit(0), count)))
    date = F.when(F.col("short").isNull() | (F.col("k") < F.col("short")), F.add_months("first", F.col("k"))).otherwise(F.add_months("moved", F.col("k") - F.col("short")))
    return k.select(key, F.unix_date(date).cast("double").alias("t"), "z").where("t <= z").drop("z")


def chart_series(series: DataFrame, steps: int | None = 100, key: str = "key") -> DataFrame:
    """(key, t, y, observed): a span in equal steps by monotone cubics, and the knots themselves, which win [T06].

    Without ``steps``, three a knot and 50 at most. A series of one time has its knot only.
    """
    span = series.groupBy(key).agg(F.min("x").alias("a"), F.max("x").alias("z"), F.count("*").alias("n")).where("z > a")
    n = F.lit(steps) if steps is not None else F.least(F.lit(50), F.col("n") * 3).cast("int")
    times = span.withColumn("m", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m")))).select(key, (F.col("a") + (F.col("z") - F.col("a")) * F.col("k") / F.col("m")).alias("t"))
    line = pchip_at(series, times, key).withColumn("observed", F.lit(False))
    both = line.unionByName(series.select(key, F.col("x").cast("double").alias("t"), "y", F.lit(True).alias("observed")))
    return both.groupBy(key, "t").agg(F.max_by("y", "observed").alias("y"), F.max("observed").alias("observed"))


def fill_small_gaps(monthly: DataFrame, longest: int = 24, pad: int = 6, key: str = "key") -> DataFrame:
    """(key, m, value, observed) of each month of a span: gaps filled by monotone cubics, but for the inside of longer ones [T10].

    monthly: key, m, value. Of a gap of more than ``longest`` months only ``pad`` at either end are filled; series
    of fewer than three months stay as they are.
    """
    knots = pchip_segments(monthly.select(key, F.col("m").alias("x"), F.col("value").alias("y")), key)
    g = on_grid(knots, 1)
    seen = F.col("x1").isNull() | (F.col("t") == F.col("x")) | (F.col("t") == F.col("x1"))
    inside = (F.col("x1") - F.col("x") - 1 > longest) & (F.col("t") >= F.col("x") + pad + 1) & (F.col("t") <= F.col("x1") - pad - 1)
    value = F.when(seen | (~inside & (F.col("n") >= 3)), _cubic())
    return g.select(key, F.col("t").alias("m"), value.alias("value"), seen.alias("observed"))


def qualified_series(series: DataFrame, least: int, span_years: float, key: str = "key") -> DataFrame:
    """Series of enough knots, two at least, and long enough [A04]."""
    good = series.groupBy(key).agg(F.count("*").alias("__n"), ((F.max("x") - F.min("x")) / 365.25).alias("__span"))
    return series.join(good.where((F.col("__n") >= max(2, least)) & (F.col("__span") >= span_years)).select(key), key, "left_semi")


def temporal_step(series: DataFrame, start: str, end: str, months: int, method: str = "pchip", least: int = 2, span_years: float = 0.0, window: float = 12, key: str = "key") -> DataFrame:
    """(key, frame_date, value) at dates so many months apart within each qualified series' span [T16, T15].

    method: 'pchip', 'linear' or 'moving-average', whose window is in months.
    """
    good = qualified_series(series, least, span_years, key)
    step = F.expr(f"interval {months} month")
    dates = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), step)
    spans = good.groupBy(key).agg(F.min("x").alias("a"), F.max("x").alias("z"))
    times = spans.withColumn("frame_date", F.explode(dates)).withColumn("t", F.unix_date("frame_date").cast("double")).where("t between a and z").select(key, "t", "frame_date")
    found = {"pchip": pchip_at, "linear": linear_at, "moving-average": lambda s, t, k: smooth_at(s, t, window, k)}[method](good, times, key)
    return found.select(key, "frame_date", F.col("y").alias("value"))


def resample_months(series: DataFrame, key: str = "key") -> DataFrame:
    """(key, month, y) at the first of each month within the span by monotone cubics [T20]."""
    span = series.groupBy(key).agg(F.date_from_unix_date(F.min("x").cast("int")).alias("start"), F.date_from_unix_date(F.max("x").cast("int")).alias("end"))
    times = month_grid(span).select(key, F.unix_date("month").cast("double").alias("t"), "month")
    return pchip_at(series, times, key).select(key, "month", "y")


def kernel_smooth(series: DataFrame, months: float, key: str = "key") -> DataFrame:
    """(key, x, y): Gaussian means at the knots; sigma is a quarter of the months, points beyond four sigma don't count [T04].

    Knots meet those of their own and the two neighbouring blocks of four sigma, by equality.
    """
    sigma = months * DAYS_A_MONTH / 4
    width = 4 * sigma
    s = series.withColumn("b", F.floor(F.col("x") / width).cast("long"))
    around = s.select(key, F.col("x").alias("x0"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    both = around.join(s, [key, "b"]).where(F.abs(F.col("x") - F.col("x0")) <= width)
    z = (F.col("x") - F.col("x0")) / F.lit(sigma)
    weight = F.exp(-0.5 * z * z)
    return both.groupBy(key, "x0").agg((F.sum(weight * F.col("y")) / F.sum(weight)).alias("y")).withColumnRenamed("x0", "x")


def month_grid(spans: DataFrame, months: int = 1) -> DataFrame:
    """spans (…, start, end) with each month start from that of start on [T08]."""
    grid = F.sequence(F.trunc("start", "month"), F.col("end"), F.expr(f"interval {months} month"))
    return spans.withColumn("month", F.explode(grid)).withColumn("month", F.col("month").cast("date"))


def gaps(series: DataFrame, longer_than: int, key: str = "key") -> DataFrame:
    """(key, x, x1): neighbouring knots more than so many days apart [T09]."""
    return segments(series, key).where(F.col("x1") - F.col("x") > longer_than).select(key, "x", "x1")


def blank_gaps(grid: DataFrame, series: DataFrame, longer_than: int, pad: int, key: str = "key") -> DataFrame:
    """grid (key, t, y) with y null from pad days after a gap's start to pad days before its end [T09].

    The segment that a time falls in is the last knot at or before it, found by one ordered pass over both.
    """
    g = segments(series, key).select(key, F.col("x").alias("t"), F.col("x").alias("x0"), "x1", F.lit(0).alias("side"), F.lit(None).cast("double").alias("y"))
    both = grid.select(key, "t", F.lit(None).cast("long").alias("x0"), F.lit(None).cast("long").alias("x1"), F.lit(1).alias("side"), "y").unionByName(g)
    w = Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"a": F.last("x0", True).over(w), "z": F.last(F.when(F.col("side") == 0, F.coalesce("x1", F.lit(-1))), True).over(w)})
    blank = (F.col("z") - F.col("a") > longer_than) & (F.col("t") >= F.col("a") + pad) & (F.col("t") <= F.col("z") - pad)
    return both.where("side = 1").select(key, "t", F.when(~F.coalesce(blank, F.lit(False)), F.col("y")).alias("y"))


def rolling_mean(df: DataFrame, key: list[str], order: str, value: str, n: int) -> Column:
    """Mean of the last n rows, null until there are n [T11, W04]."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def missing_runs(monthly: DataFrame, key: str = "key") -> DataFrame:
    """(key, start, length) of runs of missing months between observed ones: monthly (key, m) with m a month number [T10, T12]."""
    w = Window.partitionBy(key).orderBy("m")
    nxt = F.lead("m").over(w)
    return monthly.withColumn("nxt", nxt).where(F.col("nxt") - F.col("m") > 1).select(key, (F.col("m") + 1).alias("start"), (F.col("nxt") - F.col("m") - 1).alias("length"))


def zscore(df: DataFrame, key: list[str], value: str) -> Column:
    """(value - mean) / sample deviation by key; a deviation of none or 0 counts as 1 [T17, T18]."""
    w = Window.partitionBy(*key)
    s = F.stddev_samp(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(F.coalesce(s, F.lit(0.0)) == 0, 1.0).otherwise(s)


def combined(observed: Column, small: Column, model: Column) -> tuple[Column, Column]:
    """The value that counts and where it comes from [T19]."""
    stage = F.when(observed.isNotNull(), "observed").when(small.isNotNull(), "small_gap_pchip").when(model.isNotNull(), "large_gap_mc_lnn_iterative").otherwise("unfilled")
    return F.coalesce(observed, small, model), stage
