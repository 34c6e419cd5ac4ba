"""Queries of series in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.operators import series as T
from hydrolith.plans.registry import query, r, sql

SEG = """sg AS (SELECT key, x, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY key) AS n, lead(x) OVER w AS x1, lead(y) OVER w AS y1, (lead(x) OVER w - x)::DOUBLE AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x)::DOUBLE AS d FROM daily WINDOW w AS (PARTITION BY key ORDER BY x)),
gt AS (SELECT (i * 30)::BIGINT AS t FROM range(0, 500) g(i))"""
END = "CASE WHEN sign(((2 * {0} + {1}) * {2} - {0} * {3}) / ({0} + {1})) <> sign({2}) THEN 0 WHEN sign({2}) <> sign({3}) AND abs(((2 * {0} + {1}) * {2} - {0} * {3}) / ({0} + {1})) > 3 * abs({2}) THEN 3 * {2} ELSE ((2 * {0} + {1}) * {2} - {0} * {3}) / ({0} + {1}) END"
PCHIP = f"""{SEG}, nb AS (SELECT *, lag(h) OVER w AS hb, lag(d) OVER w AS db, lag(h, 2) OVER w AS hb2, lag(d, 2) OVER w AS db2, lead(h) OVER w AS hn, lead(d) OVER w AS dn FROM sg WINDOW w AS (PARTITION BY key ORDER BY x)),
sl AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN coalesce(d, db) WHEN i = 1 THEN {END.format('h', 'hn', 'd', 'dn')} WHEN i = n THEN {END.format('hb', 'hb2', 'db', 'db2')}
  WHEN db * d <= 0 THEN 0 ELSE (2 * h + hb + h + 2 * hb) / ((2 * h + hb) / db + (h + 2 * hb) / d) END AS m0 FROM nb),
sm AS (SELECT *, lead(m0) OVER (PARTITION BY key ORDER BY x) AS m1 FROM sl),
pv AS (SELECT key, t, (t - x) / h AS u, y, y1, h, m0, m1 FROM sm JOIN gt ON (t >= x AND (t < x1 OR i = n - 1 AND t = x1)))
"""


@query("T01_linear", sql(f"{SEG} SELECT key, t, {r('y + d * (t - x)', 5)} AS y FROM sg JOIN gt ON (t >= x AND (t < x1 OR i = n - 1 AND t = x1))", "daily"))
def _(t):
    return T.linear(t.daily, 30).select("key", "t", S.js_round(F.col("y"), 5).alias("y"))


@query("T02_pchip", sql(f"{PCHIP} SELECT key, t, {r('(2 * u * u * u - 3 * u * u + 1) * y + (u * u * u - 2 * u * u + u) * h * m0 + (-2 * u * u * u + 3 * u * u) * y1 + (u * u * u - u * u) * h * m1', 7)} AS y FROM pv", "daily"))
def _(t):
    return T.pchip(t.daily, 30).select("key", "t", S.js_round(F.col("y"), 7).alias("y"))


W4 = "(12 * 30.4375::DOUBLE / 4)"


@query("T04_kernel_smooth", sql(f"SELECT a.key, a.x, {r(f'sum(exp(-0.5 * pow((b.x - a.x) / {W4}, 2)) * b.y) / sum(exp(-0.5 * pow((b.x - a.x) / {W4}, 2)))', 3)} AS y FROM daily a JOIN daily b ON a.key = b.key AND abs(a.x - b.x) <= 4 * {W4} GROUP BY ALL", "daily"))
def _(t):
    return T.kernel_smooth(t.daily, 12).select("key", "x", S.js_round(F.col("y"), 3).alias("y"))


@query("T08_month_grid", sql("s AS (SELECT well_id, date_trunc('month', min(obs_date)) AS a, max(obs_date) AS z FROM meas GROUP BY 1) SELECT well_id, unnest(generate_series(a, z::TIMESTAMP, INTERVAL 3 MONTH))::DATE AS month FROM s", "meas"))
def _(t):
    spans = t.measurements.groupBy("well_id").agg(F.min("obs_date").alias("start"), F.max("obs_date").alias("end"))
    return T.month_grid(spans, 3).select("well_id", "month")


@query("T09_blank_gaps", sql(f"{SEG} SELECT key, t, CASE WHEN x1 - x > 10 AND t >= x + 3 AND t <= x1 - 3 THEN NULL ELSE 1.0::DOUBLE END AS y FROM sg JOIN gt ON (t >= x AND (t < x1 OR i = n - 1 AND t = x1))", "daily"))
def _(t):
    grid = T.linear(t.daily, 30).select("key", "t", F.lit(1.0).alias("y"))
    return T.blank_gaps(grid, t.daily, 10, 3)


@query("T11_rolling_mean", f"SELECT event_id, CASE WHEN count(*) OVER w = 12 THEN {r('avg(value) OVER w', 5)} END AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def _(t):
    e = t.read("events")
    return e.select("event_id", S.js_round(T.rolling_mean(e, ["event_type"], "event_id", "value", 12), 5).alias("mean"))


@query("T12_missing_runs", sql("s AS (SELECT key, m, lead(m) OVER (PARTITION BY key ORDER BY m) AS nxt FROM monthly) SELECT key, m + 1 AS start, nxt - m - 1 AS length FROM s WHERE nxt - m > 1", "monthly"))
def _(t):
    return T.missing_runs(t.monthly.select("key", "m"))


@query("T13_protected", sql("b AS (SELECT key, min(m) AS a, max(m) AS z FROM monthly GROUP BY key) SELECT key, m, m < a OR m > z AS protected FROM b, range(23930, 24030, 5) g(m)", "monthly"))
def _(t):
    b = t.monthly.groupBy("key").agg(F.min("m").alias("a"), F.max("m").alias("z"))
    g = b.withColumn("m", F.explode(F.sequence(F.lit(23930).cast("long"), F.lit(24029).cast("long"), F.lit(5).cast("long"))))
    return g.select("key", "m", ((F.col("m") < F.col("a")) | (F.col("m") > F.col("z"))).alias("protected"))


@query("T14_enough_samples", sql("SELECT key, count(*) AS n FROM monthly GROUP BY key HAVING count(*) >= 40", "monthly"))
def _(t):
    return t.monthly.groupBy("key").agg(F.count("*").alias("n")).where("n >= 40")


@query("T17_features", sql(f"f AS (SELECT key, m, {r('(value - avg(value) OVER w) / coalesce(nullif(stddev_samp(value) OVER w, 0), 1)', 5)} AS z, {r('(m - min(m) OVER w) / greatest(max(m) OVER w - min(m) OVER w, 1)::DOUBLE', 6)} AS year_part, (m % 12)::BIGINT AS month FROM monthly WINDOW w AS (PARTITION BY key)) SELECT key, m, z, year_part, " + ", ".join(f"(month = {k})::INTEGER AS m{k}" for k in range(12)) + " FROM f", "monthly"))
def _(t):
    w = Window.partitionBy("key")
    part = (F.col("m") - F.min("m").over(w)) / F.greatest(F.max("m").over(w) - F.min("m").over(w), F.lit(1))
    s = t.monthly
    months = [(F.col("m") % 12 == k).cast("int").alias(f"m{k}") for k in range(12)]
    return s.select("key", "m", S.js_round(T.zscore(s, ["key"], "value"), 5).alias("z"), S.js_round(part, 6).alias("year_part"), *months)


@query("T18_zscore", sql(f"SELECT pos, {r('(value - avg(value) OVER w) / coalesce(nullif(stddev_samp(value) OVER w, 0), 1)', 6)} AS z FROM meas WINDOW w AS (PARTITION BY well_id, data_type)", "meas"))
def _(t):
    m = t.measurements
    return m.select("pos", S.js_round(T.zscore(m, ["well_id", "data_type"], "value"), 6).alias("z"))


@query("T19_combined", "SELECT l_orderkey, l_linenumber, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'observed' WHEN b IS NOT NULL THEN 'small_gap_pchip' WHEN c IS NOT NULL THEN 'large_gap_mc_lnn_iterative' ELSE 'unfilled' END AS stage FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS a, CASE WHEN l_linestatus = 'O' THEN l_tax END AS b, CASE WHEN l_linenumber < 4 THEN l_discount END AS c FROM lineitem)")
def _(t):
    x = t.read("lineitem")
    value, stage = T.combined(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")), F.when(F.col("l_linestatus") == "O", F.col("l_tax")), F.when(F.col("l_linenumber") < 4, F.col("l_discount")))
    return x.select("l_orderkey", "l_linenumber", value.alias("value"), stage.alias("stage"))


@query("W03_lead_lag", sql("SELECT key, x, x1 - x AS h FROM (SELECT key, x, lead(x) OVER (PARTITION BY key ORDER BY x) AS x1 FROM daily)", "daily"))
def _(t):
    return T.segments(t.daily).select("key", "x", (F.col("x1") - F.col("x")).alias("h"))


@query("W05_running_sum", sql(f"SELECT pos, {r('sum(value) OVER (PARTITION BY well_id ORDER BY obs_date, pos)', 2)} AS total FROM meas", "meas"))
def _(t):
    w = Window.partitionBy("well_id").orderBy("obs_date", "pos")
    return t.measurements.select("pos", S.js_round(F.sum("value").over(w), 2).alias("total"))


#: The knots with slopes, and the cubic at times tt (key, t).
SLOPES = PCHIP.split("\npv AS")[0].rstrip().rstrip(",")
CUBIC = "(2 * u * u * u - 3 * u * u + 1) * y + (u * u * u - 2 * u * u + u) * h * m0 + (-2 * u * u * u + 3 * u * u) * y1 + (u * u * u - u * u) * h * m1"
AT = "av AS (SELECT sm.key, t, (t - x) / h AS u, y, y1, h, m0, m1 FROM sm JOIN tt ON tt.key = sm.key AND (t >= x AND (t < x1 OR i = n - 1 AND t = x1)))"


@query("T03_open_end", sql(f"{PCHIP}, e AS (SELECT key, max(x) AS z FROM daily GROUP BY key) SELECT pv.key, t, {r(CUBIC, 7)} AS y FROM pv JOIN e ON e.key = pv.key AND t < z", "daily"))
def _(t):
    return T.open_ended(T.pchip(t.daily, 30), t.daily).select("key", "t", S.js_round(F.col("y"), 7).alias("y"))


@query("T06_chart_series", sql(f"{SLOPES}, sp AS (SELECT key, min(x) AS a, max(x) AS z FROM daily GROUP BY key HAVING max(x) > min(x)), tt AS (SELECT key, a + (z - a) * k / 100.0::DOUBLE AS t FROM sp, range(0, 101) g(k)), {AT} SELECT key, t, {r(CUBIC, 6)} AS y, false AS observed FROM av WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.key = av.key AND d.x = av.t) UNION ALL SELECT key, x::DOUBLE, {r('y', 6)}, true FROM daily", "daily"))
def _(t):
    return T.chart_series(t.daily).withColumn("y", S.js_round(F.col("y"), 6))


@query("T06_preview", sql(f"{SLOPES}, sp AS (SELECT key, min(x) AS a, max(x) AS z, least(50, 3 * count(*)) AS m FROM daily GROUP BY key HAVING max(x) > min(x)), tt AS (SELECT key, a + (z - a) * k / m::DOUBLE AS t FROM sp, range(0, 51) g(k) WHERE k <= m), {AT} SELECT key, t, {r(CUBIC, 6)} AS y FROM av WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.key = av.key AND d.x = av.t)", "daily"))
def _(t):
    line = T.chart_series(t.daily, None).where("not observed")
    return line.select("key", "t", S.js_round(F.col("y"), 6).alias("y"))


SMOOTHED = f"sk AS (SELECT a.key, a.x, sum(exp(-0.5 * pow((b.x - a.x) / {W4}, 2)) * b.y) / sum(exp(-0.5 * pow((b.x - a.x) / {W4}, 2))) AS y FROM daily a JOIN daily b ON a.key = b.key AND abs(a.x - b.x) <= 4 * {W4} GROUP BY ALL), {SLOPES.replace('FROM daily', 'FROM sk')}"


@query("T05_smooth_model", sql(f"{SMOOTHED}, tt AS (SELECT key, k::DOUBLE AS t FROM (SELECT key, min(x) AS a, max(x) AS z FROM daily GROUP BY key), range(0, 15000, 30) g(k) WHERE k BETWEEN a AND z), {AT} SELECT key, t, {r(CUBIC, 3)} AS y FROM av", "daily"))
def _(t):
    times = T.on_grid(T.segments(t.daily), 30).select("key", "t")
    return T.smooth_at(t.daily, times, 12).select("key", "t", S.js_round(F.col("y"), 3).alias("y"))


@query("T07_monthly_line", sql(f"""{SMOOTHED}, f AS (SELECT key, DATE '1970-01-01' + min(x)::INTEGER AS f, max(x) AS z FROM daily GROUP BY key HAVING count(*) >= 2),
s AS (SELECT *, list_filter(range(1, 13), lambda k: day(f) > day(last_day(date_trunc('month', f) + to_months(k::INTEGER))))[1] AS k0 FROM f),
mv AS (SELECT *, last_day(date_trunc('month', f) + to_months(k0::INTEGER))::DATE AS e FROM s),
tt AS (SELECT * FROM (SELECT key, z, date_diff('day', DATE '1970-01-01', (CASE WHEN k0 IS NULL OR k < k0 THEN f + to_months(k::INTEGER) ELSE e + (day(f) - day(e))::INTEGER + to_months((k - k0)::INTEGER) END)::DATE)::DOUBLE AS t FROM mv, range(0, 150) g(k)) WHERE t <= z), {AT}
SELECT key, t, {r(CUBIC, 3)} AS y FROM av""", "daily"))
def _(t):
    return T.smooth_at(t.daily, T.monthly_times(t.daily), 12).select("key", "t", S.js_round(F.col("y"), 3).alias("y"))


MONTHLY_AS_DAILY = "daily AS (SELECT key, m AS x, value AS y FROM monthly)"


@query("T10_small_gaps", sql(f"{MONTHLY_AS_DAILY}, {SLOPES}, tt AS (SELECT sg.key, g.k AS t FROM (SELECT key, min(x) AS a, max(x) AS z FROM sg GROUP BY key) sg, range(23000, 25000) g(k) WHERE k BETWEEN a AND z), {AT.replace('t, (t - x)', 't, x, x1, n, (t - x)')} SELECT key, t::BIGINT AS m, CASE WHEN t = x OR t = x1 OR n >= 3 AND NOT (x1 - x - 1 > 2 AND t >= x + 1 AND t <= x1 - 1) THEN {r(CUBIC, 6)} END AS value, t = x OR t = x1 AS observed FROM av", "monthly"))
def _(t):
    f = T.fill_small_gaps(t.monthly.select("key", "m", "value"), 2, 0)
    return f.withColumn("value", S.js_round(F.col("value"), 6))


STEP = "gd AS (SELECT ok.key, a, z, (DATE '1994-01-01' + to_months(3 * k::INTEGER))::DATE AS frame_date FROM ok, range(0, 40) g(k)), tt AS (SELECT key, date_diff('day', DATE '1970-01-01', frame_date)::DOUBLE AS t, frame_date FROM gd WHERE date_diff('day', DATE '1970-01-01', frame_date) BETWEEN a AND z)"
OK = "ok AS (SELECT key, min(x) AS a, max(x) AS z FROM daily GROUP BY key HAVING count(*) >= 10 AND (max(x) - min(x)) / 365.25 >= 5)"


@query("T16_temporal_step", sql(f"{SLOPES}, {OK}, {STEP}, {AT} SELECT key, (DATE '1970-01-01' + t::INTEGER)::DATE AS frame_date, {r(CUBIC, 6)} AS value FROM av", "daily"))
def _(t):
    f = T.temporal_step(t.daily, "1994-01-01", "2003-10-01", 3, "pchip", 10, 5.0)
    return f.withColumn("value", S.js_round(F.col("value"), 6))


@query("T16_temporal_linear", sql(f"{SLOPES}, {OK}, {STEP} SELECT sm.key, frame_date, {r('y + d * (t - x)', 5)} AS value FROM sm JOIN tt ON tt.key = sm.key AND (t >= x AND (t < x1 OR i = n - 1 AND t = x1))", "daily"))
def _(t):
    f = T.temporal_step(t.daily, "1994-01-01", "2003-10-01", 3, "linear", 10, 5.0)
    return f.withColumn("value", S.js_round(F.col("value"), 5))


@query("T15_temporal_smooth")
def _(t):
    return T.temporal_step(t.daily, "1994-01-01", "2003-10-01", 3, "moving-average", 10, 5.0)


@query("T20_resample", f"WITH daily AS (SELECT event_type AS key, date_diff('day', DATE '1970-01-01', ts::DATE) AS x, avg(value) AS y FROM events GROUP BY 1, 2), {SLOPES}, tt AS (SELECT key, date_diff('day', DATE '1970-01-01', month)::DOUBLE AS t FROM (SELECT key, unnest(generate_series(date_trunc('month', DATE '1970-01-01' + min(x)::INTEGER), (DATE '1970-01-01' + max(x)::INTEGER)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM daily GROUP BY key)), {AT} SELECT key, (DATE '1970-01-01' + t::INTEGER)::DATE AS month, {r(CUBIC, 6)} AS y FROM av")
def _(t):
    e = t.read("events").groupBy(F.col("event_type").alias("key"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("x")).agg(F.avg("value").alias("y"))
    return T.resample_months(e).withColumn("y", S.js_round(F.col("y"), 6))


@query("J17_interval_join", sql(f"{SEG}, tt AS (SELECT key, x + 0.5::DOUBLE AS t FROM daily) SELECT sg.key, t, x, x1 FROM sg JOIN tt ON tt.key = sg.key AND (t >= x AND (t < x1 OR i = n - 1 AND t = x1))", "daily"))
def _(t):
    times = t.daily.select("key", (F.col("x") + 0.5).alias("t"))
    return T.at_times(T.segments(t.daily), times).select("key", "t", "x", "x1")


@query("W01_ordered_series", sql("SELECT well_id AS key, string_agg(d, '|' ORDER BY d) AS dates FROM (SELECT DISTINCT well_id, obs_date::VARCHAR AS d FROM meas) GROUP BY well_id", "meas"))
def _(t):
    days = F.array_sort(F.collect_set(F.col("obs_date").cast("string")))
    return t.measurements.where("obs_date is not null").groupBy(F.col("well_id").alias("key")).agg(F.array_join(days, "|").alias("dates"))


@query("W04_trailing_frame", sql(f"SELECT key, x, {r('avg(y) OVER (PARTITION BY key ORDER BY x ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)', 5)} AS mean FROM daily", "daily"))
def _(t):
    w = Window.partitionBy("key").orderBy("x").rowsBetween(-11, 0)
    return t.daily.select("key", "x", S.js_round(F.avg("y").over(w), 5).alias("mean"))
