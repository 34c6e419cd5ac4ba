"""Queries of filters, checks, joins and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.operators import clean, merge
from hydrolith.plans.registry import query, r, sql
from hydrolith.plans.text import HAV, NORM, TEXTS, VALID, date_texts

DAY = ["well_id", "obs_date"]


@query("F01_key_filter", sql("SELECT well_id, count(*) AS n FROM meas WHERE data_type = 'R' AND well_id IN (SELECT well_id FROM well WHERE region_id = 2) GROUP BY well_id", "meas", "well"))
def _(t):
    keys = t.wells.where("region_id = 2").select("well_id")
    return t.measurements.where("data_type = 'R'").join(keys, "well_id", "left_semi").groupBy("well_id").agg(F.count("*").alias("n"))


@query("F02_date_range", sql("SELECT pos, obs_date FROM meas WHERE obs_date >= DATE '1997-01-01' AND obs_date <= DATE '1997-03-31'", "meas"))
def _(t):
    return clean.in_dates(t.measurements, "obs_date", "1997-01-01", "1997-03-31").select("pos", "obs_date")


@query("F03_clamp_range", sql("s AS (SELECT well_id, data_type, min(obs_date) AS a, max(obs_date) AS z FROM meas GROUP BY ALL) SELECT well_id, data_type, CASE WHEN a <= DATE '1998-06-01' AND z >= DATE '1996-01-01' THEN greatest(a, DATE '1996-01-01') END AS lo, CASE WHEN a <= DATE '1998-06-01' AND z >= DATE '1996-01-01' THEN least(z, DATE '1998-06-01') END AS hi FROM s", "meas"))
def _(t):
    s = clean.spans(t.measurements, ["well_id", "data_type"])
    lo, hi = clean.clamp_range(F.col("first_date"), F.col("last_date"), F.lit("1996-01-01").cast("date"), F.lit("1998-06-01").cast("date"))
    return s.select("well_id", "data_type", lo.alias("lo"), hi.alias("hi"))


@query("F04_span_overlap", sql("SELECT well_id, data_type, min(obs_date) AS first_date, max(obs_date) AS last_date, count(*) AS n FROM meas GROUP BY ALL HAVING min(obs_date) <= DATE '1998-12-31' AND max(obs_date) >= DATE '1997-01-01'", "meas"))
def _(t):
    return clean.overlapping_spans(t.measurements, ["well_id", "data_type"], 1997, 1998)


@query("F05_count_classes", sql("c AS (SELECT well_id, count(*) AS n FROM meas WHERE value > 54000 GROUP BY 1) SELECT well_id, coalesce(n, 0) AS n, least(coalesce(n, 0), 2)::INTEGER AS count_class FROM well LEFT JOIN c USING (well_id) WHERE coalesce(n, 0) >= 1", "meas", "well"))
def _(t):
    return clean.count_classes(t.wells, t.measurements.where("value > 54000"), "well_id", 1).select("well_id", "n", "count_class")


@query("F06_search", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '1') OR contains(s_suppkey::VARCHAR, '1') ORDER BY s_suppkey LIMIT 8")
def _(t):
    return clean.search(t.read("supplier").select("s_suppkey", "s_name"), "1", ["s_name", "s_suppkey"], "s_suppkey")


@query("F07_catalog_groups", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part WHERE contains(lower(p_type), 'e') GROUP BY p_brand")
def _(t):
    p = t.read("part").where(F.lower("p_type").contains("e"))
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@query("F08_box", sql("SELECT well_id, lat, lng FROM well WHERE lat BETWEEN 38 AND 41 AND lng BETWEEN -112.5 AND -111", "well"))
def _(t):
    return t.wells.where("lat between 38 and 41 and lng between -112.5 and -111").select("well_id", "lat", "lng")


@query("F11_validate", sql(f"""{TEXTS}, i AS (SELECT o_orderkey AS pos, o_custkey % 50 AS site, {VALID} AS iso, o_totalprice - 1000 AS value FROM orders JOIN d USING (o_orderkey)),
g AS (SELECT *, iso IS NOT NULL AND value BETWEEN -10000 AND 100000 AS sane FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY site, iso, sane ORDER BY pos) AS k FROM g)
SELECT pos, CASE WHEN iso IS NULL THEN 'bad date' WHEN NOT sane THEN 'out of range' WHEN k > 1 THEN 'duplicate' END AS reason FROM k"""))
def _(t):
    o = t.read("orders").join(date_texts(t).withColumnRenamed("s", "date"), "o_orderkey")
    rows = o.select((F.col("o_custkey") % 50).alias("site"), "date", (F.col("o_totalprice") - 1000).alias("value"), F.col("o_orderkey").alias("pos"))
    return clean.validate_measurements(rows).select("pos", "reason")


@query("F12_dedup_catalog", "SELECT site, date, code, value FROM (SELECT l_suppkey AS site, l_shipdate::DATE AS date, c.code, l_extendedprice AS value, row_number() OVER (PARTITION BY l_suppkey, l_shipdate::DATE, c.code ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem JOIN (VALUES ('a', 'aa', 'O'), ('n', 'nn', NULL)) c(name, code, fraction) ON lower(l_returnflag) = c.name AND (c.fraction IS NULL OR l_linestatus = c.fraction)) WHERE k = 1")
def _(t):
    catalog = t.spark.createDataFrame([("a", "aa", "O"), ("n", "nn", None)], "characteristic_name string, code string, sample_fraction string")
    line = t.read("lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("characteristic"), F.col("l_linestatus").alias("fraction"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return clean.dedup_by_catalog(line, catalog)


@query("F13_average_duplicates", sql(f"SELECT well_id, obs_date, {r('avg(value::DECIMAL(20,6))::DOUBLE', 3)} AS value, min(pos) AS pos FROM meas GROUP BY ALL", "meas"))
def _(t):
    return clean.merge_duplicates(t.measurements, DAY, "average")


@query("F13_maximum_duplicates", sql("SELECT well_id, obs_date, max(value) AS value, min(pos) AS pos FROM meas GROUP BY ALL", "meas"))
def _(t):
    return clean.merge_duplicates(t.measurements, DAY, "maximum")


@query("F14_duplicate_report", sql("SELECT count(*) AS n_groups, sum(c - 1)::BIGINT AS n_extra FROM (SELECT count(*) AS c FROM meas GROUP BY well_id, obs_date HAVING count(*) > 1)", "meas"))
def _(t):
    return clean.duplicate_report(t.measurements, DAY)


@query("F16_iqr_outliers", sql("k AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY value, pos) - 1 AS k, count(*) OVER (PARTITION BY well_id) AS n FROM meas), q AS (SELECT well_id, max(CASE WHEN k = floor(n * 0.25) THEN value END) AS q1, max(CASE WHEN k = floor(n * 0.75) THEN value END) AS q3 FROM k GROUP BY well_id HAVING count(*) >= 4) SELECT pos, value, q1, q3 FROM meas JOIN q USING (well_id) WHERE value < q1 - 0.3 * (q3 - q1) OR value > q3 + 0.3 * (q3 - q1)", "meas"))
def _(t):
    return clean.iqr_outliers(t.measurements, "well_id", 0.3).select("pos", "value", "q1", "q3")


@query("F17_z_outliers", sql(f"z AS (SELECT pos, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z, count(*) OVER w AS n FROM meas WINDOW w AS (PARTITION BY well_id)) SELECT pos, {r('z', 6)} AS z FROM z WHERE n >= 5 AND abs(z) > 1.6", "meas"))
def _(t):
    return clean.z_outliers(t.measurements, "well_id", 1.6).select("pos", S.js_round(F.col("z"), 6).alias("z"))


@query("F18_log_check", "SELECT s_nationkey, bool_or(s_acctbal <= 0) AS has_nonpositive, ceil(max(s_acctbal))::BIGINT AS ceil_max FROM supplier GROUP BY s_nationkey")
def _(t):
    return clean.log_check(t.read("supplier").select("s_nationkey", F.col("s_acctbal").alias("value")), ["s_nationkey"])


@query("F21_unmatched", sql("SELECT m.well_id, count(*) AS n FROM meas m WHERE NOT EXISTS (SELECT 1 FROM well w WHERE w.well_id = m.well_id AND gse > 0) GROUP BY m.well_id", "meas", "well"))
def _(t):
    return clean.unmatched(t.measurements, t.wells.where("gse > 0"), "well_id")


@query("J01_lookup", sql("SELECT m.pos, w.well_name, w.aquifer_id, value FROM meas m JOIN well w USING (well_id) WHERE data_type = 'A'", "meas", "well"))
def _(t):
    return t.measurements.where("data_type = 'A'").join(t.wells.drop("pos"), "well_id").select("pos", "well_name", "aquifer_id", "value")


@query("J02_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    big = t.read("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.read("customer").join(big, "c_custkey", "left_semi").select("c_custkey")


OLD, NEW = "old AS (SELECT * FROM meas WHERE data_type <> 'R')", "new AS (SELECT * FROM meas WHERE data_type = 'R')"


@query("J03_append_new", sql(f"{OLD}, {NEW} SELECT pos FROM old UNION ALL SELECT pos FROM (SELECT *, row_number() OVER (PARTITION BY well_id, obs_date ORDER BY pos) AS k FROM new) n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.well_id = n.well_id AND o.obs_date = n.obs_date)", "meas"))
def _(t):
    m = t.measurements
    return merge.append_new(m.where("data_type <> 'R'"), m.where("data_type = 'R'"), DAY).select("pos")


@query("J04_upsert", sql("o AS (SELECT well_id, obs_date, max(value) AS value, CASE WHEN well_id % 4 = 0 THEN NULL ELSE 'old' END AS aquifer_id FROM meas WHERE data_type <> 'R' GROUP BY ALL), n AS (SELECT well_id, obs_date, arg_max(value, pos) AS value, 'new' AS aquifer_id FROM meas WHERE data_type = 'R' GROUP BY ALL) SELECT well_id, obs_date, coalesce(n.value, o.value) AS value, coalesce(o.aquifer_id, n.aquifer_id) AS aquifer_id FROM o FULL JOIN n USING (well_id, obs_date)", "meas"))
def _(t):
    m = t.measurements
    old = m.where("data_type <> 'R'").groupBy(*DAY).agg(F.max("value").alias("value")).withColumn("aquifer_id", F.when(F.col("well_id") % 4 != 0, "old"))
    new = m.where("data_type = 'R'").withColumn("aquifer_id", F.lit("new"))
    return merge.upsert(old, new, DAY)


@query("J05_quick_refresh", sql("SELECT pos FROM meas WHERE data_type = 'R' AND obs_date > (SELECT max(obs_date) FROM meas WHERE obs_date < DATE '2000-01-01')", "meas"))
def _(t):
    m = t.measurements
    return merge.newer_than_store(m.where("obs_date < date'2000-01-01'"), m.where("data_type = 'R'")).select("pos")


@query("J06_replace_scope", sql("SELECT data_type, count(*) AS n, min(value) AS low FROM (SELECT data_type, value FROM meas WHERE data_type <> 'A' UNION ALL SELECT 'A', value FROM meas WHERE data_type = 'R') GROUP BY data_type", "meas"))
def _(t):
    m = t.measurements
    new = m.where("data_type = 'R'").withColumn("data_type", F.lit("A"))
    return merge.replace_scope(m, new, "data_type", "A").groupBy("data_type").agg(F.count("*").alias("n"), F.min("value").alias("low"))


@query("K06_cascade_delete", sql("SELECT well_id, count(*) AS n FROM meas WHERE well_id NOT IN (SELECT well_id FROM well WHERE region_id = 1) GROUP BY well_id", "meas", "well"))
def _(t):
    return merge.cascade_delete(t.measurements, t.wells.where("region_id = 1"), ["well_id"]).groupBy("well_id").agg(F.count("*").alias("n"))


@query("K07_row_edit", sql("SELECT pos, CASE WHEN well_id = 7 AND data_type = 'N' THEN value * 2 ELSE value END AS value FROM meas WHERE NOT (well_id = 9 AND data_type = 'A')", "meas"))
def _(t):
    edited = F.when((F.col("well_id") == 7) & (F.col("data_type") == "N"), F.col("value") * 2).otherwise(F.col("value"))
    return t.measurements.where("not (well_id = 9 and data_type = 'A')").select("pos", edited.alias("value"))


@query("K08_rename", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'Renamed ' || n_name ELSE n_name END AS name FROM nation")
def _(t):
    name = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("Renamed "), "n_name")).otherwise(F.col("n_name"))
    return t.read("nation").select("n_nationkey", name.alias("name"))


POINTS = """pt AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN 'no ' || c_name WHEN c_custkey % 7 = 1 THEN (SELECT s_name FROM supplier WHERE s_suppkey = c_custkey % 90 + 1) ELSE '' END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 37 + c_nationkey * 0.5::DOUBLE + (c_custkey % 10) * 0.03::DOUBLE + c_acctbal / 1e7 END AS lat, -113 + (c_nationkey % 5) * 0.6::DOUBLE + (c_custkey % 7) * 0.04::DOUBLE AS lng FROM customer)"""


def points(t):
    c = t.read("customer")
    names = t.read("supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    k = F.col("c_custkey")
    both = c.join(names, k % 90 + 1 == F.col("k"), "left")
    name = F.when(k % 3 == 0, F.concat(F.lit("no "), "c_name")).when(k % 7 == 1, F.col("s_name")).otherwise("")
    lat = F.when(k % 11 != 0, 37 + F.col("c_nationkey") * 0.5 + (k % 10) * 0.03 + F.col("c_acctbal") / 1e7)
    return both.select(k.cast("string").alias("id"), name.alias("name"), lat.alias("lat"), (-113 + (F.col("c_nationkey") % 5) * 0.6 + (k % 7) * 0.04).alias("lng"))


NEAR = f"""nr AS (SELECT id, well_id, d FROM (SELECT p.id, w.well_id, {HAV.format('p.lat', 'p.lng', 'w.lat', 'w.lng')} AS d, row_number() OVER (PARTITION BY p.id ORDER BY {HAV.format('p.lat', 'p.lng', 'w.lat', 'w.lng')}, w.pos) AS k FROM pt p JOIN well w ON abs(p.lat - w.lat) < 0.2) WHERE k = 1 AND d <= {{0}})"""


@query("J11_nearest", sql(f"{POINTS}, {NEAR.format(5000.0)} SELECT id, well_id AS site_id, {r('d', 3)} AS distance FROM nr", "well"))
def _(t):
    sites = t.wells.select(F.col("well_id").alias("site_id"), F.col("lat").alias("site_lat"), F.col("lng").alias("site_lng"), F.col("pos").alias("site_pos"))
    return merge.nearest_within(points(t), sites, 5000.0).withColumn("distance", S.js_round(F.col("distance"), 3))


MATCH = f"""{POINTS}, {NEAR.format(1000.0)}, nm AS (SELECT {NORM.format('well_name')} AS k, arg_max(well_id, pos) AS well_id FROM well GROUP BY 1),
mt AS (SELECT p.id, CASE WHEN w.well_id IS NOT NULL THEN 'id' WHEN nm.well_id IS NOT NULL THEN 'name' WHEN nr.well_id IS NOT NULL THEN 'proximity' WHEN p.lat BETWEEN -90 AND 90 AND p.lng BETWEEN -180 AND 180 THEN 'new' ELSE 'unmatched' END AS kind,
  coalesce(w.well_id, nm.well_id, nr.well_id) AS well_id FROM pt p LEFT JOIN well w ON p.id = w.well_id::VARCHAR AND w.well_id < 50 LEFT JOIN nm ON {NORM.format('p.name')} = nm.k LEFT JOIN nr ON p.id = nr.id)"""


def matched(t):
    # ids above 49 are hidden from the match by id, as if the store had other ids for them
    p = points(t).withColumn("id", F.when(F.col("id").cast("long") < 50, F.col("id")).otherwise(F.concat(F.lit("x"), "id")))
    found = merge.match_wells(p, t.wells, 1000.0)
    return found.withColumn("id", F.regexp_replace("id", "^x", ""))


@query("J10_match_wells", sql(f"{MATCH} SELECT id, kind, well_id FROM mt", "well"))
def _(t):
    return matched(t).select("id", "kind", "well_id")


@query("J12_match_summary", sql(f"{MATCH} SELECT count(*) FILTER (WHERE kind = 'id') AS n_id, count(*) FILTER (WHERE kind = 'name') AS n_name, count(*) FILTER (WHERE kind = 'proximity') AS n_proximity, count(*) FILTER (WHERE kind = 'new') AS n_new, count(*) FILTER (WHERE kind = 'unmatched') AS n_unmatched FROM mt", "well"))
def _(t):
    return matched(t).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("id", "name", "proximity", "new", "unmatched")])


@query("J14_fuzzy_columns", sql(f"""h AS (SELECT DISTINCT p_type AS header, {NORM.format('p_type')} AS k FROM part), p AS (SELECT p_partkey AS code, p_partkey AS pos, {NORM.format('p_name')} AS k FROM part),
c AS (SELECT header, code, pos, CASE WHEN h.k = p.k THEN 1 WHEN length(h.k) >= 4 AND length(p.k) >= 4 AND levenshtein(h.k, p.k) <= 2 THEN 2 WHEN length(h.k) >= 3 AND length(p.k) >= 3 AND (contains(h.k, p.k) OR contains(p.k, h.k)) THEN 3 END AS tier, levenshtein(h.k, p.k) AS e FROM h, p)
SELECT header, code, tier::INTEGER AS tier FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY tier, CASE WHEN tier = 2 THEN e ELSE 0 END, pos) AS n FROM c WHERE tier IS NOT NULL) WHERE n = 1"""))
def _(t):
    p = t.read("part")
    return merge.fuzzy_parameters(p.select(F.col("p_type").alias("header")).distinct(), p.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")))


@query("J15_snap_month", sql("g AS (SELECT well_id, obs_date, max(value) AS v FROM meas WHERE data_type = 'N' GROUP BY ALL) SELECT m.pos, coalesce(a.v, b.v) AS snapped FROM meas m LEFT JOIN g a ON a.well_id = m.well_id AND a.obs_date = m.obs_date LEFT JOIN g b ON b.well_id = m.well_id AND b.obs_date = date_trunc('month', m.obs_date) WHERE m.data_type = 'A'", "meas"))
def _(t):
    g = t.measurements.where("data_type = 'N'").groupBy(*DAY).agg(F.max("value").alias("value"))
    p = t.measurements.where("data_type = 'A'").select("pos", *DAY)
    return merge.snap_to_month(p, g, "well_id").select("pos", "snapped")


@query("J16_nearest_month", sql("SELECT pos, (date_trunc('month', obs_date) + CASE WHEN date_diff('day', date_trunc('month', obs_date), obs_date) > date_diff('day', obs_date, date_trunc('month', obs_date) + INTERVAL 1 MONTH) THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END)::DATE AS month FROM meas", "meas"))
def _(t):
    first = F.trunc("obs_date", "month")
    after = F.add_months(first, 1)
    return t.measurements.select("pos", F.when(F.datediff("obs_date", first) > F.datediff(after, "obs_date"), after).otherwise(first).alias("month"))


@query("J18_active_wells", sql("f AS (SELECT make_date(y, 1, 1) AS frame_date FROM range(1994, 2003) g(y)), s AS (SELECT well_id, min(obs_date) AS a, max(obs_date) AS z, count(*) AS n FROM meas WHERE data_type = 'A' GROUP BY 1) SELECT frame_date, count(*) AS n_wells FROM f JOIN s ON frame_date BETWEEN a AND z WHERE n >= 5 GROUP BY frame_date", "meas"))
def _(t):
    s = clean.spans(t.measurements.where("data_type = 'A'"), ["well_id"]).where("n >= 5")
    first = F.year("first_date") + F.when(F.col("first_date") > F.trunc("first_date", "year"), 1).otherwise(0)
    years = s.withColumn("y0", first).where(F.col("y0") <= F.year("last_date")).select(F.explode(F.sequence("y0", F.year("last_date"))).alias("y"))
    return years.where("y between 1994 and 2002").groupBy(F.make_date("y", F.lit(1), F.lit(1)).alias("frame_date")).agg(F.count("*").alias("n_wells"))


@query("J19_wide_times", sql("SELECT well_id, obs_date AS t, arg_max(value, pos) FILTER (WHERE data_type = 'A') AS A, arg_max(value, pos) FILTER (WHERE data_type = 'R') AS R FROM meas WHERE data_type IN ('A', 'R') GROUP BY 1, 2", "meas"))
def _(t):
    s = t.measurements.where("data_type in ('A', 'R')").select("well_id", F.col("obs_date").alias("t"), F.col("data_type").alias("series"), "value", "pos")
    return merge.wide_times(s, ["A", "R"], ["well_id"])


@query("J21_pair_correlation", sql(f"SELECT a.grp, a.key AS a, b.key AS b, {r('coalesce(corr(a.value, b.value), 0)', 6)} AS r, count(*) AS n FROM monthly a JOIN monthly b ON a.grp = b.grp AND a.m = b.m AND a.key < b.key GROUP BY ALL HAVING count(*) >= 8", "monthly"))
def _(t):
    return merge.pairwise_correlation(t.monthly.withColumnRenamed("m", "t")).withColumn("r", S.js_round(F.col("r"), 6))


@query("J22_identity", sql("SELECT well_id, CASE WHEN well_id % 3 = 0 THEN 'id' || well_id WHEN well_id % 3 = 1 THEN '@' || printf('%.5f', lat) || ',' || printf('%.5f', lng) ELSE well_name END AS identity FROM well", "well"))
def _(t):
    k = F.col("well_id") % 3
    w = t.wells.select("well_id", F.when(k == 0, F.concat(F.lit("id"), F.col("well_id").cast("string"))).alias("source_id"), F.when(k == 1, F.col("lat")).alias("lat"), F.when(k == 1, F.col("lng")).alias("lng"), F.col("well_name").alias("name"))
    return merge.identity_key(w).select("well_id", "identity")


@query("W02_first_by_key", sql("SELECT well_id, obs_date, arg_min(value, pos) AS value FROM meas GROUP BY ALL", "meas"))
def _(t):
    return clean.first_by(t.measurements, DAY, ["pos"]).select(*DAY, "value")


@query("W08_sorted_groups", "SELECT p_type, lower(p_type) AS k, (row_number() OVER (ORDER BY lower(p_type)))::INTEGER AS turn FROM (SELECT DISTINCT p_type FROM part)")
def _(t):
    k = t.read("part").select("p_type").distinct().withColumn("k", F.lower("p_type"))
    return k.withColumn("turn", F.row_number().over(Window.orderBy("k")))


@query("W09_union", sql("SELECT well_id, obs_date, pos FROM (SELECT *, row_number() OVER (PARTITION BY well_id, obs_date ORDER BY (data_type <> 'A')::INT, pos) AS k FROM meas WHERE data_type IN ('A', 'N')) WHERE k = 1", "meas"))
def _(t):
    m = t.measurements
    return merge.ordered_union([m.where("data_type = 'A'"), m.where("data_type = 'N'")], DAY).select(*DAY, "pos")


@query("W10_intersect_except", sql("SELECT * FROM (SELECT DISTINCT well_id, obs_date, 'both' AS kind FROM meas WHERE data_type = 'A' AND (well_id, obs_date) IN (SELECT (well_id, obs_date) FROM meas WHERE data_type = 'R')) UNION ALL (SELECT well_id, obs_date, 'only A' FROM (SELECT well_id, obs_date FROM meas WHERE data_type = 'A' EXCEPT SELECT well_id, obs_date FROM meas WHERE data_type = 'R'))", "meas"))
def _(t):
    a, b = (t.measurements.where(F.col("data_type") == k).select(*DAY) for k in ("A", "R"))
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.exceptAll(b).distinct().join(b, DAY, "left_anti").withColumn("kind", F.lit("only A")))


SCOPE = "SELECT o_orderkey AS path, o_orderpriority AS method, (o_orderkey % 3)::BIGINT AS min_samples, o_orderkey AS pos, o_custkey, o_orderstatus FROM orders"


@query("J20_counterparts", f"""WITH m AS ({SCOPE}), c AS (SELECT a.path, b.path AS counterpart, row_number() OVER (PARTITION BY a.path ORDER BY (a.min_samples <> b.min_samples)::INT, b.pos) AS k FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.method <> b.method)
SELECT m.path, c.counterpart FROM m LEFT JOIN c ON m.path = c.path AND k = 1""")
def _(t):
    k = F.col("o_orderkey")
    models = t.read("orders").select(k.alias("path"), F.col("o_orderpriority").alias("method"), (k % 3).alias("min_samples"), k.alias("pos"), "o_custkey", "o_orderstatus")
    return merge.counterparts(models, ["o_custkey", "o_orderstatus"])


@query("J23_resolve_wells")
def _(t):
    p = points(t).withColumn("pos", F.col("id").cast("long"))
    return merge.resolve_wells(p, matched(t), t.wells)
