"""Matching new rows against what a store has, and bringing both together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions import scalars as S
from hydrolith.operators.clean import first_by


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose key it lacks, the first of each [J03]."""
    return old.unionByName(first_by(new, keys, ["pos"]).join(old.select(*keys).distinct(), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value", keep: str = "aquifer_id") -> DataFrame:
    """New values win, the last of each key; ``keep`` stays as it was unless null; keys that only new has are added [J04]."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(F.col(value), F.col(keep)), "pos").alias("__n")).select(*keys, F.col(f"__n.{value}").alias("__v"), F.col(f"__n.{keep}").alias("__k"))
    both = old.select(*keys, value, keep).join(last, keys, "full_outer")
    return both.select(*keys, F.coalesce("__v", value).alias(value), F.coalesce(keep, "__k").alias(keep))


def newer_than_store(old: DataFrame, new: DataFrame, date: str = "obs_date") -> DataFrame:
    """Rows of new after the last date in old [J05]."""
    last = old.agg(F.max(date).alias("__last"))
    return new.crossJoin(F.broadcast(last)).where(F.col("__last").isNull() | (F.col(date) > F.col("__last"))).drop("__last")


def replace_scope(old: DataFrame, new: DataFrame, column: str, scope: object) -> DataFrame:
    """old without the rows of a scope, and the rows of new [J06, K07]."""
    return old.where(~F.col(column).eqNullSafe(F.lit(scope))).unionByName(new)


def cascade_delete(children: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """children without those of what is gone [K06]."""
    return children.join(gone.select(*keys).distinct(), keys, "left_anti")


def identity_key(df: DataFrame) -> DataFrame:
    """df with ``identity``: the id, else the position to five digits, else the name [J22]."""
    place = F.concat(F.lit("@"), F.format_string("%.5f", "lat"), F.lit(","), F.format_string("%.5f", "lng"))
    named = F.when(F.coalesce(F.col("source_id"), F.lit("")) != "", F.col("source_id")).when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), place)
    return df.withColumn("identity", F.coalesce(named, "name"))


def nearest_within(points: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """The nearest site within radius metres of each point: (id, lat, lng) to (site_id, site_lat, site_lng, site_pos) [J11].

    Both sides fall into cells: bands of latitude as high as the radius, cut into cells of longitude that are wider
    than it at the band and its neighbours, fewer towards the poles. A point looks into the cells around its own, and
    those at both ends of a band are neighbours, so the join is by equality everywhere on the globe.
    """
    step = max(radius / 111_000.0, 1e-6)

    def cells(band):
        far = (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * step
        return F.greatest(F.floor(360.0 * F.cos(F.radians(F.least(far, F.lit(90.0)))) / (1.02 * step)), F.lit(1)).cast("long")

    def cell(lng, n):
        return F.least(F.floor((lng + 180.0) / 360.0 * n), n - 1).cast("long")

    own = F.floor(F.col("lat") / step).cast("long")
    seen = points.where(S.valid_point(F.col("lat"), F.col("lng"))).withColumn("__band", F.explode(F.sequence(own - 1, own + 1)))
    seen = seen.withColumn("__n", cells(F.col("__band"))).withColumn("__at", cell(F.col("lng"), F.col("__n")))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(F.col("__at") + i, F.col("__n"))))
    seen = seen.withColumn("__cell", F.explode(around)).drop("__n", "__at")
    placed = sites.where(S.valid_point(F.col("site_lat"), F.col("site_lng"))).withColumn("__band", F.floor(F.col("site_lat") / step).cast("long"))
    placed = placed.withColumn("__cell", cell(F.col("site_lng"), cells(F.col("__band"))))
    d = S.haversine(F.col("lat"), F.col("lng"), F.col("site_lat"), F.col("site_lng"))
    near = seen.join(placed, ["__band", "__cell"]).withColumn("distance", d).where(F.col("distance") <= radius)
    return first_by(near, ["id"], ["distance", "site_pos"]).select("id", "site_id", "distance")


def match_wells(points: DataFrame, wells: DataFrame, radius: float = 100.0) -> DataFrame:
    """(id, kind, well_id, distance) of each point (id, name, lat, lng) against wells (well_id, well_name, lat, lng, pos) [J10, J12].

    Kinds in order: the same id; the same name when normalised, where the last of wells counts; the nearest within
    radius; new, if it has a place; unmatched.
    """
    by_id = wells.select(F.col("well_id").cast("string").alias("id"), F.col("well_id").alias("w_id")).dropDuplicates(["id"])
    names = wells.select(S.normalize_name(F.col("well_name")).alias("key"), "well_id", "pos").where("key <> ''")
    by_name = names.groupBy("key").agg(F.max_by("well_id", "pos").alias("w_name"))
    near = nearest_within(points, wells.select(F.col("well_id").alias("site_id"), F.col("lat").alias("site_lat"), F.col("lng").alias("site_lng"), F.col("pos").alias("site_pos")), radius)
    joined = points.withColumn("key", S.normalize_name(F.col("name"))).join(by_id, "id", "left").join(by_name, "key", "left").join(near, "id", "left")
    kind = F.when(F.col("w_id").isNotNull(), "id").when(F.col("w_name").isNotNull(), "name").when(F.col("site_id").isNotNull(), "proximity")
    kind = kind.when(S.valid_point(F.col("lat"), F.col("lng")), "new").otherwise("unmatched")
    return joined.select("id", kind.alias("kind"), F.coalesce("w_id", "w_name", "site_id").alias("well_id"), F.when(kind == "proximity", F.col("distance")).alias("distance"))


def fuzzy_parameters(headers: DataFrame, parameters: DataFrame) -> DataFrame:
    """(header, code, tier) of headers against parameters (code, name, pos): equal or its formula, within two edits, or contained [J14].

    Both tables have a row a column or parameter; edits count for names of four letters and more, containment from three on.
    """
    h = headers.withColumn("key", S.normalize_name(S.header_name(F.col("header"))))
    p = parameters.withColumn("name_key", S.normalize_name(F.col("name")))
    edits = F.levenshtein("key", "name_key")
    formula = F.coalesce(S.chemical_code(F.col("header")) == F.col("code").cast("string"), F.lit(False))
    tier = F.when((F.col("key") == F.col("name_key")) | formula, 1)
    tier = tier.when((F.length("key") >= 4) & (F.length("name_key") >= 4) & (edits <= 2), 2)
    tier = tier.when((F.length("key") >= 3) & (F.length("name_key") >= 3) & (F.contains("key", "name_key") | F.contains("name_key", "key")), 3)
    ranked = h.crossJoin(p).withColumn("tier", tier).withColumn("edits", F.when(F.col("tier") == 2, edits).otherwise(0)).where("tier is not null")
    return first_by(ranked, ["header"], ["tier", "edits", "pos"]).select("header", "code", "tier")


def pairwise_correlation(series: DataFrame, least: int = 8) -> DataFrame:
    """(grp, a, b, r, n) of each two keys of one group with enough times in common, by blocks of keys: (grp, key, t, value) [J21, V01]."""
    from hydrolith.operators.pairs import correlations

    return correlations(series, least)


def snap_to_month(points: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Values of grid (key, obs_date, value) at each date, else at the first of its month [J15]."""
    g = grid.select(key, F.col("obs_date").alias("g_date"), F.col("value").alias("g_value"))
    exact = points.join(g, (points[key] == g[key]) & (points["obs_date"] == g["g_date"]), "left").select(points["*"], F.col("g_value").alias("exact"))
    month = exact.join(g, (exact[key] == g[key]) & (F.trunc(exact["obs_date"], "month") == g["g_date"]), "left")
    return month.select(*[exact[c] for c in points.columns], F.coalesce("exact", "g_value").alias("snapped"))


def wide_times(series: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """A row a key and time and a column a series: (keys, t, series, value), the last value of each [J19, A18, R05]."""
    return series.groupBy(*keys, "t").pivot("series", names).agg(F.max_by("value", "pos"))


def ordered_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all frames, the first of a key in order of frames and pos [W09]."""
    out = None
    for k, frame in enumerate(frames):
        part = frame.withColumn("__k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("__k", "pos")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__k", "__n")


def counterparts(models: DataFrame, scope: list[str]) -> DataFrame:
    """(path, counterpart) of each model (path, method, min_samples, pos, scope): one of another method and the same scope [J20].

    The first by pos with the same min_samples, else the first by pos; null if there is none. Of each scope and
    method only the first model, and the first for each min_samples, can be anyone's counterpart, so no more than
    those meet the models.
    """
    same = first_by(models, [*scope, "method", "min_samples"], ["pos"])
    other = same.select(*scope, F.col("method").alias("__method"), F.col("min_samples").alias("__least"), F.col("pos").alias("__pos"), F.col("path").alias("counterpart"))
    both = models.join(other, scope).where("method <> __method")
    order = F.struct((~F.col("min_samples").eqNullSafe(F.col("__least"))).alias("no"), F.col("__pos").alias("pos"))
    best = both.groupBy("path").agg(F.min_by("counterpart", order).alias("counterpart"))
    return models.select("path").join(best, "path", "left")


def resolve_wells(points: DataFrame, matches: DataFrame, wells: DataFrame) -> DataFrame:
    """(id, well_id, is_new) of points (id, name, lat, lng, pos) by their matches (id, kind, well_id); unmatched ones go [J23].

    New points get ids of name and place; of those with one id, and where a well has it already, the later get
    -2, -3 and so on in order of pos.
    """
    joined = points.join(matches.select("id", "kind", F.col("well_id").cast("string").alias("well_id")), "id")
    old = joined.where("kind in ('id', 'name', 'proximity')").select("id", "well_id", F.lit(False).alias("is_new"))
    base = S.aqx_id(F.coalesce("name", F.lit("")), F.col("lat"), F.col("lng"))
    new = joined.where("kind = 'new'").select("id", "pos", base.alias("base"))
    taken = wells.select(F.col("well_id").cast("string").alias("base")).distinct().withColumn("held", F.lit(1))
    w = Window.partitionBy("base").orderBy("pos")
    ranked = new.join(taken, "base", "left").withColumn("k", F.row_number().over(w) + F.coalesce("held", F.lit(0)))
    made = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("k").cast("string")))
    return old.unionByName(ranked.select("id", made.alias("well_id"), F.lit(True).alias("is_new")))
