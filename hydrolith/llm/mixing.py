"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import WORD, stored

#: Documents that are ordered in one task, about, and the most parts: beyond, parts grow, for the driver deals out their ranges.
PART, PARTS = 2_000, 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A tenth, and the share of letters and spaces in the text: prose weighs more than symbols, without a model to fit."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L} \n]", ""))
    return F.coalesce(F.lit(0.1) + plain / F.when(F.length(text) > 0, F.length(text)), F.lit(0.1))


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 that the parts decide: the first 13 hexadecimal digits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, n, target) from sizes (source, source_size, n), one row a source.

    Sources in order of code points, null last, get the weights in turn. Targets share the total by weight, stop at
    ``most`` times a source's size, and what is over is shared again by weight. The end of that is a level: each
    target is the least of its cap and level x weight. With sources in order of cap / weight, the level comes
    from the sums of caps before and of weights from each source on. The table has a row a source, so its windows
    stay small however many documents there are.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    capped = weighed.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levels = capped.withColumn("level", level)
    # the first source whose cap lies above the level of those from it on gives the level of all
    chosen = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(every)["level"]
    target = F.when(chosen.isNull(), F.col("cap")).otherwise(F.least("cap", chosen * F.col("w")))
    return levels.select("source", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, weight: Column | None = None) -> DataFrame:
    """How many words a mix of the sources takes of each document: doc_id, source, size, source_size, target, epochs, taken.

    docs has doc_id, text and source; size is its number of words. ``weight`` is a document's quality weight, by
    default quality_weight(text). A source gives as many complete epochs as its target holds; the rest of the
    target goes to documents in order of -ln(u) / weight (Efraimidis and Spirakis), where u is a hash of seed,
    doc_id and text: a document is taken whole if at least half of it lies within the rest. So a source misses its
    target by half a document at most, no document is taken more than ``most`` times, and reruns agree.

    Sizes and keys are computed once and kept. Documents are cut into parts of about PART by ranges of source and
    key, wherever the keys lie, so sums before a part come from totals of parts, and only documents of one part are
    ordered in one task, whatever the size of a source.

    Null and empty texts have size 0 and nothing taken of them. Null sources are one source, the last. Rows without
    or with repeated doc_ids are documents of their own; equal rows have equal keys and are ordered arbitrarily,
    which changes no number but by row. Other columns of docs are not looked at. An empty table gives an empty
    result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    u = uniform(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(text).alias("size"),
            (-F.log(u) / F.greatest(weight if weight is not None else quality_weight(text), F.lit(1e-6))).alias("key"),
        )
    )
    n = max(1, min(PARTS, -(-rows.count() // PART)))
    rows = stored(rows.repartitionByRange(n, F.col("source").isNull(), "source", "key", "doc_id", "size").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = source_targets(sizes, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "__source")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("__source"), F.col("part").alias("__part"), F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    both = placed.join(parts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("part") == F.col("__part"))).drop("__source", "__part")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    fraction = F.when(start + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(0)
    taken = (F.col("epochs") * F.col("size") + fraction).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", "epochs", taken.alias("taken"))
