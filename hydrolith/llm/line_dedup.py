"""Repeated runs of lines, found by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import salted_join, stored, words_of

PLACE = ("o", "th", "p")


def _order() -> Column:
    """Order of a document: its doc_id; without one it comes last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


def _hashed(docs: DataFrame) -> DataFrame:
    """o: order of a document; th: hash of its text; at, h: number and hash of each line that isn't blank."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.trim(s["x"]) != "")
    rows = docs.select(_order().alias("o"), F.xxhash64(text).alias("th"), lines.alias("lines"))
    return rows.select("o", "th", F.col("lines.i").alias("at"), F.transform("lines", lambda s: F.xxhash64(s["x"])).alias("h"))


def fingerprints(docs: DataFrame, run: int, gram: int) -> DataFrame:
    """The winnowed fingerprint of each window of ``run`` lines: fp at place (o, th, p), for the window that begins at j.

    Lines are counted from 0, blank ones aside. fp is the least hash of the ``gram``-line sequences of the window,
    the last of equal ones, so equal windows choose equal places. before and after hold the hashes of the lines
    around the place, nearest first, as far as a window of it can reach; at has the line numbers of the window.
    """
    reach = run - gram
    hashed = _hashed(docs).where(F.size("h") >= run)
    grams = hashed.withColumn("g", F.col("h") if gram == 1 else F.transform(F.sequence(F.lit(1), F.size("h") - gram + 1), lambda j: F.xxhash64(F.slice("h", j, gram))))
    numbered = grams.withColumn("n", F.transform("g", lambda x, i: F.struct(x.alias("fp"), (-i).alias("last"))))
    starts = F.sequence(F.lit(1), F.size("h") - run + 1)
    window = F.transform(starts, lambda j: F.struct(F.array_min(F.slice("n", j, reach + 1)).alias("least"), (j - 1).alias("j")))
    rows = numbered.select("o", "th", "h", "at", F.explode(window).alias("w"))
    rows = rows.select("o", "th", "h", "at", F.col("w.least.fp").alias("fp"), (-F.col("w.least.last")).alias("p"), F.col("w.j").alias("j"))
    near = F.least("p", F.lit(reach))
    before = F.reverse(F.slice("h", F.col("p") - near + 1, near))
    after = F.slice("h", F.col("p") + gram + 1, F.lit(reach))
    return rows.select(*PLACE, "fp", "j", before.alias("before"), after.alias("after"), F.slice("at", F.col("j") + 1, F.lit(run)).alias("at"))


def _extent(a: str, b: str, most: int) -> Column:
    """How many elements two arrays have in common from their first on, ``most`` at most."""
    if not most:
        return F.lit(0)
    unlike = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: ~F.coalesce(F.get(a, i - 1) == F.get(b, i - 1), F.lit(False)))
    return F.coalesce(F.get(unlike, 0) - 1, F.lit(most))


def repeated_lines(docs: DataFrame, run: int = 2, gram: int = 1, long: int | None = None) -> DataFrame:
    """(o, th, deleted): of each document with later repeats, the numbers of the lines to delete.

    Fingerprints at two places or more are joined with their first place (by doc_id, then line), and each match is
    extended to both sides along the hashes of the lines around the two. Windows that the extended match covers
    repeat those at the first place. The others, whose neighbours differ there, can only repeat each other: they
    are joined once more, with the first window of their own kind. Places never meet each other, so rows stay in
    proportion to lines, and both joins spread heavy keys over salts. With ``long``, a line of so many words is a
    run by itself.

    Hashes stand for lines: 64 bits each, and a window has ``run`` of them.
    """
    if not 1 <= gram <= run:
        raise ValueError("a run holds one gram at least")
    reach = run - gram
    windows = stored(fingerprints(docs, run, gram))
    place = F.struct(*PLACE)
    firsts = windows.groupBy("fp").agg(F.min(F.struct(*PLACE, "before", "after")).alias("f"), F.max(place).alias("z"), F.count("*").alias("n"))
    one = F.struct(*(F.col(f"f.{c}").alias(c) for c in PLACE))
    firsts = stored(firsts.where(one != F.col("z")).select("fp", one.alias("first"), F.col("f.before").alias("b"), F.col("f.after").alias("a"), "n"))
    met = salted_join(windows, firsts, ["fp"], "n").where(place != F.col("first"))
    back = F.col("p") - F.col("j")
    covered = (_extent("before", "b", reach) >= back) & (_extent("after", "a", reach) >= reach - back)
    key = F.xxhash64(back, F.slice("before", F.lit(1), back), F.slice("after", F.lit(1), F.lit(reach) - back))
    met = stored(met.select("o", "th", "j", "at", "fp", key.alias("key"), covered.alias("covered")))
    others = met.where("not covered").drop("covered")
    start = F.struct("o", "th", "j")
    kinds = others.groupBy("fp", "key").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("n"))
    kinds = stored(kinds.where("first <> last").drop("last"))
    again = salted_join(others, kinds, ["fp", "key"], "n").where(start != F.col("first"))
    later = met.where("covered").select("o", "th", F.explode("at").alias("line")).union(again.select("o", "th", F.explode("at").alias("line")))
    if long is not None:
        later = later.union(_long_lines(docs, long))
    return later.groupBy("o", "th").agg(F.collect_set("line").alias("deleted"))


def _long_lines(docs: DataFrame, long: int) -> DataFrame:
    """(o, th, line): later repeats of lines of ``long`` words or more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(_order().alias("o"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("line", "x"))
    rows = stored(rows.where(F.size(words_of(F.col("x"))) >= long).select("o", "th", "line", F.xxhash64("x").alias("h")))
    start = F.struct("o", "th", "line")
    firsts = rows.groupBy("h").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("n"))
    firsts = stored(firsts.where("first <> last").drop("last"))
    return salted_join(rows, firsts, ["h"], "n").where(start != F.col("first")).select("o", "th", "line")


def deduplicate_lines(docs: DataFrame, run: int = 2, gram: int = 1, long: int | None = None) -> DataFrame:
    """docs with later repeats of runs of ``run`` lines or more deleted, and two more columns: n_lines and n_deleted.

    With ``long``, later repeats of a single line of so many words or more go as well, whatever its neighbours.

    Lines end at a line feed. Blank lines (of spaces only) are never deleted nor counted, and don't interrupt a run.
    Of equal places the first by doc_id, then by line, keeps its lines; documents of one doc_id and different texts
    are ordered by a hash of the text. Rows equal in doc_id and text are one document: they keep or lose the same
    lines. A null text stays null, with counts 0. Documents without a doc_id come last. A text all of whose lines go
    becomes empty. Columns of docs stay as they are, apart from text; their own n_lines and n_deleted are replaced.
    An empty table gives an empty result.
    """
    found = repeated_lines(docs, run, gram, long).select(F.col("o").alias("__o"), F.col("th").alias("__th"), F.col("deleted").alias("__deleted"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"__o": _order(), "__th": F.xxhash64(text)})
    joined = keyed.join(found, ["__o", "__th"], "left")
    lines = F.split("text", "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__deleted"))
    rest = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    counted = {
        "n_lines": F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)).cast("long"),
        "n_deleted": F.coalesce(F.size("__deleted"), F.lit(0)).cast("long"),
    }
    counted = {k: F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(v) for k, v in counted.items()}
    return joined.withColumns(counted).withColumn("text", F.when(F.col("__deleted").isNull(), F.col("text")).otherwise(rest)).drop("__o", "__th", "__deleted")
