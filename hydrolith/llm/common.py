"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more than one in so many rows of a join is heavy, from so many rows on: there are fewer than PIECES such keys.
PIECES, LEAST = 1000, 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session, as in tests, may fall back on a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with files that outlive any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_listening: list[list[str]] = []


@contextmanager
def tables_kept() -> Iterator[list[str]]:
    """A list to which the paths of tables are added that ``stored`` writes meanwhile."""
    paths: list[str] = []
    _listening.append(paths)
    try:
        yield paths
    finally:
        _listening[:] = [x for x in _listening if x is not paths]


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the application's checkpoint folder: smaller than a checkpoint, and read by column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for paths in _listening:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job has written, wherever its file system is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect garbage: files of shuffles go when it finds that no plan refers to them, which can take long by itself."""
    spark.sparkContext._jvm.System.gc()


def salted_join(rows: DataFrame, single: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with a stored table that has one row a key, and in ``count`` the rows that the key has.

    Rows of a heavy key are spread over as many salts as it has PIECES-ths of the total, and its row in ``single`` is
    repeated for each; no salt keeps more than that part of the rows. Fewer than PIECES keys can be heavy, so
    the table of them that is broadcast is bounded.
    """
    total = single.agg(F.sum(count)).first()[0] or 0
    piece = max(total / PIECES, LEAST)
    heavy = single.where(F.col(count) > piece).select(*keys, F.ceil(F.col(count) / piece).cast("int").alias("__salts"))
    found = heavy.collect()
    if not found:
        return rows.join(single, keys)
    heavy = F.broadcast(rows.sparkSession.createDataFrame(found, heavy.schema))
    others = [F.col(c) for c in rows.columns if c not in keys]
    left = rows.join(heavy, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*others), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    right = single.join(heavy, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def words_of(text: Column) -> Column:
    """Words of a text as an array; of a null text, an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
