"""Quality of texts: random Fourier features of document statistics, ridge scores and isotonic calibration."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import checkpoint, stored

LOWER, UPPER, DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
WHITE, STOPS = b" \t\n\r\x0b\x0c", b".,;:?'\"()-"
WIDE = bytes(range(128, 256))
BINS = 1000
N_FEATURES = 18


def statistics(text: str | None) -> list[float]:
    """Statistics of a text, all finite; those of a null text are those of an empty one."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, m = max(len(raw), 1), max(len(words), 1)
    lower, upper, digits, white, stops, wide = (len(raw) - len(raw.translate(None, c)) for c in (LOWER, UPPER, DIGITS, WHITE, STOPS, WIDE))
    other = len(raw) - lower - upper - digits - white - stops - wide
    counts = Counter(words)
    lines = raw.split(b"\n")
    return [
        np.log1p(len(words)),
        lower / n,
        upper / n,
        digits / n,
        white / n,
        stops / n,
        wide / n,
        other / n,
        min((len(raw) - white) / m, 50.0),
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(map(operator.eq, words, words[1:])) / m,
        len(set(zip(words, words[1:]))) / m,
        raw.count(b".") / m,
        raw.count(b"!") / m,
        np.log1p(len(words) / len(lines)),
        len(set(lines)) / len(lines),
        sum(w.isupper() for w in counts) / max(len(counts), 1),
    ]


class Model:
    """What was learned: scaling, ridge weights and the knots of the calibration."""

    def __init__(self, size: int, ridge: float, seed: int) -> None:
        self.size, self.ridge, self.seed = size, ridge, seed
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.weights = np.zeros(size + 1)
        self.knots = (np.array([0.5]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel whose width is the root of the number of statistics, and a constant."""
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, self.size))
        b = rng.uniform(0, 2 * np.pi, self.size)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / self.size) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, with a thousandth of the raw order so that equal blocks keep it."""
        raw = self.raw(x)
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip((raw + 1) / 3, 0, 1)

    def column(self, x: Column) -> Column:
        """The score of statistics."""
        model = self

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.stack(rows.to_list()))) if len(rows) else pd.Series([], dtype=float)

        return score(x)


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return found(text)


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: the centres and the rising means of the blocks of bins."""
    blocks: list[list[float]] = []
    for a, c, p in zip(x, n, positive, strict=True):
        blocks.append([a * c, c, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(stats: DataFrame, labels: DataFrame, size: int = 256, ridge: float = 1e-2, seed: int = 11) -> Model:
    """Learns labels.quality (1: good) from the statistics (doc_id, x) of labelled documents, but of no fold 1.

    Fold 1 has the documents with crc32(doc_id as text) mod 3 = 1. Labels other than 0 and 1 and null ones are not
    looked at; of a document with more labels each counts. Partitions sum their parts of the normal equations,
    which are added row by row; the driver gets size + 1 rows of them and BINS counts, whatever the input.
    Without labelled documents every score is near 0.5.
    """
    model = Model(size, ridge, seed)
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("double").alias("y"))
    rows = stats.join(known.where(remainder(F.col("__id")) != 1), F.col("doc_id") == F.col("__id")).select("x", "y")
    rows = checkpoint(rows)
    sums = [f(F.col("x")[i]) for i in range(N_FEATURES) for f in (F.avg, F.stddev_pop)]
    count, *found = rows.agg(F.count("*"), *sums).first()
    if not count:
        return model
    model.mean, scale = np.array(found[::2]), np.array(found[1::2])
    model.scale = np.where(scale > 1e-9, scale, 1.0)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 2))
        for batch in batches:
            x, y = _stacked(batch), batch.column("y").to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                z = model.features(x[at : at + 4096])
                total += z.T @ np.hstack([z, y[at : at + 4096, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [int(group["i"].iloc[0])], "sums": [np.sum(np.stack(group["sums"].to_list()), axis=0)]})

    parts = rows.mapInArrow(normal, "i int, sums array<double>").groupBy("i").applyInPandas(added, "i int, sums array<double>")
    equations = np.array([r["sums"] for r in sorted(parts.collect(), key=lambda r: r["i"])])
    a, b = equations[:, :-1], equations[:, -1]
    model.weights = np.linalg.solve(a + ridge * np.eye(size + 1), b)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3 * BINS, 2))
        for batch in batches:
            at = np.clip((model.raw(_stacked(batch)) + 1) * BINS, 0, 3 * BINS - 1).astype(int)
            np.add.at(counts, (at, 0), 1)
            np.add.at(counts, (at, 1), batch.column("y").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(counts[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at, 0]), pa.array(counts[at, 1])], ["bin", "n", "p"])

    bins = rows.mapInArrow(histogram, "bin long, n double, p double").groupBy("bin").agg(F.sum("n"), F.sum("p")).collect()
    bins.sort(key=lambda r: r[0])
    centre, n, p = (np.array([r[i] for r in bins], float) for i in range(3))
    model.knots = isotonic((centre + 0.5) / BINS - 1, n, p)
    return model


def scores(docs: DataFrame, labels: DataFrame, size: int = 256, ridge: float = 1e-2, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text), learned from labels (doc_id, quality).

    held_out: the row was in the fold that nothing is learned from. predicted is 1 from a score of 0.5 on. Inputs
    are statistics of the whole text alone. Null texts are scored as empty ones. Repeated rows are kept, and rows
    without a doc_id are scored and not held out. Other columns are not looked at. An empty table gives an empty
    result.
    """
    stats = stored(document_statistics(docs))
    model = fit(stats, labels, size, ridge, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stacked(batch)))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, size: int = 256, ridge: float = 1e-2, seed: int = 11) -> DataFrame:
    """docs without those that the classifier rejects, columns as they are. Statistics are computed once and kept with the rows."""
    rows = stored(docs.withColumn("__x", statistics_column(F.col("text").cast("string"))))
    model = fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__x").alias("x")), labels, size, ridge, seed)
    return rows.where(model.column(F.col("__x")) >= 0.5).drop("__x")
