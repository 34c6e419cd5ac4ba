"""Exact repeated passages by a sparse suffix array over minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import salted_join, stored
from hydrolith.llm.kernels import MIX, WordHash, mixed, ngrams, sliding, word_hashes
from hydrolith.llm.passages import unique_documents

#: Words of a minimiser, and minimisers of which one is retained at least.
GRAM, WINDOW = 8, 16
TOP = np.uint64(0xFFFFFFFF << 32)
ORDER = ["h", "c", "doc_id", "pos"]
RETAINED = "h long, c long, doc_id long, pos int, low int, high int"
MATCHES = "doc_id long, pos int, low int, high int, source_id long, source_pos int"


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int32 if t == "int" else np.int64)) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def retained(words: np.ndarray, length: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the suffixes that a text retains, with the first and the last start of the runs that each stands for.

    A run of ``length`` words is stood for by the suffix at the least of its first ``window`` hashes of ``gram``
    words (by 32 bits, then the first). Equal runs choose the same place, so they meet in one class of suffixes.
    """
    starts = len(words) - length + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    grams = ngrams(words, gram)[: starts + window - 1]
    at = (sliding(grams & TOP | np.arange(len(grams), dtype=np.uint64), window, np.minimum) & ~TOP).astype(np.int64)
    low = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[low], low, np.append(low[1:], starts) - 1


def suffixes(docs: DataFrame, words: int, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(h, c, doc_id, pos, low, high): the retained suffixes.

    h stands for the first words of a suffix, as many as all of its runs have from pos on; c for all words of its
    runs, from the first of low to the last of high, and for where pos lies among them.
    """
    prefix = words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                hashed = word_hashes(text.as_py(), seen)
                at, low, high = retained(hashed, words, gram, window)
                if len(at):
                    whole = ngrams(hashed, words)
                    with np.errstate(over="ignore"):  # the first and the last run overlap, so together they are all the words
                        context = mixed(mixed(whole[low] * MIX + whole[high]) + ((at - low) * window + high - low).astype(np.uint64))
                    out.append((ngrams(hashed, prefix)[at].view(np.int64), context.view(np.int64), np.full(len(at), doc_id), at, low, high))
            if out:
                yield _batch([np.concatenate(c) for c in zip(*out, strict=True)], RETAINED)

    return docs.select("doc_id", "text").mapInArrow(run, RETAINED)


def neighbours(ordered: DataFrame, within: bool) -> DataFrame:
    """What suffixes find among their neighbours in suffix order: (doc_id, pos, low, high, source_id, source_pos).

    A suffix that has the same words in all of its runs as ones before it gets the first of these as its source.
    Others of a class of several contexts get none (null): their runs are to be compared one by one. So are those of a
    class that goes on over the border of a batch, for it isn't seen whole. Suffixes alone in their class
    are left out. A task holds a batch and the first suffix of the last context, however large a class is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, doc, pos, low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            goes_on = before is not None and before[0] == h[0]
            new_h = np.concatenate([[not goes_on], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[not goes_on or before[1] != c[0]], c[1:] != c[:-1]])
            own = np.cumsum(new_h) - new_h[0]  # the class of each row, from 0
            contexts = np.bincount(own, weights=new_c)
            several = contexts > 1
            several[0] |= before is None or goes_on
            several[-1] = True
            head = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
            first, place = doc[head], pos[head]
            if not new_c[0]:
                first[head < 0], place[head < 0] = before[2:]
            met = ~new_c & (within | (doc != first))
            alone = ~met & several[own]
            keep = met | alone
            if keep.any():
                part = _batch([x[keep] for x in (doc, pos, low, high, first, place)], MATCHES)
                gone = pa.array(alone[keep])
                columns = [*part.columns[:4], *(pa.compute.if_else(gone, pa.scalar(None, x.type), x) for x in part.columns[4:])]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)
            before = h[-1], c[-1], first[-1], place[-1]

    return ordered.mapInArrow(run, MATCHES)


def runs_of(docs: DataFrame, alone: DataFrame, words: int) -> DataFrame:
    """(h, g, doc_id, pos): the runs of ``words`` words of the suffixes in alone (doc_id, low, high).

    h and g are hashes by two polynomials: runs that differ agree in both with a chance of 2^-95 a pair.
    """
    places = alone.groupBy("doc_id").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    schema = "h long, g int, doc_id long, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            for doc_id, text, low, high in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("low"), batch.column("high"), strict=True):
                single = word_hashes(text.as_py(), seen)
                first, last = low.values.to_numpy(), high.values.to_numpy()
                count = last - first + 1
                start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                other = ngrams(mixed(single ^ MIX), words)[start] >> np.uint64(33)
                yield _batch([ngrams(single, words)[start].view(np.int64), other.astype(np.int64), np.full(len(start), doc_id), start], schema)

    return docs.select("doc_id", "text").join(places, "doc_id").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, words: int = 50, gram: int = GRAM, window: int = WINDOW, within: bool = False) -> DataFrame:
    """Where documents repeat passages of earlier ones word by word.

    Returns doc_id, source_id, start, end, source_start, source_end (first word, and the one after the last) and
    n_words. Words lie between ASCII white space, A-Z in lower case. The rows cover exactly the words that lie in
    runs of ``words`` words which an earlier document has, at each of their places, each with an earlier place that
    has them; matches that go on at one distance in one source are one row. Where the source changes within a
    passage, rows overlap. With ``within``, an earlier place in the same document counts as well.

    Suffixes are retained at minimisers of 8 words, sorted by their prefix, then by all that is around it, then by
    place, and compared with their neighbours: a suffix whose whole context some earlier one has is extended at
    once, which is how copies end. At the ends of passages, where contexts differ, runs are compared one by one with
    the first of their kind. Suffixes are dealt by ranges that include the place, so a passage that a third of all
    documents hold spans many tasks; runs of one kind are joined with one row and spread over salts.

    Rows without a doc_id or text take no part; texts of a repeated doc_id count as one document. Other columns are
    not looked at. An empty table gives an empty result.
    """
    if gram + window - 1 > words:
        raise ValueError("a run of that many words may hold no retained suffix")
    own = unique_documents(docs)
    kept = suffixes(own, words, gram, window)
    found = stored(neighbours(kept.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER), within))
    met = found.where("source_id is not null")
    met = met.select("doc_id", "source_id", (F.col("pos") - F.col("source_pos")).alias("shift"), F.col("low").alias("start"), (F.col("high") + words).alias("end"))
    runs = stored(runs_of(own, found.where("source_id is null").select("doc_id", "low", "high"), words))
    kinds = runs.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max(F.struct("doc_id", "pos")).alias("last"), F.count("*").alias("n"))
    kinds = kinds.where("first <> last" if within else "first.doc_id < last.doc_id")
    kinds = stored(kinds.select("h", "g", F.col("first.doc_id").alias("source_id"), F.col("first.pos").alias("source_pos"), "n"))
    later = "doc_id > source_id" + (" or doc_id = source_id and pos > source_pos" if within else "")
    near = salted_join(runs, kinds, ["h", "g"], "n").where(later)
    near = near.select("doc_id", "source_id", (F.col("pos") - F.col("source_pos")).alias("shift"), F.col("pos").alias("start"), (F.col("pos") + words).alias("end"))
    line = Window.partitionBy("doc_id", "source_id", "shift").orderBy("start", "end")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    parts = met.union(near).withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
    parts = parts.withColumn("part", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("doc_id", "source_id", "shift", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    places = {"start": F.col("start"), "end": F.col("end"), "source_start": F.col("start") - F.col("shift"), "source_end": F.col("end") - F.col("shift"), "n_words": F.col("end") - F.col("start")}
    return spans.select("doc_id", "source_id", *(v.cast("long").alias(k) for k, v in places.items()))
