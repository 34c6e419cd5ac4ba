"""Benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.kernels import WordHash, ngrams, word_hashes

#: Items, and bytes of their texts, that are searched for in one pass over the documents; they bound what a task holds.
ITEMS, BYTES = 20_000, 1 << 26
#: Values of a sketch beyond those that an item may lack; as many have to be met at least.
MORE = 8
MARKS = 20


class Index:
    """Items of one block by class of size: MinHash sketches to be met and the shingles that verify.

    An item of n shingles may lack m of them, the most that the threshold admits. Its sketch is the bottom of its
    hashes: the m + MORE least, or all. A document that holds the item lacks m values of the sketch at most, so
    the items of which it has all but m are the only candidates, and none is lost. Classes have the items of 2^c to
    2^(c+1)-1 shingles; an item's sketch depends on its class alone, as m does but for rounding.
    """

    def __init__(self, items: list[tuple[int, str]], shingle: int, threshold: float) -> None:
        seen = WordHash()
        self.threshold = threshold
        self.items: list[tuple[int, int, np.ndarray]] = []
        classes: dict[tuple[int, int], list[int]] = {}
        for item_id, text in items:
            words = word_hashes(text, seen)
            if len(words):
                n = min(shingle, len(words))
                grams = np.unique(ngrams(words, n))
                classes.setdefault((n, int(len(grams)).bit_length() - 1), []).append(len(self.items))
                self.items.append((item_id, n, grams))
        self.least = np.zeros(len(self.items), np.int64)
        self.classes = []
        for (n, c), members in sorted(classes.items()):
            size = self.lacking((2 << c) - 1) + MORE
            kept = [self.items[i][2][:size] for i in members]  # grams ascend
            for i, sketch in zip(members, kept, strict=True):
                self.least[i] = max(1, len(sketch) - self.lacking(len(self.items[i][2])))
            values, owner = np.concatenate(kept), np.repeat(members, [len(x) for x in kept])
            order = np.argsort(values, kind="stable")
            self.classes.append((n, values[order], owner[order]))
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({x[0] for x in self.classes}):
            values = np.unique(np.concatenate([x[1] for x in self.classes if x[0] == n]))
            marks = np.zeros(1 << MARKS, bool)
            marks[values >> np.uint64(64 - MARKS)] = True
            self.lengths[n] = values, marks

    def lacking(self, n: int) -> int:
        """The most shingles that a document may lack of n."""
        return n - max(1, int(np.ceil(self.threshold * n - 1e-9)))

    def candidates(self, grams: dict[int, np.ndarray]) -> list[int]:
        """Items of whose sketch a document has all values but those that it may lack."""
        hits = {}
        for n, (values, marks) in self.lengths.items():
            own = grams[n][marks[grams[n] >> np.uint64(64 - MARKS)]]
            own = np.unique(own[values[np.minimum(np.searchsorted(values, own), len(values) - 1)] == own])
            hits[n] = own
        out: list[int] = []
        for n, values, owner in self.classes:
            own = hits[n]
            if not len(own):
                continue
            first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            count = last - first
            met = owner[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            items, times = np.unique(met, return_counts=True)
            out += items[times >= self.least[items]].tolist()
        return out

    def contained(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, shingles found, shingles) of the items that a document holds to the threshold."""
        grams = {n: ngrams(words, n) for n in self.lengths}
        found = []
        for i in self.candidates(grams):
            item_id, n, own = self.items[i]
            hits = int(np.isin(own, grams[n]).sum())
            if hits >= self.threshold * len(own) - 1e-9:
                found.append((item_id, hits, len(own)))
        return sorted(found)


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and a benchmark item of whose distinct word shingles it holds ``threshold`` or more.

    Returns doc_id, item_id, n_found, n_shingles, containment. Words lie between ASCII white space and are compared
    with A-Z in lower case. An item of fewer words than ``shingle`` is one shingle; one without words is in no
    document. Null texts hold nothing. Repeated and null doc_ids and item_ids give a row for each row; of rows of
    docs that are equal in doc_id each is looked at. Other columns of either table are not looked at. An empty
    table gives an empty result.

    The documents are read once, and nothing is shuffled, for each block of items: they are sorted into blocks of
    about ITEMS items and BYTES of text by a hash, and a block is what is sent to the tasks.
    """
    own = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // BYTES))
    result = None
    for k in range(blocks):
        rows = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        part = _search(docs, [(r[0], r[1]) for r in rows.toLocalIterator()], shingle, threshold)
        result = part if result is None else result.union(part)
    return result


def _search(docs: DataFrame, items: list[tuple[int, str]], shingle: int, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    names = ["doc_id", "item_id", "n_found", "n_shingles", "containment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = Index(held.value, shingle, threshold), WordHash()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = word_hashes(text.as_py(), seen)
                out += [(doc_id, i, hits, all_, hits / all_) for i, hits, all_ in index.contained(words)]
            if out:
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, n_found long, n_shingles long, containment double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without those that hold a benchmark item; rows without a doc_id stay, for they can't be named."""
    bad = contaminated(docs, benchmark, shingle, threshold).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
