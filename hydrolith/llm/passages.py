"""What the two searches for shared passages have in common: documents by id, and words around a span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.kernels import WordHash, word_hashes


def unique_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a row an id: rows without either are left out, and the texts of a repeated id become one, in order."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return own
    return own.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))


#: Bits of the hashes of ids by which documents are let through.
BITS = 1 << 23


def among(docs: DataFrame, ids: DataFrame, others: bool = False) -> DataFrame:
    """docs but for most whose doc_id isn't in ids (doc_id): those whose hash no id has; with ``others`` these instead.

    So few texts move in a join that follows. The table that is broadcast has a row for each 64 bits, and no more at any size.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bits = ids.select(F.floor(bit / 64).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {BITS}L) % 64 as int))").alias("__bit"))
    bits = F.broadcast(bits.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    own = docs.withColumns({"__word": F.floor(bit / 64), "__at": (bit % 64).cast("int")})
    known = F.expr("shiftrightunsigned(__bits, __at) & 1 = 1")
    own = own.join(bits, "__word", "left").where(F.coalesce(~known, F.lit(True))) if others else own.join(bits, "__word").where(known)
    return own.select(*docs.columns)


#: Rows over which the spans of one document are spread when they go together, and spans of a batch that is made of them.
SPREAD, SPANS = 64, 2000


def with_words(spans: DataFrame, docs: DataFrame, key: str, start: str, end: str, name: str, pad: int, other: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """spans, which are a table, with the hashed words of document ``key`` from pad words before start to pad after end, and where they begin.

    Adds ``name`` (array of int, 32 bits of each hash) and ``name``_at (int). Documents move once, to where their spans are.
    With ``other`` the spans of one document go together, in SPREAD rows at most by that column, so its text isn't
    repeated for each. ``ids`` (doc_id) are those of ``key``, if spans is no table, which would be made twice.
    """
    fields = [*spans.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}_at` int, `{name}` array<int>"
    texts = among(docs, ids if ids is not None else spans.select(F.col(key).alias("doc_id"))).select(F.col("doc_id").alias("__key"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, words = WordHash(), None, np.empty(0, np.int32)
        for batch in batches:
            if other is None:
                rows, which = batch, np.arange(len(batch))
            else:
                lists = batch.column("__spans")
                rows = pa.RecordBatch.from_struct_array(lists.flatten())
                which = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            texts = batch.column("__text")
            for begin in range(0, len(rows), SPANS if other else max(len(rows), 1)):
                some = rows.slice(begin, SPANS if other else len(rows))
                out, at = [], []
                for k, r, a, z in zip(some.column(key).to_pylist(), which[begin:].tolist(), some.column(start).to_pylist(), some.column(end).to_pylist(), strict=False):
                    if k != last:
                        last, words = k, (word_hashes(texts[r].as_py(), seen) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    at.append(max(a - pad, 0))
                    out.append(words[at[-1] : z + pad])
                keep = [some.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(at, pa.int32()), pa.array(out, pa.list_(pa.int32()))], [*(f.name for f in fields), f"{name}_at", name])

    if other is not None:
        part = F.pmod(F.xxhash64(other), F.lit(SPREAD)).alias("__part")
        spans = spans.groupBy(key, part).agg(F.collect_list(F.struct(*(f.name for f in fields))).alias("__spans"))
        return spans.join(texts, F.col(key) == F.col("__key")).select("__spans", "__text").mapInArrow(run, schema)
    return spans.join(texts, F.col(key) == F.col("__key")).mapInArrow(run, schema)
