"""Near-duplicate documents of a stated similarity: wide SimHash fingerprints propose them, word shingles decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import salted_join, stored
from hydrolith.llm.graph import connected_components
from hydrolith.llm.kernels import WordHash, mixed, ngrams
from hydrolith.llm.simhash import BLOCK, LENGTH, Golay, _pairs, met

#: Bits of a fingerprint of 128 in which a candidate may differ; at a similarity of 0.8 some 19 do.
RADIUS = 27
#: A class of candidates is cut into blocks of about so many shingles and documents.
SHINGLES, MEMBERS = 1 << 19, 512
#: Links that a task holds at once to thin them.
LINKS = 1 << 18
SALT = np.uint64(0xA0761D6478BD642F)


def shingles(text: str | None, size: int, seen: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: of all its words, if it has fewer than size; none without words."""
    words = seen(text)
    return np.unique(ngrams(words, min(size, len(words)))) if len(words) else words


def wide_fingerprint(found: np.ndarray) -> tuple[int, int]:
    """SimHash of 128 bits of distinct shingles, as two words; 0 without any."""
    if not len(found):
        return 0, 0
    ones = np.zeros(128, np.int64)
    for at in range(0, len(found), 1 << 14):
        part = found[at : at + (1 << 14)]
        both = np.column_stack([mixed(part), mixed(part ^ SALT)]).view(np.uint8)
        ones += np.unpackbits(both, axis=1).sum(axis=0, dtype=np.int64)
    high, low = np.packbits(2 * ones > len(found)).view(np.uint64).tolist()
    return high, low


def _node(found: np.ndarray) -> int:
    """One hash for equal sets of shingles."""
    return int(mixed(np.array([mixed(found ^ ~SALT).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64))[0])


def _fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, node, size, high, low) of documents: equal nodes have equal sets of shingles."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "th", "node", "size", "high", "low")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            rows = np.empty((batch.num_rows, 4), np.uint64)
            for i, text in enumerate(batch.column("text")):
                found = shingles(text.as_py(), size, seen)
                rows[i] = _node(found), len(found), *wide_fingerprint(found)
            columns = [pa.array(c) for c in rows.view(np.int64).T.copy()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *columns], schema=schema)

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, th long, node long, size long, high long, low long")


def _segments(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Four segments of 23 bits, two of either word."""
    mask = np.uint64((1 << LENGTH) - 1)
    return [(w >> np.uint64(s) & mask).astype(np.uint32) for w in (high, low) for s in (0, LENGTH)]


def wide_keys(high: np.ndarray, low: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which fingerprints are filed, with the number of the fingerprint.

    Each segment is decoded to the codewords within distance 4, six at most. Two fingerprints share a key if of two
    segments each is near a codeword that is near the other's: errors in the other two don't matter.
    """
    near = [np.sort(code.around(s), axis=1)[:, -6:] for s in _segments(high, low)]
    keys, at = [], []
    for k, (i, j) in enumerate(combinations(range(len(near)), 2)):
        a, b = near[i][:, :, None], near[j][:, None, :]
        row, x, y = np.nonzero((a >= 0) & (b >= 0))
        keys.append(k << 24 | near[i][row, x] << 12 | near[j][row, y])
        at.append(row)
    return np.concatenate(keys), np.concatenate(at)


def _filed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            high, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low"))
            for i in range(0, len(high), 512):
                part = high[i : i + 512], low[i : i + 512]
                keys, at = wide_keys(part[0].view(np.uint64), part[1].view(np.uint64), code)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[0][at]), pa.array(part[1][at])], ["key", "high", "low"])

    many = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fps.select("high", "low").repartition(many, "high", "low").mapInArrow(run, "key int, high long, low long")


def _name(fps: np.ndarray) -> np.ndarray:
    """One hash for a fingerprint; fingerprints that share one only share a class of candidates."""
    with np.errstate(over="ignore"):
        return mixed(mixed(fps[:, 0]) + fps[:, 1])


def thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links (a, b) connect, without circles: those of least names, so that tasks return the same ones."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    names, at = np.unique(np.concatenate([low, high]), return_inverse=True)
    at, up, kept = at.reshape(2, -1), list(range(len(names))), []
    for k in np.lexsort((high, low)).tolist():
        x, y = int(at[0, k]), int(at[1, k])
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    return low[kept], high[kept]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = (np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate((a, b)))
        if len(a) > LINKS:
            a, b = thinned(a, b)
            if 2 * len(a) > LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
    a, b = thinned(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _candidates(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) by name between fingerprints fps(high, low) that share a key and differ in radius bits at most.

    Filed rows move once. A key with more than BLOCK of them is passed on as it is read, and its blocks meet afterwards.
    """
    schema = pa.schema([("key", pa.int32()), *((n, pa.int64()) for n in ("high", "low", "a", "b"))])

    def raw(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[:, 0].copy()), pa.array(fps[:, 1].copy()), none, none], schema=schema)

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((_name(fps.view(np.uint64)), keys))
        a, b = thinned(*(_name(x).view(np.int64) for x in _pairs(keys[order], fps[order].view(np.uint64), radius)))
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int32()), none, none, pa.array(a), pa.array(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, heavy = np.empty(0, np.int32), np.empty((0, 2), np.int64), None
        for batch in batches:
            more = batch.column("key").to_numpy(zero_copy_only=False)
            both = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low")])
            if heavy is not None:
                same = int(np.searchsorted(more, heavy, "right"))
                if same:
                    yield raw(more[:same], both[:same])
                more, both = more[same:], both[same:]
            if not len(more):
                continue
            keys, fps, heavy = np.concatenate([keys, more]), np.concatenate([fps, both]), None
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield linked(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
            if len(keys) > BLOCK:
                yield raw(keys, fps)
                keys, fps, heavy = keys[:0], fps[:0], keys[-1]
        if len(keys):
            yield linked(keys, fps)

    sorted_rows = _filed(fps).repartition("key").sortWithinPartitions("key")
    found = stored(sorted_rows.mapInArrow(run, "key int, high long, low long, a long, b long"))
    # a task reads what several have written, so that their common links go before they move
    light = found.where("a is not null").select("a", "b").mapInArrow(_thin, "a long, b long").distinct()
    return light.union(met(found.where("a is null").select("key", "high", "low"), ["high", "low"], _name, radius))


def similar(sets: list[np.ndarray], fps: np.ndarray, least: float, radius: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link what is linked among sets, one fewer than the sets of each component at most.

    Sets are linked if their fingerprints differ in radius bits at most and their Jaccard similarity is least or more;
    those of one label are linked already. The nearest fingerprints are tried first, and none within one component, so
    that copies of one text need few trials.
    """
    size = np.array([len(s) for s in sets])
    label = np.arange(len(sets)) if label is None else label.copy()
    out = []
    for low, high in ((-1, 9), (9, 15), (15, 21), (21, radius)):
        for i in range(1, len(sets)):
            apart = np.flatnonzero(label[:i] != label[i])
            apart = apart[np.minimum(size[apart], size[i]) >= least * np.maximum(size[apart], size[i])]
            far = np.bitwise_count(fps[apart] ^ fps[i]).sum(axis=1, dtype=np.int64)
            for j in apart[(far > low) & (far <= high)]:
                if label[j] == label[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common and common >= least * (size[i] + size[j] - common):
                    out.append((i, int(j)))
                    label[label == label[i]] = label[j]
    return out


def _blocks(size: Column, rows: Column) -> Column:
    return F.ceil(F.greatest(size / SHINGLES, rows / MEMBERS)).cast("int")


def _in(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def _cut(members: DataFrame) -> DataFrame:
    """members with the number of blocks that their class is cut into, and with their own block, p and q."""
    sums = members.groupBy("class").agg(F.count("*").alias("n"), _blocks(F.sum("size"), F.count("*")).alias("cuts"))
    return salted_join(members, stored(sums), ["class"], "n").drop("n").withColumn("p", _in(F.col("cuts"))).withColumn("q", F.col("p"))


def _star(pairs: list[tuple[int, int]], names: np.ndarray) -> list[tuple[int, int]]:
    """The names that pairs link, each with the least one of its component, but for that one itself."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            up[x] = x = up.get(up[x], up[x])
        return x

    for i, j in pairs:
        x, y = sorted((root(int(names[i])), root(int(names[j]))))
        if x != y:
            up[y] = x
    return [(x, root(x)) for x in list(up)]


def _compared(groups: DataFrame, size: int, least: float, radius: int) -> DataFrame:
    """Nodes a of groups(class, p, q, node, label, high, low, text) with the least node b that links within a group reach.

    Nodes of one label are not compared.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seen = WordHash()
        sets = [shingles(t, size, seen) for t in group["text"]]
        label = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
        found = similar(sets, group[["high", "low"]].to_numpy(np.int64).view(np.uint64), least, radius, label)
        return pd.DataFrame(_star(found, group["node"].to_numpy()), columns=["a", "b"], dtype="int64")

    wanted = groups.select("class", "p", "q", "node", "label", "high", "low", "text")
    return stored(wanted.groupBy("class", "p", "q").applyInPandas(run, "a long, b long"))


def _verified(members: DataFrame, size: int, least: float, radius: int) -> DataFrame:
    """Links (a, b) that connect what is linked among the nodes of members(class, node, size, high, low, text) of one class.

    Classes are cut into blocks, and members of one block compared. Of each component found in a class of several
    blocks the least node goes on to blocks of such, as long as each round halves them. Components that are then left
    in one class are compared in full: members outside the largest one meet its blocks and each other. So near copies
    of one text cost in proportion to their number, however many they are, and no pair is left out.
    """
    dealt = _cut(members).withColumn("label", F.col("node"))
    links = _compared(dealt, size, least, radius)
    wide = stored(dealt.where("cuts > 1").select(*members.columns))
    if wide.isEmpty():
        return links
    texts = wide.select("node", "high", "low", "text")
    # each node is in one block, so links name its component
    names = wide.select("class", "node", "size").join(links, F.col("node") == F.col("a"), "left")
    names = stored(names.select("class", "node", "size", F.coalesce("b", "node").alias("label")))
    before, now = None, names.where("node = label").count()
    while before is None or 2 * now <= before:
        found = _compared(_cut(names.where("node = label")).join(texts, "node"), size, least, radius)
        links = links.union(found)
        heads = names.groupBy("label").agg(F.count("*").alias("rows")).join(found, F.col("label") == F.col("a"), "left")
        heads = stored(heads.select("label", "rows", F.coalesce("b", "label").alias("head")))
        names = stored(salted_join(names, heads, ["label"], "rows").select("class", "node", "size", F.col("head").alias("label")))
        before, now = now, names.where("node = label").count()
    sums = names.groupBy("class", "label").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    main = F.max(F.struct("rows", "size", "label"))
    sums = sums.groupBy("class").agg(main.alias("main"), F.sum("rows").alias("n"), F.sum("size").alias("size"), F.count("*").alias("labels"))
    rest = _blocks(F.col("size") - F.col("main.size"), F.col("n") - F.col("main.rows"))
    parts = sums.where("labels > 1").select("class", "n", F.col("main.label").alias("main"), _blocks(F.col("main.size"), F.col("main.rows")).alias("cuts"), rest.alias("rest"))
    apart = salted_join(names, stored(parts), ["class"], "n")
    within, end = F.col("label") == F.col("main"), F.col("cuts") + F.col("rest") - 1
    apart = apart.withColumn("own", F.when(within, _in(F.col("cuts"))).otherwise(F.col("cuts") + _in(F.col("rest"))))
    apart = apart.withColumn("other", F.explode(F.sequence(F.when(within, F.col("cuts")).otherwise(F.lit(0)), end)))
    apart = apart.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    return links.union(_compared(apart.join(texts, "node"), size, least, radius))


def deduplicate_similar(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group of near-duplicates: that of least doc_id, one row if it is repeated.

    Documents are linked whose sets of ``size``-word shingles (words lower-cased in A-Z; of fewer words, all of them)
    have a Jaccard similarity of ``least`` or more, and groups are what links reach. Candidates share a Golay key and
    differ in at most ``radius`` bits of 128; chains of candidates make classes, in which shingles decide. No pair that
    isn't similar is linked; one that is may be missed if no two segments come near one codeword. Texts without words
    (null, empty, white space) are copies of each other and of no other. Documents of one doc_id and different texts
    are different documents: of such in one group the one of the least hash of the text stays. Rows without a doc_id
    take no part and stay. An empty table gives an empty one; other columns, whatever their names, are kept as they are.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    fps = _fingerprints(named, size)
    nodes = stored(fps.groupBy("node", "size", "high", "low").agg(F.min(F.struct("doc_id", "th")).alias("first")))
    wide = nodes.where("size > 0").select("high", "low").distinct()
    classes = connected_components(_candidates(wide, radius))
    classes = stored(classes.select(F.col("node").alias("name"), F.col("component").alias("class")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low")]).view(np.uint64)
            rest = [batch.column(c) for c in ("node", "size", "high", "low", "id", "th")]
            yield pa.RecordBatch.from_arrays([pa.array(_name(both).view(np.int64)), *rest], ["name", "node", "size", "high", "low", "id", "th"])

    flat = nodes.select("node", "size", "high", "low", F.col("first.doc_id").alias("id"), "first.th").where("size > 0")
    flat = flat.mapInArrow(run, "name long, node long, size long, high long, low long, id long, th long")
    # equal fingerprints of different sets are candidates too, linked to others or not
    twice = flat.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    alike = classes.unionByName(twice.join(classes, "name", "left_anti").select("name", F.col("name").alias("class")))
    members = stored(flat.join(alike, "name").drop("name"))
    text = named.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    texts = stored(text.join(members, ["id", "th"]).dropDuplicates(["node"]).drop("id", "th"))
    groups = connected_components(_verified(texts, size, least, radius)).withColumnRenamed("node", "__node")
    stay = nodes.join(groups, F.col("node") == F.col("__node"), "left").groupBy(F.coalesce("component", "node").alias("group"), (F.col("size") == 0).alias("none"))
    stay = stay.agg(F.min("first").alias("kept")).select(F.col("kept.doc_id").alias("__stay"), F.col("kept.th").alias("__th"))
    own = named.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    kept = own.join(stay, (F.col("doc_id").cast("long") == F.col("__stay")) & (F.col("__own") == F.col("__th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__own"]).drop("__own").unionByName(docs.where(F.col("doc_id").isNull()))
