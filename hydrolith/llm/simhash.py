"""Near-duplicates by SimHash fingerprints that meet in Golay-coded segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import salted_join, stored
from hydrolith.llm.graph import connected_components
from hydrolith.llm.kernels import split_words

#: Fixed values of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11
#: Start and width of the three segments of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of one key that are compared in one go; a key with more is cut into blocks of this many.
BLOCK = 4096


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, unsigned; 0 without words."""
    words = split_words(text)
    if not words:
        return 0
    if len(words) <= size:
        digests = xxhash.xxh64_digest(b" ".join(words), seed)
    else:
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(b" ".join(words[i : i + size]), seed) for i in range(len(words) - size + 1)])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text, fp holds the 64 bits as a signed long. One row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, th long, fp long")


def _remainders() -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial; XOR of the remainders of its bits."""
    bits = []
    for i in range(LENGTH):
        r = 1 << i
        for j in range(LENGTH - 1, CHECKS - 1, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - CHECKS)
        bits.append(r)
    return np.array(bits, np.uint32)


class Golay:
    """Decoder of the perfect [23,12,7] code: each word lies within distance 3 of exactly one codeword."""

    def __init__(self) -> None:
        bits = _remainders()
        low = np.zeros(1 << 12, np.uint32)
        high = np.zeros(1 << 11, np.uint32)
        for table, first, width in ((low, 0, 12), (high, 12, 11)):
            for i in range(width):
                table[np.arange(len(table)) >> i & 1 == 1] ^= bits[first + i]
        self.low, self.high = low, high
        words = [0] + [1 << i for i in range(LENGTH)]
        words += [1 << i | 1 << j for i in range(LENGTH) for j in range(i)]
        words += [1 << i | 1 << j | 1 << k for i in range(LENGTH) for j in range(i) for k in range(j)]
        errors = np.array(words, np.uint32)
        self.leader = np.zeros(1 << CHECKS, np.uint32)
        self.leader[self.remainder(errors)] = errors

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12 information bits of the codeword nearest to each word."""
        return (words ^ self.leader[self.remainder(words)]) >> CHECKS

    def around(self, words: np.ndarray) -> np.ndarray:
        """Indices of all codewords within distance 4, one or six a word: a row a word, where repeats are -1.

        A codeword at distance 4 is the nearest one once a bit in which the word differs from it is turned.
        """
        flips = np.array([0] + [1 << i for i in range(LENGTH)], np.uint32)
        found = np.sort(self.index(words[:, None] ^ flips).astype(np.int64), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def _keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a fingerprint is filed, with its number.

    Of three bits over three segments, either a segment has none, and then its bits are a key; or each has one.
    For that case the first two segments are decoded. Words that differ in one bit differ in parity, and the
    codeword nearest to one (within 3) lies within 4 of the other: so the even word is filed under its nearest
    codeword, the odd word under all within 4, and the two meet.
    """
    keys, at = [], []
    number = np.arange(len(fps))
    parts = [(fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.uint32) for s, w in SEGMENTS]
    for i, part in enumerate(parts):
        keys.append(part.astype(np.int64) | i << 60)
        at.append(number)
    sides = []
    for part in parts[:2]:
        odd = np.bitwise_count(part) & 1
        near = code.around(part)
        own = code.index(part).astype(np.int64)
        even = odd == 0
        near[even] = -1
        near[even, 0] = own[even]
        sides.append((odd.astype(np.int64), near))
    (odd_a, near_a), (odd_b, near_b) = sides
    row_a, col_a = np.nonzero(near_a >= 0)
    found_a = near_a[row_a, col_a]
    width = (near_b >= 0).sum(axis=1)
    list_b = near_b[near_b >= 0]
    start_b = np.concatenate([[0], np.cumsum(width)[:-1]])
    times = width[row_a]
    row = np.repeat(row_a, times)
    first = np.repeat(np.cumsum(times) - times, times)
    found_b = list_b[start_b[row] + np.arange(len(row)) - first]
    keys.append(3 << 60 | (odd_a ^ odd_b)[row] << 24 | np.repeat(found_a, times) << 12 | found_b)
    at.append(row)
    return np.concatenate(keys), np.concatenate(at)


def _filed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 2048):
                part = fps[i : i + 2048]
                keys, at = _keys(part.view(np.uint64), code)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether fingerprints of one word, or of a row of words each, differ in most bits at most."""
    bits = np.bitwise_count(a ^ b)
    return (bits.sum(axis=1, dtype=np.int64) if bits.ndim > 1 else bits) <= most


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs that link what is linked among fps, at most one a fingerprint; each pair differs in most bits at most."""
    label = np.arange(len(fps))
    out = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(_near(fps[: i + 1], fps[i], most))
        labels, first = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            out += [(i, int(near[k])) for x, k in zip(labels, first, strict=True) if x != label[i]]
            label[np.isin(label, labels)] = labels[0]
    return out


def _pairs(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by key: all within small groups, a forest within others."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    large = sizes > 16
    for s, n in zip(starts[large], sizes[large], strict=True):
        found = forest(fps[s : s + n], most)
        left += [s + a for a, _ in found]
        right += [s + b for _, b in found]
    small = np.repeat(~large, sizes)
    for step in range(1, 16):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not len(at):
            break
        hit = at[_near(fps[at], fps[at + step], most)]
        left += hit.tolist()
        right += (hit + step).tolist()
    return fps[np.array(left, np.int64)], fps[np.array(right, np.int64)]


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints nodes(fp) that differ in at most most bits, 3 at most.

    Within a small group of a key all links are returned, within a large one enough to connect what is linked: the
    rows returned stay in proportion to those filed. A key with more than BLOCK fingerprints is cut into blocks,
    and each two of them meet in a group of their own.
    """
    if most > 3:
        raise ValueError("the keys guarantee 3 bits at most")
    return met(_filed(nodes), ["fp"], lambda a: a, most)


def met(filed: DataFrame, words: list[str], name: Callable[[np.ndarray], np.ndarray], most: int) -> DataFrame:
    """Links (a, b), by name, between fingerprints of filed(key, words) under one key that differ in at most most bits."""
    blocks = filed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    dealt = filed.join(blocks, "key", "left").withColumn("block", F.pmod(F.xxhash64(*words), F.coalesce("n", F.lit(1))).cast("int"))
    whole = dealt.where("n is null").select("key", F.lit(0).alias("p"), F.lit(0).alias("q"), *words)
    cut = dealt.where("n is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = cut.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            keys = batch.column("grp").to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            fps = np.column_stack([batch.column(w).to_numpy(zero_copy_only=False) for w in words])
            if kept is not None:
                keys, fps = np.concatenate([kept[0], keys]), np.concatenate([kept[1], fps])
            last = np.searchsorted(keys, keys[-1])
            kept = keys[last:], fps[last:]
            if last:
                yield linked(keys[:last], fps[:last])
        if kept is not None:
            yield linked(*kept)

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        fps = fps.view(np.uint64)
        a, b = _pairs(keys, fps[:, 0] if len(words) == 1 else fps, most)
        return pa.RecordBatch.from_arrays([pa.array(name(a).view(np.int64)), pa.array(name(b).view(np.int64))], ["a", "b"])

    # two keys whose groups get one hash only add comparisons, for each link is verified
    groups = whole.union(cut).select(F.xxhash64("key", "p", "q").alias("grp"), *words)
    dealt = groups.repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, size: int, most: int, seed: int) -> DataFrame:
    """(doc_id, th, fp, component_id, kept): kept is the doc_id and th of the document that stands for the component."""
    fps = stored(fingerprints(docs, size, seed))
    nodes = stored(fps.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("first"), F.count("*").alias("n")))
    parts = connected_components(links(nodes.select("fp"), most)).withColumnRenamed("node", "fp")
    known = stored(nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = stored(known.groupBy("component").agg(F.min("first").alias("kept"), F.count("*").alias("fps")))
    by_fp = stored(salted_join(known.select("fp", "component", "n"), least, ["component"], "fps").select("fp", "kept", "n"))
    return salted_join(fps, by_fp, ["fp"], "n").select("doc_id", "th", "fp", F.col("kept.doc_id").alias("component_id"), "kept")


def near_duplicates(docs: DataFrame, size: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """SimHash near-duplicates of documents (doc_id, text): doc_id, fp (long), component_id.

    One row for each row of docs. Fingerprints that differ in at most ``most`` bits are linked, and component_id is
    the least doc_id that links reach. Null and empty texts and those of white space have fingerprint 0 and are
    linked like others. Repeated rows and ids are kept, and a null doc_id reaches others but names no component
    (its component_id is null if all of it are). Other columns of docs, whatever their names, are not looked at.
    An empty table gives an empty result. Rows of one fingerprint, and fingerprints of one component, are spread over
    salts where they meet their component.
    """
    return _grouped(docs, size, most, seed).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, size: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """docs with one document of each group of near-duplicates: that of least doc_id, one row if it is repeated.

    Documents of one doc_id and different texts are different documents: of such in one group the one of the least
    hash of the text stays. Rows without a doc_id stay, for they can't be told apart by it.
    """
    mine = (F.col("doc_id") == F.col("kept.doc_id")) & F.col("th").eqNullSafe(F.col("kept.th"))
    stay = _grouped(docs, size, most, seed).where(mine).select(F.col("doc_id").alias("__stay"), F.col("th").alias("__th")).distinct()
    text = F.xxhash64(F.col("text").cast("string"))
    named = docs.withColumn("__own", text).join(stay, (F.col("doc_id").cast("long") == F.col("__stay")) & (F.col("__own") == F.col("__th")), "left_semi")
    return named.dropDuplicates(["doc_id", "__own"]).drop("__own").unionByName(docs.where(F.col("doc_id").isNull()))
