from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from hydrolith.llm import common, simhash
from hydrolith.llm.graph import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def noisy(rng, base, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "ÉA b c", "a a a a a a", "The X\x0by\x0cz " * 300])
def test_fingerprint_matches_brute_force(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_every_word_decodes_within_three_bits_and_sees_all_codewords_within_four():
    code = simhash.Golay()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 300, dtype=np.uint32)
    codewords = np.arange(1 << 23, dtype=np.uint32)
    codewords = codewords[code.remainder(codewords) == 0]
    assert len(codewords) == 1 << 12
    near = code.around(words)
    for word, own, row in zip(words, code.index(words), near, strict=True):
        away = np.bitwise_count(codewords ^ word)
        assert sorted(codewords[away <= 3] >> 11) == [own]
        assert sorted(codewords[away <= 4] >> 11) == sorted(x for x in row if x >= 0)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_fingerprints_up_to_three_bits_apart_share_a_key(most):
    rng = random.Random(most)
    code = simhash.Golay()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), most):
            b ^= 1 << i
        keys, at = simhash._keys(np.array([a, b], np.uint64), code)
        assert set(keys[at == 0]) & set(keys[at == 1])


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({noisy(rng, x, 4) for x in fps for _ in range(3)} | {noisy(rng, fps[0], 3) for _ in range(150)} | {0})
    monkeypatch.setattr(simhash, "BLOCK", 32)  # the large group is cut into blocks
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    parts = dict(connected_components(simhash.links(nodes)).collect())
    want = brute_components(fps)
    mine = [parts.get(signed(x), signed(x)) for x in fps]
    assert len(set(mine)) == len(set(want))
    assert len({(a, b) for a, b in zip(mine, want, strict=True)}) == len(set(want))


def test_long_paths_and_loops_are_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (300, 301), (301, 300)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(201)} == {0}
    assert found[301] == found[300] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_without_words_ids_or_difference(spark):
    text = "one two three four five six seven eight"
    rows = [(7, None, "x", 1), (3, "", "x", 2), (None, "  ", None, None), (5, text, "x", 1), (5, text, "x", 1), (4, text.upper(), "y", 0), (None, "lonely words here now", "z", 1)]
    found = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()]
    assert sorted(found, key=str) == sorted([(7, 3), (3, 3), (None, 3), (5, 4), (5, 4), (4, 4), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_document_of_a_group_stays(spark):
    rows = [(9, "a b c d", "k", 1), (2, "A B C D", "k", 1), (2, "A B C D", "k", 1), (4, "other words stand here", "k", 1), (None, "a b c d", "k", 1)]
    found = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["doc_id"] for r in found.collect()), key=str) == [2, 4, None]
    assert found.columns == ["doc_id", "text", "fp", "component_id"]


def test_unlike_texts_of_one_id_are_documents_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST", 1)
    monkeypatch.setattr(common, "PIECES", 3)
    rows = [(5, "a text that stands here once", "k", 1), (5, "quite another thing to read", "k", 1), (7, "a text that stands here once", "k", 1), (8, None, "k", 1), (8, "", "k", 1)]
    rows += [(20 + i, "the same words again and again", "k", 1) for i in range(30)]
    found = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in found) == [(5, rows[0][1]), (5, rows[1][1]), (8, ""), (20, rows[5][1])]
    assert simhash.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
