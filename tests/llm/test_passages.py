from __future__ import annotations

import random

import numpy as np
import pytest

from hydrolith.llm import chaining, decontaminate, kernels, sparse_suffix

DOCS = "doc_id long, text string, start string, source_id string"


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def planted(rng):
    """Documents of prose; 1 to 4 share a passage of 60 words, 5 and 6 a copy, 7 and 8 passages with changed words."""
    docs = {i: prose(rng, rng.randint(60, 400)) for i in range(30)}
    passage = prose(rng, 60)
    for i in (1, 2, 3, 4):
        at = rng.randint(0, len(docs[i]))
        docs[i][at:at] = passage
    docs[6] = list(docs[5])
    fuzzy = prose(rng, 120)
    changed = [w if k % 15 else "other" for k, w in enumerate(fuzzy)]
    docs[7][10:10], docs[8][20:20] = fuzzy, changed
    return docs


def test_ngram_hashes_stand_for_words():
    words = kernels.WordHash()(" ".join(chr(65 + i % 5) for i in range(50)))
    for n in (1, 2, 3, 5, 6, 8, 13, 32):
        grams = kernels.ngrams(words, n)
        assert len(grams) == 50 - n + 1
        for i in range(len(grams)):
            for j in range(len(grams)):
                assert (grams[i] == grams[j]) == np.array_equal(words[i : i + n], words[j : j + n])
    assert len(kernels.ngrams(words[:2], 3)) == len(kernels.ngrams(words[:0], 1)) == 0


def test_word_hashes_stand_for_words():
    for text in (None, "", " ", "a", " a", "A\tb\n\n a\x0bB ", "é É ab aB b" * 5000, "a b" * 3):
        words, hashes = kernels.split_words(text), kernels.WordHash()(text)
        assert len(words) == len(hashes)
        assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist(), strict=True)))


def test_each_window_holds_a_minimiser():
    grams = np.random.default_rng(1).integers(0, 1 << 60, 500, dtype=np.uint64)
    at = kernels.minimisers(grams, 10)
    want = {i + int(np.argmin(grams[i : i + 10])) for i in range(491)}
    assert set(at.tolist()) == want


def test_chains_are_the_best_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(2, 9)
        a = np.array(sorted(rng.randrange(60) for _ in range(n)))
        b = np.array([rng.randrange(60) for _ in range(n)])
        best = 0
        for mask in range(1, 1 << n):
            path = [i for i in range(n) if mask >> i & 1]
            if all(a[i] < a[j] and b[i] < b[j] for i, j in zip(path, path[1:], strict=False)):
                cost = sum(0.1 * (a[j] - a[i] + b[j] - b[i]) for i, j in zip(path, path[1:], strict=False))
                best = max(best, 4 * len(path) - cost)
        path = chaining.chains(a, b, 4, 0.1, 1)[0]
        got = 4 * len(path) - sum(0.1 * (a[j] - a[i] + b[j] - b[i]) for i, j in zip(path, path[1:], strict=False))
        assert got == pytest.approx(best)


def test_chains_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 2, 5, 30, 39, 450, 12, 25):
        a = np.sort(rng.integers(0, 2 * n, n))
        b = a + rng.integers(0, 3, n) if n % 2 else rng.integers(0, 2 * n, n)
        order = np.lexsort((b, a))
        rows.append((a[order], b[order]))
    first = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])])
    for least in (1, 2):
        whole, paths = chaining.chains_of_many(first, np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows]), 4, 0.05, least)
        for i, (a, b) in enumerate(rows):
            got = [np.arange(len(a))] if whole[i] else paths[i]
            assert [p.tolist() for p in got] == [p.tolist() for p in chaining.chains(a, b, 4, 0.05, least)]


def test_matches_of_many_rows_are_those_of_each():
    """A k-mer of x goes to the nearest equal one by the nearest seed's line, of its own row only."""
    x = [[1, 2, 3, 9, 1, 2, 3], [1, 2, 3, 4], [5, 6]]
    y = [[1, 2, 3, 8, 8, 1, 2, 3], [4, 1, 2, 3], [1, 2, 3]]
    seeds = [([0, 4], [0, 5]), ([0], [1]), ([0], [0])]
    flat = [np.array(sum(rows, []), np.int32) for rows in (x, y)] + [np.array(sum((s[i] for s in seeds), [])) for i in (0, 1)]
    first = [np.concatenate([[0], np.cumsum([len(r) for r in rows])]) for rows in (x, y, [s[0] for s in seeds])]
    row, at, best = chaining.matches_of_many(flat[0], first[0], flat[1], first[1], flat[2], flat[3], first[2], 3)
    assert list(zip(row.tolist(), at.tolist(), best.tolist(), strict=True)) == [(0, 0, 0), (0, 4, 5), (1, 0, 1)]


def test_texts_of_sources_do_not_make_spans_twice(spark):
    """verified() runs three functions over spans: words of documents, words of sources, alignment."""
    own = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(60))) for i in range(2)], "doc_id long, text string")
    met = spark.createDataFrame([(1, 0, 3, 3, False), (1, 0, 9, 9, False)], "doc_id long, source_id long, pos int, source_pos int, alone boolean")
    found = chaining.verified(met, own, 50, 0.8, chaining.SEED)
    assert [(r["start"], r["end"]) for r in found.collect()] == [(0, 60)]
    assert chaining.verified(met, own, 50, 0.8, chaining.SEED)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 3


def test_shared_passages_are_found(spark):
    docs = planted(random.Random(4))
    rows = [(i, " ".join(w), "x", "y") for i, w in docs.items()]
    found = chaining.shared_passages(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    pairs = {(r["doc_id"], r["source_id"]) for r in found}
    assert pairs == {(2, 1), (3, 1), (4, 1), (6, 5), (8, 7)}
    for r in found:
        assert r["n_words"] == r["end"] - r["start"] >= 50
        assert r["similarity"] >= 0.8
        if r["doc_id"] < 7:
            assert docs[r["doc_id"]][r["start"] : r["end"]] == docs[r["source_id"]][r["source_start"] : r["source_end"]]
    assert next(r["n_words"] for r in found if r["doc_id"] == 8) >= 110


def test_suffix_array_finds_repeats_as_by_brute_force(spark):
    docs = planted(random.Random(5))
    docs[20] = docs[21] = docs[22] = prose(random.Random(9), 80)
    rows = [(i, " ".join(w), "x", "y") for i, w in docs.items()]
    found = sparse_suffix.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    seen, want = {}, set()
    for i, w in sorted(docs.items()):
        for j in range(len(w) - 49):
            if seen.setdefault(tuple(w[j : j + 50]), i) != i:
                want.add(i)
    assert {r["doc_id"] for r in found} == want
    for r in found:
        x, y = docs[r["doc_id"]], docs[r["source_id"]]
        a, z, b, y1 = r["start"], r["end"], r["source_start"], r["source_end"]
        assert x[a:z] == y[b:y1]
        assert a == 0 or b == 0 or x[a - 1] != y[b - 1]
        assert z == len(x) or y1 == len(y) or x[z] != y[y1]


def test_passages_of_odd_rows(spark):
    text = " ".join(prose(random.Random(6), 90))
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (1, "short", "x", "y"), (None, text, "x", "y"), (3, None, "x", "y"), (4, "", "x", "y"), (5, "a " * 5000, "x", "y"), (6, "a " * 5000, "x", "y")]
    frame = spark.createDataFrame(rows, DOCS)
    for find in (chaining.shared_passages, sparse_suffix.repeated_passages):
        pairs = {(r["doc_id"], r["source_id"]) for r in find(frame).collect()}
        assert (1, 1) not in pairs
        assert pairs <= {(6, 5)}
        assert find(frame.limit(0)).count() == 0


def brute_contained(docs, items):
    out = set()
    for i, text in docs:
        words = text.lower().split()
        for k, item in items:
            own = item.lower().split()
            n = min(5, len(own))
            if n:
                shingles = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)}
                held = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
                if len(shingles & held) >= 0.8 * len(shingles):
                    out.add((i, k, len(shingles & held)))
    return out


@pytest.mark.parametrize("block", [3, 20_000])
def test_contained_items_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEMS", block)
    rng = random.Random(7)
    items = [(k, " ".join(prose(rng, rng.choice([1, 3, 5, 9, 20, 60])))) for k in range(15)] + [(99, "")]
    docs = []
    for i in range(60):
        words = prose(rng, rng.choice([0, 3, 40, 900]))
        for k in rng.sample(range(15), 2):
            own = items[k][1].split()
            if rng.random() < 0.5 and len(own) > 10:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in own]
        docs.append((i, " ".join(words)))
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs] + [(None, items[3][1], "x", "y"), (500, None, "x", "y")], DOCS)
    b = spark.createDataFrame(items + [(100, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["n_found"]) for r in decontaminate.contaminated(d, b).collect()}
    assert {x for x in found if x[0] is not None} == brute_contained(docs, items)
    left = {r["doc_id"] for r in decontaminate.decontaminate(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, *_ in found} | {None, 500}
    assert decontaminate.contaminated(d, b.limit(0)).count() == decontaminate.contaminated(d.limit(0), b).count() == 0
