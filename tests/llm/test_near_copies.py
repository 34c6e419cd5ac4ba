from __future__ import annotations

import random

import numpy as np

from hydrolith.llm import near_copies, simhash
from hydrolith.llm.kernels import WordHash
from hydrolith.llm.near_copies import RADIUS, deduplicate_similar, shingles, similar, wide_fingerprint, wide_keys
from hydrolith.llm.simhash import Golay


def brute_sets(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1)} if words else set()


def brute_similar(texts, least=0.8):
    """Number of the first text that links of similar texts reach, for each; texts without words are alike."""
    sets = [brute_sets(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and (a == b or (a and b and len(a & b) >= least * len(a | b))):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"edit{rng.randrange(10**6)}"
    return out


def corpus(rng, families, copies):
    texts = []
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 300))]
        texts += [" ".join(edited(rng, base, k % 3)) for k in range(copies)]
        texts.append(" ".join(edited(rng, base, len(base) // 3)))
    return texts


def test_kernel_links_what_shingles_link():
    rng = random.Random(3)
    texts = corpus(rng, 12, 6)
    seen = WordHash()
    sets = [shingles(t, 5, seen) for t in texts]
    assert [len(s) for s in sets] == [len(brute_sets(t)) for t in texts]
    fps = np.array([wide_fingerprint(s) for s in sets], np.uint64)
    label = list(range(len(texts)))
    pairs = similar(sets, fps, 0.8, 128)
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    assert label == brute_similar(texts) and len(pairs) == len(texts) - len(set(label))


def test_keys_meet_as_measured():
    """Of fingerprints that differ in 19 bits, as many as a similarity of 0.8 gives, over eight in ten share a key; of 12, nearly all."""
    rng = np.random.default_rng(4)
    code, share = Golay(), {}
    for far in (12, 19):
        a = rng.integers(0, 2, (300, 128), dtype=np.uint8)
        turn = np.zeros_like(a)
        turn[:, :far] = 1
        pair = [np.packbits(x, axis=1).view(np.uint64) for x in (a, a ^ rng.permuted(turn, axis=1))]
        filed = []
        for fps in pair:
            keys, at = wide_keys(fps[:, 0], fps[:, 1], code)
            filed.append([set(keys[at == i].tolist()) for i in range(len(fps))])
        share[far] = np.mean([bool(x & y) for x, y in zip(*filed, strict=True)])
    assert share[12] > 0.97 and share[19] > 0.8 and RADIUS >= 19


def test_stage_as_by_brute_force(spark):
    rng = random.Random(5)
    texts = corpus(rng, 20, 5)
    hub = [f"v{rng.randrange(900)}" for _ in range(120)]
    texts += [" ".join(edited(rng, hub, rng.randint(0, 4))) for _ in range(150)]
    texts += ["", None, " \t", "one two", "One TWO", "one two three", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = [r["doc_id"] for r in deduplicate_similar(frame).collect()]
    want = set(brute_similar(texts))
    # what isn't similar is never linked; of what is, four segments miss about one link in a hundred here
    assert len(kept) == len(set(kept)) and want <= set(kept) and len(set(kept) - want) <= 0.02 * len(texts)


def test_heavy_keys_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    hub = [f"v{rng.randrange(900)}" for _ in range(150)]
    texts = [" ".join(edited(rng, hub, rng.randint(0, 3))) for _ in range(120)] + ["a text by itself that no other one is like"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for module in (near_copies, simhash):
        monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "MEMBERS", 40)
    kept = sorted(r["doc_id"] for r in deduplicate_similar(frame).collect())
    assert kept == sorted(set(brute_similar(texts))) and len(kept) < 10


def test_large_classes_are_compared_in_full(spark, monkeypatch):
    """A class of many blocks that falls into several components, the members of which lie all over the blocks."""
    rng = random.Random(8)
    hub = [f"v{rng.randrange(900)}" for _ in range(150)]
    far = edited(rng, hub, 9)
    families = [hub, far, edited(rng, far, 9), edited(rng, hub, 12)]
    texts = [" ".join(edited(rng, f, rng.randint(0, 2))) for f, n in zip(families, (60, 25, 25, 9), strict=True) for _ in range(n)]
    rng.shuffle(texts)
    seen = WordHash()
    sets = [shingles(t, 5, seen) for t in texts]
    schema = "class long, node long, size long, high long, low long, text string"
    rows = []
    for i, (t, s) in enumerate(zip(texts, sets, strict=True)):
        high, low = (int(x) for x in np.array(wide_fingerprint(s), np.uint64).view(np.int64))
        rows.append((i % 2 if i < 12 else 2, i, len(s), high, low, t))
    frame = spark.createDataFrame(rows, schema).repartition(4)
    for members, count in ((8, 1 << 19), (512, 1 << 10), (512, 1 << 19)):
        monkeypatch.setattr(near_copies, "MEMBERS", members)
        monkeypatch.setattr(near_copies, "SHINGLES", count)
        found = [(r["a"], r["b"]) for r in near_copies._verified(frame, 5, 0.8, 128).collect()]
        label = list(range(len(texts)))
        for a, b in found:
            assert rows[a][0] == rows[b][0]
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        for c in range(3):
            own = [i for i, r in enumerate(rows) if r[0] == c]
            want = [own[k] for k in brute_similar([texts[i] for i in own])]
            assert [label[i] for i in own] == want
        assert len({label[i] for i in range(12, len(texts))}) > 1


def test_odd_rows(spark):
    text = "one river runs by the stone field and then on to the water"
    rows = [(1, text, "a", 1), (1, text, "a", 1), (1, "another text stands under this number", None, None), (2, None, "b", 2), (3, "", "b", 3), (4, text + " ", "x", 1)]
    rows += [(None, text, "a", 1), (None, None, None, None), (5, "w " * 200_000, "y", 9), (6, "W " * 200_001, "y", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string, size long")
    found = deduplicate_similar(frame)
    assert found.columns == frame.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:7]) for r in found.collect())
    assert got == [(0, ""), (0, "one riv"), (1, "another"), (1, "one riv"), (2, ""), (5, "w w w w")]
    assert deduplicate_similar(frame.limit(0)).count() == 0


def test_thinned_links_connect_the_same():
    rng = np.random.default_rng(9)
    for n, m in ((0, 0), (1, 30), (40, 30), (400, 90)):
        a, b = rng.integers(-m, m, (2, n))
        low, high = near_copies.thinned(a, b)
        assert set(zip(low, high, strict=True)) <= set(zip(np.minimum(a, b), np.maximum(a, b), strict=True))
        parts = []
        for pairs in (zip(a, b, strict=True), zip(low, high, strict=True)):
            label = {x: x for x in (*a.tolist(), *b.tolist())}
            for x, y in pairs:
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = {k: new if v == old else v for k, v in label.items()}
            parts.append(label)
        assert parts[0] == parts[1] and len(low) == len(parts[0]) - len(set(parts[0].values()))
