"""Searches for shared passages and near-duplicates against brute force."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from hydrolith.llm import chaining, sparse_suffix


def frame(spark, texts):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def prose(rng, n):
    return [f"w{k}" for k in rng.integers(0, 100_000, n)]


def covered(rows):
    return {(r["doc_id"], i) for r in rows for i in range(r["start"], r["end"])}


def repeated(texts, words):
    """(document, word) of all words in runs of that many words which an earlier document has."""
    held, out = set(), set()
    for d, t in enumerate(texts):
        runs = [tuple(t[i : i + words]) for i in range(len(t) - words + 1)]
        out |= {(d, j) for i, r in enumerate(runs) if r in held for j in range(i, i + words)}
        held |= set(runs)
    return out


def test_repeats_meet_the_longest_match_past_edited_copies(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(20):
        passage = prose(rng, 56)
        near = [*passage[:49], *prose(rng, 7)]  # it lies between, and shares 49 words only
        texts += [[*prose(rng, 40), *p, *prose(rng, 30)] for p in (passage, near, passage)]
    got = sparse_suffix.repeated_passages(frame(spark, texts)).collect()
    assert covered(got) == repeated(texts, 50) != set()


def test_each_place_of_a_repeat_is_reported(spark):
    rng = np.random.default_rng(4)
    passage = prose(rng, 60)
    texts = [[*prose(rng, 20), *passage], [*passage, *prose(rng, 9), *passage, *passage], ["la"] * 120, [*prose(rng, 30), *["la"] * 150]]
    got = sparse_suffix.repeated_passages(frame(spark, texts)).collect()
    assert covered(got) == repeated(texts, 50) != set()


def edited(rng, t, share):
    """t with exactly that share of its words replaced."""
    t = list(t)
    at = rng.choice(len(t), round(share * len(t)), replace=False)
    for i, w in zip(at, prose(rng, len(at))):
        t[i] = w
    return t


def linked(rows):
    return {(r["doc_id"], r["source_id"]) for r in rows}


def test_fuzzy_passages_of_fifty_words_have_seeds(spark):
    rng = np.random.default_rng(6)
    for share, least in ((0.1, 0.99), (0.14, 0.9)):
        texts = []
        for _ in range(100):
            passage = prose(rng, 60)
            texts += [passage, [*edited(rng, passage[:58], share), *passage[58:]]]
        got = linked(chaining.shared_passages(frame(spark, texts)).collect())
        assert sum((2 * i + 1, 2 * i) in got for i in range(100)) >= 100 * least


def test_copies_of_copies_are_linked(spark):
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(100):
        first = prose(rng, 80)
        second = edited(rng, first, 0.08)
        texts += [first, second, edited(rng, second, 0.15)]
    got = linked(chaining.shared_passages(frame(spark, texts)).collect())
    assert sum((3 * i + 2, 3 * i + 1) in got for i in range(100)) >= 95


def test_the_line_stage_deletes_long_single_lines(spark):
    rng = np.random.default_rng(8)
    line, short = " ".join(prose(rng, 50)), " ".join(prose(rng, 10))
    texts = [(0, f"a b\n{line}\n{short}\nc d"), (1, line), (2, f"e f\n{line}\ng h\n{short}")]
    got = corpus_pipeline.line_stage(spark, spark.createDataFrame(texts, "doc_id long, text string"), "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == {0: texts[0][1], 1: "", 2: f"e f\ng h\n{short}"}


def test_op3_passages_meet_past_unlike_holders_of_their_pieces(spark):
    """The pieces of a passage stand alone in documents before both of its holders and between them; copies of a text get one row."""
    rng = np.random.default_rng(12)
    passage = [f"p{rng.integers(10**6)}" for _ in range(120)]

    def filler(n):
        return [f"f{rng.integers(10**6)}" for _ in range(n)]

    pieces = [passage[i : i + 40] for i in range(0, 81, 20)]
    texts = {i: " ".join([*filler(30), *p, *filler(30)]) for i, p in enumerate(pieces)}
    texts |= {200 + i: " ".join([*filler(30), *p, *filler(30)]) for i, p in enumerate(pieces)}
    texts |= {100: " ".join([*filler(30), *passage, *filler(30)]), 300: " ".join([*filler(20), *passage, *filler(20)])}
    texts[400] = texts[401] = texts[300]
    near = passage.copy()
    near[30::40] = ["x", "y", "z"]
    texts[500] = " ".join(near)
    got = {(r["doc_id"], r["source_id"]): r for r in chaining.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(got) == {(300, 100), (400, 300), (401, 300), (500, 100), (500, 300)}
    assert got[300, 100]["n_words"] == 120 and got[400, 300]["n_words"] == 160 and got[500, 300]["similarity"] < 1


def test_op3_frequent_lines_dont_pair_their_holders(spark):
    """Holders of a short common line aren't paired, but those that share a passage with it are found among them, past unlike first and last holders."""
    rng = np.random.default_rng(14)
    line = prose(rng, 13)
    passage = [*prose(rng, 40), *line, *prose(rng, 40)]
    texts = [[*prose(rng, 50), *line, *prose(rng, 50)] for _ in range(120)]
    for i, p in ((50, passage), (80, edited(rng, passage[:40], 0.1) + line + edited(rng, passage[53:], 0.1)), (100, [*passage[20:40], *line, *passage[53:75]])):
        texts[i] = [*prose(rng, 30), *p, *prose(rng, 30)]
    docs = frame(spark, texts)
    got = chaining.shared_passages(docs).collect()
    assert {(80, 50), (100, 50)} <= linked(got) <= {(80, 50), (100, 50), (100, 80)}
    assert chaining.seeds(docs).groupBy("h").count().where("count > 100").count() > 0


def frequent_holders(rng, n):
    """n documents of a passage of which every seed is frequent, each with other edits, and unlike holders of its pieces before and among them."""
    passage = prose(rng, 120)
    texts = [[*prose(rng, 30), *passage[i % 81 : i % 81 + 40], *prose(rng, 30)] for i in range(2 * n)]
    for i in range(n):
        texts.append([*prose(rng, 20), *edited(rng, passage, 0.05), *prose(rng, 20)])
        texts.append([*prose(rng, 30), *passage[i % 81 : i % 81 + 40], *prose(rng, 30)])
    return texts, {2 * n + 2 * i for i in range(n)}


def test_op3_family_of_frequent_seeds_is_connected(spark):
    texts, family = frequent_holders(np.random.default_rng(15), 40)
    got = chaining.shared_passages(frame(spark, texts)).collect()
    words = covered(got)
    assert {r["doc_id"] for r in got} >= family - {min(family)}
    assert all(sum((d, j) in words for j in range(20, 140)) >= 100 for d in family - {min(family)})
    root = {d: d for d in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sorted(linked(got)):
        root[max(find(d), find(s))] = min(find(d), find(s))
    assert len({find(d) for d in family}) == 1


def test_op3_meets_frequent_seeds_only_where_a_passage_may_be(spark):
    rng = np.random.default_rng(16)
    line = prose(rng, 13)
    docs = frame(spark, [[*prose(rng, 50), *line, *prose(rng, 50)] for _ in range(100)])
    held = chaining.seeds(docs).groupBy("h").agg(chaining.F.collect_list(chaining.F.struct("doc_id", "at")).alias("r")).where(chaining.F.size("r") > chaining.FEW)
    many = held.select("h", chaining.F.inline("r"))
    found = spark.createDataFrame([], "doc_id long, start long, end long, equal boolean")
    left = chaining.open_places(many, found, 5)
    assert left.where("open").count() >= 100
    assert chaining.beside(left, docs, 50, 0.8, 5).count() == 0
