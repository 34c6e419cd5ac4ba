from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import pytest

from hydrolith.llm import common, line_dedup, mixing, queries

DOCS = "doc_id long, text string, source string, n_lines string, size int"


def brute_lines(docs, run):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(" ")]
        gone = set()
        for j in range(len(lines) - run + 1):
            key = tuple(x for _, x in lines[j : j + run])
            if key in seen:
                gone |= {i for i, _ in lines[j : j + run]}
            seen.add(key)
        out[doc_id] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize(("run", "gram"), [(1, 1), (2, 1), (3, 1), (4, 2)])
def test_repeated_runs_go_as_by_brute_force(spark, run, gram):
    rng = random.Random(run)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", "  ", f"u{rng.random()}"]) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    docs.append((100, "hot\nline\n" * 200 + "end"))
    rows = [(i, t, "s", "x", 1) for i, t in docs]
    found = line_dedup.deduplicate_lines(spark.createDataFrame(rows, DOCS).repartition(5), run, gram)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == brute_lines(docs, run)


def test_heavy_lines_and_long_texts_are_spread_over_salts(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST", 3)
    monkeypatch.setattr(common, "PIECES", 20)
    rng = random.Random(9)
    docs = [(i, f"u{i}\nlicence\n{rng.choice('ab')}\n{rng.choice('ab')}\nv{i}") for i in range(150)]
    docs += [(200, "\n".join(f"x{k}" for k in range(100_000))), (201, "\n".join(f"x{k}" for k in range(50_000, 100_000)) + "\nend")]
    found = line_dedup.deduplicate_lines(spark.createDataFrame([(i, t, "s", "x", 1) for i, t in docs], DOCS))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == brute_lines(docs, 2)


def test_parts_are_even_whatever_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 200)
    rows = [(i, f"{i} % {i}", "a", "x", 1) for i in range(4000)] + [(i, "plain words", "b", "x", 1) for i in range(4000, 6000)]
    frame = spark.createDataFrame(rows, DOCS)
    kept = []
    monkeypatch.setattr(mixing, "stored", lambda df: kept.append(df.cache()) or kept[-1])
    assert mixing.mix(frame).count() == 6000
    sizes = sorted(r["count"] for r in kept[1].groupBy("part").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_line_dedup_of_odd_rows(spark):
    rows = [(1, "x\ny", "s", "k", 1), (1, "x\ny", "s", "k", 1), (None, "x\ny\nz", None, None, None), (2, None, "s", "k", 1), (3, "", "s", "k", 1), (4, "x\ny", "s", "k", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    found = sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in line_dedup.deduplicate_lines(frame).collect()], key=str)
    assert found == sorted([(1, "x\ny", 2, 0), (1, "x\ny", 2, 0), (None, "z", 3, 2), (2, None, 0, 0), (3, "", 0, 0), (4, "", 2, 2)], key=str)
    assert line_dedup.deduplicate_lines(frame.limit(0)).count() == 0


def test_mix_equals_its_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 7)
    rng = random.Random(1)
    rows = [(i, " ".join("w%" for _ in range(rng.randint(0, 40))), rng.choice(["big"] * 8 + ["B", "é", "z", None]), "k", 0) for i in range(400)]
    frame = spark.createDataFrame(rows, DOCS)
    found = sorted(map(tuple, mixing.mix(frame).select("doc_id", "size", "source_size", "target", "taken").collect()))
    con = duckdb.connect()
    table = frame.toPandas()
    con.register("documents", table)
    want = sorted(con.execute(queries.OP8).fetchall())
    assert [(a, b, c, e) for a, b, c, _, e in found] == [(a, b, c, e) for a, b, c, _, e in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want])


def test_targets_stop_at_three_times_a_source(spark):
    sizes = [("a", 10, 1), ("b", 1000, 1), ("c", 20, 1), (None, 30, 1)]
    found = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long, n long")).collect()}
    want, left = {}, dict(zip(["a", "b", "c", None], [1, 2, 3, 1], strict=True))
    size = {s: n for s, n, _ in sizes}
    total = 1060.0
    while left:
        share = {s: total * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            total -= want[s]
            del left[s]
    assert found == pytest.approx(want)


def test_mix_comes_near_targets_and_reruns_agree(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("aaaab"), "k", 0) for i in range(500)] + [(5, "w w", "b", "k", 0)] * 3 + [(None, "w", "b", "k", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(frame).collect()
    assert sorted(found, key=str) == sorted(mixing.mix(frame.repartition(9)).collect(), key=str)
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    assert mixing.mix(frame.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, "", "s", "k", 1)], DOCS)).collect()} == {0}
