from __future__ import annotations

import random

import corpus_pipeline
from hydrolith.llm import quality
from tests.llm.test_lines_and_mixing import brute_lines
from tests.llm.test_near_copies import brute_similar
from tests.llm.test_passages import brute_contained


def tables():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("river", "stone", "water", "field") for b in "abcdefghijkl"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)) + "."

    shared = [prose(9) for _ in range(3)]
    items = [(k, prose(14)) for k in range(4)]
    docs, labels = [], []
    for i in range(240):
        lines = [prose(rng.randint(6, 20)) for _ in range(rng.randint(1, 5))]
        good = 1
        if i % 7 == 3:
            lines, good = [x.upper().replace(" ", "!! ") for x in lines], 0
        if i % 11 == 5:
            lines[1:1] = shared
        if i % 13 == 6:
            lines.append(items[i % 4][1])
        text = "\n".join(lines)
        if i % 17 == 9:
            text = docs[i - 1][1]
            good = labels[i - 1][1]
        docs.append((i, text, "en", f"src{i % 5 if i % 3 else 0}", len(text)))
        labels.append((i, good, 0))
    return docs, labels, items


def test_pipeline_as_by_brute_force(spark, tmp_path):
    docs, labels, items = tables()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    predicted = {r["doc_id"]: r["predicted"] for r in quality.scores(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert predicted == {i: q for i, q, _ in labels}
    kept = [(i, t) for i, t, *_ in docs if predicted[i]]
    lines = brute_lines(kept, 2)
    left = sorted(lines.items())
    groups = brute_similar([t for _, t in left])
    left = [x for k, x in enumerate(left) if groups[k] == k]
    bad = {i for i, *_ in brute_contained(left, items)}
    want = {i: len(t.split()) for i, t in left if i not in bad}
    assert bad and len(want) < len(kept) < len(docs)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["size"] for r in found} == want
    source = {i: s for i, _, _, s, _ in docs}
    total = {}
    for i, n in want.items():
        total[source[i]] = total.get(source[i], 0) + n
    assert all(r["source_size"] == total[source[r["doc_id"]]] for r in found)
    for stage in corpus_pipeline.STAGES[:-1]:
        assert stage[1](spark, frame, str(tmp_path)).columns == frame.columns


def test_stages_take_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, th int, size double"
    text = "one river runs by the stone field and then on to the water"
    rows = [(1, text, "en", "a", 1, "x", 1, 0.5), (1, text, "en", "a", 1, "x", 1, 0.5), (1, "another text of the same number stands here", None, None, None, None, None, None)]
    rows += [(None, text, "en", "a", 1, "x", 1, 0.5), (2, None, "en", "a", 1, "x", 1, 0.5), (3, "", None, "b", 0, "x", 1, 0.5), (4, "w " * 40_000, "en", "b", 1, "x", 1, 0.5)]
    frame = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words are in any of them"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, frame, str(tmp_path))
        assert kept.columns == frame.columns
        ids = {(r["doc_id"], r["text"]) for r in kept.collect()}
        assert {i for i, _ in ids} >= {None, 1, 4} and (name != "simhash_near_dedup" or (1, rows[2][1]) in ids)
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, frame, str(tmp_path)).columns == frame.columns
    assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == len(rows)
