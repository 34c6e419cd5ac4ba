"""Pairs of series by blocks: equal to SQL on odd tables, and what is moved grows with the series, not with their pairs."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrolith.operators import impute, merge, pairs

KIND = "grp string, key long, t long, value double"
J21 = "SELECT a.grp, a.key AS a, b.key AS b, corr(a.value, b.value) AS r, count(*) AS n FROM s a JOIN s b ON a.grp = b.grp AND a.t = b.t AND a.key < b.key GROUP BY ALL HAVING count(*) >= 8"
M03 = """WITH pr AS (SELECT a.grp, a.key AS a, b.key AS b, corr(a.value, b.value) AS r, avg(a.value) AS mx, avg(b.value) AS my, covar_pop(a.value, b.value) AS c, var_pop(b.value) AS v FROM s a JOIN s b ON a.grp = b.grp AND a.t = b.t AND a.key <> b.key GROUP BY ALL HAVING count(*) >= 8 AND var_pop(b.value) > 0),
bp AS (SELECT *, row_number() OVER (PARTITION BY grp, a ORDER BY abs(r) DESC, b) AS k FROM pr WHERE NOT isnan(r))
SELECT p.grp, p.a AS key, s.t, sum(r * r * (mx + c / v * (s.value - my))) / sum(r * r) AS value, count(*) AS n_donors FROM bp p JOIN s ON s.grp = p.grp AND s.key = p.b WHERE k <= 5 GROUP BY ALL"""


def odd_series():
    """Two groups of series with gaps, nulls, repeated times, constants and a constant but for one value."""
    rng, rows = np.random.default_rng(5), []
    for key in range(60):
        for t in range(30):
            if rng.random() < 0.25:
                continue
            value = 3.3 if key == 4 else (1e6 if t == 3 else 0.1) if key == 5 else float(rng.normal(1000, 1 + key))
            rows.append(("a" if key < 45 else "b", key, t, None if rng.random() < 0.05 else value))
            if key == 7 and t % 5 == 0:
                rows.append(("a", key, t, value + 1))
    return [*rows, (None, 1, 1, 1.0), ("a", None, 1, 1.0), ("a", 1, None, 1.0), ("c", 99, 1, 2.0)]


def held_against(found, sql, rows, keys, value):
    s = pd.DataFrame(rows, columns=["grp", "key", "t", "value"]).astype({"key": "Int64", "t": "Int64"})  # noqa: F841
    columns = [*keys, value, "n" if "a" in keys else "n_donors"]
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    got = [tuple(r[c] for c in columns) for r in found.collect()]
    assert sorted((r[:3] for r in got), key=repr) == sorted((r[:3] for r in want), key=repr)
    by = {r[:3]: r[3:] for r in want}
    for r in got:
        x, y = r[3], by[r[:3]][0]
        assert r[4] == by[r[:3]][1]
        assert (y is None or math.isnan(y)) and (x in (None, 0.0)) or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7), (r, y)


@pytest.mark.parametrize("block", [4, 512])
def test_correlations_equal_sql(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rows = odd_series()
    held_against(merge.pairwise_correlation(spark.createDataFrame(rows, KIND)), J21, rows, ["grp", "a", "b"], "r")


@pytest.mark.parametrize("block", [4, 512])
def test_donors_equal_sql(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rows = odd_series()
    held_against(impute.donor_estimates(spark.createDataFrame(rows, KIND), 5), M03, rows, ["grp", "key", "t"], "value")


def moved(spark, run):
    """Rows that shuffles write while run() runs."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize("operator", [merge.pairwise_correlation, impute.donor_estimates])
def test_pairs_are_not_moved(spark, operator):
    rng = np.random.default_rng(2)
    s = spark.createDataFrame([("a", k, t, float(rng.random())) for k in range(150) for t in range(12)], KIND)
    assert moved(spark, lambda: operator(s).write.format("noop").mode("overwrite").save()) < 10000  # 11175 pairs, which meet 12 times


def gappy():
    rng = np.random.default_rng(9)
    base = rng.normal(size=40).cumsum()
    x = np.array([100 + k + (1 + k / 10) * base + rng.normal(size=40) for k in range(24)])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3, 4:] = np.nan
    x[5, 2:] = np.nan
    x[6, np.isfinite(x[6])] = 7.1
    return x


def imputed(spark, operator, x):
    """What an operator makes of one group, and the partitions it came from; a value is given as two that it is the mean of."""
    rows = [("a", k, 500 + t, float(v)) for k, series in enumerate(x) for t, v in enumerate(series) if np.isfinite(v)]
    rows = [*rows[1:], (*rows[0][:3], rows[0][3] - 1), (*rows[0][:3], rows[0][3] + 1), ("a", 1, 500, None), ("b", 50, 3, 1.5)]
    found = operator(spark.createDataFrame(rows, "grp string, key long, m long, value double"), "grp").withColumn("part", F.spark_partition_id()).collect()
    assert [(r["key"], r["m"], r["value"]) for r in found if r["grp"] == "b"] == [(50, 3, 1.5)]
    own = [r for r in found if r["grp"] == "a"]
    out = np.full(x.shape, np.nan)
    for r in own:
        out[r["key"], r["m"] - 500] = r["value"]
    assert len(own) == x.size
    return out, len({r["part"] for r in own})


@pytest.mark.parametrize("block", [5, 512])
def test_series_of_a_group_are_completed_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    x, month = gappy(), np.arange(500, 540)
    x[1, 0] = np.nan
    got, parts = imputed(spark, impute.impute_with_donors, x)
    assert np.allclose(got, [impute.complete_with_donors(x, i, month) for i in range(len(x))], atol=1e-6)
    assert parts > 1 or block == 512
    got, parts = imputed(spark, impute.impute_supported, x)
    assert np.allclose(got, [impute.supported(x, i, month, impute.rng_for(42, i)) for i in range(len(x))], atol=1e-6)
    assert parts > 1 or block == 512


@pytest.mark.parametrize("shape", [(3, 40), (20, 40), (40, 40)])
def test_many_matrices_are_filled_as_one(shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, *shape))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3] = 1.0
    want = [impute.soft_impute(m, 3, rounds=100, tol=1e-7, start="row", stop="cell") for m in x]
    assert np.allclose(impute.soft_impute_many(x, 3, 100, 1e-7), want, atol=1e-7)


def test_full_series_come_from_blocks(spark, monkeypatch):
    """Each series of one group once a month, from several tasks, with what was observed as it was."""
    monkeypatch.setattr(pairs, "BLOCK", 5)
    x = gappy()
    s = spark.createDataFrame([("a", k, t, float(v)) for k, series in enumerate(x) for t, v in enumerate(series) if np.isfinite(v)], "grp string, key long, m long, value double")
    whole = {(r["key"], r["m"]): r for r in impute.full_series(s, "grp", 1, 0).collect()}
    assert len(whole) == x.size
    assert all(whole[k, t]["value"] == x[k, t] for k, t in zip(*np.nonzero(np.isfinite(x)), strict=True))
    assert "applyInPandas" not in (plan := impute.full_series(s, "grp", 1, 0)._jdf.queryExecution().toString()) and "FlatMapGroupsInPandas" not in plan
    monkeypatch.setattr(pairs, "BLOCK", 512)
    for r in impute.full_series(s, "grp", 1, 0).collect():
        other = whole[r["key"], r["m"]]
        assert r["fill_stage"] == other["fill_stage"] and np.isclose(r["value"], other["value"], atol=1e-6)


@pytest.mark.parametrize("longest, pad", [(2, 0), (5, 1), (24, 6)])
def test_small_gaps_are_those_of_the_plan(spark, longest, pad):
    from hydrolith.operators import series

    x = gappy()
    x[8], x[9], x[10] = np.nan, np.nan, np.nan
    x[9, 7], x[10, [3, 30]] = 4.0, (1.0, 2.0)
    s = spark.createDataFrame([(k, t, float(v)) for k, row in enumerate(x) for t, v in enumerate(row) if np.isfinite(v)], "key long, m long, value double")
    want = np.full(x.shape, np.nan)
    for r in series.fill_small_gaps(s, longest, pad).where("value is not null").collect():
        want[r["key"], r["m"]] = r["value"]
    assert np.allclose(impute.small_gaps(x, longest, pad), want, rtol=1e-12, atol=0, equal_nan=True)


def test_full_series_read_measurements_once(spark, tmp_path):
    x = gappy()
    rows = [("a", k, t, float(v)) for k, row in enumerate(x) for t, v in enumerate(row) if np.isfinite(v)]
    spark.createDataFrame([*rows, ("a", 2, 1, None), ("a", 30, 1, math.nan)], "grp string, key long, m long, value double").write.parquet(f"{tmp_path}/s")
    found = impute.full_series(spark.read.parquet(f"{tmp_path}/s"), "grp", 2, 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan parquet") <= 2  # the values, and the sizes of groups
    whole = found.toPandas()
    assert len(whole) == x.size and whole["value"].notna().all()
    stage = np.full(x.shape, "", object)
    stage[whole["key"], whole["m"]] = whole["fill_stage"]
    small = np.isfinite(impute.small_gaps(x, 2, 0))
    assert ((stage == "observed") == np.isfinite(x)).all() and ((stage == "small_gap_pchip") == (small & ~np.isfinite(x))).all()
    assert (whole["observed"].notna() == (whole["fill_stage"] == "observed")).all()
