"""Quantiles and ranks against numpy and pandas, with ties, gaps and hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.functions import quantiles
from lanewise.functions.quantiles import average_ranks, column_quantiles, exact_quantiles, grouped_stats
from lanewise.functions.sizing import left_join

PROBS = [0, 0.1, 0.25, 0.5, 0.9, 0.99, 0.999, 1]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "v": np.round(rng.lognormal(0, 2, n), 3)})
    pdf.loc[rng.random(n) < 0.35, "v"] = 7.0
    pdf.loc[rng.random(n) < 0.1, "g"] = None
    pdf["v"] = pdf["v"].astype(object)
    pdf.loc[rng.random(n) < 0.05, "v"] = None
    pdf = pdf.astype(object).where(pdf.notna(), None)
    return pdf, spark.createDataFrame(pdf, "g string, v double")


@pytest.mark.parametrize("buckets,cell_rows", [(2, 1), (64, 1), (64, 50), (4096, 100_000)])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact_however_often_cells_are_cut(frame, buckets, cell_rows, by):
    pdf, df = frame
    out = exact_quantiles(df, "v", PROBS, by, buckets, cell_rows)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = out.collect()
    groups = pdf.assign(v=pdf["v"].astype(float)).groupby("g", dropna=False)["v"] if by else [(None, pdf["v"].astype(float))]
    want = {None if pd.isna(k) else k: np.quantile(v.dropna(), PROBS) for k, v in groups}
    assert {r["g"] if by else None for r in got} == set(want)
    for r in got:
        assert r["quantiles"] == pytest.approx(list(want[r["g"] if by else None]), abs=1e-9)


def test_grouped_stats_agree_with_percentile(frame):
    _, df = frame
    aggs = [F.count("*").alias("n"), F.avg("v").alias("m")]
    exact = [F.percentile("v", 0.5).alias("q50"), F.percentile("v", 0.9).alias("q90")]
    one = grouped_stats(df, ["g"], aggs, {"q50": ("v", 0.5), "q90": ("v", 0.9)})
    one, two = (x.toPandas().sort_values("g").reset_index(drop=True) for x in (one, df.groupBy("g").agg(*aggs, *exact)))
    pd.testing.assert_frame_equal(one[two.columns], two)


def test_what_is_ordered_at_last_is_bounded(spark, monkeypatch):
    """However close the values lie, no cell of more than ``cell_rows`` rows is left, unless it is one value."""
    stored = []
    keep = quantiles.write_table
    monkeypatch.setattr(quantiles, "write_table", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    df = spark.range(20_000).select((1e6 + F.col("id") / 1e7).alias("v")).unionAll(spark.range(3000).select(F.lit(1e6).alias("v")))
    values = np.r_[1e6 + np.arange(20_000) / 1e7, np.full(3000, 1e6)]
    got = exact_quantiles(df, "v", PROBS, buckets=8, cell_rows=100).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), abs=1e-9)
    assert len(stored) > 2
    assert stored[-1].where("__from < __to").agg(F.max("__n")).first()[0] <= 100
    assert stored[-1].where("__from = __to").agg(F.max("__n")).first()[0] >= 3000


def test_columns_share_their_rounds(frame, monkeypatch):
    """Several columns with probabilities of their own take as many rounds as one; a column without values is null."""
    pdf, df = frame
    stored = []
    keep = quantiles.write_table
    monkeypatch.setattr(quantiles, "write_table", lambda df, name: stored.append(name) or keep(df, name))
    wide = df.select("g", "v", (-F.col("v")).alias("w"), F.lit(None).cast("double").alias("none"))
    got = column_quantiles(wide, {"v": PROBS, "w": [0.5], "none": [0.1, 0.2]}, ["g"]).collect()
    assert len(stored) == 1
    for r in got:
        values = pdf["v"][pdf["g"].isna() if r["g"] is None else pdf["g"] == r["g"]].dropna().astype(float)
        assert r["v"] == pytest.approx(list(np.quantile(values, PROBS)), abs=1e-9)
        assert r["w"] == pytest.approx([-np.quantile(values, 0.5)], abs=1e-9)
        assert r["none"] is None


def test_extreme_values_and_empty_input(spark):
    values = [float("-inf"), -1.7e308, -1.0, -5e-324, 0.0, -0.0, 5e-324, 1.0, 1.7e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = [i / 10 for i in range(11)]
    for cell_rows in (1, 100):
        got = exact_quantiles(df, "v", probs, buckets=2, cell_rows=cell_rows).first()["quantiles"]
        assert got[:10] == values[:10] and np.isnan(got[10])
    assert exact_quantiles(df.where("v IS NULL"), "v", [0.5]).collect() == []
    stats = grouped_stats(df.where("v IS NULL"), [], [F.count("*").alias("n")], {"q": ("v", 0.5), "r": ("v", 0.9)})
    assert [tuple(r) for r in stats.collect()] == [(1, None, None)]


@pytest.mark.parametrize("buckets", [2, 64])
def test_average_ranks(frame, buckets):
    pdf, df = frame
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    got = {r["v"]: r["rank"] for r in average_ranks(counts, "v", buckets=buckets).collect()}
    values = pdf["v"].dropna().astype(float)
    want = dict(zip(values, values.rank()))
    assert got == want


def test_left_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("c", 4)], "k string, i int")
    right = spark.createDataFrame([("a", 10.0), (None, 30.0), ("z", 0.0)], "k string, v double")
    want = {1: 10.0, 2: 10.0, 3: 30.0, 4: None}
    assert {r["i"]: r["v"] for r in left_join(left, right, ["k"]).collect()} == want
