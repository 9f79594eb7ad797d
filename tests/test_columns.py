from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.functions.columns import (
    bin_number,
    calendar_columns,
    error_columns,
    is_close,
    quantile_bin,
    repaired_weight,
    route,
    with_targets,
)
from lanewise.operators.analysis import annotate, error_by_bin, quantile_edges, residuals_by_quantile
from lanewise.operators.metrics import generalization_gap, regression_metrics
from lanewise.operators.prep import Imputer, category_codes, column_medians, column_modes, encoding
from lanewise.schema import DISTANCE_BINS


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (250.0,), (250.1,), (None,)], "distance double")
    got = {r["distance"]: r["b"] for r in df.select("distance", bin_number(DISTANCE_BINS).alias("b")).collect()}
    assert got == {0.0: None, 250.0: 0, 250.1: 1, None: None}


def scored(spark, rows):
    df = spark.createDataFrame(
        rows, "load_id string, pickup string, delivery string, distance double, actual_rate double, predicted_rate double"
    )
    rpm = {"actual_rate_per_mile": F.col("actual_rate") / 100, "predicted_rate_per_mile": F.col("predicted_rate") / 100}
    return annotate(df.withColumns(rpm))


def test_empty_and_missing_bins(spark):
    df = scored(spark, [("a", "x", "y", 250.0, 10.0, 12.0), ("b", "x", "y", 250.1, 10.0, 11.0), ("c", "x", "y", None, 5.0, 5.0)])
    got = {r["bin"]: (r["label"], r["rows"], r["mae"]) for r in error_by_bin(df, DISTANCE_BINS).collect()}
    assert len(got) == 8
    assert got[0] == ("<=250", 1, 2.0) and got[1] == ("251-500", 1, 1.0)
    assert got[6] == (">2000", 0, None)
    assert got[None] == (None, 1, 0.0)
    assert sum(v[1] for v in got.values()) == 3


def test_no_missing_bin_without_missing_values(spark):
    df = scored(spark, [("a", "x", "y", 10.0, 10.0, 12.0)])
    assert error_by_bin(df, DISTANCE_BINS).count() == 7


@pytest.mark.parametrize(
    "values,sizes",
    [
        ([1, 1, 1, 1, 2, 3, 4, 5, None], [5, 1, 2]),
        ([7, 7, 7], [3]),
        ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [2, 2, 2, 2, 2]),
        ([0, 0, 0, 0, 0, 0, 0, 0, 0, 1], [10]),
        ([0, 0, 0, 0, 0, 0, 1, 2, 2, 2], [6, 4]),
    ],
)
def test_quantile_bins_merge_equal_edges(spark, values, sizes):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    edges = quantile_edges(df, "x")
    got = df.select(quantile_bin("x", edges).alias("b")).groupBy("b").count().collect()
    found = {r["b"]: r["count"] for r in got}
    assert found.pop(None, 0) == values.count(None)
    if len(set(edges)) > 1:
        cut = pd.qcut(pd.Series(values, dtype=float), 5, duplicates="drop", labels=False)
        assert list(cut.dropna().value_counts().sort_index()) == sizes
    assert [found[k] for k in sorted(found)] == sizes


def test_quantile_profile_of_an_empty_column(spark):
    df = scored(spark, [("a", "x", "y", None, 10.0, 12.0)])
    assert residuals_by_quantile(df, "distance").count() == 0


def test_determination_is_not_squared_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.5)], "actual_rate double, predicted_rate double")
    row = regression_metrics(df).first()
    assert row["mae"] == pytest.approx(0.7 / 3)
    assert row["rmse"] == pytest.approx(0.3)
    assert row["r2"] == pytest.approx(0.865)


def test_gap_signs(spark):
    rows = [("train", 10, 1.0, 2.0, 0.9), ("validation", 5, 3.0, 5.0, 0.6)]
    df = spark.createDataFrame(rows, "split string, rows long, mae double, rmse double, r2 double")
    gap = generalization_gap(df).first()
    assert (gap["mae_gap"], gap["rmse_gap"]) == (2.0, 3.0)
    assert gap["r2_gap"] == pytest.approx(0.3)


def test_scalar_columns(spark):
    df = spark.createDataFrame(
        [("Rome", None, -5.0, 100.0, 0.0, date(2025, 1, 6)), ("Rome", "Oslo", None, 100.0, 50.0, date(2025, 12, 31))],
        "pickup string, delivery string, weight double, posted_rate double, distance double, date date",
    )
    out = with_targets(df).withColumns(calendar_columns(date(2025, 1, 1))).select(
        "*", route().alias("route"), repaired_weight().alias("w")
    )
    a, b = sorted(out.collect(), key=lambda r: r["date"])
    assert a["posted_rate_per_mile"] is None and a["log_posted_rate_per_mile"] is None
    assert b["posted_rate_per_mile"] == 2.0
    assert (a["route"], b["route"]) == ("Rome -> nan", "Rome -> Oslo")
    assert a["w"] is None and b["w"] is None
    assert (a["month"], a["day_of_week"], a["day_of_month"], a["day_of_year"], a["days_since_start"]) == (1, 0, 6, 6, 5)
    assert (b["day_of_week"], b["day_of_year"], b["days_since_start"]) == (2, 365, 364)


def test_error_columns_and_closeness(spark):
    df = spark.createDataFrame([(-4.0, 2.0)], "actual_rate double, predicted_rate double")
    row = df.select(*[c.alias(n) for n, c in error_columns().items()]).first()
    assert tuple(row) == (6.0, 6.0, 36.0, 150.0)
    near = spark.createDataFrame([(360.0036,), (360.0037,)], "x double").select(is_close(F.col("x"), 360.0).alias("c"))
    assert [r["c"] for r in near.collect()] == [True, False]


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), (None,)], "c string")
    assert column_modes(df, ["c"]).first()["mode"] == "a"


def test_median_is_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert column_medians(df, ["x"]).first()["median"] == 2.5


def test_unknown_category_is_all_zeros(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "c string, x double")
    later = spark.createDataFrame([("zzz", None), (None, 5.0)], "c string, x double")
    imputer = Imputer(["x"], ["c"]).fit(train)
    model = encoding(["x"], ["c"]).fit(imputer.transform(train))
    rows = model.transform(imputer.transform(later)).collect()
    vectors = {tuple(r["features"].toArray()) for r in rows}
    assert vectors == {(2.0, 0.0, 0.0, 0.0), (5.0, 1.0, 0.0, 0.0)}
    codes = {(r["category"], r["code"]) for r in category_codes(model, imputer.transform(train), ["c"]).collect()}
    assert codes == {("a", 0), ("b", 1), ("c", 2)}
