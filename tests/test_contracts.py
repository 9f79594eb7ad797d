from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lanewise.operators.analysis import join_predictions
from lanewise.operators.quality import (
    ContractError,
    check_scenario,
    check_submission,
    duplicates,
    enforce,
    guard_report,
    missing_profile,
    repair_counts,
    sequential_ids,
)
from lanewise.schema import LOADS, SCENARIO_2025, SUBMISSION_IDS_2025

IDS = ["TE-000001", "TE-000002", "TE-000003"]
GOOD = [(i, "100.5") for i in IDS]


def broken(report):
    return {r["rule"]: r["violations"] for r in report.where("not passed").collect()}


def submission(spark, rows, columns=("load_id", "predicted_rate")):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


@pytest.mark.parametrize(
    "rows,want",
    [
        (GOOD, {}),
        ([*GOOD[:2], (None, "1")], {"id_missing": 1, "id_not_delivered": 1}),
        ([*GOOD[:2], GOOD[1]], {"id_duplicate": 1, "id_not_delivered": 1}),
        ([*GOOD, GOOD[0]], {"row_count": 1, "id_duplicate": 1}),
        (GOOD[:2], {"row_count": 1, "id_not_delivered": 1}),
        ([*GOOD[:2], ("TE-000009", "1")], {"id_not_delivered": 1, "id_unexpected": 1}),
        ([*GOOD[:2], (IDS[2], "text")], {"rate_not_numeric": 1}),
        ([*GOOD[:2], (IDS[2], None)], {"rate_not_numeric": 1}),
        ([*GOOD[:2], (IDS[2], "inf")], {"rate_not_finite": 1}),
        ([*GOOD[:2], (IDS[2], "-inf")], {"rate_not_finite": 1, "rate_not_positive": 1}),
        ([*GOOD[:2], (IDS[2], "nan")], {"rate_not_finite": 1}),
        ([*GOOD[:2], (IDS[2], "0")], {"rate_not_positive": 1}),
    ],
)
def test_submission_rules(spark, rows, want):
    expected = sequential_ids(spark, SUBMISSION_IDS_2025[0], 3)
    assert broken(check_submission(submission(spark, rows), expected)) == want


def test_submission_columns(spark):
    expected = sequential_ids(spark, "TE-%06d", 3)
    swapped = submission(spark, [(b, a) for a, b in GOOD], ("predicted_rate", "load_id"))
    assert broken(check_submission(swapped, expected)) == {"columns_exact": 1}
    other = submission(spark, GOOD, ("id", "predicted_rate"))
    report = check_submission(other, expected)
    assert broken(report) == {"columns_exact": 1}
    with pytest.raises(ContractError, match="columns_exact"):
        enforce(report, "submission")


def scenario_rows():
    s = SCENARIO_2025
    return [
        [s.pickup, s.delivery, "360", s.equipment, "32000", str(s.first_day + timedelta(days=i)), "803.9"] for i in range(31)
    ]


def change(column, value):
    rows = scenario_rows()
    rows[4][column] = value
    return rows


@pytest.mark.parametrize(
    "rows,want",
    [
        (scenario_rows(), {}),
        (change(2, "360.003"), {}),
        (change(5, "soon"), {"date_invalid": 1, "day_missing": 1}),
        (change(5, "2025-12-01"), {"date_duplicate": 1, "day_missing": 1}),
        (scenario_rows()[:30], {"day_missing": 1, "row_count": 1}),
        (change(5, "2026-01-01"), {"day_missing": 1, "day_unexpected": 1}),
        (change(0, "Paris"), {"pickup_wrong": 1}),
        (change(1, None), {"delivery_wrong": 1}),
        (change(2, "361"), {"distance_wrong": 1}),
        (change(3, "Reefer"), {"equipment_wrong": 1}),
        (change(4, "heavy"), {"weight_not_numeric": 1, "weight_wrong": 1}),
        (change(6, "inf"), {"rate_not_numeric": 1}),
        (change(6, "-1"), {"rate_not_positive": 1}),
    ],
)
def test_scenario_rules(spark, rows, want):
    df = spark.createDataFrame(
        rows,
        "pickup string, delivery string, distance string, equipment string, weight string, date string, predicted_rate string",
    )
    assert broken(check_scenario(df, SCENARIO_2025)) == want
    assert broken(check_scenario(df.withColumnRenamed("weight", "mass"), SCENARIO_2025)) == {"columns_exact": 1}


def loads(spark, **values):
    base = dict(
        load_id="a", pickup="p", delivery="d", pickup_lat=1.0, pickup_lon=1.0, delivery_lat=1.0, delivery_lon=1.0,
        distance=10.0, equipment="Van", weight=5.0, date=date(2025, 1, 1), market_index=1.0, quote_signal=1.0, posted_rate=9.0,
    )
    return spark.createDataFrame([tuple((base | values)[c] for c in LOADS.names)], LOADS)


@pytest.mark.parametrize(
    "values,want",
    [
        ({}, {}),
        ({"distance": 0.0}, {"distance_not_positive": 1}),
        ({"distance": None}, {"distance_missing": 1}),
        ({"posted_rate": -1.0}, {"rate_per_mile_not_positive": 1}),
        ({"posted_rate": None}, {"target_missing": 1}),
        ({"load_id": None}, {"id_missing": 1}),
        ({"date": None}, {"date_missing": 1}),
    ],
)
def test_guards(spark, values, want):
    report = guard_report(loads(spark, **values))
    assert broken(report) == want
    if want:
        with pytest.raises(ContractError, match=next(iter(want))):
            enforce(report, "loads")


def test_counts_and_profile(spark):
    df = loads(spark, weight=-5.0).unionByName(loads(spark, weight=None))
    row = repair_counts(df).first()
    assert (row["negative_before"], row["negative_after"], row["missing_before"], row["missing_after"]) == (1, 0, 1, 2)
    missing = {r["column_name"]: r["missing"] for r in missing_profile(df).collect()}
    assert missing["weight"] == 1 and sum(missing.values()) == 1
    assert duplicates(df).first()["copies"] == 2


def test_join_must_be_one_to_one(spark):
    left = loads(spark).unionByName(loads(spark, load_id="b"))
    ids = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("z", 3.0)], "load_id string, predicted_rate double")
    assert join_predictions(left, ids).count() == 2
    for bad, counter in (
        (ids.where("load_id != 'b'"), "missing_ids=1"),
        (ids.unionByName(ids.where("load_id = 'a'")), "duplicate_ids=1"),
    ):
        with pytest.raises(ContractError, match=counter):
            join_predictions(left, bad)
    with pytest.raises(ContractError, match="duplicate_expected_ids=1"):
        join_predictions(left.unionByName(loads(spark)), ids.where(F.lit(True)))
