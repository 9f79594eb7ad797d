from datetime import date

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from lanewise.operators.quality import ContractError
from lanewise.operators.splits import assign_folds, require_both_sides, train_rows, validation_rows
from lanewise.plans import tables
from lanewise.schema import CALENDAR_2025, FOLDS_2025, LOADS, PREDICTIONS
from lanewise.session import shared_folder, write_table
from lanewise.sources.readers import (
    SourceError,
    nan_to_null,
    read_delivery,
    read_holdout,
    read_loads,
    read_predictions,
    require_columns,
)
from lanewise.sources.writers import write_fold_predictions, write_predictions, write_reports, write_submission

HEADER = ",".join(LOADS.names)
LINE = "a,p,d,1,2,3,4,100,Van,,2025-01-31,,0.5,250"


def csv(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_loads(spark, tmp_path):
    row = read_loads(spark, csv(tmp_path / "l.csv", HEADER, LINE)).first()
    assert row["date"] == date(2025, 1, 31) and row["weight"] is None and row["posted_rate"] == 250.0


def test_permuted_header_fails(spark, tmp_path):
    names = LOADS.names[::-1]
    path = csv(tmp_path / "l.csv", ",".join(names), ",".join(LINE.split(",")[::-1]))
    with pytest.raises((PySparkException, Py4JJavaError), match="header"):
        read_loads(spark, path).collect()


def test_missing_target_file_and_bad_date(spark, tmp_path):
    held = csv(tmp_path / "h.csv", HEADER.rsplit(",", 1)[0], LINE.rsplit(",", 1)[0])
    with pytest.raises(SourceError, match="posted_rate"):
        read_loads(spark, held)
    assert read_holdout(spark, held).count() == 1
    with pytest.raises(SourceError, match="could not read"):
        read_loads(spark, str(tmp_path / "none.csv"))
    with pytest.raises(SourceError, match="could not read"):
        read_delivery(spark, str(tmp_path / "none.csv"), "submission")
    bad = csv(tmp_path / "b.csv", HEADER, LINE.replace("2025-01-31", "someday"))
    with pytest.raises((PySparkException, Py4JJavaError), match="someday"):
        read_loads(spark, bad).collect()


def test_required_columns_are_listed_sorted(spark):
    with pytest.raises(SourceError, match=r"\['date', 'weight'\]"):
        require_columns(spark.range(1), ["weight", "id", "date"], "x")


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, None)], "a double, b string")
    assert [tuple(r) for r in nan_to_null(df).collect()] == [(None, "x"), (1.0, None)]


@pytest.mark.parametrize("width", [3, 5, 7])
def test_prediction_files(spark, sf, tmp_path, width):
    df = tables.predictions(spark, sf)
    write_predictions(df, str(tmp_path / "p"), width)
    back = read_predictions(spark, str(tmp_path / "p"), width=width)
    assert back.columns == PREDICTIONS.names[:width] and back.count() == df.count()


def test_other_sinks(spark, sf, tmp_path):
    write_submission(tables.predictions(spark, sf), str(tmp_path / "s"))
    assert read_delivery(spark, str(tmp_path / "s"), "submission").columns == ["load_id", "predicted_rate"]
    write_fold_predictions(tables.fold_predictions(spark, sf), str(tmp_path / "f"))
    assert {p.name for p in (tmp_path / "f").iterdir() if p.is_dir()} == {"fold=fold_1", "fold=fold_2", "fold=fold_3"}
    write_reports({"one": spark.range(3)}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/one")).count() == 3


def test_written_table_is_a_plain_scan(spark):
    out = write_table(spark.range(5).selectExpr("id", "id * 2 as twice"), "t", ["id"])
    assert shared_folder(spark).removeprefix("file:") in out.inputFiles()[0]
    assert sorted(r["twice"] for r in out.collect()) == [0, 2, 4, 6, 8]


DAYS = [date(2025, 6, 30), date(2025, 7, 1), date(2025, 8, 15), date(2025, 9, 30), date(2025, 10, 1), date(2025, 10, 31), date(2025, 11, 1)]


def test_windows_are_half_open(spark):
    df = spark.createDataFrame([(d,) for d in DAYS], "date date")
    assert sorted(r["date"] for r in train_rows(df, CALENDAR_2025).collect()) == DAYS[:4]
    assert sorted(r["date"] for r in validation_rows(df, CALENDAR_2025).collect()) == DAYS[4:6]
    with pytest.raises(ContractError, match="validation window is empty"):
        require_both_sides(train_rows(df, CALENDAR_2025), CALENDAR_2025)


def test_folds_overlap_and_never_look_ahead(spark):
    df = spark.createDataFrame([(d,) for d in DAYS], "date date")
    rows = [(r["fold"], r["role"], r["date"]) for r in assign_folds(df, FOLDS_2025).collect()]
    assert len(rows) == len(set(rows))
    assert {f for f, role, d in rows if role == "validation" and d == date(2025, 8, 15)} == {"fold_1", "fold_2"}
    for fold in FOLDS_2025:
        train = [d for f, role, d in rows if f == fold.name and role == "train"]
        later = [d for f, role, d in rows if f == fold.name and role == "validation"]
        assert max(train) < min(later)
