from datetime import date

import pytest
from pyspark.sql import functions as F

from lanewise.operators.history import expanding_history, frozen_history
from lanewise.plans import tables
from lanewise.schema import HISTORY, HISTORY_KEYS, RPM

SCHEMA = "load_id string, pickup string, delivery string, equipment string, date date, posted_rate_per_mile double"


def test_same_day_is_excluded(spark):
    rows = [
        ("1", "a", "x", "Van", date(2025, 1, 1), 1.0),
        ("2", "a", "x", "Van", date(2025, 1, 1), 3.0),
        ("3", "a", "x", "Van", date(2025, 1, 2), 9.0),
    ]
    got = {r["load_id"]: r for r in expanding_history(spark.createDataFrame(rows, SCHEMA)).collect()}
    for first in ("1", "2"):
        assert got[first]["hist_pickup_rpm_mean"] is None and got[first]["hist_pickup_rpm_count"] == 0
        assert got[first]["hist_global_rpm_mean"] is None
    assert got["3"]["hist_route_rpm_mean"] == 2.0 and got["3"]["hist_route_rpm_count"] == 2


def walk(rows):
    """Day-by-day restatement of the rule."""
    out, state = {}, {}
    for day in sorted({r["date"] for r in rows}):
        today = [r for r in rows if r["date"] == day]
        for r in today:
            for level, keys in HISTORY_KEYS.items():
                seen = state.get((level, *[r[k] for k in keys]), [])
                out[r["load_id"], level] = (sum(seen) / len(seen) if seen else None, len(seen))
        for r in today:
            for level, keys in HISTORY_KEYS.items():
                state.setdefault((level, *[r[k] for k in keys]), []).append(r[RPM])
    return out, state


def check(row, level, want):
    mean, count = want
    assert row[f"hist_{level}_rpm_mean"] == (None if mean is None else pytest.approx(mean))
    if level != "global":
        assert row[f"hist_{level}_rpm_count"] == count


def test_matches_the_day_by_day_rule(spark, sf):
    train, later = tables.train(spark, sf), tables.validation(spark, sf)
    want, state = walk(train.collect())
    for row in expanding_history(train).collect():
        for level in HISTORY_KEYS:
            check(row, level, want[row["load_id"], level])
    for row in frozen_history(train, later).collect():
        for level, keys in HISTORY_KEYS.items():
            seen = state.get((level, *[row[k] for k in keys]), [])
            check(row, level, (sum(seen) / len(seen) if seen else None, len(seen)))


def test_a_rate_never_reaches_its_own_day_or_earlier(spark, sf):
    train = tables.train(spark, sf)
    day = train.agg(F.percentile(F.unix_date("date"), F.lit(0.5)).cast("int")).first()[0]
    changed = train.withColumn(RPM, F.when(F.unix_date("date") == day, F.lit(1e6)).otherwise(F.col(RPM)))

    def early(df):
        rows = expanding_history(df).where(F.unix_date("date") <= day).select("load_id", *HISTORY).collect()
        return {r["load_id"]: tuple(None if v is None else round(v, 9) for v in r[1:]) for r in rows}

    assert early(train) == early(changed)


def test_frozen_history_ignores_later_targets(spark, sf):
    train, later = tables.train(spark, sf), tables.validation(spark, sf)
    rows = [
        sorted(frozen_history(train, df).select("load_id", *HISTORY).collect())
        for df in (later, later.withColumn(RPM, F.lit(-1.0)))
    ]
    assert rows[0] == rows[1]
