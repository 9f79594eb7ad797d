"""Repairs, guards and contract checks. Each check is one aggregate that yields a rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions.columns import is_close, not_finite, rate_per_mile, repaired_weight

from lanewise.schema import DATE, ID, SCENARIO_COLUMNS, SUBMISSION_COLUMNS, TARGET, Scenario


class ContractError(ValueError):
    """A guard or contract rule does not hold."""


def _count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def repair_weight(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", repaired_weight())


def repair_counts(df: DataFrame) -> DataFrame:
    """Row, missing and negative weights before and after the repair, in one pass."""
    fixed = repaired_weight()
    return df.agg(
        F.count("*").alias("rows"),
        _count_if(F.col("weight") < 0).alias("negative_before"),
        _count_if(fixed < 0).alias("negative_after"),
        _count_if(F.col("weight").isNull()).alias("missing_before"),
        _count_if(fixed.isNull()).alias("missing_after"),
    )


def rules_table(row: DataFrame, order: list[str]) -> DataFrame:
    """One row of counters -> (position, rule, violations, passed)."""
    entries = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(r).alias("rule"),
            F.coalesce(F.col(r).cast("long"), F.lit(0).cast("long")).alias("violations"),
        )
        for i, r in enumerate(order)
    ]
    return row.select(F.inline(F.array(*entries))).withColumn("passed", F.col("violations") == 0)


def enforce(report: DataFrame, label: str) -> None:
    """Raise on the first broken rule, in rule order."""
    broken = report.where(~F.col("passed")).orderBy("position").first()
    if broken is not None:
        raise ContractError(f"{label}: {broken['rule']} ({broken['violations']} violations)")


def guard_report(df: DataFrame) -> DataFrame:
    """Distance and rate-per-mile guards plus the missing keys, on labelled loads."""
    return rules_table(
        df.agg(
            _count_if(F.col("distance") <= 0).alias("distance_not_positive"),
            _count_if(F.col("distance").isNull()).alias("distance_missing"),
            _count_if(rate_per_mile() <= 0).alias("rate_per_mile_not_positive"),
            _count_if(F.col(TARGET).isNull()).alias("target_missing"),
            _count_if(F.col(ID).isNull()).alias("id_missing"),
            _count_if(F.col(DATE).isNull()).alias("date_missing"),
        ),
        [
            "distance_not_positive",
            "distance_missing",
            "rate_per_mile_not_positive",
            "target_missing",
            "id_missing",
            "date_missing",
        ],
    )


def run_counters(df: DataFrame) -> DataFrame:
    """Rows, date range and violation counters of one input, in one pass."""
    return df.agg(
        F.count("*").alias("rows"),
        F.min(DATE).alias("first_day"),
        F.max(DATE).alias("last_day"),
        _count_if(F.col("weight") < 0).alias("negative_weights"),
        _count_if(F.col("distance") <= 0).alias("bad_distances"),
        _count_if(rate_per_mile() <= 0).alias("bad_rates_per_mile"),
    )


def duplicates(df: DataFrame, key: str = ID) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values per column: one aggregate, then one row per column."""
    counted = df.agg(F.count("*").alias("rows"), *[_count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in df.columns]
    return counted.select("rows", F.inline(F.array(*entries))).withColumn(
        "missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("rows"))
    )


def prediction_report(df: DataFrame, column: str = "predicted_rate") -> DataFrame:
    x = F.col(column)
    return rules_table(
        df.agg(
            _count_if(x.isNull()).alias("missing"),
            _count_if(not_finite(x)).alias("not_finite"),
            _count_if(x <= 0).alias("not_positive"),
        ),
        ["missing", "not_finite", "not_positive"],
    )


def reconcile_ids(actual: DataFrame, expected: DataFrame, key: str = ID) -> DataFrame:
    """One row comparing two key sets: rows, missing keys, repeats, absences and surplus.

    One shuffle by key for every counter; an often repeated key is folded on the map side.
    """
    sides = actual.select(F.col(key).cast("string").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("e")).unionAll(
        expected.select(F.col(key).cast("string").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("e"))
    )
    keys = sides.groupBy("k").agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    known = F.col("k").isNotNull()
    return keys.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("actual_rows"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("a"))), F.lit(0)).alias("null_ids"),
        _count_if(known & (F.col("a") > 1)).alias("duplicate_ids"),
        _count_if(known & (F.col("e") > 1)).alias("duplicate_expected_ids"),
        _count_if(known & (F.col("a") == 0)).alias("missing_ids"),
        _count_if(known & (F.col("e") == 0)).alias("extra_ids"),
    )


def sequential_ids(spark, pattern: str, n: int) -> DataFrame:
    """Ids 1..n in a printf pattern, generated on the executors."""
    return spark.range(1, n + 1).select(F.format_string(pattern, "id").alias(ID))


SUBMISSION_RULES = [
    "columns_exact",
    "row_count",
    "id_missing",
    "id_duplicate",
    "id_not_delivered",
    "id_unexpected",
    "rate_not_numeric",
    "rate_not_finite",
    "rate_not_positive",
]


def check_submission(submission: DataFrame, expected_ids: DataFrame) -> DataFrame:
    """Contract of a delivered prediction file against the expected id set."""
    exact = submission.columns == SUBMISSION_COLUMNS
    if not set(SUBMISSION_COLUMNS) <= set(submission.columns):
        row = submission.sparkSession.range(1).select(F.lit(1).alias("columns_exact"))
        return rules_table(row, ["columns_exact"])
    rate = F.col("predicted_rate").cast("string").try_cast("double")
    ids = reconcile_ids(submission, expected_ids)
    rates = submission.agg(
        _count_if(rate.isNull()).alias("rate_not_numeric"),
        _count_if(not_finite(rate)).alias("rate_not_finite"),
        _count_if(rate <= 0).alias("rate_not_positive"),
    )
    row = ids.select(
        F.lit(int(not exact)).alias("columns_exact"),
        F.abs(F.col("actual_rows") - F.col("expected_rows")).alias("row_count"),
        F.col("null_ids").alias("id_missing"),
        F.col("duplicate_ids").alias("id_duplicate"),
        F.col("missing_ids").alias("id_not_delivered"),
        F.col("extra_ids").alias("id_unexpected"),
        *[rates.select(c).scalar().alias(c) for c in rates.columns],
    )
    return rules_table(row, SUBMISSION_RULES)


SCENARIO_RULES = [
    "columns_exact",
    "date_invalid",
    "distance_not_numeric",
    "weight_not_numeric",
    "rate_not_numeric",
    "date_duplicate",
    "day_missing",
    "day_unexpected",
    "row_count",
    "pickup_wrong",
    "delivery_wrong",
    "distance_wrong",
    "equipment_wrong",
    "weight_wrong",
    "rate_not_positive",
]


def check_scenario(df: DataFrame, scenario: Scenario) -> DataFrame:
    """Contract of a priced scenario: fixed inputs, each day of the window once, rates > 0."""
    if df.columns != SCENARIO_COLUMNS:
        row = df.sparkSession.range(1).select(F.lit(1).alias("columns_exact"))
        return rules_table(row, ["columns_exact"])

    def number(name: str) -> Column:
        return F.col(name).cast("string").try_cast("double")

    def bad(x: Column) -> Column:
        return x.isNull() | not_finite(x)

    day = F.col("date").cast("string").try_cast("date")
    first, last = F.lit(scenario.first_day), F.lit(scenario.last_day)
    days = (scenario.last_day - scenario.first_day).days + 1
    # Folded per day first, so the outer aggregate sees few rows.
    per_day = df.groupBy(day.alias("day")).agg(
        F.count("*").alias("n"),
        _count_if(bad(number("distance"))).alias("distance_not_numeric"),
        _count_if(bad(number("weight"))).alias("weight_not_numeric"),
        _count_if(bad(number("predicted_rate"))).alias("rate_not_numeric"),
        F.count_if(~F.col("pickup").eqNullSafe(F.lit(scenario.pickup))).alias("pickup_wrong"),
        F.count_if(~F.col("delivery").eqNullSafe(F.lit(scenario.delivery))).alias("delivery_wrong"),
        F.count_if(~F.coalesce(is_close(number("distance"), scenario.distance), F.lit(False))).alias(
            "distance_wrong"
        ),
        F.count_if(~F.col("equipment").eqNullSafe(F.lit(scenario.equipment))).alias("equipment_wrong"),
        F.count_if(~F.coalesce(is_close(number("weight"), scenario.weight), F.lit(False))).alias("weight_wrong"),
        _count_if(number("predicted_rate") <= 0).alias("rate_not_positive"),
    )
    inside = F.col("day").between(first, last)
    summed = [
        "distance_not_numeric",
        "weight_not_numeric",
        "rate_not_numeric",
        "pickup_wrong",
        "delivery_wrong",
        "distance_wrong",
        "equipment_wrong",
        "weight_wrong",
        "rate_not_positive",
    ]
    row = per_day.agg(
        F.lit(0).alias("columns_exact"),
        F.sum(F.when(F.col("day").isNull(), F.col("n"))).alias("date_invalid"),
        F.sum(F.when(F.col("day").isNotNull(), F.col("n") - 1)).alias("date_duplicate"),
        (F.lit(days) - _count_if(inside)).alias("day_missing"),
        _count_if(~inside).alias("day_unexpected"),
        F.abs(F.coalesce(F.sum("n"), F.lit(0)) - days).alias("row_count"),
        *[F.sum(c).alias(c) for c in summed],
    )
    return rules_table(row, SCENARIO_RULES)


def day_spine(spark, first, last) -> DataFrame:
    """Every day of [first, last]; as long as the calendar, not the data."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))


def check_days(df: DataFrame, first, last) -> DataFrame:
    """Calendar days against the days in the data, both ways: rows for each expected day, then
    the days that should not be there, loads without a date among them (a null day)."""
    per_day = df.groupBy(F.col(DATE).alias("found")).agg(F.count("*").alias("n"))
    spine = day_spine(df.sparkSession, first, last)
    both = spine.join(per_day, F.col("day") == F.col("found"), "full_outer")
    return both.select(
        F.coalesce("day", "found").alias("day"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.col("n").isNull().alias("absent"),
        F.col("day").isNull().alias("unexpected"),
    )
