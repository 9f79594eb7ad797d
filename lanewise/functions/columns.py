"""Column functions: targets, calendar, route, errors, bins. All stay inside codegen."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.schema import CLOSE_ABS, CLOSE_REL, LOG_RPM, RPM, TARGET, Bins


def repaired_weight(weight: str = "weight") -> Column:
    """A negative weight is missing; a missing weight stays missing."""
    return F.when(F.col(weight) >= 0, F.col(weight))


def rate_per_mile(rate: str = TARGET, distance: str = "distance") -> Column:
    return F.try_divide(F.col(rate), F.col(distance))


def with_targets(df: DataFrame) -> DataFrame:
    """Rate per mile and its logarithm; the log is NULL where the rate is not positive."""
    return df.withColumn(RPM, rate_per_mile()).withColumn(LOG_RPM, F.ln(RPM))


def calendar_columns(origin: date, day: str = "date") -> dict[str, Column]:
    d = F.col(day)
    return {
        "month": F.month(d),
        "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "day_of_year": F.dayofyear(d),
        "days_since_start": F.datediff(d, F.lit(origin)),
    }


def route(pickup: str = "pickup", delivery: str = "delivery") -> Column:
    """``pickup -> delivery``; a missing end is spelt out instead of nulling the whole route."""
    return F.concat(
        F.coalesce(F.col(pickup), F.lit("nan")), F.lit(" -> "), F.coalesce(F.col(delivery), F.lit("nan"))
    )


def error_columns(actual: str = "actual_rate", predicted: str = "predicted_rate") -> dict[str, Column]:
    """Signed (predicted - actual), absolute, squared and absolute percentage error."""
    error = F.col(predicted) - F.col(actual)
    return {
        "error": error,
        "absolute_error": F.abs(error),
        "squared_error": error * error,
        "absolute_percentage_error": F.try_divide(F.abs(error), F.abs(F.col(actual))) * 100,
    }


def residual_columns() -> dict[str, Column]:
    """Residuals run the other way round: actual - predicted."""
    return {
        "rpm_residual": F.col("actual_rate_per_mile") - F.col("predicted_rate_per_mile"),
        "absolute_rate_error": F.abs(F.col("actual_rate") - F.col("predicted_rate")),
    }


def is_close(column: Column, constant: float) -> Column:
    return F.abs(column - F.lit(constant)) <= F.lit(CLOSE_ABS + CLOSE_REL * abs(constant))


def not_finite(column: Column) -> Column:
    return F.isnan(column) | (F.abs(column) == F.lit(float("inf")))


def bin_number(bins: Bins) -> Column:
    """0-based right-closed bin, NULL when the value is missing or outside all bins."""
    x = F.col(bins.column)
    lows, highs = bins.edges[:-1], bins.edges[1:]
    out = F.lit(None).cast("int")
    for i in reversed(range(len(lows))):
        inside = x > F.lit(float(lows[i]))
        if highs[i] != float("inf"):
            inside = inside & (x <= F.lit(float(highs[i])))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def quantile_bin(column: str, edges: list[float]) -> Column:
    """1-based bin between quantile edges: right-closed, lowest value included, equal edges merged."""
    inner = sorted({e for e in edges[1:-1] if e > edges[0]})
    x = F.col(column)
    above = [F.when(x > F.lit(e), 1).otherwise(0) for e in inner]
    total = F.lit(1)
    for step in above:
        total = total + step
    return F.when(x.isNotNull(), total)
