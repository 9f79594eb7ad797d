"""Leak-free expanding history of the rate per mile, and its frozen form for later rows.

Loads are folded once to cells of (keys, day). Every level (route, pickup, ...) is derived and
looked up on the cells, so the loads themselves take part in a single join, however skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lanewise.functions.sizing import left_join, null_safe
from lanewise.schema import DATE, HISTORY, HISTORY_KEYS, RPM

LEVEL = ["__level", "__k1", "__k2"]


def _key_columns(levels: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(k for level in levels for k in HISTORY_KEYS[level]))


def _by_level(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per level, addressed by (level, first key, second key)."""
    entries = []
    for level in levels:
        keys = [F.col(k) for k in HISTORY_KEYS[level]] + [F.lit(None).cast("string")] * 2
        entries.append(F.struct(F.lit(level).alias(LEVEL[0]), keys[0].alias(LEVEL[1]), keys[1].alias(LEVEL[2])))
    return df.select("*", F.inline(F.array(*entries)))


def _feature_columns(levels: Sequence[str], total: Column, rows: Column) -> list[Column]:
    """History columns of each level; without history the mean is missing and the count is 0."""
    out = []
    for name in HISTORY:
        level = name.split("_")[1]
        if level in levels:
            here = F.col(LEVEL[0]) == level
            if name.endswith("_mean"):
                out.append(F.max(F.when(here, F.try_divide(total, rows))).alias(name))
            else:
                out.append(F.coalesce(F.max(F.when(here, rows)), F.lit(0)).cast("long").alias(name))
    return out


def _addressed(wanted: DataFrame, found: DataFrame, keys: list[str], levels: Sequence[str], on: list[str]) -> DataFrame:
    """Look every level of ``wanted`` up in ``found`` and fold back to one row per ``keys``."""
    left = _by_level(wanted.select(*keys), levels)
    right = found.select(*[F.col(c).alias(f"r_{c}") for c in on], "s", "n")
    joined = left.join(right, null_safe(left, right, {c: f"r_{c}" for c in on}), "left")
    return joined.groupBy(*keys).agg(*_feature_columns(levels, F.col("s"), F.col("n")))


def expanding_history(train: DataFrame, levels: Sequence[str] = tuple(HISTORY_KEYS)) -> DataFrame:
    """Adds the history of strictly earlier days; loads of one day never see each other.

    A window holds one row per day of one key, so its length is bounded by the calendar.
    """
    keys = [*_key_columns(levels), DATE]
    cells = train.groupBy(*keys).agg(F.sum(RPM).alias("s"), F.count(RPM).alias("n"))
    daily = _by_level(cells, levels).groupBy(*LEVEL, DATE).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    earlier = W.partitionBy(*LEVEL).orderBy(DATE).rowsBetween(W.unboundedPreceding, -1)
    prior = daily.select(*LEVEL, DATE, F.sum("s").over(earlier).alias("s"), F.sum("n").over(earlier).alias("n"))
    return left_join(train, _addressed(cells, prior, keys, levels, [*LEVEL, DATE]), keys)


def frozen_history(train: DataFrame, later: DataFrame, levels: Sequence[str] = tuple(HISTORY_KEYS)) -> DataFrame:
    """Adds the training totals to ``later``, whose own targets are never read."""
    keys = _key_columns(levels)
    cells = train.groupBy(*keys).agg(F.sum(RPM).alias("s"), F.count(RPM).alias("n"))
    totals = _by_level(cells, levels).groupBy(*LEVEL).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    wanted = later.select(*keys).distinct()
    return left_join(later, _addressed(wanted, totals, keys, levels, LEVEL), keys)


def history_coverage(df: DataFrame) -> DataFrame:
    """Share of rows with a history, per split and history mean."""
    means = [c for c in HISTORY if c.endswith("_mean") and c in df.columns]
    shares = df.groupBy("split").agg(*[(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(c) for c in means])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage_pct")) for c in means]
    return shares.select("split", F.inline(F.array(*entries)))
