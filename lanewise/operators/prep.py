"""Imputation and encoding, learnt on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.quantiles import exact_quantiles


def melt(df: DataFrame, columns: Sequence[str], dtype: str, keep: Sequence[str] = ()) -> DataFrame:
    """One (column_name, value) row per listed column."""
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast(dtype).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*entries)))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, median), exact and interpolated, one row per column that has values."""
    q = exact_quantiles(melt(df, columns, "double"), "value", [0.5], ["column_name"])
    return q.select("column_name", F.get("quantiles", F.lit(0)).alias("median"))


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mode): most frequent value, the smallest on ties, missing values ignored.

    Values are counted across the cluster before the winner is taken, so no task holds a
    column's vocabulary.
    """
    counts = (
        melt(df, columns, "string").where(F.col("value").isNotNull()).groupBy("column_name", "value").count()
    )
    best = F.min(F.struct((-F.col("count")).alias("c"), F.col("value").alias("v")))
    return counts.groupBy("column_name").agg(best.alias("b")).select("column_name", F.col("b.v").alias("mode"))


class Imputer:
    """Median for numbers, most frequent value for categories."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str]):
        self.numeric, self.categorical = list(numeric), list(categorical)

    def fit(self, train: DataFrame) -> "ImputerModel":
        fill: dict[str, float | str] = {}  # one value per column
        if self.numeric:
            fill |= {r["column_name"]: r["median"] for r in column_medians(train, self.numeric).collect()}
        if self.categorical:
            fill |= {r["column_name"]: r["mode"] for r in column_modes(train, self.categorical).collect()}
        return ImputerModel(self.numeric, self.categorical, fill)


class ImputerModel:
    def __init__(self, numeric: list[str], categorical: list[str], fill: dict):
        self.numeric, self.categorical, self.fill = numeric, categorical, fill

    def transform(self, df: DataFrame) -> DataFrame:
        """Fills the feature columns; integer features become doubles, other columns stay."""
        return df.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(self.fill.get(c)).cast("double")) for c in self.numeric}
            | {c: F.coalesce(F.col(c), F.lit(self.fill.get(c)).cast("string")) for c in self.categorical}
        )


def code(column: str) -> str:
    return f"{column}_code"


def slots(column: str) -> str:
    return f"{column}_slots"


def indexer(categorical: Sequence[str]) -> StringIndexer:
    """Alphabetical codes learnt on train; an unknown value gets the code after the last."""
    return StringIndexer(
        inputCols=list(categorical),
        outputCols=[code(c) for c in categorical],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )


def encoder(categorical: Sequence[str]) -> OneHotEncoder:
    """Sparse one-hot; dropping the last slot turns the unknown code into all zeros."""
    return OneHotEncoder(
        inputCols=[code(c) for c in categorical],
        outputCols=[slots(c) for c in categorical],
        dropLast=True,
    )


def assembler(numeric: Sequence[str], categorical: Sequence[str]) -> VectorAssembler:
    """Numeric block first, then the one-hot blocks; anything else is dropped."""
    return VectorAssembler(inputCols=[*numeric, *[slots(c) for c in categorical]], outputCol="features")


def encoding(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[indexer(categorical), encoder(categorical), assembler(numeric, categorical)])


def category_codes(model: PipelineModel, train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(column_name, category, code) as the fitted indexer assigns them to the training values."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("category"), F.col(code(c)).cast("int").alias("code"))
        for c in categorical
    ]
    coded = model.stages[0].transform(train)
    return coded.select(F.inline(F.array(*entries))).where(F.col("category").isNotNull()).distinct()


def save_fill(spark: SparkSession, imputer: ImputerModel, path: str) -> None:
    """Imputation values as a small table: (kind, position, column_name, number, text)."""
    rows = [("numeric", i, c, imputer.fill.get(c), None) for i, c in enumerate(imputer.numeric)]
    rows += [("categorical", i, c, None, imputer.fill.get(c)) for i, c in enumerate(imputer.categorical)]
    schema = "kind string, position int, column_name string, number double, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/imputer")


def load_fill(spark: SparkSession, path: str) -> ImputerModel:
    rows = sorted(spark.read.parquet(f"{path}/imputer").collect(), key=lambda r: r["position"])
    numeric = [r["column_name"] for r in rows if r["kind"] == "numeric"]
    categorical = [r["column_name"] for r in rows if r["kind"] == "categorical"]
    fill = {r["column_name"]: r["number"] if r["kind"] == "numeric" else r["text"] for r in rows}
    return ImputerModel(numeric, categorical, fill)
