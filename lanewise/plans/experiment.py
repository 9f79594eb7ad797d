"""One parametrised run: target transform x feature set x estimator x split."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions.columns import calendar_columns, route, with_targets
from lanewise.operators.extratrees import ExtraTrees
from lanewise.operators.forest import Forest
from lanewise.operators.history import expanding_history, frozen_history
from lanewise.operators.metrics import fold_statistics, generalization_gap, prediction_summary, regression_metrics
from lanewise.operators.quality import (
    check_submission,
    duplicates,
    enforce,
    guard_report,
    prediction_report,
    repair_weight,
)
from lanewise.operators.quality import ContractError
from lanewise.operators.splits import require_both_sides, train_rows, validation_rows
from lanewise.schema import (
    CALENDAR,
    CATEGORICAL,
    DATE,
    HISTORY,
    ID,
    LOG_RPM,
    NUMERIC,
    PREDICTIONS,
    RPM,
    SEED,
    TARGET,
    Fold,
    Split,
)
from lanewise.session import write_table
from lanewise.sources.writers import append_runs, write_fold_predictions, write_submission


@dataclass(frozen=True)
class Spec:
    """Everything that distinguishes one run from another; the run log is written from it."""

    name: str
    target: str = LOG_RPM
    estimator: str = "forest"
    min_leaf: int = 5
    trees: int = 100
    max_depth: int | None = None
    repair: bool = True
    history: bool = False
    calendar: bool = False
    route: bool = False
    seed: int = SEED

    @property
    def numeric(self) -> list[str]:
        return NUMERIC + (HISTORY if self.history else []) + (CALENDAR if self.calendar else [])

    @property
    def categorical(self) -> list[str]:
        return CATEGORICAL + (["route"] if self.route else [])

    def model(self):
        kind = {"forest": Forest, "extra_trees": ExtraTrees}[self.estimator]
        return kind(
            self.numeric,
            self.categorical,
            self.target,
            trees=self.trees,
            min_leaf=self.min_leaf,
            max_depth=self.max_depth,
            seed=self.seed,
        )

    @property
    def prediction_width(self) -> int:
        return {TARGET: 3, RPM: 5, LOG_RPM: 7}[self.target]


EXTRA = dict(estimator="extra_trees")

# The published sequence of runs, each a small change to an earlier one.
RUNS = [
    Spec("raw_target_forest", target=TARGET, min_leaf=1, repair=False),
    Spec("repaired_weight_forest", target=TARGET, min_leaf=1),
    Spec("leaf_5_forest", target=TARGET),
    Spec("rate_per_mile_forest", target=RPM),
    Spec("log_rate_per_mile_forest"),
    Spec("history_forest", target=RPM, history=True),
    Spec("calendar_forest", target=RPM, calendar=True),
    Spec("route_forest", route=True),
    Spec("leaf_5_extra_trees", min_leaf=5, **EXTRA),
    Spec("leaf_10_extra_trees", min_leaf=10, **EXTRA),
    Spec("leaf_20_extra_trees", min_leaf=20, **EXTRA),
]
SELECTED = RUNS[-1]


def prepare(loads: DataFrame, spec: Spec, split: Split) -> DataFrame:
    """Repair, targets and row-local features."""
    df = with_targets(repair_weight(loads) if spec.repair else loads)
    if spec.calendar:
        df = df.withColumns(calendar_columns(split.origin))
    return df.withColumn("route", route()) if spec.route else df


def reconstruct(df: DataFrame, target: str) -> DataFrame:
    """Predicted rate, rate per mile and its log from a prediction on any target scale."""
    p, distance = F.col("prediction"), F.col("distance")
    if target == TARGET:
        rate, rpm = p, F.try_divide(p, distance)
        log = F.ln(rpm)
    elif target == RPM:
        rate, rpm, log = p * distance, p, F.ln(p)
    else:
        rate, rpm, log = F.exp(p) * distance, F.exp(p), p
    return df.withColumns(
        {"predicted_rate": rate, "predicted_rate_per_mile": rpm, "predicted_log_rate_per_mile": log}
    )


def prediction_rows(scored: DataFrame, *tags: str) -> DataFrame:
    actual = {"actual_rate": TARGET, "actual_rate_per_mile": RPM, "actual_log_rate_per_mile": LOG_RPM}
    return scored.withColumns({a: F.col(b) for a, b in actual.items()}).select(*tags, *PREDICTIONS.names)


METRICS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("mae", "rmse", "r2")])
RUN_LOG = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("estimator", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("trees", T.IntegerType()),
        T.StructField("min_leaf", T.IntegerType()),
        T.StructField("max_depth", T.IntegerType()),
        T.StructField("weights_repaired", T.BooleanType()),
        T.StructField("numeric", T.ArrayType(T.StringType())),
        T.StructField("categorical", T.ArrayType(T.StringType())),
        T.StructField("train_end", T.DateType()),
        T.StructField("valid_end", T.DateType()),
        T.StructField("train_rows", T.LongType()),
        T.StructField("validation_rows", T.LongType()),
        T.StructField("negative_weights", T.LongType()),
        T.StructField("fit_seconds", T.DoubleType()),
        T.StructField("train", METRICS),
        T.StructField("validation", METRICS),
        T.StructField("gap", METRICS),
    ]
)


@dataclass
class Run:
    spec: Spec
    model: object
    predictions: DataFrame  # split + the seven prediction columns
    record: DataFrame  # one row of RUN_LOG


def run_holdout(spec: Spec, loads: DataFrame, split: Split, log_path: str | None = None) -> Run:
    """Fit before ``split.train_end``, score both sides, log the run; ``log_path`` is the log to append to."""
    spark = loads.sparkSession
    enforce(guard_report(loads), spec.name)
    rows = require_both_sides(loads, split)
    ready = prepare(loads, spec, split)
    train, later = train_rows(ready, split), validation_rows(ready, split)
    if spec.history:
        train, later = (
            write_table(expanding_history(train), "train-history"),
            write_table(frozen_history(train, later), "validation-history"),
        )
    start = time.perf_counter()
    model = spec.model().fit(train)
    seconds = time.perf_counter() - start
    both = train.withColumn("split", F.lit("train")).unionByName(later.withColumn("split", F.lit("validation")))
    scored = write_table(prediction_rows(reconstruct(model.transform(both), spec.target), "split"), spec.name)
    gap = generalization_gap(regression_metrics(scored, ["split"])).first().asDict()
    negative = loads.where((F.col("weight") < 0) & (F.col(DATE) < F.lit(split.valid_end))).count()
    record = spark.createDataFrame(
        [
            (
                spec.name,
                spec.target,
                spec.estimator,
                spec.seed,
                spec.trees,
                spec.min_leaf,
                spec.max_depth,
                spec.repair,
                spec.numeric,
                spec.categorical,
                split.train_end,
                split.valid_end,
                rows["train"]["rows"],
                rows["validation"]["rows"],
                negative,
                seconds,
                tuple(gap[f"train_{m}"] for m in METRICS.names),
                tuple(gap[f"validation_{m}"] for m in METRICS.names),
                tuple(gap[f"{m}_gap"] for m in METRICS.names),
            )
        ],
        RUN_LOG,
    )
    if log_path:
        append_runs(record, log_path)
    return Run(spec, model, scored, record)


def run_log(runs: Sequence[Run]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.record for r in runs])


def leaderboard(log: DataFrame) -> DataFrame:
    """Runs by validation error."""
    return log.select(
        "run",
        "target",
        "estimator",
        "min_leaf",
        *[F.col(f"validation.{m}").alias(f"validation_{m}") for m in METRICS.names],
        F.col("train.mae").alias("train_mae"),
        F.col("gap.mae").alias("mae_gap"),
        "fit_seconds",
    ).orderBy("validation_mae", "run")


@dataclass
class CrossValidation:
    predictions: DataFrame  # fold, role + the seven prediction columns
    fold_metrics: DataFrame
    summary: DataFrame
    total_seconds: float  # fits and scoring of all folds


def run_folds(spec: Spec, loads: DataFrame, folds: Sequence[Fold], folder: str | None = None) -> CrossValidation:
    """Expanding-window validation: one distributed fit per fold, one aggregate for all metrics.

    With ``folder``, the fold results and the pooled validation predictions are written there.
    """
    began = time.perf_counter()
    spark = loads.sparkSession
    enforce(guard_report(loads), spec.name)
    parts, times = [], []
    for fold in folds:
        window = Split(fold.valid_start, fold.valid_end, fold.train_start)
        ready = prepare(loads, spec, window)
        day = F.col(DATE)
        train = ready.where((day >= F.lit(fold.train_start)) & (day < F.lit(fold.train_end)))
        later = ready.where((day >= F.lit(fold.valid_start)) & (day < F.lit(fold.valid_end)))
        if train.isEmpty() or later.isEmpty():
            raise ContractError(f"{fold.name} has an empty window")
        if spec.history:
            train, later = (
                write_table(expanding_history(train), "train-history"),
                write_table(frozen_history(train, later), "validation-history"),
            )
        start = time.perf_counter()
        model = spec.model().fit(train)
        times.append((fold.name, fold.train_start, fold.train_end, fold.valid_start, fold.valid_end, time.perf_counter() - start))
        both = train.withColumn("role", F.lit("train")).unionByName(later.withColumn("role", F.lit("validation")))
        scored = reconstruct(model.transform(both), spec.target).withColumn("fold", F.lit(fold.name))
        parts.append(write_table(prediction_rows(scored, "fold", "role"), f"{spec.name}-{fold.name}"))
    predictions = reduce(DataFrame.unionByName, parts)
    windows = spark.createDataFrame(
        times,
        "fold string, train_start date, train_end date, validation_start date, validation_end date, fit_seconds double",
    )
    metrics = generalization_gap(regression_metrics(predictions, ["fold", "role"]), "role", ["fold"])
    metrics = write_table(F.broadcast(windows).join(metrics, "fold"), "fold-metrics")  # one row per fold
    seconds = time.perf_counter() - began
    if folder:
        write_fold_predictions(predictions.where("role = 'validation'").drop("role"), f"{folder}/predictions")
        metrics.write.mode("overwrite").parquet(f"{folder}/fold_results")
    return CrossValidation(predictions, metrics, fold_statistics(metrics), seconds)


@dataclass
class Final:
    model: object
    submission: DataFrame
    report: DataFrame
    record: DataFrame  # one row: what was fitted on, what was repaired, what was predicted


def run_final(spec: Spec, labelled: DataFrame, holdout: DataFrame, split: Split, folder: str | None = None) -> Final:
    """Refit on every labelled row, score the held-out rows, hold the result to the contract.

    With ``folder``, the model, the submission and the record are saved there.
    """
    if spec.history:
        labelled_ready = expanding_history(prepare(labelled, spec, split))
    else:
        labelled_ready = prepare(labelled, spec, split)
    enforce(guard_report(labelled), "labelled loads")
    for label, df in (("labelled", labelled), ("held-out", holdout)):
        if not duplicates(df).isEmpty():
            raise ContractError(f"{label} loads repeat a load id")
    if not holdout.where(F.col("distance") <= 0).isEmpty():
        raise ContractError("held-out loads have a distance that is not positive")
    start = time.perf_counter()
    model = spec.model().fit(labelled_ready)
    seconds = time.perf_counter() - start
    later = prepare(holdout.withColumn(TARGET, F.lit(None).cast("double")), spec, split)
    if spec.history:
        later = frozen_history(prepare(labelled, spec, split), later)
    submission = write_table(
        reconstruct(model.transform(later), spec.target).select(ID, "predicted_rate"), "submission"
    )
    enforce(prediction_report(submission), "submission")
    report = check_submission(submission, holdout)
    enforce(report, "submission")
    negative = F.count_if(F.col("weight") < 0)
    facts = {"run": spec.name, "fit_seconds": seconds}
    for side, df in (("labelled", labelled), ("holdout", holdout)):
        row = df.agg(F.count("*"), negative).first()
        facts |= {f"{side}_rows": row[0], f"{side}_weights_repaired": row[1]}
    facts |= {f"prediction_{k}": v for k, v in prediction_summary(submission).drop("rows").first().asDict().items()}
    record = submission.sparkSession.createDataFrame([facts])
    if folder:
        model.save(submission.sparkSession, f"{folder}/model")
        write_submission(submission, f"{folder}/submission")
        record.write.mode("overwrite").json(f"{folder}/record")
    return Final(model, submission, report, record)


def small(spec: Spec, trees: int = 3, max_depth: int = 8) -> Spec:
    """The same run with few, shallow trees."""
    return replace(spec, trees=trees, max_depth=max_depth)


def as_config(spec: Spec) -> dict:
    return asdict(spec) | {"numeric": spec.numeric, "categorical": spec.categorical}


def load_model(spark: SparkSession, spec: Spec, path: str):
    from lanewise.operators.extratrees import ExtraTreesModel
    from lanewise.operators.forest import ForestModel

    return {"forest": ForestModel, "extra_trees": ExtraTreesModel}[spec.estimator].load(spark, path)
