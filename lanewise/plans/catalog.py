"""Every named query: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions.columns import calendar_columns, error_columns, residual_columns, route
from lanewise.operators import analysis, history, metrics, quality, splits
from lanewise.operators.grouped_mean import GroupedMean
from lanewise.operators.prep import Imputer, category_codes, column_medians, column_modes, encoding, melt
from lanewise.operators.scenario import scenario_inputs, scenario_rates
from lanewise.plans import run_store, tables
from lanewise.plans.experiment import (
    RUNS,
    SELECTED,
    leaderboard,
    load_model,
    run_final,
    run_folds,
    run_holdout,
)
from lanewise.schema import (
    CALENDAR,
    CATEGORICAL,
    DATE,
    DISTANCE_BINS,
    HISTORY,
    ID,
    LOG_RPM,
    NUMERIC,
    RATE_BINS,
    RPM,
    STAR_FOLDS,
    STAR_HOLDOUT_START,
    STAR_SPLIT,
    TARGET,
    WEIGHT_BINS,
    Scenario,
)
from lanewise.session import shared_folder
from lanewise.sources.readers import read_delivery, read_holdout, read_loads, read_predictions
from lanewise.sources.star import table
from lanewise.sources.writers import write_predictions, write_reports

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
BY_NAME = {s.name: s for s in RUNS}

STAR_SCENARIO = Scenario("CANADA", "BRAZIL", 360.0, "Dry Van", 32000.0, date(2001, 12, 1), date(2001, 12, 31))


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = (), **special: int) -> DataFrame:
    """Round computed doubles; ``exact`` columns are copied or follow from one IEEE operation."""
    return df.select(
        *[
            F.round(f.name, special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in exact
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def single_precision(df: DataFrame) -> DataFrame:
    """Means of short decimals often end in an exact decimal half, so they are cut in binary."""
    return df.select(
        *[
            F.col(f.name).cast("float").cast("double").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def money(df: DataFrame) -> DataFrame:
    """Rounding for row-level scored columns: the inputs are exact, the rest by magnitude."""
    return rounded(
        df,
        4,
        exact=(*NUMERIC, TARGET, "actual_rate", RPM, "actual_rate_per_mile"),
        squared_error=2,
        absolute_percentage_error=6,
        predicted_rate_per_mile=8,
        predicted_log_rate_per_mile=8,
        actual_log_rate_per_mile=8,
        rpm_residual=8,
        error_squared_contribution=10,
        absolute_error_contribution=10,
    )


# Sources and sinks


@query("src_loads")
def _(spark, sf):
    return tables.all_loads(spark, sf)


@query("src_holdout")
def _(spark, sf):
    return tables.holdout(spark, sf)


@query("predictions_full")
def _(spark, sf):
    return money(tables.predictions(spark, sf))


@query("submission")
def _(spark, sf):
    return money(submission(spark, sf))


def submission(spark, sf) -> DataFrame:
    """Refit on all labelled rows, score the held-out rows."""

    def build() -> DataFrame:
        model = GroupedMean().fit(tables.clean(spark, sf))
        later = quality.repair_weight(tables.holdout(spark, sf))
        return tables.priced(model.transform(later)).select(ID, "predicted_rate")

    return tables.once(spark, sf, "submission", build)


# Projections, repairs and guards


@query("feature_matrix")
def _(spark, sf):
    return tables.clean(spark, sf).select(ID, *NUMERIC, *CATEGORICAL)


@query("repair_weight")
def _(spark, sf):
    return quality.repair_weight(tables.all_loads(spark, sf)).select(ID, "weight")


@query("repair_counts")
def _(spark, sf):
    part = F.when(F.col(DATE) < F.lit(STAR_HOLDOUT_START), "labelled").otherwise("holdout")
    raw = tables.all_loads(spark, sf)
    return quality.repair_counts(raw.where(part == "labelled")).withColumn("part", F.lit("labelled")).unionByName(
        quality.repair_counts(raw.where(part == "holdout")).withColumn("part", F.lit("holdout"))
    )


@query("dq_report")
def _(spark, sf):
    return quality.guard_report(tables.labelled(spark, sf))


@query("dq_counters")
def _(spark, sf):
    return quality.run_counters(tables.labelled(spark, sf))


@query("dq_duplicates")
def _(spark, sf):
    """Loads that occur in more than one validation fold: the windows overlap."""
    return quality.duplicates(tables.fold_predictions(spark, sf))


@query("dq_duplicates_loads")
def _(spark, sf):
    return quality.duplicates(tables.all_loads(spark, sf))


@query("dq_predictions")
def _(spark, sf):
    return quality.prediction_report(tables.predictions(spark, sf))


@query("missing_profile")
def _(spark, sf):
    return rounded(quality.missing_profile(tables.labelled(spark, sf)))


@query("split_train")
def _(spark, sf):
    return tables.train(spark, sf).select(ID, DATE, TARGET)


@query("split_validation")
def _(spark, sf):
    return tables.validation(spark, sf).select(ID, DATE, TARGET)


@query("split_summary")
def _(spark, sf):
    return splits.split_summary(tables.clean(spark, sf), STAR_SPLIT)


# Joins


@query("scored_join")
def _(spark, sf):
    return money(
        tables.scored(spark, sf).select(
            ID, DATE, "distance", "weight", "actual_rate", "predicted_rate", "actual_rate_per_mile", "predicted_rate_per_mile"
        )
    )


@query("join_orphans")
def _(spark, sf):
    return analysis.orphans(tables.labelled(spark, sf), tables.predictions(spark, sf)).select(ID, DATE)


@query("route_coverage")
def _(spark, sf):
    return rounded(analysis.route_coverage(tables.train(spark, sf), tables.validation(spark, sf)))


@query("id_reconcile")
def _(spark, sf):
    last = table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    expected = quality.sequential_ids(spark, "LD-%08d", last)
    return quality.reconcile_ids(tables.all_loads(spark, sf), expected)


@query("unseen_high_rate")
def _(spark, sf):
    return analysis.unseen_high_rate(tables.train(spark, sf), tables.validation(spark, sf))


# Aggregates


@query("metrics_train")
def _(spark, sf):
    model = GroupedMean().fit(tables.train(spark, sf))
    fitted = tables.predictions_of(tables.priced(model.transform(tables.train(spark, sf))))
    return rounded(metrics.regression_metrics(fitted))


@query("metrics_validation")
def _(spark, sf):
    return rounded(metrics.regression_metrics(tables.predictions(spark, sf)))


@query("generalization_gap")
def _(spark, sf):
    model = GroupedMean().fit(tables.train(spark, sf))
    both = splits.tagged(tables.clean(spark, sf), STAR_SPLIT)
    fitted = tables.priced(model.transform(both)).withColumn("actual_rate", F.col(TARGET))
    return rounded(metrics.generalization_gap(metrics.regression_metrics(fitted, ["split"])))


@query("error_summary")
def _(spark, sf):
    return rounded(metrics.error_summary(tables.scored(spark, sf)))


@query("error_by_equipment")
def _(spark, sf):
    return rounded(analysis.error_by(tables.scored(spark, sf), "equipment"))


@query("error_by_distance")
def _(spark, sf):
    return rounded(analysis.error_by_bin(tables.scored(spark, sf), DISTANCE_BINS))


@query("error_by_rate")
def _(spark, sf):
    return rounded(analysis.error_by_bin(tables.scored(spark, sf), RATE_BINS))


@query("error_by_weight")
def _(spark, sf):
    return rounded(analysis.error_by_bin(tables.scored(spark, sf), WEIGHT_BINS))


@query("error_by_weight_raw")
def _(spark, sf):
    """The same report on weights as delivered: negative weights land in the lowest bin."""
    raw = tables.labelled(spark, sf).select(ID, "weight")
    return rounded(analysis.error_by_bin(tables.scored(spark, sf).drop("weight").join(raw, ID), WEIGHT_BINS))


@query("error_by_route")
def _(spark, sf):
    return rounded(analysis.error_by_route(tables.scored(spark, sf)))


for _column, _key in (("distance", "distance"), ("weight", "weight"), ("market_index", "market"), ("quote_signal", "quote")):

    @query(f"resid_by_{_key}_q")
    def _(spark, sf, column=_column):
        return rounded(analysis.residuals_by_quantile(tables.scored(spark, sf), column))


@query("resid_by_equipment")
def _(spark, sf):
    return rounded(analysis.residuals_by(tables.scored(spark, sf), "equipment"))


@query("resid_correlation")
def _(spark, sf):
    return rounded(analysis.residual_correlation(tables.scored(spark, sf)))


@query("target_describe")
def _(spark, sf):
    both = melt(splits.tagged(tables.clean(spark, sf), STAR_SPLIT), [TARGET, RPM, LOG_RPM], "double", ["split"])
    described = metrics.describe(both, "value", ["split", "column_name"])
    return rounded(described.withColumnRenamed("column_name", "target"), 5)


@query("calendar_ranges")
def _(spark, sf):
    return metrics.column_ranges(
        tables.train(spark, sf).withColumns(calendar_columns(STAR_SPLIT.origin)), CALENDAR
    )


@query("route_count")
def _(spark, sf):
    return analysis.route_count(tables.clean(spark, sf))


@query("prediction_summary")
def _(spark, sf):
    return rounded(metrics.prediction_summary(submission(spark, sf)))


@query("spearman")
def _(spark, sf):
    return rounded(analysis.spearman(tables.clean(spark, sf), "distance", TARGET))


@query("rpm_by_equipment")
def _(spark, sf):
    return rounded(analysis.rpm_by_equipment(tables.clean(spark, sf)))


@query("rpm_tail")
def _(spark, sf):
    return rounded(analysis.rpm_tail(tables.validation(spark, sf)))


# History


for _level in ("route", "pickup", "delivery", "equipment", "global"):

    @query(f"hist_{_level}")
    def _(spark, sf, level=_level):
        names = [c for c in HISTORY if c.startswith(f"hist_{level}_")]
        return single_precision(history.expanding_history(tables.train(spark, sf), [level]).select(ID, *names))


@query("hist_all")
def _(spark, sf):
    return single_precision(history.expanding_history(tables.train(spark, sf)).select(ID, *HISTORY))


@query("hist_frozen")
def _(spark, sf):
    frozen = history.frozen_history(tables.train(spark, sf), tables.validation(spark, sf))
    return single_precision(frozen.select(ID, *HISTORY))


@query("hist_coverage")
def _(spark, sf):
    early = history.expanding_history(tables.train(spark, sf)).select(F.lit("train").alias("split"), *HISTORY)
    late = history.frozen_history(tables.train(spark, sf), tables.validation(spark, sf)).select(
        F.lit("validation").alias("split"), *HISTORY
    )
    return rounded(history.history_coverage(early.unionByName(late)))


# Rows worth a look


@query("error_contribution")
def _(spark, sf):
    return money(
        analysis.error_contribution(tables.scored(spark, sf)).select(
            ID, "error_squared_contribution", "absolute_error_contribution"
        )
    )


@query("top_routes")
def _(spark, sf):
    return rounded(analysis.top_routes(tables.scored(spark, sf)))


@query("worst_100")
def _(spark, sf):
    return money(analysis.worst_predictions(tables.scored(spark, sf)))


@query("top_contributors")
def _(spark, sf):
    return money(analysis.top_contributors(tables.scored(spark, sf)))


@query("top_underpredictions")
def _(spark, sf):
    return money(analysis.top_underpredictions(tables.scored(spark, sf)))


# Scalar functions


@query("target_rpm")
def _(spark, sf):
    return tables.clean(spark, sf).select(ID, RPM)


@query("target_log_rpm")
def _(spark, sf):
    return rounded(tables.clean(spark, sf).select(ID, LOG_RPM), 10)


@query("reconstruct_rate")
def _(spark, sf):
    return tables.clean(spark, sf).select(
        ID,
        F.round(F.col(RPM) * F.col("distance"), 7).alias("from_rpm"),
        F.round(F.exp(LOG_RPM) * F.col("distance"), 7).alias("from_log_rpm"),
    )


@query("error_columns")
def _(spark, sf):
    return money(tables.scored(spark, sf).select(ID, *error_columns()))


@query("residual_columns")
def _(spark, sf):
    return money(tables.scored(spark, sf).select(ID, *residual_columns()))


@query("calendar_features")
def _(spark, sf):
    return tables.clean(spark, sf).select(
        ID, *[c.alias(n) for n, c in calendar_columns(STAR_SPLIT.origin).items()]
    )


@query("route_feature")
def _(spark, sf):
    return tables.clean(spark, sf).select(ID, route().alias("route"))


# Folds


@query("cv_assign")
def _(spark, sf):
    return splits.assign_folds(tables.labelled(spark, sf), STAR_FOLDS).select("fold", "role", ID)


@query("cv_predictions")
def _(spark, sf):
    return money(tables.fold_predictions(spark, sf))


@query("cv_fold_metrics")
def _(spark, sf):
    return rounded(fold_metrics(spark, sf))


def fold_metrics(spark, sf) -> DataFrame:
    per_role = metrics.regression_metrics(tables.fold_rows(spark, sf), ["fold", "role"])
    return metrics.generalization_gap(per_role, "role", ["fold"])


@query("cv_summary")
def _(spark, sf):
    return rounded(metrics.fold_statistics(fold_metrics(spark, sf)))


# Contracts and scenario


@query("submission_check")
def _(spark, sf):
    return quality.check_submission(submission(spark, sf), tables.holdout(spark, sf))


@query("submission_check_wrong_rows")
def _(spark, sf):
    """Validation predictions held against the held-out ids: the id rules must count every row."""
    delivered = tables.predictions(spark, sf).select(ID, "predicted_rate")
    return quality.check_submission(delivered, tables.holdout(spark, sf))


@query("scenario_rates")
def _(spark, sf):
    return money(priced_scenario(spark, sf))


def priced_scenario(spark, sf) -> DataFrame:
    loads = tables.clean(spark, sf)
    return scenario_rates(scenario_inputs(loads, STAR_SCENARIO), GroupedMean().fit(loads))


@query("scenario_check")
def _(spark, sf):
    return quality.check_scenario(priced_scenario(spark, sf), STAR_SCENARIO)


@query("scenario_check_loads")
def _(spark, sf):
    """Priced validation loads held against the scenario contract: nearly every rule must count."""
    delivered = tables.scored(spark, sf).select(
        "pickup", "delivery", "distance", "equipment", "weight", DATE, "predicted_rate"
    )
    return quality.check_scenario(delivered, STAR_SCENARIO)


@query("date_spine_check")
def _(spark, sf):
    """Held against the labelled years, so that the held-out days are unexpected."""
    return quality.check_days(tables.all_loads(spark, sf), date(1995, 1, 1), date(2000, 12, 31))


# Imputation and encoding


@query("impute_median")
def _(spark, sf):
    return rounded(column_medians(tables.train(spark, sf), NUMERIC))


@query("impute_mode")
def _(spark, sf):
    return column_modes(tables.train(spark, sf), CATEGORICAL)


def imputed(spark, sf) -> tuple[DataFrame, DataFrame]:
    model = Imputer(NUMERIC, CATEGORICAL).fit(tables.train(spark, sf))
    return model.transform(tables.train(spark, sf)), model.transform(tables.validation(spark, sf))


@query("impute_rows")
def _(spark, sf):
    return imputed(spark, sf)[1].select(ID, *NUMERIC, *CATEGORICAL)


@query("category_index")
def _(spark, sf):
    train, _later = imputed(spark, sf)
    return category_codes(encoding(NUMERIC, CATEGORICAL).fit(train), train, CATEGORICAL)


@query("onehot_rows")
def _(spark, sf):
    """Active one-hot slot per validation row and category, read back from the sparse vectors."""
    train, later = imputed(spark, sf)
    coded = encoding(NUMERIC, CATEGORICAL).fit(train).transform(later)
    blocks = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.size(vector_to_array(f"{c}_slots")).alias("width"),
            (F.array_position(vector_to_array(f"{c}_slots"), 1.0) - 1).cast("int").alias("slot"),
        )
        for c in CATEGORICAL
    ]
    return coded.select(ID, F.inline(F.array(*blocks)))


@query("feature_vector")
def _(spark, sf):
    """Assembled vector per validation row: length, active entries, numeric block and one-hot sum."""
    train, later = imputed(spark, sf)
    coded = encoding(NUMERIC, CATEGORICAL).fit(train).transform(later)
    rows = coded.select(ID, vector_to_array("features").alias("x"))
    n = len(NUMERIC)
    return rows.select(
        ID,
        F.size("x").alias("width"),
        *[F.get("x", F.lit(i)).alias(f"x_{c}") for i, c in enumerate(NUMERIC)],
        F.aggregate(F.slice("x", n + 1, F.size("x") - n), F.lit(0.0), lambda a, v: a + v).cast("int").alias("active"),
    )


# Models and runs, each as specified and fitted once for all queries on it.


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_fitted: dict[tuple, object] = {}


def fitted(spark, sf, name: str, fit: Callable[[], object]):
    """A run of this application, fitted once and shared by the queries on it."""
    key = (spark.sparkContext.applicationId, sf, tables.input_state(spark, sf), name)
    if key not in _fitted:
        _fitted[key] = fit()
    return _fitted[key]


def spec_run(spark, sf, name: str):
    """A run of the shared folder's store, fitted by the first application that asks for it."""
    spec, state = BY_NAME[name], (sf, tables.input_state(spark, sf))

    def fit():
        return run_holdout(spec, tables.labelled(spark, sf), STAR_SPLIT)

    return fitted(spark, sf, f"run-{name}", lambda: run_store.stored_run(spark, spec, STAR_SPLIT, state, fit))


def selected_run(spark, sf):
    return spec_run(spark, sf, SELECTED.name)


def forest_run(spark, sf):
    return spec_run(spark, sf, "log_rate_per_mile_forest")


def selected_folds(spark, sf):
    def fit():
        out = folder(spark, "folds")
        return run_folds(SELECTED, tables.labelled(spark, sf), STAR_FOLDS, out), out

    return fitted(spark, sf, "folds", fit)


def selected_final(spark, sf):
    def fit():
        out = folder(spark, "final")
        return run_final(SELECTED, tables.labelled(spark, sf), tables.holdout(spark, sf), STAR_SPLIT, out), out

    return fitted(spark, sf, "final", fit)


@query("rf_predictions")
def _(spark, sf):
    return forest_run(spark, sf).predictions


@query("extratrees_predictions")
def _(spark, sf):
    return selected_run(spark, sf).predictions


@query("cv_extratrees")
def _(spark, sf):
    return selected_folds(spark, sf)[0].fold_metrics


@query("submission_extratrees")
def _(spark, sf):
    return selected_final(spark, sf)[0].submission


def consistent() -> Column:
    """Rate, rate per mile and log rate per mile of a prediction say the same."""
    rate, rpm, log = F.col("predicted_rate"), F.col("predicted_rate_per_mile"), F.col("predicted_log_rate_per_mile")
    distance = F.col("actual_rate") / F.col("actual_rate_per_mile")
    return (rate > 0) & (F.abs(F.ln(rpm) - log) < 1e-9) & (F.abs(rate / (rpm * distance) - 1) < 1e-9)


@query("rf_contract")
def _(spark, sf):
    """What must hold for any model's predictions: the ids, the actual values, one price in three forms."""
    return forest_run(spark, sf).predictions.select("split", ID, "actual_rate", "actual_rate_per_mile", consistent().alias("consistent"))


@query("extratrees_contract")
def _(spark, sf):
    return selected_run(spark, sf).predictions.select("split", ID, "actual_rate", "actual_rate_per_mile", consistent().alias("consistent"))


@query("extratrees_trees")
def _(spark, sf):
    """Per tree: rows of all leaves, leaves under the minimum, inner nodes whose children do not add up to them."""
    nodes = selected_run(spark, sf).model.node_table
    parents = nodes.where("parent > 0").groupBy("tree", F.col("parent").alias("node")).agg(F.sum("n").alias("below"), F.count("*").alias("children"))
    joined = nodes.join(parents, ["tree", "node"], "left")
    leaf = F.col("feature") < 0
    wrong = (~leaf & ~((F.col("below") == F.col("n")) & (F.col("children") == 2))) | (leaf & F.col("below").isNotNull())
    return joined.groupBy("tree").agg(
        F.sum(F.when(leaf, F.col("n"))).alias("leaf_rows"),
        F.count_if(leaf & (F.col("n") < SELECTED.min_leaf)).alias("small_leaves"),
        F.count_if(wrong).alias("wrong_nodes"),
        F.round(F.max(F.when(F.col("node") == 1, F.col("value"))), 6).alias("root_value"),
    )


@query("cv_extratrees_windows")
def _(spark, sf):
    """The fold results as the run wrote them: windows and rows."""
    found = spark.read.parquet(f"{selected_folds(spark, sf)[1]}/fold_results")
    return found.select("fold", "train_start", "train_end", "validation_start", "validation_end", "train_rows", "validation_rows")


@query("cv_extratrees_written")
def _(spark, sf):
    """The pooled fold predictions as the run wrote them."""
    found = spark.read.parquet(f"{selected_folds(spark, sf)[1]}/predictions")
    return found.select(F.col("fold").cast("string").alias("fold"), ID, "actual_rate", "actual_rate_per_mile", consistent().alias("consistent"))


@query("submission_extratrees_contract")
def _(spark, sf):
    """The submission as the final run wrote it, read back as a delivery."""
    found = read_delivery(spark, f"{selected_final(spark, sf)[1]}/submission", "submission")
    return found.select(ID, (F.col("predicted_rate").cast("double") > 0).alias("priced"))


@query("final_record")
def _(spark, sf):
    """The final run's record as written, less its times and prices, and whether the saved model still agrees."""
    final, out = selected_final(spark, sf)
    saved = load_model(spark, SELECTED, f"{out}/model")
    rows = quality.repair_weight(tables.holdout(spark, sf))
    again = saved.transform(rows).select(ID, (F.exp("prediction") * F.col("distance")).alias("again"))
    differences = again.join(final.submission, ID).agg(F.count_if(F.abs(F.col("again") / F.col("predicted_rate") - 1) > 1e-9)).scalar()
    kept = ["run", "labelled_rows", "labelled_weights_repaired", "holdout_rows", "holdout_weights_repaired"]
    return spark.read.json(f"{out}/record").select(*kept, differences.alias("differences"))


@query("extratrees_error_by_distance")
def _(spark, sf):
    """The error report by distance on the selected ensemble's predictions: what does not depend on the model."""
    later = selected_run(spark, sf).predictions.where("split = 'validation'").drop("split")
    loads = quality.repair_weight(splits.validation_rows(tables.labelled(spark, sf), STAR_SPLIT))
    report = analysis.error_by_bin(analysis.annotate(analysis.join_predictions(loads, later)), DISTANCE_BINS)
    return rounded(report.select("bin", "label", "rows", "actual_rate_mean"))


# Files


@query("csv_roundtrip")
def _(spark, sf):
    """Labelled loads written as CSV and read by the strict reader."""
    out = folder(spark, "loads-csv")
    tables.labelled(spark, sf).write.option("header", True).csv(out)
    return read_loads(spark, out)


@query("csv_roundtrip_holdout")
def _(spark, sf):
    out = folder(spark, "holdout-csv")
    tables.holdout(spark, sf).write.option("header", True).csv(out)
    return read_holdout(spark, out)


@query("predictions_roundtrip")
def _(spark, sf):
    """The five-column layout written as CSV and read back."""
    out = folder(spark, "predictions-csv")
    write_predictions(tables.predictions(spark, sf), out, 5, "csv")
    return rounded(read_predictions(spark, out, "csv", 5), 4, exact=("actual_rate", "actual_rate_per_mile"), predicted_rate_per_mile=8)


REPORTS = ["error_summary", "error_by_equipment", "error_by_distance", "error_by_rate", "error_by_weight", "error_by_route", "worst_100", "error_contribution"]


@query("report_set")
def _(spark, sf):
    """The eight analysis tables written by one call, read back and counted."""
    out = folder(spark, "reports")
    write_reports({name: QUERIES[name](spark, sf) for name in REPORTS}, out)
    counts = [spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name in REPORTS]
    return reduce(DataFrame.unionByName, counts)


@query("model_roundtrip")
def _(spark, sf):
    """The models of both runs saved, loaded and compared on the validation rows."""
    out = []
    for run in (forest_run(spark, sf), selected_run(spark, sf)):
        spec, model = run.spec, run.model
        path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/model-{uuid.uuid4().hex[:12]}"
        model.save(spark, path)
        rows = tables.validation(spark, sf)
        before = model.transform(rows).select(ID, F.col("prediction").alias("before"))
        after = load_model(spark, spec, path).transform(rows).select(ID, F.col("prediction").alias("after"))
        same = before.join(after, ID)
        out.append(
            same.agg(
                F.lit(spec.estimator).alias("estimator"),
                F.count("*").alias("rows"),
                F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differences"),
            )
        )
    return out[0].unionByName(out[1])


RUNS_AT_ONCE = 4  # fewer would leave cores idle, more would leave more runs unpublished when an application ends


def logged_runs(spark, sf) -> DataFrame:
    """The records of the eleven runs. Each is published once it is fitted, so a log that was cut short goes on where it stopped."""
    tables.all_loads(spark, sf)  # stored before the runs, which share it
    with ThreadPoolExecutor(RUNS_AT_ONCE) as pool:  # the runs are independent; Spark shares its cores among their jobs
        runs = list(pool.map(lambda spec: spec_run(spark, sf, spec.name), RUNS))
    return run_store.run_log(spark, runs)


@query("run_log")
def _(spark, sf):
    return logged_runs(spark, sf)


@query("run_log_contract")
def _(spark, sf):
    """What the log must say of each run, whatever the models predict."""
    return logged_runs(spark, sf).select(
        "run", "target", "estimator", "min_leaf", "weights_repaired", "train_rows", "validation_rows", "negative_weights", F.size("numeric").alias("numeric"), F.size("categorical").alias("categorical")
    )


@query("leaderboard")
def _(spark, sf):
    return leaderboard(logged_runs(spark, sf))


@query("leaderboard_contract")
def _(spark, sf):
    """Every run has one place, and no better run stands below a worse one."""
    board = leaderboard(logged_runs(spark, sf))
    below = W.orderBy("validation_mae", "run")  # one row for each run
    gap = F.col("validation_mae") - F.col("train_mae") - F.col("mae_gap")
    return board.select("run", (F.abs(gap) < 1e-9).alias("gap_holds"), (F.col("validation_mae") >= F.coalesce(F.lag("validation_mae").over(below), F.lit(0.0))).alias("in_order"))
