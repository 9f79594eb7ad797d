from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lanewise.operators.quality import ContractError
from lanewise.plans import tables
from lanewise.plans.experiment import (
    RUN_LOG,
    RUNS,
    SELECTED,
    leaderboard,
    run_final,
    run_folds,
    run_holdout,
    run_log,
    small,
)
from lanewise.plans.tables import priced
from lanewise.operators.grouped_mean import GroupedMean
from lanewise.operators.scenario import scenario_inputs, scenario_rates
from lanewise.operators.quality import check_scenario
from lanewise.plans.catalog import STAR_SCENARIO
from lanewise.schema import HISTORY, LOG_RPM, PREDICTIONS, RPM, STAR_FOLDS, STAR_SPLIT, TARGET
from lanewise.sources.writers import append_runs


def by_name(name):
    return next(s for s in RUNS if s.name == name)


@pytest.fixture(scope="module")
def runs(spark, sf):
    names = ["raw_target_forest", "history_forest", "log_rate_per_mile_forest"]
    return [run_holdout(small(by_name(n), 2, 4), tables.labelled(spark, sf), STAR_SPLIT) for n in names]


def test_record_comes_from_the_spec(spark, sf, runs):
    negative = tables.labelled(spark, sf).where("weight < 0").count()
    assert negative > 0
    for run in runs:
        row = run.record.first()
        assert (row["run"], row["min_leaf"], row["trees"], row["estimator"]) == (
            run.spec.name,
            run.spec.min_leaf,
            run.spec.trees,
            run.spec.estimator,
        )
        assert row["numeric"] == run.spec.numeric and row["weights_repaired"] == run.spec.repair
        assert row["gap"]["mae"] == pytest.approx(row["validation"]["mae"] - row["train"]["mae"])
        assert row["gap"]["r2"] == pytest.approx(row["train"]["r2"] - row["validation"]["r2"])
        assert (row["train_rows"], row["validation_rows"], row["negative_weights"]) == (1144, 210, negative)
    assert set(HISTORY) <= set(runs[1].record.first()["numeric"])


def test_predictions_are_consistent_across_scales(runs):
    for run in runs:
        assert run.predictions.columns == ["split", *PREDICTIONS.names]
        p = run.predictions
        off = p.where(
            (F.abs(F.exp("predicted_log_rate_per_mile") - F.col("predicted_rate_per_mile")) > 1e-9)
            | (
                F.abs(
                    F.col("predicted_rate") / F.col("predicted_rate_per_mile")
                    - F.col("actual_rate") / F.col("actual_rate_per_mile")
                )
                > 1e-6
            )
        )
        assert off.isEmpty() and p.count() == 1354
    assert [r.spec.prediction_width for r in runs] == [3, 5, 7]


def test_log_and_leaderboard(spark, runs, tmp_path):
    log = run_log(runs)
    for part in (log.limit(1), log):
        append_runs(part, str(tmp_path / "log"))
    assert spark.read.schema(RUN_LOG).json(str(tmp_path / "log")).count() == 4
    maes = [r["validation_mae"] for r in leaderboard(log).collect()]
    assert maes == sorted(maes) and len(maes) == 3


def test_runs_cover_every_setting():
    assert len(RUNS) == len({s.name for s in RUNS}) == 11
    assert {s.target for s in RUNS} == {TARGET, RPM, LOG_RPM}
    assert {(s.estimator, s.min_leaf) for s in RUNS} == {
        ("forest", 1),
        ("forest", 5),
        ("extra_trees", 5),
        ("extra_trees", 10),
        ("extra_trees", 20),
    }
    assert SELECTED.min_leaf == 20 and SELECTED.estimator == "extra_trees"


def test_folds_pool_overlapping_windows(spark, sf):
    cv = run_folds(small(SELECTED, 2, 3), tables.labelled(spark, sf), STAR_FOLDS)
    later = cv.predictions.where("role = 'validation'")
    assert later.groupBy("load_id").count().where("count > 1").count() > 0
    assert later.groupBy("fold", "load_id").count().where("count > 1").isEmpty()
    rows = {r["fold"]: r for r in cv.fold_metrics.collect()}
    assert set(rows) == {"fold_1", "fold_2", "fold_3"}
    holdout = run_holdout(small(SELECTED, 2, 3), tables.labelled(spark, sf), STAR_SPLIT).record.first()
    assert rows["fold_3"]["validation_mae"] == pytest.approx(holdout["validation"]["mae"])
    summary = cv.summary.first()
    assert summary["mean_validation_mae"] == pytest.approx(sum(r["validation_mae"] for r in rows.values()) / 3)


def test_final_run_delivers_the_contract(spark, sf):
    labelled, holdout = tables.labelled(spark, sf), tables.holdout(spark, sf)
    final = run_final(small(SELECTED, 2, 4), labelled, holdout, STAR_SPLIT)
    assert final.submission.columns == ["load_id", "predicted_rate"]
    assert final.submission.count() == holdout.count() == 119
    assert final.report.where("not passed").isEmpty()
    with pytest.raises(ContractError, match="repeat a load id"):
        run_final(SELECTED, labelled, holdout.unionByName(holdout), STAR_SPLIT)
    history = replace(small(by_name("history_forest"), 1, 3), name="history_final")
    assert run_final(history, labelled, holdout, STAR_SPLIT).submission.count() == 119


def test_guards_stop_a_run(spark, sf):
    bad = tables.labelled(spark, sf).withColumn("distance", F.lit(0.0))
    with pytest.raises(ContractError, match="distance_not_positive"):
        run_holdout(SELECTED, bad, STAR_SPLIT)


def test_scenario_with_an_ensemble_is_flat(spark, sf):
    loads = tables.clean(spark, sf)
    model = small(SELECTED, 2, 4).model().fit(loads)
    priced_days = scenario_rates(scenario_inputs(loads, STAR_SCENARIO), model)
    assert check_scenario(priced_days, STAR_SCENARIO).where("not passed").isEmpty()
    assert priced_days.select("predicted_rate").distinct().count() == 1


def test_unseen_group_gets_the_overall_mean(spark):
    train = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("b", 3.0, 5.0)], f"equipment string, {LOG_RPM} double, distance double")
    later = spark.createDataFrame([("b", 2.0), ("zzz", 2.0)], "equipment string, distance double")
    got = {r["equipment"]: r["predicted_log_rate_per_mile"] for r in priced(GroupedMean().fit(train).transform(later)).collect()}
    assert got == {"b": 3.0, "zzz": pytest.approx(7 / 3)}
