"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Results are pulled through
Spark's no-op sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from lanewise.operators.extratrees import ExtraTrees
from lanewise.operators.forest import Forest
from lanewise.operators.history import expanding_history, frozen_history
from lanewise.plans import tables
from lanewise.plans.catalog import QUERIES
from lanewise.plans.experiment import SELECTED, run_final, run_folds
from lanewise.schema import CATEGORICAL, LOG_RPM, NUMERIC, STAR_FOLDS, STAR_SPLIT
from lanewise.session import local_session

NAMED = [
    "dq_report",
    "missing_profile",
    "route_coverage",
    "generalization_gap",
    "error_summary",
    "error_by_equipment",
    "error_by_distance",
    "error_by_route",
    "resid_by_distance_q",
    "resid_correlation",
    "top_contributors",
    "target_describe",
    "spearman",
    "cv_fold_metrics",
    "submission_check",
    "impute_median",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "lanewise-bench")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)

    drain(spark.range(1000).repartition(8))  # start the workers
    timed("build_loads", lambda: tables.all_loads(spark, sf_dir))
    timed("build_scored", lambda: tables.scored(spark, sf_dir))
    train, later = tables.train(spark, sf_dir), tables.validation(spark, sf_dir)

    def history() -> None:
        drain(expanding_history(train))
        drain(frozen_history(train, later))

    timed("history_features", history)
    for name in NAMED:
        timed(name, lambda: drain(QUERIES[name](spark, sf_dir)))
    models = {}

    def fit_extra_trees() -> None:
        models["extra"] = ExtraTrees(NUMERIC, CATEGORICAL, LOG_RPM, trees=100, min_leaf=20).fit(train)

    timed("fit_extra_trees_100x20", fit_extra_trees)
    timed("predict_extra_trees_100x20", lambda: drain(models["extra"].transform(later)))
    timed(
        "fit_forest_100x5",
        lambda: Forest(NUMERIC, CATEGORICAL, LOG_RPM, trees=100, min_leaf=5).fit(train),
    )
    labelled, held_out = tables.labelled(spark, sf_dir), tables.holdout(spark, sf_dir)
    timed("temporal_cv_3x100", lambda: run_folds(SELECTED, labelled, STAR_FOLDS))
    timed("final_fit_100", lambda: run_final(SELECTED, labelled, held_out, STAR_SPLIT))
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "train_rows": train.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
