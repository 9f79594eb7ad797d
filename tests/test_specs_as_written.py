"""The catalog's runs are the specs as written, each asked for once."""

from types import SimpleNamespace

from lanewise.plans import catalog
from lanewise.plans.experiment import RUNS, SELECTED


def test_log_asks_for_every_spec_as_written_once(monkeypatch):
    asked = []
    monkeypatch.setattr(catalog, "_fitted", {})
    monkeypatch.setattr(catalog.run_store, "stored_run", lambda spark, spec, *_: asked.append(spec) or SimpleNamespace(spec=spec))
    monkeypatch.setattr(catalog.run_store, "run_log", lambda spark, runs: [r.spec for r in runs])
    monkeypatch.setattr(catalog.tables, "all_loads", lambda spark, sf: None)
    monkeypatch.setattr(catalog.tables, "input_state", lambda spark, sf: 0)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app"))
    assert catalog.forest_run(spark, "sf").spec in RUNS
    assert catalog.selected_run(spark, "sf").spec == SELECTED
    assert catalog.logged_runs(spark, "sf") == RUNS
    assert len(asked) == len(RUNS) and all(spec in asked for spec in RUNS)
