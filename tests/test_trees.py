import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.operators import extratrees, tree_nodes
from lanewise.operators.extratrees import ExtraTrees, ExtraTreesModel
from lanewise.operators.forest import Forest, ForestModel
from lanewise.operators.metrics import regression_metrics
from lanewise.operators.tree_nodes import child, draw, drawn, pack, route
from lanewise.plans import tables
from lanewise.schema import CATEGORICAL, LOG_RPM, NUMERIC


def same(a, b):
    both = a.nodes.merge(b.nodes, on=["tree", "node"], how="outer", indicator=True)
    return (
        (both["_merge"] == "both").all()
        and (both["feature_x"] == both["feature_y"]).all()
        and (both["parent_x"] == both["parent_y"]).all()
        and (both["cut_x"] == both["cut_y"]).all()
        and (both["value_x"] == both["value_y"]).all()
    )


def fit(train, **params):
    base = dict(trees=2, min_leaf=20, finish_rows=10**9)
    return ExtraTrees(NUMERIC, CATEGORICAL, LOG_RPM, **base | params).fit(train)


@pytest.fixture(scope="module")
def train(spark, sf):
    return tables.train(spark, sf).persist()


@pytest.fixture(scope="module")
def model(train):
    return fit(train)


def test_partitioning_does_not_change_the_trees(train, model):
    assert same(model, fit(train.repartition(13)))


def test_finishing_size_and_pass_size_do_not_change_the_trees(train, model):
    """At full depth, bit for bit."""
    for finish_rows, nodes_per_pass in ((0, 20_000), (60, 17), (300, 20_000)):
        assert same(model, fit(train, finish_rows=finish_rows, nodes_per_pass=nodes_per_pass))
    shallow = fit(train, max_depth=5)
    assert same(shallow, fit(train, max_depth=5, finish_rows=0, nodes_per_pass=3))
    assert max(depths(shallow)) == 5 and max(depths(model)) > 5


def depths(model):
    parent = dict(zip(zip(model.nodes["tree"], model.nodes["node"]), model.nodes["parent"]))
    for tree, node in parent:
        depth = 0
        while node != 1:
            node, depth = parent[(tree, node)], depth + 1
        yield depth


@pytest.mark.parametrize("finish_rows", [0, 10**9])
def test_a_chain_grows_to_its_end(spark, finish_rows):
    """Every category has its own label, far apart: one leaves at each level."""
    df = spark.range(400).selectExpr("0D AS x", "concat('k', id % 100) AS c", "cast(id % 100 AS double) AS y")
    model = ExtraTrees(["x"], ["c"], "y", trees=1, min_leaf=1, finish_rows=finish_rows).fit(df)
    assert max(depths(model)) > 70
    assert (model.nodes["feature"] < 0).sum() > 70


def test_ties_are_broken_alike(spark):
    df = spark.range(200).selectExpr("0D AS x", "concat('k', id % 4) AS c", "cast(id % 4 >= 2 AS double) AS y")
    fits = [ExtraTrees(["x"], ["c"], "y", trees=3, min_leaf=5, finish_rows=f).fit(df.repartition(p)) for f, p in ((0, 1), (10**9, 7), (60, 3))]
    assert same(fits[0], fits[1]) and same(fits[0], fits[2])


def test_leaves(train, model):
    leaves = model.nodes[model.nodes["feature"] < 0]
    assert leaves["n"].min() >= 20
    assert (leaves.groupby("tree")["n"].sum() == train.count()).all()
    assert model.nodes["tree"].nunique() == 2
    inner = model.nodes[model.nodes["feature"] >= 0]
    children = set(zip(model.nodes["tree"], model.nodes["node"]))
    assert all((t, int(child(n, 0))) in children and (t, int(child(n, 1))) in children for t, n in zip(inner["tree"], inner["node"]))


def test_seed_changes_the_trees(train, model):
    assert not same(model, fit(train, seed=7))


def test_root_split_is_the_best_of_the_drawn_cuts(spark):
    """Brute force over every numeric cut and every category of the root."""
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.choice(list("xyz"), n)})
    pdf["y"] = pdf["a"] + 3 * (pdf["c"] == "y") + rng.normal(0, 0.1, n)
    got = ExtraTrees(["a", "b"], ["c"], "y", trees=8, min_leaf=10, max_depth=1, finish_rows=0).fit(spark.createDataFrame(pdf))
    for tree, nodes in got.nodes.groupby("tree"):
        options = []
        for f, name in enumerate(["a", "b"]):
            lo, hi = pdf[name].min(), pdf[name].max()
            cut = lo + float(draw(42, tree, 1, f)) * (hi - lo)
            options.append((pdf[name] > cut, f, cut))
        options += [(pdf["c"] == v, 2, float(i)) for i, v in enumerate("xyz")]

        def spread(mask):
            if min(mask.sum(), (~mask).sum()) < 10:
                return np.inf
            return sum(((g - g.mean()) ** 2).sum() for g in (pdf["y"][mask], pdf["y"][~mask]))

        best = min(options, key=lambda o: spread(o[0]))
        root = nodes[nodes["node"] == 1].iloc[0]
        assert root["feature"] == best[1] and root["cut"] == pytest.approx(best[2])
        right = nodes[nodes["node"] == child(1, 1)].iloc[0]
        assert right["n"] == best[0].sum() and right["value"] == pytest.approx(pdf["y"][best[0]].mean())


def test_step_function_is_recovered(spark):
    df = spark.range(600).select((F.col("id") % 100).cast("double").alias("x"), F.lit("k").alias("c"))
    df = df.withColumn("y", F.when(F.col("x") >= 50, 10.0).otherwise(0.0))
    model = ExtraTrees(["x"], ["c"], "y", trees=20, min_leaf=1).fit(df)
    worst = model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert worst == pytest.approx(0.0, abs=1e-9)


def test_constant_label_is_one_leaf(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit("k").alias("c"), F.lit(4.0).alias("y"))
    model = ExtraTrees(["x"], ["c"], "y", trees=2, min_leaf=5).fit(df)
    assert len(model.nodes) == 2 and set(model.nodes["value"]) == {4.0}


def test_node_limit_is_enforced(train):
    with pytest.raises(ValueError, match="exceeds 5 nodes"):
        fit(train, max_nodes=5)


def test_prediction_is_the_mean_of_the_leaves(spark, train, model):
    rows = train.limit(50)
    coded = model.codes.transform(model.imputer.transform(rows)).select("load_id", *model.columns).toPandas()
    x = coded[model.columns].to_numpy(float)
    want = np.mean([p["value"][route(p, x)] for p in (pack(g) for _, g in model.nodes.groupby("tree"))], axis=0)
    got = {r["load_id"]: r["prediction"] for r in model.transform(rows).select("load_id", "prediction").collect()}
    assert [got[i] for i in coded["load_id"]] == pytest.approx(list(want))


def test_a_forest_never_comes_to_the_driver_whole(train, model, monkeypatch, tmp_path, spark):
    """Fitted, scored in batches of one tree, saved and loaded without its node table being collected."""
    want = sorted(model.transform(train).select("load_id", "prediction").collect())
    sent, plain = [], ExtraTreesModel._added
    monkeypatch.setattr(extratrees, "BATCH_NODES", 10)
    monkeypatch.setattr(ExtraTreesModel, "_added", lambda self, df, trees: sent.append(trees) or plain(self, df, trees))
    one = fit(train)
    one.save(spark, str(tmp_path / "model"))
    two = ExtraTreesModel.load(spark, str(tmp_path / "model"))
    for fitted in (one, two):
        assert sorted(fitted.transform(train).select("load_id", "prediction").collect()) == want
        assert "nodes" not in vars(fitted)
    assert sent == [[0], [1]] * 2


def test_raw_values_survive_and_unknown_categories_score(spark, train, model):
    odd = train.limit(20).withColumn("pickup", F.lit("nowhere")).withColumn("weight", F.lit(None).cast("double"))
    out = model.transform(odd)
    assert out.columns == [*odd.columns, "prediction"]
    rows = out.collect()
    assert all(r["pickup"] == "nowhere" and r["weight"] is None and r["prediction"] is not None for r in rows)


def test_larger_leaves_fit_less_closely(spark, sf, train):
    def gap(min_leaf):
        model = fit(train, trees=5, min_leaf=min_leaf)
        mae = []
        for df in (train, tables.validation(spark, sf)):
            scored = model.transform(df).selectExpr(f"{LOG_RPM} AS actual_rate", "prediction AS predicted_rate")
            mae.append(regression_metrics(scored).first()["mae"])
        return mae[0], mae[1] - mae[0]

    (train_5, gap_5), (train_20, gap_20) = gap(5), gap(20)
    assert train_20 > train_5 and gap_20 < gap_5


def test_saved_models_predict_the_same(spark, train, model, tmp_path):
    forest = Forest(NUMERIC, CATEGORICAL, LOG_RPM, trees=2, min_leaf=5, max_depth=4).fit(train)
    for name, one, kind in (("et", model, ExtraTreesModel), ("rf", forest, ForestModel)):
        one.save(spark, str(tmp_path / name))
        two = kind.load(spark, str(tmp_path / name))
        pairs = one.transform(train).select("load_id", "prediction").exceptAll(two.transform(train).select("load_id", "prediction"))
        assert pairs.isEmpty()


def test_forest_respects_the_leaf_size(train):
    forest = Forest(NUMERIC, CATEGORICAL, LOG_RPM, trees=1, min_leaf=100, max_depth=10).fit(train)
    assert forest.nodes[forest.nodes["feature"] < 0]["n"].min() >= 100


def test_forest_is_the_same_however_it_is_grown(train):
    """Cut by Spark or in tasks, over few or many partitions: the same trees, bit for bit, to any depth."""
    fit = lambda df, **more: Forest(NUMERIC, CATEGORICAL, LOG_RPM, trees=2, min_leaf=5, **more).fit(df)
    whole = fit(train)
    assert same(whole, fit(train.repartition(13), finish_rows=300)) and max(depths(whole)) > 10


def slow_forest_tree(x, codes, y, times, min_leaf):
    """{path: (feature, cut or code or None, n, value)} by trying every cut of every feature."""
    rows = [i for i, n in enumerate(times) for _ in range(n)]
    out = {}

    def spread(part):
        mean = sum(y[i] for i in part) / len(part)
        return sum((y[i] - mean) ** 2 for i in part)

    def split(path, part):
        best = None
        for f in range(len(x[0])):
            values = sorted({x[i][f] for i in part})
            options = [(a + (b - a) / 2, lambda i, c=a + (b - a) / 2, f=f: x[i][f] <= c) for a, b in zip(values, values[1:])]
            for cut, left in options:
                sides = [i for i in part if left(i)], [i for i in part if not left(i)]
                if min(map(len, sides)) >= min_leaf:
                    cost = sum(map(spread, sides))
                    if best is None or cost < best[0] - 1e-9:
                        best = (cost, f, cut, sides)
        for code in sorted({codes[i] for i in part}):
            sides = [i for i in part if codes[i] != code], [i for i in part if codes[i] == code]
            if min(map(len, sides)) >= min_leaf:
                cost = sum(map(spread, sides))
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, len(x[0]), float(code), sides)
        found = best if best and spread(part) - best[0] > 1e-9 else None
        out[path] = (found[1] if found else -1, found[2] if found else 0.0, len(part), sum(y[i] for i in part) / len(part))
        if found:
            for side, own in enumerate(found[3]):
                split(path + str(side), own)

    split("1", rows)
    return out


def test_forest_equals_a_plain_one_with_the_same_draws(spark):
    rng = np.random.default_rng(8)
    n = 120
    pdf = pd.DataFrame({"a": rng.integers(0, 25, n) / 4, "b": rng.normal(size=n), "c": rng.choice(list("xyz"), n)})
    pdf["y"] = np.sin(pdf["a"]) * 3 + pdf["b"] ** 2 + 2 * (pdf["c"] == "y") + rng.normal(0, 0.2, n)
    df = spark.createDataFrame(pdf)
    keys = df.select(F.xxhash64(*df.columns).alias("k")).toPandas()["k"].to_numpy()
    for finish_rows in (0, 10**6):
        model = Forest(["a", "b"], ["c"], "y", trees=3, min_leaf=4, finish_rows=finish_rows).fit(df)
        for tree, nodes in model.nodes.groupby("tree"):
            want = slow_forest_tree(pdf[["a", "b"]].to_numpy().tolist(), [ord(c) - 120 for c in pdf["c"]], pdf["y"].tolist(), drawn(42, tree, keys).tolist(), 4)
            got = nodes.set_index("node")

            def walk(path, node):
                feature, cut, count, value = want.pop(path)
                one = got.loc[node]
                assert (one["feature"], one["n"]) == (feature, count) and one["value"] == pytest.approx(value)
                assert one["cut"] == pytest.approx(cut)
                if feature >= 0:
                    walk(path + "0", int(child(node, 0)))
                    walk(path + "1", int(child(node, 1)))

            walk("1", 1)
            assert not want


def test_bootstrap_draws_have_mean_and_variance_one():
    times = drawn(42, 3, np.arange(-50_000, 50_000))
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03


def test_all_nodes_of_a_level_are_split_together(monkeypatch):
    """The cuts of one feature are drawn for a whole level at once, not for each node."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2000, 3)), rng.integers(-100, 100, 2000).astype(float)
    calls, plain = [], tree_nodes.cut_points
    monkeypatch.setattr(tree_nodes, "cut_points", lambda *args: calls.append(len(args[0])) or plain(*args))
    spec = dict(numeric=3, widths=[], min_leaf=1, max_depth=None, seed=42, mean=0.0)
    nodes = tree_nodes.grow(x, y, 0, 1, 0, 0, spec)
    assert len(nodes) > 3000 and len(calls) < 300


def test_rows_travel_as_short_records_without_loss():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 90, 500), rng.integers(0, 9000, 500), 150.0 * rng.integers(1, 10**5, 500), rng.normal(size=500), np.full(500, -0.0)])
    x[0, 3] = np.nan
    y = rng.normal(size=500)
    rows = tree_nodes.narrowed(x, y)
    assert tree_nodes.kinds_of(rows) == "|i1,<i2,<f4,<f8,<f4,<f8"
    other = tree_nodes.narrowed(x[:9] * 1000 + 0.1, y[:9])
    got, label = tree_nodes.widened([tree_nodes.kinds_of(r) for r in (rows, other)], [rows.tobytes(), other.tobytes()])
    assert got.tobytes() == np.concatenate([x, x[:9] * 1000 + 0.1]).tobytes() and label.tobytes() == np.r_[y, y[:9]].tobytes()


@pytest.mark.parametrize("exact", [True, False])
def test_a_row_with_its_number_of_draws_counts_as_its_repeats(exact):
    rng = np.random.default_rng(4)
    x, times = np.column_stack([rng.integers(0, 50, 2000), rng.normal(size=2000), rng.integers(0, 6, 2000)]).astype(float), rng.integers(1, 5, 2000)
    spec = dict(numeric=2, widths=[5], min_leaf=3, max_depth=None, seed=5, mean=0.0, grid=2.0**20, exact=exact, bootstrap=True)
    y = tree_nodes.centred(rng.normal(size=2000), spec)
    once = tree_nodes.grow(x, y, 0, 1, 0, 0, spec, times.astype(np.uint8))
    again = tree_nodes.grow(np.repeat(x, times, axis=0), np.repeat(y, times), 0, 1, 0, 0, spec)
    assert len(once) > 100 and once.equals(again)


def test_a_table_that_fits_a_task_is_not_cut_by_passes_over_all_rows(train, model, monkeypatch):
    monkeypatch.setattr(ExtraTrees, "_split", lambda *_: pytest.fail("a pass over all rows"))
    assert same(model, ExtraTrees(NUMERIC, CATEGORICAL, LOG_RPM, trees=2).fit(train))


def test_codes_are_counted_alike_however_many_cells_there_are():
    rng = np.random.default_rng(6)
    node, value, y, times = rng.integers(0, 40, 900), rng.integers(0, 9, 900).astype(float), rng.integers(-9, 9, 900).astype(float), rng.integers(1, 4, 900)
    for t in (None, times):
        few, many = (tree_nodes._cells(node, value, 8, size, y, t) for size in (40, 10**9))
        order = np.lexsort((value, node))
        kept = order[value[order] < 8]
        for got in (few, many):
            assert all(np.array_equal(a, b) for a, b in zip(got, tree_nodes._sums(node[kept], value[kept], y[kept], None if t is None else t[kept])))


def test_a_batch_passes_through_the_driver_in_pieces_and_leaves_it(train, monkeypatch):
    fitted = fit(train, trees=5)
    want = sorted(fitted.transform(train).select("load_id", "prediction").collect())
    size, gone = max(fitted._sizes.values()), []
    monkeypatch.setattr(extratrees, "BATCH_NODES", 2 * size)
    monkeypatch.setattr(extratrees, "PIECE_NODES", 1)
    from pyspark.core.broadcast import Broadcast

    plain = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *more: gone.append(len(self.value)) or plain(self, *more))
    scored = fitted.transform(train)
    again = fitted.transform(train)
    assert gone and set(gone) == {1}
    for got in (scored, again):
        assert sorted(got.select("load_id", "prediction").collect()) == want


def test_a_task_sends_one_line_for_each_value_of_a_node_and_numbers_values_once_for_all_trees(monkeypatch):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 30, 900) / 4, "c": rng.integers(0, 4, 900).astype(float), "__y": rng.integers(-9, 9, 900).astype(float)})
    slots, times = [np.sort(rng.integers(0, 3, 900)) + first for first in (0, 3)], rng.integers(1, 4, 900)
    spec = dict(numeric=1, widths=[3], mean=0.0, grid=1.0, bootstrap=True)
    places = lambda batch, x: ((s[: len(batch)], np.arange(len(batch)), times[: len(batch)]) for s in slots)
    monkeypatch.setattr(np, "lexsort", lambda *_: pytest.fail("an order for each tree"))
    got = pd.concat(Forest._folded(places, ["a", "c"], spec)([pdf[:300], pdf[300:]]))
    assert not got.duplicated(["slot", "feature", "value"]).any()
    want = {}
    for s in slots:
        for i, slot in enumerate(s.tolist()):
            for feature, name in enumerate("ac"):
                if feature == 0 or pdf[name][i] < 3:
                    n, total = want.get(at := (slot, feature, pdf[name][i]), (0, 0))
                    want[at] = n + times[i], total + times[i] * pdf["__y"][i]
    assert {(r.slot, r.feature, r.value): (r.n, r.s) for r in got.itertuples()} == want


def test_batches_are_joined_up_to_a_number_of_rows():
    parts = [pd.DataFrame({"a": np.arange(n)}) for n in (3, 4, 2, 0)]
    assert [len(p) for p in tree_nodes.together(parts, 6)] == [7, 2]
    assert list(tree_nodes.together([], 6)) == []


def test_labels_of_a_level_are_taken_once_and_finished_rows_stay_behind(monkeypatch):
    """All categories of a level count the same array of labels, which has the rows of nodes that may be split only."""
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.integers(0, 40, 900), rng.integers(0, 6, 900), rng.integers(0, 3, 900)]).astype(float)
    y = np.rint(rng.normal(0, 50, 900) + 30 * x[:, 0])
    spec = dict(numeric=1, widths=[6, 3], min_leaf=9, max_depth=None, seed=4, mean=0.0, grid=1.0)
    seen, plain = [], tree_nodes._cells
    monkeypatch.setattr(tree_nodes, "_cells", lambda node, value, width, size, y, times: seen.append((len(node), y)) or plain(node, value, width, size, y, times))
    nodes = tree_nodes.grow(x, y, 0, 1, 0, 0, spec)
    levels = list(zip(seen[::2], seen[1::2]))
    assert len(levels) > 4 and all(a[1] is b[1] for a, b in levels)
    assert all(rows == len(labels) for level in levels for rows, labels in level)
    leaf = nodes["feature"] < 0
    assert nodes.loc[leaf, "n"].sum() == 900 and nodes.loc[leaf, "n"].min() >= 9
    sizes = [level[0][0] for level in levels]
    assert sizes[0] == 900 and sizes[-1] < 200
