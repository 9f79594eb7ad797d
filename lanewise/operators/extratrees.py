"""Extremely randomised regression trees, grown level by level over distributed rows.

Every pass scans the prepared rows once: each task routes its rows through the trees grown so
far and emits partial sums per open node, which Spark adds up by key. The driver only sees one
line per open node. Once a node has at most ``finish_rows`` rows, it is grown to its leaves in one task; such groups are bounded by that number, and
their nodes, nearly all of a forest, are written by these tasks to the shared folder. Cuts
are hashed from (seed, tree, node, feature), so neither the partitioning nor ``finish_rows``
changes the trees.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from copy import copy
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators.prep import Imputer, ImputerModel, code, indexer, load_fill, save_fill
from lanewise.operators import tree_nodes
from lanewise.operators.tree_nodes import LEAST_GAIN, NODE_COLUMNS, centred, child, cut_points, draw, drawn, grow, kinds_of, narrowed, pack, packed_row, route, widened
from lanewise.schema import SEED
from lanewise.session import write_table

# Tasks get these helpers with the closure, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(tree_nodes)

LABEL, ROW = "__y", "__row"
NODE_SCHEMA = "tree int, node long, parent long, feature int, is_category boolean, cut double, n long, value double"
DENSE_CELLS = 8_000_000
BATCH_NODES = 1_000_000  # nodes of the trees that score in one pass, some 40 bytes each; one tree is the least
PIECE_NODES = 50_000  # nodes of the trees that pass through the driver at once; one tree is the least


class ExtraTrees:
    """All rows in every tree, one random cut per number, one-against-rest per category.

    Trees grow without a limit of depth unless ``max_depth`` (levels of splits) sets one.
    With ``max_nodes``, a forest beyond it raises. The driver holds only the nodes that Spark cuts, of more
    than ``finish_rows`` rows each; the node table is in the shared folder. Labels are put on a grid on which
    sums are exact, so the trees are the same bit for bit under any partitioning.
    """

    bootstrap, exact = False, False

    def __init__(
        self,
        numeric: Sequence[str],
        categorical: Sequence[str],
        label: str,
        trees: int = 100,
        min_leaf: int = 20,
        max_depth: int | None = None,
        seed: int = SEED,
        finish_rows: int = 200_000,
        nodes_per_pass: int = 20_000,
        max_nodes: int | None = None,
    ):
        self.numeric, self.categorical, self.label = list(numeric), list(categorical), label
        self.trees, self.min_leaf, self.max_depth, self.seed = trees, min_leaf, max_depth, seed
        self.finish_rows, self.nodes_per_pass, self.max_nodes = finish_rows, nodes_per_pass, max_nodes

    def fit(self, train: DataFrame) -> "ExtraTreesModel":
        imputer = Imputer(self.numeric, self.categorical).fit(train)
        filled = imputer.transform(train.withColumn(ROW, F.xxhash64(*train.columns)))
        codes = Pipeline(stages=[indexer(self.categorical)] if self.categorical else []).fit(filled)
        columns = [*self.numeric, *[code(c) for c in self.categorical]]
        ready = codes.transform(filled).select(*columns, *[ROW] * self.bootstrap, F.col(self.label).alias(LABEL)).where(
            F.col(LABEL).isNotNull()
        )
        cores = train.sparkSession.sparkContext.defaultParallelism
        if ready.rdd.getNumPartitions() < cores:  # a small input in one or two files
            ready = ready.repartition(cores)
        ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            widths = [len(v) for v in codes.stages[0].labelsArray] if self.categorical else []
            nodes = self._grow(ready, columns, widths)
        finally:
            ready.unpersist()
        return ExtraTreesModel(imputer, codes, columns, nodes)

    def _grow(self, ready: DataFrame, columns: list[str], widths: list[int]) -> DataFrame:
        """The node table, stored."""
        n, mean, low, high = ready.agg(F.count("*"), F.avg(LABEL), F.min(LABEL), F.max(LABEL)).first()
        if not n:
            raise ValueError("no labelled rows to fit on")
        widest = max(high - mean, mean - low)
        grid = 2.0 ** math.floor(51 - math.log2(n * widest) - 2 * self.bootstrap) if widest > 0 else 1.0
        total = ready.agg(F.sum(F.rint((F.col(LABEL) - F.lit(mean)) * F.lit(grid))) / F.lit(grid)).first()[0]
        spec = dict(
            numeric=len(self.numeric),
            widths=widths,
            min_leaf=self.min_leaf,
            max_depth=self.max_depth,
            seed=self.seed,
            mean=mean,
            grid=grid,
            exact=self.exact,
            bootstrap=self.bootstrap,
        )
        # Node table so far; ``total`` is the sum of the centred label.
        done = pd.DataFrame(columns=NODE_COLUMNS)
        level = pd.DataFrame({"tree": np.arange(self.trees), "node": np.int64(1), "parent": np.int64(0), "n": n, "total": total})
        if self.bootstrap:
            level = level.drop(columns=["n", "total"]).merge(self._sampled(ready, spec), on="tree")
        small, depth = [], -1
        while len(level):
            depth += 1
            wide = (level["n"] >= 2 * self.min_leaf) & (self.max_depth is None or depth < self.max_depth)
            fits = wide & (level["n"] <= self.finish_rows)
            small.append(level[fits].assign(depth=depth))
            level, wide = level[~fits], wide[~fits]
            done = self._add(done, self._leaves(level[~wide], mean))
            level = level[wide]
            children = []
            for start in range(0, len(level), self.nodes_per_pass):
                chunk = level.iloc[start : start + self.nodes_per_pass].sort_values(["tree", "node"])
                split = self._split(ready, columns, spec, done, chunk.reset_index(drop=True))
                is_leaf = split["feature"].isna()
                done = self._add(done, self._leaves(split[is_leaf], mean))
                split = split[~is_leaf]
                inner = split.assign(value=mean + split["total"] / split["n"])
                done = self._add(done, inner[NODE_COLUMNS])
                children += [
                    split.assign(node=child(split["node"], 0), parent=split["node"], n=split["n_left"], total=split["s_left"]),
                    split.assign(
                        node=child(split["node"], 1),
                        parent=split["node"],
                        n=split["n"] - split["n_left"],
                        total=split["total"] - split["s_left"],
                    ),
                ]
            level = pd.concat(children)[["tree", "node", "parent", "n", "total"]] if children else level.iloc[:0]
        small, parts = pd.concat(small), []
        if len(done):
            top = done.astype({"tree": "int32", "node": "int64", "parent": "int64", "feature": "int32", "is_category": bool, "n": "int64"})
            parts.append(write_table(ready.sparkSession.createDataFrame(top, NODE_SCHEMA), "top-nodes"))
        if len(small):
            parts.append(write_table(self._finish(ready, columns, spec, done, small), "nodes"))
            if self.max_nodes is not None:
                self._limit(parts[-1].count() + len(done))
        return parts[0].unionAll(parts[1]) if len(parts) > 1 else parts[0]

    def _limit(self, nodes: int) -> None:
        if self.max_nodes is not None and nodes > self.max_nodes:
            raise ValueError(f"the forest exceeds {self.max_nodes} nodes: raise min_leaf or lower max_depth")

    def _add(self, done: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        self._limit(len(done) + len(more))
        return pd.concat([done, more[NODE_COLUMNS]], ignore_index=True) if len(done) else more[NODE_COLUMNS].copy()

    @staticmethod
    def _leaves(level: pd.DataFrame, mean: float) -> pd.DataFrame:
        return level.assign(feature=-1, is_category=False, cut=0.0, value=mean + level["total"] / level["n"])

    def _router(self, done: pd.DataFrame, targets: pd.DataFrame) -> list[tuple[int, dict, np.ndarray]]:
        """(tree, arrays, target number per position or -1) for every tree with a target node.

        Only the paths down to the targets are kept, so a row stops as soon as it leaves them.
        """
        out = []
        inner = {t: g for t, g in done[done["feature"] >= 0].groupby("tree")} if len(done) else {}
        shape = ["node", "feature", "is_category", "cut", "value"]
        for tree, wanted in targets.groupby("tree"):
            ends = wanted["node"].to_numpy(np.int64)
            above, up = [], np.setdiff1d(wanted["parent"].to_numpy(np.int64), [0])
            if len(up):
                known = inner[tree].sort_values("node")
                ids, parents = known["node"].to_numpy(np.int64), known["parent"].to_numpy(np.int64)
            while len(up):
                above.append(up)
                up = np.setdiff1d(parents[np.searchsorted(ids, up)], [0])
            path = np.unique(np.concatenate(above)) if above else ends[:0]
            tips = np.setdiff1d(np.concatenate([child(path, 0), child(path, 1), [1]]), path)
            tips = pd.DataFrame({"node": tips, "feature": -1, "is_category": False, "cut": 0.0, "value": 0.0})
            if len(path):
                kept = inner[tree]
                tips = pd.concat([kept.loc[kept["node"].isin(path), shape], tips])
            packed = pack(tips)
            number = np.full(len(packed["ids"]), -1, dtype=np.int64)
            number[np.searchsorted(packed["ids"], ends)] = wanted.index.to_numpy()
            out.append((tree, packed, number))
        return out

    def _sampled(self, ready: DataFrame, spec: dict) -> pd.DataFrame:
        """(tree, n, total) of the rows that each tree's sample has; a tree without rows is left out."""
        trees = self.trees

        def run(batches):
            for pdf in batches:
                y = centred(pdf[LABEL].to_numpy(np.float64), spec)
                times = [drawn(spec["seed"], t, pdf[ROW].to_numpy()) for t in range(trees)]
                yield pd.DataFrame({"tree": np.arange(trees), "n": [int(w.sum()) for w in times], "total": [float(w @ y) for w in times]})

        sums = ready.mapInPandas(run, "tree long, n long, total double").groupBy("tree").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return sums.where("n > 0").orderBy("tree").toPandas()  # one line per tree

    def _places(self, router, spec: dict):
        """Function from a batch and its features to, per tree: slot of each row in slot order, the row, how often the tree's sample has it.

        Rows that the sample does not have are left out; without a bootstrap there are no numbers.
        """

        def places(pdf: pd.DataFrame, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
            for tree, packed, number in router.value:
                slot, times = number[route(packed, x)], None
                order = np.flatnonzero(slot >= 0)
                if spec["bootstrap"] and len(order):
                    times = drawn(spec["seed"], tree, pdf[ROW].to_numpy())
                    order = order[times[order] > 0]
                if len(order):
                    at = slot[order]
                    near = at - at.min()  # short keys are ordered in linear time
                    order = order[np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")]
                    yield slot[order], order, None if times is None else times[order]

        return places

    def _by_slot(self, router, columns: list[str], spec: dict):
        """Function from a batch and a number to, per tree: slot of each row in slot order, where each slot starts, so many features, labels.

        A row comes as often as the tree's sample has it. Each feature's values lie together.
        """
        places = self._places(router, spec)

        def rows_by_slot(pdf: pd.DataFrame, most: int) -> Iterator[tuple[np.ndarray, ...]]:
            x, y = pdf[columns].to_numpy(np.float64), centred(pdf[LABEL].to_numpy(np.float64), spec)
            features = np.ascontiguousarray(x.T[:most])
            for at, order, times in places(pdf, x):
                if times is not None:
                    at, order = np.repeat(at, times), np.repeat(order, times)
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                yield at, starts, features.take(order, axis=1), y.take(order)

        return rows_by_slot

    def _split(
        self, ready: DataFrame, columns: list[str], spec: dict, done: pd.DataFrame, chunk: pd.DataFrame
    ) -> pd.DataFrame:
        """Best split of each open node; ``chunk``'s index is the slot number."""
        spark, k, size = ready.sparkSession, spec["numeric"], len(chunk)
        router = spark.sparkContext.broadcast(self._router(done, chunk))

        rows_by_slot = self._by_slot(router, columns, spec)

        def ranges(batches):
            lo, hi = np.full((size, k), np.inf), np.full((size, k), -np.inf)
            for pdf in batches:
                for at, starts, numbers, _y in rows_by_slot(pdf, k):
                    here = at[starts]
                    lo[here] = np.minimum(lo[here], np.minimum.reduceat(numbers, starts, axis=1).T)
                    hi[here] = np.maximum(hi[here], np.maximum.reduceat(numbers, starts, axis=1).T)
            slot, feature = np.nonzero(lo <= hi)
            yield pd.DataFrame({"slot": slot, "feature": feature, "lo": lo[slot, feature], "hi": hi[slot, feature]})

        cuts = np.zeros((size, k))
        if k:
            seen = (
                ready.mapInPandas(ranges, "slot long, feature long, lo double, hi double")
                .groupBy("slot", "feature")
                .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .toPandas()  # open nodes of this pass x numeric features
            )
            s, f = seen["slot"].to_numpy(), seen["feature"].to_numpy()
            u = draw(self.seed, chunk["tree"].to_numpy()[s], chunk["node"].to_numpy()[s], f)
            cuts[s, f] = cut_points(seen["lo"].to_numpy(), seen["hi"].to_numpy(), u)
        shared_cuts = spark.sparkContext.broadcast(cuts)
        widths = spec["widths"]

        def sides(batches):
            """Rows and label sums left of each cut, and per category: (slot, feature, code, n, s)."""
            at_cut = shared_cuts.value
            n, s = np.zeros((size, k)), np.zeros((size, k))
            dense = {j: np.zeros((2, size * w)) for j, w in enumerate(widths) if size * w <= DENSE_CELLS}
            for pdf in batches:
                for at, starts, x, y in rows_by_slot(pdf, len(columns)):
                    first = at[0]
                    span = int(at[-1] - first) + 1
                    here = at - first
                    if k:
                        slots, lengths = at[starts], np.diff(np.r_[starts, len(at)])
                        below = x[:k] <= np.repeat(at_cut[slots].T, lengths, axis=1)
                        n[slots] += np.add.reduceat(below.view(np.uint8), starts, axis=1, dtype=np.int64).T
                        s[slots] += np.add.reduceat(below * y, starts, axis=1).T
                    for j, width in enumerate(widths):
                        codes = x[k + j].astype(np.int64)
                        cell, yy = here * width + codes, y
                        if not (known := codes < width).all():
                            cell, yy = cell[known], yy[known]
                        if j in dense:
                            part = slice(first * width, (first + span) * width)
                            dense[j][0, part] += np.bincount(cell, minlength=span * width)
                            dense[j][1, part] += np.bincount(cell, weights=yy, minlength=span * width)
                        else:
                            found, where = np.unique(cell, return_inverse=True)
                            yield pd.DataFrame(
                                {
                                    "slot": found // width + first,
                                    "feature": k + j,
                                    "code": found % width,
                                    "n": np.bincount(where).astype(float),
                                    "s": np.bincount(where, weights=yy),
                                }
                            )
            slot, feature = np.nonzero(n)
            yield pd.DataFrame(
                {"slot": slot, "feature": feature, "code": 0, "n": n[slot, feature], "s": s[slot, feature]}
            )
            for j, cells in dense.items():
                at = np.flatnonzero(cells[0])
                yield pd.DataFrame(
                    {
                        "slot": at // widths[j],
                        "feature": k + j,
                        "code": at % widths[j],
                        "n": cells[0, at],
                        "s": cells[1, at],
                    }
                )

        totals = chunk[["n", "total"]].rename(columns={"n": "all_n", "total": "all_s"})
        totals = spark.createDataFrame(
            totals.astype({"all_n": float}).rename_axis("slot_t").reset_index(), "slot_t long, all_n double, all_s double"
        )
        added = (
            ready.mapInPandas(sides, "slot long, feature long, code long, n double, s double")
            .groupBy("slot", "feature", "code")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        )
        rest_n, rest_s = F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s")
        # The same operations in the same order as in a task, on exact sums: the same gains.
        parts = F.col("s") * F.col("s") / F.col("n") + rest_s * rest_s / rest_n
        gain = parts - F.col("all_s") * F.col("all_s") / F.col("all_n")
        best = (
            added.join(F.broadcast(totals), F.col("slot") == F.col("slot_t"))  # at most nodes_per_pass rows
            .where((F.col("n") >= self.min_leaf) & (rest_n >= self.min_leaf))
            .withColumn("gain", gain)
            .where(F.col("gain") > parts * LEAST_GAIN)
            .groupBy("slot")
            .agg(
                F.max(
                    F.struct(
                        "gain", (-F.col("feature")).alias("f"), (-F.col("code")).alias("c"), "n", "s"
                    )
                ).alias("b")
            )
            .select("slot", (-F.col("b.f")).alias("feature"), (-F.col("b.c")).alias("code"), "b.n", "b.s")
            .toPandas()  # one line per open node of this pass
        )
        router.unpersist()
        shared_cuts.unpersist()
        slot, feature = best["slot"].to_numpy(), best["feature"].to_numpy()
        is_category = feature >= k
        at = np.where(is_category, 0, feature)
        cut = np.where(is_category, best["code"].to_numpy(float), cuts[slot, at] if k else 0.0)
        n, total = chunk["n"].to_numpy()[slot], chunk["total"].to_numpy()[slot]
        left_n = np.where(is_category, n - best["n"].to_numpy(), best["n"].to_numpy())
        left_s = np.where(is_category, total - best["s"].to_numpy(), best["s"].to_numpy())
        chosen = pd.DataFrame(
            {"feature": feature, "is_category": is_category, "cut": cut, "n_left": left_n, "s_left": left_s}, index=slot
        )
        return chunk.join(chosen)

    def _finish(
        self, ready: DataFrame, columns: list[str], spec: dict, done: pd.DataFrame, small: pd.DataFrame
    ) -> DataFrame:
        """Grow every small node in its own group of at most ``finish_rows`` rows."""
        spark = ready.sparkSession
        small = small.sort_values(["tree", "node"]).reset_index(drop=True)
        router = spark.sparkContext.broadcast(self._router(done, small))
        address = spark.sparkContext.broadcast(small[["tree", "node", "parent", "depth"]].to_numpy(np.int64))

        places = self._places(router, spec)

        def blocks(batches):
            """Rows of one node in one batch, packed into one cell; a row travels once, with its number of draws."""
            for pdf in batches:
                x, y = pdf[columns].to_numpy(np.float64), centred(pdf[LABEL].to_numpy(np.float64), spec)
                rows = narrowed(x, y)
                kinds = kinds_of(rows)
                for at, order, times in places(pdf, x):
                    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    own = [p.tobytes() for p in np.split(rows[order], starts[1:])]
                    times = [b""] * len(starts) if times is None else [p.tobytes() for p in np.split(times.astype(np.uint8), starts[1:])]
                    yield pd.DataFrame({"slot": at[starts], "kinds": kinds, "rows": own, "times": times})

        def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = widened(pdf["kinds"].tolist(), pdf["rows"].tolist())
            times = np.frombuffer(b"".join(pdf["times"]), np.uint8) if spec["bootstrap"] else None
            tree, node, parent, depth = map(int, address.value[pdf["slot"].iloc[0]])
            return grow(x, y, tree, node, parent, depth, spec, times)

        return ready.mapInPandas(blocks, "slot long, kinds string, rows binary, times binary").groupBy("slot").applyInPandas(leaves, NODE_SCHEMA)


class ExtraTreesModel:
    """``node_table`` is a stored table of NODE_SCHEMA; trees are packed by tasks and broadcast a batch at a time."""

    def __init__(self, imputer: ImputerModel, codes: PipelineModel, columns: list[str], node_table: DataFrame):
        self.imputer, self.codes, self.columns, self.node_table = imputer, codes, columns, node_table

    @cached_property
    def nodes(self) -> pd.DataFrame:
        """The whole node table on the driver, for forests that fit there."""
        return self.node_table.toPandas().sort_values(["tree", "node"], ignore_index=True)

    @cached_property
    def _trees(self) -> DataFrame:
        grouped = self.node_table.groupBy("tree").applyInPandas(packed_row, "tree int, nodes long, packed binary")
        return write_table(grouped, "trees")

    @cached_property
    def _sizes(self) -> dict[int, int]:
        return dict(sorted(self._trees.select("tree", "nodes").collect()))  # one line for each tree

    def _runs(self, trees: list[int], most: int) -> list[list[int]]:
        """These trees in order, in runs of at most ``most`` nodes or one tree."""
        runs, held = [], most
        for tree in trees:
            held += self._sizes[tree]
            if held > most:
                runs.append([])
                held = self._sizes[tree]
            runs[-1].append(tree)
        return runs

    def _added(self, df: DataFrame, trees: list[int]) -> DataFrame:
        """``df`` with the values of these trees added to ``prediction``, tree by tree.

        They pass through the driver a piece at a time; the batch before leaves it and the executors.
        """
        for piece in self._sent:
            piece.destroy()
        self._sent.clear()
        for run in self._runs(trees, PIECE_NODES):
            found = self._trees.where(F.col("tree").between(run[0], run[-1])).select("tree", "packed").toArrow().sort_by("tree")
            self._sent.append(df.sparkSession.sparkContext.broadcast(found["packed"].to_pylist()))
        forest = tuple(self._sent)

        @F.pandas_udf("double")
        def add(parts: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
            packed = [pickle.loads(tree) for piece in forest for tree in piece.value]
            for x, total in parts:
                data, total = x.to_numpy(np.float64), total.to_numpy(np.float64, copy=True)
                for tree in packed:
                    total += tree["value"][route(tree, data)]
                yield pd.Series(total)

        return df.withColumn("prediction", add(F.struct(*self.columns), "prediction"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, the mean of the trees; other columns keep their raw values.

        Of several batches, each but the last is stored with the sums so far before the next is broadcast,
        and its trees leave the driver and the executors.
        """
        raw = [*self.imputer.numeric, *self.imputer.categorical]
        kept = df.withColumns({f"__raw_{c}": F.col(c) for c in raw})
        coded = self.codes.transform(self.imputer.transform(kept))
        batches = self._runs(list(self._sizes), BATCH_NODES)
        own = copy(self)  # each call has its own broadcasts, and the frame that it returns keeps the last of them
        own._sent = []
        scored = own._added(coded.withColumn("prediction", F.lit(0.0)), batches[0])
        for trees in batches[1:]:
            scored = own._added(write_table(scored, "scored"), trees)
        return scored.select(
            *[F.col(f"__raw_{c}").alias(c) if c in raw else F.col(c) for c in df.columns],
            (F.col("prediction") / len(self._sizes)).alias("prediction"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.codes.write().overwrite().save(f"{path}/codes")
        save_fill(spark, self.imputer, path)
        self.node_table.write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ExtraTreesModel":
        imputer = load_fill(spark, path)
        columns = [*imputer.numeric, *[code(c) for c in imputer.categorical]]
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")
        return ExtraTreesModel(imputer, PipelineModel.load(f"{path}/codes"), columns, nodes)
