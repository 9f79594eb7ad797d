"""Random forest: bootstrap trees with the best of all cuts, grown by the extra trees' levels.

A node of more than ``finish_rows`` sampled rows is cut by Spark: its rows are folded to one line for
each value of each feature, and prefix sums over those lines give the gain of every cut. Smaller
nodes are grown to their leaves in one task each. Neither changes the trees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanewise.operators.extratrees import LABEL, ExtraTrees, ExtraTreesModel
from lanewise.operators.tree_nodes import LEAST_GAIN, _cells, centred, together
from lanewise.session import write_table

BUCKETS = 256  # parts of a feature's range whose prefix sums are taken apart
FOLD_ROWS = 100_000  # rows that a task folds at once, some 200 bytes each


class Forest(ExtraTrees):
    """Trees over all features, each on its own bootstrap sample, without a limit of depth or of cuts.

    A row is in a tree's sample as often as a Poisson(1) draw hashed from (seed, tree, row) says, the
    row being all its columns: the same sample under any partitioning, and the same draws for rows
    that are equal in every column. ``min_leaf`` counts sampled rows. A cut lies midway between two
    neighbouring values; of equal gains the first feature and the lowest cut win.
    """

    bootstrap, exact = True, True

    def __init__(self, *args, min_leaf: int = 1, finish_rows: int = 200_000, **more):
        super().__init__(*args, min_leaf=min_leaf, finish_rows=finish_rows, **more)

    @staticmethod
    def _folded(places, columns: list[str], spec: dict):
        """Function from batches to sampled rows and label sum for each slot, feature and value; a category's value is its code.

        A feature's values are numbered once for all trees, so that each tree only counts.
        """
        k, widths = spec["numeric"], spec["widths"]

        def folded(batches):
            for pdf in together(batches, FOLD_ROWS):
                x, y = pdf[columns].to_numpy(np.float64), centred(pdf[LABEL].to_numpy(np.float64), spec)
                numbered = [np.unique(values, return_inverse=True) for values in x.T]
                for at, order, times in places(pdf, x):
                    first, span, sums = at[0], int(at[-1] - at[0]) + 1, y[order] * times
                    lines = []
                    for feature, (values, number) in enumerate(numbered):
                        slot, found, n, s = _cells(at - first, number[order], len(values), span, sums, times)
                        one = pd.DataFrame({"slot": slot + first, "feature": feature, "value": values[found], "n": n.astype(float), "s": s})
                        lines.append(one if feature < k else one[one["value"] < widths[feature - k]])
                    yield pd.concat(lines)

        return folded

    def _split(self, ready: DataFrame, columns: list[str], spec: dict, done: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        """Best split of each open node; ``chunk``'s index is the slot number."""
        spark, k = ready.sparkSession, spec["numeric"]
        router = spark.sparkContext.broadcast(self._router(done, chunk))
        folded = self._folded(self._places(router, spec), columns, spec)
        lines = ready.mapInPandas(folded, "slot long, feature long, value double, n double, s double")
        lines = write_table(lines.groupBy("slot", "feature", "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "values")
        router.unpersist()
        cuts = _prefix_sums(lines.where(F.col("feature") < k)).unionByName(lines.where(F.col("feature") >= k).withColumnRenamed("value", "cut"))

        totals = chunk[["n", "total"]].rename(columns={"n": "all_n", "total": "all_s"}).astype({"all_n": float})
        totals = spark.createDataFrame(totals.rename_axis("slot").reset_index(), "slot long, all_n double, all_s double")
        rest_n, rest_s = F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s")
        # The same operations in the same order as in a task, on exact sums: the same gains.
        parts = F.col("s") * F.col("s") / F.col("n") + rest_s * rest_s / rest_n
        gain = parts - F.col("all_s") * F.col("all_s") / F.col("all_n")
        order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c"), "n", "s")
        best = (
            cuts.join(F.broadcast(totals), "slot")  # at most nodes_per_pass rows
            .where((F.col("n") >= self.min_leaf) & (rest_n >= self.min_leaf))
            .withColumn("gain", gain)
            .where(F.col("gain") > parts * LEAST_GAIN)
            .groupBy("slot")
            .agg(F.max(order).alias("b"))
            .select("slot", (-F.col("b.f")).alias("feature"), (-F.col("b.c")).alias("cut"), "b.n", "b.s")
            .toPandas()  # one line per open node of this pass
            .set_index("slot")
        )
        is_category = best["feature"] >= k
        n, total = chunk["n"].loc[best.index], chunk["total"].loc[best.index]
        chosen = best[["feature", "cut"]].assign(
            is_category=is_category,
            cut=best["cut"] + 0.0,
            n_left=np.where(is_category, n - best["n"], best["n"]),
            s_left=np.where(is_category, total - best["s"], best["s"]),
        )
        return chunk.join(chosen)


def _prefix_sums(lines: DataFrame) -> DataFrame:
    """(slot, feature, cut, n, s): rows and label sum at or below each cut between neighbouring values.

    A feature's range is cut in equal parts; sums run within a part, over one line for each value, and
    over the parts, so no task holds all values of a node.
    """
    at = ["slot", "feature"]
    part = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
    ranges = lines.groupBy(*at).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi")
    placed = lines.join(ranges, at).select(*at, part.cast("int").alias("part"), "value", "n", "s")
    whole = placed.groupBy(*at, "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("value").alias("value"))
    over = W.partitionBy(*at).orderBy("part")
    below = over.rowsBetween(W.unboundedPreceding, -1)
    before = whole.select(
        *at,
        "part",
        F.coalesce(F.sum("n").over(below), F.lit(0.0)).alias("n_before"),
        F.coalesce(F.sum("s").over(below), F.lit(0.0)).alias("s_before"),
        F.lead("value").over(over).alias("after"),
    )
    inside = W.partitionBy(*at, "part").orderBy("value")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    running = placed.select(*at, "part", "value", F.sum("n").over(upto).alias("n"), F.sum("s").over(upto).alias("s"), F.lead("value").over(inside).alias("next"))
    joined = running.join(before, [*at, "part"]).withColumn("next", F.coalesce("next", "after")).where("next IS NOT NULL")
    middle = F.col("value") + (F.col("next") - F.col("value")) / 2
    cut = F.when(middle >= F.col("next"), F.col("value")).otherwise(middle)
    return joined.select(*at, cut.alias("cut"), (F.col("n") + F.col("n_before")).alias("n"), (F.col("s") + F.col("s_before")).alias("s"))


#: A forest predicts, and is stored, as extra trees are.
ForestModel = ExtraTreesModel
