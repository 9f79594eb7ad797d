"""Exact quantiles and average ranks that no single task has to hold.

Spark's own ``percentile`` is exact, but it keeps every distinct value of a group in one
task's memory. Here only counts move: each round scans the input once for all columns, groups
and ranks, counts the rows of each cell on the map side, and keeps the cells that hold a wanted
rank. Cells are cut again until one holds at most ``CELL_ROWS`` rows or a single value; only
then are its values put in order. The plan is the same at every size, only the rounds differ.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lanewise.functions.sizing import null_safe
from lanewise.session import write_table

BUCKETS = 4096
CELL_ROWS = 100_000  # rows of a cell that one task may put in order
CELLS_PER_E = 256  # cells of the first round while a value grows e-fold
FIRST_CELLS = 1_000_000  # beyond the number of any finite value's cell (some 182,000)


def _doubles(values: Iterable[float]) -> Column:
    """Constant array; one literal instead of one call to the JVM per element."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _splitters(value: str, buckets: int) -> Column:
    return F.percentile_approx(value, _doubles([i / buckets for i in range(1, buckets)]), 4 * buckets)


def _bucket(value: Column, splitters: Column, buckets: int) -> Column:
    """Number of splitters below the value, by bisection; ``buckets`` is a power of two."""
    steps = [buckets >> i for i in range(1, buckets.bit_length())]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(splitters, at + step - 1) < value, at + step).otherwise(at),
    )


def _running(groups: list[str], order: str):
    window = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    return window.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def _first_cell(v: Column) -> Column:
    """Cell of a value, never falling as the value grows: logarithmic, infinities and NaN apart."""
    size = F.signum(v) * F.log1p(F.abs(v)) * CELLS_PER_E
    bounded = F.least(F.greatest(size, F.lit(-float(FIRST_CELLS))), F.lit(float(FIRST_CELLS)))
    return F.when(F.isnan(v), FIRST_CELLS + 1).otherwise(F.floor(bounded).cast("int"))


def _locate(counts: DataFrame, at: list[str], ranks: Column) -> DataFrame:
    """One row for each wanted rank of the counted parts of a cell: its part, and its rank in there."""
    before = F.col("__upto") - F.col("__n")
    held = F.filter(ranks, lambda r: (r["rank"] >= before) & (r["rank"] < F.col("__upto")))
    upto = counts.withColumn("__upto", F.sum("__n").over(_running(at, "__from")))
    return upto.select("*", F.inline(held)).withColumn("rank", F.col("rank") - before)


def _inside(facts: DataFrame, cells: DataFrame, at: list[str]) -> DataFrame:
    """The values in ``cells``, which is a small stored table: Spark broadcasts it as far as its size allows."""
    cells = cells.withColumnsRenamed({k: f"{k}t" for k in [*at, "__cell"]})
    same = null_safe(facts, cells, {k: f"{k}t" for k in [*at, "__cell"]})
    return facts.join(cells, same & F.col("__v").between(F.col("__from"), F.col("__to"))).select(*at, "__cell", "__from", "__to", "__v")


def _cells(located: DataFrame, at: list[str]) -> tuple[DataFrame, DataFrame]:
    """The cells of the wanted ranks, and with each cell the ranks it holds (two for each probability at most)."""
    cells = located.select(*at, "__cell", "__from", "__to").distinct()
    ranks = located.groupBy(*at, "__from").agg(F.collect_list(F.struct("i", "side", "rank", "part")).alias("__ranks"))
    return cells, ranks.withColumnsRenamed({k: f"{k}t" for k in [*at, "__from"]})


def _narrow(facts: DataFrame, located: DataFrame, at: list[str], buckets: int) -> DataFrame:
    """The same ranks in cells of about ``1 / buckets`` of the width; both ends of a cell part at least."""
    cells, ranks = _cells(located, at)
    step = F.least(F.floor((F.col("__v") - F.col("__from")) / (F.col("__to") - F.col("__from")) * buckets), F.lit(buckets - 1))
    parts = _inside(facts, cells, at).groupBy(*at, "__cell", F.col("__from").alias("__whole"), step.alias("__step")).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__from"), F.max("__v").alias("__to")
    )
    return _ranked(parts, ranks, [*at, "__whole"])


def _ranked(parts: DataFrame, ranks: DataFrame, at: list[str]) -> DataFrame:
    """Ranks of whole cells located in their parts; ``__whole`` is the lowest value of the cell."""
    keys = {k: "__fromt" if k == "__whole" else f"{k}t" for k in at}
    return _locate(parts.join(ranks, null_safe(parts, ranks, keys)).drop(*keys.values()), at, F.col("__ranks"))


def column_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(by..., one array<double> for each column of ``wanted``), linearly interpolated, aligned with its probabilities.

    Missing values are ignored; a group without values has no row, a column without values in a
    group is null. A missing group key is a group of its own, NaN the largest value. The input is
    scanned once a round, so give a stored table where computing it is dear. Between rounds the
    located ranks are stored: a row for each group, column and rank.
    """
    by, columns = list(by), list(wanted)
    keys = [f"__g{i}" for i in range(len(by))]
    at = [*keys, "__c"]
    entries = [F.struct(F.lit(c).alias("__c"), F.col(name).cast("double").alias("__v")) for c, name in enumerate(columns)]
    facts = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.inline(F.array(*entries))).where("__v IS NOT NULL")
    facts = facts.withColumn("__cell", _first_cell(F.col("__v")))

    counts = facts.groupBy(*at, "__cell").agg(F.count("*").alias("__n"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
    sized = counts.withColumn("__all", F.sum("__n").over(W.partitionBy(*at)))
    fields = [*at, "__cell", "__n", "__from", "__to", "i", "side", "rank", "part"]
    located = write_table(_locate(sized, at, _wanted_ranks([wanted[c] for c in columns])).select(*fields), "quantile-cells")
    wide = F.col("__from") < F.col("__to")
    open_ = wide & (F.col("__n") > cell_rows)
    largest = _largest(located, wide)
    while largest > cell_rows:
        finer = _narrow(facts, located.where(open_), at, buckets).select(*fields)
        located = write_table(located.where(~open_).unionByName(finer), "quantile-cells")
        largest = _largest(located, wide)

    points = located.where(~wide).select(*at, "i", "side", "part", F.col("__from").alias("__v"))
    if largest:
        cells, ranks = _cells(located.where(wide), at)
        whole = _inside(facts, cells, at).groupBy(*at, F.col("__from").alias("__whole"), "__v").agg(F.count("*").alias("__n"))
        found = _ranked(whole.withColumn("__from", F.col("__v")), ranks, [*at, "__whole"])
        points = points.unionByName(found.select(*at, "i", "side", "part", "__v"))

    # Two entries for each column and probability, the lower first.
    all_points = F.array_sort(F.collect_list(F.struct("__c", "i", "side", "__v", "part")))
    grouped = points.groupBy(*keys).agg(all_points.alias("__points")).where(F.size("__points") > 0)
    return grouped.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *[_interpolated(c, len(wanted[name])).alias(name) for c, name in enumerate(columns)])


def _largest(located: DataFrame, wide: Column) -> int:
    """Rows of the largest cell of several values; 0 if there is none."""
    return located.where(wide).agg(F.coalesce(F.max("__n"), F.lit(0)).alias("n")).first()["n"]


def _wanted_ranks(probs: list[Sequence[float]]) -> Column:
    """Both neighbours of each wanted position among the ``__all`` values of column ``__c``."""
    ranks = []
    for i in range(max(map(len, probs))):
        of_column = [F.when(F.col("__c") == c, float(p[i])) for c, p in enumerate(probs) if i < len(p)]
        position = F.coalesce(*of_column) * (F.col("__all") - 1)
        for side, rank in enumerate((F.floor(position), F.ceil(position))):
            part = position - F.floor(position)
            ranks.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), part.alias("part")))
    return F.array(*ranks)


def _interpolated(column: int, probs: int) -> Column:
    own = F.filter("__points", lambda x: x["__c"] == column)

    def value(i: Column) -> Column:
        lower, upper = F.get(own, i * 2), F.get(own, i * 2 + 1)
        return F.when(lower["__v"] == upper["__v"], lower["__v"]).otherwise(lower["__v"] + (upper["__v"] - lower["__v"]) * lower["part"])

    return F.when(F.size(own) > 0, F.transform(F.sequence(F.lit(0), F.lit(probs - 1)), value))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(by..., quantiles: array<double>) of one column, as ``column_quantiles`` gives them."""
    found = column_quantiles(df.select(*by, F.col(value).alias("quantiles")), {"quantiles": list(probs)}, by, buckets, cell_rows)
    return found.select(*by, "quantiles")


def grouped_stats(
    df: DataFrame,
    by: Sequence[str],
    aggs: Sequence[Column],
    quantiles: dict[str, tuple[str, float]],
) -> DataFrame:
    """Aggregates plus exact quantiles, ``{alias: (column, probability)}``.

    The quantiles of all columns come from one ``column_quantiles`` and are joined to the other
    aggregates, one row per group on both sides.
    """
    by = list(by)
    columns = {c: [p for d, p in quantiles.values() if d == c] for c, _ in quantiles.values()}
    inputs = df.select(*[F.col(k).alias(f"__{k}") for k in by], *[F.col(c).alias(f"__q{i}") for i, c in enumerate(columns)])
    q = column_quantiles(inputs, {f"__q{i}": p for i, p in enumerate(columns.values())}, [f"__{k}" for k in by])
    place = {c: iter(range(len(p))) for c, p in columns.items()}
    values = [F.get(f"__q{list(columns).index(c)}", F.lit(next(place[c]))).alias(a) for a, (c, _) in quantiles.items()]
    out = df.groupBy(*by).agg(*aggs)
    if not by:
        return out.withColumn("__q", q.select(F.struct(*values)).scalar()).select("*", *[F.col("__q")[a].alias(a) for a in quantiles]).drop("__q")
    q = q.select(*[f"__{k}" for k in by], *values)
    return out.join(q, null_safe(out, q, {k: f"__{k}" for k in by}), "left").drop(*[f"__{k}" for k in by])


def average_ranks(counts: DataFrame, value: str, count: str = "n", buckets: int = BUCKETS) -> DataFrame:
    """(value, rank): 1-based rank, ties share their mean rank.

    ``counts`` has one row per distinct value. The running total is taken inside buckets of
    near-equal size and shifted by the totals of the lower buckets, so no window is global.
    """
    facts = counts.select(F.col(value).alias("__v"), F.col(count).alias("__n")).where("__v is not null")
    splitters = facts.agg(_splitters("__v", buckets).alias("__s")).first()["__s"]  # ``buckets`` - 1 numbers
    placed = facts.withColumn("__b", _bucket(F.col("__v"), _doubles(splitters), buckets) if splitters else F.lit(0))
    totals = placed.groupBy("__b").agg(F.sum("__n").alias("__t"))
    offsets = F.broadcast(  # at most ``buckets`` rows
        totals.select(
            F.col("__b").alias("__bo"),
            (F.sum("__t").over(_running([], "__b")) - F.col("__t")).alias("__before"),
        )
    )
    inside = placed.withColumn("__upto", F.sum("__n").over(_running(["__b"], "__v")))
    first = F.col("__before") + F.col("__upto") - F.col("__n") + 1
    return inside.join(offsets, F.col("__b") == F.col("__bo")).select(
        F.col("__v").alias(value), (first + (F.col("__n") - 1) / 2.0).alias("rank")
    )
