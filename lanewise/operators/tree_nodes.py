"""Numpy helpers used inside tasks: reproducible draws, node routing, growing a small node."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

NODE_COLUMNS = ["tree", "node", "parent", "feature", "is_category", "cut", "n", "value"]


#: Share of the sums of squares that a split must gain; less is rounding.
LEAST_GAIN = 1e-12


def _scramble(x: np.ndarray) -> np.ndarray:
    # The published 64-bit splitmix finaliser.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(seed: int, tree, node, feature) -> np.ndarray:
    """Uniform in [0, 1) from (seed, tree, node, feature): the same under any partitioning."""
    x = np.asarray(seed, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in (tree, node, feature):
            x = _scramble((x ^ np.asarray(part, dtype=np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def child(node, side) -> np.ndarray:
    """Id of the left (0) or right (1) child: hashed from the path, so that depth has no limit. The root is 1."""
    with np.errstate(over="ignore"):
        x = np.asarray(node, dtype=np.uint64) * np.uint64(2) + np.asarray(side, dtype=np.uint64)
        return (_scramble(x + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype(np.int64)


def centred(y: np.ndarray, spec: dict) -> np.ndarray:
    """Labels less their mean, on a grid so coarse that float sums of them are exact in any order."""
    return np.rint((y - spec["mean"]) * spec["grid"]) / spec["grid"]


#: Chances of at most 0, 1, 2... draws of a row, Poisson with mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def drawn(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample: a Poisson(1) count from (seed, tree, row)."""
    keys = np.ascontiguousarray(rows, np.int64).view(np.uint64)
    return np.searchsorted(POISSON, draw(seed, tree, keys, 1 << 32), side="right")


def between(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Middle of two neighbouring values; the lower one where the middle rounds up to the higher one."""
    cut = lo + (hi - lo) / 2
    return np.where(cut >= hi, lo, cut)


def cut_points(lo: np.ndarray, hi: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Uniform cut in [lo, hi); a constant feature gets its own value, which separates nothing."""
    cut = lo + u * (hi - lo)
    return np.where(cut >= hi, lo, cut)


def pack(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """One tree as flat arrays, by node id."""
    nodes = nodes.sort_values("node")
    ids = nodes["node"].to_numpy(np.int64)
    return {
        "ids": ids,
        "feature": nodes["feature"].to_numpy(np.int32),
        "is_category": nodes["is_category"].to_numpy(bool),
        "cut": nodes["cut"].to_numpy(np.float64),
        "value": nodes["value"].to_numpy(np.float64),
        "root": int(np.searchsorted(ids, 1)),
        # Places of the children, only read for inner nodes.
        "left": np.searchsorted(ids, child(ids, 0)).astype(np.int32),
        "right": np.searchsorted(ids, child(ids, 1)).astype(np.int32),
    }


def packed_row(nodes: pd.DataFrame) -> pd.DataFrame:
    """One tree as one row: its number, its nodes, its arrays."""
    return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "nodes": len(nodes), "packed": [pickle.dumps(pack(nodes))]})


def together(batches: Iterable[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches, joined until they have ``rows`` rows."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def route(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Position of each row's terminal node."""
    cells, width = np.ascontiguousarray(x).ravel(), x.shape[1]
    at = np.zeros(len(x), dtype=np.int32)
    rows = np.arange(len(x))
    here, base = np.full(len(x), tree["root"], dtype=np.int32), rows * width
    while True:
        feature = tree["feature"].take(here)
        live = np.flatnonzero(feature >= 0)
        if len(live) < len(here):
            at[rows] = here
            rows, here, base, feature = rows[live], here[live], base[live], feature[live]
        if not len(rows):
            return at
        v, cut = cells.take(base + feature), tree["cut"].take(here)
        right = np.where(tree["is_category"].take(here), v == cut, v > cut)
        here = np.where(right, tree["right"].take(here), tree["left"].take(here))


def _first_best(best: dict, node: np.ndarray, feature: int, cut, n, s, all_n: np.ndarray, all_s: np.ndarray, min_leaf: int) -> None:
    """Takes into ``best``, per node, the first option that gains more than those before; options come by node, then by cut."""
    rest_n, rest_s = all_n[node] - n, all_s[node] - s
    legal = (n >= min_leaf) & (rest_n >= min_leaf)
    node, cut, n, s, rest_n, rest_s = node[legal], cut[legal], n[legal], s[legal], rest_n[legal], rest_s[legal]
    if not len(node):
        return
    parts = s * s / n + rest_s * rest_s / rest_n
    gain = parts - all_s[node] * all_s[node] / all_n[node]
    gain = np.where(gain > parts * LEAST_GAIN, gain, -1.0)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    top = np.maximum.reduceat(gain, starts)
    at = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[starts, len(node)])))
    at = at[np.r_[True, node[at][1:] != node[at][:-1]]]  # the first of equal gains
    at = at[gain[at] > best["gain"][node[at]]]
    for name, values in (("gain", gain), ("cut", cut)):
        best[name][node[at]] = values[at]
    best["feature"][node[at]] = feature


def _sums(node: np.ndarray, value: np.ndarray, y: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(node, value, rows, label sum) of each value of each node, by node, then by value; the rows are in that order."""
    starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (value[1:] != value[:-1])])
    n = np.diff(np.r_[starts, len(node)]) if times is None else np.add.reduceat(times, starts)
    return node[starts], value[starts], n, np.add.reduceat(y, starts)


def _cells(node: np.ndarray, value: np.ndarray, width: int, size: int, y: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """As ``_sums``, for codes below ``width``; the rows need no order."""
    cell = node * width + value.astype(np.int64)
    cell, y, times = (cell, y, times) if (known := value < width).all() else (cell[known], y[known], times if times is None else times[known])
    if size * width <= 4 * len(cell) + (1 << 16):
        n, s = np.bincount(cell, times, size * width), np.bincount(cell, y, size * width)
        found = np.flatnonzero(n)
        n, s = n[found], s[found]
    else:  # more cells than a task should hold: only those that occur
        found, at = np.unique(cell, return_inverse=True)
        n, s = np.bincount(at, times), np.bincount(at, y)
    return found // width, found % width, n.astype(np.int64), s


def _narrowest(values: np.ndarray) -> str:
    """The shortest kind that holds each of these floats to the bit."""
    with np.errstate(invalid="ignore", over="ignore"):
        for kind in ("|i1", "<i2", "<f4"):
            if (values.astype(kind).astype(np.float64).view(np.int64) == values.view(np.int64)).all():
                return kind
    return "<f8"


def narrowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of features and label as records without loss, a third of their size where most values are whole numbers."""
    columns = np.ascontiguousarray(np.column_stack([x, y]).T)
    rows = np.empty(len(y), [(f"f{i}", _narrowest(c)) for i, c in enumerate(columns)])
    for name, values in zip(rows.dtype.names, columns):
        rows[name] = values
    return rows


def kinds_of(rows: np.ndarray) -> str:
    return ",".join(rows.dtype[i].str for i in range(len(rows.dtype)))


def widened(kinds: list[str], blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features and label of blocks of records; each feature's values lie together."""
    parts = [np.frombuffer(b, [(f"f{i}", k) for i, k in enumerate(ks.split(","))]) for ks, b in zip(kinds, blocks)]
    columns = np.concatenate([np.array([p[f] for f in p.dtype.names], np.float64) for p in parts], axis=1)
    return columns[:-1].T, columns[-1]


def grow(x: np.ndarray, y: np.ndarray, tree: int, node: int, parent: int, depth: int, spec: dict, times: np.ndarray | None = None) -> pd.DataFrame:
    """Split one bounded node down to its leaves, all nodes of a level at once; returns the rows of the node table below it.

    ``times`` says how often each row is in the tree's sample, once without it: the same tree, bit for
    bit, as with rows repeated. Only rows of nodes that may be split go on to the next level, put in the order of their nodes
    there; with ``exact``, each feature's rows are put in order once and stay in order when they are dealt to the children. Label sums
    are exact in any order, so taking nodes together changes no bit.
    """
    k, min_leaf, exact = spec["numeric"], spec["min_leaf"], bool(spec.get("exact"))
    columns = np.ascontiguousarray(x.T)
    if times is not None:
        times, y = times.astype(np.int64), y * times
    of = lambda r: None if times is None else times[r]
    deep = lambda: spec["max_depth"] is not None and depth >= spec["max_depth"]
    ids, parents = np.array([node], np.int64), np.array([parent], np.int64)
    all_n, all_s = np.array([len(y) if times is None else times.sum()]), np.array([y.sum()])
    out, order = [], []
    if exact:  # row numbers by node, then by the feature's value; the columns stay as they are
        order = [np.argsort(c, kind="stable") for c in columns]
    counts = np.array([len(y)])  # rows of each node that may be split, in the order of these nodes
    while len(ids):
        size = len(ids)
        best = {"gain": np.zeros(size), "feature": np.full(size, -1), "cut": np.zeros(size)}
        here = np.flatnonzero((all_n >= 2 * min_leaf) & (not deep()))
        if len(here):
            score = lambda f, *options: _first_best(best, options[0], f, *options[1:], all_n, all_s, min_leaf)
            at = np.repeat(here, counts)
            starts = np.cumsum(counts) - counts
            turn = np.zeros(len(at), bool)
            turn[starts] = True
            for f in range(len(columns)):
                if exact:
                    own = order[f]
                    value = columns[f].take(own)
                    line = turn.copy()
                    line[1:] |= value[1:] != value[:-1]
                    first = np.flatnonzero(line)
                    slot, value = at.take(first), value.take(first)
                    n = np.diff(np.r_[first, len(at)]) if times is None else np.add.reduceat(times.take(own), first)
                    s = np.add.reduceat(y.take(own), first)
                    if f >= k:
                        known = value < spec["widths"][f - k]
                        score(f, slot[known], value[known], n[known], s[known])
                        continue
                    cut = np.flatnonzero(slot[1:] == slot[:-1])
                    if not len(cut):
                        continue
                    first = np.searchsorted(first, starts)
                    lines = np.diff(np.r_[first, len(slot)])
                    n, s = np.cumsum(n), np.cumsum(s)
                    before_n, before_s = np.r_[0, n][first], np.r_[0.0, s][first]
                    n, s = n - np.repeat(before_n, lines), s - np.repeat(before_s, lines)
                    low = value.take(cut)
                    score(f, slot.take(cut), between(low, value.take(cut + 1)), n.take(cut), s.take(cut))
                elif f >= k:
                    score(f, *_cells(at, columns[f], spec["widths"][f - k], size, y, times))
                else:
                    value = columns[f]
                    lo, hi = np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts)
                    cuts = cut_points(lo, hi, draw(spec["seed"], tree, ids[here], f))
                    below = value <= np.repeat(cuts, counts)
                    n = np.add.reduceat(below.view(np.uint8), starts, dtype=np.int64) if times is None else np.add.reduceat(below * times, starts)
                    score(f, here, cuts, n, np.add.reduceat(below * y, starts))
        feature, cut = best["feature"], best["cut"]
        is_category = feature >= k
        out.append(pd.DataFrame(dict(zip(NODE_COLUMNS, (tree, ids, parents, feature, is_category, cut, all_n, spec["mean"] + all_s / all_n)))))
        inner = np.flatnonzero(feature >= 0)
        parents = np.repeat(ids[inner], 2)
        ids = child(parents, np.tile([0, 1], len(inner)))
        depth += 1
        if not len(inner):
            break
        # Children are numbered in pairs; rows of nodes that are not split go to the number behind them.
        place = np.full(size, 2 * len(inner))
        place[inner] = 2 * np.arange(len(inner))
        rows = order[0] if exact else np.arange(len(at))
        value = columns[feature[at], rows]
        right = np.where(is_category[at], value == cut[at], value > cut[at])
        to = place[at] + (right & (feature[at] >= 0))
        sums = [np.bincount(to, w, len(ids) + 1)[: len(ids)] for w in (of(rows), y[rows])]
        all_n, all_s = sums[0].astype(np.int64), sums[1]
        wide = np.r_[(all_n >= 2 * min_leaf) & (not deep()), False]
        kept = wide[to]
        counts = np.bincount(to[kept], minlength=len(wide))[wide]
        left = int(counts.sum())
        short = np.uint16 if len(ids) < (1 << 16) - 1 else np.int64
        key = np.where(kept, to, len(ids)).astype(short)
        if exact:
            of_row = np.empty(len(y), short)
            of_row[rows] = key
            order = [r.take(np.argsort(of_row.take(r), kind="stable")[:left]) for r in order]
        else:
            rows = np.argsort(key, kind="stable")[:left]
            columns, y, times = columns.take(rows, axis=1), y.take(rows), of(rows)
    return pd.concat(out, ignore_index=True)
