"""Walk-forward boosted trees on histograms, all quarterly folds in one job.

Boosting on binned features sees a row only through its cell, the bins of its
features: rows of a cell get equal predictions, so their gradients (of the squared error, and
of the log loss of labels as well) enter every split as a count and a sum. A panel of any length therefore shrinks to counts and sums per (quarter, cell), in one
aggregate that combines before the shuffle, and running sums over quarters give each fold its past, as
the Gram sums do for linear models. The bins of all features together are at most ``CELLS``, so a
fold is a small group whatever the number of rows; all folds are fitted side by side. A fold answers
with the prediction of every cell of its test quarter, and rows pick theirs up by quarter and cell.

Nothing looks ahead: bin edges are quantiles of the rows whose target lies before the first fold,
and a row trains the quarters that begin after its target's date.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .forecast import quarter_of
from .frames import attach
from .ranks import value_counts

#: Most cells of all features together, and most bins of one.
CELLS, BINS = 1 << 20, 256


@dataclass(frozen=True)
class Boost:
    """Trees grow level by level; a split needs ``least`` rows on both sides. ``columns`` is the share of
    features that a tree may use, drawn by a counter-based generator."""
    trees: int = 400
    rate: float = 0.03
    depth: int = 5
    least: int = 50
    l1: float = 0.1
    l2: float = 0.1
    columns: float = 0.8
    seed: int = 42
    #: Targets are labels 0 and 1, predictions probabilities; both labels weigh the same in all.
    labels: bool = False


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def grow(bins: np.ndarray, n: np.ndarray, g: np.ndarray, h: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, b: Boost) -> np.ndarray:
    """One tree on cells: ``bins`` (cells, features), row counts, sums of gradients and of second
    derivatives. Returns the value that each cell gets; cells without rows follow the splits of the others."""
    node = np.zeros(len(n), np.int64)
    score = lambda gs, hs: shrunk(gs, b.l1) ** 2 / (hs + b.l2)
    nodes = 1
    for _ in range(b.depth):
        gain_of, cut_of, feature_of = np.full(nodes, 1e-12), np.zeros(nodes, np.int64), np.full(nodes, -1)
        total_n, total_g, total_h = (np.bincount(node, x, nodes) for x in (n, g, h))
        for f in np.flatnonzero(allowed):
            slot, width = node * sizes[f] + bins[:, f], sizes[f]
            left_n, left_g, left_h = (np.bincount(slot, x, nodes * width).reshape(nodes, width).cumsum(1)[:, :-1] for x in (n, g, h))
            gain = score(left_g, left_h) + score(total_g[:, None] - left_g, total_h[:, None] - left_h) - score(total_g, total_h)[:, None]
            gain[(left_n < b.least) | (total_n[:, None] - left_n < b.least)] = -1
            if not gain.shape[1]:
                continue
            cut = gain.argmax(1)
            best = gain[np.arange(nodes), cut]
            better = best > gain_of * (1 + 1e-9)  # near ties go to the first feature
            gain_of[better], cut_of[better], feature_of[better] = best[better], cut[better], f
        if (feature_of < 0).all():
            break
        own = feature_of[node]
        right = (own >= 0) & (bins[np.arange(len(node)), np.maximum(own, 0)] > cut_of[node])
        node = node * 2 + right
        held = np.bincount(node, minlength=2 * nodes) > 0  # numbered without gaps
        node, nodes = (held.cumsum() - 1)[node], int(held.sum())
    total_g, total_h = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
    return (shrunk(total_g, b.l1) / (total_h + b.l2))[node]


def grow_grid(n: np.ndarray, g: np.ndarray, h: np.ndarray, allowed: np.ndarray, b: Boost) -> np.ndarray:
    """As ``grow``, on arrays with an axis for each feature: a node is a box, whose counts and sums by the
    bins of a feature are sums over its other axes."""
    score = lambda gs, hs: shrunk(gs, b.l1) ** 2 / (hs + b.l2)
    out, axes = np.empty(n.shape), range(n.ndim)
    open_boxes = [tuple(slice(0, s) for s in n.shape)]
    for level in range(b.depth + 1):
        split = []
        for box in open_boxes:
            nb, gb, hb = n[box], g[box], (n if h is n else h)[box]
            total_g, total_h = gb.sum(), hb.sum()
            gain_of, cut_of, feature_of = 1e-12, 0, -1
            for f in (np.flatnonzero(allowed) if level < b.depth else ()):
                if n.shape[f] < 2 or nb.shape[f] < 2:
                    continue
                others = tuple(a for a in axes if a != f)
                left_n, left_g = nb.sum(others).cumsum()[:-1], gb.sum(others).cumsum()[:-1]
                left_h = left_n if h is n else hb.sum(others).cumsum()[:-1]
                whole = left_n[-1] + nb.take(-1, f).sum()
                gain = score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h)
                gain[(left_n < b.least) | (whole - left_n < b.least)] = -1
                cut = int(gain.argmax())
                if gain[cut] > gain_of * (1 + 1e-9):  # near ties go to the first feature
                    gain_of, cut_of, feature_of = gain[cut], cut, f
            if feature_of < 0:
                out[box] = shrunk(total_g, b.l1) / (total_h + b.l2)
                continue
            side = box[feature_of]
            for part in (slice(side.start, side.start + cut_of + 1), slice(side.start + cut_of + 1, side.stop)):
                split.append((*box[:feature_of], part, *box[feature_of + 1:]))
        open_boxes = split
    return out


#: The grid of all cells is held whole where at least one in so many of its cells has rows or is asked.
GRID_SHARE = 16


def fit_cells(bins: np.ndarray, n: np.ndarray, total: np.ndarray, sizes: np.ndarray, b: Boost) -> np.ndarray:
    """Predictions of all cells. ``total`` is the sum of a cell's targets; cells with n = 0 are only predicted."""
    rows, ones = n.sum(), total.sum()
    if not rows or b.labels and not 0 < ones < rows:
        return np.full(len(n), ones / rows if rows else np.nan)
    if b.labels:  # each label weighs half of the rows
        up, down = rows / (2 * ones), rows / (2 * (rows - ones))
        weight = up * total + down * (n - total)
        value = np.zeros(len(n))
    else:
        value = np.full(len(n), ones / rows)
    features = bins.shape[1]
    dense = np.prod(sizes.astype(float)) <= min(2 * CELLS, GRID_SHARE * len(n))
    if dense:
        place = tuple(bins.T)
        grid = lambda x: np.bincount(np.ravel_multi_index(place, tuple(sizes)), x, int(np.prod(sizes))).reshape(tuple(sizes))
        n, total, value = grid(n), grid(total), np.full(tuple(sizes), value[0])
        weight = up * total + down * (n - total) if b.labels else None
    used = max(1, int(np.ceil(b.columns * features)))
    for t in range(b.trees):
        allowed = np.zeros(features, bool)
        allowed[np.random.Generator(np.random.Philox(key=b.seed, counter=[0, 0, 0, t])).permutation(features)[:used]] = True
        if b.labels:
            p = 1 / (1 + np.exp(-value))
            g, h = up * total - weight * p, weight * p * (1 - p)
        else:
            g, h = total - n * value, n
        value = value + b.rate * (grow_grid(n, g, h, allowed, b) if dense else grow(bins, n, g, h, sizes, allowed, b))
    if dense:
        value = value[place]
    return 1 / (1 + np.exp(-value)) if b.labels else value


def bins_of(features: int) -> int:
    return min(BINS, int(CELLS ** (1 / features) + 1e-9))


def _edges(past: DataFrame, features: list[str], most: int) -> dict[str, list[float]]:
    """Bins of equally many rows: the least value of each, the first left out."""
    out = {}
    for f in features:
        ranked = value_counts(past.select(F.col(f).cast("double").alias("_x")), [], "_x")
        low = ranked.groupBy(F.floor(F.col("n_lt") * most / F.col("n")).alias("bin")).agg(F.min("_x").alias("x")).collect()  # ``most`` rows
        out[f] = sorted(r["x"] for r in low)[1:]
    return out


def bin_edges(d: DataFrame, features: list[str], before: str, most: int) -> dict[str, list[float]]:
    """Exact quantiles of each feature over the rows whose target lies before the date."""
    return _edges(d.filter(F.col("ydate") < F.lit(before).cast("date")), features, most)


def binned(d: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Adds ``b0``, ``b1``, ... : the number of edges at or below each feature."""
    inf = float("inf")
    names = [f"b{i}" for i in range(len(edges))]
    d = d.select("*", *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(edges)])
    cut = Bucketizer(splitsArray=[[-inf, *e, inf] if e else [-inf, 0.0, inf] for e in edges.values()], inputCols=[f"_x{i}" for i in range(len(edges))], outputCols=[f"_{n}" for n in names])
    d = cut.setHandleInvalid("keep").transform(d)
    # without edges a feature has one bin
    return d.select(*[c for c in d.columns if c[:2] not in ("_x", "_b")], *[(F.col(f"_{n}") if e else F.lit(0)).cast("int").alias(n) for n, e in zip(names, edges.values())])


def walk_forward_trees(d: DataFrame, features: list[str], start: str, boost: Boost | None = None, least: int = 500, out: str = "trees") -> DataFrame:
    """Forecasts of the rows from ``start`` on. ``d`` has key, date, the features, y and ydate;
    rows without all features get no forecast, rows without a target do. A quarter with
    fewer than ``least`` training rows gets none."""
    boost = boost or Boost()
    most = bins_of(len(features))
    known = d.dropna(subset=features)
    edges = bin_edges(known.filter(F.col("y").isNotNull()), features, start, most)
    sizes = np.array([len(e) + 1 for e in edges.values()])
    names = [f"b{i}" for i in range(len(features))]
    rows = binned(known, edges)
    past = rows.filter(F.col("y").isNotNull()).groupBy(quarter_of("ydate").alias("q"), *names).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    past = written(past)
    test = rows.withColumn("fold", quarter_of("date")).filter(F.col("date") >= F.lit(start).cast("date"))
    asked = written(test.groupBy("fold", *names).count().drop("count"))
    folds = [r["fold"] for r in asked.select("fold").distinct().collect()]  # quarters of the calendar
    ahead = F.filter(F.array(*[F.lit(f) for f in sorted(folds)]), lambda f: f > F.col("q"))
    cells = past.withColumn("fold", F.explode(ahead)).groupBy("fold", *names).agg(F.sum("n").alias("n"), F.sum("total").alias("total")) if folds else None
    if cells is None:
        return test.withColumn(out, F.lit(None).cast("double")).drop("fold", *names)
    return _fitted(cells, asked, test, names, sizes, boost, least, out, "date", len(folds))


def split_trees(train: DataFrame, test: DataFrame, features: list[str], y: str, boost: Boost | None = None, out: str = "trees") -> DataFrame:
    """One fit on ``train``; ``test`` gets a column with the predictions."""
    boost, names = boost or Boost(), [f"b{i}" for i in range(len(features))]
    most = bins_of(len(features))
    known = train.dropna(subset=[*features, y])
    edges = _edges(known, features, most)
    sizes = np.array([len(e) + 1 for e in edges.values()])
    cells = binned(known, edges).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("total")).withColumn("fold", F.lit(0))
    rows = binned(test.dropna(subset=features), edges).withColumn("fold", F.lit(0))
    return _fitted(written(cells), written(rows.groupBy("fold", *names).count().drop("count")), rows, names, sizes, boost, 1, out, "int")


def _fitted(cells: DataFrame, asked: DataFrame, rows: DataFrame, names: list[str], sizes: np.ndarray, boost: Boost, least: int, out: str, kind: str, folds: int = 1) -> DataFrame:
    """Fits every fold on its cells (fold, bins, n, total) and gives its prediction to the rows."""
    both = cells.select("fold", *names, "n", "total", F.lit(False).alias("asked")).unionByName(
        asked.select("fold", *names, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(True).alias("asked")))

    def fit(t: pa.Table) -> pa.Table:
        bins = np.stack([t[c].to_numpy() for c in names], 1).astype(np.int64)
        n, total, wanted = t["n"].to_numpy().astype(float), t["total"].to_numpy(), t["asked"].to_numpy(zero_copy_only=False)
        # cells in one order, so that sums do not depend on how rows arrived
        order = np.lexsort([wanted, *bins.T[::-1]])
        bins, n, total, wanted = bins[order], n[order], total[order], wanted[order]
        value = fit_cells(bins, n, total, sizes, boost) if n.sum() >= least else np.full(len(n), np.nan)
        return pa.table([t["fold"].combine_chunks().take(pa.array(order[wanted])), *[pa.array(b, pa.int32()) for b in bins[wanted].T], pa.array(value[wanted], from_pandas=True)], names=["fold", *names, out])
    # folds are few rows and long work: one to a task, by ranges that are not put together again
    found = both.repartitionByRange(folds, "fold").groupBy("fold").applyInArrow(fit, f"fold {kind}, {', '.join(f'{c} int' for c in names)}, {out} double")
    return attach(rows, found, ["fold", *names]).drop("fold", *names)
