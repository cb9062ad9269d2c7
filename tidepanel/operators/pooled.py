"""Pooled calibrators: one threshold path for the whole cross-section.

The thresholds of a day depend on all scores of the day before, so the recursion
runs over dates. It needs only counts and sums of the scores beyond a threshold,
which come from a digest of bounded size per date:

1. rows -> (date, cell): count, sum, smallest and largest score. Cells split the
   score line; the aggregate combines map-side, so a hot date is harmless.
2. the recursion walks the dates on the digests. Where a threshold falls inside
   a cell that holds different scores, the cell is reported.
3. reported cells are split further from the rows and the walk repeats, until no
   threshold falls into an open cell: then all counts and sums are exact.
4. with summed errors on wide cross-sections a step can be far longer than the scores'
   spread, so a single miscounted score moves all later thresholds and a round settles a few
   dates only. What is open after ``TRIES`` rounds is walked in blocks of dates, on the
   scores of each block and from the state that the block before left.
5. the thresholds, one row per date, are joined back to the rows.

The walk sees dates x cells numbers whatever the number of rows, or the scores of one block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalized, uniform
from ..session import written
from .frames import attach, calendar
from .ranks import quantiles
from .steps import weights
from .windows import mad_scale

CELLS, SPLIT = 512, 128
#: Rounds on cells before blocks of dates, and most scores of a block of several dates.
TRIES, BLOCK = 6, 1 << 21
CELL = ("lo", "hi", "c", "t", "path")
POOL_RATES = (0.0005, 0.001, 0.002, 0.004, 0.008, 0.016, 0.032, 0.064)  # fixed values: candidate rates
XS_DAYS, XS_GAMMA, XS_LOW, XS_HIGH = 5, 0.005, 1e-4, 0.499  # fixed values


def scores(preds: DataFrame, forecast: str, target: str = "target", window: int = 250, least: int = 50) -> DataFrame:
    """Residual, trailing scale and standardized score per key."""
    d = preds.withColumn("residual", F.col(target) - F.col(forecast))
    d = mad_scale(d, "residual", "sigma_hat", window, least)
    return d.withColumn("s_std", F.try_divide(F.col("residual"), F.col("sigma_hat")))


# --- digest ------------------------------------------------------------------

def root_cell(s):
    """Monotone map of the score line onto the first cells."""
    u = s / (1 + F.abs(s))
    return F.least(F.floor((u + 1) / 2 * CELLS), F.lit(CELLS - 1)).cast("int")


def _cells(df, keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.sum("s").alias("t"), F.min("s").alias("lo"), F.max("s").alias("hi"))


def first_digest(rows: DataFrame, root=root_cell) -> DataFrame:
    d = rows.select("date", F.col("s_std").alias("s")).withColumn("root", root(F.col("s")))
    return _cells(d, ["date", "root"]).withColumn("path", F.col("root").cast("string"))


def split_cells(rows: DataFrame, digest: DataFrame, open_cells: DataFrame, root=root_cell) -> DataFrame:
    """Replace the reported cells by finer ones, counted from their rows only."""
    hit = digest.join(open_cells, ["date", "path"], "left_semi").select(
        "date", "root", F.col("path").alias("up"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    d = rows.select("date", F.col("s_std").alias("s")).withColumn("root", root(F.col("s")))
    near = attach(d, hit.groupBy("date", "root").agg(F.collect_list(F.struct("up", "a", "b")).alias("hits")), ["date", "root"], "inner")
    cell = F.filter("hits", lambda h: (F.col("s") >= h["a"]) & (F.col("s") <= h["b"]))
    near = near.withColumn("h", F.get(cell, 0)).filter(F.col("h").isNotNull())
    part = F.least(F.floor((F.col("s") - F.col("h.a")) / (F.col("h.b") - F.col("h.a")) * SPLIT), F.lit(SPLIT - 1))
    near = near.withColumn("path", F.concat_ws("/", "h.up", part.cast("string")))
    finer = _cells(near, ["date", "root", "path"])
    kept = digest.join(open_cells, ["date", "path"], "left_anti")
    return kept.unionByName(finer.select(*kept.columns))


class Day:
    """Counts and sums beyond a threshold for one date and one side."""

    def __init__(self, cells, side: int):
        """``cells``: the arrays lo, hi, c, t, path of a date, sorted by lo."""
        lo, hi, c, t, self.path = cells
        if side < 0:
            lo, hi, t, c, self.path = -hi[::-1], -lo[::-1], -t[::-1], c[::-1], self.path[::-1]
        self.lo, self.hi, self.c, self.t = lo, hi, c.astype(float), t
        self.above_c = np.concatenate([np.cumsum(self.c[::-1])[::-1], [0.0]])
        self.above_t = np.concatenate([np.cumsum(self.t[::-1])[::-1], [0.0]])
        self.n, self.total = self.above_c[0], self.above_t[0]
        self.open: set[str] = set()

    def beyond(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the scores above each threshold."""
        q = np.atleast_1d(np.asarray(q, dtype=float))
        i = np.searchsorted(self.lo, q, side="right")
        c, t = self.above_c[i].copy(), self.above_t[i].copy()
        j = np.maximum(i - 1, 0)
        inside = (i > 0) & (self.hi[j] > q)
        for k in np.flatnonzero(inside):
            m = j[k]
            self.open.add(self.path[m])
            share = (self.hi[m] - q[k]) / (self.hi[m] - self.lo[m])
            c[k] += round(self.c[m] * share)
            t[k] += round(self.c[m] * share) * (self.hi[m] + q[k]) / 2
        return c, t

    def pinball(self, q: np.ndarray, tau: float) -> np.ndarray:
        q = np.atleast_1d(q)
        c, t = self.beyond(q)
        over = t - c * q
        under = (self.n - c) * q - (self.total - t)
        return (tau * over + (1 - tau) * under) / self.n


def kth(days: list[Day], k: int) -> float:
    """k-th smallest (from 0) of the pooled scores of several days."""
    lo = np.concatenate([d.lo for d in days])
    c = np.concatenate([d.c for d in days])
    hi = np.concatenate([d.hi for d in days])
    owner = [(d, p) for d in days for p in d.path]
    o = np.argsort(lo, kind="stable")
    # count of scores certainly below or at a cell; open cells may overlap others
    cum = np.cumsum(c[o])
    at = o[min(int(np.searchsorted(cum, k, side="right")), len(o) - 1)]
    value = lo[at]
    for m in o:
        if hi[m] > lo[m] and lo[m] <= hi[at] and hi[m] >= value:
            owner[m][0].open.add(owner[m][1])
    return float(value)


# --- walks over the dates -----------------------------------------------------

class FixedWalk:
    """One step per regime and day on the issued interval's misses."""

    def __init__(self, alpha, eta, one_sided=False, average=False):
        self.a = alpha if one_sided else alpha / 2
        self.eta, self.one_sided, self.average = np.atleast_1d(np.asarray(eta, dtype=float)), one_sided, average

    def begin(self, q0, k):
        self.q = {side: np.full(k, v) for side, v in q0.items()}

    def issue(self, side, pi):
        return float(pi @ self.q[side])

    def learn(self, side, day, pi, issued):
        miss = day.beyond(issued)[0][0]
        self.q[side] += self.eta * pi * (miss - self.a * day.n) / (day.n if self.average else 1)

    def rates(self, side):
        return np.broadcast_to(self.eta, self.q[side].shape)

    def state(self):
        """Thresholds after the day, upper side first: the start of a later walk."""
        return [float(v) for side in sorted(self.q, reverse=True) for v in self.q[side]]

    def resume(self, state, k):
        """Go on from a state; ``begin`` has set the sides."""
        for side, part in zip(sorted(self.q, reverse=True), np.reshape(state, (-1, k))):
            self.q[side] = part.astype(float)


class AdaptiveWalk:
    """A bank of rates per regime, mixed by exponential weights on the day's mean
    pinball loss, with a corrector on the issued misses."""

    def __init__(self, alpha, rates=POOL_RATES, meta=5.0, mix=0.01, eta_corr=0.002, one_sided=False, average=False):
        self.a = alpha if one_sided else alpha / 2
        self.rate, self.meta, self.mix, self.eta_corr = np.asarray(rates, dtype=float), meta, mix, eta_corr
        self.one_sided, self.average = one_sided, average

    def begin(self, q0, k):
        e = len(self.rate)
        self.bank = {s: np.full((k, e), v) for s, v in q0.items()}
        self.logw = {s: np.zeros((k, e)) for s in q0}
        self.corr = {s: np.zeros(k) for s in q0}

    def issue(self, side, pi):
        mean = (weights(self.logw[side]) * self.bank[side]).sum(axis=1)
        return float(pi @ (mean + self.corr[side]))

    def learn(self, side, day, pi, issued):
        gate, norm = pi[:, None], (day.n if self.average else 1)
        bank = self.bank[side]
        flat = bank.ravel()
        miss = day.beyond(flat)[0].reshape(bank.shape)
        loss = day.pinball(flat, 1 - self.a).reshape(bank.shape)
        self.bank[side] = bank + self.rate * gate * (miss - self.a * day.n) / norm
        w = weights(self.logw[side] - self.meta * gate * loss)
        self.logw[side] = np.log((1 - self.mix * gate) * w + self.mix * gate / len(self.rate))
        self.corr[side] += self.eta_corr * pi * (day.beyond(issued)[0][0] - self.a * day.n) / norm

    def rates(self, side):
        return weights(self.logw[side]) @ self.rate

    def state(self):
        """Bank, log weights and corrector of every side, upper side first."""
        parts = [a[side].ravel() for side in sorted(self.bank, reverse=True) for a in (self.bank, self.logw, self.corr)]
        return np.concatenate(parts).tolist()

    def resume(self, state, k):
        e = len(self.rate)
        for side, row in zip(sorted(self.bank, reverse=True), np.reshape(np.asarray(state, dtype=float), (len(self.bank), -1))):
            self.bank[side], self.logw[side] = row[:k * e].reshape(k, e), row[k * e:2 * k * e].reshape(k, e)
            self.corr[side] = row[2 * k * e:].copy()


def _walk(pdf: pd.DataFrame, walk, state: list[float] | None = None, keep: bool = False) -> list[tuple]:
    """Walks over the dates, from ``state`` if there is one; ``keep`` gives the state
    after each date."""
    out = []
    sides = (1,) if walk.one_sided else (1, -1)
    k = len(pdf["pi"].iloc[0])
    q0 = {1: pdf["q0_hi"].iloc[0], -1: pdf["q0_lo"].iloc[0]}
    walk.begin({s: q0[s] for s in sides}, k)
    if state:
        walk.resume(state, k)
    for pi, warm, cells in zip(pdf["pi"], pdf["warm"], pdf["cells"]):
        pi = np.asarray(pi, dtype=float)
        issued = {s: walk.issue(s, pi) for s in sides}
        rates = [float(v) for v in walk.rates(1)]
        touched: set[str] = set()
        if not warm:
            for s in sides:
                day = Day(cells, s)
                walk.learn(s, day, pi, issued[s])
                touched |= day.open
        out.append((issued.get(-1, math.nan), issued[1], rates, sorted(touched), walk.state() if keep else []))
    return out


def _walk_xs(pdf: pd.DataFrame, alpha: float) -> list[tuple]:
    """Order statistic of the last cross-sections at a level that adapts to the
    day's miss rate."""
    a, out = alpha / 2, []
    level = {1: a, -1: a}
    past: dict[int, list[Day]] = {1: [], -1: []}
    opened: dict[int, set] = {}
    dates: list[int] = []
    for t, (warm, cells) in enumerate(zip(pdf["warm"], pdf["cells"])):
        q = {}
        for s in (1, -1):
            if past[s]:
                m = int(sum(d.n for d in past[s]))
                k = min(m - 1, int(math.ceil((m + 1) * (1 - level[s]) - 1e-12)) - 1)
                q[s] = kth(past[s], k)
            else:
                q[s] = math.inf
        today = {s: Day(cells, s) for s in (1, -1)}
        first = not past[1]
        for s in (1, -1):
            if not warm and not first:
                miss = today[s].beyond(q[s])[0][0] / today[s].n
                level[s] = min(max(level[s] + XS_GAMMA * (a - miss), XS_LOW), XS_HIGH)
            past[s].append(today[s])
            if len(past[s]) > XS_DAYS:
                past[s].pop(0)
        opened[t] = (today[1], today[-1])
        dates.append(t)
        out.append((q[-1], q[1], [], None))
    return [(lo, hi, r, sorted(opened[t][0].open | opened[t][1].open)) for t, (lo, hi, r, _) in enumerate(out)]


def calendar_frame(rows: DataFrame, membership: DataFrame | None, alpha: float, k: int, warmup_days: int,
                   one_sided: bool = False) -> DataFrame:
    """One row per date: warm-up flag, membership, starting thresholds."""
    a = alpha if one_sided else alpha / 2
    dates = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    d = dates.withColumn("pos", F.row_number().over(calendar()) - 1)
    last = d.agg(F.max("pos")).scalar()
    d = d.withColumn("warm", F.col("pos") <= F.least(F.lit(warmup_days), last))
    if membership is None:
        d = d.withColumn("pi", uniform(k))
    else:
        d = d.join(membership.select("date", "pi"), "date", "left").withColumn("pi", normalized(F.col("pi"), k))
    warm_end = d.filter("warm").agg(F.max("date")).scalar()
    warm_rows = rows.filter(F.col("date") <= warm_end)
    q = quantiles(warm_rows, [], "s_std", [1 - a, a], ["hi", "lo"]).select(F.struct("hi", (-F.col("lo")).alias("lo")).alias("q"))
    return d.withColumn("_q", q.scalar()).withColumn("q0_hi", F.col("_q.hi")).withColumn("q0_lo", F.col("_q.lo")).drop("_q")


OUT = "arm string, date date, warm boolean, q_lo double, q_hi double, rates array<double>, touched array<string>, state array<double>"


def _runner(walks: dict, states: dict, exact: bool = False):
    """One arm on its date frame, from its state if it has one; ``exact``: each score is a cell."""
    def run(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        arm = pdf["arm"].iloc[0]
        if exact:
            found = [np.unique(x, return_counts=True) for x in pdf["x"]]
            pdf["cells"] = [(v, v, c, v * c, ()) for v, c in found]
        else:
            pdf["cells"] = list(zip(*[pdf["cell_" + c] for c in CELL]))
        res = walks[arm](pdf, states[arm]) if arm in states else walks[arm](pdf)
        return pd.DataFrame({"arm": arm, "date": pdf["date"], "warm": pdf["warm"], "q_lo": [r[0] for r in res], "q_hi": [r[1] for r in res],
                             "rates": [r[2] for r in res], "touched": [r[3] for r in res],
                             "state": [r[4] if len(r) > 4 else [] for r in res]})
    return run


def _each_arm(walks: dict):
    return F.explode(F.array(*[F.lit(a) for a in walks]))


def _rounds(rows: DataFrame, cal: DataFrame, walks: dict, states: dict, root, rounds: int) -> tuple[DataFrame, bool]:
    """The walk on cells that are split where it meets open ones, and whether it met none in the end."""
    digest = first_digest(rows, root)
    run = _runner(walks, states)
    for left in range(rounds - 1, -1, -1):
        digest = written(digest)
        cells = digest.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "c", "t", "path"))).alias("x"))
        cells = cells.select("date", *[F.col(f"x.{c}").alias("cell_" + c) for c in CELL])
        path = written(cal.join(cells, "date").withColumn("arm", _each_arm(walks)).groupBy("arm").applyInPandas(run, OUT))
        open_cells = path.select("date", F.explode("touched").alias("path")).distinct()
        if open_cells.isEmpty():
            return path, True
        if left:
            digest = split_cells(rows, digest, open_cells, root)
    return path, False


def _blocks(sizes: list) -> list[tuple]:
    """Consecutive dates (first, last, scores) of at most ``BLOCK`` scores; a larger date is alone."""
    out = []
    for r in sizes:
        if out and out[-1][2] + r["n"] <= BLOCK:
            out[-1] = (out[-1][0], r["date"], out[-1][2] + r["n"])
        else:
            out.append((r["date"], r["date"], r["n"]))
    return out


def _walk_blocks(rows: DataFrame, cal: DataFrame, walks: dict, path: DataFrame, root, rounds: int) -> DataFrame:
    """The dates of a path from its first open one on, block by block. The driver carries the state of
    the arms and one row per date; a date above ``BLOCK`` scores is walked on cells, all of
    whose lookups are known from its start."""
    first = path.filter(F.size("touched") > 0).agg(F.min("date").alias("date")).first()["date"]
    done = path.filter(F.col("date") < F.lit(first)).drop("touched")
    states = {r["arm"]: r["state"] for r in done.groupBy("arm").agg(F.max_by("state", "date").alias("state")).collect()}
    left = rows.filter(F.col("date") >= F.lit(first)).select("date", "s_std")
    sizes = left.groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy("date").collect()  # one row per date
    left = written(left.repartitionByRange("date", "s_std").sortWithinPartitions("date", "s_std"))
    found = []
    for a, b, n in _blocks(sizes):
        of_block = F.col("date").between(F.lit(a), F.lit(b))
        part, days = left.filter(of_block), cal.filter(of_block)
        if n > BLOCK:
            walked, settled = _rounds(part, days, walks, states, root, rounds)
            if not settled:
                raise RuntimeError("cells were still open after the last round")
        else:
            scores = part.groupBy("date").agg(F.collect_list("s_std").alias("x"))
            walked = days.join(scores, "date").withColumn("arm", _each_arm(walks)).groupBy("arm").applyInPandas(_runner(walks, states, True), OUT)
        new = walked.drop("touched").collect()
        states = {r["arm"]: r["state"] for r in sorted(new, key=lambda r: r["date"])}
        found += new
    return written(done.unionByName(path.sparkSession.createDataFrame(found, done.schema)))


def thresholds(rows: DataFrame, cal: DataFrame, walks: dict, root=root_cell, rounds: int = 40, resumable: bool = False) -> DataFrame:
    """Walk all arms until every lookup is exact. ``walks`` maps an arm to a function from its date
    frame to (q_lo, q_hi, rates, open cells[, state]). ``resumable``: the functions also take a state
    to go on from, and give the state after each date."""
    path, settled = _rounds(rows, cal, walks, {}, root, min(TRIES, rounds) if resumable else rounds)
    if settled:
        return path.drop("touched")
    if resumable:
        return _walk_blocks(rows, cal, walks, path, root, rounds)
    raise RuntimeError("cells were still open after the last round")


def issue(rows: DataFrame, path: DataFrame, arms: list[str], one_sided: bool = False) -> DataFrame:
    """Thresholds back onto the rows: interval flags and widths."""
    d = rows.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    d = attach(d, path.drop("rates", "state"), ["arm", "date"], "inner", stored=True)
    hi = F.col("s_std") <= F.col("q_hi")
    lo = F.lit(True) if one_sided else -F.col("s_std") <= F.col("q_lo")
    width = F.col("q_hi") if one_sided else F.col("q_lo") + F.col("q_hi")
    if one_sided:
        d = d.withColumn("q_lo", F.lit(None).cast("double"))
    return (d.withColumn("covered_lo", lo).withColumn("covered_hi", hi).withColumn("covered", lo & hi)
            .withColumn("width", width * F.col("sigma_hat")).withColumnRenamed("warm", "warmup"))


def run_pooled(rows: DataFrame, membership: DataFrame | None, k: int, walks: dict, alpha: float = 0.1,
               warmup_days: int = 100, one_sided: bool = False, root=root_cell):
    """rows: key, date, s_std, sigma_hat. Returns (issued rows, thresholds)."""
    rows = written(rows.filter(F.col("s_std").isNotNull()))
    cal = written(calendar_frame(rows, membership, alpha, k, warmup_days, one_sided))
    resumable = not any(callable(w) for w in walks.values())
    named = {arm: (lambda pdf, state=None, w=w: _walk(pdf, w, state, True)) if not callable(w) else w for arm, w in walks.items()}
    path = thresholds(rows, cal, named, root, resumable=resumable)
    return issue(rows, path, list(walks), one_sided), path


def run_xs(rows: DataFrame, alpha: float = 0.1, warmup_days: int = 100, root=root_cell):
    return run_pooled(rows, None, 1, {"xs": lambda pdf: _walk_xs(pdf, alpha)}, alpha, warmup_days, root=root)


# --- nearest past days ---------------------------------------------------------

def _neighbours(x: np.ndarray, t: int, k: int) -> np.ndarray:
    """Earlier days by distance, ties by date. Only those up to the k-th distance are sorted."""
    dist = np.round(np.sqrt(((x[:t] - x[t]) ** 2).sum(axis=1)), 9)
    near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1]) if t > k else np.arange(t)
    return near[np.argsort(dist[near], kind="stable")][:k]


def _scaled(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    x = pdf[features].astype(float)
    return ((x - x.mean()) / x.std()).fillna(0.0).to_numpy()


#: Days whose neighbours one task finds, about.
DAYS_PER_TASK = 500


def nearest_past(market: DataFrame, features: list[str], k: int, skip: int) -> DataFrame:
    """(date, past, rk): the ``k`` nearest earlier days of each day after the first ``skip``. The market
    frame, one row per date, goes to every task; each finds the neighbours of its own days."""
    pdf = market.select("date", *features).toPandas().sort_values("date").reset_index(drop=True)
    x, dates, spark = _scaled(pdf, features), pdf["date"].tolist(), market.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-len(dates) // DAYS_PER_TASK)))

    def run(batches):
        for ids in batches:
            out = []
            for t in ids["id"].tolist():
                near = _neighbours(x, t, k)
                out.append(pd.DataFrame({"date": dates[t], "past": [dates[j] for j in near.tolist()], "rk": range(1, len(near) + 1)}))
            yield pd.concat(out) if out else pd.DataFrame({"date": [], "past": [], "rk": []})
    return spark.range(skip + 1, max(skip + 1, len(dates)), 1, tasks).mapInPandas(run, "date date, past date, rk int")


def run_knn(rows: DataFrame, market: DataFrame, features: list[str], alpha: float, k: int, warmup_days: int,
            root=root_cell, blocks: int = 8):
    """Quantile of the pooled scores of the nearest past days, from digests."""
    a = alpha / 2
    rows = written(rows.filter(F.col("s_std").isNotNull()))
    cal = written(calendar_frame(rows, None, alpha, 1, warmup_days).join(market.select("date", *features), "date", "left"))

    def walk(pdf, b):
        x, n = _scaled(pdf, features), len(pdf)
        days = {s: [Day(c, s) for c in pdf["cells"]] for s in (1, -1)}
        out = []
        for t in range(n):
            q = {1: math.nan, -1: math.nan}
            if t > warmup_days and t % blocks == b:
                near = _neighbours(x, t, k)
                for s in (1, -1):
                    pool = [days[s][j] for j in near]
                    pos = (sum(d.n for d in pool) - 1) * (1 - a)
                    low = int(math.floor(pos))
                    v = kth(pool, low)
                    q[s] = v + (kth(pool, int(math.ceil(pos))) - v) * (pos - low)
            out.append((q[-1], q[1]))
        return [(lo, hi, [], sorted(days[1][t].open | days[-1][t].open)) for t, (lo, hi) in enumerate(out)]
    arms = {str(b): (lambda pdf, b=b: walk(pdf, b)) for b in range(blocks)}
    path = thresholds(rows, cal, arms, root)
    one = path.groupBy("date").agg(F.max(F.nanvl("q_lo", F.lit(None).cast("double"))).alias("q_lo"),
                                   F.max(F.nanvl("q_hi", F.lit(None).cast("double"))).alias("q_hi"))
    out = attach(rows, one, ["date"]).withColumn("warmup", F.col("q_hi").isNull())
    no = F.lit(False)
    lo, hi = F.coalesce(-F.col("s_std") <= F.col("q_lo"), no), F.coalesce(F.col("s_std") <= F.col("q_hi"), no)
    return (out.withColumn("covered_lo", lo).withColumn("covered_hi", hi).withColumn("covered", lo & hi)
            .withColumn("width", (F.col("q_lo") + F.col("q_hi")) * F.col("sigma_hat")))
