"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds.

Vectors are turned into integers, so distances and sums are exact. They are packed into
cells of up to ``CELL`` vectors, written once, bucketed by cell. In each cell every cluster
keeps a heap of its vectors, keyed by the gap between the distance to the second nearest
centroid (lower bound) and to the own one (upper bound), offset by the drift that the
cluster had accumulated when the gap was measured. If centroids move, a gap shrinks by
the movement of the own centroid and the largest movement of another one at most; so only
vectors whose key the accumulated drift has reached are popped, rescanned exactly and pushed
again. All others keep their centroid without being looked at.

Between rounds a cell's state (assignments and heaps) is a small written table that meets
the vectors by cell, without moving them. A cell reports what its moved vectors change
in the clusters' sums; only those sums (clusters x components) reach the driver.

Gaps are floating-point numbers, rounded down by more than their error; drifts are rounded up.
Equal distances give a gap of zero, which expires at once, so ties always go to the
smaller number exactly.

Defined cases: NULL vectors, other lengths, NULL or non-finite components are left out;
integers saturate at 2^25 in absolute value, so that every squared distance fits in a long;
rows with equal ids are clustered each on their own, and may both be first centroids; NULL ids take part but are
first centroids last of all (then the smaller vector first); fewer vectors than clusters make as many clusters as there are
vectors; an empty table has no clusters and no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, written
from .base import parts_for

#: Vectors of a cell.
CELL = 4096
#: Cells of a bucket, about, and the most buckets.
CELLS_PER_BUCKET, BUCKETS = 16, 4096
#: Largest integer of a component.
LARGEST = 1 << 25


def integers(vectors: DataFrame, id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) for each component of the vectors that count."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(vector) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cut = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * float(scale), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))),
                                                      F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id).cast("long").alias("id"), cut.alias("v"))


def first_centroids(ints: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = ints.select("v", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


CELLS = "cell long, n int, ids binary, null_ids binary, matrix binary"


def cells(ints: DataFrame, dim: int) -> tuple[str, DataFrame]:
    """Packs vectors into cells, in a table bucketed by cell."""
    spark = ints.sparkSession

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, no = TaskContext.get().partitionId(), [], 0

        def one(parts):
            nonlocal no
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, m = table.column(0).combine_chunks(), table.column(1).combine_chunks().flatten().to_numpy().astype("<i4")
            cell = (task << 32) + no
            no += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                 pa.array([np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())],
                names=["cell", "n", "ids", "null_ids", "matrix"])
        n = 0
        for rb in rows:
            at = 0
            while at < rb.num_rows:
                take = min(CELL - n, rb.num_rows - at)
                held.append(rb.slice(at, take))
                n, at = n + take, at + take
                if n == CELL:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)
    table = written(ints.mapInArrow(packed, CELLS))
    n = table.count()
    buckets = min(BUCKETS, parts_for(n, CELLS_PER_BUCKET, min(max(n, 1), spark.sparkContext.defaultParallelism)))
    name = f"cells_{uuid.uuid4().hex}"
    table.repartition(buckets, "cell").write.bucketBy(buckets, "cell").sortBy("cell").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return name, spark.table(name)


# --- one cell --------------------------------------------------------------------

def nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance and
    that of the second nearest one; exact."""
    a, c = m.astype(np.float64), centroids.astype(np.float64)
    top = max(np.abs(a).max(initial=0), np.abs(c).max(initial=0))
    if top < 2 ** 21:  # all terms stay below 2^53
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    else:
        d = np.stack([((m.astype(np.int64) - x) ** 2).sum(1) for x in centroids], 1)
    d = d.astype(np.int64)
    best = d.argmin(1)
    rows = np.arange(len(m))
    own = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    second = d.min(1) if d.shape[1] > 1 else np.full(len(m), np.iinfo(np.int64).max)
    return best, own, second


def gaps(own: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Lower minus upper bound, rounded down by more than the error of the roots."""
    low, high = np.sqrt(second.astype(np.float64)), np.sqrt(own.astype(np.float64))
    return low - high - 1e-12 * (low + high + 1)


class Heaps:
    """One heap of (key, place) for each cluster of a cell."""

    def __init__(self, clusters: int, state: bytes | None = None):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]
        if state:
            sizes = np.frombuffer(state, "<i4", clusters)
            n, at = int(sizes.sum()), 4 * clusters
            keys = np.frombuffer(state, "<f8", n, at).tolist()
            places = np.frombuffer(state, "<i4", n, at + 8 * n).tolist()
            at = 0
            for c, size in enumerate(sizes.tolist()):  # kept in heap order
                self.heaps[c] = list(zip(keys[at:at + size], places[at:at + size]))
                at += size

    def expired(self, drift: np.ndarray) -> tuple[list[int], list[int]]:
        """Pops the vectors whose gap the drift of their cluster has used up."""
        places, clusters = [], []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                places.append(heapq.heappop(heap)[1])
                clusters.append(c)
        return places, clusters

    def push(self, places: list[int], clusters: np.ndarray, keys: np.ndarray) -> None:
        for c, key, place in zip(clusters.tolist(), keys.tolist(), places):
            heapq.heappush(self.heaps[c], (key, place))

    def build(self, clusters: np.ndarray, keys: np.ndarray) -> None:
        for c, key, place in zip(clusters.tolist(), keys.tolist(), range(len(keys))):
            self.heaps[c].append((key, place))
        for heap in self.heaps:
            heapq.heapify(heap)

    def state(self) -> bytes:
        flat = [e for heap in self.heaps for e in heap]
        return (np.array([len(h) for h in self.heaps], "<i4").tobytes() + np.array([k for k, _ in flat], "<f8").tobytes()
                + np.array([p for _, p in flat], "<i4").tobytes())


def moved_sums(m: np.ndarray, before: np.ndarray | None, after: np.ndarray, clusters: int) -> bytes:
    """What the moved vectors change in the counts and sums of the clusters."""
    out = np.zeros((clusters, m.shape[1] + 1), np.int64)
    np.add.at(out[:, 0], after, 1)
    np.add.at(out[:, 1:], after, m.astype(np.int64))
    if before is not None:
        np.subtract.at(out[:, 0], before, 1)
        np.subtract.at(out[:, 1:], before, m.astype(np.int64))
    return out.tobytes()


STATE = "cell long, assigned binary, heaps binary, change binary, scanned int"


def advance(n: int, matrix: np.ndarray, assigned: bytes | None, heaps: bytes | None, centroids: np.ndarray, drift: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """A cell's next state, its change of the sums and how many vectors were rescanned."""
    k = len(centroids)
    if assigned is None:
        mine, own, second = nearest(matrix, centroids)
        held = Heaps(k)
        held.build(mine, gaps(own, second) + drift[mine])
        return mine.astype("<i4").tobytes(), held.state(), moved_sums(matrix, None, mine, k), n
    mine, held = np.frombuffer(assigned, "<i4").copy(), Heaps(k, heaps)
    places, old = held.expired(drift)
    if not places:
        return assigned, heaps, np.zeros((k, matrix.shape[1] + 1), np.int64).tobytes(), 0
    best, own, second = nearest(matrix[places], centroids)
    held.push(places, best, gaps(own, second) + drift[best])
    mine[places] = best
    other = best != np.array(old)
    at = np.array(places)[other]
    return mine.tobytes(), held.state(), moved_sums(matrix[at], np.array(old)[other], best[other], k), len(places)


def _round(vectors: DataFrame, state: DataFrame | None, centroids: np.ndarray, drift: np.ndarray, dim: int) -> DataFrame:
    if state is None:
        both = vectors.select("cell", "n", "matrix", F.lit(None).cast("binary").alias("assigned"), F.lit(None).cast("binary").alias("heaps"))
    else:
        both = vectors.select("cell", "n", "matrix").join(state.select("cell", "assigned", "heaps"), "cell")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for cell, n, m, a, h in zip(*(c for c in rb.columns)):
                matrix = np.frombuffer(m.as_buffer(), "<i4").reshape(n.as_py(), dim)
                out = advance(n.as_py(), matrix, a.as_py(), h.as_py(), centroids, drift)
                yield pa.RecordBatch.from_arrays([pa.array([cell.as_py()], pa.int64()), *[pa.array([x], pa.binary()) for x in out[:3]], pa.array([out[3]], pa.int32())],
                                                 names=["cell", "assigned", "heaps", "change", "scanned"])
    return written(both.mapInArrow(batches, STATE))


def _sums(state: DataFrame, shape: tuple[int, int]) -> list[int]:
    """The changes of all cells, added up: as many numbers as clusters x components."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for rb in rows:
            for x in rb.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "x"])
    added = state.select("change").mapInArrow(batches, "at int, x long").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = [0] * (shape[0] * shape[1])
    for r in added:
        out[r["at"]] = int(r["x"])
    return out


def _moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each centroid's movement and the largest one of another, rounded up."""
    step = np.array([math.sqrt(sum(int(x) ** 2 for x in d)) for d in (new - old)]) * (1 + 1e-12)
    others = np.array([max((s for j, s in enumerate(step) if j != i), default=0.0) for i in range(len(step))])
    return step, others


def clustered(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 256, clusters: int = 40, rounds: int = 5,
              salt: str = "2:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid), one row for each vector that counts."""
    spark = vectors.sparkSession
    ints = integers(vectors, id, vector, dim, scale)
    centroids = first_centroids(ints, clusters, salt)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
    name, table = cells(ints, dim)
    drift, totals, state = np.zeros(k), [0] * (k * (dim + 1)), None
    for r in range(rounds + 1):
        state = _round(table, state, centroids, drift, dim)
        if r == rounds:
            break
        totals = [a + b for a, b in zip(totals, _sums(state, (k, dim + 1)))]
        new = centroids.copy()
        for c in range(k):
            count, *sums = totals[c * (dim + 1):(c + 1) * (dim + 1)]
            if count:
                new[c] = [s // count for s in sums]
        step, others = _moved(centroids, new)
        drift, centroids = (drift + step + others) * (1 + 1e-12), new

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for n, ids, nulls, m, a in zip(*rb.columns):
                n = n.as_py()
                mine = np.frombuffer(a.as_buffer(), "<i4")
                d = ((np.frombuffer(m.as_buffer(), "<i4").reshape(n, dim).astype(np.int64) - centroids[mine]) ** 2).sum(1)
                gone = np.unpackbits(np.frombuffer(nulls.as_buffer(), np.uint8), count=n).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_buffer(), "<i8"), mask=gone), pa.array(mine), pa.array(d)], names=["id", "cluster", "distance"])
    joined = table.select("cell", "n", "ids", "null_ids", "matrix").join(state.select("cell", "assigned"), "cell").drop("cell")
    out = written(joined.mapInArrow(batches, "id long, cluster int, distance long"))
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each cluster
    spark.sql(f"DROP TABLE {name}")  # the name only; nothing below reads it
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    most = np.iinfo(np.int64).max
    facts = [(c, min(s, most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist())
             for c, s in sorted(inertia.items())]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
    return out.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
