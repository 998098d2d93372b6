"""Exact k-means over integer vectors with Yinyang bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable
from .common import drop_scratch, scratch_path

#: Components lie within this, so that a squared distance of 64 components fits a long.
MOST = 1 << 27
#: Rows that are measured together.
BLOCK = 4096
#: Bounds give way by this share at each step, which covers rounding.
SLACK = 1e-12
STATE = "vec_id long, q array<int>, cluster int, upper double, lower array<double>, measured long, distance long"


def quantised(vectors: DataFrame, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``q``, each component x as the integer floor(scale * x), x as double.

    Vectors null, of another size, or with null or non-finite components are left out. Rows
    repeated under one id and null ids stay, each row for itself. A component of 2^27 or
    more after scaling fails the job, as distances would leave a long.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter((F.size("v") == size) & ~odd)
    far = F.exists("v", lambda x: F.abs(x * scale) >= MOST)
    error = F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")
    return rows.select("vec_id", F.when(far, error).otherwise(F.transform("v", lambda x: F.floor(x * scale).cast("int"))).alias("q"))


def least_hashes(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, all if there are fewer; null ids hash as empty text, ties go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r.q for r in first], np.int64)


@dataclass
class Step:
    """Centroids with their groups, and how far each has moved since bounds were last kept; nothing moved before the first step."""

    centers: np.ndarray
    group: np.ndarray
    drift: np.ndarray | None
    last: bool

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cluster, upper bound, a lower bound for each group without the own centroid, and the distances measured for each vector.

        A vector whose groups are all farther than its own centroid stays; else its own distance
        is measured and groups, then single centroids, that are farther drop out; the others are
        measured exactly. Only what is strictly farther drops out, so ties go to the smaller number.
        """
        if self.drift is None:
            exact = np.stack([_squares(x, c) for c in self.centers], 1)
            a = exact.argmin(1)
            rows = np.arange(len(x))
            return a, _over(np.sqrt(exact[rows, a])), self._lower(_under(np.sqrt(exact)), a), np.full(len(x), len(self.centers))
        most = np.array([self.drift[self.group == g].max() for g in range(lower.shape[1])])
        before, lower = lower, _under(lower, most)
        upper = _over(upper + self.drift[a])
        measured = np.zeros(len(x), np.int64)
        near = np.flatnonzero(lower.min(1) <= upper)
        own = _squares(x[near], self.centers[a[near]])
        upper[near] = _over(np.sqrt(own))
        measured[near] += 1
        still = lower[near].min(1) <= upper[near]
        near, own = near[still], own[still]
        if len(near):
            rows, mine = np.arange(len(near)), a[near]
            bound = _under(before[near][:, self.group], self.drift)
            open_ = (lower[near][:, self.group] <= upper[near, None]) & (bound <= upper[near, None])
            open_[rows, mine] = False
            exact = np.full(bound.shape, np.iinfo(np.int64).max)
            exact[rows, mine] = own
            bound[rows, mine] = _under(np.sqrt(own))
            for c in np.flatnonzero(open_.any(0)):
                at = np.flatnonzero(open_[:, c])
                exact[at, c] = _squares(x[near[at]], self.centers[c])
                bound[at, c] = _under(np.sqrt(exact[at, c]))
            best = exact.argmin(1)
            a[near], upper[near] = best, _over(np.sqrt(exact[rows, best]))
            lower[near] = self._lower(bound, best)
            measured[near] += open_.sum(1)
        return a, upper, lower, measured

    def _lower(self, bound: np.ndarray, a: np.ndarray) -> np.ndarray:
        bound[np.arange(len(bound)), a] = np.inf
        return np.stack([bound[:, self.group == g].min(1) for g in range(self.group.max() + 1)], 1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(1)


def _over(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _under(x: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
    return np.where(np.isinf(x), x, x - less - SLACK * (np.abs(np.where(np.isinf(x), 0, x)) + less))


def grouped(centers: np.ndarray, groups: int, steps: int = 5) -> np.ndarray:
    """A group for every centroid: a few rounds of k-means among the centroids, started by taking the farthest."""
    x = centers.astype(np.float64)
    heads = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(heads) < min(groups, len(x)) and far.max() > 0:
        heads.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[heads[-1]]) ** 2).sum(1))
    means = x[heads]
    for _ in range(steps):
        near = np.stack([((x - m) ** 2).sum(1) for m in means], 1).argmin(1)
        means = np.stack([x[near == g].mean(0) if (near == g).any() else m for g, m in enumerate(means)])
    near = np.stack([((x - m) ** 2).sum(1) for m in means], 1).argmin(1)
    return np.unique(near, return_inverse=True)[1]


def _assigned(state: DataFrame, step: Step) -> DataFrame:
    """The state with every vector assigned anew; before the first step it has only ``vec_id`` and ``q``."""
    shared = state.sparkSession.sparkContext.broadcast(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        groups = int(step.group.max()) + 1
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = _matrix(b.column(1)).astype(np.int64)
                if step.drift is None:
                    a, upper, lower, before = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros((len(x), groups)), np.zeros(len(x), np.int64)
                else:
                    a, upper = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().copy()
                    lower, before = _matrix(b.column(4)), b.column(5).to_numpy()
                a, upper, lower, measured = step.assign(x, a, upper, lower)
                distance = pa.array(_squares(x, step.centers[a])) if step.last else pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(a, pa.int32()), pa.array(upper), _lists(lower), pa.array(before + measured), distance],
                    names=["vec_id", "q", "cluster", "upper", "lower", "measured", "distance"],
                )

    return state.mapInArrow(run, STATE)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _sums(state: DataFrame, k: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of every cluster that has vectors; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                x, a = _matrix(b.column(1)).astype(np.int64), b.column(0).to_numpy()
                total = np.zeros((k, x.shape[1]), np.int64) if total is None else total
                np.add.at(total, a, x)
                n += np.bincount(a, minlength=k)
        if total is not None:
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), _lists(total[at])], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "q").mapInArrow(run, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in cells.orderBy("cluster", "pos").collect():  # the size of the model
        out.setdefault(r.cluster, (r.n, []))[1].append(r.s)
    return out


def yinyang(rows: DataFrame, centers: np.ndarray, rounds: int, groups: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Vectors in the clusters of ``rounds`` rounds of k-means, and the final centroids.

    ``rows`` has ``vec_id`` and ``q``, arrays of integers of one size without nulls. Each
    round assigns every vector to the nearest of ``centers`` (squared Euclidean
    distance, ties to the smaller number), then sets each centroid that has vectors to the
    componentwise floor of their mean; an empty one stays. Then vectors are assigned once
    more. Centroids are grouped once, by default in a fifth as many groups; every vector
    carries an upper bound to its own centroid and a lower one for each group, in a table
    in the shared folder that each round rewrites. All arithmetic that decides is on integers.

    Returns ``vec_id, q, cluster, distance, measured`` (exact distances measured by the
    search so far) and the centroids. Without centroids no row is returned.
    """
    spark = rows.sparkSession
    ensure_importable(spark)
    shape = ["vec_id", "q", "cluster", "distance", "measured"]
    if not len(centers):
        return spark.createDataFrame([], STATE).select(*shape), centers
    group = grouped(centers, groups or -(-len(centers) // 5))
    drift, state, kept = None, rows.select("vec_id", "q"), None
    for at in range(rounds + 1):
        path = scratch_path(spark, "clusters")
        _assigned(state, Step(centers, group, drift, at == rounds)).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if kept:
            drop_scratch([kept])
        kept = path
        if at < rounds:
            moved = centers.copy()
            for c, (n, sums) in _sums(state, len(centers)).items():
                moved[c] = [s // n for s in sums]
            drift = _over(np.sqrt(_squares(moved, centers)))
            centers = moved
    return state.select(*shape), centers


def clustered(rows: DataFrame, centers: np.ndarray, rounds: int, groups: int | None = None) -> DataFrame:
    """``yinyang`` with what belongs to each cluster: ``vec_id, cluster, distance, measured, cluster_inertia, inertia, centroid``.

    Inertia is the sum of squared distances over the cluster and over all; beyond a long it fails the job.
    """
    found, centers = yinyang(rows, centers, rounds, groups)
    totals = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    model = [(c, totals.get(c, 0), sum(totals.values()), x) for c, x in enumerate(centers.tolist())]
    model = found.sparkSession.createDataFrame(model, "of int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(model), F.col("cluster") == F.col("of")).select(
        "vec_id", "cluster", "distance", "measured", "cluster_inertia", "inertia", "centroid"
    )
