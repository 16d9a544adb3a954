"""Fits for all k of a sweep at once: K-means and Gaussian mixtures that share their scans (M3, M4, M5).

A scan reads the rows once and adds up, in numpy, the sufficient statistics of every model that is still moving: counts
and sums for K-means, weights, means and scatter matrices for mixtures.  Tasks hand over one partial sum per model;
with many tasks these are added in two shuffles, so the driver gets one per model whatever the number of tasks.  The
driver only updates parameters (k centres; k means and d x d matrices) and factorises the matrices: no task calls
LAPACK, whose Java version can loop forever when several threads of a JVM call it first.

Random choices are hashes of the row's id and the seed, so neither partitioning nor cluster changes a fit beyond the
rounding of its sums.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions of this module travel to the executors by value: they need no copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Partial sums beyond so many tasks are added up in shuffles, in as many groups per model.
REDUCERS = 32
#: Rows of one numpy step.
STEP = 1024
#: fixed values: convergence of the original's K-means (moved distance) and mixtures (log-likelihood)
MOVED, GAINED = 1e-4, 0.01
#: Rounds of k-means|| and rows of one round per cluster.
ROUNDS, PER_ROUND = 2, 2
#: Variance floor of a mixture's components, as a share of the features' mean variance.
RIDGE = 1e-6


# ------------------------------------------------------------------- scans
def _matrices(batches, column: str = "_v"):
    """Arrow batches as matrices of a few rows, with the batch slice each came from."""
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            part = b.slice(at, STEP)
            values = part.column(column)
            yield part, np.asarray(values.flatten(), np.float64).reshape(part.num_rows, -1)


class Scans:
    """Sums over the rows of a frame, one scan per call."""

    def __init__(self, rows: DataFrame, features_col: str, keys: dict[str, Column] | None = None):
        self.spark = rows.sparkSession
        self.rows = rows.select(vector_to_array(features_col).alias("_v"), *[c.alias(n) for n, c in (keys or {}).items()])
        self.tasks = REDUCERS + 1   # not known before the first scan
        self.done = 0

    def summed(self, partial: Callable[[np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
        """{key: sum over all rows} of the vectors that ``partial`` gives for a matrix of rows."""
        def run(batches):
            held: dict[int, np.ndarray] = {}
            for _, x in _matrices(batches):
                for key, v in partial(x).items():
                    held[key] = held[key] + v if key in held else v
            part = TaskContext.get().partitionId()
            if held:
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(held), pa.int32()), pa.array([1] * len(held), pa.int32()), pa.array(list(held), pa.int32()),
                    pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "tasks", "key", "total"])

        def add(data):
            data = data.sort_by("part")
            total = sum(np.frombuffer(x, np.float64) for x in data.column("total").to_pylist())
            return pa.table({"part": pa.array([min(data.column("part").to_pylist())], pa.int32()),
                             "tasks": pa.array([sum(data.column("tasks").to_pylist())], pa.int32()),
                             "key": data.column("key")[:1], "total": pa.array([total.tobytes()], pa.binary())})

        schema = "part int, tasks int, key int, total binary"
        parts = self.rows.select("_v").mapInArrow(run, schema)
        if self.tasks > REDUCERS:
            parts = parts.groupBy("key", F.pmod("part", F.lit(REDUCERS))).applyInArrow(lambda _, t: add(t), schema)
            parts = parts.groupBy("key").applyInArrow(lambda _, t: add(t), schema)
        self.done += 1
        out: dict[int, np.ndarray] = {}
        tasks: dict[int, int] = {}
        for r in sorted(parts.collect(), key=lambda r: (r.key, r.part)):   # at most REDUCERS rows per model
            v = np.frombuffer(r.total, np.float64)
            out[r.key] = out[r.key] + v if r.key in out else v
            tasks[r.key] = tasks.get(r.key, 0) + r.tasks
        self.tasks = max(tasks.values(), default=0)
        return out


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows x centres) squared distances; those that are only rounding are 0."""
    a, b = (x * x).sum(axis=1)[:, None], (centres * centres).sum(axis=1)
    d = a - 2 * (x @ centres.T) + b
    return np.where(d <= 1e-12 * (a + b), 0.0, d)


def all_predictions(df: DataFrame, models: list[tuple[int, KMeansModel | MixtureModel]], id_col: str) -> DataFrame:
    """``(k, id, prediction)`` of every model in one scan."""
    assigns = [m.assigner() for _, m in models]

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(v), STEP):
            x = np.stack(v.iloc[at: at + STEP])
            out += list(np.stack([a(x) for a in assigns], axis=1).astype(np.int32))
        return pd.Series(out, dtype=object)

    ks = F.array(*[F.lit(k) for k, _ in models])
    found = df.select(id_col, F.arrays_zip(ks.alias("k"), nearest(vector_to_array(models[0][1].features_col)).alias("prediction")).alias("_p"))
    return found.select(F.explode("_p").alias("_p"), id_col).select("_p.k", id_col, "_p.prediction")


def _predicted(df: DataFrame, assign: Callable[[np.ndarray], np.ndarray], features_col: str) -> DataFrame:
    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        out = [assign(np.stack(v.iloc[at: at + STEP])) for at in range(0, len(v), STEP)]
        return pd.Series(np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32))

    return df.withColumn("prediction", nearest(vector_to_array(features_col)))


# ----------------------------------------------------------------- K-means
@dataclass
class KMeansModel:
    """k centres."""
    centres: np.ndarray
    features_col: str = "features"

    def clusterCenters(self) -> list[np.ndarray]:   # noqa: N802 - as Spark ML names it
        return list(self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the nearest centre (the first of equally near ones)."""
        return _predicted(df, self.assigner(), self.features_col)

    def assigner(self) -> Callable[[np.ndarray], np.ndarray]:
        centres = self.centres
        return lambda x: _squared(x, centres).argmin(axis=1)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c.tolist()) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "cluster int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/data")

    @classmethod
    def load(cls, spark: SparkSession, path: str, features_col: str) -> KMeansModel:
        rows = spark.read.parquet(f"{path}/data").orderBy("cluster").collect()
        return cls(np.array([r.centre for r in rows]), features_col)


def _one_hot(which: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(which), k))
    out[np.arange(len(which)), which] = 1
    return out


def weighted_start(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted points by k-means++, moved by a few weighted Lloyd steps; all of them if there are no more."""
    points, of = np.unique(points, axis=0, return_inverse=True)
    weights = np.bincount(of.ravel(), weights, len(points))
    if len(points) <= k:
        return points
    rnd = np.random.default_rng([seed, k])
    weights = np.maximum(weights, 1e-9 * max(weights.max(), 1.0))
    chosen = [int(rnd.choice(len(points), p=weights / weights.sum()))]
    far = _squared(points, points[chosen]).min(axis=1)
    while len(chosen) < k:
        p = weights * far
        p[chosen] = 0
        if not p.any():     # the others are the chosen ones but for rounding
            break
        chosen.append(int(rnd.choice(len(points), p=p / p.sum())))
        far = np.minimum(far, _squared(points, points[chosen[-1:]])[:, 0])
    centres = points[chosen]
    for _ in range(30):
        hot = _one_hot(_squared(points, centres).argmin(axis=1), len(centres)) * weights[:, None]
        n = hot.sum(axis=0)
        moved = np.where(n[:, None] > 0, (hot.T @ points) / np.maximum(n, 1e-300)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def lloyd_sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Counts, sums and cost of the rows' nearest centres, in one vector."""
    d = _squared(x, centres)
    which = d.argmin(axis=1)
    hot = _one_hot(which, len(centres))
    return np.concatenate((hot.sum(axis=0), (hot.T @ x).ravel(), [d[np.arange(len(x)), which].sum()]))


class KMeans:
    """Lloyd's K-means for several k, from k-means|| starts; every scan serves all k.

    Seeding keeps a weighted reservoir per k and round: the rows with the least ``-ln(u) / d**2``, u a hash of the id
    and d the distance to the candidates so far, are a sample in proportion to d**2 whose size is exact.  Rounds go on
    beyond ``ROUNDS`` only while a k has fewer candidates than clusters and rows away from them.  A k above the number
    of distinct points gets as many clusters as there are points.
    """

    def __init__(self, ks: list[int], max_iter: int, seed: int, features_col: str, id_col: str):
        self.ks, self.max_iter, self.seed, self.features_col, self.id_col = ks, max_iter, seed, features_col, id_col

    def fit(self, rows: DataFrame) -> dict[int, KMeansModel]:
        scans = Scans(rows, self.features_col, {"_u": F.xxhash64(F.lit(self.seed), F.col(self.id_col).cast("string"))})
        centres = self.starts(scans)
        moving = set(centres)
        for _ in range(self.max_iter):
            if not moving:
                break
            now = {k: centres[k] for k in moving}
            sums = scans.summed(lambda x, now=now: {k: lloyd_sums(x, c) for k, c in now.items()})
            for k, c in now.items():
                n, total = sums[k][: len(c)], sums[k][len(c): -1].reshape(c.shape)
                moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)   # an empty cluster stays
                centres[k] = moved
                if ((moved - c) ** 2).sum(axis=1).max() <= MOVED**2:
                    moving.discard(k)
        self.scans = scans.done
        return {k: KMeansModel(c, self.features_col) for k, c in centres.items()}

    def starts(self, scans: Scans) -> dict[int, np.ndarray]:
        first = np.array([scans.rows.orderBy("_u", "_v").limit(1).first()._v])
        candidates = {k: first for k in self.ks}
        growing, done = set(self.ks), 0
        while growing:
            found = self._reservoirs(scans, {k: candidates[k] for k in growing}, done)
            done += 1
            for k in list(growing):
                if k in found:
                    candidates[k] = np.unique(np.concatenate((candidates[k], found[k])), axis=0)
                # no row away from the candidates: they are all the points there are
                if k not in found or (done >= ROUNDS and len(candidates[k]) >= k):
                    growing.discard(k)
        held = dict(candidates)
        weights = scans.summed(lambda x: {k: np.bincount(_squared(x, c).argmin(axis=1), minlength=len(c)).astype(np.float64)
                                          for k, c in held.items()})
        return {k: weighted_start(c, weights[k], k, self.seed) for k, c in candidates.items()}

    @staticmethod
    def _reservoirs(scans: Scans, candidates: dict[int, np.ndarray], done: int) -> dict[int, np.ndarray]:
        """{k: the round's sample}: at most PER_ROUND x k rows each, chosen per task before the shuffle."""
        def run(batches):
            best: dict[int, tuple] = {}
            for part, x in _matrices(batches):
                h = np.asarray(part.column("_u")).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (done + 1) % 2**64)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                for k, c in candidates.items():
                    d = _squared(x, c).min(axis=1)
                    away = np.flatnonzero(d > 0)
                    key, rows = -np.log(u[away]) / d[away], x[away]
                    if k in best:
                        key, rows = np.concatenate((best[k][0], key)), np.concatenate((best[k][1], rows))
                    least = np.argsort(key, kind="stable")[: PER_ROUND * k]
                    best[k] = key[least], rows[least]
            for k, (key, rows) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(key), pa.int32()), pa.array(key),
                                                  pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["k", "sort", "v"])

        scans.done += 1
        sample = scans.rows.mapInArrow(run, "k int, sort double, v array<double>")
        place = F.row_number().over(Window.partitionBy("k").orderBy("sort", "v"))
        chosen = sample.withColumn("place", place).where(F.col("place") <= PER_ROUND * F.col("k")).collect()
        return {k: np.array([r.v for r in chosen if r.k == k]) for k in {r.k for r in chosen}}


def held_out_costs(rows: DataFrame, models: dict[int, KMeansModel], features_col: str) -> dict[int, float]:
    """M4: the sum of squared distances to the nearest centre, for every k in one scan."""
    centres = {k: m.centres for k, m in models.items()}
    found = Scans(rows, features_col).summed(
        lambda x: {k: np.array([_squared(x, c).min(axis=1).sum()]) for k, c in centres.items()})
    return {k: float(found[k][0]) if k in found else 0.0 for k in models}


# ---------------------------------------------------------------- mixtures
@dataclass
class MixtureModel:
    """k weighted normal distributions; ``log_likelihood`` is that of the rows it was fitted on."""
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    ridge: float
    log_likelihood: float
    features_col: str = "features"

    def factors(self):
        """(whitening matrices side by side, whitened means, log constants): what a task needs.

        A component's density is ``N(x; mean, covariance) * exp(-ridge / 2 * tr(covariance**-1))``: with it, EM for
        covariances of at least ``ridge`` is exact, so the likelihood never falls.
        """
        k, d = self.means.shape
        white = np.linalg.inv(np.linalg.cholesky(self.covariances))          # on the driver: k matrices of d x d
        log_det = 2 * np.log(np.diagonal(white, axis1=1, axis2=2)).sum(axis=1)
        penalty = self.ridge * (white**2).sum(axis=(1, 2))
        const = np.log(self.weights) + 0.5 * (log_det - d * np.log(2 * np.pi) - penalty)
        return white.transpose(2, 0, 1).reshape(d, k * d), np.einsum("kij,kj->ki", white, self.means).ravel(), const

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the most probable component (the first of equally probable ones)."""
        return _predicted(df, self.assigner(), self.features_col)

    def assigner(self) -> Callable[[np.ndarray], np.ndarray]:
        factors = self.factors()
        return lambda x: joint_log(x, *factors).argmax(axis=1)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), m.tolist(), c.ravel().tolist(), float(self.ridge), float(self.log_likelihood))
                for i, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances))]
        spark.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<double>, ridge double, "
                              "log_likelihood double").coalesce(1).write.mode("overwrite").parquet(f"{path}/data")

    @classmethod
    def load(cls, spark: SparkSession, path: str, features_col: str) -> MixtureModel:
        rows = spark.read.parquet(f"{path}/data").orderBy("component").collect()
        means = np.array([r.mean for r in rows])
        d = means.shape[1]
        return cls(np.array([r.weight for r in rows]), means, np.array([r.covariance for r in rows]).reshape(-1, d, d),
                   rows[0].ridge, rows[0].log_likelihood, features_col)


def joint_log(x: np.ndarray, white: np.ndarray, whitened: np.ndarray, const: np.ndarray) -> np.ndarray:
    """(rows x components) log of weight times density."""
    y = x @ white - whitened
    return const - 0.5 * (y * y).reshape(len(x), len(const), -1).sum(axis=2)


def em_sums(x: np.ndarray, factors) -> np.ndarray:
    """Log-likelihood, responsibilities, weighted sums and scatter of the rows, in one vector."""
    joint = joint_log(x, *factors)
    top = joint.max(axis=1, keepdims=True)
    r = np.exp(joint - top)
    total = r.sum(axis=1, keepdims=True)
    r /= total
    scatter = np.concatenate([((x * r[:, j: j + 1]).T @ x).ravel() for j in range(r.shape[1])])
    return np.concatenate(([(np.log(total) + top).sum()], r.sum(axis=0), (r.T @ x).ravel(), scatter))


def em_step(model: MixtureModel, sums: np.ndarray, n: float) -> MixtureModel:
    """The parameters that maximise the expected likelihood of ``em_sums``."""
    k, d = model.means.shape
    mass = np.maximum(sums[1: 1 + k], 1e-12)
    first = sums[1 + k: 1 + k + k * d].reshape(k, d)
    second = sums[1 + k + k * d:].reshape(k, d, d)
    alive = sums[1: 1 + k] > 1e-12
    means = np.where(alive[:, None], first / mass[:, None], model.means)
    cov = second / mass[:, None, None] - means[:, :, None] * means[:, None, :]
    cov = (cov + cov.transpose(0, 2, 1)) / 2 + model.ridge * np.eye(d)
    cov = np.where(alive[:, None, None], cov, model.covariances)
    # rounding can leave a direction without variance slightly below the floor
    value, vector = np.linalg.eigh(cov)
    if value.min() < model.ridge:
        cov = np.einsum("kij,kj,klj->kil", vector, np.maximum(value, model.ridge), vector)
        cov = (cov + cov.transpose(0, 2, 1)) / 2
    return MixtureModel(mass / n, means, cov, model.ridge, model.log_likelihood, model.features_col)


class GaussianMixture:
    """EM for several k; every scan gathers the statistics of all mixtures that still gain.

    Starts: means by k-means++ from a hash-chosen sample of rows, the features' variances for every component.  Work is
    done around the features' mean, so scatter matrices don't cancel.  Stops as the original's fit does: after
    ``max_iter`` steps, or when the log-likelihood gains less than ``GAINED``.
    """

    def __init__(self, ks: list[int], max_iter: int, seed: int, features_col: str, id_col: str, ridge: float = RIDGE):
        self.ks, self.max_iter, self.seed, self.features_col, self.id_col, self.ridge = ks, max_iter, seed, features_col, id_col, ridge

    def fit(self, rows: DataFrame, start: dict[int, MixtureModel] | None = None) -> dict[int, MixtureModel]:
        """``start`` overrides the starts (in the features' own coordinates)."""
        scans = Scans(rows, self.features_col, {"_u": F.xxhash64(F.lit(self.seed), F.col(self.id_col).cast("string"))})
        moments = scans.summed(lambda x: {0: np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))})[0]
        n, d = moments[0], (len(moments) - 1) // 2
        mean = moments[1: 1 + d] / n
        models = dict(start) if start else self._starts(scans, mean)
        for m in models.values():
            m.means = m.means - mean
        self.history: dict[int, list[float]] = {k: [] for k in models}
        moving = set(models)
        for step in range(self.max_iter + 1):
            if not moving:
                break
            factors = scans.spark.sparkContext.broadcast({k: models[k].factors() for k in moving})
            sums = scans.summed(lambda x, f=factors: {k: em_sums(x - mean, v) for k, v in f.value.items()})
            factors.destroy()
            for k in list(moving):
                models[k].log_likelihood = float(sums[k][0])
                self.history[k].append(float(sums[k][0]))
                gained = len(self.history[k]) < 2 or self.history[k][-1] - self.history[k][-2] >= GAINED
                if step == self.max_iter or not gained:
                    moving.discard(k)
                else:
                    models[k] = em_step(models[k], sums[k], n)
        self.scans = scans.done
        for m in models.values():
            m.means = m.means + mean
        return models

    def _starts(self, scans: Scans, mean: np.ndarray) -> dict[int, MixtureModel]:
        around = scans.summed(lambda x: {0: ((x - mean) ** 2).sum(axis=0), 1: np.array([float(len(x))])})
        variance = around[0] / around[1][0]
        ridge = float(self.ridge * (variance.mean() or 1.0))
        scans.done += 1
        sample = np.array([r._v for r in scans.rows.orderBy("_u", "_v").limit(20 * max(self.ks)).collect()])
        out = {}
        for k in self.ks:
            means = weighted_start(sample, np.ones(len(sample)), k, self.seed)
            cov = np.tile(np.diag(np.maximum(variance, ridge)), (len(means), 1, 1))
            out[k] = MixtureModel(np.full(len(means), 1 / len(means)), means, cov, ridge, -np.inf, self.features_col)
        return out
