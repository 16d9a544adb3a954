"""Feature scaling, vectorisation and clustering of plates.

The fits iterate over the partitioned feature table, all k of a sweep in the
same scans (``sweeps``); only model parameters -- k centres, k Gaussians --
live on the driver.  Everything around them is DataFrame code: scaling is one
aggregate, WCSS is an aggregate over distances to the k centres, anomaly
selection is a semi join with the small set of outlier clusters.
"""

from __future__ import annotations

import hashlib
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import RFormula
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from roadtrace.operators.sweeps import GaussianMixture, KMeans, KMeansModel, MixtureModel, all_predictions, held_out_costs
from roadtrace.sources.stages import exists

FEATURES = "features"
SEED = 42
# fixed values: the k sweeps and iteration count of the original analysis
KMEANS_KS = [2, 4, 6, 8, 10, 12, 15, 20, 30, 45]
GMM_KS = [2, 4, 6, 8, 10, 12, 15, 20, 30, 40]
MAX_ITER = 20
OUTLIER_SHARE = 0.05
TRAIN_SHARE = 0.7
PARALLELISM = 4   # models that are stored or loaded at a time


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns (decimals included)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def fill_undefined(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """Q17: undefined statistics (e.g. a speed over zero hours) become ``value``."""
    return df.na.fill(value, subset=cols)


def normalize(df: DataFrame, cols: list[str]) -> DataFrame:
    """M1: ``x / stddev_samp(x)`` per column, no centring; a constant column gives 0.0.

    Same result as ``StandardScaler(withStd=True, withMean=False)`` fitted per
    column.  The k standard deviations come from one aggregate (k numbers on
    the driver, like any scaler fit) and enter the projection as literals.
    """
    sds = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    out = []
    for f in df.schema.fields:
        if f.name in cols:
            sd = sds[f.name]
            expr = (F.lit(0.0) if not sd else F.col(f.name).cast("double") / F.lit(float(sd)))
            out.append(expr.alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def apply_pipeline_stages(df: DataFrame, stages: list[Estimator | Transformer]) -> DataFrame:
    """M8: fit the stages in order and transform ``df``."""
    return Pipeline(stages=stages).fit(df).transform(df)


def vectorize(df: DataFrame, id_col: str = "plate", include_id: bool = False,
              features_col: str = FEATURES) -> DataFrame:
    """M2: ``RFormula("label ~ .")`` without a label column.

    Strings are indexed and one-hot encoded (last category dropped), the rest
    assembled.  The id column is left out unless ``include_id`` (Q14: the
    original put the raw plate id into the vector, where it dominates distances).
    A string column with one value, or none in an empty frame, has no slot:
    its last category is the only one, which Spark's encoder refuses.
    """
    left_out = ([] if include_id else [id_col]) + _constant_strings(df, () if include_id else (id_col,))
    formula = " - ".join(["label ~ .", *left_out])
    return RFormula(formula=formula, featuresCol=features_col).fit(df).transform(df)


def _constant_strings(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """The string columns without two distinct values, found in one aggregate."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if not names:
        return []
    differ = df.agg(*[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(c) for c in names]).first()
    return [c for c in names if not differ[c]]


def plate_vectors(features: DataFrame) -> DataFrame:
    """M1 + M2 on the per-plate feature table."""
    num = numeric_columns(features, exclude=("plate",))
    scaled = normalize(fill_undefined(features, num), num)
    return vectorize(scaled)


# ----------------------------------------------------------------- split
def in_training(id_col: str = "plate", seed: int = SEED, share: float = TRAIN_SHARE) -> Column:
    """Which rows train: a bucket of md5(id, seed), so neither the partitioning nor the cluster changes the split."""
    head = F.substring(F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8)
    return F.conv(head, 16, 10).cast("long") % 100 < round(share * 100)


# ------------------------------------------------------------------ fits
def squared_distance_cost(df: DataFrame, centres: list[list[float]], features_col: str = FEATURES) -> DataFrame:
    """M4: the sum of squared distances of the rows to their nearest centre, as one row ``wcss``.

    ``centres`` are model parameters: k vectors, whatever the data's size.  Without any, no rows cost 0 and rows are
    an error.
    """
    costs = [_squared_distance(F.col("_v"), c) for c in centres]
    if not costs:
        costs = [F.raise_error(F.lit("no centres to measure rows against")).cast("double")]
    nearest = F.least(*costs) if len(costs) > 1 else costs[0]
    return (df.select(vector_to_array(features_col).alias("_v"))
            .agg(F.coalesce(F.sum(nearest), F.lit(0.0)).alias("wcss")))


def _squared_distance(v: Column, centre: list[float]) -> Column:
    d = F.zip_with(v, F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)


def wcss(model: KMeansModel, df: DataFrame, features_col: str = FEATURES) -> float:
    """M4 for a fitted model.

    ``KMeansModel.computeCost`` no longer exists; this is the same quantity
    (equal to ``summary.trainingCost`` on the training rows).
    """
    return float(squared_distance_cost(df, [list(c) for c in model.clusterCenters()], features_col).first().wcss)


def fit_models(df: DataFrame, algo: str, ks: list[int] | None = None, max_iter: int = MAX_ITER, seed: int = SEED,
               features_col: str = FEATURES, model_dir: str | None = None, id_col: str = "plate"):
    """M3 / M5 + S7: ``(k, model, score)`` for each k; K-means on the training share, mixtures on all rows.

    The ks that have to be fitted share every scan of the rows.  Every k gets
    a model: where the rows have fewer distinct points than k, a model of as
    many clusters as there are points, reported under k.  No rows to fit on
    give no models.  The score is the mixture's log-likelihood (None for K-means).  With ``model_dir`` models and
    scores are kept under a digest of the rows, the parameters, the seed and
    the vector's width, and fitted only if absent.
    """
    if algo not in ("kmeans", "gmm"):
        raise ValueError(f"unknown clustering algorithm {algo!r}; expected 'kmeans' or 'gmm'")
    ks = ks or (KMEANS_KS if algo == "kmeans" else GMM_KS)
    rows = df.filter(in_training(id_col, seed)) if algo == "kmeans" else df
    if not rows.take(1):
        return []
    spark = df.sparkSession
    digest = _digest(rows, features_col) if model_dir else ""
    paths = {k: f"{model_dir.rstrip('/')}/{'_'.join(map(str, (algo, k, max_iter, seed, digest)))}" if model_dir else None
             for k in ks}
    missing = [k for k in ks if not (paths[k] and exists(spark, f"{paths[k]}.score"))]
    fitted = {}
    if missing:
        estimator = KMeans if algo == "kmeans" else GaussianMixture
        fitted = estimator(ks=missing, max_iter=max_iter, seed=seed, features_col=features_col, id_col=id_col).fit(rows)

    def kept(k: int):
        if k in fitted:
            model, score = fitted[k], getattr(fitted[k], "log_likelihood", None)
            if paths[k]:  # S7: the score is written last and marks a complete entry
                model.save(spark, paths[k])
                spark.createDataFrame([(score,)], "score double").coalesce(1).write.mode("overwrite").parquet(f"{paths[k]}.score")
        else:
            model = (KMeansModel if algo == "kmeans" else MixtureModel).load(spark, paths[k], features_col)
            score = spark.read.schema("score double").parquet(f"{paths[k]}.score").first().score
        return k, model, score

    # a model's files are small jobs: a few at a time
    with ThreadPool(PARALLELISM) as pool:
        return pool.map(inheritable_thread_target(spark)(kept), ks, chunksize=1)


def _digest(df: DataFrame, features_col: str) -> str:
    """Digest of the rows (their multiset) and of the vector's width, in one aggregate."""
    row = F.xxhash64(*[vector_to_array(c.name) if c.name == features_col else F.col(c.name) for c in df.schema.fields
                       if c.name == features_col or not isinstance(c.dataType, VectorUDT)])
    found = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row),
                   F.max(F.size(vector_to_array(features_col)))).first()
    return hashlib.sha1(repr(tuple(found)).encode()).hexdigest()[:16]


def kmeans_sweep(df: DataFrame, ks: list[int] | None = None, max_iter: int = MAX_ITER,
                 seed: int = SEED, features_col: str = FEATURES, model_dir: str | None = None,
                 id_col: str = "plate") -> tuple[list[tuple[int, KMeansModel]], DataFrame]:
    """M3 + M4: fit K-means on the training share for each k, WCSS on the other rows (all k in one scan).

    Returns the models and a ``(algo, k, wcss)`` frame (the elbow data).
    """
    models = [(k, m) for k, m, _ in fit_models(df, "kmeans", ks, max_iter, seed, features_col, model_dir, id_col)]
    cost = held_out_costs(df.filter(~in_training(id_col, seed)), dict(models), features_col)
    rows = [("kmeans", k, cost[k]) for k, _ in models]
    return models, df.sparkSession.createDataFrame(rows, "algo string, k int, wcss double")


def gmm_sweep(df: DataFrame, ks: list[int] | None = None, max_iter: int = MAX_ITER,
              seed: int = SEED, features_col: str = FEATURES, model_dir: str | None = None,
              id_col: str = "plate") -> tuple[list[tuple[int, MixtureModel]], DataFrame]:
    """M5: Gaussian mixtures on all rows for each k; ``(algo, k, log_likelihood)``."""
    fits = fit_models(df, "gmm", ks, max_iter, seed, features_col, model_dir, id_col)
    rows = [("gmm", k, score) for k, _, score in fits]
    return [(k, m) for k, m, _ in fits], df.sparkSession.createDataFrame(rows, "algo string, k int, log_likelihood double")


def cluster_sweep(df: DataFrame, algo: str, ks: list[int] | None = None, **kw):
    """M7: dispatch by algorithm name."""
    if algo == "kmeans":
        return kmeans_sweep(df, ks, **kw)
    if algo == "gmm":
        return gmm_sweep(df, ks, **kw)
    raise ValueError(f"unknown clustering algorithm {algo!r}; expected 'kmeans' or 'gmm'")


# -------------------------------------------------------------- anomalies
def anomalies(predictions: DataFrame, share: float = OUTLIER_SHARE, prediction_col: str = "prediction",
              id_col: str = "plate", ordered: bool = True) -> DataFrame:
    """M6 + A9 + P14: rows in clusters holding less than ``share`` of all rows, by cluster and id.

    Cluster sizes are one aggregate (k rows); the outlier clusters (at most k)
    are applied as a broadcast semi join -- no ids travel through the driver.
    The order includes the id, so a large cluster is sorted by many tasks.
    """
    outliers = cluster_sizes(predictions, prediction_col).filter(F.col("share") < share).select(prediction_col)
    # at most k outlier clusters
    found = predictions.join(F.broadcast(outliers), prediction_col, "left_semi")
    return found.orderBy(prediction_col, id_col) if ordered else found


def sweep_anomalies(df: DataFrame, algo: str, models: list[tuple[int, KMeansModel | MixtureModel]],
                    id_col: str = "plate") -> DataFrame:
    """M6 for every model of a sweep: ``(algo, k, plate, prediction)``, ordered once over the whole result.

    All models predict in one scan; sizes are one aggregate over (k, cluster), applied as in ``anomalies``.
    Without models there are no rows.
    """
    if not models:
        return df.where(F.lit(False)).select(F.lit(algo).alias("algo"), F.lit(0).alias("k"), id_col, F.lit(0).alias("prediction"))
    found = all_predictions(df, models, id_col)
    sizes = found.groupBy("k", "prediction").agg(F.count(F.lit(1)).alias("count"))
    # one row per cluster of the sweep
    share = F.col("count") / F.sum("count").over(Window.partitionBy("k"))
    outliers = sizes.withColumn("share", share).filter(F.col("share") < OUTLIER_SHARE).select("k", "prediction")
    return (found.join(F.broadcast(outliers), ["k", "prediction"], "left_semi")
            .select(F.lit(algo).alias("algo"), "k", id_col, "prediction").orderBy("algo", "k", "prediction", id_col))


def cluster_sizes(predictions: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    """Size and share of each cluster (k rows; the window over them is as small)."""
    sizes = predictions.groupBy(prediction_col).agg(F.count(F.lit(1)).alias("count"))
    return sizes.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def save_anomalies(anoms: DataFrame, parquet_path: str, csv_path: str) -> None:
    """Full rows as Parquet; a CSV report without vector columns (Q10), read back from it."""
    anoms.write.mode("overwrite").parquet(parquet_path)
    anoms = anoms.sparkSession.read.schema(anoms.schema).parquet(parquet_path)
    flat = anoms.select(*[c.name for c in anoms.schema.fields if not isinstance(c.dataType, VectorUDT)])
    # anomalies grow with the number of plates: no single-file funnel
    flat.write.mode("overwrite").option("header", True).csv(csv_path)
