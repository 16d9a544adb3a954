"""Clustering invariants (seeded; rows-only in the driver's gate)."""

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from roadtrace.operators import clustering as cl


@pytest.fixture(scope="module")
def vec(spark):
    rows = [(i, float(i % 7), float((i * 3) % 11), "I" if i % 3 else "HR", 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "plate int, a double, b double, nationality string, c double")
    return cl.plate_vectors(df)


def test_normalize_matches_standard_scaler(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, 2.0, 4.0), (3, 6.0, 4.0)], "id int, x double, k double")
    ours = cl.normalize(df, ["x", "k"]).orderBy("id").collect()
    assert [r.k for r in ours] == [0.0, 0.0, 0.0]          # constant column -> 0.0
    va = VectorAssembler(inputCols=["x"], outputCol="v").transform(df)
    ref = (StandardScaler(inputCol="v", outputCol="s", withStd=True, withMean=False).fit(va).transform(va)
           .select("id", vector_to_array("s")[0].alias("s")).orderBy("id").collect())
    assert [round(a.x, 12) for a in ours] == [round(b.s, 12) for b in ref]


def test_numeric_columns():
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.DecimalType(10, 2)), T.StructField("b", T.StringType()),
                           T.StructField("c", T.LongType())])

    class Fake:
        pass
    f = Fake()
    f.schema = schema
    assert cl.numeric_columns(f) == ["a", "c"]


def test_vector_excludes_plate(vec):
    # one-hot of 2 nationalities (last dropped) + 3 numeric columns
    assert len(vec.first().features) == 4


def test_wcss_equals_training_cost(vec):
    model = KMeans(k=3, maxIter=20, seed=42).fit(vec)
    assert abs(cl.wcss(model, vec) - model.summary.trainingCost) < 1e-6


def test_sweeps_and_anomalies(vec):
    models, elbow = cl.cluster_sweep(vec, "kmeans", ks=[2, 4])
    assert [r.k for r in elbow.orderBy("k").collect()] == [2, 4]
    pred = models[1][1].transform(vec).select("plate", "prediction")
    sizes = cl.cluster_sizes(pred)
    assert sizes.agg(F.sum("count")).first()[0] == 60
    anom = cl.anomalies(pred)
    small = {r.prediction for r in sizes.filter("share < 0.05").collect()}
    assert {r.prediction for r in anom.collect()} == small
    _, fits = cl.cluster_sweep(vec, "gmm", ks=[2])
    assert fits.count() == 1
    with pytest.raises(ValueError):
        cl.cluster_sweep(vec, "dbscan")


def test_anomaly_share_is_strict(spark):
    pred = spark.createDataFrame([(i, 0 if i < 95 else 1) for i in range(100)], "plate int, prediction int")
    assert cl.anomalies(pred).count() == 0          # 5 of 100 is not < 5 %
    pred = spark.createDataFrame([(i, 0 if i < 96 else 1) for i in range(100)], "plate int, prediction int")
    assert cl.anomalies(pred).count() == 4


def test_model_store_and_anomaly_sink(spark, vec, tmp_path):
    models, _ = cl.kmeans_sweep(vec, ks=[2], model_dir=str(tmp_path / "models"))
    again, _ = cl.kmeans_sweep(vec, ks=[2], model_dir=str(tmp_path / "models"))   # loaded, not refitted
    assert [list(c) for c in models[0][1].clusterCenters()] == [list(c) for c in again[0][1].clusterCenters()]
    pred = models[0][1].transform(vec)
    cl.save_anomalies(pred, str(tmp_path / "anom.parquet"), str(tmp_path / "anom_csv"))
    assert spark.read.parquet(str(tmp_path / "anom.parquet")).count() == 60
    assert "features" not in spark.read.option("header", True).csv(str(tmp_path / "anom_csv")).columns


def test_loaded_mixtures_keep_their_score(spark, vec, tmp_path):
    store = str(tmp_path / "models")
    cl.fit_models(vec, "gmm", [2, 3], model_dir=store)        # as the anomalies query does, before the sweep
    first = {r.k: r.log_likelihood for r in cl.gmm_sweep(vec, ks=[2, 3], model_dir=store)[1].collect()}
    again = {r.k: r.log_likelihood for r in cl.gmm_sweep(vec, ks=[2, 3], model_dir=store)[1].collect()}
    assert first == again and all(x is not None for x in first.values())


def test_store_tells_data_seed_and_parameters_apart(spark, vec, tmp_path, monkeypatch):
    store = str(tmp_path / "models")
    fits = []
    real = cl.KMeans
    monkeypatch.setattr(cl, "KMeans", lambda **kw: fits.append(kw) or real(**kw))
    for df, kw in ((vec, {}), (vec, {}), (vec.filter("plate < 50"), {}), (vec, {"seed": 7}), (vec, {"max_iter": 3})):
        cl.kmeans_sweep(df, ks=[2], model_dir=store, **kw)
    assert len(fits) == 4                                     # only the second call found its model


def test_a_broken_model_is_an_error(spark, vec, tmp_path):
    import os
    store = str(tmp_path / "models")
    cl.kmeans_sweep(vec, ks=[2], model_dir=store)
    model = next(d for d in os.listdir(store) if not d.endswith(".score"))
    os.rename(f"{store}/{model}/data", f"{store}/{model}/elsewhere")
    with pytest.raises(Exception):
        cl.kmeans_sweep(vec, ks=[2], model_dir=store)


def test_split_does_not_depend_on_the_partitioning(vec):
    def trained(df):
        return sorted(r.plate for r in df.filter(cl.in_training()).collect())
    assert trained(vec.repartition(3)) == trained(vec.repartition(7)) == trained(vec)
    assert 0.5 < len(trained(vec)) / 60 < 0.9
    assert trained(vec.withColumn("plate", F.col("plate") + 1000)) != [x + 1000 for x in trained(vec)]


def test_apply_pipeline_stages(spark):
    from pyspark.ml.feature import StringIndexer
    df = spark.createDataFrame([("I",), ("HR",), ("I",)], "nationality string")
    out = cl.apply_pipeline_stages(df, [StringIndexer(inputCol="nationality", outputCol="idx")])
    assert {r.nationality: r.idx for r in out.collect()} == {"I": 0.0, "HR": 1.0}


def test_every_k_gets_a_model_and_a_number(spark, vec):
    small = vec.limit(5)
    for algo in ("kmeans", "gmm"):
        models, report = cl.cluster_sweep(small, algo, ks=[2, 8, 45])
        assert [k for k, _ in models] == [2, 8, 45]
        assert all(r[2] is not None for r in report.collect()) and report.count() == 3


def test_sweep_anomalies_are_ordered_by_cluster_and_plate(spark, vec):
    models, _ = cl.kmeans_sweep(vec, ks=[6, 12, 20])
    found = cl.sweep_anomalies(vec, "kmeans", models).collect()
    keys = [(r.algo, r.k, r.prediction, r.plate) for r in found]
    assert keys == sorted(keys) and keys


def test_sweep_anomalies_equal_those_of_each_model(spark, vec):
    for algo, ks in (("kmeans", [6, 12, 20]), ("gmm", [4, 9])):
        models, _ = cl.cluster_sweep(vec, algo, ks=ks)
        got = {(r.k, r.plate, r.prediction) for r in cl.sweep_anomalies(vec, algo, models).collect()}
        want = {(k, r.plate, r.prediction) for k, m in models
                for r in cl.anomalies(m.transform(vec).select("plate", "prediction")).collect()}
        assert got == want
