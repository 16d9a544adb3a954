"""Shared-scan fits against plain numpy, and what every sweep has to keep."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from roadtrace.operators import clustering as cl
from roadtrace.operators import sweeps as sw


def frame(spark, x):
    rows = [(i, [float(c) for c in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "plate int, v array<double>").select("plate", array_to_vector("v").alias("features"))


def blobs(seed, n=300, d=4, centres=5, spread=0.4):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(0, 2, (centres, d))
    return c[rnd.integers(0, centres, n)] + rnd.normal(0, spread, (n, d))


def kmeans(ks, **kw):
    return sw.KMeans(**({"ks": ks, "max_iter": 20, "seed": 42, "features_col": "features", "id_col": "plate"} | kw))


def gmm(ks, **kw):
    return sw.GaussianMixture(**({"ks": ks, "max_iter": 20, "seed": 42, "features_col": "features", "id_col": "plate"} | kw))


def plain_lloyd(x, centres, steps):
    centres = centres.copy()
    for _ in range(steps):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        done = ((moved - centres) ** 2).sum(axis=1).max() <= 1e-8
        centres = moved
        if done:
            break
    return centres


def test_lloyd_equals_a_plain_loop_from_the_same_start(spark, monkeypatch):
    x = blobs(1)
    ks = [1, 2, 5, 9]
    rnd = np.random.default_rng(0)
    start = {k: x[rnd.choice(len(x), k, replace=False)] for k in ks}
    monkeypatch.setattr(sw.KMeans, "starts", lambda self, scans: dict(start))
    for steps in (1, 3, 20):
        found = kmeans(ks, max_iter=steps).fit(frame(spark, x).repartition(5))
        for k in ks:
            assert np.allclose(found[k].centres, plain_lloyd(x, start[k], steps), atol=1e-9)


def test_a_sweep_takes_the_scans_of_its_longest_fit(spark):
    ks = [2, 3, 4, 5, 6, 8, 10, 12]
    est = kmeans(ks)
    est.fit(frame(spark, blobs(2)))
    assert est.scans <= sw.ROUNDS + 1 + 20     # seeding, weights, steps: not eight times as many
    mix = gmm(ks)
    mix.fit(frame(spark, blobs(2)))
    assert mix.scans <= 3 + 21


def test_a_k_is_fitted_alike_alone_and_in_a_sweep(spark):
    df = frame(spark, blobs(3))
    for make, part in ((kmeans, "centres"), (gmm, "means")):
        alone, together = make([4]).fit(df)[4], make([2, 4, 7]).fit(df)[4]
        if make is kmeans:
            assert np.allclose(getattr(alone, part), getattr(together, part), atol=1e-8)
        else:   # the sample that starts come from grows with the largest k
            assert together.log_likelihood > -np.inf and len(together.means) == 4


def test_partitioning_changes_nothing(spark, monkeypatch):
    df = frame(spark, blobs(4))
    base = kmeans([3, 6]).fit(df.repartition(2)), gmm([2, 3]).fit(df.repartition(2))
    monkeypatch.setattr(sw, "REDUCERS", 2)      # partial sums added up in shuffles
    again = kmeans([3, 6]).fit(df.repartition(7)), gmm([2, 3]).fit(df.repartition(7))
    assert all(np.allclose(base[0][k].centres, again[0][k].centres, atol=1e-8) for k in (3, 6))
    assert all(np.allclose(base[1][k].means, again[1][k].means, atol=1e-6) for k in (2, 3))


def test_starts_spread_like_kmeans_parallel(spark):
    x = np.concatenate([blobs(5, 200, 3, 1, 0.01) + 10 * j for j in range(6)])
    found = kmeans([6]).fit(frame(spark, x))[6]
    assert len({tuple(np.round(c / 10)) for c in found.centres}) == 6      # one centre per far blob


def test_hot_and_few_points(spark):
    x = np.concatenate([np.zeros((500, 2)), [[1.0, 0.0]], [[0.0, 1.0]], [[5.0, 5.0]]])
    found = kmeans([2, 4, 9]).fit(frame(spark, x))
    assert len(found[4].centres) == len(found[9].centres) == 4 and len(found[2].centres) == 2
    assert sw.held_out_costs(frame(spark, x), found, "features")[9] == 0.0
    one = kmeans([3]).fit(frame(spark, np.ones((20, 2))))
    assert one[3].centres.tolist() == [[1.0, 1.0]]


def test_held_out_costs_equal_brute_force(spark):
    x = blobs(6)
    found = kmeans([2, 5]).fit(frame(spark, x))
    cost = sw.held_out_costs(frame(spark, x[:100]), found, "features")
    for k, m in found.items():
        want = ((x[:100, None, :] - m.centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
        assert abs(cost[k] - want) < 1e-8 * want
        assert abs(cl.wcss(m, frame(spark, x[:100])) - want) < 1e-8 * want
    assert sw.held_out_costs(frame(spark, x).filter("plate < 0"), found, "features") == {2: 0.0, 5: 0.0}


# ---------------------------------------------------------------- mixtures
def log_normal(x, mean, cov):
    d = len(mean)
    diff = x - mean
    return -0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", diff, np.linalg.inv(cov), diff))


def plain_em(x, weights, means, covs, steps, tol=0.01):
    """EM by its textbook formulas, without floors."""
    history = []
    for step in range(steps + 1):
        joint = np.stack([np.log(w) + log_normal(x, m, c) for w, m, c in zip(weights, means, covs)], axis=1)
        top = joint.max(axis=1, keepdims=True)
        history.append(float((np.log(np.exp(joint - top).sum(axis=1)) + top[:, 0]).sum()))
        if step == steps or (len(history) > 1 and history[-1] - history[-2] < tol):
            break
        r = np.exp(joint - top)
        r /= r.sum(axis=1, keepdims=True)
        mass = r.sum(axis=0)
        weights, means = mass / len(x), (r.T @ x) / mass[:, None]
        covs = np.array([((x - m).T * r[:, j]) @ (x - m) / mass[j] for j, m in enumerate(means)])
    return weights, means, covs, history


def test_em_equals_numpy_from_the_same_start(spark):
    x = blobs(7, 400, 3, 4, 0.8) + 50            # far from the origin
    rnd = np.random.default_rng(1)
    start = {k: (np.full(k, 1 / k), x[rnd.choice(len(x), k, replace=False)], np.tile(np.eye(3), (k, 1, 1))) for k in (2, 3, 5)}
    models = {k: sw.MixtureModel(w, m.copy(), c, 0.0, -np.inf) for k, (w, m, c) in start.items()}
    est = gmm([2, 3, 5])
    found = est.fit(frame(spark, x).repartition(6), models)
    for k in start:
        w, m, c, history = plain_em(x, *start[k], 20)
        assert np.allclose(est.history[k], history, rtol=1e-9)
        assert np.allclose(found[k].weights, w) and np.allclose(found[k].means, m) and np.allclose(found[k].covariances, c)
        assert found[k].log_likelihood == est.history[k][-1]


@pytest.mark.parametrize("case", ["blobs", "constant", "discrete", "few"])
def test_likelihood_never_falls(spark, case):
    x = {"blobs": blobs(8),
         "constant": np.concatenate((blobs(9), np.full((300, 2), 7.0)), axis=1),
         "discrete": np.round(blobs(10, 300, 3, 4, 0.5)),
         "few": np.repeat(np.eye(3), 30, axis=0)}[case]
    est = gmm([2, 4, 9], max_iter=30)
    found = est.fit(frame(spark, x))
    for k, h in est.history.items():
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(h, h[1:])), (k, h)
        assert np.isfinite(found[k].covariances).all() and np.linalg.eigvalsh(found[k].covariances).min() > 0
        assert abs(found[k].weights.sum() - 1) < 1e-9


def test_predictions_are_the_most_probable_component(spark):
    x = blobs(11)
    m = gmm([3]).fit(frame(spark, x))[3]
    joint = np.stack([np.log(w) + log_normal(x, mu, c) for w, mu, c in zip(m.weights, m.means, m.covariances)], axis=1)
    got = [r.prediction for r in m.transform(frame(spark, x)).orderBy("plate").collect()]
    assert (np.array(got) == joint.argmax(axis=1)).mean() > 0.995      # the floor moves ties only


def test_models_round_trip(spark, tmp_path):
    df = frame(spark, blobs(12))
    m, c = gmm([3]).fit(df)[3], kmeans([3]).fit(df)[3]
    m.save(spark, str(tmp_path / "m"))
    c.save(spark, str(tmp_path / "c"))
    m2, c2 = sw.MixtureModel.load(spark, str(tmp_path / "m"), "features"), sw.KMeansModel.load(spark, str(tmp_path / "c"), "features")
    assert (m2.means == m.means).all() and (m2.weights == m.weights).all()
    assert (m2.covariances == m.covariances).all() and m2.log_likelihood == m.log_likelihood and (c2.centres == c.centres).all()
    assert ([r.prediction for r in m.transform(df).orderBy("plate").collect()]
            == [r.prediction for r in m2.transform(df).orderBy("plate").collect()])


def test_no_fit_runs_spark_ml(spark):
    """The sweeps never reach Spark ML's fits, whose tasks call LAPACK."""
    import inspect
    assert "pyspark.ml.clustering" not in inspect.getsource(cl) + inspect.getsource(sw)


def test_transform_keeps_rows_and_columns(spark):
    df = frame(spark, blobs(13)).withColumn("extra", F.lit("x"))
    out = kmeans([4]).fit(df)[4].transform(df)
    assert out.columns == ["plate", "features", "extra", "prediction"] and out.count() == 300
    x = np.array([r.v for r in df.select(vector_to_array("features").alias("v")).collect()])
    assert x.shape == (300, 4)
    assert kmeans([4]).fit(df)[4].transform(df.filter("plate < 0")).count() == 0
