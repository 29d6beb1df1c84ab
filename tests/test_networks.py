import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import networks as N

COLUMNS = {"categorical": ["a_idx", "b_idx"], "binary": ["flag"], "numeric": ["x"]}
SIZES = {"a_idx": 6, "b_idx": 9}


def table(spark, n, seed, split):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, flag, x = rng.randrange(1, 6), rng.randrange(1, 9), rng.randrange(2), rng.gauss(0, 1)
        z = [0, 0, 1.5, -1, 0.5, -0.5][a] + (1.2 if (a + b) % 3 == 0 else -1.2) + 0.8 * x - flag
        rows.append((seed * 10**6 + i, int(rng.random() < 1 / (1 + np.exp(-z))), split, a, b, flag, x))
    return spark.createDataFrame(rows, "impression_id long, clk int, split string, a_idx long, b_idx long, flag int, x double")


@pytest.mark.parametrize("kind", N.KINDS)
def test_slopes_by_finite_differences(kind):
    rng = np.random.default_rng(1)
    net = N.Net.start(N.Settings(kind=kind, factors=3, hidden=(5, 4)), 12, 2, 2)
    net.table[1:] += rng.normal(size=net.table[1:].shape)
    at, x, y = rng.integers(0, 12, size=(7, 2)), rng.normal(size=(7, 2)), rng.integers(0, 2, size=7).astype(float)
    at[:, 1] = np.where(at[:, 1] == at[:, 0], (at[:, 1] + 1) % 12, at[:, 1])

    def loss():
        z, _ = net.forward(at, x)
        return (np.logaddexp(0, z) - y * z).mean()

    rows, dense = net.slopes(at, x, y)
    whole = np.zeros_like(net.table)
    np.add.at(whole, at, rows)
    for weights, slopes in [(net.table, whole), *[(net.dense[k], dense[k]) for k in net.dense]]:
        for i in np.ndindex(weights.shape):
            if weights is net.table and i[0] == 0:
                assert slopes[i] == 0
                continue
            was = weights[i]
            weights[i] = was + 1e-5
            up = loss()
            weights[i] = was - 1e-5
            down = loss()
            weights[i] = was
            assert abs((up - down) / 2e-5 - slopes[i]) < 1e-6


def test_walk_is_the_mean_of_single_steps():
    """Averaged descent against steps taken one row at a time with all weights kept."""
    rng = np.random.default_rng(2)
    at, x, y = rng.integers(0, 6, size=(40, 2)), rng.normal(size=(40, 3)), rng.integers(0, 2, size=40).astype(float)
    s = N.Settings(rate=0.1, penalty=0.01, batch=1)
    net = N.Net.start(s, 6, 2, 3)
    w, d, b, sums = np.zeros(6), np.zeros(3), 0.0, [np.zeros(6), np.zeros(3), 0.0]
    for a, v, t in zip(at, x, y):
        g = 1 / (1 + np.exp(-(b + w[a].sum() + v @ d))) - t
        for p in set(a.tolist()) - {0}:
            w[p] -= 0.1 * (g * (a == p).sum() + 0.01 * w[p])
        d, b = d - 0.1 * g * v, b - 0.1 * g
        sums = [sums[0] + w, sums[1] + d, sums[2] + b]
    got, met = net.walk([(at[:25], x[:25], y[:25]), (at[25:], x[25:], y[25:])])
    assert met.tolist() == sorted(set(at.ravel().tolist()) - {0})
    assert np.allclose(got.table[:, 0], sums[0] / 40) and np.allclose(got.dense["linear"], sums[1] / 40) and np.allclose(got.dense["bias"], sums[2] / 40)


@pytest.mark.parametrize("kind,least", [("linear", 0.03), ("wide_deep", 0.1), ("deepfm", 0.1)])
def test_training(spark, kind, least):
    train, val = table(spark, 6000, 1, "train"), table(spark, 1500, 2, "val")
    s = N.Settings(kind=kind, epochs=4, rate=0.05, batch=32, hidden=(16, 8), shards=4)
    fitted = N.train_network(train, val, COLUMNS, SIZES, s)
    scored = fitted(val).toPandas()
    y, p = scored.clk.to_numpy(), np.clip(scored.prediction.to_numpy().astype(float), 1e-7, 1 - 1e-7)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    base = y.mean()
    assert abs(loss - min(fitted.history)) < 1e-6 and loss < -(base * np.log(base) + (1 - base) * np.log(1 - base)) - least
    assert (fitted.net.table[0] == 0).all()
    again = N.train_network(train.repartition(7), val.repartition(3), COLUMNS, SIZES, s)
    assert again.history == pytest.approx(fitted.history, abs=1e-9)
    unknown = val.withColumns({"a_idx": F.lit(None).cast("long"), "x": F.lit(None).cast("double")})
    assert fitted(unknown).filter("prediction IS NULL OR isnan(prediction)").count() == 0


def test_stops_and_keeps_the_best(spark):
    train, val = table(spark, 400, 3, "train"), table(spark, 300, 4, "val")
    fitted = N.train_network(train, val, COLUMNS, SIZES, N.Settings(kind="deepfm", epochs=40, patience=2, rate=0.3, hidden=(32, 16), shards=2))
    assert len(fitted.history) < 40 and len(fitted.history) - 1 - int(np.argmin(fitted.history)) == 2
    with pytest.raises(ValueError, match="positions"):
        N.train_network(train, val, COLUMNS, {"a_idx": 10**9}, N.Settings())
    with pytest.raises(ValueError, match="no model"):
        N.train_network(train, val, COLUMNS, SIZES, N.Settings(kind="other"))
