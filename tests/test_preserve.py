import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import preserve as V


def basis(x, low, high):
    """Uniform cubic splines by the recursion, in plain numbers."""
    step = (high - low) / 5
    t = [low + step * (i - 3) for i in range(12)]
    x = np.clip(x, low, high)
    b = [((x >= t[i]) & (x < t[i + 1]) if i != 7 else x >= t[7]).astype(float) if i <= 7 else np.zeros_like(x) for i in range(11)]
    for d in (1, 2, 3):
        b = [(x - t[i]) / (step * d) * b[i] + (t[i + d + 1] - x) / (step * d) * b[i + 1] for i in range(len(b) - 1)]
    return np.stack([np.ones_like(x), *b], 1)


def solved(x, y, penalty=1.0):
    """The same fit with all rows in one matrix, until the gradient is gone."""
    b = basis(x, x.min(), x.max())
    w, ridge = np.zeros(9), np.diag([0.0] + [1 / penalty] * 8)
    for _ in range(200):
        p = 1 / (1 + np.exp(-b @ w))
        g = b.T @ (y - p) - ridge @ w
        if np.abs(g).max() < 1e-10:
            return w
        w = w + np.linalg.solve((b * (p * (1 - p))[:, None]).T @ b + ridge, g)
    raise AssertionError("no end")


def scene(spark, groups=3, n=400):
    rnd, rows = np.random.default_rng(2), []
    for g in range(groups):
        x = rnd.uniform(1 + g, 4 + g, n)
        y = rnd.random(n) < 1 / (1 + np.exp(-(np.sin(2 * x) * (1 + g) - 0.5)))
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
    return rows, spark.createDataFrame(rows, "split_id long, x double, y double")


def test_all_groups_equal_a_direct_solve(spark):
    rows, df = scene(spark)
    fits = V.fit_preservations(df)
    assert set(fits) == {0, 1, 2}
    for g, f in fits.items():
        x, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        want = solved(x, y)
        assert [f.intercept, *f.coefficients] == pytest.approx(want.tolist(), abs=1e-6)
        eta = basis(x, x.min(), x.max()) @ want
        assert f.bounds == pytest.approx((eta.min(), eta.max()), abs=1e-6)


def test_odd_groups(spark):
    df = spark.createDataFrame([(0, 2.0, 1.0), (0, 2.0, 0.0), (1, 1.0, 1.0), (1, 3.0, 1.0)], "split_id long, x double, y double")
    fits = V.fit_preservations(df)  # one place for all rows; one class only
    assert set(fits) == {0, 1} and all(np.isfinite([f.intercept, *f.coefficients]).all() for f in fits.values())
    assert V.fit_preservations(df.limit(0)) == {}


def test_held_out_areas_need_no_loop(spark):
    df = spark.range(3000).select(F.col("id").alias("point_id"), ((F.col("id") * 53) % 997).cast("double").alias("erosion_m"))
    df = df.withColumn("label", (F.xxhash64("point_id") % 997 > F.col("erosion_m")).cast("int"))
    mean, std = V.held_out_auc(df, 4)
    assert 0.6 < mean < 0.95 and 0 <= std < 0.05
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    V.held_out_auc(df, 12)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - jobs < 120  # not in proportion to the splits
