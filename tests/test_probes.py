"""Models fitted together against models fitted one by one, by a plain solver and by MLlib."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.operators import jointfits, probes


def table(spark, n=180, width=5, subjects=6):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, width)) * [1, 5, 0.1, 1, 0] + [0, 100, 0, -3, 7]  # the last column never varies
    y = (np.arange(n) % 3).astype(int)
    x[np.arange(n), y] += [2.0, 3.0, 0.2][0] * (y == 0) + 3.0 * (y == 1) + 0.2 * (y == 2)
    rows = [(i, f"s{(i * 7) % subjects}", int(y[i]), float(2 * x[i, 0] - x[i, 3] + rng.normal()), x[i].tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, subject string, y int, z double, x array<double>").repartition(4)


def test_ridge_without_refits_equals_direct_fits(spark):
    rows, df = table(spark)
    ids = np.array([r[0] for r in rows])
    subjects, z, x = np.array([r[1] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    out = probes.left_out(df.drop("y").withColumnRenamed("z", "y"), "subject", "regression", [0.5, 20.0], 3, ["id", "subject"])
    got = {(r.id, r.parameter): r.yhat for r in out.collect()}
    assert len(got) == 2 * len(rows)
    for name in sorted(set(subjects)):
        fit = subjects != name
        mean, deviation = x[fit].mean(axis=0), x[fit].std(axis=0, ddof=1)
        scaled = np.where(deviation > 1e-12, (x - mean) / np.where(deviation > 1e-12, deviation, 1), 0.0)
        for penalty in (0.5, 20.0):
            w = np.linalg.solve(scaled[fit].T @ scaled[fit] + penalty * np.eye(5), scaled[fit].T @ (z[fit] - z[fit].mean()))
            want = scaled[~fit] @ w + z[fit].mean()
            assert [got[i, penalty] for i in ids[~fit].tolist()] == pytest.approx(want.tolist(), abs=1e-8)


def test_classifiers_of_all_groups_equal_mllib_one_by_one(spark):
    rows, df = table(spark)
    out = probes.left_out(df, "subject", "multiclass", [0.1, 1.0], 3, ["id"])
    got = {(r.id, r.parameter): r.yhat for r in out.collect()}
    assert len(got) == 2 * len(rows)
    plain = probes.with_features(df, "x")
    for name in ("s0", "s3"):
        for parameter in (0.1, 1.0):
            one = probes.fit_predict(plain.where(F.col("subject") != name), plain.where(F.col("subject") == name), "multiclass", parameter)
            want = {r.id: r.yhat for r in one.select("id", "yhat").collect()}
            assert sum(got[i, parameter] == v for i, v in want.items()) >= len(want) - 1  # a row on the border may fall either way


def test_turns_change_nothing(spark, monkeypatch):
    _, df = table(spark, 90)
    whole = sorted(map(tuple, probes.left_out(df, "subject", "multiclass", [1.0], 3, ["id"]).collect()))
    monkeypatch.setattr(jointfits, "MODEL_BYTES", 8 * 3 * 6 * 2)
    assert sorted(map(tuple, probes.left_out(df, "subject", "multiclass", [1.0], 3, ["id"]).collect())) == whole


def test_passes_do_not_grow_with_the_grid(spark, monkeypatch):
    _, df = table(spark, 90)
    plain = jointfits.reduced

    def passes(grid):
        seen = []
        monkeypatch.setattr(jointfits, "reduced", lambda *a: (seen.append(1), plain(*a))[1])
        probes.left_out(df, "subject", "multiclass", grid, 3, ["id"])
        return len(seen)

    assert passes([1.0]) == passes([1.0] * 5)


def test_moments_without_a_part_keep_their_digits():
    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(size=(1000, 2)) * 1e-3
    part = lambda v: (np.array([float(len(v))]), v.mean(axis=0)[None], ((v - v.mean(axis=0)) ** 2).sum(axis=0)[None])
    both = jointfits.merged(part(x[:300]), part(x[300:]))
    n, mean, squares = jointfits.without(both, part(x[:300]))
    assert n[0] == 700 and mean[0] == pytest.approx(x[300:].mean(axis=0), rel=1e-15)
    assert squares[0] == pytest.approx(((x[300:] - x[300:].mean(axis=0)) ** 2).sum(axis=0), rel=1e-3)


def test_metadata_unseen_in_training_counts_as_zeros(spark):
    rows = [(i, i % 3, "abc"[i % 3] if i < 60 else "new", i % 2 if i < 60 else 2, float(i % 3)) for i in range(63)]
    df = spark.createDataFrame(rows, "id int, y int, kind string, fold int, n double")
    out = probes.left_out(probes.metadata_vectors(df, ["kind"], ["n"]), "fold", "multiclass", [1.0], 3, ["id"])
    guesses = {r.id: r.yhat for r in out.collect()}
    assert [guesses[i] for i in range(60)] == [i % 3 for i in range(60)] and [guesses[i] for i in (60, 62)] == [0, 2]


def test_a_pass_holds_no_more_for_more_models(spark, monkeypatch):
    """200 label permutations in three folds are 600 models; what a task holds of a slice must not grow with them."""
    import tracemalloc

    rng = np.random.default_rng(1)
    x, ys, g = rng.normal(size=(2048, 8)), rng.integers(0, 3, (2048, 200)), rng.integers(0, 3, 2048)
    peaks = []

    def here(rows, columns, per_batch, merge, at_once=jointfits.SLICE):
        held = None
        for at in range(0, len(x), at_once):
            tracemalloc.start()
            part = per_batch(x[at:at + at_once], ys[at:at + at_once], g[at:at + at_once])
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            held = part if held is None else merge(held, part)
        return held

    monkeypatch.setattr(jointfits, "reduced", here)
    specs = [(k, i) for k in range(3) for i in range(200)]
    fits = jointfits.JointFits(None, 3, [k for k, _ in specs], [i for _, i in specs], [1.0] * 600, 3)
    point = rng.normal(size=(600, 3, 9))
    peaks.clear()
    value, slope = fits.loss(point, np.arange(600))
    assert max(peaks) < 64 << 20
    monkeypatch.setattr(jointfits, "HELD_SCORES", 1 << 30)
    again, slopes = fits.loss(point, np.arange(600))
    assert np.allclose(value, again, rtol=1e-12) and np.allclose(slope, slopes, rtol=1e-9, atol=1e-14)
    assert max(peaks) > 64 << 20
