"""Many linear probe models over the same rows, fitted side by side: folds, held-out subjects, labels and penalties at once.

A model is (group left out, label, penalty). Rows carry their group's number, so leaving a group out is a mask, and what a
model needs of its training rows (mean, spread, class counts) is the total less the group. Classifiers take every step of all models
in one pass over the data; ridge models need one pass in all: cross products per group, a subtraction and a small solve per model.
The number of jobs depends on the steps the slowest model takes, never on how many models there are.

Held by the driver and by tasks: the models (at most ``MODEL_BYTES`` at a time, more go in turns) and per-group moments.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trialloom.session import cut

ITERATIONS = 3000  # at most; a fit that needs more is an error
TOLERANCE = 1e-7  # relative decrease of the loss at which a fit has converged
MODEL_BYTES = 32 << 20
GRAM_BYTES = 64 << 20
SLICE = 2048
HELD_SCORES = 1 << 20  # scores (rows x models x classes) that a task holds in one array; a pass has about six such arrays


def rows_at_once(models: int, classes: int) -> int:
    """Rows of a slice: the more models are fitted together, the fewer."""
    return max(1, min(SLICE, HELD_SCORES // max(1, models * classes)))


def numbered_groups(df: DataFrame, group: str) -> tuple[DataFrame, list]:
    """``df`` with ``_g``, the group's number in sorted order, and the groups."""
    names = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    fields = StructType([StructField("_name", df.schema[group].dataType), StructField("_g", IntegerType())])
    index = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(names)], fields)
    return df.join(index, df[group].eqNullSafe(F.col("_name"))).drop("_name"), names


def merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred squares of two parts together, part by part of the leading axis."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)[..., None]
    step = b[1] - a[1]
    return n, a[1] + step * share, a[2] + b[2] + step * step * (a[0][..., None] * share)


def without(total: tuple, part: tuple) -> tuple:
    """Count, mean and centred squares of the rest."""
    n = total[0] - part[0]
    some = np.maximum(n, 1)[..., None]
    mean = total[1] + (total[1] - part[1]) * (part[0][..., None] / some)
    step = part[1] - mean
    squares = total[2] - part[2] - step * step * (n * part[0] / np.maximum(total[0], 1))[..., None]
    return n, mean, np.maximum(squares, 0.0)


def reduced(rows: DataFrame, columns: list[str], per_batch: Callable, merge: Callable, at_once: int = SLICE):
    """``merge`` over all tasks of what ``per_batch`` makes of slices of ``at_once`` rows (arrays become matrices); None without rows."""
    wanted = rows.select(*columns)

    def run(batches):
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = per_batch(*(_matrix(c) for c in batch.slice(at, at_once).columns))
                held = part if held is None else merge(held, part)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["part"])

    parts = wanted.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r["part"]))
    return None if parts.isEmpty() else parts.treeReduce(merge)


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return np.asarray(pc.list_flatten(column)).reshape(len(column), -1)
    return np.asarray(column)


def _added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b)]


class JointFits:
    """Balanced multinomial classifiers: features scaled on the model's own training rows, mean weighted loss, ridge on the weights."""

    def __init__(self, rows: DataFrame, groups: int, held: list[int], label: list[int], inverse: list[float], classes: int):
        """rows: x (array<double>), ys (array<int>, one entry per label), _g. Model i leaves group ``held[i]`` out (-1: none),
        predicts ``ys[label[i]]`` and has the inverse penalty ``inverse[i]``."""
        self.rows, self.classes = rows, classes
        self.held, self.label = np.array(held), np.array(label)
        labels = int(max(label)) + 1

        def moments(x, ys, g):
            n = np.bincount(g, minlength=groups).astype(float)
            mean, squares = np.zeros((groups, x.shape[1])), np.zeros((groups, x.shape[1]))
            for k in np.unique(g):
                own = x[g == k]
                mean[k] = own.mean(axis=0)
                squares[k] = ((own - mean[k]) ** 2).sum(axis=0)
            counts = np.zeros((groups, labels, classes))
            for i in range(labels):
                np.add.at(counts[:, i], (g, ys[:, i]), 1.0)
            return n, mean, squares, counts

        n, mean, squares, counts = reduced(rows, ["x", "ys", "_g"], moments, lambda a, b: (*merged(a[:3], b[:3]), a[3] + b[3]))
        total = (n[:1], mean[:1], squares[:1])
        for k in range(1, groups):
            total = merged(total, (n[k:k + 1], mean[k:k + 1], squares[k:k + 1]))
        out = np.maximum(self.held, 0)
        rest = without(tuple(np.repeat(t, len(held), axis=0) for t in total), (n[out], mean[out], squares[out]))
        whole = (self.held < 0)
        self.n, self.mean, squares = (np.where(whole.reshape(-1, *[1] * (r.ndim - 1)), t, r) for r, t in zip(rest, total))
        deviation = np.sqrt(squares / np.maximum(1.0, self.n - 1)[:, None])
        flat = deviation <= 1e-12 * np.maximum(1.0, np.abs(self.mean))  # what a subtraction leaves of no spread
        self.scale = np.where(flat, 0.0, 1.0 / np.where(flat, 1.0, deviation))
        seen = counts.sum(axis=0)[self.label] - np.where(whole[:, None, None], 0.0, counts[out, self.label][:, None])[:, 0]
        present = (seen > 0).sum(axis=1, keepdims=True)
        self.weights = np.where(seen > 0, self.n[:, None] / (np.maximum(present, 1) * np.maximum(seen, 1.0)), 0.0)
        self.penalty = (2.0 if classes == 2 else 1.0) / (np.array(inverse, float) * np.maximum(self.n, 1.0))  # two classes share one vector there
        self.points: np.ndarray | None = None

    def raw(self, point: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes and intercepts on the features as they are."""
        slopes = point[:, :, :-1] * self.scale[only][:, None, :]
        return slopes, point[:, :, -1] - (slopes * self.mean[only][:, None, :]).sum(axis=2)

    def loss(self, point: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss and gradient of the models ``only`` at ``point`` (models x classes x inputs), in one pass."""
        slopes, ends = self.raw(point, only)
        held, label, weights = self.held[only], self.label[only], self.weights[only]
        k, classes, width = slopes.shape
        flat = slopes.reshape(k * classes, width)

        def per_batch(x, ys, g):
            z = (x @ flat.T).reshape(len(x), k, classes) + ends
            z -= z.max(axis=2, keepdims=True)
            log = z - np.log(np.exp(z).sum(axis=2, keepdims=True))
            y = ys[:, label]
            w = np.take_along_axis(np.broadcast_to(weights, (len(x), k, classes)), y[:, :, None], axis=2)[:, :, 0] * (g[:, None] != held)
            at = np.take_along_axis(log, y[:, :, None], axis=2)[:, :, 0]
            wrong = np.exp(log)
            np.put_along_axis(wrong, y[:, :, None], np.take_along_axis(wrong, y[:, :, None], axis=2) - 1.0, axis=2)
            wrong *= w[:, :, None]
            return [-(w * at).sum(axis=0), (wrong.reshape(len(x), -1).T @ x).reshape(k, classes, width), wrong.sum(axis=0)]

        values, steep, sums = reduced(self.rows, ["x", "ys", "_g"], per_batch, _added, rows_at_once(k, classes))
        n, penalty = np.maximum(self.n[only], 1.0), self.penalty[only]
        gradient = np.concatenate([(steep - sums[:, :, None] * self.mean[only][:, None, :]) * self.scale[only][:, None, :], sums[:, :, None]], axis=2)
        ridge = point.copy()
        ridge[:, :, -1] = 0.0
        return values / n + penalty / 2 * (ridge ** 2).sum(axis=(1, 2)), gradient / n[:, None, None] + penalty[:, None, None] * ridge

    def fit(self, iterations: int = ITERATIONS, memory: int = 10) -> "JointFits":
        """Quasi-Newton steps of all models, halved until a model's loss falls; a model that stops short of its minimum is an error."""
        models, width = self.mean.shape
        at = np.zeros((models, self.classes, width + 1))
        every = np.arange(models)
        value, slope = self.loss(at, every)
        past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in every]
        going, step, ways = every, np.ones(models), -slope
        for _ in range(iterations):
            tried = at[going] + step[going, None, None] * ways[going]
            values, slopes = self.loss(tried, going)
            fell = values <= value[going] + 1e-4 * step[going] * (slope[going] * ways[going]).sum(axis=(1, 2))
            left = []
            for i, ok, v, x, g in zip(going, fell, values, tried, slopes):
                if not ok:
                    if step[i] > 1e-10:
                        step[i] /= 2
                        left.append(i)
                    elif np.abs(slope[i]).max() > 1e-4:
                        raise ValueError(f"no step lowers the loss of model {i}, whose slope is {np.abs(slope[i]).max():.3g}")
                    continue
                moved, turned = x - at[i], g - slope[i]
                if (moved * turned).sum() > 1e-14:
                    past[i] = [*past[i][1 - memory:], (moved, turned)]
                gain, at[i], value[i], slope[i], step[i] = value[i] - v, x, v, g, 1.0
                if gain > TOLERANCE * max(abs(v), 1e-12) and np.abs(g).max() > 1e-9:
                    ways[i] = _way(g, past[i])
                    left.append(i)
            going = np.array(left, int)
            if not len(going):
                self.points = at
                return self
        raise ValueError(f"{len(going)} classifiers have not converged in {iterations} steps")

    def guesses(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """(keep, model, yhat): every row of ``rows`` (x, _g, keep) by each model that leaves its group out."""
        slopes, ends = self.raw(self.points, np.arange(len(self.held)))
        return _by_left_out(rows, keep, self.held, lambda x, i: (x @ slopes[i].T + ends[i]).argmax(axis=1), "int")

    def hits(self) -> np.ndarray:
        """Rows of the left-out groups by class: all and rightly predicted (classes x 2 x models)."""
        slopes, ends = self.raw(self.points, np.arange(len(self.held)))
        held, label, classes = self.held, self.label, self.classes

        def per_batch(x, ys, g):
            out = np.zeros((classes, 2, len(held)))
            for i in range(len(held)):
                own = g == held[i]
                if own.any():
                    y = ys[own, label[i]]
                    right = (x[own] @ slopes[i].T + ends[i]).argmax(axis=1) == y
                    out[:, 0, i] = np.bincount(y, minlength=classes)
                    out[:, 1, i] = np.bincount(y[right], minlength=classes)
            return [out]

        return reduced(self.rows, ["x", "ys", "_g"], per_batch, _added)[0]


def _way(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, shares = slope.copy(), []
    for moved, turned in reversed(past):
        shares.append((moved * q).sum() / (moved * turned).sum())
        q -= shares[-1] * turned
    if past:
        q *= (past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2).sum()
    for (moved, turned), share in zip(past, reversed(shares)):
        q += moved * (share - (turned * q).sum() / (moved * turned).sum())
    return -q


def _by_left_out(rows: DataFrame, keep: list[str], held: np.ndarray, guess: Callable, kind: str) -> DataFrame:
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    by_group = {int(g): np.flatnonzero(held == g).tolist() for g in np.unique(held)}
    arrow = pa.int32() if kind == "int" else pa.float64()

    def run(batches):
        for batch in batches:
            x, g = _matrix(batch.column("x")).astype(float), _matrix(batch.column("_g"))
            for k in np.unique(g):
                own = np.flatnonzero(g == k)
                kept = [batch.column(c).take(pa.array(own)) for c in keep]
                for i in by_group.get(int(k), []):
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(np.full(len(own), i, np.int32)), pa.array(guess(x[own], i), arrow)], [*keep, "model", "yhat"])

    return rows.select(*dict.fromkeys([*keep, "x", "_g"])).mapInArrow(run, f"{fields}, model int, yhat {kind}")


def classified_left_out(rows: DataFrame, groups: int, parameters: list[float], labels: int, classes: int, keep: list[str],
                        test: DataFrame | None = None) -> DataFrame:
    """(keep, parameter, label, yhat): every row, or every row of ``test``, by the models that did not see its group.

    rows: x, ys, _g and keep. All groups, labels and inverse penalties are fitted together, ``MODEL_BYTES`` of them at a time.
    """
    specs = [(g, i, p) for g in range(groups) for i in range(labels) for p in parameters]
    width = rows.select(F.size("x")).first()[0] + 1
    most = max(1, MODEL_BYTES // (8 * classes * width))
    out = None
    for at in range(0, len(specs), most):
        some = specs[at:at + most]
        fits = JointFits(rows, groups, [s[0] for s in some], [s[1] for s in some], [s[2] for s in some], classes).fit()
        names = F.array(*[F.struct(F.lit(float(p)).alias("parameter"), F.lit(i).alias("label")) for _, i, p in some])
        part = fits.guesses(rows if test is None else test, keep).withColumn("_m", F.get(names, "model")).select(
            *keep, "_m.parameter", "_m.label", "yhat")
        out = part if out is None else out.unionByName(part)
    return out


def grams(rows: DataFrame, groups: int) -> tuple[np.ndarray, list]:
    """(centre, [per group: count, sums, cross products]) of the columns (x, y) less a common centre, so that sums stay small."""
    first = reduced(rows, ["x", "y"], lambda x, y: [len(x), np.append(x.sum(axis=0), y.sum())], _added)
    centre = first[1] / max(first[0], 1)
    width = len(centre)
    if groups * width * width * 8 > GRAM_BYTES * 16:
        raise ValueError(f"{groups} groups of {width} columns need more than {GRAM_BYTES * 16} bytes of cross products")

    def per_batch(x, y, g):
        both = np.column_stack([x, y]) - centre
        out = {}
        for k in np.unique(g):
            own = both[g == k]
            out[int(k)] = [len(own), own.sum(axis=0), own.T @ own]
        return out

    def merge(a, b):
        return {k: _added(a[k], b[k]) if k in a and k in b else a.get(k) or b[k] for k in {**a, **b}}

    found = reduced(rows, ["x", "y", "_g"], per_batch, merge)
    empty = [0, np.zeros(width), np.zeros((width, width))]
    return centre, [found.get(k, empty) for k in range(groups)]


def ridge_left_out(rows: DataFrame, groups: int, penalties: list[float], keep: list[str], test: DataFrame | None = None) -> DataFrame:
    """(keep, parameter, yhat): ridge on standardised features, every row (or row of ``test``) by the models without its group.

    rows: x, y, _g and keep. One model is a subtraction of cross products and a solve; the data are read twice in all.
    """
    centre, parts = grams(rows, groups)
    n, sums, cross = (sum(p[i] for p in parts) for i in range(3))
    specs, slopes, ends = [], [], []
    for g in range(groups):
        count, total, square = n - parts[g][0], sums - parts[g][1], cross - parts[g][2]
        mean = total / max(count, 1)
        spread = square - count * np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(spread)[:-1], 0.0) / max(count - 1, 1))
        scale = np.where(deviation > 1e-12, 1.0 / np.where(deviation > 1e-12, deviation, 1.0), 0.0)
        system, answer = spread[:-1, :-1] * np.outer(scale, scale), spread[:-1, -1] * scale
        for penalty in penalties:
            slope = np.linalg.solve(system + penalty * np.eye(len(scale)), answer) * scale
            specs.append((g, penalty))
            slopes.append(slope)
            ends.append(centre[-1] + mean[-1] - (centre[:-1] + mean[:-1]) @ slope)
    names = F.array(*[F.lit(float(p)) for _, p in specs])
    held = np.array([g for g, _ in specs])
    out = _by_left_out(rows if test is None else test, keep, held, lambda x, i: x @ slopes[i] + ends[i], "double")
    return out.withColumn("parameter", F.get(names, "model")).select(*keep, "parameter", "yhat")


def permuted_hits(rows: DataFrame, groups: int, models: int, classes: int, parameter: float) -> np.ndarray:
    """Left-out rows by class and label column (classes x 2 x labels), all groups together."""
    total = 0
    width = rows.select(F.size("x")).first()[0] + 1
    most = max(1, MODEL_BYTES // (8 * classes * width))
    specs = [(g, i) for g in range(groups) for i in range(models)]
    for at in range(0, len(specs), most):
        some = specs[at:at + most]
        found = JointFits(rows, groups, [s[0] for s in some], [s[1] for s in some], [parameter] * len(some), classes).fit().hits()
        counts = np.zeros((classes, 2, models))
        np.add.at(counts, (slice(None), slice(None), np.array([s[1] for s in some])), found)
        total = total + counts
    return total


def shaped(df: DataFrame, vector, labels) -> DataFrame:
    """``df`` with x and ys, written once: every pass reads them."""
    return cut(df.withColumns({"x": vector.cast("array<double>"), "ys": labels.cast("array<int>")}))
