"""Linear models on sparse features (row, col, cnt): many at once, by sums over the rows where they are.

Rows hold their features as two arrays, and the models that they teach as arrays too, so a round of training is
one pass: each task adds up losses, gradients and, where features are few, Hessians of all models in numpy, and
these sums are added by model. Only parameters meet at the driver, NUMBERS of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.metrics import pair_scores
from sylva.session import written

#: Parameters trained together; more models are trained one lot after the other.
NUMBERS = 2_000_000
#: Columns up to which Newton's method is used; beyond, gradients of the last MEMORY rounds stand for the Hessian.
NEWTON, MEMORY = 256, 10
GRID = (0.01, 0.1, 1.0, 10.0)
_WITHOUT = 30.0  # the decision of a model that has seen one class only


@dataclass
class Loss:
    """Loss, its slope and its curve by the margin; penalised: whether the intercept is a weight like others."""

    name: str
    penalised: bool

    def __call__(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.name == "logistic":
            p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))  # the chance of being wrong
            return np.logaddexp(0, -margin), -p, p * (1 - p)
        short = np.maximum(1 - margin, 0)
        return short * short, -2 * short, 2.0 * (short > 0)


LOGISTIC, HINGE = Loss("logistic", False), Loss("squared hinge", True)


def packed(features: DataFrame) -> DataFrame:
    """(task, cols, vals): each row's features (row, col, cnt; col from 0) as two arrays, in order of the columns."""
    cells = F.sort_array(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("cnt").cast("double").alias("cnt"))))
    return features.groupBy(F.col("row").alias("task")).agg(cells.alias("cells")).select("task", F.col("cells.col").alias("cols"), F.col("cells.cnt").alias("vals"))


def examples(rows: DataFrame, uses: DataFrame) -> DataFrame:
    """(task, cols, vals, uses): rows (task, cols, vals) with their uses (task, base, v, weight, asked); a task without features has none."""
    use = F.collect_list(F.struct(F.col("base").cast("int").alias("base"), F.col("v").cast("double").alias("v"), F.col("weight").cast("double").alias("weight"), "asked"))
    of = uses.groupBy("task").agg(use.alias("uses"))
    part = lambda name: F.col(f"uses.{name}").alias(name)
    return of.join(rows, "task", "left").select("task", F.coalesce("cols", F.array().cast("array<int>")).alias("cols"), F.coalesce("vals", F.array().cast("array<double>")).alias("vals"), *map(part, ("base", "v", "weight", "asked")))


class _Part:
    """The examples of a batch of rows, as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(batch.schema.names.index(name))
        flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False)
        count = lambda name: pa.compute.list_value_length(column(name)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.task = column("task")
        self.cols, self.vals, self.n = flat("cols"), flat("vals"), count("cols")
        self.first = np.cumsum(self.n) - self.n
        row, base = np.repeat(np.arange(batch.num_rows), count("base")), flat("base")
        order = np.argsort(base, kind="stable")
        self.base, self.row = base[order], row[order]
        self.y, self.weight, self.asked = flat("v")[order], flat("weight")[order], flat("asked")[order]
        self.kinds, self.starts = np.unique(self.base, return_index=True)

    def uses(self, base: int) -> slice:
        k = np.searchsorted(self.kinds, base)
        if k == len(self.kinds) or self.kinds[k] != base:
            return slice(0, 0)
        return slice(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.kinds) else len(self.base))

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among rows, column and value of each of their features."""
        n = self.n[rows]
        at = np.arange(int(n.sum())) + np.repeat(self.first[rows] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(rows)), n), self.cols[at], self.vals[at]


def _decision(w: np.ndarray, of: np.ndarray, cols: np.ndarray, vals: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(of, weights=w[1:][cols] * vals, minlength=rows) + w[0]


def _sums(data: DataFrame, models: list[tuple[int, float]], w: np.ndarray, loss: Loss, hessian: bool) -> dict[int, tuple[float, np.ndarray, np.ndarray | None]]:
    """Loss, gradient and Hessian of the data for each model (base, c) at w, without the penalty."""
    size = w.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 1 + size + (size * size if hessian else 0)))
        for batch in batches:
            part = _Part(batch)
            last = None
            for m, (base, _) in enumerate(models):
                if base != last:
                    last, own = base, part.uses(base)
                    own = np.flatnonzero(part.weight[own] > 0) + own.start
                    rows, y, weight = part.row[own], part.y[own], part.weight[own]
                    of, cols, vals = part.cells(rows)
                if not len(own):
                    continue
                value, slope, curve = loss(y * _decision(w[m], of, cols, vals, len(rows)))
                slope = weight * slope * y
                total[m, 0] += weight @ value
                total[m, 1] += slope.sum()
                total[m, 2 : 1 + size] += np.bincount(cols, weights=vals * slope[of], minlength=size - 1)
                if hessian:
                    x = np.zeros((len(rows), size))
                    x[:, 0] = 1
                    np.add.at(x, (of, cols + 1), vals)
                    total[m, 1 + size :] += ((x * (weight * curve)[:, None]).T @ x).ravel()
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["model", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks()
        return pa.table({"model": table.column("model")[:1], "sums": pa.array([sums.flatten().to_numpy().reshape(len(sums), -1).sum(axis=0)], pa.list_(pa.float64()))})

    schema = "model int, sums array<double>"
    out = {}
    for r in data.mapInArrow(run, schema).groupBy("model").applyInArrow(added, schema).collect():  # NUMBERS at most
        s = np.array(r.sums)
        out[r.model] = (float(s[0]), s[1 : 1 + size], s[1 + size :].reshape(size, size) if hessian else None)
    none = (0.0, np.zeros(size), np.zeros((size, size)) if hessian else None)
    return {m: out.get(m, none) for m in range(len(models))}


class _Descent:
    """One model's way down: a direction, and steps along it that are halved until the objective falls enough."""

    def __init__(self, size: int, c: float, loss: Loss):
        self.c, self.x, self.f = c, np.zeros(size), None
        self.ridge = np.ones(size)
        self.ridge[0] = 1.0 if loss.penalised else 0.0
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.trial, self.done, self.converged = 0.0, self.x, False, False

    def given(self, value: float, gradient: np.ndarray, hessian: np.ndarray | None, tolerance: float) -> None:
        """The data's sums at the trial point."""
        f = self.c * value + 0.5 * float(self.ridge @ (self.trial * self.trial))
        g = self.c * gradient + self.ridge * self.trial
        if self.f is not None and f > self.f + 1e-4 * self.step * self.slope + 1e-12 * abs(self.f):
            self.step *= 0.5
            self.trial = self.x + self.step * self.p
            self.done = self.step < 1e-12  # no fall that the sums can show
            self.converged = self.done and np.abs(self.g).max() <= 1e-5 * max(1.0, self.c)
            return
        if self.f is not None:
            s, y = self.trial - self.x, g - self.g
            if s @ y > 1e-12 * (s @ s):
                self.kept = [*self.kept[1 - MEMORY :], (s, y)]
        self.x, self.f, self.g = self.trial, f, g
        if np.abs(g).max() <= tolerance * max(1.0, self.c):
            self.done = self.converged = True
            return
        self.p = -np.linalg.solve(self.c * hessian + np.diag(self.ridge + 1e-10), g) if hessian is not None else self._remembered(g)
        self.slope = float(self.p @ g)
        if self.slope >= 0:
            self.p, self.kept = -g, []
            self.slope = -float(g @ g)
        self.step = 1.0 if hessian is not None or self.kept else min(1.0, 1.0 / np.abs(g).sum())
        self.trial = self.x + self.step * self.p

    def _remembered(self, g: np.ndarray) -> np.ndarray:
        q, turns = g.copy(), []
        for s, y in reversed(self.kept):
            a = (s @ q) / (s @ y)
            turns.append(a)
            q -= a * y
        if self.kept:
            s, y = self.kept[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.kept, reversed(turns), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        return -q


def _trained(data: DataFrame, models: list[tuple[int, float]], size: int, loss: Loss, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (intercept first) of each model (base, c), and whether it converged."""
    ways = [_Descent(size, c, loss) for _, c in models]
    hessian = size <= NEWTON
    for _ in range(rounds):
        live = [k for k, way in enumerate(ways) if not way.done]
        if not live:
            break
        sums = _sums(data, [models[k] for k in live], np.stack([ways[k].trial for k in live]), loss, hessian)
        for i, k in enumerate(live):
            ways[k].given(*sums[i], tolerance)
    return np.stack([way.x for way in ways]), np.array([way.converged for way in ways])


def _decisions(data: DataFrame, models: list[tuple[int, float]], w: np.ndarray) -> DataFrame:
    """(task, base, c, decision) of the uses that are asked for."""
    kind = dict(data.dtypes)["task"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _Part(batch)
            for m, (base, c) in enumerate(models):
                own = part.uses(base)
                own = np.flatnonzero(part.asked[own]) + own.start
                if len(own):
                    rows = part.row[own]
                    z = _decision(w[m], *part.cells(rows), len(rows))
                    yield pa.RecordBatch.from_arrays([part.task.take(pa.array(rows)), pa.array(np.full(len(rows), base, np.int32)), pa.array(np.full(len(rows), c)), pa.array(z)], ["task", "base", "c", "decision"])

    return data.mapInArrow(run, f"task {kind}, base int, c double, decision double")


def fit(
    rows: DataFrame, uses: DataFrame, models: list[tuple[int, float]], size: int, loss: Loss = LOGISTIC, tolerance: float = 1e-7, rounds: int = 400, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Models (base, c) of rows (task, cols, vals) with so many columns, and their decisions where uses (task, base, v in -1/1, weight, asked) ask.

    The first table is (base, c, w: intercept and weights, converged), the second (task, base, c, decision). A base
    whose uses with a weight are of one class decides for it. A model that doesn't converge is an error, if strict.
    """
    spark = rows.sparkSession
    data = written(examples(rows, uses))
    seen = {r.base: (r.low, r.high) for r in uses.where("weight > 0").groupBy("base").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()}  # a row for each base
    models = sorted(set(models))
    lot, tables, found = max(1, NUMBERS // (size + 1)), [], []
    for start in range(0, len(models), lot):
        part = models[start : start + lot]
        w, converged = np.zeros((len(part), size + 1)), np.ones(len(part), bool)
        mixed = [k for k, (b, _) in enumerate(part) if seen.get(b, (0, 0))[0] < seen.get(b, (0, 0))[1]]
        if mixed:
            w[mixed], converged[mixed] = _trained(data, [part[k] for k in mixed], size + 1, loss, tolerance, rounds)
        for k in set(range(len(part))) - set(mixed):
            w[k, 0] = _WITHOUT * seen.get(part[k][0], (0.0, 0.0))[0]
        if strict and not converged.all():
            raise RuntimeError(f"{(~converged).sum()} of {len(part)} models did not converge in {rounds} rounds; the first is {part[int(np.argmin(converged))]}")
        base, c = zip(*part, strict=True)
        tables.append(written(spark.createDataFrame(pa.table([pa.array(base, pa.int32()), pa.array(c, pa.float64()), pa.array(list(w), pa.list_(pa.float64())), pa.array(converged)], ["base", "c", "w", "converged"]))))
        found.append(written(_decisions(data, part, w)))
    one = lambda parts: parts[0] if len(parts) == 1 else one([parts[0].unionByName(parts[1]), *parts[2:]])
    if not models:
        kind = dict(rows.dtypes)["task"]
        return spark.createDataFrame([], "base int, c double, w array<double>, converged boolean"), spark.createDataFrame([], f"task {kind}, base int, c double, decision double")
    return one(tables), one(found)


# ---------------------------------------------------------------- choosing C


def numbered_bases(groups: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """(keys, base): a number for each of few groups (pairs by folds), in order of the keys."""
    rows = groups.select(*keys).distinct().orderBy(*keys).collect()  # a row for each model
    kinds = dict(groups.dtypes)
    return groups.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{k} {kinds[k]}" for k in keys) + ", base int"), len(rows)


def pair_metrics(decided: DataFrame, *keys: str) -> DataFrame:
    """accuracy, precision, recall and f1 of decisions (keys, v in -1/1, decision) by group."""
    said = F.when(F.col("decision") > 0, 1).otherwise(-1)
    return decided.groupBy(*keys).agg(*pair_scores(F.col("v"), said))


def inner_fold(k: int) -> Column:
    """A fold for each row by a digest of its task, the same whatever table it stands in."""
    digest = F.md5(F.concat(F.lit("inner"), F.col("task").cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def best_c(scores: DataFrame, metric: str, *keys: str) -> DataFrame:
    """(keys, c, score): the C of the best mean over the inner folds of (keys, inner, c, metrics), the least of equals."""
    means = scores.groupBy(*keys, "c").agg(F.round(F.avg(metric), 12).alias("score"))
    best = means.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("c")).alias("less"))).alias("best"))
    return best.select(*keys, (-F.col("best.less")).alias("c"), F.col("best.score").alias("score"))


def tuned(
    rows: DataFrame, train: DataFrame, asked: DataFrame, *keys: str, size: int, inner: int = 3, grid: tuple[float, ...] = GRID, metric: str = "f1", loss: Loss = LOGISTIC, tolerance: float = 1e-7
) -> tuple[DataFrame, DataFrame]:
    """A model for each group of train (keys, task, v in -1/1, weight), its C chosen by a metric over inner folds, and its decisions for asked (keys, task).

    Gives (keys, c, score, w, converged) and (keys, task, decision). Inner folds are drawn by a digest of the task, the same for all groups.
    """
    train = written(train.select(*keys, "task", "v", "weight", inner_fold(inner).alias("own")))
    keys = list(keys)
    if len(grid) > 1:
        spread = train.withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
        bases, n = numbered_bases(spread, *keys, "inner")
        uses = spread.join(F.broadcast(bases), [*keys, "inner"])  # a row for each model
        held = F.col("own") == F.col("inner")
        uses = written(uses.select("task", "base", "v", F.when(held, 0.0).otherwise(F.col("weight")).alias("weight"), held.alias("asked")))
        _, decisions = fit(rows, uses, [(b, c) for b in range(n) for c in grid], size, loss, tolerance)
        truth = uses.where("asked").select("task", "base", "v")
        scores = pair_metrics(decisions.join(truth, ["task", "base"]).join(F.broadcast(bases), "base"), *keys, "inner", "c")
        chosen = written(best_c(scores, metric, *keys))
    else:
        chosen = written(train.select(*keys).distinct().withColumn("c", F.lit(grid[0])).withColumn("score", F.lit(None).cast("double")))
    bases, n = numbered_bases(train, *keys)
    taught = train.select(*keys, "task", "v", "weight", F.lit(False).alias("asked"))
    told = asked.select(*keys, "task", F.lit(0).alias("v"), F.lit(0.0).alias("weight"), F.lit(True).alias("asked"))
    uses = written(taught.unionByName(told).join(F.broadcast(bases), keys).select("task", "base", "v", "weight", "asked"))
    known = chosen.join(F.broadcast(bases), keys).select(*keys, "base", "c", "score")
    models, decisions = fit(rows, uses, [(r.base, r.c) for r in known.select("base", "c").collect()], size, loss, tolerance)  # a row for each model
    own = F.broadcast(bases)
    return models.join(F.broadcast(known.drop("c")), "base").select(*keys, "c", "score", "w", "converged"), decisions.join(own, "base").select(*keys, "task", "decision")


def coefficients(models: DataFrame, *keys: str) -> DataFrame:
    """(keys, col, coef) of weights that are not 0; col -1 is the intercept."""
    each = models.select(*keys, F.posexplode("w").alias("col", "coef"))
    return each.where("coef <> 0").withColumn("col", F.col("col") - 1)
