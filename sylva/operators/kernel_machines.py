"""Support-vector machines on a Gram table, one for each group of pairs and folds, and what is decided by them.

A Gram table (i, j, v) has each pair of tasks once (i <= j) or in both orders. Machines of up to MOST tasks are solved in
one task each: those that share their training tasks come in lots, and a lot gets one block of the Gram for all of them.
Larger ones are solved apart: parts first, then, round by round, the tasks that violate the conditions most, with a
block of the Gram for these alone, until none does. What is left of the conditions (gap) stands beside each machine.

In place of a table there may be a Kernel: the tasks' bags, of which each lot makes what it needs, so that no table with the
square of the tasks is written. Tasks of equal bags and classes are one example with that many bounds there, and products of
few labels stand as their factors, by which machines of many more tasks are solved in one task.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators import kernels as K
from sylva.operators.bags import dense_index
from sylva.operators.sparse_learners import best_c, inner_fold, packed, pair_metrics
from sylva.session import written

MOST, LOTS = 4_000, 4
GRID = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
#: What may be left of the conditions, and steps by pairs before all coefficients are moved at once.
TOLERANCE, STEPS = 1e-3, 20_000
#: Labels up to which products stand as their factors, and numbers in the factors of one machine.
WIDTH, CELLS = 512, 20_000_000


# ---------------------------------------------------------------- one machine in numpy


class _Factor:
    """A Gram x x' of few columns; its rows are made when they are asked for."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def __getitem__(self, i: int) -> np.ndarray:
        return self.x @ self.x[i]

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return self.x @ (self.x.T @ v)


def _among(k, at: np.ndarray):
    return _Factor(k.x[at]) if isinstance(k, _Factor) else k[np.ix_(at, at)]


def _diagonal(k) -> np.ndarray:
    return (k.x * k.x).sum(axis=1) if isinstance(k, _Factor) else np.diag(k)


def _by_columns(k, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    return k.x @ (k.x[at].T @ v) if isinstance(k, _Factor) else k[:, at] @ v


def _sides(y: np.ndarray, a: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Which coefficients may move up, and which down."""
    return np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)


def _gap(y: np.ndarray, a: np.ndarray, g: np.ndarray, c: float) -> float:
    up, low = _sides(y, a, c)
    score = -y * g
    return float(score[up].max() - score[low].min()) if up.any() and low.any() else 0.0


def _by_pairs(k: np.ndarray, y: np.ndarray, c: float, a: np.ndarray, g: np.ndarray, tolerance: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves the pair that violates the conditions most, again and again; coefficients that stay at a bound are left out meanwhile."""
    a, g, everyone, c = a.copy(), g.copy(), np.arange(len(y)), np.broadcast_to(np.asarray(c, float), y.shape)
    active, left = everyone, steps
    while left > 0:
        ka, ya, aa, ga, ca = (k, y, a, g, c) if len(active) == len(y) else (_among(k, active), y[active], a[active], g[active], c[active])
        was, diagonal = aa.copy(), _diagonal(ka)
        turn, met = min(left, max(1_000, len(active))), False
        for _ in range(turn):
            left -= 1
            score = -ya * ga
            up, low = _sides(ya, aa, ca)
            i = int(np.where(up, score, -np.inf).argmax())
            gap = np.where(low, score[i] - score, -np.inf)
            if not up[i] or gap.max() < tolerance:
                met = True
                break
            own = ka[i]
            curve = np.maximum(diagonal[i] + diagonal - 2 * own, 1e-12)
            j = int(np.where(gap > 0, gap * gap / curve, -np.inf).argmax())
            step = min(gap[j] / curve[j], ca[i] - aa[i] if ya[i] > 0 else aa[i], aa[j] if ya[j] > 0 else ca[j] - aa[j])
            aa[i] += ya[i] * step
            aa[j] -= ya[j] * step
            aa[[i, j]] = np.clip(aa[[i, j]], 0, ca[[i, j]])
            ga += ya * step * (own - ka[j])
        if len(active) < len(y):  # those left out see what has moved
            moved = aa != was
            a[active] = aa
            g += y * _by_columns(k, active[moved], ((aa - was) * ya)[moved])
        if met and len(active) == len(y):
            break
        if met:
            active = everyone
            continue
        score = -y * g
        up, low = _sides(y, a, c)
        top, bottom = score[up].max(initial=-np.inf), score[low].min(initial=np.inf)
        stays = (~up & (score > top)) | (~low & (score < bottom))
        active = np.flatnonzero(~stays) if stays.sum() > len(y) // 2 else everyone
    return a, g


def _inside(k: np.ndarray, y: np.ndarray, c: float, linear: np.ndarray, target: float, rounds: int = 80) -> np.ndarray | None:
    """Coefficients within the bounds by an interior-point method, all moved at once; None if the Gram has no such minimum."""
    n, c = len(y), np.broadcast_to(np.asarray(c, float), y.shape)
    base = float(c.max())
    linear, y, target = linear * (c / base), y * (c / base), target / base  # in parts of c
    times, system = _factored(k.x * (np.sqrt(base) * y[:, None])) if isinstance(k, _Factor) else _dense(k * y[:, None] * y * base)
    a, b, z, w = np.full(n, 0.5), 0.0, np.ones(n), np.ones(n)
    size = max(1.0, float(np.abs(linear).max()))
    for _ in range(rounds):
        up = 1 - a
        dual, primal, mean = times(a) + linear + b * y - z + w, y @ a - target, (a @ z + up @ w) / (2 * n)
        if np.abs(dual).max() < 1e-7 * size and abs(primal) < 1e-9 * n and mean < 1e-10 * size:
            return np.clip(a, 0, 1) * c
        solved = system(z / a + w / up)
        goal = 0.0
        for turn in range(2):
            if turn:
                back = ((a + step * da) @ (z + step * dz) + (up - step * da) @ (w + step * dw)) / (2 * n)
                goal = mean * (back / mean) ** 3
            extra = (da * dz, -da * dw) if turn else (0.0, 0.0)
            lz, lw = (goal - extra[0]) / a - z, (goal - extra[1]) / up - w
            right = -dual + lz - lw
            try:
                s = solved(np.column_stack([right, y]))
            except np.linalg.LinAlgError:
                return None
            db = (y @ s[:, 0] + primal) / (y @ s[:, 1])
            da = s[:, 0] - db * s[:, 1]
            dz, dw = lz - z / a * da, lw + w / up * da
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = min([np.where(d < 0, -x / d, np.inf).min() for x, d in ((a, da), (up, -da), (z, dz), (w, dw))])
            step = min(1.0, 0.995 * float(reach))
        if not np.isfinite(step) or step < 1e-12:
            return None
        a, b, z, w = a + step * da, b + step * db, z + step * dz, w + step * dw
        if (a <= 0).any() or (a >= 1).any():
            return None
    return None


def _dense(q: np.ndarray):
    """Products with q, and solutions of q with a diagonal added."""

    def system(diagonal: np.ndarray):
        m = q.copy()
        m.flat[:: len(q) + 1] += diagonal
        return lambda right: np.linalg.solve(m, right)

    return lambda a: q @ a, system


def _factored(z: np.ndarray):
    """The same of z z', by systems of as many rows as z has columns; a second turn mends what rounding leaves."""

    def system(diagonal: np.ndarray):
        part = z / diagonal[:, None]
        small = np.eye(z.shape[1]) + z.T @ part

        def once(right: np.ndarray) -> np.ndarray:
            own = right / diagonal[:, None]
            return own - part @ np.linalg.solve(small, z.T @ own)

        def solved(right: np.ndarray) -> np.ndarray:
            s = once(right)
            return s + once(right - diagonal[:, None] * s - z @ (z.T @ s))

        return solved

    return lambda a: z @ (z.T @ a), system


def _snapped(found: np.ndarray, y: np.ndarray, c: np.ndarray, target: float, near: float) -> np.ndarray | None:
    """Coefficients that are nearly at a bound put there, and one of the others moved so that the sum stays; None if it can't."""
    found = np.where(found < near * c, 0.0, np.where(found > c * (1 - near), c, found))
    free = (found > 0) & (found < c)
    if free.any():
        at = int(np.where(free, np.minimum(found, c - found), -1).argmax())
        found[at] = np.clip(found[at] + y[at] * (target - found @ y), 0, c[at])
    return found if abs(found @ y - target) < 1e-9 * c.max() * len(y) else None


def solve_dual(k: np.ndarray, y: np.ndarray, c: float, a: np.ndarray, g: np.ndarray, tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Coefficients of least loss from a start a with its gradient g, and what is left of the conditions."""
    linear, target, c = g - y * (k @ (a * y)), float(a @ y), np.broadcast_to(np.asarray(c, float), y.shape)
    if not isinstance(k, _Factor):  # by its factors all are moved at once sooner than a few steps are made
        a, g = _by_pairs(k, y, c, a, g, tolerance, steps)
    if _gap(y, a, g, c) >= tolerance:
        found = _inside(k, y, c, linear, target)
        if found is not None:
            tried = [t for near in (1e-7, 1e-6, 1e-5) if (t := _snapped(found, y, c, target, near)) is not None]
            ends = [(t, linear + y * (k @ (t * y))) for t in (tried if isinstance(k, _Factor) else tried[:1])]
            a, g = min(ends, key=lambda e: _gap(y, *e, c), default=(a, g))
        a, g = _by_pairs(k, y, c, a, g, tolerance, 20 * steps)
    return a, _gap(y, a, g, c)


def _offset(score: np.ndarray, y: np.ndarray, a: np.ndarray, c: float) -> float:
    free = (a > 1e-9 * c) & (a < c * (1 - 1e-9))
    if free.any():
        return float(score[free].mean())
    up, low = _sides(y, a, c)
    return float((score[up].max() + score[low].min()) / 2)


def solve_svm(k: np.ndarray, y: np.ndarray, c: float, tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """Dual coefficients a_i y_i, the offset of the machine of least hinge loss, and what is left of its conditions."""
    a, gap = solve_dual(k, y, c, np.zeros(len(y)), -np.ones(len(y)), tolerance, steps)
    return a * y, _offset(y - k @ (a * y), y, a, c), gap


def platt(decision: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from decisions to the chance of a positive, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([decision, np.ones(len(y))])
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (t - p))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class _Own:
    """What a Kernel's lot holds of a group: the bags of its tasks (at)."""

    def __init__(self, bags: _Bags, at: np.ndarray):
        self.bags, self.at = bags, at

    def part(self, tasks: np.ndarray) -> _Own:
        return _Own(self.bags, self.at[tasks])

    def solved(self, y: np.ndarray, c: float) -> tuple[np.ndarray, float, float]:
        """solve_svm with tasks of equal bags and classes as one, which has the bounds of all of them."""
        pairs, first, place, n = np.unique(np.column_stack([self.at, y > 0]), axis=0, return_index=True, return_inverse=True, return_counts=True)
        k, own = self.bags.gram(pairs[:, 0]), y[first]
        a, gap = solve_dual(k, own, c * n, np.zeros(len(own)), -np.ones(len(own)))
        return (a * own / n)[place.ravel()], _offset(own - k @ (a * own), own, a, c * n), gap

    def told(self, held: np.ndarray, taught: np.ndarray, w: np.ndarray) -> np.ndarray:
        of, place = np.unique(self.at[taught], return_inverse=True)
        to, back = np.unique(self.at[held], return_inverse=True)
        return self.bags.sums(to, of, np.bincount(place, weights=w, minlength=len(of)))[back]


class _Bags:
    """A lot's different bags, a row each and one more of an empty bag at the end, and parts of their normalised Gram."""

    def __init__(self, kind: str, cols: list[np.ndarray], vals: list[np.ndarray], most: int):
        self.kind, self.most, self.rows = kind, most, len(cols) + 1
        self.row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
        labels, self.col = np.unique(np.concatenate([*cols, np.empty(0, int)]).astype(np.int64), return_inverse=True)
        self.labels, self.val = len(labels), np.concatenate([*vals, np.empty(0)]).astype(float)
        if kind == "linear":
            self.val = self.val / np.sqrt(np.bincount(self.row, weights=self.val**2, minlength=self.rows))[self.row]
        self.factored = kind == "linear" and self.labels <= WIDTH and (self.rows > most or 4 * self.labels <= self.rows)

    @cached_property
    def x(self) -> np.ndarray:
        x = np.zeros((self.rows, self.labels))
        x[self.row, self.col] = self.val
        return x

    @cached_property
    def whole(self) -> np.ndarray:
        return self.made(np.arange(self.rows))

    def made(self, at: np.ndarray) -> np.ndarray:
        """The Gram of some bags, label by label."""
        place = np.full(self.rows, -1)
        place[at] = np.arange(len(at))
        own = place[self.row] >= 0
        row, col, val = place[self.row[own]], self.col[own], self.val[own]
        order = np.argsort(col, kind="stable")
        ends = np.flatnonzero(np.diff(col[order], append=-1)) + 1
        k, join = np.zeros((len(at), len(at))), np.multiply if self.kind == "linear" else np.minimum
        for i, j in zip([0, *ends[:-1]], ends, strict=False):
            r, v = row[order[i:j]], val[order[i:j]]
            if 2 * len(r) > len(at):
                full = np.zeros(len(at))
                full[r] = v
                k += join.outer(full, full)
            else:
                k[np.ix_(r, r)] += join.outer(v, v)
        if self.kind == "jaccard":
            size = np.bincount(row, weights=val, minlength=len(at))
            either = np.add.outer(size, size) - k
            k = np.divide(k, either, out=k, where=either > 0)
        return k

    def gram(self, at: np.ndarray):
        if self.factored:
            return _Factor(self.x[at])
        if self.rows <= self.most:
            return self.whole[np.ix_(at, at)]
        different, back = np.unique(at, return_inverse=True)  # a bag may stand in both classes
        return self.made(different)[np.ix_(back, back)]

    def sums(self, to: np.ndarray, of: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Rows of some bags of the Gram with others, times w."""
        if self.factored:
            return self.x[to] @ (self.x[of].T @ w)
        if self.rows <= self.most:
            return self.whole[np.ix_(to, of)] @ w
        out, step = np.zeros(len(to)), max(1, self.most // 2)
        for i in range(0, len(to), step):
            for j in range(0, len(of), step):
                a, b = to[i : i + step], of[j : j + step]
                both, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                out[i : i + step] += self.made(both)[np.ix_(back[: len(a)], back[len(a) :])] @ w[j : j + step]
        return out


def _part(k, tasks: np.ndarray):
    return k.part(tasks) if isinstance(k, _Own) else k[np.ix_(tasks, tasks)]


def _told(k, held: np.ndarray, taught: np.ndarray, w: np.ndarray) -> np.ndarray:
    return k.told(held, taught, w) if isinstance(k, _Own) else k[np.ix_(held, taught)] @ w


def _trained(k: np.ndarray | _Own, y: np.ndarray, c: float) -> tuple[np.ndarray, float, float]:
    """solve_svm, or the constant of a single class."""
    if y.min() == y.max():
        return np.zeros(len(y)), float(y[0]), 0.0
    return k.solved(y, c) if isinstance(k, _Own) else solve_svm(k, y, c)


def _apart(k: np.ndarray | _Own, y: np.ndarray, c: float, parts: int = 3) -> np.ndarray:
    """Each task's decision by a machine that did not learn from it."""
    out = np.zeros(len(y))
    for p in range(parts):
        held = np.arange(len(y)) % parts == p
        if held.any() and not held.all():
            w, b, _ = _trained(_part(k, ~held), y[~held], c)
            out[held] = _told(k, held, ~held, w) + b
    return out


# ---------------------------------------------------------------- many machines in Spark


class Kernel:
    """The normalised Gram of bags (graph, label, cnt) by a kernel (linear or jaccard), made where it is needed; tasks without a bag have products of 0.

    Different bags are numbered: rows are (task, bag), bags (bag, cols, vals).
    """

    def __init__(self, bags: DataFrame, kind: str = "linear"):
        if kind not in ("linear", "jaccard"):
            raise ValueError(f"no kernel {kind} of bags; there are linear, jaccard")
        self.kind, self.given = kind, written(bags.select("graph", "label", "cnt"))
        index = written(dense_index(self.given, "label"))
        self.width = index.count()
        own = written(packed(self.given.join(index, "label").select(F.col("graph").alias("row"), F.col("idx").alias("col"), "cnt")))
        first = written(own.groupBy("cols", "vals").agg(F.min("task").alias("least")))
        number = written(dense_index(first, "least").withColumnRenamed("idx", "bag"))
        self.bags = written(first.join(number, "least").select("bag", "cols", "vals"))
        self.rows = written(own.join(self.bags, ["cols", "vals"]).select("task", "bag"))

    def most(self, most: int) -> int:
        """Different examples that a machine in one task may have."""
        return max(most, CELLS // max(1, self.width)) if self.kind == "linear" and self.width <= WIDTH else most

    def table(self) -> DataFrame:
        return written(K.normalized(K.KERNELS[self.kind](self.given)))


def kept(gram: DataFrame | Kernel) -> DataFrame | Kernel:
    return gram if isinstance(gram, Kernel) else written(gram)


def both_orders(gram: DataFrame) -> DataFrame:
    return gram.select("i", "j", "v").union(gram.where("i <> j").select("j", "i", "v")).distinct()


def _kinds(df: DataFrame, *names: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in names)


def _in_lots(rows: DataFrame, gram: DataFrame | Kernel, keys: list[str], share: tuple[str, ...], solve, schema: str, most: int = MOST, lots: int = LOTS) -> DataFrame:
    """solve(group, Gram of the group's tasks) for each group of rows (keys, task, ...), the groups of a lot on one block of the Gram.

    Groups of equal share columns have about the same tasks; they are dealt into lots.
    """
    others = [k for k in keys if k not in share]
    rows = rows.withColumn("lot", F.pmod(F.xxhash64(*others), F.lit(lots)).cast("int") if others else F.lit(0))
    lot = [*share, "lot"]
    if isinstance(gram, Kernel):
        kind, names = gram.kind, [f.split()[0] for f in schema.split(", ")]
        rows = rows.join(gram.rows, "task", "left").withColumn("bag", F.coalesce("bag", F.lit(-1)))
        own = rows.select(*lot, "bag").distinct().join(gram.bags, "bag").select(*[F.col(c).alias(f"of_{c}") for c in lot], F.col("bag").alias("of_bag"), "cols", "vals")

        def of_bags(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({n: [] for n in names})
            bags, number = _Bags(kind, list(right["cols"]), list(right["vals"]), most), pd.Index(right["of_bag"])
            out = []
            for _, group in left.groupby(keys, sort=False, dropna=False) if keys else [((), left)]:
                group = group.sort_values("task", kind="stable").reset_index(drop=True)
                at = number.get_indexer(group["bag"])
                out.append(solve(group, _Own(bags, np.where(at < 0, bags.rows - 1, at))))
            return pd.DataFrame({n: np.concatenate([part[n].to_numpy() for part in out]) for n in names})  # strings in one piece

        return rows.groupBy(*lot).cogroup(own.groupBy(*[f"of_{c}" for c in lot])).applyInPandas(of_bags, schema)
    member = lambda name: rows.select(*lot, F.col("task").alias(name)).distinct()
    block = gram.select("i", "j", "v").join(member("i"), "i").join(member("j"), [*lot, "j"]).select(*[F.col(c).alias(f"of_{c}") for c in lot], "i", "j", "v")

    def of_lot(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(left):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
        tasks = pd.Index(np.sort(left["task"].unique()))
        i, j, v = tasks.get_indexer(right["i"]), tasks.get_indexer(right["j"]), right["v"].to_numpy()
        whole = np.zeros((len(tasks), len(tasks))) if len(tasks) <= most else None
        if whole is not None:
            whole[i, j] = whole[j, i] = v
        for _, group in left.groupby(keys, sort=False, dropna=False) if keys else [((), left)]:
            group = group.sort_values("task", kind="stable").reset_index(drop=True)
            at = tasks.get_indexer(group["task"])
            if whole is not None:
                k = whole[np.ix_(at, at)]
            else:  # only this group's part of a block of many tasks
                place = np.full(len(tasks), -1)
                place[at] = np.arange(len(at))
                own = (place[i] >= 0) & (place[j] >= 0)
                k = np.zeros((len(at), len(at)))
                k[place[i[own]], place[j[own]]] = k[place[j[own]], place[i[own]]] = v[own]
            out.append(solve(group, k))
        return pd.concat(out, ignore_index=True)

    return rows.groupBy(*lot).cogroup(block.groupBy(*[f"of_{c}" for c in lot])).applyInPandas(of_lot, schema)


def _by_size(rows: DataFrame, keys: list[str], most: int, gram: DataFrame | Kernel | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of groups of up to so many tasks (of a Kernel: different examples), and rows of larger ones."""
    counted, n = rows, F.count("*")
    if isinstance(gram, Kernel):
        counted, most, n = rows.join(gram.rows, "task", "left"), gram.most(most), F.count_distinct(F.struct("bag", "v"))
    n = written(counted.groupBy(*keys).agg(n.alias("n")))
    largest = n.agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return rows, None
    is_large = n.where(F.col("n") > most).drop("n")
    small = None if n.where(F.col("n") <= most).isEmpty() else rows.join(is_large, keys, "left_anti")
    return small, rows.join(is_large, keys, "left_semi")


def _union(parts: list[DataFrame | None]) -> DataFrame:
    first, *rest = [p for p in parts if p is not None]
    for p in rest:
        first = first.unionByName(p)
    return first


def at_one_c(train: DataFrame, gram: DataFrame, *keys: str, chances: bool = False, share: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """Machines of train (keys, task, v in -1 and 1, c): (keys, c, task, coef, offset, slope, shift, gap), a row for each support task at least.

    A group of one class is that constant: no coefficients, the offset alone.
    """
    keys = list(keys)
    schema = f"{_kinds(train, *keys)}{', ' if keys else ''}c double, {_kinds(train, 'task')}, coef double, offset double, slope double, shift double, gap double"

    def fit(group: pd.DataFrame, k: np.ndarray) -> pd.DataFrame:
        y, c = np.where(group["v"].to_numpy() > 0, 1.0, -1.0), float(group["c"].iloc[0])
        w, b, gap = _trained(k, y, c)
        slope, shift = (1.0, 0.0) if not chances else (30.0, 0.0) if y.min() == y.max() else platt(_apart(k, y, c), y)
        some = group.iloc[np.flatnonzero(w) if w.any() else [0]]
        return pd.DataFrame({**{n: some[n].to_numpy() for n in keys}, "c": c, "task": some["task"].to_numpy(), "coef": w[some.index], "offset": b, "slope": slope, "shift": shift, "gap": gap})

    small, large = _by_size(train.select(*keys, "task", "v", "c"), keys, most, gram)
    out = [None if small is None else _in_lots(small, gram, keys, share, fit, schema, most)]
    if large is not None:
        gram = gram.table() if isinstance(gram, Kernel) else gram
        machines = solved_apart(large, gram, *keys, most=most)
        if chances:
            part = large.withColumn("part", inner_fold(3))
            told = cross_decided(part.withColumnRenamed("part", "inner").drop("c"), gram, *keys, cs=large.select(*keys, "c").distinct(), share=share, most=most)

            def curve(pdf: pd.DataFrame) -> pd.DataFrame:
                slope, shift = platt(pdf["decision"].to_numpy(), np.where(pdf["v"].to_numpy() > 0, 1.0, -1.0))
                return pd.DataFrame({**{n: [pdf[n].iloc[0]] for n in keys}, "slope": [slope], "shift": [shift]})

            curves = told.groupBy(*keys).applyInPandas(curve, f"{_kinds(train, *keys)}, slope double, shift double")  # two numbers for each task
            machines = machines.drop("slope", "shift").join(curves, keys)
        out.append(machines.select(*keys, "c", "task", "coef", "offset", "slope", "shift", "gap"))
    return _union(out)


def cross_decided(rows: DataFrame, gram: DataFrame, *keys: str, cs: tuple[float, ...] | DataFrame = GRID, share: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """(keys, inner, c, task, v, decision, gap): what each task's held-out fold is told, for each C, by the machine of all the other folds.

    rows are (keys, task, v, inner); tasks of a negative inner fold are never held out, and those with v 0 teach nothing. All fits of a
    group share one block of the Gram.
    cs may be a table (keys, c) instead.
    """
    keys = list(keys)
    listed = rows.withColumn("cs", F.array(*map(F.lit, cs))) if isinstance(cs, tuple) else rows.join(cs.groupBy(*keys).agg(F.collect_set("c").alias("cs")), keys)
    schema = f"{_kinds(rows, *keys)}{', ' if keys else ''}inner int, c double, {_kinds(rows, 'task')}, v int, decision double, gap double"

    def fit(group: pd.DataFrame, k: np.ndarray) -> pd.DataFrame:
        y, fold, out = np.where(group["v"].to_numpy() > 0, 1.0, -1.0), group["inner"].to_numpy(), []
        for f in np.unique(fold[fold >= 0]):
            held = fold == f
            taught, own = ~held & (group["v"].to_numpy() != 0), group[held]
            if not taught.any():
                continue
            for c in sorted(group["cs"].iloc[0]):
                w, b, gap = _trained(_part(k, taught), y[taught], c)
                out.append(pd.DataFrame({**{n: own[n].to_numpy() for n in keys}, "inner": np.int32(f), "c": c, "task": own["task"].to_numpy(), "v": own["v"].to_numpy(), "decision": _told(k, held, taught, w) + b, "gap": gap}))
        return pd.concat(out) if out else pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})

    small, large = _by_size(listed.select(*keys, "task", F.col("v").cast("int").alias("v"), F.col("inner").cast("int").alias("inner"), "cs"), keys, most, gram)
    out = [None if small is None else _in_lots(small, gram, keys, share, fit, schema, most)]
    if large is not None:
        gram = gram.table() if isinstance(gram, Kernel) else gram
        large = written(large)
        held = large.where("inner >= 0").select(*keys, F.col("inner").alias("held")).distinct()
        each = large.join(held, keys).withColumn("c", F.explode("cs"))
        key = [*keys, "held", "c"]
        machines = written(solved_apart(each.where("inner <> held and v <> 0").select(*key, "task", "v"), gram, *key, most=most))
        asked = each.where("inner = held").select(*key, "task", "v")
        gaps = machines.groupBy(*key).agg(F.max("gap").alias("gap"))
        told = decided(machines, gram, asked, *key).select(*key, "task", "decision").join(asked, [*key, "task"]).join(gaps, key)
        out.append(told.select(*keys, F.col("held").alias("inner"), "c", "task", "v", "decision", "gap"))
    return _union(out)


def chosen_c(rows: DataFrame, gram: DataFrame, *keys: str, grid: tuple[float, ...] = GRID, metric: str = "accuracy", inner: int = 1, share: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """(keys, c, score): the C of the best mean of a metric (accuracy, precision, recall, f1) for each group of rows (keys, task, v).

    With inner 1 a third of the tasks is held out, else each of so many folds in turn; both are drawn by a digest of the task. The
    least C of equals is taken, and the first one where a group has no tasks to hold out or to learn from.
    """
    drawn = inner_fold(inner if inner > 1 else 3)
    folds = written(rows.select(*keys, "task", "v").withColumn("inner", drawn if inner > 1 else F.when(drawn == 0, 0).otherwise(-1)))
    told = written(cross_decided(folds, gram, *keys, cs=grid, share=share, most=most))
    scores = pair_metrics(told, *keys, "inner", "c")
    best = best_c(scores, metric, *keys)
    every = folds.select(*keys).distinct()
    return every.join(best, list(keys), "left").select(*keys, F.coalesce("c", F.lit(grid[0])).alias("c"), "score")


def fitted(
    train: DataFrame, gram: DataFrame, *keys: str, grid: tuple[float, ...] = GRID, chances: bool = False, most: int = MOST, metric: str = "accuracy", inner: int = 1, share: tuple[str, ...] = (), strict: bool = True
) -> DataFrame:
    """Machines for each group of train (keys, task, v in -1 and 1): (keys, c, score, task, coef, offset, slope, shift, gap).

    C is chosen as chosen_c does, and score is its mean there (null, if there is one C only); slope and shift turn decisions into
    chances, where they are asked for. A machine whose conditions are not met is an error, if strict; gap shows it otherwise.
    """
    train = written(train.select(*keys, "task", "v"))
    if len(grid) > 1:
        best = written(chosen_c(train, gram, *keys, grid=grid, metric=metric, inner=inner, share=share, most=most))
        rows = train.join(best, list(keys)) if keys else train.crossJoin(F.broadcast(best))  # one row
    else:
        rows = train.withColumn("c", F.lit(float(grid[0])))
        best = train.select(*keys).distinct().withColumn("score", F.lit(None).cast("double"))
    out = written(at_one_c(rows, gram, *keys, chances=chances, share=share, most=most))
    if strict:
        open_ = out.where(F.col("gap") >= TOLERANCE).agg(F.max("gap")).first()[0]
        if open_ is not None:
            raise RuntimeError(f"a machine's conditions are not met: {open_:.3g} is left of them, {TOLERANCE} is allowed")
    scores = best.select(*keys, "score")
    out = out.join(scores, list(keys)) if keys else out.crossJoin(F.broadcast(scores))  # one row
    return out.select(*keys, "c", "score", "task", "coef", "offset", "slope", "shift", "gap")


def solved_apart(train: DataFrame, gram: DataFrame, *keys: str, most: int = MOST, tolerance: float = TOLERANCE, rounds: int = 500) -> DataFrame:
    """Machines of more than most tasks, of train (keys, task, v, c; c may be a key): (keys, c, task, coef, offset, slope, shift, gap).

    Parts of the tasks are solved by themselves, which gives most coefficients about where they end. Then the tasks that violate
    the conditions most, half of them on either side, are solved together while all others rest, and what has moved is added
    to the decisions of all tasks by a join with the Gram. It ends when no task violates the conditions; gap tells what is left if
    the rounds are used up. Tasks of a round are at most most, whatever a machine's size.
    """
    keys = list(keys)
    both = written(both_orders(gram))
    own = [k for k in keys if k != "c"]
    y = F.when(F.col("v") > 0, 1.0).otherwise(-1.0)
    state = train.select(*own, "task", F.col("c").cast("double").alias("c"), y.alias("y"))
    sizes = state.groupBy(*own, "c").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"), F.min("y").alias("least"), F.max("y").alias("greatest"))
    group = [*own, "c"]
    state = written(state.join(sizes, group).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "task"), "parts").cast("int")))
    kinds = f"{_kinds(state, *group, 'task')}, a double"

    def solve(given: pd.DataFrame, k: np.ndarray) -> pd.DataFrame:
        y, a, c = given["y"].to_numpy(), given["a"].to_numpy(), float(given["c"].iloc[0])
        if y.min() < y.max():
            a, _ = solve_dual(k, y, c, a, y * given["f"].to_numpy() - 1, tolerance / 2)
        return pd.DataFrame({**{n: given[n].to_numpy() for n in [*group, "task"]}, "a": a})

    def moved(now: DataFrame, change: DataFrame) -> DataFrame:
        """now with the coefficients of change (group, task, a) and the decisions that follow from them."""
        step = now.join(change.withColumnRenamed("a", "to"), [*group, "task"]).select(*group, "task", "to", (F.col("y") * (F.col("to") - F.col("a"))).alias("by")).where("by <> 0")
        step = written(step)
        added = step.select(*group, F.col("task").alias("i"), "by").join(both, "i").groupBy(*group, F.col("j").alias("task")).agg(F.sum(F.col("by") * F.col("v")).alias("plus"))
        out = now.join(step.select(*group, "task", "to"), [*group, "task"], "left").join(added, [*group, "task"], "left")
        return written(out.select(*group, "task", "y", F.coalesce("to", "a").alias("a"), (F.col("f") + F.coalesce("plus", F.lit(0.0))).alias("f")))

    zero = state.select(*group, "task", "y", F.lit(0.0).alias("a"), F.lit(0.0).alias("f"), "part", "parts")
    first = _in_lots(zero.select(*group, "task", "y", "a", "f", "part"), gram, [*group, "part"], ("part",), solve, kinds, most * 2)
    now = moved(written(zero.drop("part", "parts")), first)
    score = F.col("y") - F.col("f")
    up = ((F.col("y") > 0) & (F.col("a") < F.col("c"))) | ((F.col("y") < 0) & (F.col("a") > 0))
    low = ((F.col("y") > 0) & (F.col("a") > 0)) | ((F.col("y") < 0) & (F.col("a") < F.col("c")))
    free = (F.col("a") > 1e-9 * F.col("c")) & (F.col("a") < F.col("c") * (1 - 1e-9))
    for _ in range(rounds):
        ends = now.groupBy(*group).agg(F.max(F.when(up, score)).alias("top"), F.min(F.when(low, score)).alias("bottom"), F.avg(F.when(free, score)).alias("mean"), F.first("y").alias("y1"))
        gap = F.coalesce(F.col("top") - F.col("bottom"), F.lit(0.0))
        # A group of one class has nothing to move on one side.
        ends = written(ends.select(*group, F.greatest(gap, F.lit(0.0)).alias("gap"), F.coalesce("mean", (F.col("top") + F.col("bottom")) / 2, "y1").alias("offset")))
        live = ends.where(F.col("gap") >= tolerance).select(*group)
        if live.isEmpty():
            break
        open_ = now.join(live, group)
        side = lambda on, order: open_.where(on).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(order, F.xxhash64("task")))).where(F.col("place") <= most // 2)  # noqa: B023, E731  each task of Spark keeps its own first rows before they meet
        chosen = side(up, score.desc()).drop("place").unionByName(side(low, score.asc()).drop("place")).distinct()
        now = moved(now, _in_lots(written(chosen), gram, group, tuple(group), solve, kinds, most))
    out = now.join(ends, group).withColumn("coef", F.col("a") * F.col("y"))
    one = out.groupBy(*group).agg(F.min_by(F.struct("task", "offset", "gap"), "task").alias("r")).select(*group, "r.*", F.lit(0.0).alias("coef"))  # so that machines without support tasks stay
    support = out.where("coef <> 0").select(*group, "task", "offset", "gap", "coef").unionByName(one)
    return support.select(*own, "c", "task", "coef", "offset", F.lit(1.0).alias("slope"), F.lit(0.0).alias("shift"), "gap")


def decided(machines: DataFrame, gram: DataFrame, tasks: DataFrame, *keys: str) -> DataFrame:
    """(keys, task, decision, p) for rows of tasks (keys, task): sums of coefficients by the Gram, and the offset."""
    if isinstance(gram, Kernel):
        return _decided_by_bags(machines, gram, tasks, list(keys))
    both = both_orders(gram)
    heads = machines.groupBy(*keys).agg(F.first("offset").alias("offset"), F.first("slope").alias("slope"), F.first("shift").alias("shift"))
    asked = tasks.select(*keys, F.col("task").alias("j")).distinct()
    sums = machines.where("coef <> 0").select(*keys, F.col("task").alias("i"), "coef").join(both, "i").join(asked, [*keys, "j"], "left_semi")
    sums = sums.groupBy(*keys, "j").agg(F.sum(F.col("coef") * F.col("v")).alias("s"))
    decision = F.coalesce("s", F.lit(0.0)) + F.col("offset")
    out = asked.join(heads, list(keys)).join(sums, [*keys, "j"], "left").select(*keys, F.col("j").alias("task"), decision.alias("decision"), "slope", "shift")
    return out.withColumn("p", 1 / (1 + F.exp(-(F.col("slope") * F.col("decision") + F.col("shift"))))).drop("slope", "shift")


def _decided_by_bags(machines: DataFrame, gram: Kernel, tasks: DataFrame, keys: list[str]) -> DataFrame:
    schema = f"{_kinds(tasks, *keys)}{', ' if keys else ''}{_kinds(tasks, 'task')}, decision double, p double"
    of = machines.select(*keys, "task", F.lit(False).alias("asked"), "coef", "offset", "slope", "shift")
    none = F.lit(0.0)
    to = tasks.select(*keys, "task").distinct()
    if keys:
        to = to.join(machines.select(*keys).distinct(), keys, "left_semi")
    to = to.withColumns({"asked": F.lit(True), "coef": none, "offset": none, "slope": none, "shift": none})

    def tell(group: pd.DataFrame, k: _Own) -> pd.DataFrame:
        held = group["asked"].to_numpy(bool)
        own, machine = group[held], group[~held]
        if not len(own) or not len(machine):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
        d = k.told(held, ~held, machine["coef"].to_numpy()) + machine["offset"].iloc[0]
        p = 1 / (1 + np.exp(-np.clip(machine["slope"].iloc[0] * d + machine["shift"].iloc[0], -700, 700)))
        return pd.DataFrame({**{n: own[n].to_numpy() for n in keys}, "task": own["task"].to_numpy(), "decision": d, "p": p})

    return _in_lots(of.unionByName(to), gram, keys, (), tell, schema, lots=3 * LOTS)
