"""Eigenvectors, singular vectors and scaling of tables (i, j, v), by iterations of products of blocks; only k x k numbers meet at the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.bags import dense_index
from sylva.session import written

#: Rows of a block of vectors, blocks that a task holds sums of, and the most multiplications between two looks at the residuals.
BLOCK, HELD, DEGREE = 1024, 16, 10
#: Sums of products that meet at the driver.
PARTS = 8
VECTORS = "b int, x array<double>"
#: Parts of the rows, each of which meets each in a task of its own, where a whole table is asked for.
BLOCKS = 16


def whole(gram: DataFrame) -> DataFrame:
    """A table of pairs i <= j as one of all pairs in both orders, 0 where it has none: it has the square of the rows. Blocks of pairs are dealt by a key."""
    both = gram.select("i", "j", "v").unionByName(gram.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    ids = both.select("i").distinct().withColumn("p", F.pmod(F.xxhash64("i"), F.lit(BLOCKS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    pairs = ids.select("i", "p", every.alias("q")).join(ids.select(F.col("i").alias("j"), every.alias("p"), F.col("p").alias("q")), ["p", "q"])
    return pairs.select("i", "j").join(both, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def centred(gram: DataFrame) -> DataFrame:
    """A whole symmetric table less its rows' and columns' means, plus its mean."""
    mean = gram.groupBy("i").agg(F.avg("v").alias("m"))
    whole = gram.agg(F.avg("v").alias("w"))  # one row
    side = lambda k, m: mean.select(F.col("i").alias(k), F.col("m").alias(m))
    return gram.join(side("i", "mi"), "i").join(side("j", "mj"), "j").join(F.broadcast(whole)).select("i", "j", (F.col("v") - F.col("mi") - F.col("mj") + F.col("w")).alias("v"))


def _placed(ids: DataFrame) -> DataFrame:
    """(id, b, at): each id's block of BLOCK and its place there."""
    index = dense_index(ids.select(F.col("id").alias("key")), "key")
    return written(index.select(F.col("key").alias("id"), F.floor(F.col("idx") / BLOCK).cast("int").alias("b"), (F.col("idx") % BLOCK).cast("int").alias("at")))


def _blocks(m: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """The table m (i, j, v) in blocks (b, c, i, j, v) of rows and columns: places and values as arrays."""
    side = lambda ids, name, b, at: ids.select(F.col("id").alias(name), F.col("b").alias(b), F.col("at").alias(at))
    placed = m.join(side(rows, "i", "b", "p"), "i").join(side(cols, "j", "c", "q"), "j")
    cells = F.collect_list(F.struct("p", "q", F.col("v").cast("double").alias("v")))  # BLOCK x BLOCK at most
    return written(placed.groupBy("b", "c").agg(cells.alias("s")).select("b", "c", F.col("s.p").alias("i"), F.col("s.q").alias("j"), F.col("s.v").alias("v")))


def _drawn(ids: DataFrame, k: int) -> DataFrame:
    """Vectors (b, x: a block's rows of k numbers) drawn by block, so that reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _row(b, np.random.default_rng([7, b]).normal(size=(n, k)))

    return written(ids.groupBy("b").agg(F.count("*").cast("int").alias("n")).mapInArrow(run, VECTORS))


def _row(b: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], ["b", "x"])


def _rows_of(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """Each row's list as an array."""
    column = batch.column(batch.schema.names.index(name))
    return np.split(column.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(column).to_numpy())[:-1])


def _times(m: DataFrame, x: DataFrame, k: int, factor: float = 1.0, less: DataFrame | None = None, transposed: bool = False) -> DataFrame:
    """factor * m x (or its transpose), less other vectors. A task adds up its blocks by row of blocks; these sums are added by key."""
    to, of = ("c", "b") if transposed else ("b", "c")
    met = m.select(F.col(to).alias("to"), F.col(of).alias("b"), F.col("j" if transposed else "i").alias("p"), F.col("i" if transposed else "j").alias("q"), "v").join(x, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, p, q, v, y in zip(batch.column(batch.schema.names.index("to")).to_pylist(), *(_rows_of(batch, n) for n in ("p", "q", "v", "x")), strict=True):
                y = y.reshape(-1, k)
                dense = np.zeros((int(p.max()) + 1, len(y)))
                dense[p, q] = v
                part = factor * (dense @ y)
                if b in sums and len(sums[b]) >= len(part):
                    sums[b][: len(part)] += part
                else:
                    if b in sums:
                        part[: len(sums[b])] += sums[b]
                    sums[b] = part
                if len(sums) > HELD:
                    yield _row(b := next(iter(sums)), sums.pop(b))
        for b, part in sums.items():
            yield _row(b, part)

    def added(table: pa.Table) -> pa.Table:
        parts = [np.asarray(r) for r in table.column("x").to_numpy()]
        out = np.zeros(max(map(len, parts)))
        for part in parts:  # the last rows of a block may be missing in a part
            out[: len(part)] += part
        return pa.table({"b": table.column("b")[:1], "x": pa.array([out], pa.list_(pa.float64()))})

    parts = met.mapInArrow(run, VECTORS)
    if less is not None:
        parts = parts.unionByName(less.select("b", F.transform("x", lambda t: -t).alias("x")))
    return written(parts.groupBy("b").applyInArrow(added, VECTORS))


def _turned(x: DataFrame, k: int, t: np.ndarray) -> DataFrame:
    """Vectors x times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, y in zip(batch.column(0).to_pylist(), _rows_of(batch, "x"), strict=True):
                yield _row(b, y.reshape(-1, k) @ t)

    return written(x.select("b", "x").mapInArrow(run, VECTORS))


def _products(x: DataFrame, y: DataFrame | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """x'y and y'y (x'x both, if there is no y): tasks add up theirs, these sums are added in PARTS, and PARTS meet at the driver."""
    both = x.withColumn("y", F.col("x")) if y is None else x.join(y.withColumnRenamed("x", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k, k))
        for batch in batches:
            for u, w in zip(_rows_of(batch, "x"), _rows_of(batch, "y"), strict=True):
                w = w.reshape(-1, k)
                u = u.reshape(-1, k)[: len(w)]
                total += u.T @ w[: len(u)], w.T @ w
        yield _row(TaskContext.get().partitionId() % PARTS, total)

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"b": table.column("b")[:1], "x": pa.array([np.sum(table.column("x").to_numpy(), axis=0)], pa.list_(pa.float64()))})

    sums = [np.array(r.x) for r in both.select("b", "x", "y").mapInArrow(run, VECTORS).groupBy("b").applyInArrow(added, VECTORS).collect()]  # PARTS rows
    return tuple(np.sum(sums, axis=0).reshape(2, k, k)) if sums else (np.zeros((k, k)), np.zeros((k, k)))


def _orthonormal(x: DataFrame, k: int) -> DataFrame:
    """Vectors of the same span that are orthonormal; directions that the span lacks become 0."""
    for _ in range(2):  # the second turn mends what the first one's rounding has left
        value, vector = np.linalg.eigh(_products(x, None, k)[0])
        scale = np.where(value > 1e-14 * max(value.max(), 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
        x = _turned(x, k, vector * scale)
        if value.min() > 1e-6 * value.max():
            break
    return x


def _invariant(apply, x: DataFrame, k: int, wide: int, tolerance: float, rounds: int) -> tuple[np.ndarray, DataFrame, float]:
    """The k greatest eigenvalues (by size) of a symmetric map and their vectors, from the start x of wide vectors.

    Each round filters the vectors by a Chebyshev polynomial that damps what is below the least value of the subspace,
    and ends with values, vectors and residuals within the subspace. It ends when no residual of the k is above the
    tolerance, as a part of the greatest value; that none ends in the rounds given is an error.
    """
    x = _orthonormal(apply(x, 1.0, None), wide)
    worst = np.inf
    for _ in range(rounds):
        y = apply(x, 1.0, None)
        h, g = _products(x, y, wide)
        value, turn = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-np.abs(value), kind="stable")
        value, turn = value[order], turn[:, order]
        size = np.abs(value)
        residual = np.sqrt(np.maximum(np.einsum("ia,ij,ja->a", turn, g, turn) - value**2, 0.0))
        worst = float(residual[:k].max() / max(size[0], 1e-300))
        x = _turned(x, wide, turn)
        if worst <= tolerance:
            return value[:k], _turned(x, wide, np.eye(wide)[:, :k]), worst
        low = max(size[-1], 1e-6 * size[0])
        degree = int(np.clip(np.log(2e6) / max(np.arccosh(max(size[0] / low, 1.0)), 1e-3), 2, DEGREE))
        before, now = x, apply(x, 1 / low, None)
        for _ in range(degree - 1):
            before, now = now, apply(now, 2 / low, before)
        grown = np.cosh(degree * np.arccosh(np.maximum(size / low, 1.0)))
        x = _orthonormal(_turned(now, wide, np.diag(1 / grown)), wide)
    raise RuntimeError(f"after {rounds} rounds a residual of {worst:.3g} is left, {tolerance} is allowed")


def _by_id(x: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """(id, x) of vectors in blocks; ids past the last cells of their block have zeros."""
    rows = ids.join(x, "b", "left")
    return rows.select("id", F.when(F.size("x") >= (F.col("at") + 1) * k, F.slice("x", F.col("at") * k + 1, k)).otherwise(F.array_repeat(F.lit(0.0), k)).alias("x"))


def eigenvectors(m: DataFrame, k: int, tolerance: float = 1e-6, rounds: int = 60, spare: int | None = None) -> tuple[list[float], DataFrame]:
    """The k greatest eigenvalues (by size) of a whole symmetric table and the vectors (id, x), by filtered subspace iteration from drawn starts.

    Residuals are at most the tolerance as a part of the greatest value. Rows stand in blocks of BLOCK: products are of blocks, and
    only k x k numbers meet at the driver.
    """
    ids = _placed(m.select(F.col("i").alias("id")).distinct())
    n = ids.count()
    wide = min(k + (max(8, k // 4) if spare is None else spare), n)
    blocks = _blocks(m, ids, ids)
    values, x, _ = _invariant(lambda x, factor, less: _times(blocks, x, wide, factor, less), _drawn(ids, wide), min(k, wide), wide, tolerance, rounds)
    return values.tolist(), _by_id(x, len(values), ids)


def kernel_components(gram: DataFrame, k: int) -> DataFrame:
    """(id, x): kernel principal components of a whole symmetric Gram table, each scaled by the root of its eigenvalue."""
    values, vectors = eigenvectors(written(centred(gram)), k)
    scale = F.array(*[F.lit(float(np.sqrt(max(v, 0.0)))) for v in values])
    return vectors.select("id", F.zip_with("x", scale, lambda a, b: a * b).alias("x"))


def singular_rows(rows: DataFrame, k: int, tolerance: float = 1e-6, rounds: int = 60) -> tuple[list[float], DataFrame]:
    """The k greatest singular values of a sparse table (row, col, cnt) and (id, x): its rows on the right singular vectors. Residuals are those of the table times itself."""
    m = written(rows.select(F.col("row").alias("i"), F.col("col").alias("j"), F.col("cnt").cast("double").alias("v")))
    left = _placed(m.select(F.col("i").alias("id")).distinct())
    n = left.count()
    if n <= BLOCK and n <= m.select("j").distinct().count():
        return _from_products(m, left, n, k, tolerance, rounds)
    right = _placed(m.select(F.col("j").alias("id")).distinct())
    wide = min(k + max(8, k // 4), right.count())
    blocks = _blocks(m, left, right)

    def apply(x: DataFrame, factor: float, less: DataFrame | None) -> DataFrame:
        return _times(blocks, _times(blocks, x, wide), wide, factor, less, transposed=True)

    values, x, _ = _invariant(apply, _drawn(right, wide), min(k, wide), wide, tolerance, rounds)
    return np.sqrt(np.maximum(values, 0.0)).tolist(), _by_id(_times(blocks, x, len(values)), len(values), left)


def _from_products(m: DataFrame, left: DataFrame, n: int, k: int, tolerance: float, rounds: int) -> tuple[list[float], DataFrame]:
    """singular_rows of n rows, BLOCK at most, that have more columns: from the products of the rows, so that no vectors have the columns' length.

    A task adds up the products of its columns, and these n x n numbers are added in PARTS. With the vectors u and values s
    of the products, rows on the right singular vectors are u s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            places, values = _rows_of(batch, "at"), _rows_of(batch, "v")
            for start in range(0, len(places), BLOCK):
                at, v = places[start : start + BLOCK], values[start : start + BLOCK]
                dense = np.zeros((n, len(at)))
                np.add.at(dense, (np.concatenate(at), np.repeat(np.arange(len(at)), [len(a) for a in at])), np.concatenate(v))
                total += dense @ dense.T
        yield _row(TaskContext.get().partitionId() % PARTS, total)

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"b": table.column("b")[:1], "x": pa.array([np.sum(table.column("x").to_numpy(), axis=0)], pa.list_(pa.float64()))})

    cells = m.join(F.broadcast(left.select(F.col("id").alias("i"), "at")), "i")  # BLOCK rows
    columns = cells.groupBy("j").agg(F.collect_list(F.struct("at", "v")).alias("s")).select(F.col("s.at").alias("at"), F.col("s.v").alias("v"))  # BLOCK of a column, if no cell is given twice
    sums = columns.mapInArrow(run, VECTORS).groupBy("b").applyInArrow(added, VECTORS)
    whole = written(sums.select(F.posexplode("x").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")))
    place = F.struct(F.lit(0).alias("b"), F.lit(0).alias("c"))
    cells = F.collect_list(F.struct(F.floor(F.col("p") / n).cast("int").alias("i"), (F.col("p") % n).cast("int").alias("j"), "v"))
    block = written(whole.groupBy(place.alias("of")).agg(cells.alias("s")).select("of.b", "of.c", F.col("s.i").alias("i"), F.col("s.j").alias("j"), F.col("s.v").alias("v")))  # one block
    wide = min(k + max(8, k // 4), n)
    values, x, _ = _invariant(lambda x, factor, less: _times(block, x, wide, factor, less), _drawn(left, wide), min(k, wide), wide, tolerance, rounds)
    size = np.sqrt(np.maximum(values, 0.0))
    vectors = _by_id(x, len(values), left)
    return size.tolist(), vectors.select("id", F.zip_with("x", F.array(*[F.lit(float(v)) for v in size]), lambda a, b: a * b).alias("x"))


def scaled(dissimilarity: DataFrame, k: int = 2, rounds: int = 20, tolerance: float = 1e-4) -> tuple[float, DataFrame]:
    """Stress and (id, x): points whose distances follow a whole symmetric table of dissimilarities, each step a join of pairs with points."""
    d = written(dissimilarity.where("i <> j").select("i", "j", "v"))
    ids = written(dissimilarity.select(F.col("i").alias("id")).distinct())
    n = ids.count()
    x = written(ids.select("id", F.array(*[(F.xxhash64(F.lit(f"start{a}"), "id") / F.lit(float(1 << 63))) for a in range(k)]).alias("x")))
    last = float("inf")
    while True:
        side = lambda name, as_: x.select(F.col("id").alias(name), F.col("x").alias(as_))  # noqa: E731, B023
        pairs = d.join(side("i", "a"), "i").join(side("j", "b"), "j")
        away = F.sqrt(sum(((F.col("a")[c] - F.col("b")[c]) * (F.col("a")[c] - F.col("b")[c]) for c in range(k)), F.lit(0.0)))
        pairs = written(pairs.withColumn("away", away))
        stress = (pairs.agg(F.sum((F.col("away") - F.col("v")) * (F.col("away") - F.col("v"))).alias("s")).first().s or 0.0) / 2
        rounds -= 1
        if rounds < 0 or last - stress < tolerance * max(stress, 1e-300):
            return stress, x
        last = stress
        pull = F.when(F.col("away") > 0, F.col("v") / F.col("away")).otherwise(0.0)
        moved = pairs.groupBy(F.col("i").alias("id")).agg(F.array(*[F.sum(pull * (F.col("a")[c] - F.col("b")[c])) / n for c in range(k)]).alias("y"))
        x = written(x.join(moved, "id", "left").select("id", F.coalesce("y", "x").alias("x")))
