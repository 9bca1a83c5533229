"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt by hash into shards. Each shard builds a graph: batches of points search
it greedily from its centre, the points met are pruned to a diverse few (a candidate goes if a kept
neighbour is nearer to it than the point is, up to a factor), edges are also led back, and lists
that grow too long are pruned again. Queries go to the shards in blocks; a beam search per shard
finds candidates, whose distances are then taken in double precision and merged over the shards.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.common import cut
from sylva.session import table

#: Out-edges, beams while building and searching, the pruning's factors (a round each), points inserted at once.
DEGREE, BUILD, SEARCH, RELAX, BATCH = 24, 40, 64, (1.0, 1.2), 256
#: Vectors of a shard, at least and at most, and shards that are aimed at between these; queries of a block, on average.
SHARD, LARGEST, SHARDS, BLOCK = 6_000, 100_000, 64, 20_000


def _distances(q: np.ndarray, x: np.ndarray, ids: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own square, to x[ids] (rows by query)."""
    return squares[ids] - 2 * np.einsum("qd,qkd->qk", q, x[ids], optimize=True)


def beam_search(q: np.ndarray, x: np.ndarray, squares: np.ndarray, edges: np.ndarray, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width nearest points met by each query (-1: none) and their distances, nearest first."""
    n, m = len(q), len(x)
    ids = np.full((n, width), m)
    dist = np.full((n, width), np.inf, np.float32)
    ids[:, 0] = start
    dist[:, 0] = squares[start] - 2 * q @ x[start]
    done = np.zeros((n, width), bool)
    met = np.zeros((n, m + 1), bool)
    met[:, start] = True
    met[:, m] = True
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live] | (ids[live] == m), np.inf, dist[live])
        at = open_.argmin(1)
        some = np.isfinite(open_[np.arange(len(live)), at])
        live, at = live[some], at[some]
        if not len(live):
            break
        done[live, at] = True
        near = edges[ids[live, at]]
        fresh = ~met[live[:, None], near]
        met[live[:, None], near] = True
        d = np.where(fresh, _distances(q[live], x, np.minimum(near, m - 1), squares), np.inf).astype(np.float32)
        all_d, all_i = np.concatenate([dist[live], d], 1), np.concatenate([ids[live], np.where(fresh, near, m)], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :width]
        dist[live], ids[live], done[live] = (np.take_along_axis(v, order, 1) for v in (all_d, all_i, all_done))
    return np.where(np.isfinite(dist), ids, -1), dist


def prune(points: np.ndarray, ids: np.ndarray, x: np.ndarray, relax: float, degree: int = DEGREE) -> np.ndarray:
    """For each point (a row), a diverse few of the candidates ids (-1: none): nearest first, without those that a kept one is nearer to."""
    n, m = len(points), len(x)
    ids = np.where((ids < 0) | (ids == points[:, None]), m, ids)
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = m
    safe = np.minimum(ids, m - 1)
    v = x[safe]
    d = ((v - x[points][:, None]) ** 2).sum(2)
    d[ids == m] = np.inf
    order = np.argsort(d, 1, kind="stable")
    d, v, ids = np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1), np.take_along_axis(ids, order, 1)
    out = np.full((n, degree), m)
    alive, rows, size = np.isfinite(d), np.arange(n), np.zeros(n, np.int64)
    for _ in range(degree):
        k = alive.argmax(1)
        some = rows[alive[rows, k]]
        if not len(some):
            break
        k = k[some]
        out[some, size[some]] = ids[some, k]
        size[some] += 1
        between = ((v[some] - v[some, k][:, None]) ** 2).sum(2)
        alive[some] &= relax * relax * between > d[some]
        alive[some, k] = False
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges (rows of DEGREE, padded with len(x)) and the point where searches start."""
    m = len(x)
    rng = np.random.default_rng(11)
    squares = (x * x).sum(1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    edges = np.full((m + 1, DEGREE), m)
    if m > 1:
        edges[:m, : min(DEGREE, m - 1)] = (np.arange(m)[:, None] + 1 + rng.integers(0, m - 1, (m, min(DEGREE, m - 1)))) % m
    for relax in RELAX:
        order = rng.permutation(m)
        for at in range(0, m, BATCH):
            p = order[at : at + BATCH]
            found, _ = beam_search(x[p], x, squares, edges, start, BUILD)
            out = prune(p, np.concatenate([found, np.where(edges[p] < m, edges[p], -1)], 1), x, relax)
            edges[p] = out
            # Edges back: each target's list takes its new ones; lists that overflow are pruned.
            source, target = np.repeat(p, DEGREE), out.ravel()
            source, target = source[target < m], target[target < m]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            ts, first, n = np.unique(target, return_index=True, return_counts=True)
            more = np.full((len(ts), int(n.max()) if len(n) else 1), -1)
            more[np.repeat(np.arange(len(ts)), n), np.arange(len(target)) - np.repeat(first, n)] = source
            for lo in range(0, len(ts), BATCH):
                t = ts[lo : lo + BATCH]
                edges[t] = prune(t, np.concatenate([np.where(edges[t] < m, edges[t], -1), more[lo : lo + BATCH]], 1), x, relax)
    return edges, start


_SHARD = "shard bigint, vectors binary, ids binary, sizes binary, edges binary, start bigint, width int"


def index(vectors: DataFrame, degree: int = DEGREE) -> DataFrame:
    """A graph for each shard of vectors (shard, ids: the least of each vector's, v: its components)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        edges, start = build((x - x.mean(0)).astype(np.float32))
        ids = np.concatenate(pdf["ids"].to_numpy())
        sizes = np.array([len(i) for i in pdf["ids"]])
        row = (int(pdf["shard"].iloc[0]), x.tobytes(), ids.astype(np.int64).tobytes(), sizes.tobytes(), edges.astype(np.int32).tobytes(), start, x.shape[1])
        return pd.DataFrame([row], columns=["shard", "vectors", "ids", "sizes", "edges", "start", "width"])

    return vectors.groupBy("shard").applyInPandas(run, _SHARD)


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    v = F.col("v")
    df = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.where(F.coalesce(fine, F.lit(False)))


def search(embeddings: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance, in doubles) of the k nearest found for each row whose id is divisible by every.

    Rows whose vector is null, empty, zero, or holds null or non-finite components, and rows without
    an id, take no part; vectors of unlike lengths are searched apart. Equal vectors share a node,
    which keeps the k + 1 least of their ids; no other can be among the k nearest. Repeated rows
    (equal id and vector) count once. Ties go to the smaller id. An empty table gives an empty result;
    other columns are ignored. Very long vectors are compared whole.

    Every block of queries meets every shard. Shards grow with the table up to LARGEST vectors, which
    bounds a task's memory; up to SHARDS times that, the searches grow in proportion to the queries.
    """
    rows = usable(embeddings, key, vector).withColumn("v", F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)))  # -0.0 is 0.0
    # The k + 1 least ids of each vector, cut down in each task before they meet.
    least = Window.partitionBy("v").orderBy("id")
    kept = rows.select("v", "id").distinct().withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    nodes = cut(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")))
    counts = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length
    shards_of = {d: -(-n // min(max(SHARD, -(-n // SHARDS)), LARGEST)) for d, n in counts.items()}
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in shards_of.items()], F.lit(1))
    draw = F.pmod(F.xxhash64("v"), shards)
    sharded = nodes.withColumn("shard", F.col("dim").cast("long") * (1 << 32) + draw)
    graphs = cut(index(sharded))

    asked = cut(rows.where(F.col("id") % every == 0).dropDuplicates(["id"]).withColumn("dim", F.size("v")))
    asked_counts = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // BLOCK))) for d, n in asked_counts.items()], F.lit(1))
    block = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), blocks)).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    # Each block goes to each shard of its length, so that a shard is a key of its own.
    first = F.col("dim").cast("long") * (1 << 32)
    shard = F.explode(F.sequence(first, first + shards - 1)).alias("shard")
    pairs = graphs.join(block.select("block", "queries", shard), "shard")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})]
        for r in pdf.itertuples():
            x = np.frombuffer(r.vectors).reshape(-1, r.width)
            ids, sizes = np.frombuffer(r.ids, np.int64), np.frombuffer(r.sizes, np.int64)
            first = np.cumsum(sizes) - sizes
            edges = np.frombuffer(r.edges, np.int32).reshape(-1, DEGREE).astype(np.int64)
            centre = x.mean(0)
            small = (x - centre).astype(np.float32)
            qid = np.array([q["id"] for q in r.queries])
            q = np.array([q["v"] for q in r.queries])
            for at in range(0, len(q), BATCH):
                found, _ = beam_search((q[at : at + BATCH] - centre).astype(np.float32), small, (small * small).sum(1), edges, r.start, max(SEARCH, 2 * k))
                there = np.maximum(found, 0)
                d = np.sqrt(((x[there] - q[at : at + BATCH][:, None]) ** 2).sum(2))
                d[found < 0] = np.inf
                order = np.argsort(d, 1, kind="stable")
                out = []
                for i in range(len(d)):
                    got = 0
                    last = -1.0
                    for j in order[i].tolist():
                        if not np.isfinite(d[i, j]) or (got >= k and d[i, j] > last):
                            break
                        node = there[i, j]
                        own = qid[at + i]
                        for v in ids[first[node] : first[node] + sizes[node]].tolist():
                            if v != own:
                                out.append((own, v, d[i, j]))
                                got += 1
                        last = d[i, j]
                parts.append(pd.DataFrame(out, columns=["query_id", "vec_id", "score"]))
        return pd.concat(parts)

    hits = pairs.groupBy("shard", "block").applyInPandas(run, "query_id bigint, vec_id bigint, score double")  # a shard and a block at once
    # An id with several vectors counts at its nearest.
    best = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
