"""Approximate nearest neighbours by learned partitions.

1. Fit, on at most `SAMPLE` vectors (those with the least hash of the id): the exact neighbour graph, a
   balanced partition of it (projection halves, then moves to the part of most neighbours while there is
   room), and a softmax classifier from a vector to the parts that hold it and its neighbours.  The number of
   parts a query probes is the least that finds `GOAL` of the neighbours of vectors the classifier was not
   trained on.
2. Index: every vector goes to its most probable part.  Parts are dealt in blocks of about `BLOCK` rows, so
   that a part that holds a third of all vectors is many blocks.
3. Search: a query goes to all blocks of its most probable parts; each block returns its best rows in double
   precision on the original vectors, and the best of those are the result.

The model is a matrix of parts x dimensions, whatever the input.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import staged, table

SAMPLE = 8192
PART_ROWS = 4096  # rows of a part aimed at: what a part returns for a query is few of them
LEAST_PARTS = 16  # of any table with the vectors to fit them
LEAST_FIT = 24  # sampled vectors for a part, at least
GRAPH = 10  # neighbours in the graph
GOAL = 0.95
BLOCK, QUERIES = 4096, 512


class Partitions(NamedTuple):
    weights: np.ndarray  # (dimensions + 1) x parts
    probes: int


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x), k), np.int64)
    for low in range(0, len(x), 512):
        s = x[low : low + 512] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -np.inf
        out[low : low + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(x: np.ndarray, rows: np.ndarray, parts: int, first: int, out: np.ndarray, rng) -> None:
    """Split `rows` evenly into `parts` by the direction of largest spread, again and again."""
    if parts == 1:
        out[rows] = first
        return
    centred = x[rows] - x[rows].mean(0)
    way = rng.normal(size=x.shape[1])
    for _ in range(8):
        way = centred.T @ (centred @ way)
        way /= np.linalg.norm(way) or 1.0
    left = parts // 2
    order = rows[np.argsort(centred @ way, kind="stable")]
    cut = len(rows) * left // parts
    _halves(x, order[:cut], left, first, out, rng)
    _halves(x, order[cut:], parts - left, first + left, out, rng)


def partition_graph(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, sweeps: int = 8) -> np.ndarray:
    """A balanced partition that keeps neighbours together."""
    rng = np.random.default_rng(5)
    part = np.zeros(len(x), np.int64)
    _halves(x, np.arange(len(x)), parts, 0, part, rng)
    room = int(np.ceil(len(x) / parts * (1 + slack)))
    size = np.bincount(part, minlength=parts)
    # Edges count in both directions.
    ends = np.concatenate((graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])))
    starts = np.concatenate((np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()))
    order = np.argsort(starts, kind="stable")
    ends, first = ends[order], np.searchsorted(starts[order], np.arange(len(x) + 1))
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(len(x)):
            votes = np.bincount(part[ends[first[v] : first[v + 1]]], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != part[v])] = -1
            to = int(votes.argmax())
            if votes[to] > votes[part[v]]:
                size[part[v]] -= 1
                size[to] += 1
                part[v], moved = to, moved + 1
        if not moved:
            break
    return part


def fit(x: np.ndarray, rows: int, top: int = 20, epochs: int = 40) -> Partitions:
    """Partitions for an index of `rows` vectors, from the sample `x`."""
    n, d = x.shape
    parts = max(1, min(max(LEAST_PARTS, -(-rows // PART_ROWS)), n // LEAST_FIT))
    if parts == 1:
        return Partitions(np.zeros((d + 1, 1)), 1)
    scale = np.sqrt((x**2).mean()) or 1.0
    ones = np.concatenate((x / scale, np.ones((n, 1))), 1)
    graph = _neighbours(x, min(GRAPH, n - 1))
    part = partition_graph(x, graph, parts)
    # What a vector should be routed to: its own part, and those of its neighbours as far as they lie there.
    wish = np.zeros((n, parts))
    np.add.at(wish, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    wish[np.arange(n), part] += 0.5
    w, m1, m2, t = np.zeros((d + 1, parts)), 0.0, 0.0, 0
    rng = np.random.default_rng(6)
    asked = np.arange(0, n, max(8, n // 1024))  # held out of the classifier
    seen = np.setdiff1d(np.arange(n), asked)
    for _ in range(epochs):
        for rows_ in np.array_split(rng.permutation(seen), max(1, n // 256)):
            z = ones[rows_] @ w
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            g = ones[rows_].T @ (z - wish[rows_]) / len(rows_) + 1e-4 * w
            t += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            w = w - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    # Probes: the least number of parts that hold GOAL of the neighbours, as they will be indexed.
    z = ones @ w
    at, rank = z.argmax(1), np.zeros((n, parts), np.int64)
    np.put_along_axis(rank, np.argsort(-z, 1, kind="stable"), np.arange(parts)[None, :], 1)
    near = _neighbours(x, min(top, n - 1))[asked]
    depth = np.sort(rank[asked[:, None], at[near]].ravel())
    probes = int(depth[min(len(depth) - 1, int(np.ceil(GOAL * len(depth))))]) + 1
    w[:d] /= scale
    return Partitions(w, min(parts, probes))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def _assign(model: Partitions, many: int):
    """(id, x, parts): the `many` most probable parts of each vector."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), len(model.weights) - 1)
            z = x @ model.weights[:-1] + model.weights[-1]
            parts = np.argsort(-z, 1, kind="stable")[:, :many]
            where = pa.array(np.arange(len(x) + 1) * parts.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(where, pa.array(parts.ravel().astype(np.int32)))], names=["id", "x", "parts"])

    return run


def _best(top: int):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        held = held.sort_values("id")
        q, c = np.stack(asked.x.to_numpy()).astype(np.float64), np.stack(held.x.to_numpy()).astype(np.float64)
        ids, mine = held.id.to_numpy(), asked.id.to_numpy()
        out = []
        for k in range(len(q)):
            # One order of summation for all rows, so that equal vectors tie exactly.
            s = np.einsum("d,cd->c", q[k], c)
            s[ids == mine[k]] = -np.inf
            n = min(top, int(np.isfinite(s).sum()))
            if not n:
                continue
            least = np.partition(s, len(s) - n)[len(s) - n]
            near = np.flatnonzero(s >= least)
            near = near[np.argsort(-s[near], kind="stable")][:n]
            out.append(pd.DataFrame({"query_id": mine[k], "vec_id": ids[near], "score": s[near]}))
        return pd.concat(out) if out else run(asked[:0], held)

    return run


def search(spark: SparkSession, vectors: DataFrame, asked: DataFrame, top: int = 20, sample: int = SAMPLE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `asked` the `top` rows of `vectors` found nearest.

    Nearness is the largest inner product; ties go to the smaller id; a row is not its own neighbour (ids tell).
    Null ids, and vectors that are null, empty, zero, of another length than most, or with null or non-finite
    components take no part.  Repeated ids on either side: each row counts, answers of one id are merged.
    """

    def valid(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and size(x) > 0")
        sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return rows.where(sound & F.exists("x", lambda v: v != 0))

    every = valid(vectors)
    size = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()  # a row for each length
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    d, rows = size
    every = every.where(F.size("x") == d)
    drawn = every.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().sort_by("id")
    model = fit(_matrix(drawn["x"].combine_chunks(), d), rows, top)
    held = staged(spark, every.mapInArrow(_assign(model, 1), "id long, x array<double>, parts array<int>").select("id", "x", F.col("parts")[0].alias("part")))
    queries = valid(asked).where(F.size("x") == d).mapInArrow(_assign(model, model.probes), "id long, x array<double>, parts array<int>")
    queries = staged(spark, queries.select("id", "x", F.explode("parts").alias("part")))

    # At most one row for each part, and parts are at most sample / LEAST_FIT.
    blocks = held.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = queries.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    cells = F.broadcast(staged(spark, blocks.join(groups, "part")))
    held = held.join(cells, "part").select("id", "x", "part", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    queries = queries.join(cells, "part").select("id", "x", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "groups").cast("int").alias("group"))
    on = ["part", "block", "group"]
    found = queries.groupBy(*on).cogroup(held.groupBy(*on)).applyInPandas(_best(top), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_learned_partition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(spark, vectors, vectors.where("vec_id % 20 = 0"))
