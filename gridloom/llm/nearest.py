"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to length 1, where the largest cosine is the smallest Euclidean distance, and
projected to PROJECTED dimensions with a seeded Gaussian matrix (a 2-stable distribution): the
squared projected distance of two points over their squared distance has a chi-square law with
PROJECTED degrees of freedom. Points are taken in the order of their projected distance and verified on
the full vectors, until with the k-th best distance d and projected radius r chi-square(r^2 / d^2)
reaches CONFIDENCE: a point nearer than d would then have been met with that probability.

The index has two levels. A kd-tree over a bounded sample (SAMPLE rows) of projections cuts space into
cells of about SHARD rows, MAX_CELLS at most; every row is in a cell. A query searches its own cell
first, and then, with the distance that it has found, only the cells that its test doesn't exclude. A cell is dealt to parts
of about SHARD rows at random, so an id or a vector that a third of all rows share, or a table far larger
than the sample can cut, makes more parts, not larger ones. Each part has a kd-tree of its own: queries take its leaves in the order of
their projected distance, and of a leaf those points that pass the test.

Equal vectors of a part are one point of its tree, with its k + 1 smallest ids. Queries come in blocks
of bounded size; a part's rows are sent once for each block of queries that come to its cell.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; so do null ids; a query's candidates exclude every row with its
id; a query with no candidate gives no rows; rows that repeat an id and a vector count once, other
rows of that id are candidates of their own; equal scores go to the smaller id; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import cut, table, trimmed

PROJECTED, SEED, CONFIDENCE = 16, 5, 0.92
LEAF = 128
#: Rows of a cell and of a part, and queries of a block, about.
SHARD, BLOCK = 20_000, 4_000
#: Queries that are sent to their cells at once.
ASKING = 64
#: Rows that the first level is fitted on, and its cells at most.
SAMPLE, MAX_CELLS = 16_384, 1024
#: Squared distances are told apart by so much, and points of a part are numbered by so many bits.
GRAIN, NUMBERS = 1e-12, 20
NONE = np.int64((1 << 63) - 1)


def chi_square(x: float, k: int) -> float:
    """The distribution function, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    if z > a + 60 + 10 * a:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-12:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * exp(-z + a * log(z) - lgamma(a)))


@lru_cache
def stopping_ratio(k: int, confidence: float) -> float:
    """Where the distribution reaches confidence."""
    low, high = 0.0, 50.0 * k
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < confidence else (low, mid)
    return high


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, PROJECTED))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; a power of two brings the largest component near 1 first, so that no square overflows or vanishes."""
    scaled = scaled_near_one(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def scaled_near_one(vectors: np.ndarray) -> np.ndarray:
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """A kd-tree's leaves of up to most points: halves along the widest axis, again and again."""
    stack, out = [np.arange(len(points))], []
    while stack:
        own = stack.pop()
        if len(own) <= most:
            out.append(own)
            continue
        axis, m = int(np.ptp(points[own], axis=0).argmax()), len(own) // 2
        own = own[np.argpartition(points[own, axis], m)]
        stack += [own[m:], own[:m]]
    return out


class Cells:
    """The first level: a kd-tree over projections with unbounded outer cells."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.at, self.low, self.high, self.child, self.number = [], [], [], [], [], []
        ends = (np.full(PROJECTED, -np.inf), np.full(PROJECTED, np.inf))
        stack = [(np.arange(len(points)), cells, *ends, None)]
        while stack:
            own, n, low, high, up = stack.pop()
            node = len(self.axis)
            for column, v in zip((self.axis, self.at, self.low, self.high, self.child, self.number), (0, 0.0, low, high, [], -1), strict=True):
                column.append(v)
            if up is not None:
                self.child[up].append(node)
            axis = int(np.ptp(points[own], axis=0).argmax()) if len(own) > 1 else 0
            at = float(np.median(points[own, axis])) if len(own) > 1 else 0.0
            if n > 1 and len(own) > 1 and (points[own, axis] < at).any():
                left = points[own, axis] < at
                inner, outer = high.copy(), low.copy()
                inner[axis] = outer[axis] = at
                self.axis[node], self.at[node] = axis, at
                stack += [(own[~left], n - n // 2, outer, high, node), (own[left], n // 2, low, inner, node)]
        ends = [k for k in range(len(self.axis)) if not self.child[k]]
        for c, k in enumerate(ends):
            self.number[k] = c
        self.boxes = np.array([self.low[k] for k in ends]), np.array([self.high[k] for k in ends])

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, stack = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while stack:
            node, own = stack.pop()
            if not self.child[node]:
                out[own] = self.number[node]
                continue
            left = points[own, self.axis[node]] < self.at[node]
            stack += [(self.child[node][0], own[left]), (self.child[node][1], own[~left])]
        return out

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """(points, cells): the squared distance to each cell."""
        return _bounds(points, *self.boxes)


def _bounds(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        x = points[:, axis, None]
        gap = np.maximum(np.maximum(low[None, :, axis] - x, x - high[None, :, axis]), 0)
        out += gap * gap
    return out


def search(
    points: np.ndarray, queries: np.ndarray, k: int, label: np.ndarray, own: np.ndarray, reach: np.ndarray | None = None
) -> tuple[np.ndarray, int]:
    """(queries, k) numbers of the nearest found points, -1 where there are fewer, and how many were verified in all.

    A query doesn't find points whose label is its own; reach is a squared distance that it has k points within
    already. Equal distances go to the lower number.
    """
    matrix = projection(points.shape[1])
    near, far = points @ matrix, queries @ matrix
    parts = leaves(near, LEAF)
    low, high = (np.array([f(near[p], axis=0) for p in parts]) for f in (np.min, np.max))
    ratio, verified = stopping_ratio(PROJECTED, CONFIDENCE), 0
    bound = _bounds(far, low, high)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full((len(queries), k), NONE)
    worst = np.full(len(queries), np.inf) if reach is None else np.maximum(reach, GRAIN)
    active = np.arange(len(queries))
    for step in range(len(parts)):
        leaf = order[active, step]
        on = bound[active, leaf] < ratio * worst[active]
        active, leaf = active[on], leaf[on]  # the rest of a query's leaves is farther still
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(leaf[by]) != 0)).tolist() + [len(by)]
        for a, b in zip(edges[:-1], edges[1:]):
            who, here = active[by[a:b]], parts[leaf[by[a]]]
            r = ((far[who] ** 2).sum(1)[:, None] + (near[here] ** 2).sum(1)[None, :]) - 2 * far[who] @ near[here].T
            passed = (r < ratio * worst[who][:, None]) & (label[here][None, :] != own[who][:, None])
            verified += int(passed.sum())
            d = np.maximum(2 - 2 * queries[who] @ points[here].T, 0)
            code = np.where(passed, np.rint(d / GRAIN).astype(np.int64) << NUMBERS | here[None, :], NONE)
            both = np.concatenate([best[who], code], 1)
            both.partition(k - 1, axis=1)
            best[who] = both[:, :k]
            last = both[:, :k].max(1)
            found = np.where(last == NONE, np.inf, (last >> NUMBERS) * GRAIN + GRAIN)
            worst[who] = np.minimum(worst[who], np.maximum(found, GRAIN))
    best.sort(axis=1)
    return np.where(best == NONE, -1, best & ((1 << NUMBERS) - 1)), verified


def usable(vector: str, size: int) -> F.Column:
    """Not null, of the given length, finite and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vector, lambda x: x != 0)
    return F.col(vector).isNotNull() & (F.size(vector) == size) & ~bad & ~zero


def _stacked(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def nearest(
    df: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest cosine found for each row that is_query holds for."""
    sizes = df.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("n")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    size = most["n"] if most else 1
    rows = df.where(F.col(id_col).isNotNull() & usable(vector_col, size)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks")
    )
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30))
    sample = rows.where(draw < int(min(1.0, SAMPLE / 2 / max(n, 1)) * (1 << 30))).select("vector").limit(SAMPLE).toArrow()
    vectors = _stacked(sample.column("vector").combine_chunks(), size) if len(sample) else np.zeros((0, size))
    cells = Cells(unit(vectors) @ projection(size) if len(vectors) else np.zeros((0, PROJECTED)), min(MAX_CELLS, ceil(n / SHARD)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            found = cells.of(unit(_stacked(batch.column(1), size)) @ projection(size)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "cell"])

    kind = rows.schema["vector"].dataType.simpleString()
    placed = cut(rows.mapInArrow(place, f"id long, vector {kind}, asks boolean, cell long"), "placed")
    own = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
    parts = {c: ceil(x / SHARD) for c, x in own.items()}
    asking = placed.where("asks").select("id", "vector", "cell").distinct().withColumn("reach", F.lit(float("inf")))
    found = cut(_searched(placed, asking, parts, k, size), "found")
    if len(own) > 1:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        held = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") == k)
        reach = held.select(F.col("query_id").alias("id"), (2 - 2 * F.col("score")).alias("reach"))
        far = asking.drop("reach").join(reach, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        ratio = stopping_ratio(PROJECTED, CONFIDENCE)

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in trimmed(batches):
                for a in range(0, batch.num_rows, ASKING):
                    part = batch.slice(a, ASKING)
                    bound = cells.bounds(unit(_stacked(part.column(1), size)) @ projection(size))
                    go = bound < ratio * np.maximum(part.column(3).to_numpy(), GRAIN)[:, None]
                    go[np.arange(len(go)), part.column(2).to_numpy()] = False
                    who, cell = np.nonzero(go)
                    taken = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cell, pa.int64()), taken.column(3)], ["id", "vector", "cell", "reach"])

        more = cut(far.select("id", "vector", "cell", "reach").mapInArrow(others, f"id long, vector {kind}, cell long, reach double"), "asking")
        found = found.unionByName(cut(_searched(placed, more, parts, k, size), "found"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.groupBy("query_id", "id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def _searched(placed: DataFrame, asking: DataFrame, parts: dict[int, int], k: int, size: int) -> DataFrame:
    """(query_id, id, score): the k best found of each part of a cell for each query (id, vector, cell, reach) that comes to it."""
    visits = {r["cell"]: r["n"] for r in asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "query_id long, id long, score double"
    visited = [c for c in visits if c in parts]
    if not visited:
        return placed.sparkSession.createDataFrame([], schema)
    n_parts = F.element_at(F.create_map(*[F.lit(x) for c in visited for x in (c, parts[c])]), F.col("cell"))
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for c in visited for x in (c, ceil(visits[c] / BLOCK))]), F.col("cell"))
    draw = F.floor(F.rand(SEED + 1) * (1 << 30))
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    index = placed.where(F.col("cell").isin(visited)).select("id", "vector", "cell", (draw % n_parts).cast("int").alias("part"), n_blocks.alias("n"))
    index = index.withColumn("block", every(F.col("n"))).drop("n")
    queries = asking.where(F.col("cell").isin(visited)).select("id", "vector", "cell", "reach", (draw % n_blocks).cast("int").alias("block"), n_parts.alias("n"))
    queries = queries.withColumn("part", every(F.col("n"))).drop("n")

    def find(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asks):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
        ids, vectors = own["id"].to_numpy(), np.stack(own["vector"].to_numpy()).astype(float)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        points, least, of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        if len(points) >> NUMBERS:
            raise OverflowError(f"a part holds over {1 << NUMBERS} different vectors")
        by_id = np.argsort(least)  # points are numbered by their smallest id
        points, of = points[by_id], np.argsort(by_id)[of.reshape(-1)]
        by_point = np.argsort(of, kind="stable")
        first = np.searchsorted(of[by_point], np.arange(len(points) + 1))
        held = [np.unique(ids[by_point[a:b]])[: k + 1].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        q_ids, wanted = asks["id"].to_numpy().tolist(), np.stack(asks["vector"].to_numpy()).astype(float)
        number = {i: c for c, i in enumerate(sorted({*q_ids}))}  # a point that only one id holds is labelled by it if that asks
        label = np.array([number.get(h[0], -1) if len(h) == 1 else -1 for h in held])
        found, _ = search(unit(points), unit(wanted), k, label, np.array([number[i] for i in q_ids]), asks["reach"].to_numpy())
        points, wanted = scaled_near_one(points), scaled_near_one(wanted)
        norms = np.sqrt((points * points).sum(1))
        out = []
        for i, v, mine in zip(q_ids, wanted, found, strict=True):
            mine = mine[mine >= 0]
            score = (points[mine] * v).sum(1) / (norms[mine] * np.sqrt((v * v).sum()))
            out += [(i, x, s) for p, s in zip(mine.tolist(), score.tolist(), strict=True) for x in held[p] if x != i]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    keys = ("cell", "part", "block")
    return index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(find, schema)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


QUERIES = {"op6_nearest": (op6_nearest, None)}
