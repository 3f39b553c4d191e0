"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each task takes its rows in blocks: a block's mean, and the singular values and right vectors of its centred
rows, all of them. Two summaries (n, mean, s, V) merge by stacking diag(s1) V1, diag(s2) V2 and one row
sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), and decomposing again: the products of the stacked rows are the centred
scatter of both together, so nothing is lost, and no covariance is ever formed. Summaries of tasks merge
FAN_IN at a time, level by level, over all tasks. The last one, whose size depends on the dimensions only, goes to the driver.

Vectors count as whole numbers, floor(scale * c), so their sums are exact. The fit is over different vectors: rows that share
one are combined before they shuffle. Each row is then projected on the leading components and scaled to variance 1.

Defined results: vectors that are null, hold null or non-finite entries, or have another length than most take no part; a null id is
kept; repeated rows each give rows; components whose variance is rounding error (a constant, fewer vectors than components) give no rows;
an empty table gives no rows; ties of eigenvalues are any basis; sums of squares beyond 64 bits raise an error; other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import cut, discard, table, trimmed

SCALE, COMPONENTS = 256, 4
#: Numbers of a block that is decomposed at once, and summaries that merge at once.
NUMBERS, FAN_IN = 1 << 19, 8
#: A component counts if its singular value is over this share of the first.
LEAST = 1e-10
SUMMARY = "part long, n long, sums array<long>, s array<double>, v array<double>"


@dataclass(frozen=True)
class Summary:
    n: int
    sums: np.ndarray  # exact, whole numbers
    s: np.ndarray
    v: np.ndarray  # (len(s), dimensions)

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def summary_of(block: np.ndarray) -> Summary:
    """block: (rows, dimensions) of whole numbers, one row or more."""
    sums = block.sum(0)
    return Summary(len(block), sums, *_decomposed(block - sums / len(block)))


def merge(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    between = np.sqrt(a.n * (b.n / n)) * (a.mean - b.mean)
    return Summary(n, a.sums + b.sums, *_decomposed(np.concatenate([a.s[:, None] * a.v, b.s[:, None] * b.v, between[None]])))


def _stacked(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _row(part: int, x: Summary) -> dict:
    return {"part": part, "n": x.n, "sums": x.sums.tolist(), "s": x.s.tolist(), "v": x.v.reshape(-1).tolist()}


def fit(vectors: DataFrame, size: int) -> Summary | None:
    """The summary of a table of one column, arrays of size longs; None if it is empty."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, step = None, max(1, NUMBERS // size)
        for batch in trimmed(batches):
            rows = _stacked(batch.column(0), size)
            for a in range(0, len(rows), step):
                own = summary_of(rows[a : a + step])
                whole = own if whole is None else merge(whole, own)
        if whole is not None:
            schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("s", pa.list_(pa.float64())), ("v", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist([_row(TaskContext.get().partitionId(), whole)], schema)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        whole = None
        for r in rows.itertuples():
            own = Summary(r.n, np.asarray(r.sums), np.asarray(r.s), np.asarray(r.v).reshape(-1, size))
            whole = own if whole is None else merge(whole, own)
        return pd.DataFrame([_row(int(rows["part"].iloc[0]) // FAN_IN, whole)])

    level = cut(vectors.mapInArrow(summarise, SUMMARY), "summaries")
    left = level.agg(F.max("part")).first()[0]
    while left:  # parts are numbered from 0, so each level divides their number
        above = cut(level.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(merged, SUMMARY), "summaries")
        discard(level)
        level, left = above, left // FAN_IN
    last = level.first()  # a row of dimensions squared numbers
    if last is None:
        return None
    return Summary(last["n"], np.array(last["sums"], np.int64), np.array(last["s"]), np.array(last["v"]).reshape(-1, size))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, x) of the rows that take part, x as whole numbers; and their length."""
    column = f"`{vector_col}`"
    sizes = df.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    size = most["n"] if most else 1
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * scale))
    return df.where(F.col(column).isNotNull() & (F.size(column) == size) & ~bad).select(F.col(f"`{id_col}`").alias("id"), x.alias("x")), size


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Per row, the sum of (n * x - sums) ** 2, exactly."""
    most = n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    if most * most * x.shape[1] < 2.0**62:
        off = n * x - sums
        return (off * off).sum(1)
    off = n * x.astype(object) - sums.astype(object)
    return np.array((off * off).sum(1), dtype=object).astype(np.int64)  # an OverflowError beyond 64 bits


def _projected(rows: DataFrame, size: int, model: Summary, k: int) -> DataFrame:
    """(id, deviation, w: the first k whitened components)."""
    to = model.v[:k].T / (model.s[:k] / np.sqrt(model.n))
    n, sums, mean = model.n, model.sums, model.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            x = _stacked(batch.column(1), size)
            w = (x - mean) @ to
            flat, ends = pa.array(w.reshape(-1)), pa.array(np.arange(len(w) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviation(x, n, sums), pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["id", "deviation", "w"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, w array<double>")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row per row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows, size = whole_vectors(df, id_col, vector_col, scale)
    different = cut(rows.select("x").distinct(), "vectors")
    model = fit(different, size)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = 0 if model is None else int((model.s[:components] > LEAST * max(model.s[0], 1e-300)).sum())
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    w = [F.col("w")[i] for i in range(k)]
    fitted = _projected(different.select(F.lit(0).alias("id"), "x"), size, model, k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = fitted.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = model.s**2 / (model.s**2).sum()
    out = _projected(rows, size, model, k).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*[F.lit(float(x)) for x in share[:k]]), F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op13_whitening": (op13_whitening, None)}
