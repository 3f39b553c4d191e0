"""Near-duplicates by SetSketch registers.

A document's set is its distinct word shingles. Register i of its sketch is the minimum over the set
of an exponentially distributed hash, truncated to exponentially spaced values (base BASE), so the
sketch of a union is the register-wise extreme of the sketches. Documents that agree in all
registers of a band are candidates. For a candidate pair the numbers of registers in which one side
is above, the other is above, or both agree give the similarity by maximum likelihood, jointly with
the known set sizes; pairs far below the threshold are left out and all others are verified on the
full sets.

Work that grows with the square of a group's size is avoided in steps, none of which loses a link beyond those chances:
* Documents with one set are one class; only its smallest id is compared.
* In each band bucket, members are first compared with one pivot: the member with the most company
  over all its buckets, which for copies that were altered is the text they come from.
* Buckets that still hold more than one component are compared with another pivot each.
* What is left, pairs from different components in a bucket, is compared pair by pair, if bitmaps of
  the two sets leave it possible that they reach the threshold. Members of a bucket are dealt to blocks
  of about BUCKET and each pair of blocks is a key of its own, so no task holds a large bucket.
A set is shipped with a pair only after size and likelihood passed, that is to sets of about its size.
Linked documents form components by alternating stars.

With 32 bands of 4 registers a pair at similarity 0.85 shares no band with probability 6e-11, one at
0.8 with 5e-8. The likelihood filter loses a pair of equal sizes with about 2.8e-6 and 1.4e-6 (registers
that agree taken as binomial, ERRORS below the threshold); together these are the chances to miss a pair.
The full sets are sets of 64-bit hashes of shingles.

Defined results: null or wordless text has an empty set and links with nothing; fewer words than a
shingle are one shingle; a null id links with nothing and has a null component; rows that repeat an
id are one document; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._graph import components
from gridloom.llm._shared import cut, discard, table, trimmed
from gridloom.llm._words import Words, grams, mix

SHINGLE = 5
#: The threshold of op10; other callers give their own.
PERCENT = 85
BANDS, ROWS_PER_BAND = 32, 4
REGISTERS = BANDS * ROWS_PER_BAND
#: Rate of the exponential hash, ratio of neighbouring register values, and the largest register.
RATE, BASE, LARGEST = 20.0, 1.001, (1 << 16) - 1
#: Bits of the bitmap of a set's hashes, by which pairs are left out exactly.
BITS = 1024
#: Members of a bucket that one task compares with as many others.
BUCKET = 300
#: Estimates this many standard errors below the threshold are not verified.
ERRORS = 5.0
DOCS = 200
_TURN = np.random.default_rng(21).integers(1, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(22).integers(1, 1 << 63, (BANDS, ROWS_PER_BAND), np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts, and where each text's begin (with the end appended)."""
    words = Words(texts, lower=True)
    h, first = words.hashes(), words.first
    n = np.diff(first)
    every = grams(h, size)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    begin = np.append(0, np.cumsum(count))
    out = np.empty(begin[-1], np.uint64)
    long = np.flatnonzero(n >= size)
    m = count[long]
    step = _ranges(m)
    out[np.repeat(begin[long], m) + step] = every[np.repeat(first[long], m) + step]
    for d in np.flatnonzero((n > 0) & (n < size)).tolist():
        own = h[first[d] : first[d + 1]]
        out[begin[d]] = grams(own, len(own))[0] ^ np.uint64(len(own))
    return out, begin


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to s - 1 for each s of sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def registers(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) of unsigned 16 bits; texts have a shingle at least."""
    low = np.empty((len(begin) - 1, REGISTERS), np.uint64)
    turned = np.empty_like(shingles)
    for i in range(REGISTERS):
        np.multiply(shingles, _TURN[i], out=turned)
        low[:, i] = np.minimum.reduceat(turned, begin[:-1])
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        for a in range(0, batch.num_rows, DOCS):
            part = batch.slice(a, DOCS)
            shingles, begin = shingle_sets(part.column(1).to_pylist(), SHINGLE)
            n, d1, d2 = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            bits: list = [None] * part.num_rows
            full = np.flatnonzero(np.diff(begin))
            for d in full.tolist():
                own = np.unique(shingles[begin[d] : begin[d + 1]])
                n[d] = len(own)
                mark = np.zeros(BITS, np.uint8)
                mark[own % np.uint64(BITS)] = 1
                bits[d] = np.packbits(mark).view(np.int64)
                d1[d], d2[d] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
            kept = np.append(begin[full], begin[-1])
            found = registers(shingles, kept) if len(full) else np.zeros((0, REGISTERS), np.uint16)
            keys = np.empty((len(full), BANDS), np.int64)
            for b in range(BANDS):
                own = found[:, b * ROWS_PER_BAND : (b + 1) * ROWS_PER_BAND].astype(np.uint64) + np.uint64(1)
                keys[:, b] = mix((own * _BAND[b]).sum(1, dtype=np.uint64)).view(np.int64)
            regs: list = [None] * part.num_rows
            bands: list = [None] * part.num_rows
            for k, d in enumerate(full.tolist()):
                regs[d], bands[d] = found[k].tobytes(), keys[k]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *map(pa.array, (n, d1, d2)), pa.array(regs, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (bits, bands))],
                ["id", "n", "d1", "d2", "regs", "bits", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        for a in range(0, batch.num_rows, DOCS):
            part = batch.slice(a, DOCS)
            shingles, begin = shingle_sets(part.column(1).to_pylist(), SHINGLE)
            own = [np.unique(shingles[b:e]).tobytes() for b, e in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["node", "set"])


def estimate(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Similarity of each pair of register rows by maximum likelihood over a grid, given the set sizes."""
    above, below = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    same = x.shape[1] - above - below
    u, v = (n_x / (n_x + n_y))[:, None], (n_y / (n_x + n_y))[:, None]
    most = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, steps + 1)[None, :] * most

    def p(z: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-z * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    p_above, p_below = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
    p_same = np.maximum(1 - p_above - p_below, 1e-12)
    chance = above * np.log(p_above) + below * np.log(p_below) + same * np.log(p_same)
    return np.take_along_axis(j, chance.argmax(1)[:, None], 1)[:, 0]


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    t = percent / 100
    least = t - ERRORS * np.sqrt(t * (1 - t) / REGISTERS)
    for batch in trimmed(batches):
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
            n_x, n_y = (part.column(k).to_numpy() for k in (4, 5))
            near = 100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)
            near[near] = estimate(x[near], y[near], n_x[near], n_y[near]) >= least
            yield part.select(["a", "b"]).filter(pa.array(near))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(both) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _pairs_of(df: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of other's rows for a and for b."""
    for side in ("a", "b"):
        own = other.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        df = df.join(own, side)
    return df.select("a", "b", *[f"{c}_{s}" for c in columns for s in ("a", "b")])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept (id is component_id).

    Documents whose sets have a Jaccard similarity of percent / 100 or more are linked.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = cut(
        docs.mapInArrow(_sketches, "id long, n long, d1 long, d2 long, regs binary, bits array<long>, bands array<long>"), "sketched"
    )
    classes = cut(
        sketched.where("n > 0 and id is not null")
        .groupBy("d1", "d2")
        .agg(F.min("id").alias("node"), *[F.any_value(c).alias(c) for c in ("n", "regs", "bits", "bands")]),
        "classes",
    )
    found = components(_links(docs, classes, percent))
    same = sketched.join(classes.select("d1", "d2", "node"), ["d1", "d2"], "left")
    one = same.where("id is not null").groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    if one.where("low <> high").limit(1).count():  # an id that repeats with other texts ties its classes
        ties = one.where("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b"))
        found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(ties))
    return (
        same.join(found, "node", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")))
        .select("id", F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
    )


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between classes that connect all that are linked."""
    exploded = classes.select("node", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(shared, "shared")
    members = cut(exploded.join(shared, "key").select("key", "node", "size"), "members")
    compared = members.select("node").distinct()
    sets = cut(
        docs.join(compared.withColumnRenamed("node", "id"), "id", "left_semi").mapInArrow(_sets, "node long, set binary"),
        "sets",
    )
    sketches = cut(classes.join(compared, "node", "left_semi").select("node", "regs", "n", "bits", "bands"), "compared")

    def tested(pairs: DataFrame) -> DataFrame:
        likely = _pairs_of(pairs, sketches, "regs", "n").mapInArrow(lambda b: _likely(b, percent), "a long, b long")
        return cut(_pairs_of(likely, sets, "set").mapInArrow(lambda b: _verified(b, percent), "a long, b long"), "links")

    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    alone = members.join(company, "node").withColumn("component", F.col("node"))
    links = tested(_with_pivots(alone, F.struct("company", "node")))
    for last in (False, True):
        found = components(links)
        rest = _apart(members, found)
        if not rest.limit(1).count():
            break
        pairs = _one_by_one(rest, sketches, percent) if last else _with_pivots(rest, F.xxhash64("node"))
        links = links.unionByName(tested(pairs))
    discard(members, sets, sketches)
    return links


def _with_pivots(members: DataFrame, rank: Column) -> DataFrame:
    """Each member with its bucket's pivot, the member of largest rank; pairs of one component are left out."""
    pivot = F.max_by("node", rank).alias("pivot")
    owner = F.max_by("component", rank).alias("owner")
    pivots = cut(members.groupBy("key").agg(pivot, owner), "pivots")
    return (
        members.join(pivots, "key")
        .where("component <> owner")
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets of three or more that hold more than one component (a bucket of two has been compared)."""
    own = (
        members.where("size > 2")
        .join(found, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("component"))
    )
    mixed = (
        own.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("left"))
        .where("x <> y")
    )
    return cut(own.join(cut(mixed.select("key", "left"), "mixed"), "key"), "apart")


def _one_by_one(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of one bucket that are in different components and can reach the threshold.

    A bit that only one side has stands for a shingle, at least, that only that side has: this bounds
    what the two share from above. A pair is made in one of the buckets it shares, the one of smallest
    key; if that bucket isn't among those left it held this pair alone and has been compared.
    """
    columns = ("key", "node", "component", "n", "bits", "bands", "low", "high")
    blocks = F.ceil(F.col("left") / BUCKET)
    dealt = (
        members.join(sketches.select("node", "n", "bits", "bands"), "node")
        .withColumn("last", blocks.cast("int") - 1)
        .withColumn("own", F.pmod(F.xxhash64(F.lit(4), "node"), blocks).cast("int"))
    )
    one = dealt.withColumn("low", F.col("own")).withColumn("high", F.explode(F.sequence("own", "last"))).select(*columns)
    other = dealt.withColumn("high", F.col("own")).withColumn("low", F.explode(F.sequence(F.lit(0), "own")))
    other = other.select(*[F.col(c).alias(f"{c}_b") for c in columns])

    def only(x: str, y: str) -> Column:
        return reduce(add, [F.bit_count(F.col(x)[k].bitwiseAND(F.bitwise_not(F.col(y)[k]))) for k in range(BITS // 64)])

    most = F.least(F.col("n") - only("bits", "bits_b"), F.col("n_b") - only("bits_b", "bits"))
    once = (F.col("low") < F.col("high")) | (F.col("node") < F.col("node_b"))
    apart = once & (F.col("component") != F.col("component_b"))
    sizes = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    can = sizes & ((100 + percent) * most >= percent * (F.col("n") + F.col("n_b")))
    here = F.array_min(F.array_intersect("bands", "bands_b")) == F.col("key")
    same = reduce(and_, [F.col(c) == F.col(f"{c}_b") for c in ("key", "low", "high")])
    return one.join(other, same & apart & can & here).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_near_dup": (op10_near_dup, None)}
