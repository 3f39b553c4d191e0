"""Substring dedup: repeated windows of words, by suffix trees over groups of suffixes that share a prefix.

A window is WINDOW consecutive words. Removed is every word that a window covers whose words also
start in a document with a smaller id.

Suffixes: of the GRAM-word sequences inside a window the one of smallest hash, the leftmost of equal
ones, is its anchor; equal windows have it at the same place. The trees are sparse: they hold the
suffixes that begin at an anchor, about one in twenty, each with the words before it that its
windows reach. A segment is such a suffix with its windows; it has 90 words at most. Only segments
whose prefix of GRAM words occurs in two documents go on, about a tenth; equal ones are one leaf
with the smallest and largest of their ids.

Groups: suffixes are partitioned by their prefix. Words under each prefix are counted. A prefix with
more than MEMORY words is lengthened: its windows are dealt to several suffixes by their distance
from the anchor, and windows at distances a to b share WINDOW - (b - a) words, which are the prefix of
the suffix that begins a words before the anchor. The steps in SPANS give prefixes of 10, 37, 46 and
50 words; a prefix of 50 is one window, so equal ones are one leaf by then and no group is larger than MEMORY.
Short groups are packed together.

Trees: a group's suffixes are sorted; the longest common prefixes of neighbours give the internal
nodes. For windows that begin k words before their suffix, those below one node of depth WINDOW - k
or more that also agree in the k words before it have a repeat of WINDOW words or more. The smallest id
of these leaves decides for all; merged over neighbouring windows the repeats are maximal.

Equal word sequences are one document for all of this: a copy with a larger id loses every word.

Defined results: null text has no words; fewer words than a window are kept; repeats inside one
document don't count; a null id ranks behind all others, and rows without id count as one document,
as do rows that repeat an id; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import cut, discard, table, trimmed
from gridloom.llm._words import Words, grams

WINDOW, GRAM = 50, 10
#: By the steps of lengthening: how far apart the windows of one suffix may begin, less one.
SPANS = (WINDOW - GRAM, 13, 4, 0)
#: Words under one prefix, and of the groups that short ones are packed into.
MEMORY = 100_000
#: Bytes of a word in a segment; a longer one is named by its digest.
LONGEST_WORD = 33
DOCS = 200
LAST = (1 << 63) - 1
DIGEST, LEAF = ["d1", "d2"], ["c1", "c2"]
LEAVES = "c1 long, c2 long, prefix long, at int, words int, lowest long, highest long, segment binary"
RUNS = "runs array<struct<low:int,high:int,doc:long>>"
RUN = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("doc", pa.int64())]))


def _digest(data: bytes) -> tuple[int, int]:
    x = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def _short(word: bytes) -> bytes:
    """The word, or a name of LONGEST_WORD bytes that no shorter word has."""
    return word if len(word) < LONGEST_WORD else b"\x00" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def _slide(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimum of each width consecutive values and the place of its leftmost occurrence."""

    def better(a, b, p, q):
        later = b < a
        return np.where(later, b, a), np.where(later, q, p)

    low, place, size = values, np.arange(len(values), dtype=np.int64), 1
    while size * 2 <= width:
        low, place = better(low[:-size], low[size:], place[:-size], place[size:])
        size *= 2
    if size < width:
        k = width - size
        low, place = better(low[:-k], low[k:], place[:-k], place[k:])
    return low, place


def segments_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, text, first and last window start and anchor (words of its text) of each segment."""
    first, h = words.first, words.hashes()
    n = np.diff(first)
    if len(h) < WINDOW:
        return (np.zeros(0, np.int64),) * 5
    low, anchor = _slide(grams(h, GRAM), WINDOW - GRAM + 1)
    text = np.repeat(np.arange(len(n)), n)[: len(low)]
    place = np.arange(len(low)) - first[text]
    whole = place <= n[text] - WINDOW
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) & whole
    at = np.flatnonzero(new)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    size = np.add.reduceat(whole.astype(np.int64), at)
    return low[at].view(np.int64), text[at], place[at], place[at] + size - 1, anchor[at] - first[text[at]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        for a in range(0, batch.num_rows, DOCS):
            part = batch.slice(a, DOCS)
            words = Words(part.column(2).to_pylist())
            h, first = words.hashes(), words.first
            digests = [_digest(h[b:e].tobytes()) for b, e in zip(first[:-1], first[1:], strict=True)]
            prefix, text, low, high, anchor = segments_of(words)
            edges = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(prefix, pa.int64()))]
            lists += [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (low, high, anchor)]
            columns = [pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *columns, pa.array(np.diff(first), pa.int64()), *lists],
                ["doc", "body", *DIGEST, "n", "prefixes", "lows", "highs", "anchors"],
            )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per segment; its words are those from its first window to the end of its last."""
    names = ["d1", "d2", "doc", "low", *LEAF, "prefix", "at", "words", "segment"]
    types = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
    for batch in trimmed(batches):
        for a in range(0, batch.num_rows, DOCS):
            out: list[list] = [[] for _ in names]
            for row in batch.slice(a, DOCS).to_pylist():
                words = list(map(_short, row["text"].encode("utf-8", "replace").split()))
                for run in row["runs"]:
                    own = words[run["low"] : run["high"] + WINDOW]
                    segment, at = b" ".join(own), run["anchor"] - run["low"]
                    leaf = _digest(b"%d %s" % (at, segment))
                    values = (row["d1"], row["d2"], row["doc"], run["low"], *leaf, run["prefix"], at, len(own), segment)
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)


def _longer(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Leaves with longer prefixes: windows whose distances from the anchor fall in one step of span + 1 share a suffix.

    up1 and up2 name the leaf that a row comes from, shift is the place of its first window there.
    """
    names = ["up1", "up2", "shift", "c1", "c2", "prefix", "at", "words", "lowest", "highest", "segment"]
    types = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()]
    for batch in trimmed(batches):
        for a in range(0, batch.num_rows, DOCS):
            out: list[list] = [[] for _ in names]
            for row in batch.slice(a, DOCS).to_pylist():
                words, at = row["segment"].split(b" "), row["at"]
                nearest = at - (len(words) - WINDOW)  # the distance of the last window from the suffix's first word
                for b in range(nearest // (span + 1) * (span + 1), at + 1, span + 1):
                    far, near = min(at, b + span), max(nearest, b)
                    first, last = at - far, at - near
                    own = words[first : last + WINDOW]
                    segment, begin = b" ".join(own), at - b - first
                    prefix = _digest(b" ".join(own[begin : begin + WINDOW - span]))[0]
                    leaf = _digest(b"%d %d %s" % (span, begin, segment))
                    values = (row["c1"], row["c2"], first, *leaf, prefix, begin, len(own), row["lowest"], row["highest"], segment)
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)


class SuffixTree:
    """A tree over rows of words (0 where a row has ended) as sorted rows and the common prefixes of neighbours."""

    def __init__(self, rows: np.ndarray):
        if rows.shape[1]:
            whole = np.ascontiguousarray(rows.astype(">u8")).view(f"V{8 * rows.shape[1]}")[:, 0]
            self.order = np.argsort(whole, kind="stable")
        else:
            self.order = np.arange(len(rows))
        ordered = rows[self.order]
        differ = np.ones((max(len(rows) - 1, 0), rows.shape[1] + 1), bool)
        differ[:, :-1] = ordered[1:] != ordered[:-1]
        self.common = differ.argmax(1)

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the number of the shallowest node of that depth or more above it; ended rows have no meaning."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.append(0, np.cumsum(self.common < depth))[: len(out)]
        return out


def repeats(segments: list[bytes], at: np.ndarray, size: np.ndarray, span: int, lowest: np.ndarray) -> np.ndarray:
    """(segments, span + 1): for the window k words before the suffix the smallest id of the leaves that have it, -1 where there's none."""
    n, first = len(segments), np.cumsum(size) - size
    words = np.append(Words(segments).hashes() | np.uint64(1), np.uint64(0))
    rest = size - at
    steps = np.arange(WINDOW)
    after = words[np.where(steps < np.minimum(rest, WINDOW)[:, None], (first + at)[:, None] + steps, len(words) - 1)]
    steps = np.arange(1, span + 1)
    before = words[np.where(steps <= at[:, None], (first + at)[:, None] - steps, len(words) - 1)]
    suffixes, contexts = SuffixTree(after), SuffixTree(before)
    out = np.full((n, span + 1), -1, np.int64)
    for k in range(span + 1):
        own = np.flatnonzero((at >= k) & (rest >= WINDOW - k))
        if not len(own):
            continue
        node = suffixes.nodes(WINDOW - k)[own] * (n + 1) + contexts.nodes(k)[own]
        _, node = np.unique(node, return_inverse=True)
        least = np.full(node.max() + 1, LAST)
        np.minimum.at(least, node, lowest[own])
        out[own, k] = least[node]
    return out


def _tree(rows: pa.Table, span: int) -> pa.RecordBatch:
    """The leaves of a group with, by runs of their windows, the smallest id that has the window, if below their largest."""
    at, size = (rows.column(c).to_numpy().astype(np.int64) for c in ("at", "words"))
    lowest, highest = (rows.column(c).to_numpy() for c in ("lowest", "highest"))
    windows = size - WINDOW + 1
    of = np.repeat(np.arange(len(size)), windows)
    place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = repeats(rows.column("segment").to_pylist(), at, size, span, lowest)[of, at[of] - place]
    hit = found < highest[of]
    change = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    begin = np.flatnonzero(hit & np.append(True, change | ~hit[:-1]))
    end = np.flatnonzero(hit & np.append(change | ~hit[1:], True))
    edges = np.searchsorted(of[begin], np.arange(len(size) + 1))
    fields = [pa.array(place[begin], pa.int32()), pa.array(place[end], pa.int32()), pa.array(found[begin], pa.int64())]
    runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, ["low", "high", "doc"]))
    leaves = [pa.array(rows.column(c).to_numpy(), pa.int64()) for c in LEAF]
    return pa.RecordBatch.from_arrays([*leaves, runs.cast(RUN)], [*LEAF, "runs"]).filter(pa.array(np.diff(edges) > 0))


def _trees(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by prefix; a group ends at a change of prefix once it has MEMORY words."""
    held: list[pa.RecordBatch] = []
    words, last = 0, None
    for batch in trimmed(batches):
        if not batch.num_rows:
            continue
        prefix, counts = batch.column("prefix").to_numpy(), np.append(0, np.cumsum(batch.column("words").to_numpy(), dtype=np.int64))
        begin = 0
        for at in np.flatnonzero(np.append(prefix[0] != last, prefix[1:] != prefix[:-1])).tolist():
            if words + counts[at] - counts[begin] >= MEMORY:
                held.append(batch.slice(begin, at - begin))
                yield _tree(pa.Table.from_batches(held), span)
                held, words, begin = [], 0, at
        held.append(batch.slice(begin))
        words += int(counts[-1] - counts[begin])
        last = prefix[-1]
    if words:
        yield _tree(pa.Table.from_batches(held), span)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        for a in range(0, batch.num_rows, DOCS):
            part = batch.slice(a, DOCS)
            counts, removed, texts = [], [], []
            for text, copy, spans in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                rest, at = [], 0
                for span in [{"low": 0, "high": len(words) - 1}] if copy else spans or []:
                    rest += words[at : span["low"]]
                    at = span["high"] + 1
                rest += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(rest))
                texts.append(b" ".join(rest).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the kept words, joined by one space)."""
    docs = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("body"),
    )
    scanned = cut(
        docs.select("doc", "body", "text").mapInArrow(
            _scan,
            "doc long, body long, d1 long, d2 long, n long, "
            "prefixes array<long>, lows array<int>, highs array<int>, anchors array<int>",
        ),
        "scanned",
    )
    classes = cut(
        scanned.where(f"n >= {WINDOW}")
        .groupBy(*DIGEST)
        .agg(F.min(F.struct("doc", "body", "prefixes", "lows", "highs", "anchors")).alias("one"))
        .select(*DIGEST, "one.*"),
        "classes",
    )
    whole = cut(
        scanned.where(f"n >= {WINDOW}")
        .select("doc", "body", *DIGEST)
        .distinct()
        .join(classes.select(*DIGEST, F.col("doc").alias("owner")), DIGEST)
        .select("doc", "body", *DIGEST, (F.col("doc") > F.col("owner")).alias("copy")),
        "whole",
    )
    discard(scanned)
    spans = _spans(docs, classes)
    state = whole.join(spans, DIGEST, "left").where("copy or spans is not null").select("doc", "body", "copy", "spans")
    return (
        docs.join(state, ["doc", "body"], "left")
        .select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
        .mapInArrow(_kept, "id long, n_words long, n_removed long, kept string")
    )


def _spans(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(d1, d2, spans): merged intervals of the words to remove from the first document of a class. Tables that no later step reads, classes too, are deleted."""
    lists = [F.col(c).alias(one) for c, one in (("prefixes", "prefix"), ("lows", "low"), ("highs", "high"), ("anchors", "anchor"))]
    anchors = classes.select("doc", "body", *DIGEST, F.explode(F.arrays_zip(*lists)).alias("r")).select("doc", "body", *DIGEST, "r.*")
    twice = anchors.groupBy("prefix").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("prefix")
    twice = cut(twice, "twice")  # read from a table, the join below has two plain shuffles, and adaptive execution splits a prefix of very many segments
    runs = (
        anchors.join(twice, "prefix")
        .groupBy("doc", "body", *DIGEST)
        .agg(F.sort_array(F.collect_list(F.struct("low", "high", "anchor", "prefix"))).alias("runs"))
    )
    texts = docs.select("doc", "body", "text").dropDuplicates(["doc", "body"])
    suspects = cut(runs.join(texts, ["doc", "body"]).select(*DIGEST, "doc", "text", "runs"), "suspects")
    discard(classes, twice)
    segments = suspects.mapInArrow(
        _segments, "d1 long, d2 long, doc long, low int, c1 long, c2 long, prefix long, at int, words int, segment binary"
    )
    leaves = segments.withColumns({"lowest": F.col("doc"), "highest": F.col("doc")})
    leaves = cut(_combined(leaves), "leaves")
    found = cut(_repeated(leaves, 0), "found")
    discard(leaves)
    ends = segments.select(*DIGEST, "doc", "low", *LEAF).join(found, LEAF).select(*DIGEST, "doc", "low", F.explode("runs").alias("r"))
    covered = ends.where("r.doc < doc").select(
        *DIGEST, (F.col("low") + F.col("r.low")).alias("from"), (F.col("low") + F.col("r.high") + WINDOW - 1).alias("to")
    )
    order = Window.partitionBy(*DIGEST).orderBy("from", "to")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        covered.withColumn("apart", F.coalesce(F.col("from") > reach + 1, F.lit(True)))
        .withColumn("island", F.count_if("apart").over(order))
        .groupBy(*DIGEST, "island")
        .agg(F.min("from").alias("low"), F.max("to").alias("high"))
        .groupBy(*DIGEST)
        .agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))
    )


def _combined(leaves: DataFrame) -> DataFrame:
    """Equal leaves as one, where they are read and again after the shuffle."""
    rest = [F.any_value(c).alias(c) for c in ("prefix", "at", "words", "segment")]
    return leaves.groupBy(*LEAF).agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), *rest)


def _repeated(leaves: DataFrame, step: int) -> DataFrame:
    """(c1, c2, runs) of the leaves that have a window of a smaller id; prefixes over MEMORY are lengthened to the next step."""
    leaves = leaves.select(*[x.split()[0] for x in LEAVES.split(", ")])
    large = None
    if step + 1 < len(SPANS):
        large = cut(leaves.groupBy("prefix").agg(F.sum("words").alias("n")).where(F.col("n") > MEMORY).select("prefix"), "large")
        large = large if large.limit(1).count() else None
    rest = leaves.join(large, "prefix", "left_anti") if large else leaves
    trees = rest.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(
        lambda batches, span=SPANS[step]: _trees(batches, span), f"c1 long, c2 long, {RUNS}"
    )
    if not large:
        return trees
    span = SPANS[step + 1]
    longer = leaves.join(large, "prefix", "left_semi").mapInArrow(
        lambda batches: _longer(batches, span), f"up1 long, up2 long, shift int, {LEAVES}"
    )
    longer = cut(longer, "longer")
    below = cut(_repeated(cut(_combined(longer), "leaves"), step + 1), "found")
    moved = F.transform("runs", lambda r: F.struct((r["low"] + F.col("shift")).alias("low"), (r["high"] + F.col("shift")).alias("high"), r["doc"].alias("doc")))
    up = longer.select("up1", "up2", "shift", *LEAF).join(below, LEAF).withColumn("runs", moved)
    back = up.groupBy(F.col("up1").alias("c1"), F.col("up2").alias("c2")).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return trees.unionByName(back)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
win AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM w WHERE len(words) >= 50)
), later AS (
  SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lowest FROM win) WHERE lowest < doc_id
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), marked AS (
  SELECT e.doc_id, e.word, e.i, l.pos IS NOT NULL AND e.i < l.pos + 50 AS gone
  FROM each e ASOF LEFT JOIN later l ON e.doc_id = l.doc_id AND e.i >= l.pos
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
QUERIES = {"op5_substring_dedup": (op5_substring_dedup, SQL)}
