"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the pattern of the rank files. First tier: a minimal perfect hash (hash and
displace; as many slots as keys) finds a whole pre-token that is in the vocabulary with one probe and
one comparison. Second tier, for misses: bytes are linked both ways, a heap holds the rank of each
neighbouring pair, and the lowest rank, leftmost first, is merged until no pair has a rank.

What a pre-token encodes to is kept in tables of bounded size per worker, from which the rare ones drop out.
The rank file is read on the driver and sent along; its size is that of the vocabulary.

Defined results: null text encodes as the empty text, to no ids; a text without spaces of any length
takes n log n steps; every row gives a row, repeated or null ids included; an empty table gives no
rows; other columns are unread.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import Kept, table, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens of each of two generations kept per worker, and their longest length.
KEPT, KEPT_LENGTH = 300_000, 64
#: Rows handled and returned at once.
ROWS = 200
MASK = (1 << 64) - 1

#: Letters, numbers and white space up to U+024F, for texts without higher characters: Python's re is faster there.
LOW = "ɏ"
LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
SPACE = "\\t-\\r \\x85\\xa0"
LOW_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
_low_only = re.compile("[\\x00-\\u024f]*").fullmatch
_low = re.compile(LOW_PATTERN).findall
_any = regex.compile(public_tokenizers.PATTERN).findall


def pretokens(text: str) -> list[str]:
    """The matches of public_tokenizers.PATTERN."""
    return _low(text) if _low_only(text) else _any(text)


class MinimalPerfectHash:
    """Maps each of n distinct keys to a slot of its own among n; a key's bucket holds its displacement."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) < self.n:
            raise ValueError("two keys have one hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate([[0], np.cumsum(sizes)])
        hashed = hashes.tolist()
        taken, self.displace, slots = bytearray(self.n), [0] * self.buckets, [0] * self.n
        free = 0
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[first[b] : first[b + 1]].tolist()
            if not own:
                break
            if len(own) == 1:  # a single key takes the next free slot, written as a negative number
                while taken[free]:
                    free += 1
                places = [free]
                self.displace[b] = -1 - free
            else:
                d = 0
                while True:
                    places = [self._place(hashed[k], d) for k in own]
                    if len(set(places)) == len(own) and not any(taken[p] for p in places):
                        break
                    d += 1
                self.displace[b] = d
            for k, p in zip(own, places, strict=True):
                taken[p] = 1
                slots[k] = p
        self.slots = slots

    def _place(self, h: int, d: int) -> int:
        return ((((h + d * 0x9E3779B97F4A7C15) & MASK) * 0xBF58476D1CE4E5B9 & MASK) >> 29) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key; any slot for other bytes, so the caller compares."""
        h = xxhash.xxh64_intdigest(key)
        d = self.displace[h % self.buckets]
        return -1 - d if d < 0 else self._place(h, d)


class Encoder(Kept):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, rank_file: bytes):
        super().__init__(KEPT, KEPT_LENGTH)
        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        keys = list(self.ranks)
        self.hash = MinimalPerfectHash(keys)
        self.held: list[bytes] = [b""] * len(keys)
        self.ids: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.hash.slots, strict=True):
            self.held[slot] = key
            self.ids[slot] = self.ranks[key].to_bytes(4, "little")
        self.bytes_of = {i: k for k, i in self.ranks.items()}

    def make(self, token: str) -> bytes:
        piece = token.encode()
        slot = self.hash.slot(piece)
        return self.ids[slot] if self.held[slot] == piece else self.merged(piece)

    def merged(self, piece: bytes) -> bytes:
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the neighbouring parts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != end:  # one of the two parts has changed since
                continue
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join([self[t] for t in pretokens(text)]) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[bytes, Encoder] = {}


def encoder(rank_file: bytes) -> Encoder:
    """The encoder of a rank file, built once in each worker."""
    key = xxhash.xxh128_digest(rank_file)
    if key not in _encoders:
        _encoders[key] = Encoder(rank_file)
    return _encoders[key]


def read_ranks(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def bpe_encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False
) -> DataFrame:
    """One row per input row: id, ids (little-endian unsigned 32-bit); with decoded, also the bytes that the ids decode to."""
    rank_file = read_ranks(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(rank_file)
        for batch in trimmed(batches):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                out = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    out.append(pa.array([e.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][: len(out)])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, ids binary" + ", decoded binary" * decoded)


def bpe_decode(df: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per input row: id, the decoded bytes; null ids decode to no bytes."""
    rank_file = read_ranks(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(rank_file)
        for batch in trimmed(batches):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = pa.array([e.decode(x or b"") for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["id", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decode, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_encode(table(spark, sf_dir, "documents"), decoded=True))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """The number of ids and digests of both sides, with more columns if named."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


QUERIES = {"op4_bpe": (op4_bpe, None)}
