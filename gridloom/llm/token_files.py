"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by id. Each task writes two files as it encodes: the ids
of its documents, one after another, and a record per document (id, 64-bit offset of its first id in
the file, flag for a null id). It returns one row: the names and sizes of its files. Prefix sums over these rows, which are as many as partitions, give each
partition's base, and base plus offset is a document's place in the whole. Readers map the files to
memory and see only what they touch.

Ids take 16 bits where the vocabulary has at most 65,536, else 32. A task that runs again writes
under new names; only files in the table of parts count, and that table is written once.

Texts of characters up to U+024F are split by the tokenizer's own pattern and each new pre-token is
encoded by the library; other texts, and texts that hold one of the tokenizer's added tokens (which the
library matches before the pattern), go to the library whole.

The folder is a URI of a file system that Arrow knows; Hadoop's names of S3 are read as such.

Defined results: null text has the end id only; null ids come last; rows that repeat an id come in
the order of their texts' hash; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import Kept, cut, partitions, scratch, table, trimmed
from gridloom.llm.bpe import _low, _low_only

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Pre-tokens of each of two generations kept per worker, and their longest length.
KEPT, KEPT_LENGTH = 300_000, 64
ROWS = 200
#: Documents that a reader returns at once.
READ_DOCS = 500
RECORD = np.dtype([("id", "<i8"), ("start", "<u8"), ("no_id", "u1")])
PARTS = "part int, ids_path string, docs_path string, n_docs long, n_ids long, width int"

#: The characters that stand for bytes in byte-level vocabularies: itself if printable in Latin-1, else the next from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
BYTE_CHARACTERS = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + k) for k, b in enumerate(_HIDDEN)}


class _Pieces(Kept):
    """Pre-token to its ids as little-endian unsigned integers, by the library's model."""

    def __init__(self, definition: bytes):
        super().__init__(KEPT, KEPT_LENGTH)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.tokenize = self.tokenizer.model.tokenize

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def make(self, piece: str) -> bytes:
        return self.packed([t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARACTERS))])

    def encode(self, text: str) -> bytes:
        if _low_only(text) and not any(t in text for t in self.added):
            return b"".join(map(self.__getitem__, _low(text)))
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


_pieces: dict[bytes, _Pieces] = {}


def pieces(definition: bytes) -> _Pieces:
    """The encoder of a tokenizer file, made once in each worker."""
    key = xxhash.xxh128_digest(definition)
    if key not in _pieces:
        _pieces[key] = _Pieces(definition)
    return _pieces[key]


def write_tokens(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Writes the files under folder (a URI that all executors reach); returns the table of parts with base_docs and base_ids."""
    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        definition = f.read()
    width = pieces(definition).width
    end = int(end_id).to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), pieces(definition).encode
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        names = [f"part-{part:06d}-{uuid.uuid4().hex}.{kind}" for kind in ("ids", "docs")]
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{root}/{names[0]}") as ids, fs.open_output_stream(f"{root}/{names[1]}") as docs:
            for batch in trimmed(batches):
                for at in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(at, ROWS)
                    data = [encode(t) + end for t in rows.column(1).to_pylist()]
                    sizes = np.array([len(x) // width for x in data], np.int64)
                    record = np.zeros(len(data), RECORD)
                    record["id"] = rows.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                    record["no_id"] = rows.column(0).is_null().to_numpy(zero_copy_only=False)
                    record["start"] = n_ids + np.cumsum(sizes) - sizes
                    ids.write(b"".join(data))
                    docs.write(record.tobytes())
                    n_docs += len(data)
                    n_ids += int(sizes.sum())
        out = [[part], [f"{folder}/{names[0]}"], [f"{folder}/{names[1]}"], [n_docs], [n_ids], [width]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, _part_types(), strict=True)], PARTS_NAMES
        )

    place = [F.col("id").asc_nulls_last(), F.col("h").asc()]
    parts = (
        df.select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            F.xxhash64(text_col).alias("h"),
        )
        .repartitionByRange(partitions(df.sparkSession), *place)
        .sortWithinPartitions(*place)
        .select("id", "text")
        .mapInArrow(write, PARTS)
        .where("n_docs > 0")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return cut(parts, "parts").withColumns(
        {f"base_{k}": F.coalesce(F.sum(f"n_{k}").over(before), F.lit(0)) for k in ("docs", "ids")}
    )


PARTS_NAMES = [x.split()[0] for x in PARTS.split(", ")]


def _part_types() -> list[pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return [kinds[x.split()[1]] for x in PARTS.split(", ")]


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _opened(uri: str):
    """A file to read at offsets: mapped to memory where it is local."""
    fs, path = _file_system(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return pa.memory_map(path) if os.path.getsize(path) else pa.BufferReader(b"")
    return fs.open_input_file(path)


def read_tokens(parts: DataFrame) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), ids (unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for p in batch.to_pylist():
                yield from _documents(p)

    spread = parts.repartition(max(1, partitions(parts.sparkSession)), "part")
    return spread.mapInArrow(read, "id long, start long, ids binary")


def _documents(p: dict) -> Iterator[pa.RecordBatch]:
    width, size = p["width"], RECORD.itemsize
    ids, docs = _opened(p["ids_path"]), _opened(p["docs_path"])
    for at in range(0, p["n_docs"], READ_DOCS):
        n = min(READ_DOCS, p["n_docs"] - at)
        more = at + n < p["n_docs"]
        record = np.frombuffer(docs.read_at((n + more) * size, at * size), RECORD)
        edges = np.append(record["start"], [] if more else [np.uint64(p["n_ids"])]).astype(np.int64)
        start = int(edges[0])
        flat = np.frombuffer(ids.read_at((int(edges[-1]) - start) * width, start * width), f"<u{width}").astype("<u4")
        own = [flat[a - start : b - start].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        record = record[:n]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(record["id"].astype(np.int64), pa.int64(), mask=record["no_id"].astype(bool)),
                pa.array(edges[:-1] + p["base_ids"], pa.int64()),
                pa.array(own, pa.binary()),
            ],
            ["id", "start", "ids"],
        )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"))
    return read_tokens(parts).select(
        F.col("id").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


QUERIES = {"op7_token_files": (op7_token_files, None)}
