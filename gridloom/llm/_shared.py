"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a local master (one machine, as in tests) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, apart for each application and call."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later jobs neither recompute it nor depend on executors that made it.

    An aggregate that is cut before it is joined to its own rows leaves the join two plain shuffles, of which
    adaptive execution can split one at a key with very many rows.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these, once nothing that is still to run reads it."""
    for df in tables:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; between them, memory that Arrow holds but doesn't use goes back to the system."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


class Kept(dict):
    """What make() gives for a key, remembered for the keys that came last.

    There are two generations of at most ``most`` keys: when the younger is full it becomes the older, whose
    keys come back when they are asked for again. So common keys stay, and memory is bounded. Keys longer than ``longest`` aren't kept.
    """

    def __init__(self, most: int, longest: int):
        super().__init__()
        self.most, self.longest, self.older = most, longest, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashable(df: DataFrame) -> list[Column]:
    """The columns that a hash can cover: all but those that hold maps."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def row_of(df: DataFrame, *but: str) -> Column:
    """The columns as one struct, named row, so that none clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in but]).alias("row")


def strip_spaces(text: Column) -> Column:
    """Text without any character of SPACES; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
