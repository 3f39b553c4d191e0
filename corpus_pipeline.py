"""A training-corpus pipeline over ``documents``; each stage's rows are written and read again for the next.

Stages and their rules: documents without a letter, or whose most common language has less than half
of the letters, go; repeated three-line windows go; one document of each near-duplicate group
(sets of five-word shingles whose similarity is 0.8 or more) stays;
documents are repeated or left out so that sources meet their targets; texts are encoded.
A document that loses all its lines stays, as an empty text, until mixing, which takes no words of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, language_id, line_dedup, mixing, near_dup
from gridloom.llm._shared import cut, hashable, row_of, table

LEAST_SCORE = 0.5
#: Of the Jaccard similarity from which documents are near-duplicates; op10's own contract has another.
NEAR_PERCENT = 80


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no column clashes with an operator's results."""
    return docs.select("doc_id", "text", row_of(docs, "text"))


def _with_text(docs: DataFrame, packed: DataFrame, **changed) -> DataFrame:
    """The columns of docs from packed rows, some replaced."""
    changed = {"text": F.col("text")} | changed
    return packed.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of one language, named in lang; the model learns from all labelled documents' bounded sample.

    Null and empty texts and texts without a letter go; languages of equal score go by code point; repeated
    rows and null ids are rows like others; without labelled rows, or of an empty table, nothing stays.
    """
    found = language_id.identify(_packed(docs), language_id.learn(docs))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _with_text(docs, kept, lang=F.col("lang_pred"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later occurrences of three lines; nulls, ties and repeats as in line_dedup."""
    kept = line_dedup.dedup_lines(_packed(docs))
    return _with_text(docs, kept, n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of smallest id.

    Rows that repeat an id are one document; of them the row with the smallest hashes stays (text first, then all
    columns), so reruns agree. Rows without id all stay, null and wordless texts too.
    """
    kept = near_dup.near_duplicates(docs, percent=NEAR_PERCENT).where("kept and id is not null").select(F.col("id").alias("doc_id")).distinct()
    first = F.min_by(row_of(docs), F.struct(F.xxhash64("text"), F.xxhash64(*hashable(docs))))
    single = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row"))
    return single.select("row.*").unionByName(docs.where("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; ids may be null or repeat, each row is drawn by itself.

    Rows of size 0 (null, empty or blank texts) are taken as their source's repetitions say; ties, a null source and
    an empty table as in mix_sources.
    """
    taken = mixing.mix_sources(docs, carry=True).where("reps > 0")
    copies = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "reps")))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row, with its token ids and their digests.

    A null or empty text has no ids; very long texts are encoded whole; ties can't occur; repeated rows, and rows without id, each give
    a row; an empty table gives none; columns beside doc_id and text aren't read.
    """
    return bpe.digests(bpe.bpe_encode(docs, decoded=True), "ids")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
