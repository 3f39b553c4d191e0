"""Language identification of spans: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters and their marks (Unicode classes L and M beyond ASCII). The scripts of its
characters (ranges of code points) leave the languages whose training words use them as candidates. Each candidate scores the word by the log
probabilities of its byte trigrams, bounded below so that no word decides alone. Viterbi over the
words of a document, with a penalty for each change of language, labels spans. The document's
language is the one whose spans hold the most letters; its score is their share.

Learning counts trigrams per language over a bounded sample: about PER_LANG different documents of each
language (MOST at most), chosen by a hash of id and text, so neither null nor repeated ids decide together; rows alike in both count once, and
each language has its row of least hash at least. The counts are summed by language and trigram class before
they reach the driver; their number is bounded by languages times 64^3, and languages by MAX_LANGS (more raise an error).

Viterbi runs over all documents of a batch at once, word by word, longest first, so its work is the
number of words and its Python steps are as many as the longest text of the batch has words.

Defined results: null text, and text without a letter, gives ``und``, score 0 and no spans; words in
a script that no learned language uses are scored by all languages; without labelled rows all is
``und``; equal scores go to the language first in code point order; repeated rows each give a row;
an empty table gives no rows; other columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm._shared import table, trimmed

#: Sampled training documents of each language, about and at most.
PER_LANG, MOST = 1800, 3600
#: Languages whose model fits a worker: 1 MB each.
MAX_LANGS = 200
#: Cost of changing the language between two words, and the lowest score of a word below the best language's.
SWITCH, LOWEST = 6.0, -8.0
UNKNOWN = "und"
#: A language uses a script if so large a share of its training words does.
LEAST_SHARE = 0.001
#: Documents that Viterbi takes together, documents whose words are scored together, and words at once.
ROWS, SCORED, WORDS = 2000, 100, 100_000
RESULTS = "lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>"

CLASSES = 64
#: Byte to class: 0 no letter, 1 to 26 a to z, the others for bytes of longer characters.
CLASS = np.zeros(256, np.uint32)
CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
CLASS[128:] = 27 + np.arange(128) * 7 % (CLASSES - 27)

#: Script ranges as first and last code points; the place in the list is the bit. Other letters stand for any script.
SCRIPTS = [
    ("latin", [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("other indic", [(0x980, 0xDFF)]),
    ("thai and lao", [(0xE00, 0xEFF)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("ethiopic", [(0x1200, 0x139F)]),
    ("kana", [(0x3040, 0x30FF)]),
    ("han", [(0x3400, 0x9FFF), (0x20000, 0x2FFFF)]),
    ("hangul", [(0x1100, 0x11FF), (0xAC00, 0xD7AF)]),
]


def _scripts_by_bytes() -> np.ndarray:
    """Script bits by the first two bytes of a character: 64 code points or fewer in two and three bytes, 4096 in four."""
    out = np.zeros(1 << 16, np.uint16)
    for bit, (_, ranges) in enumerate(SCRIPTS):
        for low, high in ranges:
            for point in range(low, high + 1):
                two = (chr(point).encode() + b" ")[:2]
                if point < 0x80:
                    out[two[0] << 8 : (two[0] + 1) << 8] |= 1 << bit
                else:
                    out[two[0] << 8 | two[1]] |= 1 << bit
    return out


SCRIPT = _scripts_by_bytes()
_no_letters = regex.compile(r"[^\x00-\x7f\p{L}\p{M}]").sub
_ascii_letter = re.compile("[a-z]").search


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_p: np.ndarray  # (CLASSES ** 3, languages), float32
    scripts: np.ndarray  # bits by language


def _lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts with a space around each; where each starts; whether each has a letter."""
    low = [t.lower() if t else "" for t in texts]
    low = [t if t.isascii() else _no_letters(" ", t) for t in low]
    has = np.array([bool(_ascii_letter(t)) or any(map(str.isalpha, t)) for t in low], bool)
    data = [t.encode("utf-8", "replace") for t in low]
    starts = np.cumsum([1] + [len(x) + 1 for x in data])
    return np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8), starts[:-1], has


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram classes of all letter bytes, and where among these each word begins (with the end appended); the places of letter bytes."""
    kind = CLASS[data]
    code = (kind[:-2] << 12) | (kind[1:-1] << 6) | kind[2:]
    letter = kind > 0
    at = np.flatnonzero(letter)
    begins = np.flatnonzero(~letter[at - 1])
    return code[at - 1], np.append(begins, len(at)), at


def _scripts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return SCRIPT[data[at].astype(np.uint16) << 8 | data[at + 1]]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram log probabilities by language from a sample of the rows with text and language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(F.lit(3), id_col, text_col)
    draw = F.pmod(h, F.lit(1 << 20))
    found = rows.groupBy(lang_col).agg(F.approx_count_distinct(h).alias("n"), F.min(draw).alias("least")).limit(MAX_LANGS + 1).collect()
    counts = {r[0]: (r["n"], r["least"]) for r in found}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((CLASSES**3, 0), np.float32), np.zeros(0, np.uint16))
    shares = [x for k, (n, least) in counts.items() for x in (F.lit(k), F.lit(max(least + 1, int(min(1.0, PER_LANG / n) * (1 << 20)))))]
    share = F.element_at(F.create_map(*shares), F.col(lang_col))
    drawn = rows.where(draw < share).groupBy(F.col(lang_col).alias("lang"), h.alias("h")).agg(F.any_value(text_col).alias("text"))
    first = Window.partitionBy("lang").orderBy("h")
    sample = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= MOST).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            own = batch.column(0).to_numpy(zero_copy_only=False)
            texts = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(own)):
                data, _, _ = _lowered(list(texts[own == lang]))
                codes, begins, at = _words(data)
                if not len(codes):
                    continue
                tri, n = np.unique(codes, return_counts=True)
                used, m = np.unique(np.bitwise_or.reduceat(_scripts(data, at), begins[:-1]), return_counts=True)
                keys = np.concatenate([tri.astype(np.int64), -1 - used.astype(np.int64)])
                sums = np.concatenate([n, m]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys), pa.array(sums)], ["lang", "code", "n"]
                )

    place = {lang: k for k, lang in enumerate(langs)}
    found = (
        sample.repartition(16)  # of a bounded number of rows
        .mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    who = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    code, n = found.column("code").to_numpy(), found.column("n").to_numpy()
    sums = np.zeros((CLASSES**3, len(langs)))
    tri = code >= 0
    sums[code[tri], who[tri]] = n[tri]
    scripts = np.zeros(len(langs), np.uint16)
    for k in range(len(langs)):
        own = ~tri & (who == k)
        for b in range(len(SCRIPTS)):
            using = n[own & ((-1 - code) >> b & 1 == 1)].sum()
            scripts[k] |= (1 << b) * int(using > LEAST_SHARE * n[own].sum())
    log_p = np.log((sums + 0.1) / (sums.sum(0) + 0.1 * CLASSES**3))
    return Model(langs, log_p.astype(np.float32), scripts)


def _scores(codes: np.ndarray, begins: np.ndarray, scripts: np.ndarray, model: Model) -> np.ndarray:
    """(words, languages): log probability of each word, from the best language's down to LOWEST."""
    out = np.empty((len(begins) - 1, len(model.langs)), np.float32)
    for a in range(0, len(out), WORDS):
        b = min(a + WORDS, len(out))
        own = slice(begins[a], begins[b])
        score = np.add.reduceat(model.log_p[codes[own]], begins[a:b] - begins[a], axis=0)
        barred = (scripts[a:b, None] & ~model.scripts[None, :]) != 0
        barred[barred.all(1)] = False
        score[barred] = -np.inf
        out[a:b] = np.maximum(score - score.max(1, keepdims=True), LOWEST)
    return out


def _scored(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores and letters of each word, words of each text, and whether it has a letter."""
    data, starts, has = _lowered(texts)
    codes, begins, at = _words(data)
    if len(begins) < 2:
        return np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64), np.zeros(len(texts), np.int64), has
    doc = np.searchsorted(starts, at[begins[:-1]], side="right") - 1
    scripts = np.bitwise_or.reduceat(_scripts(data, at), begins[:-1])
    score = _scores(codes, begins, scripts, model) if model.langs else np.zeros((len(doc), 0), np.float32)
    return score, np.diff(begins), np.bincount(doc, minlength=len(texts)), has


def viterbi(score: np.ndarray, first: np.ndarray, size: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; documents are rows first to first + size of score."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # documents with more than t words
    value = np.zeros((len(size), score.shape[1]), np.float32)
    moved = np.zeros(score.shape, bool)
    source = np.zeros(len(score), np.int16)
    for t in range(longest):
        n = active[t]
        at, v = first[:n] + t, value[:n]
        if t:
            top = v.argmax(1)
            rest = v[np.arange(n), top] - np.float32(switch)
            move = v < rest[:, None]
            moved[at], source[at] = move, top
            v = np.where(move, rest[:, None], v)
            v -= v.max(1, keepdims=True)  # only differences count; keeps long sums small
        value[:n] = v + score[at]
    path = np.zeros(len(score), np.int16)
    now = value.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = now[:n]
        now[:n] = np.where(moved[at, now[:n]], source[at], now[:n])
    return path


def label(texts: list[str | None], model: Model) -> list[pa.Array]:
    """lang_pred, score and spans of each text."""
    n, langs = len(texts), model.langs
    parts = [_scored(texts[a : a + SCORED], model) for a in range(0, n, SCORED)]
    score, letters, size, has = (np.concatenate(x) for x in zip(*parts, strict=True))
    words = len(letters)
    doc = np.repeat(np.arange(n), size)
    first = np.cumsum(size) - size
    best, share = [UNKNOWN] * n, np.zeros(n)
    spans = [[] for _ in range(n)]
    if words and langs:
        path = viterbi(score, first, size)
        held = np.bincount(doc * len(langs) + path, weights=letters, minlength=n * len(langs))
        held = held.reshape(n, len(langs))
        known = has & (size > 0)
        share = np.where(known, held.max(1) / np.maximum(held.sum(1), 1), 0.0)
        best = [langs[k] if ok else UNKNOWN for k, ok in zip(held.argmax(1), known, strict=True)]
        new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(path) != 0)))
        length = np.diff(np.append(new, words))
        for a, m in zip(new.tolist(), length.tolist(), strict=True):
            if known[d := doc[a]]:
                spans[d].append({"first": a - int(first[d]), "words": m, "lang": langs[path[a]]})
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
    return [pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(spans, kind)]


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and spans (first word, number of words, language)."""
    names = [x.split()[0] for x in RESULTS.split(", ")]
    rest = df.drop(*names)
    schema = StructType([*rest.schema.fields, *StructType.fromDDL(RESULTS).fields])
    place = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                out = label(part.column(place).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, *names])

    return rest.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans")
    )


QUERIES = {"op3_language_id": (op3_language_id, None)}
