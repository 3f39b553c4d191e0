"""The registered queries on driver tables: against their SQL, or against brute force where SQL can't state them."""

import base64
import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from gridloom.llm import bpe, language_id, mixing, near_dup, nearest, queries, token_files
from tests.test_contract import TABLES, rows

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Larger, for what needs enough rows to be told.
MORE = os.environ.get("TEST_MORE_DIR", "/root/testdata/sf0.01")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


class PlainModel:
    """Language identification as the operator's text defines it, one word and one document at a time."""

    def __init__(self, labelled):
        self.counts, self.words, self.uses = defaultdict(Counter), Counter(), defaultdict(Counter)
        for text, lang in labelled:
            for word in self.split(text):
                self.words[lang] += 1
                self.counts[lang].update(self.trigrams(word))
                self.uses[lang].update(self.scripts(word))
        self.langs = sorted({lang for _, lang in labelled})
        self.total = {k: sum(self.counts[k].values()) for k in self.langs}
        self.known = {k: {s for s, n in self.uses[k].items() if n > language_id.LEAST_SHARE * self.words[k]} for k in self.langs}

    @staticmethod
    def split(text):
        return regex.findall(r"(?:[a-z]|[[^\x00-\x7f]&&[\p{L}\p{M}]])+", text.lower(), flags=regex.V1)

    @staticmethod
    def trigrams(word):
        data = [0, *(int(language_id.CLASS[b]) for b in word.encode()), 0]
        return list(zip(data, data[1:], data[2:]))

    @staticmethod
    def scripts(word):
        return {name for c in word for name, ranges in language_id.SCRIPTS if any(a <= ord(c) <= b for a, b in ranges)}

    def score(self, word):
        found = {}
        own, scripts = self.trigrams(word), self.scripts(word)
        barred = {k for k in self.langs if scripts - self.known[k]}
        for k in self.langs:
            bottom = self.total[k] + 0.1 * language_id.CLASSES**3
            found[k] = sum(math.log((self.counts[k][t] + 0.1) / bottom) for t in own)
        if len(barred) < len(self.langs):
            found |= dict.fromkeys(barred, -math.inf)
        top = max(found.values())
        return [max(found[k] - top, language_id.LOWEST) for k in self.langs]

    def label(self, text):
        words = self.split(text or "")
        if not words or not self.langs:
            return "und", 0.0
        memo, value, back = {}, None, []
        for w in words:
            if w not in memo:
                memo[w] = np.array(self.score(w))
            if value is None:
                value = memo[w].copy()
                continue
            top = int(value.argmax())
            move = value < value[top] - language_id.SWITCH
            back.append(np.where(move, top, np.arange(len(value))))
            value = np.maximum(value, value[top] - language_id.SWITCH) + memo[w]
        at, path = int(value.argmax()), []
        for step in [*back[::-1], None]:
            path.append(at)
            if step is not None:
                at = int(step[at])
        held = Counter()
        for w, k in zip(words, path[::-1]):
            held[k] += len(w.encode())
        best = min(held, key=lambda k: (-held[k], k))
        return self.langs[best], held[best] / sum(held.values())


def test_language_id_by_brute_force_and_held_out(spark):
    docs = documents(spark, MORE)
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    got = {r.doc_id: r for r in queries.queries()["op3_language_id"](spark, MORE).collect()}
    assert len(got) == len(docs) and all(got[i].held_out == h for i, h in held.items())
    model = PlainModel([(r.text, r.lang) for r in docs if r.text is not None and r.lang is not None and not held[r.doc_id]])
    near = 0
    for r in docs:
        if len(r.text or "") < 20_000:
            lang, score = model.label(r.text)
            near += got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-6
        else:
            near += 1
    assert near >= 0.995 * len(docs)  # sums of 32-bit numbers may part a tie otherwise
    asked = [r for r in docs if held[r.doc_id] and r.lang is not None and r.text is not None and re.search("[a-z]", r.text, re.I)]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in asked) >= 0.98 * len(asked) > 100


def sha(data):
    return hashlib.sha256(data).hexdigest()


def plain_encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktokens(spark):
    own = plain_encoder()
    want = {}
    for r in documents(spark, MORE):
        ids = own.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()))
    got = queries.queries()["op4_bpe"](spark, MORE).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_token_files_are_the_librarys(spark):
    from tokenizers import Tokenizer

    own, start, want = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER)), 0, {}
    for r in sorted(documents(spark, MORE), key=lambda r: r.doc_id):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = queries.queries()["op7_token_files"](spark, MORE).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_nearest_recall(spark):
    rows_ = spark.read.parquet(f"{MORE}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows_]), np.array([r.embedding for r in rows_], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in nearest.op6_nearest(spark, MORE).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((ids, -score))[:5]
        own = sorted(got[ids[q]])
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[np.flatnonzero(ids == i)[0]], abs=1e-12) for _, i, s in own)
        assert [s for *_, s in own] == sorted((s for *_, s in own), reverse=True)
        hits += len({i for _, i, _ in own} & set(ids[best].tolist()))
        total += 5
    assert hits >= 0.9 * total


def shingles(text):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets, percent):
    """Smallest reachable id by comparing every pair that shares a shingle."""
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    shared = Counter()
    for own in having.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                shared[min(i, j), max(i, j)] += 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((top(i), top(j)))
            group[b] = a
    return {i: top(i) for i in sets}


def test_near_dup_finds_every_link(spark):
    sets = {r.doc_id: shingles(r.text) for r in documents(spark, MORE)}
    want = components(sets, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.op10_near_dup(spark, MORE).collect()}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert sum(i != c for i, c in want.items()) > 50


def plain_lines(docs):
    """docs [(id, text, source)] without later occurrences of three lines."""
    seen, out = set(), []
    for i, text, source in sorted(docs):
        lines, gone = text.split("\n"), set()
        for p in range(len(lines) - 2):
            if tuple(lines[p : p + 3]) in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(tuple(lines[p : p + 3]))
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), source))
    return out


def drawn(doc):
    """The place of (id, text, source) in the seeded order."""
    return hashlib.md5(f"{mixing.SEED}:{doc[0]}:{hashlib.md5(doc[1].encode()).hexdigest()}".encode()).hexdigest()[:15]


def plain_mix(docs):
    """docs as often as the mix takes them."""
    size, order = Counter(), sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    n_words = {i: len(WORD.findall(t)) for i, t, _ in docs}
    for i, _, s in docs:
        size[s] += n_words[i]
    weight, clamped = {s: 1 + k % 3 for k, s in enumerate(order)}, set()
    while True:
        rest, free = sum(size.values()) - sum(3 * size[s] for s in clamped), sum(weight[s] for s in order if s not in clamped)
        target = {s: 3 * size[s] if s in clamped else weight[s] * rest / free for s in order}
        more = {s for s in order if s not in clamped and target[s] > 3 * size[s]}
        if not more:
            break
        clamped |= more
    until, out = Counter(), []
    for i, t, s in sorted(docs, key=drawn):
        ratio = target[s] / size[s] if size[s] else 0.0
        extra = (ratio - math.floor(ratio)) * size[s]
        until[s] += n_words[i]
        out += [(i, t, s)] * (math.floor(ratio) + (extra > 0 and 2 * until[s] - n_words[i] <= 2 * extra))
    return out


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    docs = documents(spark, DATA)
    model = PlainModel([(r.text, r.lang) for r in docs if r.text is not None and r.lang is not None])
    kept = []
    for r in docs:
        lang, score = model.label(r.text)
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            kept.append((r.doc_id, r.text, r.source))
    kept = plain_lines(kept)
    group = components({i: shingles(t) for i, t, _ in kept}, corpus_pipeline.NEAR_PERCENT)
    mixed = plain_mix([x for x in kept if group[x[0]] == x[0]])
    own, want = plain_encoder(), Counter()
    for i, t, _ in mixed:
        want[i, np.array(own.encode_ordinary(t), "<u4").tobytes()] += 1
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == sha(bytes(r.ids)) for r in got)


def test_brute_force_is_not_blind(tmp_path):
    """The plain versions tell texts apart."""
    assert components({1: shingles("a b c d e f g h i j"), 2: shingles("a b c d e f g h i j"), 3: shingles("q")}, 80) == {1: 1, 2: 1, 3: 3}
    assert json.dumps(plain_lines([(2, "a\nb\nc\nd", None), (1, "a\nb\nc", None)])) == '[[1, "a\\nb\\nc", null], [2, "d", null]]'
