"""Each operator against a brute-force version on small rows: nulls, ties, repeated rows, long and empty texts, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import (
    _graph,
    _shared,
    bpe,
    chat_format,
    exact_dedup,
    language_id,
    line_dedup,
    mixing,
    near_dup,
    nearest,
    substring_dedup,
    token_files,
)
from gridloom.llm._shared import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, id string, n_lines string, score string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with results."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, l, s in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 5, 40, 60, 80, 120, 300, 300)]
    passage = prose(rng, 70)
    texts = base + [base[3], base[3].replace(" ", "\n"), base[6] + " end", base[6].upper(), "", None, " \t\n", "x"]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(6)]
    texts += ["a\nb\nc\nd\ne", "q\nb\nc\nd\nz", "b\nc\nd", "r\nr\nr\nr\nr\nr", "a\nb", prose(rng, 20_000), "y" * 50_000]
    near = prose(rng, 200).split()
    for k in range(12):
        own = list(near)
        for _ in range(k % 5):
            own[rng.randrange(200)] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(own))
    texts += ["same text here"] * 40
    out = [(k * 3 % 101 + 101 * (k // 101), t, ("en", "de", None)[k % 3], ("a", "b", None, "c")[k % 4]) for k, t in enumerate(texts)]
    return out + [out[3], (None, base[4], "en", "a"), (None, None, None, None)]


def test_exact_dedup(spark, rows):
    """One row of each group stays: the longest, then of smallest id; of rows alike in both, one."""
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    want = Counter()
    for norm, own in groups.items():
        best = min(own, key=lambda x: x[:3])
        want[(best[3], norm, best[3], len(own), True)] += 1
        own.remove(best)
        for x in own:
            want[(x[3], norm, best[3], len(own) + 1, False)] += 1
    assert Counter((r.id, r.normalised, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert any(r.group_size > exact_dedup.LEAST_HOT for r in got)  # the branch for hot texts ran


@pytest.mark.parametrize("copies", [2, 200])
def test_exact_dedup_keeps_one_of_repeated_rows(spark, copies):
    docs = [(1, "a b", None, None)] * copies + [(1, " ab", None, None), (1, "a\tb", None, None), (2, "c", None, None)]
    seen = set()
    for k in range(3):
        random.Random(k).shuffle(docs)
        got = exact_dedup.exact_dedup(frame(spark, docs).repartition(3)).collect()
        assert Counter((r.id, r.group_size, r.kept) for r in got) == {(1, copies + 2, True): 1, (1, copies + 2, False): copies + 1, (2, 1, True): 1}
        seen.add(len(got))
    assert seen == {copies + 3}


def test_mixing(spark, rows):
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, total, clamped = {}, sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in clamped)
        free = sum(weight[s] for s in order if s not in clamped)
        target = {s: 3 * sizes[s] if s in clamped else weight[s] * rest / free for s in order}
        above = {s for s in order if s not in clamped and target[s] > 3 * sizes[s]}
        if not above:
            break
        clamped |= above
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.reps <= 3 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
    again = mixing.mix_sources(frame(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: (str(r.id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_weights_go_by_the_order_of_sources(spark):
    names = [f"s{k:03d}" for k in range(200)] + ["é", "Z", ""]
    docs = [(k, "a", None, s) for k, s in enumerate(names + [None])]
    sources = frame(spark, docs).select(F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("source_null"), F.lit(1).cast("long").alias("source_size"))
    got = {None if r.source_null else r.source_key: r.weight for r in mixing._weighted(sources, (1, 2, 3)).collect()}
    assert got == {s: 1 + k % 3 for k, s in enumerate([*sorted(names), None])}


def test_fill_clamps_round_by_round(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 10, 5), ("c", 100, 1)], "k string, source_size long, weight long")
    got = {r.k: r.target for r in mixing.fill(df, 3).collect()}
    assert got == {"a": 3, "b": 30, "c": 78}
    assert mixing.fill(df.limit(0), 3).count() == 0


def test_line_dedup(spark, rows):
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert got.columns == [c for c in SCHEMA.replace(",", "").split()[::2] if c != "n_lines"] + ["n_lines", "n_removed"]
    docs = sorted({(i is None, i or 0, t) for i, t, *_ in rows if t is not None})
    seen, kept = {}, {}
    for none, i, t in docs:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[p : p + 3]), (none, i, t, p)) != (none, i, t, p):
                gone |= {p, p + 1, p + 2}
        kept[none, i, t] = "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)
    want = Counter((i, *(kept[i is None, i or 0, t] if t is not None else (None, 0, 0))) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == want
    assert sum(r.n_removed for r in got.collect()) > 5


def kept_words(rows):
    """What is left of each row when windows of 50 words that start in a smaller id go, by brute force."""
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, (True, 0)), (i is None, i or 0))
    want = Counter()
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < (i is None, i or 0):
                gone |= set(range(p, p + 50))
        want[(i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    return want


@pytest.mark.parametrize("memory", [substring_dedup.MEMORY, 150])  # the second lengthens prefixes of three segments, to whole windows if need be
def test_substring_dedup(spark, rows, monkeypatch, memory):
    monkeypatch.setattr(substring_dedup, "MEMORY", memory)
    want = kept_words(rows)
    got = substring_dedup.dedup_substrings(frame(spark, rows)).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert sum(k[2] > 0 for k in want) > 10


@pytest.mark.parametrize("memory", [substring_dedup.MEMORY, 150])
def test_substring_dedup_of_periodic_texts(spark, monkeypatch, memory):
    """Texts that repeat 1, 7 and 60 words, two words only, and one passage between different words."""
    monkeypatch.setattr(substring_dedup, "MEMORY", memory)
    rng = random.Random(12)
    turns = [[f"p{k}" for k in range(n)] for n in (1, 7, 60)]
    texts = [" ".join((w * 400)[: rng.randrange(49, 400)]) for w in turns for _ in range(5)]
    texts += [" ".join(rng.choices("ab", (9, 1), k=300)) for _ in range(8)]
    passage, long = prose(rng, 55, 10**6), "z" * 40
    texts += [f"{prose(rng, 60, 10**6)} {long}{k % 2} {passage} {prose(rng, 60, 10**6)}" for k in range(12)]
    docs = [(k, t, None, None) for k, t in enumerate(texts)]
    rng.shuffle(docs)
    got = substring_dedup.dedup_substrings(frame(spark, docs)).collect()
    want = kept_words(docs)
    assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert sum(k[2] > 0 for k in want) > 20


def test_segments_are_bounded():
    """No text gives a segment of more than 90 words, and every window is in one segment."""
    texts = [" ".join(f"p{k % 7}" for k in range(2000)), "a " * 500, prose(random.Random(3), 1000)]
    _, text, low, high, anchor = substring_dedup.segments_of(substring_dedup.Words(texts))
    assert (high - low <= 40).all() and (anchor >= high).all() and (anchor - low <= 40).all()
    for d, t in enumerate(texts):
        assert sorted(p for a, b in zip(low[text == d], high[text == d]) for p in range(a, b + 1)) == list(range(len(words(t)) - 49))


def test_suffix_tree_nodes():
    rows = np.random.default_rng(1).integers(1, 3, (300, 12)).astype(np.uint64)
    tree = substring_dedup.SuffixTree(rows)
    for depth in (0, 1, 5, 12):
        names = {}
        got = tree.nodes(depth).tolist()
        assert all(names.setdefault(tuple(r[:depth]), c) == c for r, c in zip(rows.tolist(), got)) and len(set(got)) == len(names)


def sets_of(text):
    w = words((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dup(spark, rows):
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    own = [(i, sets_of(t)) for i, t, *_ in rows]
    group = {i: i for i, _ in own if i is not None}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in own:
        for j, y in own:
            if None not in (i, j) and x and y and 100 * len(x & y) >= 85 * len(x | y):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    want = Counter((i, len(s), top(i) if i is not None else None, i is None or top(i) == i) for i, s in own)
    assert Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_chain_of_near_copies_is_one_component(spark):
    """Neighbours link, ends don't: pivots alone need not find all links."""
    rng = random.Random(8)
    w = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    docs = []
    for k in range(30):
        docs.append((k, " ".join(w), None, None))
        w = w[2:] + [f"z{k}", f"y{k}"]
    got = near_dup.near_duplicates(frame(spark, docs)).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("alone", [0, 10**6])
def test_components(spark, monkeypatch, alone):
    monkeypatch.setattr(_graph, "ALONE", alone)
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    group = {n: n for pair in links for n in pair}
    for _ in range(200):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = _graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got if r.node != r.component} == {n: g for n, g in group.items() if n != g}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    for j in (0.3, 0.6, 0.85, 1.0):
        n, got = 2000, []
        for _ in range(12):
            both = rng.integers(1, 1 << 63, int(2 * n * j / (1 + j)), np.uint64)
            x, y = (np.concatenate([both, rng.integers(1, 1 << 63, n - len(both), np.uint64)]) for _ in range(2))
            r = near_dup.registers(np.concatenate([x, y]), np.array([0, n, 2 * n]))
            got.append(near_dup.estimate(r[:1], r[1:], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(got) - j) < 0.05


def test_registers_merge():
    x = np.random.default_rng(5).integers(1, 1 << 63, 900, np.uint64)
    a, b, c = (near_dup.registers(y, np.array([0, len(y)]))[0] for y in (x[:500], x[300:], x))
    assert (np.maximum(a, b) == c).all()


def test_language_id(spark):
    rng = random.Random(2)
    parts = {"xx": ["ba", "be", "bi"], "yy": ["to", "tu", "ti"], "ru": ["да", "не", "он"]}
    say = lambda k, n: " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(n))
    train = [(k, say(lang, 60), lang, "s") for k, lang in enumerate(list(parts) * 20)] + [(900, None, "xx", None), (901, "", None, None)]
    model = language_id.learn(frame(spark, train))
    assert model.langs == sorted(parts)
    long = say("xx", 20_000)
    tests = [(1, say("xx", 9), "xx"), (2, say("ru", 9), "ru"), (2, say("ru", 9), "ru"), (3, None, "und"), (4, " 12 !? ", "und"), (5, "", "und"), (None, long, "xx")]
    mixed = say("yy", 30) + " " + say("xx", 10)
    df = frame(spark, [(i, t, None, None) for i, t, _ in tests] + [(7, mixed, None, None)])
    got = language_id.identify(df, model).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got if r.doc_id != 7) == Counter((i, want) for i, _, want in tests)
    assert all(0 <= r.score <= 1 for r in got)
    (m,) = [r for r in got if r.doc_id == 7]
    assert [(s["first"], s["words"], s["lang"]) for s in m.spans] == [(0, 30, "yy"), (30, 10, "xx")] and m.lang_pred == "yy"
    none = language_id.learn(frame(spark, train).limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(7)
    size = np.array([1, 4, 0, 6, 5])
    first = np.cumsum(size) - size
    score = -rng.random((size.sum(), 3)).astype(np.float32) * 9
    got = language_id.viterbi(score, first, size, switch=3.0)

    def value(path, a):
        return sum(score[a + k, l] for k, l in enumerate(path)) - 3 * sum(x != y for x, y in zip(path, path[1:]))

    for a, n in zip(first, size, strict=True):
        best = max((value(p, a) for p in np.ndindex(*[3] * n)), default=0)
        assert value(got[a : a + n].tolist(), a) == pytest.approx(best, abs=1e-4)


TEXTS = ["", "  a\n\n b\x1c \x85x", "日本 語　x", "a" * 3000, "don't I'll 12²½ ₂", "<|endoftext|>", "é" * 500 + "ß", "Ünï <|endoftext|>日", "hello <|endoftext|> x", "a<|endoftext|>b<|endoftext"]


def random_texts():
    rng = random.Random(1)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x3000)]))
    return ["".join(pick() for _ in range(150)) for _ in range(40)]


def test_bpe(spark, rows):
    docs = rows + [(1000 + k, t, None, None) for k, t in enumerate(TEXTS + random_texts())]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe_encode(frame(spark, docs), decoded=True).collect()
    want = Counter((i, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in docs)
    assert Counter((r.id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    back = bpe.bpe_decode(bpe.bpe_encode(frame(spark, docs))).collect()
    assert Counter((r.id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t, *_ in docs)


def test_kept_keys_are_bounded_and_common_ones_stay():
    class Doubled(_shared.Kept):
        made = 0

        def make(self, key):
            self.made += 1
            return key * 2

    kept = Doubled(10, 4)
    for k in range(200):
        assert kept["aa"] == "aaaa" and kept[f"{k}"] == f"{k}" * 2 and kept["longer"] == "longerlonger"
        assert len(kept) <= 10 and len(kept.older) <= 10
    assert kept.made == 1 + 200 + 200 and "longer" not in kept


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 3000):
        keys = [b"k%d" % k for k in range(n)]
        h = bpe.MinimalPerfectHash(keys)
        assert sorted(h.slots) == list(range(n)) and [h.slot(k) for k in keys] == h.slots


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    docs = rows + [(1000 + k, x, None, None) for k, x in enumerate(TEXTS + random_texts())]
    parts = token_files.write_tokens(frame(spark, docs), scratch(spark, "test"))
    got = sorted(token_files.read_tokens(parts).collect(), key=lambda r: r.start)
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0)) and len(got) == len(docs)
    place = 0
    for r in got:
        assert r.start == place
        place += len(r.ids) // 4
    want = Counter((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x, *_ in docs)
    assert Counter((r.id, bytes(r.ids)) for r in got) == want
    crc = token_files.read_tokens(parts).select("ids", F.crc32("ids").alias("c")).first()
    assert crc.c == zlib.crc32(crc.ids)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((600, 16))
    vectors[100:300] = vectors[7]
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    bad = [(700, None, "x"), (750, [0.0] * 16, "x"), (800, [1.0] * 15 + [None], "x"), (850, [float("nan")] * 16, "x"), (None, [1.0] * 16, "x"), (900, [1.0], "x")]
    df = spark.createDataFrame(rows + bad + rows[:60], "vec_id long, embedding array<float>, rank string")
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r.rank, r.id, r.score))
    assert set(got) == set(range(0, 600, 50))
    unit = vectors.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q, own in got.items():
        score = unit @ unit[q]
        want = sorted((k for k in range(600) if k != q), key=lambda k: (-round(score[k], 12), k))[:5]
        own.sort()
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5] and all(s == pytest.approx(score[i]) for _, i, s in own)
        hits += len(set(want) & {i for _, i, _ in own})
        if 100 <= q < 300:
            assert [i for _, i, _ in own] == [i for i in [7, *range(100, 110)] if i != q][:5]
    assert hits >= 0.9 * 5 * len(got)
    one = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest.nearest(one, F.col("vec_id") % 50 == 0).count() == 0


def plain_nearest(rows, queries, k=5):
    """Brute force over (id, vector): the k best of each query by score, then id."""
    out = {}
    for q, v in rows:
        if q in queries:
            best = {}
            for i, w in rows:
                if i != q:
                    s = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 10)
                    best[i] = max(best.get(i, -2), s)
            out[q] = sorted(best, key=lambda i: (-best[i], i))[:k]
    return out


def test_nearest_breaks_ties_by_id(spark):
    """Axes, their negatives, doubles and halves: very many equal cosines; extreme lengths; an id with two vectors."""
    axes = np.eye(8)
    vectors = [axes[k % 8] * (1.0, 2.0, 0.5, -1.0)[k // 8 % 4] for k in range(96)]
    vectors[5] = vectors[5] * 1e200
    vectors[6] = vectors[6] * 1e-200
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(0, axes[3].tolist()), (0, (axes[0] * 4).tolist())]
    schema = "vec_id long, embedding array<double>, query_id string, id string, score string, rank string, cell string"
    df = spark.createDataFrame([(*r, *"xxxxx") for r in rows], schema)
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id").isin(5, 6, 7, 40)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    plain = [(i, np.array(v) / np.abs(v).max()) for i, v in rows]
    assert got == plain_nearest(plain, {5, 6, 7, 40})


def test_nearest_over_many_cells(spark, monkeypatch):
    """Clusters in many cells, blocks and parts: recall as in one cell, and far cells are left out."""
    for name, v in (("SHARD", 150), ("BLOCK", 7), ("SAMPLE", 600)):
        monkeypatch.setattr(nearest, name, v)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16)) * 4
    vectors = np.concatenate([centres[np.arange(1200) % 12] + rng.standard_normal((1200, 16)), np.tile(centres[:1], (500, 1))])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_nearest([(k, v) for k, v in enumerate(vectors)], set(range(0, 1700, 50)))
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append(r.id)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_search_verifies_few_of_clustered_points():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32))
    points = nearest.unit(np.repeat(centres, 100, 0) + 0.1 * rng.standard_normal((4000, 32)))
    queries = nearest.unit(centres + 0.1 * rng.standard_normal((40, 32)))
    found, verified = nearest.search(points, queries, 5, np.full(4000, -1), np.zeros(40, int))
    best = np.argsort(-(queries @ points.T), 1)[:, :5]
    assert sum(len(set(a) & set(b)) for a, b in zip(found.tolist(), best.tolist())) >= 0.9 * 200
    assert verified < 0.2 * 40 * 4000


def test_cells_hold_every_point_within_their_bounds():
    points = np.random.default_rng(7).standard_normal((3000, nearest.PROJECTED))
    points[:1000] = points[0]
    cells = nearest.Cells(points[::3], 20)
    of, bound = cells.of(points), cells.bounds(points)
    assert (bound[np.arange(3000), of] == 0).all() and 15 <= len(set(of)) <= 20


def test_nearest_with_a_repeated_id(spark, monkeypatch):
    """A third of the rows has one id: its vectors are dealt to several parts, and each is a candidate."""
    monkeypatch.setattr(nearest, "SHARD", 50)
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((600, 6)).astype(np.float32)
    ids = [0] * 200 + list(range(1, 401))
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)] + [(0, vectors[0].tolist())] * 100
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    own, hits, total = np.array(ids), 0, 0
    for q in range(0, 401, 50):
        best = {}
        for j, score in zip(ids, (unit @ unit[own == q].T).max(1), strict=True):
            if j != q:
                best[j] = max(best.get(j, -2), score)
        want = sorted(best, key=lambda j: -best[j])[:5]
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and all(abs(r.score - best[r.id]) < 1e-9 for r in found)
        hits, total = hits + len({r.id for r in found} & set(want)), total + 5
    assert hits >= 0.9 * total


def test_mixing_with_a_hot_row(spark, monkeypatch):
    """A third of the rows repeats an id, or is one row: ranges part them, and sources still meet their targets."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rng = random.Random(21)
    docs = [(5, prose(rng, 12), None, "a") for _ in range(300)] + [(6, "one row of words", None, "b")] * 300 + [(k, prose(rng, 12), None, "abc"[k % 3]) for k in range(100, 400)]
    got = mixing.mix_sources(frame(spark, docs), carry=True).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == 900 and all(abs(taken[s] - t) <= 7 for s, t in target.items())


def test_chi_square():
    assert nearest.chi_square(2.0, 2) == pytest.approx(1 - np.exp(-1.0))
    assert nearest.stopping_ratio(2, 0.95) == pytest.approx(-2 * np.log(0.05))


def test_chat_format(spark):
    schema = "conv_id long, turn long, role string, text string, n string"
    talk = [("user", "hi"), ("assistant", "yes"), ("user", None), ("assistant", "so")]
    rows = [(c, k, *talk[k], "x") for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (9, 3)) for k in range(n)]
    rows += [(5, 0, "user", "hi", "x"), (5, 1, "assistant", "no", "x"), (6, 0, "user", "hi", "x"), (6, 0, "user", "hi", "x")]
    rows += [(None, 3, None, "z", "x"), (7, None, "user", "", "x"), (8, 0, "user", "hi", "x"), (8, 7, "user", "other", "x")]
    got = {r.conv: r for r in chat_format.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {3, 5, None, 7, 8}
    assert got[3].n_turns == 4 and got[3].n_same == 2
    assert got[3].rendered == "".join(f"<|{r}|>\n{t or ''}<|end|>\n" for r, t in talk)
    assert got[None].rendered == "<||>\nz<|end|>\n"


def test_names_that_clash(spark):
    """Input columns named like results: passed through or replaced, as the docstrings say."""
    docs = spark.createDataFrame([(1, "ba be bi " * 20, "xx", "p", "s", "w")], "doc_id long, text string, lang string, lang_pred string, spans string, `a b` string")
    model = language_id.learn(docs)
    (r,) = language_id.identify(docs, model).collect()
    assert (r.lang_pred, r["a b"], r.spans[0]["lang"]) == ("xx", "w", "xx")
    turns = spark.createDataFrame([(1, 0, "user", "hi", "c", "n", "x", "y")], "conv_id long, turn long, role string, text string, conv string, n_turns string, said string, alone string")
    assert [(r.conv, r.n_turns, r.n_same) for r in chat_format.format_chats(turns).collect()] == [(1, 1, 1)]
    lines = spark.createDataFrame([("b", "x\ny\nz", 1, 2), ("a", "x\ny\nz", 3, 4)], "doc_id string, text string, n_removed int, spans int")
    got = {r.doc_id: (r.text, r.n_removed, r.spans) for r in line_dedup.dedup_lines(lines).collect()}
    assert got == {"a": ("x\ny\nz", 0, 4), "b": ("", 3, 2)}  # ids may be text; removed is counted anew
    mixed = mixing.mix_sources(docs.withColumn("source", F.lit("z")).withColumn("row", F.lit("old")).withColumn("h", F.lit("old")), carry=True).first()
    assert mixed.row["row"] == mixed.row["h"] == "old" and mixed.reps == 1


def test_rows_without_ids(spark):
    """Rows without id don't stand for each other: they are drawn by their texts, and chats without id are single turns."""
    rng = random.Random(15)
    docs = [(None, prose(rng, 30), None, "a") for _ in range(60)] + [(k, prose(rng, 10), None, "b") for k in range(60)]
    got = mixing.mix_sources(frame(spark, docs)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    target = {r.source: r.target for r in got}
    assert all(abs(taken[s] - t) <= 16 for s, t in target.items()) and len({r.reps for r in got if r.source == "a"}) > 1
    turns = [(None, k % 3, "user", f"t{k}") for k in range(30)] + [(None, 0, "user", "t0"), (4, 0, "user", "t0"), (5, 0, "user", "t0"), (5, 1, "user", "u")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df).collect()
    assert sorted(r.rendered for r in chats if r.conv is None) == sorted(f"<|user|>\nt{k}<|end|>\n" for k in range(1, 30))
    assert [(r.conv, r.n_turns) for r in chats if r.conv is not None] == [(5, 2)]  # the others prefix it


def test_words_end_at_what_is_no_letter():
    """No-break spaces, quotes, dashes and full stops of any script part words; scripts go by code points."""
    data, _, _ = language_id._lowered(["a\u00a0b\u2019c\u2014d\u3002e\u0301f 12 \u0531\u0587 \u4e2d"])
    _, begins, at = language_id._words(data)
    assert len(begins) - 1 == 7
    of = np.bitwise_or.reduceat(language_id._scripts(data, at), begins[:-1])
    names = [{n for b, (n, _) in enumerate(language_id.SCRIPTS) if x >> b & 1} for x in of.tolist()]
    assert names == [{"latin"}] * 5 + [{"armenian"}, {"han"}]


@pytest.mark.parametrize("ids", ["null", "one", "alike"])
def test_learning_with_odd_ids(spark, monkeypatch, ids):
    """No language is lost, and the sample stays bounded, where rows share an id or are alike as a whole."""
    monkeypatch.setattr(language_id, "PER_LANG", 40)
    monkeypatch.setattr(language_id, "MOST", 60)
    rng = random.Random(3)
    words = {"de": "das haus und der garten ist schoen".split(), "en": "the house with this yard looks nice".split()}
    docs = [(k, " ".join(rng.choices(words["de"], k=9)), "de", None) for k in range(1500)]
    text = lambda: "the house with this yard" if ids == "alike" else " ".join(rng.choices(words["en"], k=9))
    docs += [({"null": None, "one": 7, "alike": 7}[ids], text(), "en", None) for _ in range(1500)]
    model = language_id.learn(frame(spark, docs))
    assert model.langs == ["de", "en"]
    asked = frame(spark, [(1, "the house with this yard", None, None), (2, "das haus und der garten", None, None)])
    assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, model).collect()} == {1: "en", 2: "de"}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 2)
    docs = frame(spark, [(k, "a b", str(k), None) for k in range(3)])
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(docs)


@pytest.mark.parametrize("bucket", [near_dup.BUCKET, 2])
def test_buckets_in_blocks_miss_no_pair(spark, monkeypatch, bucket):
    """Texts that resemble each other just below the threshold share buckets but not components."""
    monkeypatch.setattr(near_dup, "BUCKET", bucket)
    rng = random.Random(16)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for k in range(24):
        w = list(base)
        for p in rng.sample(range(120), 3):
            w[p] = f"n{k}-{p}"
        docs.append((k, " ".join(w), None, None))
    docs += [(100 + k, t + " tail", None, None) for k, t, *_ in docs[::5]]
    sets = {i: sets_of(t) for i, t, *_ in docs}
    group = {i: i for i in sets}
    for _ in sets:
        for i, x in sets.items():
            for j, y in sets.items():
                if 100 * len(x & y) >= 85 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    got = {r.id: r.component_id for r in near_dup.near_duplicates(frame(spark, docs)).collect()}
    assert got == group and len(set(group.values())) > 5


def test_empty_tables(spark, rows):
    none = frame(spark, rows).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert bpe.bpe_encode(none).count() == 0
    assert token_files.read_tokens(token_files.write_tokens(none, scratch(spark, "none"))).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(vectors, F.col("vec_id") % 50 == 0).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(chats).count() == 0
    model = language_id.learn(frame(spark, [(1, "ba be", "xx", None)]))
    assert language_id.identify(none, model).count() == 0


def test_empty_pipeline(spark, rows):
    import corpus_pipeline as p

    docs = frame(spark, rows).limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_pipeline_keeps_a_defined_row_of_a_repeated_id(spark):
    """The row of smallest hash stays, whatever the order of rows; rows without id all stay and are mixed one by one."""
    import corpus_pipeline as p

    rng = random.Random(17)
    docs = [(k % 7, prose(rng, 40), "en", "a") for k in range(21)] + [(None, prose(rng, 40), "en", "a") for _ in range(5)] + [(None, "same words here", "en", "b")] * 2
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(docs)
        out = p.near_duplicates(spark, frame(spark, docs).repartition(5), "").collect()
        assert Counter(r.doc_id for r in out) == Counter({**dict.fromkeys(range(7), 1), None: 7})
        seen.add(frozenset(r.text for r in out))
    assert len(seen) == 1
    mixed = p.mixture(spark, frame(spark, docs), "")
    assert mixed.columns == frame(spark, docs).columns and mixed.where("source = 'b'").count() == 6


def test_pipeline(spark, rows):
    import corpus_pipeline as p

    rng = random.Random(6)
    more = [(2000 + k, prose(rng, 50), "en", "abc"[k % 3]) for k in range(40)]
    docs = frame(spark, rows + more)
    assert [n for n, _ in p.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing sources", "byte-level BPE"]
    for name, stage in p.STAGES:
        out = stage(spark, docs, "")
        out = spark.createDataFrame(out.collect(), out.schema)
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        if name == "language ID":
            assert {r.doc_id for r in out.collect()} >= {i for i, t, *_ in more}
            assert not any(r.text is None or not re.search("[a-z]", r.text, re.I) for r in out.collect())
        if name == "MinHash near-dedup":
            left = [r for r in out.collect() if r.doc_id is not None]
            assert len({r.doc_id for r in left}) == len(left)
            found = [sets_of(r.text) for r in left]
            assert not any(x and y and 100 * len(x & y) >= 85 * len(x | y) for k, x in enumerate(found) for y in found[:k])
        if name == "mixing sources":
            assert set(Counter(r.doc_id for r in out.collect()).values()) <= {1, 2, 3, 6}
        docs = out
    own = docs.select("decoded_sha256").collect()
    assert own and all(len(r[0]) == 64 for r in own)
    assert hashlib.sha256(b"").hexdigest() not in {r.decoded_sha256 for r in docs.where("n_tokens > 0").collect()}


def test_pipeline_of_odd_columns(spark):
    """Names that clash or hold dots, and maps inside structs, pass through every stage."""
    import corpus_pipeline as p

    rng = random.Random(9)
    odd = ["named_struct('m', map('k', doc_id)) AS `a.b`", *[f"{k} AS `{c}`" for k, c in enumerate(["_copy", "row", "range", "h", "tie", "starts", "a b"])]]
    docs = frame(spark, [(k, prose(rng, 40), "en", "ab"[k % 2]) for k in range(20)] + [(3, prose(rng, 40), "en", None)]).selectExpr("*", *odd)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count(), name
    assert p.encode(spark, docs, "").count() == docs.count()


def test_pipeline_links_from_four_fifths(spark):
    """Pairs at 0.815 and 0.774: the stage drops one of the first pair, op10's threshold none."""
    import corpus_pipeline as p

    base = [[f"{c}{k}" for k in range(200)] for c in "ab"]
    docs = [(k, " ".join(w), "en", "a") for k, w in enumerate(base)]
    for k, (w, changed) in enumerate(zip(base, (4, 5), strict=True)):
        docs.append((10 + k, " ".join(f"z{i}" if i % 30 == 20 and i // 30 < changed else x for i, x in enumerate(w)), "en", "a"))
    x, y, u, v = (sets_of(docs[k][1]) for k in (0, 2, 1, 3))
    assert 0.8 <= len(x & y) / len(x | y) < 0.85 and 0.75 < len(u & v) / len(u | v) < 0.8
    df = frame(spark, docs)
    assert {r.doc_id for r in p.near_duplicates(spark, df, "").collect()} == {0, 1, 11}
    assert all(r.kept for r in near_dup.near_duplicates(df).collect())
