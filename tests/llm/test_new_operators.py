"""Snapshot difference, fingerprints and whitening against brute force: nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import _ranges, fingerprints, snapshot_diff, whitening

DOCS = "doc_id long, text string, lang string, source string, `n_chars` long, old_key string, `key` string, `a.b` string, rank string, edited string"
DATA = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x") for r in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def differing(a, b):
    return [name for name, x, y in zip(("text", "lang", "source"), a, b, strict=True) if x != y]


def plain_diff(old, new):
    """Snapshots whose keys are unique: (key, old_key, op, changed, later row)."""
    old, new = {r[0]: r[1:] for r in old}, {r[0]: r[1:] for r in new}
    out = []
    for k in old.keys() & new.keys():
        out.append((k, k, "update" if old[k] != new[k] else "same", differing(old[k], new[k]), new[k]))
    groups = defaultdict(lambda: ([], []))
    for side, (own, other) in enumerate(((old, new), (new, old))):
        for k in own.keys() - other.keys():
            groups[own[k][:2]][side].append(k)
    for before, after in groups.values():
        before, after = sorted(before), sorted(after, reverse=True)
        n = min(len(before), len(after))
        out += [(b, a, "rekey", differing(old[a], new[b]), new[b]) for a, b in zip(before, after, strict=False)]
        out += [(a, a, "delete", [], None) for a in before[n:]] + [(b, None, "insert", [], new[b]) for b in after[n:]]
    return Counter(map(repr, out))


def found_diff(df):
    return Counter(repr((r.key, r.old_key, r.op, list(r.changed), tuple(r.row) if r.row else None)) for r in df.collect())


def snapshots():
    long = "long text " * 5000
    old = [(1, "a", "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, long, "en", "s"), (5, long, "en", "t"), (6, "b", "de", "s"), (7, "b", "de", "s")]
    old += [(8, None, None, None), (9, "only old", "en", "s")] + [(100 + k, "many", "en", "s") for k in range(700)]
    new = [(1, "a", "en", "s"), (2, "+", "en", None), (3, "", None, None), (-4, long, "en", "s"), (-5, long, "en", None), (-6, "b", "de", "s"), (-20, "b", "de", "s"), (-21, "b", "de", "z")]
    new += [(80, None, None, None), (90, "only new", "en", "s"), (91, "=a", "en", "s")] + [(-100 - 3 * k, "many", "en", "st"[k % 2]) for k in range(650)]
    return old, new


def test_snapshot_diff(spark):
    old, new = snapshots()
    assert found_diff(snapshot_diff.snapshot_diff(docs(spark, old), docs(spark, new))) == plain_diff(old, new)


@pytest.mark.parametrize("sides", [(0, 0), (1, 0), (0, 1)])
def test_snapshot_diff_of_empty_tables(spark, sides):
    old, new = (rows[:9] if use else [] for rows, use in zip(snapshots(), sides, strict=True))
    assert found_diff(snapshot_diff.snapshot_diff(docs(spark, old), docs(spark, new))) == plain_diff(old, new)


def test_snapshot_diff_of_repeated_keys(spark):
    """Rows of one key pair one by one, identical ones with each other's like; null is a key; a key may hold very many rows."""
    old = [(None, "n", "en", "s")] * 500 + [(5, "a", "en", "s"), (5, "b", "en", "s"), (6, "c", "en", "s")]
    new = [(None, "n", "en", "s")] * 300 + [(5, "a", "en", "s"), (5, "b", "en", "s"), (5, "a", "en", "s"), (60, "c", "en", "s"), (60, "c", "en", "u")]
    got = Counter((r.key, r.old_key, r.op) for r in snapshot_diff.snapshot_diff(docs(spark, old), docs(spark, new)).collect())
    want = {(None, None, "same"): 300, (None, None, "delete"): 200, (5, 5, "same"): 2, (5, None, "insert"): 1, (60, 6, "rekey"): 1, (60, None, "insert"): 1}
    assert got == want


def test_snapshot_diff_of_other_columns_and_key_types(spark):
    schema = "id string, `a.b` long, raw binary, note array<string>"
    old = spark.createDataFrame([("x", 1, b"1", ["p"]), ("y", 2, None, None), ("z", 3, b"3", [])], schema)
    new = spark.createDataFrame([("x", 1, b"1", ["q"]), ("w", 2, None, None), ("z", 3, b"3", [])], schema)
    got = snapshot_diff.snapshot_diff(old, new, "id", ["a.b", "raw", "note"], ["a.b", "raw"])
    assert sorted((r.key, r.old_key, r.op, *r.changed) for r in got.collect()) == [("w", "y", "rekey"), ("x", "x", "update", "note"), ("z", "z", "same")]


def test_snapshot_diff_has_no_joins(spark):
    plan = snapshot_diff.op11_snapshot_diff(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_ranges_of_repeated_places(spark):
    """Alike rows that fill several ranges are dealt among them; the rest keep their order."""
    df = spark.createDataFrame([(7,)] * 3000 + [(k,) for k in range(1000)], "v long")
    place = df.select(F.col("v").alias("key"), F.lit(0).cast("long").alias("tie"))
    bounds = _ranges.bounds_of(place, 16)
    assert any(bounds.repeats()) and len(bounds) == 16
    placed = _ranges.with_range(df, F.col("v"), F.lit(0).cast("long"), bounds).groupBy("range", "v").count().collect()
    assert sum(r["count"] for r in placed if r["v"] == 7) == 3001 and max(r["count"] for r in placed) < 1000
    ends = sorted((r["range"], r["v"]) for r in placed)
    assert [v for _, v in ends] == sorted(v for _, v in ends)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sketch(text, limit=2**61):
    words = WORD.findall(text or "")
    runs = [" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    hashes = sorted({int(hashlib.md5(x.encode()).hexdigest()[:16], 16) for x in runs})
    return [h for h in hashes if h < limit] or hashes[:1]


def near(a, b):
    least = min(len(a), len(b))
    return len(set(a) & set(b)) / least if least else float(len(a) == len(b))


def as_text(hashes):
    return "".join(f"{h:016x}" for h in hashes)


def edited_rows(rows):
    """rows in order: (id, text) to what the operator gives."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = sketch(text)
        out.append((i, len(text), edited, as_text(own), as_text(sketch(edited)), near(own, sketch(edited)), near(own, sketch(following))))
    return Counter(out)


def found_edits(df):
    got = df.select("id", "n_chars", "edited", fingerprints.as_text(F.col("own")), fingerprints.as_text(F.col("of_edited")), fingerprints.containment(F.col("own"), F.col("of_edited")), fingerprints.containment(F.col("own"), F.col("of_next")))
    return Counter(tuple(r) for r in got.collect())


def texts():
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    out = ["", None, " \t\n", "one", "two words", "a b c d e", "a b c d e f", "é😀 ü ñ 漢字 x y", "x" * 40_000, prose(30_000), prose(200), prose(200)]
    return out + [out[-1], out[-1] + " more"] + [prose(int(n)) for n in rng.integers(1, 60, 300)]


def test_fingerprints(spark):
    rows = [(3 * k - 40, t) for k, t in enumerate(texts())]
    frame = docs(spark, [(i, t, "en", "s") for i, t in rows])
    assert found_edits(fingerprints.edited_by_next(frame)) == edited_rows(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f g h")], [(None, "a b"), (2, "c d e")], [(4, "same text")] * 400 + [(k, f"text {k}") for k in range(5, 50)]])
def test_fingerprints_of_odd_tables(spark, rows):
    frame = docs(spark, [(i, t, "en", "s") for i, t in rows])
    assert found_edits(fingerprints.edited_by_next(frame)) == edited_rows(rows)


def test_sketches_merge(spark):
    """A merged sketch is that of the union; containment of a part in the whole is about 1, of unequal documents their share."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 5000, 6000)]
    parts = [" ".join(words[k : k + 2004]) for k in range(0, 6000, 2000)] + ["tiny one"]
    frame = spark.createDataFrame([(1, t) for t in parts] + [(2, "tiny one"), (3, ""), (4, "p q"), (4, "r s")], "g int, text string")
    got = {r.g: r.sketch for r in fingerprints.merged(fingerprints.with_sketch(frame, "text", "sketch"), ["g"]).collect()}
    whole = sketch(" ".join(words))
    assert got[1] == whole and got[3] == []
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    assert got[2] == [signed(h) for h in sketch("tiny one")] and got[4] == [signed(min(sketch("p q") + sketch("r s")))]
    small = sketch(" ".join(words[1000:1400]))
    assert near(small, whole) == 1.0 and len(whole) == pytest.approx(6000 / 8, rel=0.15)


def plain_whitening(vectors, k):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    w = (x - sums / n) @ v[:, :k] / np.sqrt(e[:k])
    return n, [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))) for row in x], w, e[:k] / e.sum()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, label int, `x.y` string, w string")


def test_whitening(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((900, 12)) * np.linspace(3, 0.5, 12)
    good = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    good += [(None, good[0][1]), (3, good[3][1])] + [(2000 + k, good[7][1]) for k in range(500)]
    bad = [(5000, None), (5001, [1.0] * 11 + [None]), (5002, [float("nan")] * 12), (5003, [float("inf")] + [0.0] * 11), (5004, [1.0]), (5005, [])]
    got = whitening.whiten(vectors(spark, good + bad).repartition(7)).collect()
    n, deviation, w, share = plain_whitening([v for _, v in good], 4)
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and n == 900
    want = defaultdict(list)
    for (i, _), d, own in zip(good, deviation, w, strict=True):
        want[i].append((d, own))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        options = [own[r.component - 1] for d, own in want[r.id] if d == r.deviation]
        sign = signs.setdefault(r.component, np.sign(options[0]) * np.sign(r.whitened))
        assert any(abs(sign * r.whitened - x) < 1e-9 for x in options)
        assert abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9


def test_merging_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (700, 9))
    for cuts in ([1], [2, 5, 300], list(range(1, 700, 13))):
        parts = [whitening.summary_of(p) for p in np.split(x, cuts)]
        while len(parts) > 1:
            parts = [whitening.merge(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        whole = whitening.summary_of(x)
        assert parts[0].n == 700 and (parts[0].sums == whole.sums).all()
        assert np.allclose(parts[0].s, whole.s, rtol=1e-12)
        assert np.allclose(np.abs((parts[0].v * whole.v).sum(1)), 1, atol=1e-9)


def test_levels_of_summaries(spark):
    rows = np.random.default_rng(4).integers(-90, 90, (400, 5))
    frame = spark.createDataFrame([(r.tolist(),) for r in rows], "x array<long>").repartition(70)
    got = whitening.fit(frame, 5)
    assert got.n == 400 and np.allclose(got.s, whitening.summary_of(rows).s)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0  # no variance
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(6)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line) and len(line) == 6


def test_deviation_is_exact_or_an_error():
    x = np.array([[3_000_000_007, -5], [1, 2]])
    got = whitening._deviation(x, 1, np.array([1, 1]))
    assert got.tolist() == [3_000_000_006**2 + 36, 1]
    with pytest.raises(OverflowError):
        whitening._deviation(x, 10, np.array([1, 1]))


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    n, deviation, w, share = plain_whitening([r.embedding for r in rows], 4)
    got = whitening.op13_whitening(spark, DATA).collect()
    place = {r.vec_id: k for k, r in enumerate(rows)}
    assert len(got) == 4 * len(rows)
    for c in range(4):
        own = {r.vec_id: r for r in got if r.component == c + 1}
        off = np.array([own[i].whitened - w[k, c] for i, k in place.items()])
        flipped = np.array([own[i].whitened + w[k, c] for i, k in place.items()])
        assert min(np.abs(off).max(), np.abs(flipped).max()) < 1e-8
        assert all(r.deviation == deviation[place[i]] and abs(r.explained - share[c]) < 1e-9 * share[c] and r.n == n for i, r in own.items())
