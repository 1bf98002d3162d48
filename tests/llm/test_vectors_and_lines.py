"""Whitening, hard negatives and line dedup against plain versions, on awkward rows and on the smallest tables."""

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, line_dedup, whitening
from tidemark.llm.characteristic import RealRoots, coefficient_bound, enough_primes, from_remainders, is_prime, null_vectors, polynomial_modulo
from tidemark.llm.queries import QUERIES
from tidemark.shared.scratch import Scratch

CLASHING = ("id", "row", "at", "h1", "seen", "first", "batch", "block", "chunk", "group", "length", "place", "rank", "n", "deviation", "gone", "lines")


def scratch(spark):
    return Scratch(spark, "test")


def clashing(df):
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in CLASHING))


# Line dedup ---------------------------------------------------------------------------------------------------------


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))


def without_repeats(rows):
    """(id, text, lines, dropped) of each row; a missing id comes last."""
    last = float("inf")
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            holders[k] = min(holders.get(k, last), last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(key(line)) < 10 or holders[key(line)] == (last if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LONG = "\n".join(f"line number {i % 3000} of a long text" for i in range(12_000))
TEXTS = [
    (5, "Shared heading here\nown line of five\n\nshort\nshared heading HERE"),
    (3, "  \tSHARED heading here\r\nshort\n\n\n"),
    (9, None),
    (10, ""),
    (11, " \t\n\x0b "),
    (12, LONG),
    (13, LONG),
    (13, "line number 7 of a long text\nonly in the second row of 13"),
    (14, "line number 7 of a long text\nÄÖÜ äöü straße\nonly in the second row of 13"),
    (15, "äöü äöü straße\nÄÖÜ äöü straße\n\x85ÄÖÜ äöü straße"),
    (16, "123456789\n1234567890\n１２３４５６７８９"),
    (17, "123456789\n1234567890 \n１２３４５６７８９"),
    (18, "123456789\n1234567890\n1234567890"),
    (18, "123456789\n1234567890\n1234567890"),
    (None, "shared heading here\nonly without an id\nshort"),
    (None, "only without an id\nonly in the second row of 13"),
    (-4, "only in the second row of 13\nlast line\n"),
]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (7, 2), (6, 3)])
def test_line_dedup_awkward_rows(spark, batches, fanout):
    docs = clashing(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    got = line_dedup.drop_repeated(docs, scratch(spark), batches, fanout).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got), key=order) == sorted(without_repeats(TEXTS), key=order)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_hot_line_and_empty_table(spark):
    rows = [(i, f"the very same line everywhere\nline of its own {i}\n" + "x" * (i % 12)) for i in range(600)]
    got = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark)).collect()
    assert sorted(map(tuple, got)) == sorted(without_repeats(rows))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated(none, scratch(spark)).count() == 0


def test_line_dedup_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in without_repeats(rows)]
    assert sorted(map(tuple, QUERIES["op13_line_dedup"](spark, sf).collect())) == sorted(want)


def test_runs_levels(spark):
    """Runs are compacted level by level, and every hash is found once."""
    runs = line_dedup.LineRuns(scratch(spark), 2)
    for number in range(5):
        runs.add(spark.range(number * 10, number * 10 + 10).select(F.col("id").alias("h1"), F.lit(number).alias("h2")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    asked = spark.range(60).select(F.col("id").alias("h1"), F.floor(F.col("id") / 10).cast("int").alias("h2"))
    assert {r.h1: r.seen for r in runs.look_up(asked).collect()} == {i: i < 50 for i in range(60)}
    assert sorted(r.h1 for r in runs.look_up(asked).where("not seen").collect()) == list(range(50, 60))
    plan = runs.look_up(asked)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the runs lie sorted and are not shuffled
    runs.close()


# Hard negatives -----------------------------------------------------------------------------------------------------


def hard(rows, anchors, scale=256, band=(50, 95)):
    """By comparing each anchor with all rows: rows are (id, vector, label)."""
    ok = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, al in ok:
        if a is None or not anchors(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(av, v, strict=True)), i is None, i or 0, i, label) for i, v, label in ok if len(v) == len(av)), key=lambda r: r[:3])
        positives = [r for r in scored if r[4] == al and r[3] != a][:5]
        for p in positives:
            hits = [r for r in scored if r[4] != al and band[0] * -p[0] <= 100 * -r[0] <= band[1] * -p[0]][:3]
            out += [(a, p[3], n, r[3], -p[0], -r[0]) for n, r in enumerate(hits, 1)]
    return sorted(out, key=str)


def mined(df, anchor, spark, **more):
    return sorted((tuple(r) for r in hard_negatives.mine(clashing(df), anchor, scratch(spark), **more).collect()), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_hard_negatives_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0.4, 0.3, 5).astype(np.float32)], int(rng.integers(0, 3))) for i in range(90)]
    rows += [(100, None, 1), (150, [1.0] * 5, None), (101, [1.0, None, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 5, 1), (103, [float("inf")] + [0.0] * 4, 2)]
    rows += [(None, [0.5] * 5, 0), (None, [0.5] * 5, 1), (None, [0.5] * 5, 1), (10, rows[10][1], rows[10][2]), rows[20], rows[21], rows[21], (200, [1.0, 2.0], 1), (201, [1.0, 2.0], 1), (202, [0.5, 1.4], 0), (210, [], 1), (211, [], 1), (212, [], 2)]
    rows += [(i, [0.5] * 5, i % 2) for i in range(120, 140)]  # ties
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df, F.col("vec_id") % 10 == 0, spark) == hard(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("size", [1.0, 3000.0, 1e6, 1e14])
def test_hard_negatives_any_size_of_numbers(spark, size):
    """Fields of four, eight and more bytes."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (rng.normal(0.5, 0.4, 4) * size)], int(rng.integers(0, 2))) for i in range(40)]
    got = mined(spark.createDataFrame(rows, VECTORS.replace("float", "double")), F.col("vec_id") % 10 == 0, spark)
    most = (1 << 63) - 1
    assert got == sorted([(*r[:4], min(r[4], most), min(r[5], most)) for r in hard(rows, lambda i: i % 10 == 0)], key=str) or size == 1e14
    if size == 1e14:  # scores beyond a long count as its end, so only their bounds are known
        assert all(r[4] <= most and r[5] <= most for r in got)


def test_packed_scores():
    rng = np.random.default_rng(9)
    for size in (3, 10**4, 10**9, 10**15):
        values, anchors = (rng.integers(-size, size, (n, 7)) for n in (33, 4))
        packed = hard_negatives.Packed(values, hard_negatives._largest(anchors))
        for a in anchors:
            want = [sum(int(x) * int(y) for x, y in zip(a, v, strict=True)) for v in values]
            assert packed.scores(a).tolist() == [min(max(w, -(1 << 63) + 1), (1 << 63) - 1) for w in want]


def test_hard_negatives_empty_and_table(spark, sf):
    assert mined(spark.createDataFrame([], VECTORS), F.lit(True), spark) == []
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_hard_negatives"](spark, sf).collect()), key=str) == hard(rows, lambda i: i % 50 == 0)


# Whitening ----------------------------------------------------------------------------------------------------------


def test_characteristic_polynomial_and_roots():
    assert [n for n in range(30) if is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        x = rng.integers(-50, 50, (n + 3, n)).astype(object)
        a = x.T @ x
        c = from_remainders([(p, polynomial_modulo(a, p).tolist()) for p in enough_primes(coefficient_bound(int(a.trace()), n))])
        # Faddeev and LeVerrier, in fractions.
        m, want = np.zeros((n, n), object), [Fraction(1)]
        for k in range(1, n + 1):
            m = a @ m + want[-1] * np.array([[int(i == j) for j in range(n)] for i in range(n)], object)
            want.append(-Fraction((a @ m).trace()) / k)
        assert c == [int(w) for w in reversed(want)]
        roots = RealRoots(c).largest(n)
        assert np.allclose([float(r) for r, m in roots for _ in range(m)], np.linalg.eigvalsh(a.astype(float))[::-1], rtol=1e-9)


def test_repeated_and_zero_roots():
    a = np.diag([7, 7, 3, 0, 0, 7, 1]).astype(object)
    c = from_remainders([(p, polynomial_modulo(a, p).tolist()) for p in enough_primes(coefficient_bound(25, 7))])
    roots = RealRoots(c).largest(7)
    assert [(round(float(r), 12), m) for r, m in roots] == [(7, 3), (3, 1), (1, 1)]
    vectors = null_vectors(a, roots[0][0], 3)
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-15) and np.allclose(vectors[:, [2, 3, 4, 6]], 0, atol=1e-15)


def test_close_roots_keep_all_digits():
    """Two roots that differ in the ninth digit, turned by an exact integer reflection."""
    w = [1, 2, 3, 4, 5]
    size = sum(x * x for x in w)
    q = [[size * (i == j) - 2 * w[i] * w[j] for j in range(5)] for i in range(5)]  # orthogonal, times size
    d = [10**9 + 1, 10**9, 10**5, 12, 5]
    a = np.array([[sum(q[i][k] * d[k] * q[j][k] for k in range(5)) for j in range(5)] for i in range(5)], object)
    c = from_remainders([(p, polynomial_modulo(a, p).tolist()) for p in enough_primes(coefficient_bound(int(a.trace()), 5))])
    roots = RealRoots(c).largest(5)
    assert [m for _, m in roots] == [1] * 5
    for k, (root, _) in enumerate(roots):
        assert abs(root / size**2 - d[k]) < Fraction(1, 10**20)
        v, want = null_vectors(a, root, 1)[0], np.array([q[i][k] for i in range(5)]) / size
        assert np.abs(v * np.sign(v @ want) - want).max() < 4e-16


def plain_whitening(rows, scale=64, most=32):
    """(n, deviations, whitened, explained) by numpy's eigenvectors."""
    x = np.array([[math.floor(scale * float(c)) for c in v] for v in rows]) + 1_000_000
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [i for i in np.argsort(-values) if values[i] > 1e-9][:most]
    return n, deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check_whitening(got, rows):
    n, deviation, want, explained = plain_whitening([v for _, v in rows])
    assert len(got) == len(rows) and {r.n for r in got} == {n}
    by_id = {r.id: r for r in got}
    found = np.array([by_id[i].whitened for i, _ in rows])
    assert [by_id[i].deviation for i, _ in rows] == deviation.tolist()
    assert np.allclose(got[0].explained, explained, rtol=1e-9)
    for k in range(want.shape[1]):
        assert np.allclose(found[:, k] * np.sign(found[:, k] @ want[:, k]), want[:, k], atol=1e-6)
    centred = found - found.mean(0)
    assert np.abs(centred.T @ centred / n - np.eye(found.shape[1])).max() < 1e-9 and got[0].identity_error < 1e-9


def test_whitening_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, [3, 1, 0.5, 0.2], 4).astype(np.float32)]) for i in range(60)]
    odd = [(70, None), (71, [1.0, None, 0.0, 0.0]), (72, [float("nan")] * 4), (73, [0.0, float("-inf"), 0.0, 0.0]), (74, [1.0, 2.0]), (75, [])]
    df = clashing(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"))
    check_whitening(whitening.whiten(df, scratch(spark)).collect(), rows)


def test_whitening_repeats_nulls_and_little_rank(spark):
    rng = np.random.default_rng(4)
    base = [[float(a), float(b), float(a + b), float(a)] for a, b in rng.integers(-5, 5, (30, 2))]
    rows = [(i, v) for i, v in enumerate(base + base[:7])]
    df = spark.createDataFrame([*rows, (None, base[0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, scratch(spark)).collect()
    assert len(got) == 38 and {len(r.whitened) for r in got} == {2} and got[0].identity_error < 1e-12
    check_whitening(got, [*rows, (None, base[0])])


def test_whitening_of_none_one_and_equal_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema), scratch(spark)).count() == 0
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(3)], [(1, []), (2, [])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema), scratch(spark)).collect()
        assert [(r.n, r.deviation, r.whitened, r.explained) for r in got] == [(len(rows), 0, [], [])] * len(rows)


def test_whitening_of_very_large_numbers(spark):
    rows = [(i, [1e13 * i, 3.0 * i]) for i in range(6)] + [(9, [1e300, -1e300])]
    n, sums, matrix = whitening.scatter(spark.createDataFrame(rows[:6], "vec_id long, embedding array<double>"))
    x = [[math.floor(64 * c) for c in v] for _, v in rows[:6]]
    assert (n, sums) == (6, [sum(c) for c in zip(*x, strict=True)])
    assert matrix.tolist() == [[6 * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(2)] for i in range(2)]
    assert len(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch(spark)).collect()) == 7


def test_whitening_table(spark, sf):
    got = QUERIES["op11_whitening"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, deviation, want, explained = plain_whitening([v for _, v in rows])
    assert len(got) == 32 * len(rows)
    cells = {(r.vec_id, r.component): r for r in got}
    for k in range(32):
        own = np.array([cells[i, k + 1].whitened for i, _ in rows])
        assert np.allclose(own * np.sign(own @ want[:, k]), want[:, k], atol=1e-7)
        assert math.isclose(cells[rows[0][0], k + 1].explained, explained[k], rel_tol=1e-9)
    assert [cells[i, 1].deviation for i, _ in rows] == deviation.tolist() and got[0].n == n and got[0].identity_error < 1e-9
