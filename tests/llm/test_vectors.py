"""Operators on embeddings against brute force, and their edge cases."""

import math
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("ledgerlake.llm")
from pyspark.sql import functions as F  # noqa: E402

from ledgerlake.llm import ann, hard_negatives, vectors, whitening  # noqa: E402

RNG = np.random.default_rng(5)
BASE = RNG.standard_normal((400, 12)) * 0.3
SCHEMA = "vec_id long, embedding array<double>, label int, row long, q string, anchor string, vec string, x int, h int, copy int"
NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0] * 12, [None] + [0.1] * 11, [NAN] + [0.1] * 11, [INF] + [0.1] * 11, [0.2] * 3, [-0.2, 0.1, 0.3]]


def rows_of():
    rows = [(i, BASE[i].tolist(), i % 4 if i % 9 else None) for i in range(400)]
    rows += [(1000 + i, BASE[7].tolist(), i % 3) for i in range(60)]  # one vector many times: ties
    rows += [(2000 + 50 * i, v, 1) for i, v in enumerate(ODD)] + [(3001 + i, v, 2) for i, v in enumerate(ODD)]
    rows += [rows[50], rows[51], rows[51], (100, BASE[3].tolist(), 2), (None, BASE[5].tolist(), 1), (None, None, None)]
    return [(*r, 1, "a", "b", "c", 2, 3, 4) for r in rows]


ROWS = rows_of()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def finite(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def integers(v):
    return [math.floor(256 * x) for x in v]


def test_hard_negatives(table, empty):
    use = [(r[0], integers(r[1]), r[2]) for r in ROWS if r[0] is not None and r[2] is not None and finite(r[1])]
    want = Counter()
    for a, v, label in use:
        if a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, w, lab in use if len(w) == len(v)]
        pos = sorted((-s, i) for s, i, lab in scored if lab == label and i != a)[:5]
        for p, pid in pos:
            neg = sorted((-s, i) for s, i, lab in scored if lab != label and 50 * -p <= 100 * s <= 95 * -p)[:3]
            want.update((a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(neg))
    asked = table.filter("vec_id % 50 = 0")
    for most in (hard_negatives.ROUND, 3):  # 3: several rounds
        got = hard_negatives.hard_negatives(table, asked, round_rows=most)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert Counter(map(tuple, got.collect())) == want
    assert len(want) > 50
    for a, b in ((empty, empty), (table, empty), (empty, asked)):
        assert hard_negatives.hard_negatives(a, b).count() == 0


def test_positive_of_zero_opens_before_negatives(spark):
    rows = [(50, [1.0, 0.0], 1), (9, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [0.0, 3.0], 2), (4, [-1.0, 0.0], 2)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.hard_negatives(e, e.filter("vec_id = 50"))
    assert sorted(map(tuple, got.collect())) == [(50, 9, 1, 2, 0, 0), (50, 9, 2, 3, 0, 0)]


def test_keys_sort_as_the_shuffle_wants():
    rng = np.random.default_rng(1)
    edge = np.array([-2 ** 63, -1, 0, 1, 2 ** 63 - 1])
    anchor, score, ids = (np.concatenate([rng.integers(-5, 5, 200), rng.choice(edge, 50)]) for _ in range(3))
    kind = rng.integers(0, 2, 250).astype(np.uint8)
    keys = hard_negatives.packed(anchor, score, kind, ids)
    assert [tuple(map(int, r)) for r in zip(*hard_negatives.unpacked(keys), strict=True)] == list(zip(anchor.tolist(), score.tolist(), kind.tolist(), ids.tolist(), strict=True))
    order = sorted(range(250), key=lambda i: (anchor[i], -int(score[i]), kind[i], ids[i]))
    raw = keys.to_pylist()
    assert [raw[i] for i in order] == sorted(raw)


def test_best_keeps_exact_ties_and_large_scores():
    rows = vectors.Rows(np.zeros((7, 1)), np.arange(7), np.zeros(7), np.arange(7), np.arange(7))
    for big in (1, 2 ** 61):
        s = np.array([[3, 3, 1, 3, 2, 3, 3]]) * big if big == 1 else np.array([[3, 3, 1, 3, 2, 3, 3]]) + big
        best = vectors.Best(1, 4)
        best.add(np.array([0]), s, rows, np.array([[True, False, True, True, True, True, True]]))
        assert best.found()[2].tolist() == [0, 3, 5, 6]
    a, b = np.array([[2 ** 40, 1]]), np.array([[2 ** 20, 3]])
    assert vectors.products(a, b).tolist() == [[2 ** 60 + 3]]


def test_hard_negatives_query_equals_sql_parameters(spark):
    """The registered query shifts labels of ids divisible by 7 and asks ids divisible by 50."""
    got = hard_negatives.op12_hard_negatives(spark, "/root/testdata/sf0.001").collect()
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    label = {r.vec_id: (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label for r in t}
    assert got and all(r.anchor_id % 50 == 0 and label[r.anchor_id] == label[r.positive_id] != label[r.negative_id] for r in got)


@pytest.mark.parametrize("size", [(400, 12), (30, 3), (9, 12), (2, 12)])
def test_whitening(spark, size):
    v = [None if i == 3 else BASE[i % 300, :size[1]].tolist() for i in range(size[0])] + ODD[3:6] + [[0.5] * 20]
    t = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(v)] + [(None, v[0], "c"), (0, v[0], "c")],
                              "vec_id long, embedding array<double>, n string").repartition(3)
    out = whitening.whitened(t).toPandas()
    part = [(i, integers(x)) for i, x in [*enumerate(v), (None, v[0]), (0, v[0])] if finite(x) and len(x) == size[1]]
    fit = np.array(sorted({tuple(x) for _, x in part}))
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(4, int((e > 1e-12 * e.sum()).sum()))
    assert len(out) == len(part) * k and (out.n == n).all()
    assert (out.identity_error < 1e-9).all()
    for j in range(1, k + 1):
        mine = out[out.component == j].sort_values(["vec_id", "whitened"])
        z = [(i, float(((np.array(x) * n - s) / n) @ u[:, j - 1] / np.sqrt(e[j - 1])), sum(int(n * a - b) ** 2 for a, b in zip(x, s, strict=True))) for i, x in part]
        sign = np.sign(sum(a[1] * b for a, b in zip(sorted(z, key=lambda r: (r[0] is None, r[0])), mine.whitened, strict=True)))
        z = sorted(((i, sign * w, d) for i, w, d in z), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert np.abs(mine.whitened.to_numpy() - np.array([r[1] for r in z])).max() < 1e-7
        assert mine.deviation.tolist() == [r[2] for r in z]
        assert abs(mine.explained.iloc[0] / (e[j - 1] / e.sum()) - 1) < 1e-9


def test_whitening_without_variance_and_large_entries(spark, empty):
    assert whitening.whitened(empty).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whitened(same).count() == 0
    large = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(large).collect()
    assert len(got) == 3 * 2 or len(got) == 3  # the second direction is below double precision of the first
    assert all(r.deviation is None for r in got if r.vec_id < 3)


def test_jacobi_davidson_on_equal_and_close_eigenvalues(spark):
    """Steep, flat and repeated spectra, without Spark: the operator only needs products."""
    class Dense:
        def __init__(self, m):
            self.m, self.dim = m, len(m)

        def product(self, d):
            return self.m @ d

    rng = np.random.default_rng(2)
    for e in (np.linspace(1, 2, 120), np.r_[np.ones(60), 5, 5, 5, 5 - 1e-9], 10.0 ** -np.arange(30), np.ones(25), np.array([3.0]), np.array([2.0, 0])):
        u = np.linalg.qr(rng.standard_normal((len(e), len(e))))[0]
        m = (u * e) @ u.T
        m = (m + m.T) / 2
        value, vec = whitening.leading_pairs(Dense(m), 4)
        k = min(4, len(e))
        assert np.abs(value - np.sort(e)[::-1][:k]).max() < 1e-13 * e.max() * len(e)
        assert np.abs(vec.T @ vec - np.eye(k)).max() < 1e-12
        assert np.linalg.norm(m @ vec - vec * value, axis=0).max() < 1e-13 * e.max() * len(e)


def cosine_best(rows, k):
    use = [(r[0], r[1]) for r in rows if r[0] is not None and finite(r[1]) and any(r[1])]
    cand = {(i, tuple(v)) for i, v in use}
    out = []
    for a, v in use:
        if a % 50 == 0:
            s = [(-(np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w))), i) for i, w in cand if len(w) == len(v) and i != a]
            out.append((a, sorted((round(x, 12), i) for x, i in s)[:k]))
    return out


def test_nearest_finds_the_neighbours(table, empty):
    want = cosine_best(ROWS, 5)
    asked = table.filter("vec_id % 50 = 0")
    for kw in ({}, {"shard_rows": 16, "target": 1.0, "level": 50.0}):
        got = ann.nearest(table, asked, **kw).collect()
        assert ann.nearest(table, asked, **kw).columns == ["query_id", "rank", "vec_id", "score"]
        assert len(got) == sum(len(b) for _, b in want)
        found = Counter((r.query_id, r.vec_id) for r in got)
        hit = sum((found & Counter((a, i) for a, b in want for _, i in b)).values())
        assert hit >= 0.9 * len(got)
        score = {(a, i): -s for a, b in want for s, i in b}
        assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-11 for r in got if (r.query_id, r.vec_id) in score)
    for a, b in ((empty, empty), (table, empty), (empty, asked)):
        assert ann.nearest(a, b).count() == 0


def test_nearest_ties_and_scale(spark):
    rows = [(i, [1e200, 2e200, 3e200]) for i in range(40)] + [(100, [2e-200, 4e-200, 6e-200]), (50, [0.0, 1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(e, e.filter("vec_id = 100")).orderBy("rank").collect()]
    assert got == [(100, k + 1, k) for k in range(5)]


def test_nearest_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    m = np.stack(t.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    ids, hit, n = t.vec_id.to_numpy(), 0, 0
    got = ann.op11_nearest_neighbours(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    for i in np.flatnonzero(ids % 50 == 0):
        s = m @ m[i]
        s[i] = -9
        hit, n = hit + len(got[ids[i]] & set(ids[np.argsort(-s)[:5]])), n + 5
    assert hit >= 0.9 * n


def test_abandoning_keeps_what_is_near():
    """Rows within the threshold survive the tests at any block but for the tests' level."""
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal((20, 64))
    x, q = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, q))
    true = 2 - 2 * q @ x.T
    t = np.sort(true, axis=1)[:, 20]
    at = ann.scanned([x[:, c:c + 16] for c in range(0, 64, 16)], [q[:, c:c + 16] for c in range(0, 64, 16)], t, 64, 2.1)
    assert (true[at] <= t[at[0]] + 1e-8).all()
    assert len(at[0]) >= 0.97 * 20 * 21


def test_empty_and_null_columns(spark):
    none = spark.createDataFrame([(1, None, None), (50, None, 3)], "vec_id long, embedding array<float>, label int")
    assert ann.nearest(none, none).count() == hard_negatives.hard_negatives(none, none).count() == whitening.whitened(none).count() == 0
    assert ann.usable(none.withColumn("vec_id", F.lit(None).cast("long")), "vec_id", "embedding").count() == 0
