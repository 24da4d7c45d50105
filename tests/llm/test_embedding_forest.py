"""The forest against comparing all pairs."""

import math

import numpy as np
import pytest

from loamline.llm import embedding_forest as ef

VECTORS = "vec_id long, embedding array<float>, label int, n int, leaf string, tree int"


def brute(rows, threshold=0.93):
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) if sound(v, g) else None for _, v, g in rows]
    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    heads = {}
    for a in range(n):
        if rows[a][0] is not None:
            heads[root(a)] = min(heads.get(root(a), 1 << 60), rows[a][0])
    return sorted(((rows[a][0], links[a], heads.get(root(a))) for a in range(n)), key=str)


def near(rng, center, spread, n):
    out = center + rng.standard_normal((n, len(center))) * spread / math.sqrt(len(center))
    return [list(map(float, v)) for v in out]


def planted(seed, dim=32):
    """Random vectors, small groups, chains, a dense group and its copies, in two labels."""
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(dim))
    vectors = [list(map(float, unit())) for _ in range(500)]
    for _ in range(30):
        vectors += near(rng, unit(), 0.25, 4)
    dense = unit()
    vectors += near(rng, dense, 0.15, 150)
    vectors += [vectors[-1]] * 20 + [[2 * x for x in vectors[-2]]]
    step = unit()
    for k in range(8):  # a chain whose ends are far apart
        vectors.append(list(map(float, unit() * 0.01 + dense * math.cos(0.3 * k) + step * math.sin(0.3 * k))))
    return [(i * 7 % 100_003, v, i % 9 == 0) for i, v in enumerate(vectors)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x", 1) for r in rows], VECTORS).repartition(3)


def test_small_labels_are_exact(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e30, 1e29], 1), (14, [1e-40, 0.0], 1), (None, [0.0, 1.0], 1), (15, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (16, [-0.0, 1.0], 3), (17, [0.0, 1.0], 3)]
    got = ef.near_vectors(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert ef.near_vectors(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 64])
def test_forest_finds_the_links(spark, monkeypatch, block):
    """Trees with leaves of 16: no link is wrong, and nine of ten, and of components, are found; blocks change nothing."""
    monkeypatch.setattr(ef, "BLOCK", block)
    monkeypatch.setattr(ef, "PIECE", block // 4)
    rows = [(i, v, int(g)) for i, v, g in planted(11)]
    want = {}
    for i, n, c in brute(rows):
        want.setdefault(i, (n, c))
    got = {r.vec_id: (r.n_links, r.component_id) for r in ef.near_vectors(frame(spark, rows), leaf=16).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def test_counts_are_of_distinct_pairs(spark):
    """A dense group in many leaves of many trees: each pair counts once."""
    rng = np.random.default_rng(2)
    center = rng.standard_normal(16)
    rows = [(i, v, 0) for i, v in enumerate(near(rng, center / np.linalg.norm(center), 0.1, 120) + near(rng, -center / np.linalg.norm(center), 0.1, 120))]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in ef.near_vectors(frame(spark, rows), leaf=8, trees=6).collect()), key=str)
    assert got == brute(rows)
