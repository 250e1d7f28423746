"""E8 decoding and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from tessera.llm.lattice_dup import Lattice, decode, minimal_vectors, near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string"


def brute(ids, x, cosine=0.95):
    n = np.linalg.norm(x, axis=1)
    s = (x @ x.T) / np.outer(n, n) >= cosine
    np.fill_diagonal(s, False)
    label = np.array(ids)
    while True:
        before = label.copy()
        for k in np.flatnonzero(s.any(axis=1)):
            label[k] = min(label[k], label[s[k]].min())
        if (label == before).all():
            return {i: (int(c), int(g)) for i, c, g in zip(ids, s.sum(axis=1), label)}


def test_decode_finds_nearest_points():
    rng = np.random.default_rng(1)
    x = rng.normal(scale=2, size=(400, 8))
    p = decode(x)
    whole = np.isclose(p, np.rint(p)).all(axis=1)
    half = np.isclose(p - 0.5, np.rint(p - 0.5)).all(axis=1)
    assert (whole | half).all() and (np.rint(p.sum(axis=1)) % 2 == 0).all()
    d = ((x - p) ** 2).sum(axis=1)
    for v in minimal_vectors():
        assert (d <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()
    assert len(minimal_vectors()) == 240 and d.max() <= 1 + 1e-9


def made(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, 64))
    rows = [b / np.linalg.norm(b) for b in base]
    for k in range(8):
        for _ in range(5 * k):
            v = rows[k] + rng.normal(scale=0.02 + 0.002 * k, size=64)
            rows.append(v / np.linalg.norm(v))
    rows += [rows[3].copy(), rows[3].copy(), rows[9] * 5.0]
    return np.array(rows).astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("block", [4096, 4])
def test_links_match_brute_force(spark, block):
    x = made()
    ids = [7 * i % 1000 for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in zip(ids, x)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, Lattice(block=block)).collect()}
    assert got == brute(ids, x)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = rng.normal(size=(400, 64))
    v -= (v * x).sum(axis=1, keepdims=True) * x
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * v
    rows = [(i, r.tolist(), 0, "x") for i, r in enumerate(np.concatenate([x, y]))]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).where("n_links > 0").count()
    assert found >= 0.99 * 800


def test_edges(spark):
    e = [1.0] + [0.0] * 63
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [nan] + e[1:]), (5, [inf] + e[1:]), (6, [None] + e[1:]), (7, e), (8, e), (8, e), (None, e), (9, [1.0, 0.0]), (10, [1e-30] + e[1:])]
    got = near_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert all(by[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 9))
    assert by[7] == (3, 7, True) and by[8] == (3, 7, False) and by[10] == (3, 7, False)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
