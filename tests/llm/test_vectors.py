"""Operators over embeddings against plain versions."""

import hashlib

import numpy as np
import pytest

from spanloom.llm import centroids, collisions

SCHEMA = "vec_id long, embedding array<double>, label int, _row string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def plain_copies(rows, similarity=0.93):
    """Links by all pairs, components by repeated relabelling."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) and g is not None for _, v, g in rows]
    n, links = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / max(abs(x) for x in rows[k][1]) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= similarity:
                    links[i].append(j)
                    links[j].append(i)
    root, changed = [r[0] for r in rows], True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in links[i])])
            changed |= low != root[i]
            root[i] = low
    return sorted((rows[i][0], len(links[i]), root[i], rows[i][0] == root[i]) for i in range(n))


def test_calibration_keeps_pairs_at_the_threshold():
    half, least = collisions.calibrated(0.93, 32, 1e-7)
    rng = np.random.default_rng(3)
    kept = total = passed = 0
    for _ in range(20):
        x = rng.standard_normal((2000, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((2000, 24))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        d = rng.standard_normal((24, 32))
        p, q = x @ d, y @ d
        kept += int(((np.abs(p - q) <= half).sum(axis=1) >= least).sum())
        passed += int(((np.abs(p - np.roll(q, 1, axis=0)) <= half).sum(axis=1) >= least).sum())
        total += len(x)
    assert kept == total
    assert passed < total * 0.02


def test_candidates_are_the_pairs_that_collide_often_enough():
    rng = np.random.default_rng(5)
    p, q = rng.standard_normal((70, 20)), rng.standard_normal((50, 20))
    q[:10] = p[:10] + 0.1
    q[10] = p[10]
    a, b = collisions.candidates(p, q, 0.8, 12)
    count = (np.abs(p[:, None] - q[None]) <= 0.8).sum(axis=2)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(count >= 12)), strict=True))


@pytest.mark.parametrize("block", [3, 16, 2048])
def test_near_copies_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(60)]
    for i in range(60, 150):  # chains and groups of near copies, copies, multiples
        base = np.array(rows[int(rng.integers(0, len(rows)))][1])
        rows.append((i, (base * 3 if i % 7 == 0 else base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.33])).tolist(), int(rng.integers(0, 3))))
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 1), (203, [1.0, None] * 8, 1), (204, [float("nan")] * 16, 1), (205, [float("inf")] * 16, 1), (206, rows[0][1], None), (207, rows[0][1][:8], 0)]
    rows += [(208, [1e200] * 16, 2), (209, [1e-200] * 16, 2), (3, rows[3][1], 0), (3, rows[3][1], 0), (3, rows[5][1], 2), (207, rows[0][1], 0)]
    found = collisions.near_copies(frame(spark, rows), block=block)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in found.collect()) == plain_copies(rows)


def test_a_large_group_is_counted_whole_and_rows_without_id_go(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(32)
    rows = [(i, base.tolist() if i % 2 else (base + rng.standard_normal(32) * 0.02).tolist(), 7) for i in range(400)] + [(None, base.tolist(), 7)]
    found = collisions.near_copies(frame(spark, rows), block=64).collect()
    assert len(found) == 400 and {(r["n_links"], r["component_id"]) for r in found} == {(399, 0)} and sum(r["kept"] for r in found) == 1


def test_empty_tables_of_vectors(spark):
    assert collisions.near_copies(frame(spark, [])).collect() == []
    assert centroids.report(frame(spark, [])).collect() == []


def plain_rounds(rows, clusters, rounds, dim):
    kept = [(i, [min(max(int(np.floor(256 * min(max(x, -1e15), 1e15))), -centroids.REACH), centroids.REACH) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:clusters]
    at = [v for _, v in first]
    for n in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(at)) for _, v in kept]
        if n < rounds:
            for k in range(len(at)):
                mine = [v for (_, v), (_, j) in zip(kept, near, strict=True) if j == k]
                at[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else at[k]
    inertia = {k: sum(d for d, j in near if j == k) for k in range(len(at))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    most = centroids.MOST
    return sorted((-1 if i is None else i, k, d, min(inertia[k], most), min(sum(inertia.values()), most), digest[k]) for (i, _), (d, k) in zip(kept, near, strict=True))


def held(found):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], *list(r)[1:]) for r in found.collect())


@pytest.mark.parametrize("seed", range(4))
def test_clusters_are_those_of_plain_rounds(spark, seed):
    """Values on a coarse grid make ties between centroids frequent; repeated vectors make equal centroids."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-2, 3, 4) / 64).tolist() if seed % 2 else rng.standard_normal(4).tolist(), 0) for i in range(300)]
    rows += [(i, rows[i % 5][1], 0) for i in range(300, 340)] + [(7, rows[8][1], 1), (None, rows[9][1], None), (None, rows[9][1], 2)]
    rows += [(400, None, 0), (401, rows[0][1][:3], 0), (402, [0.0, None, 0.0, 0.0], 0), (403, [float("nan")] * 4, 0), (404, [float("-inf")] * 4, 0)]
    assert held(centroids.report(frame(spark, rows), clusters=25, dim=4)) == plain_rounds(rows, 25, 5, 4)


def test_large_components_and_few_vectors(spark):
    rows = [(1, [1e9, -1e9], 0), (2, [1e300, 3.0], 0), (3, [5e5, -1.5], 0), (4, [5e5, -1.25], 0)]
    assert held(centroids.report(frame(spark, rows), clusters=2, dim=2)) == plain_rounds(rows, 2, 5, 2)
    assert held(centroids.report(frame(spark, rows[2:]), clusters=9, dim=2)) == plain_rounds(rows[2:], 9, 5, 2)


def test_balls_save_distances():
    """On grouped vectors a round after the first takes a small part of all distances."""
    rng = np.random.default_rng(0)
    middle = rng.standard_normal((40, 16)) * 400
    x = np.floor(middle[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)) * 30)
    by = centroids.Centroids(np.floor(middle))
    a, u, low, work = by.assigned(x, np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x)))
    assert work == x.shape[0] * 40
    moved = np.floor(middle + rng.standard_normal(middle.shape) * 5)
    after = centroids.Centroids(moved, np.sqrt(np.square(moved - np.floor(middle)).sum(axis=1)))
    b, _, _, work = after.assigned(x, a, u, low)
    assert (b == centroids.squares(x, moved).argmin(axis=1)).all()
    assert work < x.shape[0] * 4
