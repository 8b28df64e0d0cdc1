import numpy as np
import pytest

from siltstone.llm import vectors as V


def frame(spark, x, extra=()):
    rows = [(f"v{i:05d}", [float(a) for a in v], None) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id string, embedding array<float>, position int")


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_recall_of_many_leaves(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 64))
    x = (centres[rng.integers(0, 60, 4000)] + 0.8 * rng.standard_normal((4000, 64))).astype(np.float32)
    rows = V.nearest(frame(spark, x), leaf_rows=120).collect()
    near, _ = brute(x.astype(np.float64), 5)
    got: dict = {}
    for r in rows:
        got.setdefault(int(r["id"][1:]), set()).add(int(r["near_id"][1:]))
    assert all(len(v) == 5 for v in got.values()) and len(got) == 4000
    assert np.mean([len(got[i] & set(near[i].tolist())) / 5 for i in range(4000)]) >= 0.9


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, 64))
    return (centres[rng.integers(0, 60, n)] + 0.8 * rng.standard_normal((n, 64))).astype(np.float32)


def recall(rows, x):
    near, _ = brute(x.astype(np.float64), 5)
    got: dict = {}
    for r in rows:
        got.setdefault(int(r["id"][1:]), []).append(int(r["near_id"][1:]))
    assert all(len(v) == len(set(v)) == 5 for v in got.values()) and len(got) == len(x)
    return np.mean([len(set(got[i]) & set(near[i].tolist())) / 5 for i in range(len(x))])


@pytest.mark.parametrize("depth", [8, 10])
def test_recall_of_deep_trees(spark, depth):
    x = clustered(6 << depth)
    assert recall(V.nearest(frame(spark, x), leaf_rows=6, fit_rows=32 << depth).collect(), x) >= 0.9


def test_leaves_beyond_the_fit_are_split_again_and_cells_cut(spark):
    x = clustered(6000, 2)
    whole = V.nearest(frame(spark, x), leaf_rows=100, fit_rows=300).collect()  # depth 3, leaves of 750
    assert recall(whole, x) >= 0.9
    parts = V.nearest(frame(spark, x), leaf_rows=100, fit_rows=300, part_rows=2500).collect()
    assert recall(parts, x) >= 0.9


def test_one_leaf_is_exact_and_copies_take_smallest_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 64)).astype(np.float32)
    x[10:30] = x[10]
    bad = [("n", None, 1), ("z", [0.0] * 64, 1), ("s", [1.0] * 63, 1), ("nan", [float("nan")] * 64, 1), ("i", [float("inf")] * 64, 1), ("e", [None] * 64, 1), (None, [1.0] * 64, 1), ("v00000", [float(a) for a in x[0]], 9)]
    rows = V.nearest(frame(spark, x, bad)).collect()
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["position"])):
        by.setdefault(r["id"], []).append(r["near_id"])
    assert set(by) == {f"v{i:05d}" for i in range(50)}
    assert by["v00025"] == [f"v{i:05d}" for i in range(10, 15)] and by["v00012"] == ["v00010", "v00011", "v00013", "v00014", "v00015"]
    near, _ = brute(np.delete(x.astype(np.float64), range(11, 30), 0), 5)
    alone = [i for i in range(50) if not 11 <= i < 30]
    for row, i in enumerate(alone):
        if i != 10 and 10 not in {alone[j] for j in near[row]}:
            assert by[f"v{i:05d}"] == [f"v{alone[j]:05d}" for j in near[row]]
    assert V.nearest(frame(spark, x).limit(0)).count() == 0


def test_deep_search_visits_best_leaves():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    f = V.Forest(x, 3, 9, 20, 1)  # the last level is wider than the dense part
    leaves, own = f.search(x[:200])
    assert leaves.shape == (200, 20) and (own.sum(1) == 3).all()
    for row in leaves:
        assert len(set(row.tolist())) == 20
