import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import topk, vantage

NAN, INF = float("nan"), float("inf")
ODD = [
    (0, [0.5, 0.25]), (20, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [NAN, 1.0]), (4, [INF, 1.0]), (5, [None, 1.0]),
    (6, [0.0, 0.0]), (7, [-0.3, 0.9]), (None, [1.0, 1.0]), (8, [0.25]), (9, []), (10, [0.5, 0.25]), (10, [0.5, 0.25]), (40, [-0.3, 0.9]),
]
SCHEMA = "id long, vector array<float>"


def by_hand(vectors, keep, score):
    """``vectors``: id to numbers."""
    out = {}
    for q in (i for i in vectors if i % 20 == 0):
        ranked = sorted(((-score(vectors[q], v), i) for i, v in vectors.items() if i != q))[:keep]
        out[q] = [(i, -s) for s, i in ranked]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def scaled(x):
    return np.floor(64 * np.asarray(x, float))


def padded(rows, width=2):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = np.array([*v, *[0.0] * (width - len(v))], np.float32).astype(float)
    return good


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_exact_top_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(parts)
    data = rng.integers(-3, 4, (400, 6)) / 4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = by_hand({i: scaled(v) for i, v in rows}, 20, lambda a, b: int(a @ b))
    assert found(topk.exact_top(vectors, "id % 20 = 0", 20, 64, parts)) == want


def test_exact_top_of_odd_rows(spark):
    vectors = spark.createDataFrame(ODD, SCHEMA)
    want = by_hand({i: scaled(v) for i, v in padded(ODD).items()}, 3, lambda a, b: int(a @ b))
    assert found(topk.exact_top(vectors, "id % 20 = 0", 3)) == want
    assert topk.exact_top(vectors.limit(0), "id % 20 = 0", 3).count() == 0
    assert topk.exact_top(vectors.filter("id = 9"), "id = 9", 3).count() == 0


def test_exact_top_sends_nothing_through_the_driver(spark, monkeypatch):
    """Query blocks are copied to all blocks, so the size of their file says nothing about the join."""
    plans = []

    def staged(df, label, write=topk.staged):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "staged", staged)
    monkeypatch.setattr("stallwise.llm.vectors.staged", staged)
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(300)]
    top = topk.exact_top(spark.createDataFrame(rows, SCHEMA), "id % 20 = 0", 3)
    plans.append(("ranked", top._jdf.queryExecution().executedPlan().toString()))
    assert {"asked", "query-blocks", "local-lists", "cutoffs", "nearest"} <= {label for label, _ in plans}
    assert not [label for label, plan in plans if "Broadcast" in plan]
    assert found(top) == by_hand({i: scaled(v) for i, v in rows}, 3, lambda a, b: int(a @ b))


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 8)
    monkeypatch.setattr(vantage, "SHARD_ROWS", 100)
    monkeypatch.setattr(vantage, "QUERY_ROWS", 9)
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(size=(400, 5)), np.repeat(rng.normal(size=(3, 5)), 40, 0)]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = by_hand({i: np.array(v) for i, v in rows}, 20, lambda a, b: float((a * b).sum()))
    got = found(vantage.nearest(vectors, "id % 20 = 0", 20, 1.0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in want for a, b in zip(got[q], want[q], strict=True))


def test_recall_with_pruning(spark):
    from stallwise.llm.queries import PRUNING, embeddings

    vectors = embeddings(spark, "/root/testdata/sf0.1")
    data = {r["id"]: np.array(r["vector"], float) for r in vectors.collect()}
    got = found(vantage.nearest(vectors, "id % 20 = 0", 20, PRUNING))
    ids = np.array(sorted(data))
    table = np.stack([data[i] for i in ids])
    hits = []
    for q, near in got.items():
        scores = np.where(ids == q, -np.inf, table @ data[q])
        hits.append(len({i for i, _ in near} & set(ids[np.argsort(-scores)[:20]])) / 20)
    assert len(hits) == sum(i % 20 == 0 for i in data) and np.mean(hits) >= 0.9


def test_nearest_of_odd_rows(spark):
    vectors = spark.createDataFrame(ODD, SCHEMA)
    good = {i: v for i, v in padded(ODD).items() if v.any()}
    got = found(vantage.nearest(vectors, "id % 20 = 0", 3))
    want = by_hand(good, 3, lambda a, b: float((a * b).sum()))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert vantage.nearest(vectors.limit(0), "id % 20 = 0", 3).count() == 0
    assert vantage.nearest(vectors.filter(F.col("id") == 6), "id = 6", 3).count() == 0


def tree_of(points):
    """A tree over ``points`` and the points in its order."""
    longest = np.sqrt((points**2).sum(1).max()) * (1 + 1e-12)
    order, nodes, paths = vantage.grown(vantage.lengthened(points, longest))
    return points[order], nodes, paths, longest


def test_most_points_need_no_score(spark):
    """The trees prune at the registered factor, factor one loses nothing."""
    from stallwise.llm.queries import PRUNING, embeddings

    data = np.array([r["vector"] for r in embeddings(spark, "/root/testdata/check_l").orderBy("id").filter("size(vector) = 64").collect() if np.isfinite(r["vector"]).all()])
    data = np.unique(data, axis=0)[: vantage.SHARD_ROWS]
    points, nodes, paths, longest = tree_of(data)
    wanted = points[:: len(points) // 100]
    best = np.sort(wanted @ points.T, 1)[:, -21:]
    shares, recalls = {}, {}
    for factor in (1.0, PRUNING):
        found = vantage.Search(points, nodes, paths, longest, wanted, 21, factor)
        shares[factor] = found.scored / len(wanted) / len(points)
        recalls[factor] = (found.scores >= best[:, :1] - 1e-12).mean()
        assert all(len(set(x)) == 21 for x in found.at)
        if factor == 1:
            assert np.allclose(np.sort(found.scores, 1), best, atol=1e-9)
    assert shares[PRUNING] < 0.75 and recalls[PRUNING] >= 0.9


def test_clustered_points_are_mostly_skipped():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 8))
    data = np.concatenate([c + rng.normal(scale=0.05, size=(100, 8)) for c in centres])
    points, nodes, paths, longest = tree_of(data)
    wanted = points[::60]
    found = vantage.Search(points, nodes, paths, longest, wanted, 10, 1.0)
    assert np.allclose(np.sort(found.scores, 1), np.sort(wanted @ points.T, 1)[:, -10:], atol=1e-9)
    assert found.scored < 0.5 * len(wanted) * len(points)


def test_tree_keeps_every_point():
    rng = np.random.default_rng(5)
    for points in (rng.normal(size=(1, 3)), rng.normal(size=(2000, 3)), np.ones((1500, 3))):
        order, nodes, paths = vantage.grown(points)
        assert sorted(order) == list(range(len(points))) and len(paths) == len(points)
        ranges = [(n["start"], n["end"] if n["inside"] < 0 else n["start"] + vantage.VANTAGES) for n in nodes]
        ranges.sort()
        assert ranges[0][0] == 0 and ranges[-1][1] == len(points)
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        d = np.sqrt(((points[order] - points[order[0]]) ** 2).sum(1))
        assert not paths.size or np.allclose(paths[:, 0], d, atol=1e-5)
