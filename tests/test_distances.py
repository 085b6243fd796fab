"""Distance operators against brute-force NumPy implementations."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.operators import dbscan as DB
from faultline.operators import pairwise as PW
from faultline.operators.distances import block_dists, dists


def brute_dbscan(X, eps, min_samples):
    """Sequential lowest-row-first DBSCAN (the reference's labelling)."""
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = D <= eps
    core = nb.sum(1) >= min_samples
    lab = -np.ones(n, dtype=int)
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = c
        stack = [i]
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in np.nonzero(nb[j])[0]:
                if lab[k] == -1:
                    lab[k] = c
                    stack.append(k)
        c += 1
    return lab


def frame(spark, X):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "row_id long, features array<double>")


def blobs(seed, n=120, d=2):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-3, 3, size=(4, d))
    X = np.concatenate([c + rng.normal(0, 0.25, size=(n // 4, d)) for c in centers])
    return np.round(np.concatenate([X, rng.uniform(-4, 4, size=(n // 6, d))]), 6)


@pytest.mark.parametrize("seed,d,block", [(1, 2, 2048), (2, 3, 16), (3, 5, 7)])
def test_dbscan_matches_brute_force(spark, seed, d, block):
    X = blobs(seed, d=d)
    eps = 0.37 + 0.01 * seed
    got = DB.dbscan(frame(spark, X), eps, 5, block_rows=block).orderBy("row_id").collect()
    assert [r.cluster for r in got] == list(brute_dbscan(X, eps, 5))


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=10, max_value=60), st.integers(min_value=0, max_value=10_000))
def test_dbscan_property(spark, n, seed):
    rng = np.random.default_rng(seed)
    X = np.round(rng.normal(0, 1, size=(n, 2)), 4)
    got = DB.dbscan(frame(spark, X), 0.45, 3, block_rows=8).orderBy("row_id").collect()
    assert [r.cluster for r in got] == list(brute_dbscan(X, 0.45, 3))


def test_connected_components_chain(spark):
    # a long chain plus a separate pair and an isolated vertex
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101)]
    e = spark.createDataFrame(edges, "src long, dst long")
    v = spark.createDataFrame([(i,) for i in list(range(41)) + [100, 101, 200]], "id long")
    comp = {r.id: r.component for r in DB.connected_components(v, e).collect()}
    assert all(comp[i] == 0 for i in range(41))
    assert comp[100] == 100 and comp[101] == 100 and comp[200] == 200


def test_neighbour_counts(spark):
    X = blobs(5)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    want = (D <= 0.4).sum(1)
    got = {r.row_id: r.n_neighbours for r in PW.neighbour_counts(frame(spark, X), 0.4, block_rows=9).collect()}
    assert [got[i] for i in range(len(X))] == list(want)


def test_kth_neighbour_and_knee(spark):
    X = blobs(7)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    kd = np.sort(D, axis=1)[:, 4]
    got = {r.row_id: r.k_distance for r in PW.kth_neighbour(frame(spark, X), 5, block_rows=13).collect()}
    assert np.allclose([got[i] for i in range(len(X))], kd)
    # knee on all rows (sample larger than the data)
    s = np.sort(kd)
    n = len(s)
    line = np.array([n - 1, s[-1] - s[0]])
    # |2-D cross product| of the chord with (first point - point), over the chord length
    dist = [abs(line[0] * (s[0] - v) - line[1] * (0 - i)) / np.linalg.norm(line) for i, v in enumerate(s)]
    want = float(s[int(np.argmax(dist))])
    want = 0.5 if want < 0.1 else want
    got_eps = PW.find_eps(frame(spark, X), 5, 1000).first().eps
    assert got_eps == pytest.approx(want)


def brute_silhouette(X, lab):
    m = lab >= 0
    X, lab = X[m], lab[m]
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def brute_db(X, lab):
    m = lab >= 0
    X, lab = X[m], lab[m]
    ks = sorted(set(lab))
    C = np.array([X[lab == k].mean(0) for k in ks])
    S = np.array([np.linalg.norm(X[lab == k] - C[i], axis=1).mean() for i, k in enumerate(ks)])
    Dc = np.linalg.norm(C[:, None] - C[None], axis=-1)
    Dc[Dc == 0] = np.inf
    return float(np.mean(np.max((S[:, None] + S[None]) / Dc, axis=1)))


def test_silhouette_and_davies_bouldin(spark):
    X = blobs(11, d=3)
    lab = brute_dbscan(X, 0.5, 5)
    lab[3] = 7  # a singleton cluster scores 0
    df = frame(spark, X).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "row_id long, cluster int"),
                              "row_id")
    assert PW.silhouette(df, block_rows=17).first().silhouette == pytest.approx(brute_silhouette(X, lab), abs=1e-12)
    assert PW.davies_bouldin(df, block_rows=3).first().davies_bouldin == pytest.approx(brute_db(X, lab), abs=1e-12)


def test_silhouette_needs_two_clusters(spark):
    df = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [5.0], -1)], "row_id long, features array<double>, cluster int")
    assert PW.silhouette(df).first().silhouette is None
    assert PW.davies_bouldin(df).first().davies_bouldin is None


@pytest.mark.parametrize("seed,d,eps,m,block", [(1, 2, 0.3, 5, 16), (2, 2, 1.2, 8, 16), (3, 3, 0.35, 4, 9), (4, 1, 0.2, 3, 8), (5, 2, 1.2, 40, 6)])
def test_dbscan_dense_cells_copies_and_negative_ids(spark, seed, d, eps, m, block):
    rng = np.random.default_rng(seed)
    X = np.concatenate([blobs(seed, 200, d), np.repeat([[9.0] * d], 40, 0), np.repeat([[9.2] * d], 3, 0), rng.normal(0, 1e-3, (80, d))]).round(4)
    X = X[rng.permutation(len(X))]
    df = frame(spark, X).withColumn("row_id", F.col("row_id") - 100)
    got = DB.dbscan(df, eps, m, block_rows=block).orderBy("row_id").collect()
    assert [r.cluster for r in got] == list(brute_dbscan(X, eps, m))


def test_dbscan_narrow_cells_far_from_one_another(spark):
    """Leaves that are settled by a cell whose own points are not core."""
    X = np.concatenate([[[0.0, 0.0]] * 3, [[0.9, 0.0]] * 2, [[0.45, 0.0]], [[1.8, 0.0]]])
    for m, block in ((3, 1), (3, 2), (5, 2)):
        got = DB.dbscan(frame(spark, X), 1.0, m, block_rows=block).orderBy("row_id").collect()
        assert [r.cluster for r in got] == list(brute_dbscan(X, 1.0, m)), (m, block)


def test_work_is_linear_when_one_spot_holds_a_third(spark):
    """Leaf pairs that are counted or measured grow with the rows, not with their square."""
    rng = np.random.default_rng(4)
    pairs = []
    for n in (1200, 4800):
        X = np.concatenate([rng.normal(0, 0.05, (n // 3, 2)), rng.uniform(-n ** 0.5 / 10, n ** 0.5 / 10, (2 * n // 3, 2))])
        sent = {}
        DB.dbscan(frame(spark, X), 0.5, 5, block_rows=32, sent=sent).count()
        pairs.append(sent["counted"] + sent["measured"])
    assert pairs[1] < 6 * pairs[0]


def test_kth_neighbour_candidates_do_not_grow_on_clustered_rows(spark):
    rng = np.random.default_rng(6)
    per_row = []
    for n in (1000, 4000):
        centers = rng.uniform(-50, 50, (n // 50, 3))
        X = (centers[:, None] + rng.normal(0, 0.2, (n // 50, 50, 3))).reshape(-1, 3)
        rings = []
        got = {r.row_id: r.k_distance for r in PW.kth_neighbour(frame(spark, X), 5, block_rows=64, rings=rings).collect()}
        if n == 1000:
            D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
            assert np.allclose([got[i] for i in range(n)], np.sort(D, axis=1)[:, 4])
        per_row.append(sum(r["points"] for r in rings) / n)
    assert per_row[1] < 2 * per_row[0] + 1


def test_kth_neighbour_copies_few_rows_and_no_rows(spark):
    X = np.repeat([[1.0, 2.0], [3.0, 4.0], [3.0, 4.5]], [6, 2, 1], axis=0)
    got = {r.row_id: r.k_distance for r in PW.kth_neighbour(frame(spark, X), 3, block_rows=2).collect()}
    assert [got[i] for i in range(9)] == [0.0] * 6 + [0.5] * 2 + [0.5]
    assert [r.k_distance for r in PW.kth_neighbour(frame(spark, X[6:]), 5).collect()] == [None] * 3
    none = frame(spark, X).filter("row_id < 0")
    assert PW.kth_neighbour(none, 3).count() == PW.neighbour_counts(none, 1.0).count() == DB.dbscan(none, 1.0).count() == 0


def test_eps_of_a_sample(spark):
    """M3 on the reference's terms: at most ``max_samples`` rows, the same at every call."""
    X = blobs(3, 400)
    df = frame(spark, X)
    picked = sorted(r.row_id for r in PW.sample_rows(df, "row_id", 100).collect())
    assert len(picked) == 100 and picked == sorted(r.row_id for r in PW.sample_rows(df.repartition(5), "row_id", 100).collect())
    D = np.sqrt(((X[picked][:, None] - X[picked][None]) ** 2).sum(-1))
    raw = PW.find_eps(df, 5, 100).first()
    assert raw.n_points == 100 and np.isclose(np.sort(D, axis=1)[:, 4], raw.eps_raw).any()


def test_block_distances_keep_their_digits():
    rng = np.random.default_rng(9)
    for d in (1, 2, 6, 64):
        x, y = rng.normal(1e4, 1, (40, d)), rng.normal(1e4, 1, (70, d))
        y[:5], y[5:9] = x[:5], x[5:9] + 1e-7
        assert np.allclose(block_dists(x, y), dists(x, y), rtol=1e-8, atol=0)
    assert block_dists(np.full((3, 2), 7.5), np.full((4, 2), 7.5)).max() == 0


def test_points_leave_a_tile_with_few_numbers_however_many_clusters():
    rng = np.random.default_rng(10)
    for k in (4, 100):
        pdf = pd.DataFrame({"pid": np.arange(400), "cl": np.repeat(np.arange(k), 400 // k), "vec": list(rng.normal(size=(400, 2))),
                            "w": 1, "c": 400 // k, "m": 1, "cut": False})
        left, right = PW.Points(pdf[:200]), PW.Points(pdf[200:])
        PW.measure(left, right, True, 37)
        assert sum(len(t) for side in (left, right) for t in side.rows()) == 400


@pytest.mark.parametrize("n_bands", [1, 2, 7, None])
def test_silhouette_of_repeated_points_and_cut_clusters(spark, n_bands):
    rng = np.random.default_rng(11)
    X = rng.integers(0, 6, (150, 2)).astype(float)  # most points come more than once, some in several clusters
    lab = rng.choice([-1, 0, 1, 2, 3], 150, p=[0.1, 0.6, 0.2, 0.05, 0.05])
    df = frame(spark, X).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "row_id long, cluster int"), "row_id")
    assert PW.silhouette(df, block_rows=19, n_bands=n_bands).first().silhouette == pytest.approx(brute_silhouette(X, lab), abs=1e-12)


@pytest.mark.parametrize("n_bands", [1, 5])
def test_silhouette_leaves_out_missing_distances(spark, n_bands):
    """As the SQL: a distance to a point with a missing entry adds nothing, the point counts in its cluster's size."""
    X = [[0.0], [1.0], [None], [4.0], [6.0], [None]]
    lab = [0, 0, 0, 1, 1, 2]
    df = spark.createDataFrame(list(zip(range(6), X, lab)), "row_id long, features array<double>, cluster int")
    a, b = [1 / 2, 1 / 2, 2 / 1, 2 / 1], [10 / 2, 8 / 2, 7 / 3, 11 / 3]
    want = sum((q - p) / max(p, q) for p, q in zip(a, b)) / 6
    assert PW.silhouette(df, n_bands=n_bands).first().silhouette == pytest.approx(want)


def test_each_row_goes_to_a_fixed_number_of_tiles(spark):
    assert [PW.bands(t) * (PW.bands(t) + 1) // 2 >= 2 * t for t in (1, 8, 200)] == [True] * 3
    for n in (50, 500):
        got = PW.tiles(spark.range(n), "id", 6).groupBy("id").count().select("count").distinct().collect()
        assert [r[0] for r in got] == [6]


def test_distances_by_products_are_those_by_differences():
    from faultline.operators.distances import smallest_sq, sq_dists, within
    rng = np.random.default_rng(11)
    for d in (1, 2, 6, 64):
        a = np.round(rng.normal(size=(60, d)), 1) + 5
        b = np.concatenate([a[:20], np.round(rng.normal(size=(80, d)), 1) + 5])
        s = sq_dists(a, b)
        for limit in np.quantile(s, [0.01, 0.3, 0.9]):  # distances that occur: ties with the limit
            assert (within(a, b, limit) == (s <= limit)).all()
        i, j, got = smallest_sq(a, b, 5)
        assert (got == s[i, j]).all()
        assert all((got[i == r][:5] == np.sort(s[r])[:5]).all() for r in range(len(a)))


def test_missing_entries_bound_no_leaf():
    from faultline.operators.metric_tree import Leaf
    q = Leaf({"vec": np.array([[0.0, 0.0]]), "refd": np.array([[0.0]])})
    p = Leaf({"vec": np.array([[3.0, 4.0], [np.nan, 0.0]]), "refd": np.array([[5.0], [np.nan]])})
    assert np.allclose(q.gap_to(p), [5.0])


def test_links_of_a_table_make_parts():
    rows, columns = DB._parts(np.array([[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]], bool))
    assert rows.tolist() == [0, 0, 1, -1] and columns.tolist() == [0, 0, -1, 1]


def test_a_split_fills_its_leaves(spark):
    from faultline.operators.metric_tree import build
    tree = build(frame(spark, np.random.default_rng(3).normal(size=(300, 3))), block_rows=256)
    assert tree.nodes.filter("is_leaf").count() <= 8


def test_leaf_bound_takes_the_box_around_the_other_points():
    """A long thin leaf is far from a point beside it, and the bound is below every distance."""
    from faultline.operators.metric_tree import Leaf
    rng = np.random.default_rng(9)
    y = rng.normal(0, 1, (60, 3)) * [5.0, 0.1, 0.1]
    x = np.concatenate([rng.normal(0, 3, (40, 3)), [[0.0, 3.0, 0.0], [np.nan, 0.0, 0.0]]])
    refs = np.zeros((1, 3))

    def leaf(v):
        return Leaf({"vec": v, "refd": np.sqrt(((v[:, None] - refs) ** 2).sum(-1))})
    gap = leaf(x).gap_to(leaf(y))
    least = np.sqrt(((x[:-1, None] - y) ** 2).sum(-1)).min(axis=1)
    assert (np.nan_to_num(gap[:-1]) <= least * (1 + 1e-12)).all()
    assert gap[-2] > 2.5


def test_only_points_that_may_matter_travel(spark, monkeypatch):
    """a leaf's points are sifted before they travel, leaf pairs lie on disk a part at a time, spent tables are deleted."""
    from faultline import session
    from faultline.operators import metric_tree as MT
    rng = np.random.default_rng(21)
    X = np.concatenate([rng.normal(c, 0.4, (150, 3)) for c in (0.0, 3.0, 6.0, 9.0)])
    df = frame(spark, X)
    sent, write = [], MT.materialize

    def written(t):
        t = write(t)
        if t.columns == ["target", "leaf", "n", "block"]:
            sent.append(t.agg(F.sum("n")).first()[0] or 0)
        return t
    monkeypatch.setattr(MT, "materialize", written)
    D = np.sort(np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)), axis=1)
    for pairs in (50_000, 100):  # all leaf pairs at once, and some parts
        monkeypatch.setattr(MT, "PAIRS", pairs)
        sent.clear()
        before = len(session._WRITTEN)
        rings = []
        got = MT.kth_neighbour(df, 5, block_rows=40, rings=rings).toPandas().sort_values("row_id")["k_distance"].to_numpy()
        assert np.allclose(got, D[:, 4], atol=1e-12)
        assert sent and sum(sent) == sum(r["points"] for r in rings) < 0.5 * len(X) * 20
        assert len(sent) > len(rings) if pairs == 100 else len(sent) == len(rings)
        left = [w for w in session._WRITTEN[before:]]
        assert len(left) <= 12
    tree = MT.build(df, block_rows=40)
    assert len({f.rsplit("/", 2)[1] for f in tree.points.inputFiles()}) == 1
