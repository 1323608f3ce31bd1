import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import blocks, clustering, evaluation, features, grid
from siltstone.operators.graph import components


def blobs(seed=0, n=60, centers=((0, 0), (8, 8))):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, 0.6, (n, len(c))) for c in centers])
    return x, np.repeat(np.arange(len(centers)), n)


@pytest.fixture(scope="module")
def points(spark):
    x, y = blobs()
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, tag long").repartition(3).cache()


def agrees(points, labelled):
    got = {r.id: r.cluster for r in labelled.collect()}
    want = {r.id: r.tag for r in points.collect()}
    assert set(got) == set(want)
    same = sum(got[i] == want[i] for i in want)
    return max(same, len(want) - same) == len(want)


def test_each_method_separates_two_blobs(points):
    C = clustering
    assert agrees(points, C.kmeans(points))
    assert agrees(points, C.gmm(points))
    assert agrees(points, C.spherical_gmm(points))
    assert agrees(points, C.fuzzy_cmeans(points)[0])
    assert agrees(points, C.kmedoids(points))
    assert agrees(points, C.agglomerative(points))
    assert agrees(points, C.bisecting(points))
    assert agrees(points, C.mean_shift(points, 3.0))
    assert agrees(points, C.dbscan(points, 2.0, 4))
    assert agrees(points, C.cann_centers(points))


def test_gustafson_kessel(points):
    labelled, fpc = clustering.gustafson_kessel(points)
    assert agrees(points, labelled) and 0.5 < fpc <= 1


def test_searches(points):
    assert agrees(points, clustering.ymeans(points, range(2, 4)))
    assert len({r.cluster for r in clustering.gmeans(points, 4).collect()}) >= 2
    costs = {r.k: r.cost for r in clustering.elbow(points, range(1, 4)).collect()}
    x, _ = blobs()
    assert abs(costs[1] - ((x - x.mean(0)) ** 2).sum()) < 1e-6 and costs[1] > costs[2]


def test_neural_gas_covers_both(points):
    got = {r.id: r.cluster for r in clustering.neural_gas(points, nodes=6, epochs=5).collect()}
    tags = {r.id: r.tag for r in points.collect()}
    by = {}
    for i, c in got.items():
        by.setdefault(c, set()).add(tags[i])
    assert len(by) > 1 and all(len(t) == 1 for t in by.values())


def test_memberships_add_up(points):
    labelled, centers = clustering.fuzzy_cmeans(points, 3)
    assert centers.shape == (3, 2)
    assert all(abs(sum(r.membership) - 1) < 1e-9 for r in labelled.collect())


def test_dbscan_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 6, (150, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    eps, least = 0.5, 5
    near = np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    number = {r: k for k, r in enumerate(sorted(set(label[core])))}
    want = [number[label[i]] if core[i] else min([number[label[j]] for j in np.flatnonzero(near[i] & core)], default=-1) for i in range(len(x))]
    got = {r.id: (r.cluster, r.core) for r in clustering.dbscan(df, eps, least).collect()}
    assert [got[i] for i in range(len(x))] == list(zip(want, core.tolist()))
    assert -1 in want and len(set(want)) > 3


def test_blocks_do_not_change_results(points):
    queries = points.where("id % 7 = 0")
    near = lambda b: sorted(tuple(r) for r in blocks.nearest(queries, points, 4, block=b).collect())
    assert near(10) == near(5000)
    x, _ = blobs()
    for q, n, _, d, r in near(10):
        order = np.sort(np.sqrt(((x - x[q]) ** 2).sum(1)))
        assert abs(order[r - 1] - d) < 1e-6
    assert sorted(map(tuple, blocks.within(points, 1.0, 17).collect())) == sorted(map(tuple, blocks.within(points, 1.0).collect()))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_cells_leave_out_blocks_but_no_neighbour(spark, metric):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (90, 3)) for c in ((0, 0, 0), (20, 0, 0), (0, 20, 0), (500, 500, 500))])
    x = np.vstack([x, np.repeat(x[:1], 140, 0)])  # one hot vector
    points = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, tag long").repartition(3).cache()
    d = np.abs(x[:, None] - x).sum(2) if metric == "manhattan" else np.sqrt(((x[:, None] - x) ** 2).sum(2))
    order = np.lexsort((np.tile(np.arange(len(x)), (len(x), 1)), np.round(d, 9)))[:, :6]
    got = {}
    for r in blocks.nearest(points, points, 6, metric, block=20, cells=13).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    assert got == {i: {j + 1: int(n) for j, n in enumerate(row)} for i, row in enumerate(order)}
    at = blocks.index(points, metric, block=20, cells=13)
    assert at.blocks.sum() >= len(x) // 20
    seen = blocks.blocked(points, at, lambda q, b: iter([q.select(["id"]).combine_chunks().to_batches()[0]]), "id long", F.lit(0.5)).count()
    assert seen < len(x) * at.blocks.sum() / 2  # queries far from a block never meet it
    assert sorted(map(tuple, blocks.within(points, 0.5, at=at).collect())) == [(i, int(n)) for i, n in enumerate((d <= 0.5).sum(1))] if metric == "euclidean" else True


def test_dbscan_over_cells(spark):
    x, _ = blobs(5, 80, ((0, 0), (5, 5), (40, 0)))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    want = sorted(map(tuple, clustering.dbscan(points, 0.5, 4).collect()))
    assert want == sorted(map(tuple, clustering.dbscan(points, 0.5, 4, block=16, cells=11).collect()))
    assert len({r[1] for r in want}) > 3


def test_blocks_over_no_rows(spark):
    none = spark.createDataFrame([], "id long, v array<double>, tag long")
    some = spark.createDataFrame([(1, [0.0], 0)], "id long, v array<double>, tag long")
    assert blocks.nearest(some, none, 2).count() == 0 and blocks.nearest(none, some, 2).count() == 0
    assert clustering.dbscan(none).count() == 0


def test_votes(points):
    assert agrees(points, clustering.knn_vote(points, points, 3).withColumnRenamed("prediction", "cluster"))
    first = {r.id: r.prediction for r in clustering.least_neighbour(points, points, 5).collect()}
    assert all(p <= i for i, p in first.items())


def test_silhouette_by_brute_force(points):
    x, y = blobs()
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = {}
    for i in range(len(x)):
        a = d[i][y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = d[i][y != y[i]].mean()
        want[i] = (b - a) / max(a, b)
    named = points.withColumnRenamed("tag", "cluster")
    for block in (25, 4096):
        got = {r.id: r.s for r in evaluation.silhouette(named, block=block).collect()}
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert abs(evaluation.silhouette_score(named).first()[0] - np.mean(list(want.values()))) < 1e-6
    assert evaluation.silhouette_score(named, sample=30).first()[0] > 0.5


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 10), (3, 3), (None, 4)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys([1, 2, 3], 1), **dict.fromkeys([8, 9, 10], 8), **dict.fromkeys(range(100, 141), 100)}
    assert components(edges.limit(0)).count() == 0


def test_ward_merges_the_close_ones():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [5.2]])
    assert clustering.ward(x, 2).tolist() in ([0, 0, 1, 1, 1], [1, 1, 0, 0, 0])


def test_features(spark):
    df = spark.createDataFrame([(1, "x", 1.0, 5.0, 1), (2, "y", 3.0, 5.0, 0), (3, None, float("inf"), 5.0, 1)], "id int, kind string, a double, c double, flag int")
    spec = features.FeatureSpec((features.Block("onehot", ("kind",)), features.Block("scale", ("a", "c")), features.Block("plain", ("flag",))))
    got = {r.id: r.v for r in features.build(df, spec, "id").collect()}
    assert got == {1: [1, 0, -1, 0, 1], 2: [0, 1, 1, 0, 0], 3: [0, 0, 0, 0, 1]}


def test_pca_is_centred_and_signed(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, [5, 1, 0.1], (200, 3)) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    p = np.array([r.v for r in features.pca(df, 2).orderBy("id").collect()])
    assert np.abs(p.mean(0)).max() < 1e-8
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    vt = vt[:2] * np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(1)])[:, None]
    assert np.allclose(p, (x - x.mean(0)) @ vt.T, atol=1e-6)


def test_digitize_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 8.9, 9.0])], "id long, v array<double>")
    assert df.select(features.digitize(df.v, 0, 9)).first()[0] == [1, 2, 9, 10]


def test_graph_embedding(spark):
    rows = [(i, f"h{i % 5}", f"h{(i * 3 + 1) % 7}", i) for i in range(30)]
    graph = features.edges(spark.createDataFrame(rows, "o int, a string, b string, w int"), "a", "b", "o", ["w"])
    last = {}
    for o, a, b, w in rows:
        last[min(a, b), max(a, b)] = w
    assert {(r.src, r.dst): r.w for r in graph.collect()} == last
    walks = [r.walk for r in features.random_walks(graph, 5, 2).collect()]
    pairs = {frozenset(e) for e in last}
    assert walks and all(len(w) == 5 and all(frozenset(e) in pairs for e in zip(w, w[1:])) for w in walks)
    assert len(features.node_embeddings(graph, 4, 5, 2).first().v) == 4


def test_grid_rules(spark):
    rows = [(i, [0.0 if i % 2 else 9.0, 4.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {r.cluster for r in grid.grid_clusters(df, 0.4).collect()} <= {0, 1, -1}
    assert {r.cluster for r in grid.grid_clusters(df, 0.99).collect()} == {-1}


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 2), (1, -1), (0, None)], "label int, cluster int")
    got = {(r.metric, r.average): r.value for r in evaluation.scores(evaluation.contingency(df, "label", "cluster")).collect()}
    assert got["accuracy", "macro"] == 0.5 and got["precision", "micro"] == 0.5
    assert abs(got["precision", "macro"] - (0.5 + 1 + 0) / 3) < 1e-12 and abs(got["recall", "weighted"] - 0.5) < 1e-12
    assert abs(got["jaccard", "micro"] - 0.5 / 1.5) < 1e-12
    both = evaluation.original_and_adjusted(df)
    assert {r.variant for r in both.collect()} == {"Original", "Adjusted"}
    assert len(evaluation.wide(both).columns) == 7
    assert evaluation.rand_index(evaluation.contingency(df.where("cluster = label"), "label", "cluster")).first()[0] == 1.0


def test_attention_stand_in(points):
    scored = clustering.attention_score(points.withColumnRenamed("tag", "label"))
    assert all((r.v[0] > 0.5) == (r.label == 1) for r in scored.collect())


def test_sequence_codes_read_whole_sequences_in_event_order(spark, tmp_path):
    import datetime as dt

    from siltstone.plans import relational

    rng = np.random.default_rng(8)
    seqs = [rng.normal(size=n) for n in (12, 30, 9, 21, 30, 17, 25)]
    rows = [(100 * u + i, u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for u, xs in enumerate(seqs) for i, v in enumerate(xs)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    m = np.array([np.r_[xs, np.zeros(30 - len(xs))] for xs in seqs])
    m = m - m.mean(0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    got = np.array([list(r)[1:] for r in sorted(relational.sequence_codes(spark, str(tmp_path)).collect())])
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * s[:4]), atol=1e-5)


def test_normality_reads_all_rows(spark):
    rng = np.random.default_rng(4)
    x = {0: rng.normal(size=5000), 1: rng.gamma(9.0, size=7000), 2: np.ones(40)}
    df = spark.createDataFrame([(c, float(v)) for c, xs in x.items() for v in xs], "cluster int, x double")
    got = clustering.normality(df, 7)
    for c, xs in x.items():
        assert got[c][0] == len(xs) and abs(got[c][1] - clustering.anderson_darling(xs)) < 1e-6 * max(1, got[c][1])


def test_registered_searches_go_up_to_ten(spark, monkeypatch):
    from siltstone.plans import relational

    monkeypatch.setattr(relational, "_points", lambda spark, sf_dir: "points")
    seen = []
    monkeypatch.setattr(clustering, "by_silhouette", lambda points, fit, ks: seen.append(ks))
    relational.ymeans(spark, "")
    monkeypatch.setattr(clustering, "gmeans", lambda points, most_clusters=10: seen.append(most_clusters))
    relational.gmeans(spark, "")
    assert seen == [range(2, 11), 10]


def test_scratch_tables_go_with_their_step(spark):
    from pathlib import Path

    from siltstone.operators.graph import cut, release_all, scratch

    there = lambda df: Path(df._siltstone_path.removeprefix("file://")).exists()
    outer = cut(spark.range(3))
    with scratch(spark) as keep:
        inner, kept = cut(spark.range(4)), keep(cut(spark.range(5)))
    assert there(outer) and not there(inner) and kept.count() == 5
    release_all(spark)
    assert not there(outer) and not there(kept)
