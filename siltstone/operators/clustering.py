"""Clustering of points (id long, v array<double>); results are (id, cluster).

Iterative methods keep their model (centers, covariances, weights: a few numbers a cluster) on the driver. One pass an iteration
sums what the next model needs: each task adds up its rows in numpy and gives back one vector of sums, and those are added by
place in the cluster, so the driver gets one number a model entry whatever the rows were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import blocks, evaluation
from siltstone.operators.features import distance, literal
from siltstone.operators.graph import components, cut

#: Rows that models fitted on the driver see at most (initial centers, neural gas, Ward, bandwidths).
SAMPLE = 2000


def sample(points: DataFrame, most: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """At most ``most`` rows, those of least hash, in id order."""
    rows = points.select("id", "v").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["id"])], float)


def summed(points: DataFrame, size: int, run: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``run`` over all rows; run takes a matrix of rows and gives ``size`` sums."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += run(blocks.matrix(pa.Table.from_batches([batch])))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "x"])

    got = points.select("v").mapInArrow(go, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["at"]] = r["x"]
    return out


def spread_centers(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Initial centers of a sample, each drawn in proportion to its squared distance from the others."""
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    while len(out) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in out], axis=0)
        out.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(out)


def nearest_center(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``points`` with the number of the nearest center, the first one on ties."""
    d = F.transform(literal(centers), lambda c: distance(F.col("v"), c))
    return points.withColumn("cluster", (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def _vectors(points: DataFrame) -> DataFrame:
    return points.withColumn("features", array_to_vector("v"))


def _labelled(model, points: DataFrame) -> DataFrame:  # noqa: ANN001
    return model.transform(_vectors(points)).select("id", F.col("prediction").cast("int").alias("cluster"))


def kmeans_model(points: DataFrame, k: int, seed: int = 42, n_init: int = 1):  # noqa: ANN201
    """The model of least cost among ``n_init`` seeds."""
    rows = _vectors(points).select("features").persist()
    try:
        models = [KMeans(k=k, seed=seed + i, maxIter=100, tol=1e-4).fit(rows) for i in range(n_init)]
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()


def kmeans(points: DataFrame, k: int = 2, seed: int = 42, n_init: int = 1) -> DataFrame:
    return _labelled(kmeans_model(points, k, seed, n_init), points)


def elbow(points: DataFrame, ks: range = range(1, 11), seed: int = 42) -> DataFrame:
    """(k, cost)."""
    one = summed(points, 1 + 2 * len(points.first()["v"]), lambda x: np.r_[len(x), x.sum(0), (x * x).sum(0)])
    half = (len(one) + 1) // 2
    alone = float((one[half:] - one[1:half] ** 2 / max(one[0], 1)).sum())  # one cluster: the deviation from the mean
    rows = [(k, float(kmeans_model(points, k, seed).summary.trainingCost) if k > 1 else alone) for k in ks]
    return points.sparkSession.createDataFrame(rows, "k int, cost double")


def by_silhouette(points: DataFrame, fit: Callable[[int], DataFrame], ks: range = range(2, 11)) -> DataFrame:
    """The clusters of the k with the greatest silhouette, the first one on ties."""
    found, top = None, -2.0
    for k in ks:
        labelled = cut(fit(k))
        score = evaluation.silhouette_score(points.join(labelled, "id").select("id", "v", "cluster")).first()[0]
        if score is not None and score > top:
            found, top = labelled, score
    return found if found is not None else fit(1)


def ymeans(points: DataFrame, ks: range = range(2, 11), seed: int = 42, n_init: int = 1) -> DataFrame:
    return by_silhouette(points, lambda k: kmeans(points, k, seed, n_init), ks)


def gmm(points: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    return _labelled(GaussianMixture(k=k, seed=seed, maxIter=300, tol=1e-4).fit(_vectors(points)), points)


def gmm_search(points: DataFrame, ks: range = range(2, 11), seed: int = 42) -> DataFrame:
    return by_silhouette(points, lambda k: gmm(points, k, seed), ks)


def spherical_gmm(points: DataFrame, k: int = 2, seed: int = 42, iterations: int = 100, tol: float = 1e-4) -> DataFrame:
    """Expectation-maximization with one variance a component."""
    first = sample(points, seed=seed)
    d = first.shape[1]
    mu, var, pi = spread_centers(first, k, seed), np.full(k, max(first.var(), 1e-6)), np.full(k, 1 / k)

    def logs(x: np.ndarray) -> np.ndarray:
        square = ((x[:, None, :] - mu) ** 2).sum(2)
        return np.log(pi) - d / 2 * np.log(2 * np.pi * var) - square / (2 * var)

    last = -np.inf
    for _ in range(iterations):

        def run(x: np.ndarray) -> np.ndarray:
            p = logs(x)
            top = p.max(1, keepdims=True)
            r = np.exp(p - top)
            total = r.sum(1, keepdims=True)
            r /= total
            return np.r_[(top[:, 0] + np.log(total[:, 0])).sum(), len(x), r.sum(0), (r.T @ x).ravel(), r.T @ (x * x).sum(1)]

        s = summed(points, 2 + k + k * d + k, run)
        n, w, sx, sq = s[1], np.maximum(s[2 : 2 + k], 1e-12), s[2 + k : 2 + k + k * d].reshape(k, d), s[2 + k + k * d :]
        mu = sx / w[:, None]
        var = np.maximum((sq - w * (mu * mu).sum(1)) / (w * d), 1e-6)
        pi = w / n
        if abs(s[0] / n - last) < tol:
            break
        last = s[0] / n
    square = F.transform(literal(mu), lambda c: F.pow(distance(F.col("v"), c), 2))
    odds = F.transform(square, lambda q, i: F.get(literal(np.log(pi) - d / 2 * np.log(2 * np.pi * var))[0], i) - q / F.get(literal(2 * var)[0], i))
    return points.select("id", (F.array_position(odds, F.array_max(odds)) - 1).cast("int").alias("cluster"))


def memberships(v: Column, centers: np.ndarray, m: float = 2.0) -> Column:
    """array<double>: fuzzy memberships from distances to the centers."""
    d = F.transform(literal(centers), lambda c: F.greatest(distance(v, c), F.lit(float(np.finfo(float).eps))))
    power = F.transform(d, lambda x: F.pow(x, -2.0 / (m - 1)))
    return F.transform(power, lambda x: x / F.aggregate(power, F.lit(0.0), lambda s, y: s + y))


def _fuzzy(x: np.ndarray, d: np.ndarray, m: float) -> np.ndarray:
    w = np.maximum(d, np.finfo(float).eps) ** (-2 / (m - 1))
    return w / w.sum(1, keepdims=True)


def fcm_step(points: DataFrame, centers: np.ndarray, m: float = 2.0) -> np.ndarray:
    """One update of the fuzzy centers."""
    c, d = centers.shape

    def run(x: np.ndarray) -> np.ndarray:
        u = _fuzzy(x, blocks.distances(x, centers), m) ** m
        return np.r_[u.sum(0), (u.T @ x).ravel()]

    s = summed(points, c + c * d, run)
    return s[c:].reshape(c, d) / np.maximum(s[:c], 1e-300)[:, None]


def fuzzy_cmeans(points: DataFrame, c: int = 2, m: float = 2.0, error: float = 0.005, iterations: int = 1000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, membership) by greatest membership, and the centers. It stops when memberships move by less than ``error``."""
    centers = spread_centers(sample(points, seed=seed), c, seed)
    for _ in range(iterations):
        new = fcm_step(points, centers, m)
        old, centers = centers, new
        moved = summed(points, 1, lambda x, a=old, b=new: np.array([((_fuzzy(x, blocks.distances(x, a), m) - _fuzzy(x, blocks.distances(x, b), m)) ** 2).sum()]))
        if np.sqrt(moved[0]) < error:
            break
    u = memberships(F.col("v"), centers, m)
    return points.select("id", u.alias("membership")).select("id", (F.array_position("membership", F.array_max("membership")) - 1).cast("int").alias("cluster"), "membership"), centers


def _mahalanobis(x: np.ndarray, centers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    diff = x[:, None, :] - centers
    return np.sqrt(np.maximum(np.einsum("ncd,cde,nce->nc", diff, inverse, diff), 0))


def gk_step(points: DataFrame, centers: np.ndarray, inverse: np.ndarray, m: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """New centers and volume-normalized covariances from the memberships of the given model."""
    c, d = centers.shape

    def means(x: np.ndarray) -> np.ndarray:
        u = _fuzzy(x, _mahalanobis(x, centers, inverse), m) ** m
        return np.r_[u.sum(0), (u.T @ x).ravel()]

    s = summed(points, c + c * d, means)
    weight = np.maximum(s[:c], 1e-300)
    new = s[c:].reshape(c, d) / weight[:, None]

    def outer(x: np.ndarray) -> np.ndarray:
        u = _fuzzy(x, _mahalanobis(x, centers, inverse), m) ** m
        diff = x[:, None, :] - new
        return np.einsum("nc,ncd,nce->cde", u, diff, diff).ravel()

    cov = summed(points, c * d * d, outer).reshape(c, d, d) / weight[:, None, None] + 1e-12 * np.eye(d)
    return new, cov / np.maximum(np.linalg.det(cov), 1e-300)[:, None, None] ** (1 / d)


def gustafson_kessel(points: DataFrame, c: int = 2, m: float = 2.0, error: float = 0.005, iterations: int = 1000, seed: int = 42) -> tuple[DataFrame, float]:
    """(id, cluster) under one volume-normalized covariance a cluster, and the fuzzy partition coefficient."""
    first = sample(points, seed=seed)
    centers, inverse = spread_centers(first, c, seed), np.stack([np.eye(first.shape[1])] * c)
    fpc = 0.0
    for _ in range(iterations):
        new, cov = gk_step(points, centers, inverse, m)
        turned = np.linalg.inv(cov)

        def change(x: np.ndarray, a=(centers, inverse), b=(new, turned)) -> np.ndarray:  # noqa: ANN001
            u, w = _fuzzy(x, _mahalanobis(x, *a), m), _fuzzy(x, _mahalanobis(x, *b), m)
            return np.array([((u - w) ** 2).sum(), (w**m).sum(), len(x)])

        moved = summed(points, 3, change)
        centers, inverse, fpc = new, turned, float(moved[1] / max(moved[2], 1))
        if np.sqrt(moved[0]) < error:
            break

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _mahalanobis(blocks.matrix(pa.Table.from_batches([batch])), centers, inverse)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.argmin(1).astype(np.int32))], names=["id", "cluster"])

    return points.select("id", "v").mapInArrow(label, "id long, cluster int"), fpc


def kmedoids(points: DataFrame, k: int = 2, metric: str = "euclidean", iterations: int = 20, seed: int = 42, first: list[int] | None = None) -> DataFrame:
    """Alternate nearest-medoid assignment and the point of least summed distance in each cluster (exact, in blocks)."""
    ids = first or [r["id"] for r in points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()]
    labelled = None
    for _ in range(iterations):
        medoids = {r["id"]: r["v"] for r in points.where(F.col("id").isin(ids)).dropDuplicates(["id"]).collect()}
        order = [i for i in ids if i in medoids]
        far = np.array([medoids[i] for i in order], float)
        if metric == "manhattan":
            d = F.transform(literal(far), lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))
        else:
            d = F.transform(literal(far), lambda c: distance(F.col("v"), c))
        labelled = cut(points.select("id", "v", (F.array_position(d, F.array_min(d)) - 1).cast("long").alias("tag")))
        sums = blocks.group_sums(labelled, labelled, metric)
        best = sums.join(labelled.select("id", F.col("tag").alias("own")), "id").where("tag = own").groupBy("tag").agg(F.min(F.struct(F.round("total", 9).alias("t"), "id")).alias("r"))
        new = [r["r"]["id"] for r in best.orderBy("tag").collect()]
        if sorted(new) == sorted(order):
            break
        ids = new
    return labelled.select("id", F.col("tag").cast("int").alias("cluster"))


def dbscan(points: DataFrame, eps: float = 0.5, min_points: int = 5, block: int | None = None, cells: int | None = None) -> DataFrame:
    """(id, cluster, core): noise is -1; clusters are numbered by their least core id; a border point takes the least cluster in reach.

    Points meet only blocks within ``eps`` (``blocks``); block and cells change the work, not the result.
    """
    rows = points.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(0).cast("long").alias("tag"))
    at = blocks.index(rows, cells=cells, block=block)
    counts = cut(blocks.within(rows, eps, at=at))
    core = counts.where(F.col("n") >= min_points).select("id")
    dense = at.rows.join(core, "id", "left_semi")
    roots = components(blocks.forest(dense, eps, at=at.over(dense))).select(F.col("node").alias("id"), "root")
    named = cut(core.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    numbers = named.groupBy("root").agg(F.count(F.lit(1)).alias("_")).select("root", (F.row_number().over(Window.orderBy("root")) - 1).alias("cluster"))  # a row a cluster
    named = cut(named.join(numbers, "root").select("id", F.col("cluster").cast("long").alias("cluster")))
    tagged = dense.join(named, "id").select("id", "v", "cell", F.col("cluster").alias("tag"))
    rest = rows.join(core, "id", "left_anti")

    def reach(q: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        d = blocks.distances(blocks.matrix(q), blocks.matrix(b)) <= eps
        tags = np.where(d, b.column("tag").to_numpy()[None, :], np.iinfo(np.int64).max).min(1)
        some = tags < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(q.column("id").to_numpy()[some]), pa.array(tags[some])], names=["id", "cluster"])

    border = blocks.blocked(rest, at.over(tagged), reach, "id long, cluster long", F.lit(eps)).groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = named.select("id", "cluster", F.lit(True).alias("core")).unionByName(border.select("id", "cluster", F.lit(False).alias("core")))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


def estimate_bandwidth(points: DataFrame, quantile: float = 0.2, most: int = 500, seed: int = 42) -> float:
    """Mean distance to the farthest of a sample's nearest ``quantile`` share."""
    x = sample(points, most, seed)
    d = np.sort(blocks.distances(x, x), axis=1)
    return float(d[:, max(1, int(len(x) * quantile)) - 1].mean())


def mean_shift_step(points: DataFrame, seeds: np.ndarray, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the points within the bandwidth of each seed, and their number; a seed without points stays."""
    k, d = seeds.shape

    def run(x: np.ndarray) -> np.ndarray:
        near = (blocks.distances(x, seeds) <= bandwidth).astype(float)
        return np.r_[near.sum(0), (near.T @ x).ravel()]

    s = summed(points, k + k * d, run)
    n = s[:k]
    return np.where(n[:, None] > 0, s[k:].reshape(k, d) / np.maximum(n, 1)[:, None], seeds), n


def mean_shift(points: DataFrame, bandwidth: float | None = None, iterations: int = 100, seed: int = 42, most_seeds: int = 100_000) -> DataFrame:
    """Flat-kernel modes from all occupied cells of a grid, merged within a bandwidth; nearest mode assigned.

    More than ``most_seeds`` occupied cells mean that the bandwidth is too small for the data, and are an error.
    """
    bandwidth = bandwidth or estimate_bandwidth(points, seed=seed)
    cell = F.transform("v", lambda x: F.round(x / bandwidth))
    cells = sorted(points.select(cell.alias("c")).distinct().limit(most_seeds + 1).collect())
    if len(cells) > most_seeds:
        raise ValueError(f"over {most_seeds} cells of bandwidth {bandwidth}")
    now = np.array([r["c"] for r in cells], float) * bandwidth
    for _ in range(iterations):
        new, n = mean_shift_step(points, now, bandwidth)
        if np.abs(new - now).max(initial=0) < 1e-3 * bandwidth:
            break
        now = new
    modes: list[np.ndarray] = []
    for i in sorted(range(len(new)), key=lambda i: (-n[i], tuple(new[i]))):
        if n[i] > 0 and all(np.linalg.norm(new[i] - c) > bandwidth for c in modes):
            modes.append(new[i])
    return nearest_center(points, np.array(modes) if modes else now[:1]).select("id", "cluster")


def anderson_darling(x: np.ndarray) -> float:
    """The statistic of normality with mean and deviation estimated."""
    n = len(x)
    s = x.std(ddof=1)
    if n < 8 or s == 0:
        return 0.0
    from math import erf

    z = np.sort((x - x.mean()) / s)
    p = np.clip([0.5 * (1 + erf(v / 2**0.5)) for v in z], 1e-15, 1 - 1e-15)
    i = np.arange(1, n + 1)
    return float(-n - ((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))).sum() / n)


def normality(rows: DataFrame, parts: int | None = None) -> dict[int, tuple[int, float]]:
    """Number and Anderson-Darling statistic of every cluster of (cluster, x), over all rows.

    The rows are sorted over all tasks; each task sums over its own ranks and the ranks before it are added afterwards, so a
    row a task and cluster reaches the driver.
    """
    from math import erf

    about = {r["cluster"]: (r["n"], r["m"], r["s"] or 0.0) for r in rows.groupBy("cluster").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()}
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cluster).tolist():
                n, m, s = about[c]
                if n < 8 or s == 0:
                    continue
                got = sums.setdefault(c, np.zeros(5))
                p = np.clip([0.5 * (1 + erf(v / 2**0.5)) for v in (x[cluster == c] - m) / s], 1e-15, 1 - 1e-15)
                rank = got[0] + np.arange(1, len(p) + 1)
                low, high = np.log(p), np.log(1 - p)
                got += [len(p), ((2 * rank - 1) * low).sum(), low.sum(), ((1 - 2 * rank) * high).sum(), high.sum()]
        place = TaskContext.get().partitionId()
        kept = [[c, place, *v.tolist()] for c, v in sums.items()]
        kinds = [pa.int32(), pa.int32()] + [pa.float64()] * 5
        columns = [pa.array([r[i] for r in kept], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "n", "a", "b", "c", "d"])

    ordered = rows.select(F.col("cluster").cast("int").alias("cluster"), "x").repartitionByRange(parts, "cluster", "x").sortWithinPartitions("cluster", "x")
    got = ordered.mapInArrow(run, "cluster int, place int, n double, a double, b double, c double, d double").collect()
    before: dict[int, float] = {}
    total: dict[int, float] = {}
    for r in sorted(got, key=lambda r: r["place"]):
        c, n, off = r["cluster"], about[r["cluster"]][0], before.get(r["cluster"], 0.0)
        total[c] = total.get(c, 0.0) + r["a"] + 2 * off * r["b"] + r["c"] + 2 * (n - off) * r["d"]
        before[c] = off + r["n"]
    return {c: (n, -n - total[c] / n if c in total else 0.0) for c, (n, _, _) in about.items()}


def gmeans(points: DataFrame, most_clusters: int = 10, seed: int = 42, critical: float = 0.787) -> DataFrame:
    """K-means with one cluster more for as long as some cluster's first coordinate is not Gaussian at five per cent.

    The test reads all rows of a cluster.
    """
    limit = lambda n: critical / (1 + 4 / n - 25 / n**2)
    k = 2
    while True:
        labelled = cut(kmeans(points, k, seed))
        if k >= most_clusters:
            return labelled
        found = normality(points.join(labelled, "id").select("cluster", F.col("v")[0].alias("x")))
        if all(a < limit(max(n, 8)) for n, a in found.values()):
            return labelled
        k += 1


def neural_gas(points: DataFrame, nodes: int = 50, epochs: int = 20, rate: float = 0.2, age: int = 50, seed: int = 42) -> DataFrame:
    """Growing neural gas learned on a bounded sample, then every point takes its nearest node."""
    return nearest_center(points, grow_gas(sample(points, seed=seed), nodes, epochs, rate, age, seed)).select("id", "cluster")


def grow_gas(x: np.ndarray, nodes: int, epochs: int, rate: float, age: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w = x[rng.choice(len(x), min(2, len(x)), replace=False)].copy()
    error, links = np.zeros(len(w)), {}
    step = 0
    every = max(1, len(x) * epochs // (2 * nodes))
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step += 1
            d = ((w - x[i]) ** 2).sum(1)
            if len(w) < 2:
                w[0] += rate * (x[i] - w[0])
                continue
            a, b = np.argsort(d, kind="stable")[:2].tolist()
            error[a] += d[a]
            w[a] += rate * (x[i] - w[a])
            for e in [e for e in links if a in e]:
                links[e] += 1
                other = e[0] if e[1] == a else e[1]
                w[other] += rate / 50 * (x[i] - w[other])
            links[min(a, b), max(a, b)] = 0
            links = {e: t for e, t in links.items() if t <= age}
            if step % every == 0 and len(w) < nodes:
                q = int(error.argmax())
                near = [e[0] if e[1] == q else e[1] for e in links if q in e]
                f = max(near, key=lambda n: error[n]) if near else int(np.argsort(((w - w[q]) ** 2).sum(1))[1])
                w = np.vstack([w, (w[q] + w[f]) / 2])
                error[[q, f]] /= 2
                error = np.append(error, error[q])
                links.pop((min(q, f), max(q, f)), None)
                links[q, len(w) - 1] = links[f, len(w) - 1] = 0
            error *= 0.995
    return w


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of bottom-up merging by least growth of variance."""
    n = len(x)
    size, centre, alive = np.ones(n), x.astype(float).copy(), np.ones(n, bool)
    label = np.arange(n)
    square = ((centre[:, None] - centre) ** 2).sum(2) / 2
    np.fill_diagonal(square, np.inf)
    for _ in range(n - k):
        i, j = divmod(int(square.argmin()), n)
        i, j = min(i, j), max(i, j)
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        d = size * size[i] / (size + size[i]) * ((centre - centre[i]) ** 2).sum(1)
        d[~alive] = np.inf
        d[i] = np.inf
        square[i], square[:, i] = d, d
        square[j], square[:, j] = np.inf, np.inf
    return np.unique(label, return_inverse=True)[1]


def agglomerative(points: DataFrame, k: int = 2, most: int = 500, seed: int = 42) -> DataFrame:
    """Ward clusters of a bounded sample; every point takes the nearest cluster's center."""
    x = sample(points, most, seed)
    labels = ward(x, min(k, len(x)))
    return nearest_center(points, np.array([x[labels == c].mean(0) for c in np.unique(labels)])).select("id", "cluster")


def bisecting(points: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    return _labelled(BisectingKMeans(k=k, seed=seed).fit(_vectors(points)), points)


def attention_score(points: DataFrame, label: str = "label", epochs: int = 5, seed: int = 42) -> DataFrame:
    """(id, v, label): a perceptron's score as a one-dimensional vector. It stands in for a network with attention over a batch."""
    d = len(points.first()["v"])
    rows = _vectors(points).withColumn("label", F.col(label).cast("double"))
    model = MultilayerPerceptronClassifier(layers=[d, 64, 32, 2], maxIter=epochs * 20, seed=seed).fit(rows)
    return model.transform(rows).select("id", F.array(vector_to_array("probability")[1]).alias("v"), F.col("label").cast("long").alias("label"))


def knn_vote(points: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(id, prediction): the most frequent tag among the k nearest, the least one on ties."""
    near = blocks.nearest(queries, points, k)
    votes = near.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min_by("tag", F.struct((-F.col("n")).alias("n"), "tag")).alias("prediction"))


def least_neighbour(points: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(id, prediction): the vote of k neighbours that each carry their own number: the least number."""
    return blocks.nearest(queries, points, k).groupBy("id").agg(F.min("neighbour").alias("prediction"))


def cann_centers(points: DataFrame, k: int = 2, neighbours: int = 5, iterations: int = 10, seed: int = 42) -> DataFrame:
    """K-means whose centers move to the mean of their points' nearest neighbours, until labels stay.

    Who is whose neighbour does not change, so the mean vector of each point's neighbours is taken once.
    """
    rows = points.select("id", "v", F.lit(0).cast("long").alias("tag"))
    near = blocks.nearest(rows, rows, neighbours).select("id", "neighbour")
    vectors = points.select(F.col("id").alias("neighbour"), F.col("v").alias("w"))
    d = len(points.first()["v"])
    means = near.join(vectors, "neighbour").groupBy("id").agg(F.array(*[F.avg(F.col("w")[i]) for i in range(d)]).alias("u"))
    both = cut(points.select("id", "v").join(means, "id"))
    labelled = cut(both.join(kmeans(points, k, seed), "id"))
    for _ in range(iterations):
        got = labelled.groupBy("cluster").agg(*[F.avg(F.col("u")[i]) for i in range(d)]).orderBy("cluster").collect()
        new = cut(nearest_center(both, np.array([list(r)[1:] for r in got], float)))
        moved = new.select("id", F.col("cluster").alias("c")).join(labelled.select("id", "cluster"), "id").where("c <> cluster").limit(1).count()
        labelled = new
        if not moved:
            break
    return labelled.select("id", "cluster")
