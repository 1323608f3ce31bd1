"""Exact comparison of vectors in blocks of bounded size; no pair is emitted.

Base rows lie in cells around pivots (a bounded sample of the rows), a cell of over ``block`` rows in several blocks. A query goes to
the blocks that can hold a row within its reach and to no other: by the triangle inequality a row of a cell is at least
``distance to the pivot - radius of the cell`` away, and at least half of what the pivot is farther than the nearest pivot. Base
rows are not copied but for pieces of QUERIES queries; queries are copied once a block that they visit. Where every row counts
(sums of distances), a query visits all blocks and the work is quadratic.

A task holds one block and a few queries, so memory is bounded and hot cells are cut; what leaves a task is a row or a few per
query (nearest k, sums, counts). The pivots decide the work only, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.graph import cut

BLOCK = 4096
#: Pivots at most; beyond BLOCK * CELLS rows a cell has several blocks.
CELLS = 4096
#: Queries that meet a block at once, and in one task at most.
CHUNK, QUERIES = 1024, 1 << 24

Run = Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    got = table.column(column).combine_chunks()
    return got.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(got), -1)


def by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """One table per run of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        fresh = np.zeros(batch.num_rows, bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = tuple(c[a] for c in columns)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class Index:
    """Base rows (id, v, tag, cell) with what tells which blocks a query must visit. Sizes and radii may be those of more rows."""

    rows: DataFrame
    size: np.ndarray
    block: int
    metric: str = "euclidean"
    pivots: np.ndarray | None = None
    radius: np.ndarray | None = None

    @property
    def blocks(self) -> np.ndarray:
        """Blocks of each cell."""
        return -(-self.size // self.block)

    def over(self, rows: DataFrame) -> Index:
        """The same cells over some of the rows, or other tags."""
        return replace(self, rows=rows.select("id", "v", "tag", "cell"))


def index(base: DataFrame, metric: str = "euclidean", block: int | None = None, cells: int | None = None) -> Index:
    """Blocks of (id long, v array<double>, tag long). Few rows make one cell, in a few blocks a task, as pruning would cost more than it saves."""
    n = base.count()
    rows = base.select("id", F.col("v").cast("array<double>").alias("v"), F.col("tag").cast("long").alias("tag"))
    width = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    block = block or min(BLOCK, max(CHUNK, -(-n // (2 * width))))
    cells = cells or (min(CELLS, -(-n // block)) if n > 4 * BLOCK else 1)
    pivots = [r["v"] for r in rows.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(cells).collect()] if cells > 1 else []
    if len(pivots) < 2:
        return Index(rows.withColumn("cell", F.lit(0)), np.array([max(n, 1)]), block, metric)
    at = np.array(pivots, float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            d = distances(matrix(part), at, metric)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).combine_chunks() for c in ("id", "v", "tag")), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "tag", "cell", "far"]
            )

    placed = cut(rows.mapInArrow(place, "id long, v array<double>, tag long, cell int, far double"))
    size, radius = np.zeros(len(at), np.int64), np.zeros(len(at))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return Index(placed.drop("far"), size, block, metric, at, radius)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for s in range(0, batch.num_rows, CHUNK):
            yield pa.Table.from_batches([batch.slice(s, CHUNK)])


def _visits(queries: DataFrame, base: Index, reach: Column | None, home: bool) -> DataFrame:
    """(id, v, tag, visits): the numbers of the blocks that may hold a row within ``reach`` (null: any), or of one block of the own cell."""
    rows = queries.select("id", F.col("v").cast("array<double>").alias("v"), F.col("tag").cast("long").alias("tag"), (F.lit(float("inf")) if reach is None else reach.cast("double")).alias("reach"))
    many = base.blocks
    if base.pivots is None or reach is None and not home:
        return rows.select("id", "v", "tag", F.sequence(F.lit(0), F.lit(int(many.sum()) - 1)).alias("visits"))
    pivots, radius, metric = base.pivots, base.radius, base.metric
    owner = np.repeat(np.arange(len(many)), many)
    first = np.cumsum(many) - many
    norm = np.sqrt((pivots * pivots).sum(1).max())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            x = matrix(part)
            d = distances(x, pivots, metric)
            if home:
                cell = d.argmin(1)
                some = many[cell] > 0
                block = first[cell] + np.arange(len(cell)) % np.maximum(many[cell], 1)
                offsets, numbers = np.r_[0, np.cumsum(some)], block[some]
            else:
                r = part.column("reach").to_numpy()[:, None]
                slack = 1e-8 + 1e-9 * (norm + np.sqrt((x * x).sum(1)))[:, None]  # of rounding
                mask = ((d <= d.min(1)[:, None] + 2 * r + slack) & (d <= radius + r + slack))[:, owner]
                offsets, numbers = np.r_[0, np.cumsum(mask.sum(1))], np.nonzero(mask)[1]
            visits = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(numbers.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("id", "v", "tag")), visits], names=["id", "v", "tag", "visits"])

    return rows.mapInArrow(go, "id long, v array<double>, tag long, visits array<int>")


def blocked(queries: DataFrame, base: Index, run: Run, schema: str, reach: Column | None = None, home: bool = False) -> DataFrame:
    """``run(some queries, base block)`` over all blocks that the queries (id, v, tag) must visit for all base rows within ``reach``.

    reach: a column of the queries, or None for every row. home: one block near each query only.
    """
    many = base.blocks
    numbers = lambda a: F.split(F.lit(",".join(map(str, a.tolist()))), ",").cast("array<int>")
    pieces = max(1, -(-queries.count() // QUERIES))
    at = F.col("cell") + 1
    own = F.element_at(numbers(np.cumsum(many) - many), at) + F.pmod(F.xxhash64("id"), F.element_at(numbers(np.maximum(many, 1)), at)).cast("int")
    left = base.rows.select("id", "v", "tag", F.lit(0).alias("side"), own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))
    place = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(pieces)).cast("int")
    right = _visits(queries, base, reach, home).select("id", "v", "tag", F.lit(1).alias("side"), F.explode("visits").alias("b"), place.alias("piece"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = last = None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("b", "piece", "side")]
            fresh = np.zeros(batch.num_rows, bool)
            for k in keys:
                fresh[1:] |= k[1:] != k[:-1]
            edge = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                own = (keys[0][a], keys[1][a])
                if own != last:
                    held, block, last = [], None, own
                part = batch.slice(a, z - a)
                if keys[2][a] == 0:
                    held.append(part)
                elif held:
                    block = block or pa.Table.from_batches(held).combine_chunks()
                    for q in _chunks(iter([part])):
                        yield from run(q, block)

    return left.unionByName(right).repartition("b", "piece").sortWithinPartitions("b", "piece", "side").mapInArrow(go, schema)


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(y - row).sum(1) for row in x]) if len(x) else np.zeros((0, len(y)))
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    near = square < 1e-6 * ((x * x).sum(1)[:, None] + (y * y).sum(1))  # cancellation: take those directly
    out = np.sqrt(np.maximum(square, 0))
    for i, j in zip(*np.nonzero(near), strict=True):
        out[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum())
    return out


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", block: int | None = None, cells: int | None = None) -> DataFrame:
    """(id, neighbour, tag, distance, rank) of the k nearest base rows of each query, ties by neighbour id.

    One block of the own cell bounds the distance of the k-th; the query then visits all blocks that can hold a nearer row.
    """

    def run(q: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, tags = b.column("id").to_numpy(), b.column("tag").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, tags, y, qid = ids[order], tags[order], matrix(b)[order], q.column("id").to_numpy()
        x = matrix(q)
        for s in range(0, len(x), 512):
            d = np.round(distances(x[s : s + 512], y, metric), 9)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(d)), best.shape[1])
            flat = best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(qid[s + rows]), pa.array(ids[flat]), pa.array(tags[flat]), pa.array(d[rows, flat])], names=["id", "neighbour", "tag", "distance"])

    at, reach = index(base, metric, block, cells), None
    if at.pivots is not None:

        def bound(q: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
            d = np.sort(distances(matrix(q), matrix(b), metric), axis=1)
            far = d[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
            yield pa.RecordBatch.from_arrays([q.column("id").combine_chunks(), pa.array(far)], names=["id", "reach"])

        bounds = blocked(queries, at, bound, "id long, reach double", home=True).groupBy("id").agg(F.max("reach").alias("reach"))
        queries = cut(queries.select("id", "v", "tag").join(bounds, "id", "left"))
        reach = F.coalesce("reach", F.lit(float("inf")))
    found = blocked(queries, at, run, "id long, neighbour long, tag long, distance double", reach)
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_sums(queries: DataFrame, base: DataFrame, metric: str = "euclidean", block: int | None = None) -> DataFrame:
    """(id, tag, total, n): summed distance of each query to the base rows of each tag."""

    def run(q: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        tags, at = np.unique(b.column("tag").to_numpy(), return_inverse=True)
        hot = np.zeros((len(at), len(tags)))
        hot[np.arange(len(at)), at] = 1
        x, y, ids = matrix(q), matrix(b), q.column("id").to_numpy()
        for s in range(0, len(x), 1024):
            total = distances(x[s : s + 1024], y, metric) @ hot
            rows = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[s : s + rows], len(tags))), pa.array(np.tile(tags, rows)), pa.array(total.ravel()), pa.array(np.tile(hot.sum(0).astype(np.int64), rows))],
                names=["id", "tag", "total", "n"],
            )

    return blocked(queries, index(base, metric, block, 1), run, "id long, tag long, total double, n long").groupBy("id", "tag").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def within(points: DataFrame, radius: float, block: int | None = None, at: Index | None = None) -> DataFrame:
    """(id, n): how many points, itself included, lie within the radius. at: their index, if there is one."""

    def run(q: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        d = distances(matrix(q), matrix(b))
        yield pa.RecordBatch.from_arrays([q.column("id").combine_chunks(), pa.array((d <= radius).sum(1).astype(np.int64))], names=["id", "n"])

    return blocked(points, at or index(points, block=block), run, "id long, n long", F.lit(radius)).groupBy("id").agg(F.sum("n").alias("n"))


def forest(points: DataFrame, radius: float, block: int | None = None, at: Index | None = None) -> DataFrame:
    """(a, b): edges of spanning forests, one per block and chunk of queries, of the graph of points within the radius."""

    def run(q: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = np.r_[q.column("id").to_numpy(), b.column("id").to_numpy()]
        i, j = np.nonzero(distances(matrix(q), matrix(b)) <= radius)
        up = np.arange(len(ids))
        a, c = i, j + q.num_rows

        def root(x: np.ndarray) -> np.ndarray:
            x = up[x]
            while not np.array_equal(y := up[x], x):
                x = y
            return x

        while len(a):
            a, c = root(a), root(c)
            keep = a != c
            a, c = a[keep], c[keep]
            np.minimum.at(up, np.maximum(a, c), np.minimum(a, c))
        top = ids[root(np.arange(len(ids)))]
        some = top != ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(top[some])], names=["a", "b"])

    return blocked(points, at or index(points, block=block), run, "a long, b long", F.lit(radius))
