"""Embedding near-duplicates over an inverted multi-index.

Unit vectors are cut into halves with a codebook each; pairs of centroids form a grid of cells, and every vector lies in
one cell. How far a vector must move to get from its own cell into another is bounded below, per half, by the greatest
distance to a plane that bisects that cell's centroid and one of the PLANES nearest ones; squared, the halves add up. The
multi-sequence traversal sorts both halves' ways, visits cells in the order of their sums and stops at ``reach``, the sum that
partners at exactly the threshold's cosine need for the target recall: they are made from a bounded sample, one half turned in
random directions, the other towards other vectors. Closer links need less. Then all pairs of visitors and members of the
visited cells are verified by cosine in double precision. Vectors of different lengths have no cosine: each length has its
own index.

A task takes the cells of one first-half centroid: its members once, and each visitor whose traversal gets there, with the
second halves that it visits in order, so a vector is sent to as many tasks as first centroids are in reach. Members and
visitors beyond MEMBERS and VISITORS are dealt to separate tasks. Equal vectors are one class with a count, so copies cost
nothing. Tasks give back numbers of links and a spanning forest, never pairs. A pair that only one side finds counts for both.

The codebooks and the reach come from at most SAMPLE vectors (of each length its share, LEAST_SAMPLE at least); every vector is
indexed and every vector queries. A codebook has up to CENTROIDS centroids, about the root of a twelfth of the vectors.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and name their own component; so does a row without an id, whose component is null. Rows that repeat an id count as
vectors each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import by_key, components, cut, scratch
from siltstone.llm.simhash import Forest

SAMPLE, LEAST_SAMPLE = 20_000, 200
PLANES = 4
CENTROIDS = 1024
MEMBERS, VISITORS = 4096, 16_384


@dataclass
class Index:
    """Two codebooks (k x half), half of one over the distances between their centroids, and how far a traversal goes."""

    books: list[np.ndarray]
    over: list[np.ndarray]
    split: int
    reach: float = 0.0
    #: Number of the first cell of this index among all lengths'.
    base: int = 0

    @staticmethod
    def fit(unit: np.ndarray, k: int, cosine: float, recall: float) -> Index:
        rng = np.random.default_rng(12)
        split = unit.shape[1] // 2
        books = [_codebook(half, k, rng) for half in (unit[:, :split], unit[:, split:])]
        over = [0.5 / np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(-1), 1e-18)) for b in books]
        index = Index(books, over, split)
        some = unit[rng.choice(len(unit), min(len(unit), 2000), replace=False)]
        some = np.concatenate([some, some])
        noise = np.concatenate([rng.standard_normal(some[::2].shape), unit[rng.choice(len(unit), len(some) // 2)]])
        noise -= (noise * some).sum(1, keepdims=True) * some
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        partners = cosine * some + np.sqrt(max(0.0, 1 - cosine * cosine)) * noise
        a, b = index.bounds(some)
        i, j = index.cells(partners)
        at = np.arange(len(some))
        index.reach = float(np.quantile(a[at, i] + b[at, j], recall)) + 1e-9
        return index

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared least ways into each centroid's region, per half."""
        out = []
        for half, book, half_over in zip((unit[:, : self.split], unit[:, self.split :]), self.books, self.over, strict=True):
            far = (book * book).sum(1) - 2 * half @ book.T
            way, at = np.zeros_like(far), np.arange(len(far))
            near = np.argpartition(far, min(PLANES, len(book)) - 1, axis=1)[:, :PLANES] if len(book) > PLANES else np.tile(np.arange(len(book)), (len(far), 1))
            for c in near.T:
                np.maximum(way, (far - far[at, c][:, None]) * half_over[c], out=way)
            out.append(way**2)
        return out[0], out[1]

    def traverse(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The multi-sequence traversal of each vector: (row, first, number of seconds, seconds) of the visited cells.

        Both halves' ways are sorted; along the first, the second is followed for as long as the sum stays within reach.
        """
        a, b = self.bounds(unit)
        near_a, near_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        way_a, way_b = np.take_along_axis(a, near_a, 1), np.take_along_axis(b, near_b, 1)
        row, at = np.nonzero(way_a + way_b[:, :1] <= self.reach)
        inside = way_a[row, at][:, None] + way_b[row] <= self.reach
        return row, near_a[row, at], inside.sum(1), near_b[row][inside]

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        halves = (unit[:, : self.split], unit[:, self.split :])
        return tuple(((b * b).sum(1) - 2 * h @ b.T).argmin(1) for h, b in zip(halves, self.books, strict=True))


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(10):
        near = ((book * book).sum(1) - 2 * x @ book.T).argmin(1)
        count = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return book


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision from a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.99) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; the result is written, all else is released."""
    with scratch(vectors.sparkSession) as keep:
        return keep(cut(_near_duplicates(vectors, id_col, vector_col, cosine, recall)))


def _near_duplicates(vectors: DataFrame, id_col: str, vector_col: str, cosine: float, recall: float) -> DataFrame:
    e = F.col("e")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False)
    )
    keyed = rows.select("vec_id", F.when(sound, e).alias("e")).select(
        "vec_id", "e", F.when(e.isNotNull(), F.xxhash64(e)).alias("k1"), F.when(e.isNotNull(), F.xxhash64(F.lit(1), e)).alias("k2")
    )
    classes = cut(keyed.where(e.isNotNull()).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("e").alias("e")))
    lengths = {r["d"]: r["n"] for r in classes.groupBy(F.size(e).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    n = sum(lengths.values())
    indexes: dict[int, Index] = {}
    base = 0
    for d, c in sorted(lengths.items()):
        taken = classes.where(F.size(e) == d).orderBy("k1", "k2").limit(max(LEAST_SAMPLE, SAMPLE * c // n)).select("e").toArrow()
        k = int(np.clip(2 ** round(np.log2(max(1.0, (c / 12) ** 0.5))), 4, CENTROIDS))
        indexes[d] = Index.fit(_unit(taken.column("e")), k, cosine, recall)
        indexes[d].base = base
        base += len(indexes[d].books[0])
    if not indexes:
        return _result(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    index = classes.sparkSession.sparkContext.broadcast(indexes)

    found = cut(_compare(classes.select("rep", "m", "e"), index, cosine))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("k1", "k2", "rep", "m")
        .join(counts, "rep", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    joined = keyed.drop("e").join(named, ["k1", "k2"], "left")
    return _result(joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))


def _result(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _compare(classes: DataFrame, index, cosine: float) -> DataFrame:  # noqa: ANN001
    """(rep, links, root): links of each class to other classes' vectors, and a forest of the links, per task."""
    element = classes.schema["e"].dataType.simpleString()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(size).tolist():
                mine, known = np.flatnonzero(size == d), index.value[d]
                for s in range(0, len(mine), 512):
                    part = batch.take(pa.array(mine[s : s + 512]))
                    unit = _unit(part.column(2))
                    own, _ = known.cells(unit)
                    # the member's row comes first, then the cells that its traversal gets to
                    row, to, count, seconds = known.traverse(unit)
                    take = pa.array(np.r_[np.arange(len(own)), row])
                    edge = np.r_[np.zeros(len(own), np.int32), 0, np.cumsum(count)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((np.r_[own, to] + known.base).astype(np.int32)),
                            pa.array(np.r_[np.ones(len(own), bool), np.zeros(len(row), bool)]),
                            *[part.column(c).take(take) for c in range(3)],
                            pa.ListArray.from_arrays(pa.array(edge), pa.array(seconds.astype(np.int32))),
                        ],
                        names=["cell", "own", "rep", "m", "e", "seconds"],
                    )

    sent = classes.mapInArrow(visits, f"cell int, own boolean, rep long, m long, e {element}, seconds array<int>")
    sizes = sent.groupBy("cell").agg(F.count_if("own").alias("members"), F.count_if(~F.col("own")).alias("visitors")).collect()  # one row a centroid
    blocks = {r["cell"]: (-(-max(1, r["members"]) // MEMBERS), -(-max(1, r["visitors"]) // VISITORS)) for r in sizes}
    number = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b[k])]), F.col("cell")), F.lit(1))
    if any(b != (1, 1) for b in blocks.values()):
        h = F.abs(F.xxhash64("rep") % (1 << 40))
        every = lambda k: F.sequence(F.lit(0), number(k) - 1)
        dealt = sent.withColumn("mb", F.explode(F.when(F.col("own"), F.array((h % number(0)).cast("int"))).otherwise(every(0)))).withColumn(
            "vb", F.explode(F.when(F.col("own"), every(1)).otherwise(F.array((h % number(1)).cast("int"))))
        )
    else:
        dealt = sent.withColumn("mb", F.lit(0)).withColumn("vb", F.lit(0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ("cell", "mb", "vb")):
            own = group.column("own").to_numpy(zero_copy_only=False)
            if own.any() and not own.all():
                yield from _verify(group.filter(pa.array(own)), group.filter(pa.array(~own)), index.value, cosine)

    return dealt.repartition("cell", "mb", "vb").sortWithinPartitions("cell", "mb", "vb").mapInArrow(compare, "rep long, links long, root long")


def _verify(members: pa.Table, visitors: pa.Table, indexes: dict[int, Index], cosine: float) -> Iterator[pa.RecordBatch]:
    y, x = _unit(members.column("e")), _unit(visitors.column("e"))
    index = indexes[y.shape[1]]
    rep = np.r_[members.column("rep").to_numpy(), visitors.column("rep").to_numpy()]
    m = np.r_[members.column("m").to_numpy(), visitors.column("m").to_numpy()]
    second = index.cells(y)[1]
    back = index.bounds(y)
    first_x, second_x = index.cells(x)
    order = np.argsort(second, kind="stable")
    edge = np.r_[0, np.flatnonzero(np.diff(second[order])) + 1, len(order)]
    lists = visitors.column("seconds").combine_chunks()
    who, where = np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    by_cell = np.argsort(where, kind="stable")
    who, where = who[by_cell], where[by_cell]
    links = np.zeros(len(rep), np.int64)
    forest = Forest(len(rep))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        mine = order[a:b]
        lo, hi = np.searchsorted(where, [second[mine[0]], second[mine[0]] + 1])
        for s in range(lo, hi, 4096):
            come = who[s : min(s + 4096, hi)]
            p, q = np.nonzero(x[come] @ y[mine].T >= cosine)
            p, q = come[p], mine[q]
            keep = rep[len(y) + p] != rep[q]
            p, q = p[keep], q[keep]
            np.add.at(links, len(y) + p, m[q])
            # where the member's own traversal does not get back to the visitor, the member counts the link here
            lost = back[0][q, first_x[p]] + back[1][q, second_x[p]] > index.reach
            np.add.at(links, q[lost], m[len(y) + p[lost]])
            forest.join(len(y) + p, q)
    root = forest.root(np.arange(len(rep)))
    # a class may stand here twice, as member and as visitor: both rows go out, and sums and components join them
    some = (links > 0) | (rep != rep[root])
    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["rep", "links", "root"])
