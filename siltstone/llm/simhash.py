"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile.

Tiles. A fingerprint's four 16-bit quarters have population counts (p1..p4); that vector names its tile. Two fingerprints
within a radius r differ by at most r in the sum of |p - p'|, so a tile is compared with itself and with the tiles in that
ball only: every other tile pair is skipped by its population counts, and no pair within the radius is lost. The tile grid
is the same at every input size, so a fingerprint is sent to a constant number of tiles (65 at radius 3).
Inside a tile numpy takes exclusive-or and bit counts over blocks; large tiles are cut into sub-blocks that are separate
tasks. Equal fingerprints are one class from the start, so copies cost nothing here.

Groups of a verified likeness (``keep_one``). Shingle sets of five words get fingerprints of 192 bits, compared in the same
manner over tiles of the population count; sets chained within a radius that a Jaccard likeness of 0.8 stays in are brought
together, and each pair within the radius is verified on the whole sets. Comparisons stay quadratic in distinct sets.

Cases: a null or empty text and one without words has fingerprint zero, which links like any other. Fewer words than the
shingle's width give one shingle of them all. Rows may repeat and ids may be null: a null id keeps its row, takes the
component of its fingerprint and never names one (null only if no id of the component is known), but links others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from siltstone.llm import words as W
from siltstone.llm.common import by_key, components, cut, possible, scratch
from siltstone.llm.common import width as width_of

SEED = 42
#: Most members and most visitors of one comparison task; larger tiles are cut.
BLOCK = 1 << 16
#: Shingles hashed at a time.
CHUNK = 1 << 15
#: Words of a wide fingerprint, and how far those of a set of likeness 0.8 may lie apart: the mean is 29 of 192 bits with a
#: deviation of 5 (10 and 2.9 in the first word), so a pair is missed with a chance of about 1 in 10**5 (1 in 10**3 for sets of five).
WORDS, RADIUS, FIRST = 3, 52, 24
#: Most and least rows of a tile of wide fingerprints.
MOST_TILE, LEAST_TILE = 1 << 18, 1024
#: Most texts, and their characters, of one side of a verifying task.
MEMBERS, GROUP_BYTES = 1024, 8 << 20
_SALT = np.random.Generator(np.random.PCG64(19)).integers(1, 2**63, WORDS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per document of a buffer."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(offsets) - 1, np.uint64)
    start, end, doc = W.spans(data, offsets)
    if not len(start):
        return out
    size = end - start
    # the words alone, one space after each
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    flat = np.full(at[-1], 32, np.uint8)
    inside = np.repeat(np.arange(len(size)), size)
    byte = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    flat[at[inside] + byte] = _LOWER[data[start[inside] + byte]]
    raw = flat.tobytes()
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, len(doc)])
    shingles = np.maximum(count - width + 1, 1)
    begin = np.repeat(first, shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(begin + width - 1, np.repeat(first + count - 1, shingles))
    begin, last = at[begin], at[last + 1] - 1
    ones = np.zeros((len(first), 64), np.int64)
    owner = np.repeat(np.arange(len(first)), shingles)
    for i in range(0, len(begin), CHUNK):  # a document may span chunks
        part = slice(i, i + CHUNK)
        h = np.array([xxh64_intdigest(raw[a:b], SEED) for a, b in zip(begin[part].tolist(), last[part].tolist(), strict=True)], ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        edge = np.flatnonzero(np.r_[True, owner[part][1:] != owner[part][:-1]])
        ones[owner[part][edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    on = ones * 2 > shingles[:, None]
    out[doc[first]] = np.packbits(on, axis=1).reshape(-1, 8).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column(1))
            parts = [fingerprints_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width) for i, j in W.slices(offsets)]
            fp = np.concatenate([*parts, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


def _ball(radius: int) -> list[tuple[int, ...]]:
    """Half of the moves between tiles, and staying."""
    moves = [m for m in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, m)) <= radius]
    return [m for m in moves if m >= (0, 0, 0, 0)]


def _near(visitors: np.ndarray, members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, block by block."""
    step = max(1, (1 << 18) // max(1, len(members)))
    for i in range(0, len(visitors), step):
        a, b = np.nonzero(np.bitwise_count(visitors[i : i + step, None] ^ members[None, :]) <= radius)
        yield a + i, b


class Forest:
    """Union by least index over local numbers."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def root(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while not np.array_equal(y := self.up[x], x):
            x = y
        return x


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Spanning links ``(a, b)`` between class names: a and b are in one group of fingerprints chained within the radius.

    classes: distinct (rep, fp). Within a task all pairs are compared, and a forest of what links is given back, so the
    rows out are fewer than the rows in however many pairs there are.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))).cast("int") for q in range(4)]
    tile = lambda p: sum((x * 17**q for q, x in enumerate(p)), F.lit(0))
    own = classes.select("rep", "fp", *[q.alias(f"p{i}") for i, q in enumerate(quarter)])
    sizes = own.select(tile([F.col(f"p{i}") for i in range(4)]).alias("t")).groupBy("t").count().where(F.col("count") > BLOCK)
    cuts = {r["t"]: -(-r["count"] // BLOCK) for r in sizes.collect()}  # at most 17**4 tiles exist
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(m)]) for m in _ball(radius)])
    sent = own.select("rep", "fp", "p0", "p1", "p2", "p3", F.explode(moves).alias("d"))
    to = [F.col(f"p{i}") + F.col(f"d.d{i}") for i in range(4)]
    inside = [c.between(0, 16) for c in to]
    sent = sent.where(inside[0] & inside[1] & inside[2] & inside[3]).select(
        tile(to).cast("int").alias("t"), (F.expr("d.d0 = 0 and d.d1 = 0 and d.d2 = 0 and d.d3 = 0")).alias("own"), "rep", "fp"
    )
    if cuts:
        # a member lies in one block and a visitor goes to every block; both lists are cut for the task's size
        blocks = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])
        n = F.coalesce(F.try_element_at(blocks, F.col("t")), F.lit(1))
        cell = F.pmod(F.xxhash64("fp"), n).cast("int")
        sent = sent.select("t", n.alias("n"), cell.alias("c"), "own", "rep", "fp")
        members = sent.where("own").select("t", F.explode(F.sequence(F.lit(0), F.expr("n - 1"))).alias("v"), F.col("c").alias("m"), F.lit(True).alias("own"), "rep", "fp")
        visits = sent.select("t", F.col("c").alias("v"), F.explode(F.sequence(F.lit(0), F.expr("n - 1"))).alias("m"), F.lit(False).alias("own"), "rep", "fp")
        sent = members.unionByName(visits)
    else:
        sent = sent.select("t", F.lit(0).alias("v"), F.lit(0).alias("m"), "own", "rep", "fp")
    both = bool(cuts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:  # sorted by tile: one tile at a time leaves the window
            table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            key = _key(table)
            stop = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if stop:
                yield from _tiles(table.slice(0, stop), radius, both)
            left = table.slice(stop)
        if left is not None and left.num_rows:
            yield from _tiles(left, radius, both)

    return sent.repartition("t", "v", "m").sortWithinPartitions("t", "v", "m").mapInArrow(compare, "a long, b long")


def _key(table: pa.Table) -> np.ndarray:
    t, v, m = (table.column(c).to_numpy().astype(np.int64) for c in ("t", "v", "m"))
    return (t << 42) | (v << 21) | m


def _tiles(table: pa.Table, radius: int, both: bool) -> Iterator[pa.RecordBatch]:
    key = _key(table)
    rep, fp = table.column("rep").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    own = table.column("own").to_numpy(zero_copy_only=False)
    edge = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        mine = np.flatnonzero(own[lo:hi]) + lo
        rest = np.flatnonzero(~own[lo:hi]) + lo
        if not len(mine) or len(mine) + len(rest) < 2:
            continue
        everyone = np.r_[mine, rest]
        forest = Forest(len(everyone))
        member = fp[mine]
        visitors = fp[everyone] if not both else fp[rest]
        base = 0 if not both else len(mine)
        for a, b in _near(visitors, member, radius):
            forest.join(a + base, b)
        root = forest.root(np.arange(len(everyone)))
        x, y = rep[everyone], rep[everyone[root]]
        if (keep := x != y).any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["a", "b"])


def groups(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(id, fp) to (id, fp, component_id): the least id of the fingerprints chained within the radius, null if none has one."""
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select(F.col("fp").alias("rep"), "fp"), radius))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(of, "fp", "left").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row of ``docs``; fingerprint is 16 lowercase hex digits. The result is written, all else is released."""
    with scratch(docs.sparkSession) as keep:
        found = keep(cut(groups(cut(fingerprints(docs, id_col, text_col, width)), radius)))
    return found.select(F.col("id").alias("doc_id"), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- groups of a verified likeness ------------------------------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, document by document, and len+1 offsets; fewer words than the width are one shingle."""
    n = len(offsets) - 1
    low = _LOWER[data]
    start, end, doc = W.spans(low, offsets)
    word = W.word_hashes(low, start, end)
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)
    runs = W.gram_hashes(word, width)
    begin = np.arange(len(runs))
    whole = doc[begin] == doc[begin + width - 1] if len(runs) else np.zeros(0, bool)
    owner, value = [doc[begin[whole]]], [runs[whole]]
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        if len(short):
            owner.append(short)
            value.append(W.gram_hashes(word, size)[first[short]])
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])] if len(owner) else np.zeros(0, bool)
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def _set_names(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number a set, 0 for the empty one."""
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(W.mix(value), out=sums[1:])
    return np.where(np.diff(at) > 0, W.mix((sums[at[1:]] - sums[at[:-1]]) ^ np.diff(at).astype(np.uint64)), np.uint64(0))


def set_fingerprints(value: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """(sets, words): a bit is 1 if it is set in over half the hashes of the set's shingles; words are of independent hashes."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), words), np.uint64)
    for w in range(words):
        ones = np.zeros((len(size), 64), np.int64)
        for i in range(0, len(value), CHUNK):
            h = W.mix(value[i : i + CHUNK] ^ _SALT[w])
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
            mine = owner[i : i + CHUNK]
            edge = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            ones[mine[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
        out[:, w] = np.packbits(ones * 2 > size[:, None], axis=1).reshape(-1, 8).view(np.uint64).ravel()
    return out


def _parts(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = W.buffers(column)
    for i, j in W.slices(offsets):
        yield shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)


_WIDE = [f"_sim_f{w}" for w in range(WORDS)]
_CLASS = ["_sim_set", *_WIDE]


#: What tells rows apart: the hash of the text, and that of id and text.
_KEY = ["_sim_text", "_sim_both"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ident = F.col(id_col)
    return docs.withColumns({"_sim_text": F.xxhash64(text_col), "_sim_both": F.xxhash64(ident.isNull(), ident, F.col(text_col))})


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Key and id of each row, the name and size of its shingle set and the set's wide fingerprint."""
    picked = _keyed(docs, id_col, text_col).select(*_KEY, F.col(id_col).alias("_sim_id"), F.col(text_col).alias("text"))
    own = picked.columns[:-1]
    schema = StructType([picked.schema[c] for c in own])
    for name in (*_CLASS, "_sim_n"):
        schema = schema.add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, wide = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, WORDS), np.uint64)]
            for value, at in _parts(batch.column(len(own)), width):
                names.append(_set_names(value, at))
                sizes.append(np.diff(at))
                wide.append(set_fingerprints(value, at, WORDS))
            f = np.concatenate(wide).view(np.int64)
            columns = [np.concatenate(names).view(np.int64), *(f[:, w].copy() for w in range(WORDS)), np.concatenate(sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns)], names=[*own, *_CLASS, "_sim_n"])

    return picked.mapInArrow(run, schema)


def wide_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) between classes (k and a fingerprint) whose wide fingerprints are chained within the radius.

    Tiles are ranges of the population count, at most MOST_TILE rows each; a pair of tiles whose counts differ beyond the
    radius is skipped, every other pair is one task. A task gives back a forest, fewer rows than it got.
    """
    spark = classes.sparkSession
    ones = sum((F.bit_count(c) for c in _WIDE[1:]), F.bit_count(_WIDE[0])).cast("int")
    own = classes.select("k", *_WIDE, ones.alias("p"))
    sizes = sorted((r["p"], r["n"]) for r in own.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a count of bits
    total = sum(n for _, n in sizes)
    most = int(min(MOST_TILE, max(LEAST_TILE, total / (2 * width_of(spark)) ** 0.5)))
    first, parts, low, high, filled = {}, {}, [], [], most
    for p, n in sizes:
        if filled + n > most:
            first[p], parts[p] = len(low), -(-n // most)
            low += [p] * parts[p]
            high += [p] * parts[p]
            filled = n if parts[p] == 1 else most
        else:
            first[p], parts[p] = len(low) - 1, 1
            high[-1] = p
            filled += n
    if not low:
        return spark.createDataFrame([], "a long, b long")
    near = [[u for u in range(len(low)) if low[u] - high[t] <= radius and low[t] - high[u] <= radius] for t in range(len(low))]
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
    by_count = lambda table: F.element_at(numbers([table.get(p, 0) for p in range(64 * WORDS + 1)]), F.col("p") + 1)
    tile = (by_count(first) + F.pmod(F.xxhash64("k"), F.greatest(by_count(parts), F.lit(1))).cast("int")).alias("t")
    ends = lambda f: F.element_at(numbers([f(x) for x in near]), F.col("t") + 1)
    sent = own.select("k", *_WIDE, tile).withColumn("u", F.explode(F.sequence(ends(min), ends(max))))
    sent = sent.select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), (F.col("t") <= F.col("u")).alias("own"), "k", *_WIDE)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ("a", "b")):
            k = group.column("k").to_numpy()
            f = [group.column(c).to_numpy().view(np.uint64) for c in _WIDE]
            mine = group.column("own").to_numpy(zero_copy_only=False)
            order = np.r_[np.flatnonzero(mine), np.flatnonzero(~mine)]
            k, f, m = k[order], [x[order] for x in f], int(mine.sum())
            other = slice(m, None) if m < len(k) else slice(0, m)
            forest = Forest(len(k))
            for a, b in wide_pairs([x[:m] for x in f], [x[other] for x in f], radius):
                forest.join(a, b + (other.start or 0))
            root = forest.root(np.arange(len(k)))
            if (some := k != k[root]).any():
                yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(k[root[some]])], names=["a", "b"])

    return sent.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(compare, "a long, b long")


def wide_pairs(x: list[np.ndarray], y: list[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose fingerprints differ in at most ``radius`` bits, at most FIRST of them in the first word."""
    step = max(1, (1 << 18) // max(1, len(y[0])))
    for i in range(0, len(x[0]), step):
        d = np.bitwise_count(x[0][i : i + step, None] ^ y[0][None, :])
        a, b = np.nonzero(d <= FIRST)
        far = d[a, b].astype(np.int64)
        for u, v in zip(x[1:], y[1:], strict=True):
            far += np.bitwise_count(u[i + a] ^ v[b])
        keep = far <= radius
        yield a[keep] + i, b[keep]


def _same(sets: list[np.ndarray], i: int, j: int) -> float:
    a, b = sets[i], sets[j]
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def verified_links(texts: DataFrame, width: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) of the pairs of (g, k, text) in one g whose shingle sets have a Jaccard likeness of ``similarity`` or more.

    Every pair within the radius is compared set by set unless both are linked already. A g of more than MEMBERS texts or
    GROUP_BYTES is cut into blocks, and each pair of blocks is a task.
    """
    sizes = texts.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum(F.length("text")) / GROUP_BYTES)).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("t")
    sent = texts.join(sizes, "g").select("g", "k", "text", "parts", block).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("g", F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), (F.col("t") <= F.col("u")).alias("own"), "k", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ("g", "a", "b")):
            if group.num_rows < 2:
                continue
            k, mine = group.column("k").to_numpy(), group.column("own").to_numpy(zero_copy_only=False)
            sets, wide = [], []
            for value, at in _parts(group.column("text"), width):
                sets += [value[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]
                wide.append(set_fingerprints(value, at, WORDS))
            f, size = np.concatenate(wide), np.array([len(s) for s in sets])
            one, two = np.flatnonzero(mine), np.flatnonzero(~mine) if not mine.all() else np.flatnonzero(mine)
            up = list(range(len(k)))

            def root(i: int) -> int:
                while up[i] != i:  # noqa: B023
                    up[i] = up[up[i]]  # noqa: B023
                    i = up[i]  # noqa: B023
                return i

            for a, b in wide_pairs([f[one, w] for w in range(WORDS)], [f[two, w] for w in range(WORDS)], radius):
                i, j = one[a], two[b]
                alike = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])) & ((i < j) | ~mine.all())
                for p, q in zip(i[alike].tolist(), j[alike].tolist(), strict=True):
                    r, s = root(p), root(q)
                    if r != s and _same(sets, p, q) >= similarity:
                        up[max(r, s)] = min(r, s)
            top = np.array([root(i) for i in range(len(k))])
            if (some := top != np.arange(len(k))).any():
                yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(k[top[some]])], names=["a", "b"])

    return sent.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of texts chained by a Jaccard likeness of their shingle sets of ``similarity`` or more.

    Candidates are the pairs of distinct sets whose wide fingerprints differ in at most RADIUS bits; each is verified on the
    whole sets. The row of least id stays (a row without one only if its group has no id), then that of least text hash,
    then any one of equal rows. Texts without words are one group. Only keys are written; the rows are read again from ``docs``.
    """
    with scratch(docs.sparkSession) as keep:
        kept, gone, twice = (keep(x) for x in _decided(docs, id_col, text_col, width, similarity))
    # A row that is not gone is kept. Only what all filters let pass, and rows that repeat, are sent to the exact join.
    told = _keyed(docs, id_col, text_col)
    for name, keys in (("_sim_kept", kept), ("_sim_gone", gone), ("_sim_twice", twice)):
        told = possible(told, keys, name)
    unsure = told.where("_sim_kept and (_sim_gone or _sim_twice)").join(kept, _KEY, "left_semi").dropDuplicates(_KEY)
    return told.where("not _sim_gone and not _sim_twice").unionByName(unsure).select(*docs.columns)


def _decided(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> Iterator[DataFrame]:
    """Keys of the rows that stay, of those that go, and of those that several rows share."""
    row = cut(_marked(docs, id_col, text_col, width))
    classes = row.groupBy(*_CLASS).agg(F.max("_sim_n").alias("_sim_n"), F.min(F.struct(*_KEY)).alias("r")).select(*_CLASS, "_sim_n", "r.*")
    classes = cut(classes.withColumn("k", F.monotonically_increasing_id()))
    found = wide_links(classes.where("_sim_n > 0"))
    near = components(found).select(F.col("node").alias("k"), F.col("root").alias("g"))
    # one text a class; only rows that may be among them are sent
    one = cut(classes.join(near, "k").select(*_KEY, "g", "k"))
    words = possible(_keyed(docs, id_col, text_col).select(*_KEY, F.col(text_col).alias("text")), one.select(*_KEY), "_sim_hit")
    texts = cut(words.where("_sim_hit").drop("_sim_hit").dropDuplicates(_KEY).join(one, _KEY).select("g", "k", "text"))
    roots = components(verified_links(texts, width, similarity))
    named = classes.join(roots, F.col("k") == F.col("node"), "left").select(*_CLASS, F.coalesce("root", "k").alias("g"))
    rank = F.struct(F.col("_sim_id").isNull().alias("none"), "_sim_id", *_KEY)
    kept = cut(row.join(named, _CLASS).groupBy("g").agg(F.min(rank).alias("r")).select("r._sim_text", "r._sim_both"))
    yield kept
    yield cut(row.select(*_KEY).join(kept, _KEY, "left_anti"))
    yield cut(row.groupBy(*_KEY).count().where("count > 1").select(*_KEY))
