"""Quality by nearest neighbours: latent-semantic vectors, exact cosine in blocks, votes weighted by similarity.

Features of a text are its byte pairs (hashed to a fixed width, times inverse document frequency) and how far back each of its
words stood last (in powers of two, or never), both as square roots of relative frequencies; the two blocks have the same
length, so none outweighs the other. A bounded sample of labelled rows
(``most``, least hash of the id first) fits the latent axes, the leading eigenvectors of the features' second moments, and
gives the labelled vectors, at most ``most`` of them, which are broadcast. Each document takes the cosine with all of them; those as
near as the ``neighbours``-th nearest, ties included, vote with their similarity to the eighth power.

Cases: a text without features (null, empty, one byte) or without any similar neighbour scores the sample's mean label. No
labelled rows at all give 0.5 to each. Labels that are null are ignored, several labels of one id are averaged, and of rows
that repeat an id one is taken for the sample. Very long texts are read whole, in slices of whole documents. Extra columns
pass; a column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W

PAIRS, BACK = 1024, 12
WIDTH = PAIRS + BACK
_BUCKET = np.random.Generator(np.random.PCG64(77)).integers(0, PAIRS, 1 << 16)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(blocks(counts, self.idf) @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        mean = float(self.labels.mean())
        out = np.empty(len(counts))
        for i in range(0, len(counts), 256):
            near = self.latent(counts[i : i + 256]) @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            near[near < np.maximum(least, 0)[:, None] - 1e-6] = 0
            np.maximum(near, 0, out=near)
            for _ in range(3):
                np.square(near, out=near)
            total = near.sum(1, dtype=np.float64)
            votes = near @ self.labels
            out[i : i + 256] = np.where(total > 0, votes / np.where(total > 0, total, 1), mean)
        return np.clip(np.round(out, 6), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))


def blocks(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of both kinds of features side by side."""
    root = lambda c: np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1))
    return _unit(np.concatenate([_unit(root(counts[:, :PAIRS]) * idf), _unit(root(counts[:, PAIRS:]))], axis=1).astype(np.float32))


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature counts, a row per document of a buffer."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH))
    if len(data) > 1:
        doc = np.repeat(np.arange(n), np.diff(offsets))
        inside = doc[1:] == doc[:-1]
        pair = (data[:-1].astype(np.int64) << 8 | data[1:])[inside]
        out[:, :PAIRS] = np.bincount(doc[1:][inside] * PAIRS + _BUCKET[pair], minlength=n * PAIRS).reshape(n, PAIRS)
    start, end, doc = W.spans(data, offsets)
    word = W.word_hashes(data, start, end)
    if len(word):
        order = np.lexsort((np.arange(len(word)), word, doc))
        again = np.r_[False, (word[order][1:] == word[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
        back = np.log2(np.r_[1, np.maximum(np.diff(order), 1)]).astype(np.int64)
        kind = np.where(again, np.minimum(back, BACK - 2), BACK - 1)
        out[:, PAIRS:] = np.bincount(doc[order] * BACK + kind, minlength=n * BACK).reshape(n, BACK)
        out[~out[:, :PAIRS].any(1)] = 0  # a text of one byte has no features
    return out


def held_out(id_col: str) -> Column:
    """Ids whose text's crc32 is divisible by five are never learned from; a null id's text is empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 4096, axes: int = 32, neighbours: int = 15) -> Model:
    """Learn from at most ``most`` labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").dropDuplicates(["_id"]).select("_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column(1))
            for i, j in W.slices(offsets):
                got = counts_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in got], pa.binary())], names=["y", "counts"])

    got = rows.mapInArrow(run, "y double, counts binary").collect()
    got.sort(key=lambda r: (bytes(r["counts"]), r["y"]))
    y = np.array([r["y"] for r in got], np.float32)
    x = np.frombuffer(b"".join(bytes(r["counts"]) for r in got), np.float32).reshape(-1, WIDTH)
    idf = (np.log((1 + len(x)) / (1 + (x[:, :PAIRS] > 0).sum(0))) + 0.1).astype(np.float32)
    model = Model(idf, np.eye(WIDTH, axes, dtype=np.float32), np.zeros((0, axes), np.float32), y, neighbours)
    if len(x):
        z = blocks(x, idf).astype(np.float64)
        model.axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :axes].astype(np.float32)
        model.vectors = model.latent(x)
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1: higher, label 1 likelier."""
    docs = docs.drop(score_col)
    at, names = docs.columns.index(text_col), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column(at))
            parts = [shared.value.scores(counts_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in W.slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*parts, np.zeros(0)]))], names=[*names, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{score_col}` double")
