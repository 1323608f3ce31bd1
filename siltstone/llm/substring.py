"""Substring deduplication: windows of words that also start in a document with a smaller id are cut out.

Route. Each window of 50 words is named by the least hash of its 12-word runs, so equal windows carry one name wherever they
stand. Neighbouring windows of one name form a segment. Names seen in one document only are dropped; equal segments are
counted once, under their least document, before anything is grouped, so a passage in a third of all documents is one row.
The distinct segments go to shards by name, at least two a shuffle partition. Each shard builds a compressed FM-index over its
segments and streams them through backward search on the wavelet matrix: every window's interval gives the least document
that it starts in. That answer alone decides: of each occurrence of a segment the windows go whose least document is
smaller than the occurrence's. Segments are told apart by two 64-bit hashes.

A name whose distinct segments exceed NAME_ROWS (a passage amid very many different contexts) is resolved window by window
instead: its windows are named by their own hash and pass the same steps, so no shard grows with one name's group.

Cases: null and empty texts have no words. Documents of under 50 words lose none. A null id has no smaller id and is
smaller than none: its row stays whole. Rows that repeat, also under one id, do not remove each other. Extra columns pass, but for those named as a result, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.common import FILTER_WORDS, cut, marks, possible, release, scratch
from siltstone.llm.common import width as width_of
from siltstone.llm.fmindex import FMIndex

GRAM = 12
#: Distinct segments of a shard, about: 5,000 of them are some 0.3 million words and 50 MB while the index is built.
SHARD_ROWS = 5_000
#: Most distinct segments of one name that go to a shard under that name.
NAME_ROWS = 1_000


def _segments(h: np.ndarray, doc: np.ndarray, window: int, gram: int, only: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(name, hash, document, first word within it, windows) of the segments of a slice.

    only: bits of names; then every window of such a name by itself, under its own hash, and last the name.
    """
    first = np.searchsorted(doc, np.arange(doc[-1] + 1)) if len(doc) else np.zeros(0, np.int64)
    n = len(h) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z, z.astype(np.uint64)
    inside = doc[:n] == doc[window - 1 :]
    name = W.sliding_min(W.gram_hashes(h, gram), window - gram + 1)
    if only is not None:
        slot = name % np.uint64(64 * len(only))
        at = np.flatnonzero(inside & ((only[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool))
        return W.gram_hashes(h, window)[at], W.gram_hashes(W.mix(h), window)[at], doc[at], at - first[doc[at]], np.ones(len(at), np.int64), name[at]
    fresh = np.r_[True, (name[1:] != name[:-1]) | (doc[1:n] != doc[: n - 1])] & inside
    at = np.flatnonzero(fresh)
    stop = np.flatnonzero(np.r_[fresh[1:] | ~inside[1:], True] & inside) + 1
    size = stop - at
    whole = np.zeros(len(at), np.uint64)
    # words at .. at + size + window - 1, and their number
    up, down = W._power(W._BASE2, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    whole = W.mix((sums[stop + window - 1] - sums[at]) * down[at] + size.astype(np.uint64) * np.uint64(0x51ED270B))
    return name[at], whole, doc[at], at - first[doc[at]], size, name[at]


_OCCURRENCE = "h long, s long, doc long, th long, start int, size int"


def _occurrences(picked: DataFrame, window: int, gram: int, only: np.ndarray | None = None) -> DataFrame:
    """Every segment; with ``only`` each window of the names whose bit is set there, and that name as ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("doc"), batch.column("th")
            data, offsets = W.buffers(batch.column("text"))
            for i, j in W.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                start, end, doc = W.spans(part, offsets[i : j + 1] - offsets[i])
                name, whole, d, at, size, of = _segments(W.word_hashes(part, start, end), doc, window, gram, only)
                take = pa.array(d + i)
                columns = [pa.array(name.view(np.int64)), pa.array(whole.view(np.int64)), ids.take(take), th.take(take), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))]
                if only is None:
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "s", "doc", "th", "start", "size"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(of.view(np.int64))], names=["h", "s", "doc", "th", "start", "size", "of"])

    return picked.mapInArrow(run, _OCCURRENCE if only is None else f"{_OCCURRENCE}, of long")


def _shared(found: DataFrame) -> DataFrame:
    """Occurrences whose name stands in two documents or more."""
    names = found.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    return found.join(names, "h", "left_semi")


def _texts(picked: DataFrame, classes: DataFrame, window: int, shards: int) -> DataFrame:
    """(shard, s, doc, words) of each distinct segment, sliced from its least document's text."""
    lists = classes.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "s", "start", "size")).alias("want"))
    joined = lists.join(picked, ["doc", "th"]).select("doc", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            want = batch.column("want").combine_chunks() if isinstance(batch.column("want"), pa.ChunkedArray) else batch.column("want")
            ids = batch.column("doc")
            for i, j in W.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                start, end, doc = W.spans(part, offsets[i : j + 1] - offsets[i])
                first = np.searchsorted(doc, np.arange(j - i))
                lists = want.slice(i, j - i)
                flat = lists.flatten()
                owner = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                at = first[owner] + flat.field("start").to_numpy()
                last = at + flat.field("size").to_numpy() + window - 2
                raw = part.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("h"),
                        flat.field("s"),
                        ids.take(pa.array(owner + i)),
                        pa.array([raw[a:b] for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["h", "s", "doc", "words"],
                )

    sliced = joined.mapInArrow(run, "h long, s long, doc long, words binary")
    return sliced.select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "h", "s", "doc", "words")


def _search(segments: DataFrame, window: int) -> DataFrame:
    """(h, s, first, n, least): runs of a segment's windows whose intervals in the shard's index have the same least document."""

    def one(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        column = rows.column("words").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        start, end, seg = W.spans(data, offsets - offsets[0])
        owner = rows.column("doc").to_numpy()
        index = FMIndex(W.word_hashes(data, start, end), np.bincount(seg, minlength=len(owner)), owner, window)
        parts = [(np.zeros(0, np.int64),) * 3, *index.windows()]
        s, at, least = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, s))
        s, at, least = s[order], at[order], least[order]
        fresh = np.r_[True, (s[1:] != s[:-1]) | (least[1:] != least[:-1])][: len(s)]
        begin = np.flatnonzero(fresh)
        count = np.diff(np.r_[begin, len(s)])
        name = lambda c: pa.array(rows.column(c).to_numpy()[s[begin]])
        yield pa.RecordBatch.from_arrays(
            [name("h"), name("s"), pa.array(at[begin].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(least[begin])], names=["h", "s", "first", "n", "least"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by shard: one shard is held at a time
            shard = batch.column("shard").to_numpy()
            edge = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if held and held[0].column("shard")[0] != part.column("shard")[0]:
                    yield from one(held)
                    held = []
                held.append(part)
        if held:
            yield from one(held)

    dealt = segments.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "h long, s long, first int, n int, least long")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = GRAM) -> DataFrame:
    """(doc, th, cuts): for each text that loses words its windows to remove, as array of (start, size); th is the text's hash.

    The result is written, all else is released.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(cut(_covered(docs, id_col, text_col, window, gram)))


def _covered(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    picked = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )
    every = cut(_occurrences(picked, window, gram))
    found = cut(_shared(every))
    release(every)
    distinct = cut(found.groupBy("h", "s").agg(F.min(F.struct("doc", "th", "start", "size")).alias("r")).select("h", "s", "r.*"))
    crowded = cut(distinct.groupBy("h").count().where(F.col("count") > NAME_ROWS).select("h"))
    if crowded.limit(1).count():
        # windows of crowded names, each under its own hash; the texts stay where they are, and the bits of the names go to them
        only = np.zeros(FILTER_WORDS, np.uint64)
        for r in marks(crowded).toLocalIterator():
            only[r["word"]] = r["bits"] % 2**64
        alone = cut(_occurrences(picked, window, gram, only))
        alone = cut(_shared(alone.join(crowded.withColumnRenamed("h", "of"), "of", "left_semi").select("h", "s", "doc", "th", "start", "size")))
        found = found.join(crowded, "h", "left_anti").unionByName(alone)
        distinct = cut(
            distinct.join(crowded, "h", "left_anti").unionByName(
                alone.groupBy("h", "s").agg(F.min(F.struct("doc", "th", "start", "size")).alias("r")).select("h", "s", "r.*")
            )
        )
    shards = max(2 * width_of(docs.sparkSession), distinct.count() // SHARD_ROWS + 1)
    once = possible(picked, distinct.select("doc", "th"), "hit").where("hit").drop("hit").dropDuplicates(["doc", "th"])
    told = _search(_texts(once, distinct, window, shards), window)
    lost = found.join(told, ["h", "s"]).where("least < doc").select("doc", "th", (F.col("start") + F.col("first")).alias("start"), F.col("n").alias("size"))
    return lost.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "size")).alias("cuts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_words, n_removed, removed_spans (array of first word and number) and kept_text (kept words, one space between)."""
    docs = docs.drop(*[c for c in ("n_words", "n_removed", "removed_spans", "kept_text") if c not in (id_col, text_col)])
    gone = covered(docs, id_col, text_col, window, gram).select(F.col("doc").alias("_gone_doc"), F.col("th").alias("_gone_th"), F.col("cuts").alias("_gone_cuts"))
    keyed = docs.withColumn("_gone_doc", F.col(id_col).cast("long")).withColumn("_gone_th", F.xxhash64(text_col))
    # most texts lose nothing and stay where they are
    told = possible(keyed, gone.select("_gone_doc", "_gone_th"), "_gone_hit")
    some = told.where("_gone_hit").join(gone, ["_gone_doc", "_gone_th"], "left")
    joined = told.where("not _gone_hit").withColumn("_gone_cuts", F.lit(None).cast(gone.schema["_gone_cuts"].dataType)).unionByName(some).drop("_gone_doc", "_gone_th", "_gone_hit")
    text_at, cuts_at = joined.columns.index(text_col), joined.columns.index("_gone_cuts")
    extra = "n_words long, n_removed long, removed_spans array<struct<start: int, size: int>>, kept_text string"
    names = [c for c in joined.columns if c != "_gone_cuts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column(text_at))
            cuts = batch.column(cuts_at)
            n_words, n_gone, spans, kept = [], [], [], []
            for i, j in W.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                start, end, doc = W.spans(part, offsets[i : j + 1] - offsets[i])
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                raw = part.tobytes()
                for k in range(j - i):
                    a, b = int(edge[k]), int(edge[k + 1])
                    # n windows from a start cover n + window - 1 words
                    mine = cuts[i + k].as_py()
                    words = raw[int(start[a]) : int(end[b - 1])].split() if b > a else []
                    n_words.append(b - a)
                    if not mine:
                        n_gone.append(0)
                        spans.append([])
                        kept.append(b" ".join(words))
                        continue
                    delta = np.zeros(b - a + 1, np.int64)
                    np.add.at(delta, [c["start"] for c in mine], 1)
                    np.add.at(delta, [c["start"] + c["size"] + window - 1 for c in mine], -1)
                    off = np.cumsum(delta[:-1]) > 0
                    step = np.flatnonzero(np.diff(np.r_[False, off, False].astype(np.int8)))
                    spans.append([{"start": int(x), "size": int(y - x)} for x, y in zip(step[::2], step[1::2], strict=True)])
                    n_gone.append(int(off.sum()))
                    kept.append(b" ".join(w for w, x in zip(words, off.tolist(), strict=True) if not x))
            columns = [batch.column(c) for c in range(batch.num_columns) if c != cuts_at]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))
            new = [pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, kind), pa.array([x.decode() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=[*names, "n_words", "n_removed", "removed_spans", "kept_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "_gone_cuts")
    return joined.mapInArrow(run, f"{fields}, {extra}")
