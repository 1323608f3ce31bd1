"""Harmonic packing of token sequences.

Documents longer than a sequence give full sequences first; only the remainder is packed with others. A remainder of a length in
(capacity/(k+1), capacity/k] belongs to class k, and class k's bins take exactly k of them, whole. A bin that has its k
documents still lacks less than one more of them; the next documents of the worker fill that gap, cut where it is full,
and what is left of them is classed by its own length. So a document is cut about once, every closed bin is full, and none is
padded.

Each worker fills the bins of its own classes, with no exchange: sequence ids hold the partition's number in their upper
bits. What stands in open bins when a partition ends (less than a sequence a class) is laid out one after the other, cut at full
sequences, and the last, shorter rest into sequences whose lengths are powers of two, which need no padding either.

Cases: a null text is an empty one: the end id alone, one piece. Null and repeated ids keep their rows and are packed each
for itself. Very long texts only add full sequences. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond these characters, or with a special token's text, a document is left to the tokenizers library.
_PLAIN = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, ranks_path: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids as tokenizers gives them without special tokens.

    ranks_path: the same vocabulary as ranks; with it Latin texts take tiktoken, which is some three times as fast and gives
    the same ids (tests/llm/test_packing.py), and all other texts the tokenizers library.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks_path is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if _PLAIN.search(text) else fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)


class Bins:
    """The open bins of one worker. A piece is (doc, start, length, doc_tokens, ids as bytes)."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        #: Class to pieces and tokens of its open bin, and bins that hold their number of documents but are not full.
        self.open: dict[int, tuple[list[tuple], int]] = {}
        self.gaps: deque[tuple[list[tuple], int]] = deque()

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Take a document; the pieces of the sequences that it fills, each with sequence and offset."""
        n, at = len(ids), 0
        piece = lambda size: (doc, at, size, n, ids[at : at + size].tobytes())
        while n - at >= self.capacity:
            yield from self._lay([piece(self.capacity)])
            at += self.capacity
        while at < n and self.gaps:
            pieces, held = self.gaps[0]
            size = min(self.capacity - held, n - at)
            pieces.append(piece(size))
            at += size
            if held + size == self.capacity:
                self.gaps.popleft()
                yield from self._lay(pieces)
            else:
                self.gaps[0] = (pieces, held + size)
        if at < n:
            size = n - at
            k = self.capacity // size
            pieces, held = self.open.pop(k, ([], 0))
            pieces.append(piece(size))
            if len(pieces) < k:
                self.open[k] = (pieces, held + size)
            elif held + size == self.capacity:
                yield from self._lay(pieces)
            else:
                self.gaps.append((pieces, held + size))

    def close(self) -> Iterator[tuple]:
        """What is left, in full sequences and then in powers of two."""
        left = deque(p for pieces, _ in [*self.gaps, *(self.open[k] for k in sorted(self.open))] for p in pieces)
        self.open, self.gaps = {}, deque()
        total = sum(p[2] for p in left)
        rest = total % self.capacity
        for size in [self.capacity] * (total // self.capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]:
            pieces, held = [], 0
            while held < size:
                doc, start, length, n, ids = left.popleft()
                take = min(length, size - held)
                pieces.append((doc, start, take, n, ids[: 4 * take]))
                if take < length:
                    left.appendleft((doc, start + take, length - take, n, ids[4 * take :]))
                held += take
            yield from self._lay(pieces)

    def _lay(self, pieces: list[tuple]) -> Iterator[tuple]:
        own, self.next_id = self.next_id, self.next_id + 1
        offset = 0
        for p in pieces:
            yield (*p, own, offset)
            offset += p[2]


_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    tokenizer: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids, sequence_id, offset); ids are little-endian unsigned 32-bit numbers.

    capacity: a power of two. tokenizer, ranks: vocabulary files that every executor can open (the public ones by default).
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer or vocabulary_path("byte_bpe_50k.json"), ranks or (None if tokenizer else vocabulary_path("byte_bpe_50k.tiktoken")))
        bins, out, held = Bins(capacity, TaskContext.get().partitionId() << 36), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                out += bins.add(doc, ids)
                held += len(ids)
                if held > 1 << 20:
                    yield _batch(out)
                    out, held = [], 0
        yield _batch(out + list(bins.close()))

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])
