"""BPE encoding with a queue of merges over a linked list of symbols, and decoding from the vocabulary.

``Codec`` reads a tokenizer file of the kind word_bpe_49k.json (NFC, white space to one space, lower case; a split by pattern
that drops what does not match; byte-level symbols with an end-of-word suffix) and gives the ids that the tokenizers library
gives without special tokens. A word's symbols form a doubly linked list; a heap holds (rank, place) of mergeable neighbours
and entries whose symbols have changed are skipped when they come up. Words repeat, so their ids are kept in a bounded table.

Decoding joins the ids' vocabulary strings; the file names no decoder, so they are joined by one space, special tokens
included.

Cases: a null or empty text has no ids and decodes to the empty text. Very long words take n log n steps. Null and repeated
ids keep their rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.packing import vocabulary_path

#: Texts with other characters than these are normalized and split by the library's own steps: Unicode versions differ on them.
_OTHER = re.compile("[^\x00-\u024f]")
#: Words kept with their ids in a worker, about 60 MB.
KEPT_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


class Codec:
    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"] or []}
        self.strings = {**{i: s for s, i in self.vocab.items()}, **{i: s for s, i in special.items()}}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = self.vocab.get(a + b)
            if joined is not None:
                self.merges[self.vocab[a], self.vocab[b]] = (rank, joined)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.inner = [self.vocab.get(s) for s in symbols]
        self.final = [self.vocab.get(s + self.suffix) for s in symbols]
        self.kept: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.final[raw[-1]])
        if None in ids:  # without an unknown token such symbols give nothing
            ids = [i for i in ids if i is not None]
        n, ranks = len(ids), self.merges
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = ranks.get((ids[i], ids[i + 1]))
            if found is not None:
                queue.append((found[0], i, found[1]))
        heapify(queue)
        while queue:
            rank, i, joined = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks.get((ids[i], ids[j])) != (rank, joined):
                continue  # stale: a symbol has been merged meanwhile
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((joined, ids[k]))
                if found is not None:
                    heappush(queue, (found[0], i, found[1]))
            p = before[i]
            if p >= 0:
                found = ranks.get((ids[p], joined))
                if found is not None:
                    heappush(queue, (found[0], p, found[1]))
        return [i for i in ids if i >= 0]

    def split(self, text: str) -> list[str]:
        """Normalized words."""
        if not _OTHER.search(text):
            return self.words(text.lower())
        pieces = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in pieces]

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian unsigned 32-bit numbers."""
        kept, words = self.kept, self.split(text)
        try:
            return b"".join([kept[w] for w in words])
        except KeyError:
            pass
        new = {w for w in words if w not in kept}
        for w in new:
            kept[w] = np.array(self.merge(w), "<u4").tobytes()
        out = b"".join([kept[w] for w in words])
        if len(kept) > KEPT_WORDS:
            kept.clear()
        return out

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in parts)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text; ids are little-endian unsigned 32-bit numbers.

    tokenizer: a vocabulary file that every executor can open (the public word_bpe_49k.json by default).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer or vocabulary_path("word_bpe_49k.json"))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [codec.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
