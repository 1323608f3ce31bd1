import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing

PATH, RANKS = packing.vocabulary_path("byte_bpe_50k.json"), packing.vocabulary_path("byte_bpe_50k.tiktoken")
WHOLE = Tokenizer.from_file(PATH)
FAST = packing.encoder(PATH, RANKS)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n\t\r\x1c\x85\xa0'sst")), max_size=80))
def test_fast_ids_are_the_librarys(text):
    assert FAST(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_other_texts_and_special_tokens():
    for text in ("汉字 и кириллица ٣", "a<|endoftext|>b", "<|endoftext|>", "", "e\u0301", "👍🏽"):
        assert FAST(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_every_id_once_and_no_padding(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(["the", "of", "Zäune", "x!"], k=rng.choice([0, 1, 5, 300, 3000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (3, "again"), (None, "none"), (102, "word " * 40000)]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, length int").repartition(3)
    out = packing.pack(df, capacity=1024).collect()
    bins = defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length and r.length >= 1
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    whole = sorted(WHOLE.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows)
    assert sum(map(len, whole)) == sum(r.length for r in out)
    by = defaultdict(list)
    for r in out:
        if r.doc_id != 3:
            by[r.doc_id].append(r)
    for d, t in rows:
        if d != 3:
            ids = np.frombuffer(b"".join(bytes(r.ids) for r in sorted(by[d], key=lambda r: r.start)), "<u4").tolist()
            assert ids == WHOLE.encode(t or "", add_special_tokens=False).ids + [0]
            assert all(r.doc_tokens == len(ids) for r in by[d])


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bins_take_a_class_count_of_whole_documents():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 3000, 2000)
    bins = packing.Bins(1024, 0)
    before, after = [], []
    for d, n in enumerate(lengths):
        before += bins.add(d, np.full(n, d, np.uint32).astype("<u4"))
    after += bins.close()
    laid = defaultdict(list)
    for p in before:
        laid[p[5]].append(p)
    for pieces in laid.values():
        assert sum(p[2] for p in pieces) == 1024
        if pieces[0][2] < 1024:
            # the class is that of the first piece, and it holds as many pieces of that class before its gap is filled
            k = 1024 // pieces[0][2]
            assert [1024 // p[2] for p in pieces[:k]] == [k] * k
            # what fills the gap is cut only where it is full or left whole
            assert all(p[1] + p[2] == p[3] for p in pieces[k:-1])
    count = defaultdict(int)
    for p in [*before, *after]:
        count[p[0]] += 1
    whole = sum(int(n) // 1024 for n in lengths)
    sequences = len({p[5] for p in [*before, *after]})
    assert sum(count.values()) <= len(lengths) + whole + sequences
    assert sum(p[2] for p in [*before, *after]) == lengths.sum()
