import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import bpe
from siltstone.llm.packing import vocabulary_path

PATH = vocabulary_path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(PATH)


def same(text):
    ids = WHOLE.encode(text, add_special_tokens=False).ids
    got = CODEC.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert CODEC.decode(got) == WHOLE.decode(ids, skip_special_tokens=False)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghij 'ÉéßÄstdΣσς0123!?|", max_size=80))
def test_common_text(text):
    same(text)


def test_chosen_texts():
    for text in ("", " ", "It's they'LL", "ΟΔΟΣ Σ", "İstanbul", "e\u0301É", "a<|endoftext|>b <|startoftext|>", "!!! ### ***", "x" * 5000, "the " * 3000):
        same(text)


def test_table(spark):
    rows = [(1, "Some text, some more."), (1, "Some text, some more."), (2, None), (None, "x"), (3, "")]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.round_trip(df).collect()), key=str)
    want = []
    for d, t in rows:
        ids = WHOLE.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), np.array(ids, "<u4").tobytes(), WHOLE.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    codec = bpe.Codec(PATH)
    for text in ("one two three four five", "six seven", "one"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids
