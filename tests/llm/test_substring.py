import random

import numpy as np

from siltstone.llm import common, substring
from siltstone.llm.fmindex import FMIndex, WaveletMatrix
from tests.llm.shuffled import shuffled_bytes


def brute(rows, window):
    seen = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                seen[k] = min(seen.get(k, d), d)
    out = []
    for d, w in texts:
        off = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and seen[tuple(w[i : i + window])] < d:
                off[i : i + window] = [True] * window
        out.append((d, len(w), sum(off), " ".join(x.decode() for x, o in zip(w, off) if not o)))
    return sorted(out, key=str)


def rows_for(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    passages = [rng.choices(vocab, k=k) for k in (50, 51, 64, 90, 140, 300)]
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edit"
            at = rng.randint(0, len(words))
            words[at:at] = p
        rows.append((rng.randrange(10 * n), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(7, None), (8, ""), (9, " \n "), (None, " ".join(passages[3])), (3, " ".join(["same"] * 200)), (4, " ".join(["same"] * 120)), (4, " ".join(["same"] * 120))]
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df).collect()), key=str)
    assert got == brute(rows, 50)


def test_against_brute_force(spark):
    check(spark, rows_for(1))


def test_crowded_names(spark, monkeypatch):
    monkeypatch.setattr(substring, "NAME_ROWS", 2)
    check(spark, rows_for(2))


def test_texts_that_lose_nothing_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(substring, "NAME_ROWS", 2)
    rng = random.Random(5)
    word = lambda: f"{rng.getrandbits(60):x}"
    rows = [(i, " ".join(word() for _ in range(700))) for i in range(100, 300)]
    passage = [word() for _ in range(60)]
    rows += [(i, " ".join([word() for _ in range(5)] + passage + [word() for _ in range(5)])) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    with shuffled_bytes(spark) as sent:
        substring.remove_repeats(df).write.format("noop").mode("overwrite").save()
    assert sent[0] < sum(len(t) for _, t in rows) / 4
    check(spark, rows)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "NAME_ROWS", 2)
    monkeypatch.setattr(substring, "FILTER_WORDS", 1)
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    check(spark, rows_for(6))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(df).count() == 0


def test_spans_add_up(spark):
    df = spark.createDataFrame(rows_for(3, 40), "doc_id long, text string")
    for r in substring.remove_repeats(df).collect():
        assert sum(s.size for s in r.removed_spans) == r.n_removed


def test_wavelet_rank():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 37, 1000)
    w = WaveletMatrix(x, 37)
    c, i = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert (w.rank(c, i) == [(x[:b] == a).sum() for a, b in zip(c, i)]).all()


def test_index_reports_least_owner():
    rng = np.random.default_rng(1)
    segs = [rng.integers(0, 3, n).astype(np.uint64) for n in (9, 12, 7, 30, 5, 3)]
    owner = np.array([5, 4, 3, 9, 1, 0])
    index = FMIndex(np.concatenate(segs), np.array([len(s) for s in segs]), owner, depth=5)
    for seg, at, least in index.windows():
        for s, a, o in zip(seg, at, least):
            w = segs[s][a : a + 5]
            want = min(owner[k] for k, t in enumerate(segs) for i in range(len(t) - 4) if (t[i : i + 5] == w).all())
            assert o == want
