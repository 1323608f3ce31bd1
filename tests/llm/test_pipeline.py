import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from siltstone.llm import quality
from siltstone.llm.packing import vocabulary_path
from tests.llm.test_simhash import brute_kept, brute_sets
from tests.llm.test_substring import brute as brute_substring


def tables(spark, folder):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(600)]
    passage = rng.choices(vocab, k=70)
    rows = []
    for i in range(160):
        words = rng.choices(vocab, k=rng.randint(1, 260))
        if i % 6 == 1:
            words = [w.upper() + "!!" for w in words]
        elif i % 9 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        rows.append((i, "\n".join([" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])])))
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 3)] + [(300, ""), (301, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 1), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    kept = []
    for d, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        if model.scores(quality.counts_of(raw, np.array([0, len(raw)])))[0] >= 0.3:
            kept.append((d, t))
    assert 100 < len(kept) < len(rows) - 15
    stay = set(brute_kept(kept))
    kept = [(d, t) for d, t in kept if d in stay]
    done = {d: (gone, left) for d, _, gone, left in brute_substring(kept, 50)}
    assert any(gone for gone, _ in done.values())
    texts = {d: (done[d][1] if done[d][0] else t) for d, t in kept}
    encode = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")).encode
    tokens = {d: len(encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    out = P.run(spark, str(tmp_path)).collect()
    got = {}
    for r in out:
        assert r.doc_tokens == tokens[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens


def test_stage_contracts(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert docs.where("n_chars <> char_length(text)").count() == 0
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_dedup_finds_texts_of_likeness_from_0_8(spark):
    words = [f"w{i}" for i in range(300)]
    other = [w if i % 60 else "changed" for i, w in enumerate(words)]
    text = [" ".join(words), " ".join(other), " ".join(reversed(words))]
    a, b = brute_sets(text[0]), brute_sets(text[1])
    assert len(a & b) / len(a | b) >= 0.8
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_dedup(spark, df, "").collect()) == [0, 2]
