import random
import zlib

import numpy as np

from siltstone.llm import quality


def data(spark, n=900):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(20, 200))
        bad = i % 5 == 1
        kind = i % 3
        text = (" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 60))[kind] if bad else ". ".join(words)
        docs.append((i, text, 0.5))
        labels.append((i, int(not bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, score double")
    return df, spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = data(spark)
    model = quality.fit(docs, labels, most=400)
    assert len(model.labels) == 400
    out = quality.with_score(docs, model).withColumn("held", quality.held_out("doc_id")).collect()
    assert len(out) == 900 and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held]
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.97


def test_cases(spark):
    docs, labels, _ = data(spark, 200)
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a"), (3, "汉" * 50000)], "doc_id long, text string")
    got = quality.with_score(odd, model).collect()
    mean = round(float(model.labels.mean()), 6)
    assert len(got) == 5 and [round(r.score, 5) for r in got[:4]] == [round(mean, 5)] * 4
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.with_score(docs, none).collect()} == {0.5}
    assert quality.with_score(odd.limit(0), model).count() == 0


def test_scores_are_brute_force_votes(spark):
    docs, labels, _ = data(spark, 300)
    model = quality.fit(docs, labels, neighbours=7)
    texts = [r.text for r in docs.collect()][:50]
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        x = model.latent(quality.counts_of(raw, np.array([0, len(raw)])))[0].astype(np.float64)
        sims = model.vectors.astype(np.float64) @ x
        least = np.sort(sims)[-7]
        w = np.where(sims >= least - 1e-6, np.maximum(sims, 0), 0) ** 8
        assert abs(model.scores(quality.counts_of(raw, np.array([0, len(raw)])))[0] - (w * model.labels).sum() / w.sum()) < 1e-3
