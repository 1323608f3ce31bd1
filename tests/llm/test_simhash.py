import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import common, simhash
from tests.llm.shuffled import shuffled_bytes


def brute_fp(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = low.split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fps = [brute_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Été", "X"]
    rows = []
    for i in range(150):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        rows.append((i * 3, " ".join(words)))
        if i % 4 == 0 and len(words) > 30:
            for k in range(3):
                other = list(words)
                other[rng.randrange(len(other))] = "changed"
                rows.append((1000 + 10 * i + k, "\n".join(other)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "a"), (5003, "a"), (None, "a b"), (5004, "A B"), (5005, "x " * 30000)]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute_groups(rows)


def test_cut_tiles_and_empty(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = [int(b) ^ int(m) for b in base for m in (0, 1, 6, 7 << 20, 1 << 40)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    whole = {(r.id, r.component_id) for r in simhash.groups(df).collect()}
    monkeypatch.setattr(simhash, "BLOCK", 3)
    assert {(r.id, r.component_id) for r in simhash.groups(df).collect()} == whole
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(spark):
    rows = [(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (3, "other words stand here now", "z"), (None, "q", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.lang for r in kept.collect()) == ["n", "y", "z"]


def brute_sets(text, width=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_kept(rows):
    """Least id of each group of texts chained by a Jaccard likeness of 0.8 or more."""
    sets = [brute_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= 0.8:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def near_copies(seed, n=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(1, 200))]
        rows.append((100 * i, " ".join(words)))
        for k in range(1, 9):
            other = list(words)
            for _ in range(rng.randint(1, 6)):
                other[rng.randrange(len(other))] = f"changed{rng.randrange(9)}"
            rows.append((100 * i + k, "\n".join(other)))
    return rows + [(9000, ""), (9001, None), (9002, " \t"), (9003, "A b"), (9004, "a B")]


def test_groups_of_a_likeness_against_brute_force(spark, monkeypatch):
    rows = near_copies(3)
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, k string, g int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    # tiles and groups in many pieces give the same
    for name, value in (("MOST_TILE", 16), ("LEAST_TILE", 1), ("MEMBERS", 3)):
        monkeypatch.setattr(simhash, name, value)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == brute_kept(rows)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_rows_that_are_surely_kept_or_gone_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(700)) for _ in range(200)]
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(texts[:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    with shuffled_bytes(spark) as sent:
        kept = simhash.keep_one(df)
        kept.write.format("noop").mode("overwrite").save()
    assert sent[0] < sum(len(t) for _, t in rows) / 4
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    # a full filter sends all rows to the exact join
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(200))
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(near_copies(3), "doc_id long, text string")).collect()) == brute_kept(near_copies(3))


def test_keep_one_tells_rows_of_one_id_by_their_text(spark):
    a, b = "a b c d e f g h", "totally different words that stand here instead"
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (None, b, "n"), (None, "only here", "o"), (3, "twice", "t"), (3, "twice", "t")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (1, b), (0, "only here"), (3, "twice")])


def test_a_fingerprint_without_an_id_links_others(spark):
    rows = [(7, 0), (None, 7), (9, 63)]
    got = {r.id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "id long, fp long")).collect()}
    assert got == {7: 7, None: 7, 9: 7}
    alone = simhash.groups(spark.createDataFrame([(None, 5)], "id long, fp long")).first()
    assert alone.component_id is None


def test_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)
