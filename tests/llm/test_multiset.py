import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from siltstone.llm import multiset as M

ROWS = [
    (1, "one two three\nfour five six seven eight nine ten eleven twelve\nend"),
    (2, "end\none two three\nfour five six seven eight nine ten eleven twelve"),
    (4, None),
    (9, ""),
    (7, "é" * 31),
    (30, "a b c d\n" * 500),
    (None, "nothing"),
    (31, "a b c d\n" * 500),
    (32, "x"),
    (32, "y z"),
]


def brute(rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-(2**70) if r[0] is None else r[0]))
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    return M.edited_fingerprints(df, {"sha": F.sha2("edited", 256), "edited": F.col("edited")}).collect()


def test_edit_follows_the_order(spark):
    rows = [r for r in ROWS if r[0] != 32]
    got = sorted(((r.doc_id, r.n_chars, r.sha) for r in run(spark, rows)), key=str)
    assert got == sorted(brute(rows), key=str)


def test_next_over_many_ranges(spark):
    rows = [(i * 13 % 1009, f"text number {i} " * (i % 5)) for i in range(1009)]
    got = sorted((r.doc_id, r.n_chars, r.sha) for r in run(spark, rows))
    assert got == sorted(brute(rows))


def test_order_does_not_count_and_copies_agree(spark):
    got = {r.doc_id: r for r in run(spark, ROWS)}
    assert got[1].fp == got[2].fp and got[4].fp == got[9].fp and got[1].fp != got[7].fp
    assert got[30].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert len(run(spark, ROWS)) == len(ROWS)


def test_likeness_tells_edits_from_neighbours(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(40)]
    got = run(spark, rows)
    assert all(r.near_edited > 0.25 > r.near_next or r.near_edited > r.near_next + 0.1 for r in got)


def test_insert_and_delete(spark):
    df = spark.createDataFrame([("x", "a b\nc d"), ("y", "e f g\nh"), ("z", "a b\nc d\ne f g\nh")], "name string, text string")
    fp = {r.name: r.fp for r in M.fingerprints(df, ["name"]).collect()}
    one = spark.createDataFrame([(fp["x"], fp["y"], fp["z"])], "x array<long>, y array<long>, z array<long>")
    r = one.select("*", M.plus(F.col("x"), F.col("y")).alias("s"), M.minus(F.col("z"), F.col("y")).alias("d")).first()
    assert r.s == r.z and r.d == r.x


def test_one_and_none(spark):
    assert run(spark, []) == []
    one = run(spark, [(5, "abcd")])
    assert one[0].edited == "abab" and one[0].near_next == 1.0


def hashed(*values):
    """Spark's xxhash64: each value's hash seeds the next; nulls are left out."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little") if v is not None and not isinstance(v, bytes) else v
        seed = seed if v is None else xxhash.xxh64_intdigest(raw, seed)
    return seed


def integer(n):
    return n.to_bytes(4, "little")


def brute_fp(text):
    dense, bits, n = [0] * 16, [0] * 180, 0
    for p in text.split("\n"):
        g, h = hashed(integer(0), p), hashed(integer(1), p)
        for j in range(8):
            d = hashed(g, h, integer(j))
            dense[2 * j] += d % 2**32
            dense[2 * j + 1] += d >> 32
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", p) if w]
        t = [hashed(x) for w in words for x in ([w] if len(w) <= 16 else re.findall(r"[\u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF]|[^ \u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF]{1,16}", w))]
        for i in range(max(1, len(t) - 3) if t else 0):
            run = hashed(*t[i : i + 4])
            n += 1
            for j in range(3):
                s = hashed(run, integer(j))
                for k in range(20):
                    for lane in range(3):
                        bits[(j * 20 + k) * 3 + lane] += s >> (k + 20 * lane) & 1
    packed = [bits[3 * i] + (bits[3 * i + 1] << 20) + (bits[3 * i + 2] << 40) for i in range(60)]
    signs = [2 * b - n for b in bits]
    return [n, *[d % 2**32 for d in dense], *packed], signs


def test_fingerprints_and_likeness_against_an_independent_version(spark):
    rows = [r for r in ROWS if r[0] != 32] + [(40, "汉字和词语 mixed with words " * 3 + "汉字和词语" * 5), (41, "averyveryverylongwordwithoutanyspaces" * 3), (42, "汉字和词语 mixed with a word")]
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-(2**70) if r[0] is None else r[0]))
    got = {r.doc_id: r for r in run(spark, rows)}

    def likeness(a, b):
        if a[0] == b[0]:
            return 1.0
        norm = (sum(x * x for x in a[1]) * sum(x * x for x in b[1])) ** 0.5
        return min(1.0, max(0.0, sum(x * y for x, y in zip(a[1], b[1])) / norm)) if norm else 0.0

    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 2
        own, edit, other = brute_fp(t), brute_fp(t[: len(t) - k] + nxt[:k]), brute_fp(nxt)
        assert got[d].fp == own[0] and got[d].edited_fp == edit[0]
        assert abs(got[d].near_edited - likeness(own, edit)) < 1e-9 and abs(got[d].near_next - likeness(own, other)) < 1e-9


def test_a_word_more_early_in_a_line_changes_little(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([("x", " ".join(words)), ("y", " ".join(["new", *words]))], "name string, text string")
    x, y = (r.fp for r in M.fingerprints(df, ["name"]).orderBy("name").collect())
    got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(M._dot(M.sketch_of(F.col("x")), M.sketch_of(F.col("y"))).alias("xy"), M._dot(M.sketch_of(F.col("x")), M.sketch_of(F.col("x"))).alias("xx")).first()
    assert got.xy / got.xx > 0.9
