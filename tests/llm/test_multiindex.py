import numpy as np

from siltstone.llm import multiindex as M


def brute(rows, cosine=0.9):
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in good], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, True)
    links = {g: int(near[k].sum()) - 1 for k, g in enumerate(good)}
    label = np.array([rows[g][0] for g in good])
    while True:
        new = np.array([label[near[k]].min() for k in range(len(good))])
        if (new == label).all():
            break
        label = new
    root = dict(zip(good, label.tolist()))
    return sorted(((d, links.get(i, 0), root.get(i, d), d is not None and root.get(i, d) == d) for i, (d, _) in enumerate(rows)), key=str)


def planted(seed, n=900, groups=40):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    rows = [(i * 2, v) for i, v in enumerate(base)]
    for g in range(groups):
        for k in range(int(rng.integers(1, 6))):
            rows.append((5000 + g * 10 + k, base[g] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])))
    rows += [(9000 + i, base[7]) for i in range(60)]  # copies
    return [(d, v.astype(np.float32).tolist()) for d, v in rows]


ODD = [(1, None), (3, []), (5, [0.0] * 16), (7, [float("nan")] * 16), (9, [1.0, float("inf")] * 8), (11, [None] + [1.0] * 15), (13, [1.0] * 5), (None, [1.0] * 16)]


def run(spark, rows):
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<float>, label int")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in M.near_duplicates(df).collect()), key=str)


def test_recall_and_precision(spark):
    rows = planted(1) + ODD + [(9000, planted(1)[7][1])]
    got, want = run(spark, rows), brute(rows)
    assert len(got) == len(want)
    total = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.98 * total
    by = {}
    for w in want:
        by.setdefault(w[0], []).append(w)
    assert all(g[1] <= max(w[1] for w in by[g[0]]) for g in got)
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)


def test_blocks_agree(spark, monkeypatch):
    rows = planted(2, 300, 20)
    whole = run(spark, rows)
    monkeypatch.setattr(M, "MEMBERS", 7)
    monkeypatch.setattr(M, "VISITORS", 11)
    assert run(spark, rows) == whole


def test_chains_join(spark):
    step = np.eye(16)
    rows = [(i, (np.cos(i * 0.3) * step[0] + np.sin(i * 0.3) * step[1] + step[2] * 0).tolist()) for i in range(12)]
    assert {r[2] for r in run(spark, rows)} == {0}


def test_nothing(spark):
    assert run(spark, []) == []
    assert all(r[1] == 0 for r in run(spark, ODD))


def test_every_length_is_compared(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [3.0]), (6, [4.0]), (7, [-1.0])]
    assert run(spark, rows) == [(0, 1, 0, True), (1, 1, 0, False), (2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]


def test_traversal_visits_by_the_sum_of_both_ways():
    unit = np.random.default_rng(4).standard_normal((500, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    index = M.Index.fit(unit, 16, 0.9, 0.99)
    a, b = index.bounds(unit[:40])
    row, first, count, seconds = index.traverse(unit[:40])
    got = set(zip(np.repeat(row, count).tolist(), np.repeat(first, count).tolist(), seconds.tolist()))
    assert got == {(r, i, j) for r in range(40) for i in range(16) for j in range(16) if a[r, i] + b[r, j] <= index.reach}
    at = 0
    for r, n in zip(row, count):
        assert (np.diff(b[r, seconds[at : at + n]]) >= 0).all()
        at += n
    assert (np.diff(a[row, first])[np.diff(row) == 0] >= 0).all()
