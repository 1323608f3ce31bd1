import random
from itertools import combinations

import pytest

from siltstone.operators import mining as M
from siltstone.operators import signatures as G

COLUMNS = list("abcdef")


def rows(seed, n=200):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = rng.random() < 0.6
        out.append((i, int(rng.random() < 0.5), [int(rng.random() < (0.85 if base else 0.3)) for _ in COLUMNS[:-1]] + [0]))
    return out


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame([(i, a, *x) for i, a, x in rows(1)], "row_id int, anomal int, " + ", ".join(f"{c} int" for c in COLUMNS))


def support(data, items):
    return sum(all(x[COLUMNS.index(c)] for c in items) for _, _, x in data)


def test_counts_and_itemsets(matrix):
    data = rows(1)
    tx = M.transactions(matrix, "row_id", COLUMNS)
    counts = M.collect_counts(tx, COLUMNS)
    assert counts.single == {c: support(data, [c]) for c in COLUMNS}
    assert all(counts.both(a, b) == support(data, [a, b]) for a, b in combinations(COLUMNS, 2))
    sets = {tuple(r["items"]): r.n for r in M.frequent_itemsets(tx, 0.3).collect()}
    want = {s: n for k in range(1, 7) for s in combinations(COLUMNS, k) if (n := support(data, s)) >= 0.3 * len(data)}
    assert sets == want
    top = {tuple(r["items"]) for r in M.last_level(M.frequent_itemsets(tx, 0.3)).collect()}
    assert top == {s for s in want if len(s) == max(map(len, want))}


def test_rules_with_all_consequents(matrix):
    data = rows(1)
    sets = M.frequent_itemsets(M.transactions(matrix, "row_id", COLUMNS), 0.3)
    got = {(tuple(r.antecedent), tuple(r.consequent)): round(r.confidence, 9) for r in M.rules(sets, 0.7).collect()}
    want = {}
    for s in [tuple(r["items"]) for r in sets.collect()]:
        for k in range(1, len(s)):
            for a in combinations(s, k):
                c = support(data, s) / support(data, a)
                if c >= 0.7:
                    want[a, tuple(x for x in s if x not in a)] = round(c, 9)
    assert got == want and any(len(c) > 1 for _, c in want)
    assert all("a" not in r.antecedent + r.consequent for r in M.rules(sets, 0.7, excluded=["a"]).collect())


def test_candidates(spark):
    frequent = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["b", "c"],)], "items array<string>")
    assert [r["items"] for r in M.candidates(frequent).collect()] == [["a", "b", "c"]]


def by_hand(data, confidence):
    """The greedy stars as their definition reads."""
    n = {c: support(data, [c]) for c in COLUMNS}
    done, out = set(), []
    for a in sorted(COLUMNS):
        if a in done:
            continue
        group = [a]
        out.append(set(group))
        for b in sorted(COLUMNS):
            both = support(data, [a, b])
            if b not in group and n[a] and n[b] and both / n[a] >= confidence and both / n[b] >= confidence:
                group.append(b)
                done.add(b)
                out.append(set(group))
    return out


@pytest.mark.parametrize("confidence", [0.5, 0.7, 0.8, 0.95])
def test_related_groups(matrix, confidence):
    counts = M.collect_counts(M.transactions(matrix, "row_id", COLUMNS), COLUMNS)
    groups = M.related_groups(counts, confidence)
    assert [set(g.items) for g in groups] == by_hand(rows(1), confidence)
    assert {"f"} in [set(g.items) for g in groups]  # a column of zeros seeds a group of its own
    for g, h in zip(groups, groups[1:]):
        if h.step:
            assert len(h.items) == len(g.items) + 1 and h.seed == g.seed
    final = M.related_groups(counts, confidence, snapshots=False)
    assert len(final) == sum(g.step == 0 for g in groups)


def test_confusion_and_metrics(matrix):
    data = rows(1)
    groups = [(i, list(s)) for i, s in enumerate(combinations(COLUMNS, 2))] + [(99, [])]
    for mode in ("reference", "standard"):
        for r in G.metrics(G.confusion(matrix, groups, mode=mode)).collect():
            items = dict(groups)[r.group_id]
            match = [(a, all(x[COLUMNS.index(c)] for c in items)) for _, a, x in data]
            hit, miss = sum(a and m for a, m in match), sum(a and not m for a, m in match)
            benign = sum(not a and m for a, m in match)
            fp, fn = (miss, benign) if mode == "reference" else (benign, miss)
            assert (r.TP, r.FP, r.FN, r.TN) == (hit, fp, fn, len(data) - hit - miss - benign)
            assert abs(r.accuracy - (r.TP + r.TN) / len(data)) < 1e-12
            assert r.precision == (r.TP / (r.TP + r.FP) if r.TP + r.FP else 0)


def test_ties_keep_the_least_group(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9, 0, -1)], "group_id int, precision double")
    assert [r.group_id for r in G.top(df).collect()] == [1, 2, 3, 4, 5]
    last = G.top_with_mean(df).collect()[-1]
    assert (last.eva_row, last.precision) == ("Precision Mean", 1.0)


def test_sweep_and_grid(matrix):
    counts = M.collect_counts(M.transactions(matrix, "row_id", COLUMNS), COLUMNS)
    assert len(G.thresholds()) == 18
    swept = G.sweep(matrix, {t: [(g.group_id, list(g.items)) for g in M.related_groups(counts, t)] for t in G.thresholds()})
    assert swept.count() == 18 and G.best(swept).count() == 1
    scored = G.metrics(G.confusion(matrix, [(0, ["a"])]))
    assert G.confidence_grid(scored).count() == 2234


def test_differences(spark):
    a = spark.createDataFrame([(["x", "y"],), (["z"],)], "items array<string>")
    b = spark.createDataFrame([(["y"],), (["z"],)], "items array<string>")
    assert sorted(r.item for r in G.difference_items(a, b).collect()) == ["x", "y", "z"]
    assert sorted(r["items"] for r in G.difference_sets(a, b).collect()) == [["x"], ["x", "y"], ["z"]]


def test_empty(spark):
    tx = spark.createDataFrame([], "row_id int, items array<string>")
    assert M.frequent_itemsets(tx, 0.1).count() == 0 and M.pair_counts(tx).count() == 0
    assert G.confusion(spark.createDataFrame([], "anomal int, a int"), [(0, ["a"])]).collect()[0].TP == 0
