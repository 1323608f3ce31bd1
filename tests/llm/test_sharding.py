import zlib
from collections import Counter, defaultdict

from siltstone.llm import sharding
from siltstone.llm.sharding import SlotMap

ROWS = [(i, f"text {i} " + "x" * (i * 37 % 300)) for i in range(600)] + [(1000 + i, "copy " * 40) for i in range(300)] + [(5, None), (6, ""), (None, "z"), (2007, "é"), (2007, "é")]


def test_whole_and_even(spark):
    df = spark.createDataFrame([(d, t, "s") for d, t in ROWS], "doc_id long, text string, shard string")
    out = sharding.shard(df, shards=6, slots=256).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    load, places = defaultdict(int), defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        places[r.shard].append(r.place)
    assert sorted(load) == list(range(6))
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 6
    for p in places.values():
        assert sorted(p) == list(range(len(p)))
    # light groups stay together, the heavy one is dealt out
    assert len({r.shard for r in out if r.doc_id == 2007}) == 1
    assert len({r.shard for r in out if r.doc_id and 2000 > r.doc_id >= 1000}) == 6


def test_map_versions(spark, tmp_path):
    weight = [(s * 7919) % 101 + 1 for s in range(200)]
    first = SlotMap.fresh(5, 200)
    second = first.rebalanced(weight)
    assert second.version == 1
    load = second.loads(weight)
    assert max(load) - min(load) <= 2 <= max(first.loads(weight)) - min(first.loads(weight))
    third = second.grown(weight)
    assert all(a == b or b == 5 for a, b in zip(second.of, third.of))
    grown = third.loads(weight)
    assert grown[5] >= 0.95 * sum(weight) / 6
    path = str(tmp_path / "map")
    for m in (first, second, third):
        m.frame(spark).write.mode("append").parquet(path)
    assert sharding.load_map(spark, path) == third
    assert sharding.load_map(spark, path, 0) == first


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(df, shards=3).count() == 0


def test_copies_stay_together_below_a_shards_share(spark):
    """Also with far fewer documents than slots, where most groups outweigh a slot's share."""
    rows = [(i, f"own words of document {i} " * (1 + i % 4)) for i in range(60)] + [(100 + i, f"copied text {i % 6} " * 5) for i in range(30)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    of = {r.doc_id: r.shard for r in out}
    for k in range(6):
        assert len({of[100 + i] for i in range(k, 30, 6)}) == 1
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert len(load) == 4 and max(load.values()) <= 1.02 * min(load.values())
    few = sharding.shard(spark.createDataFrame(rows[:3], "doc_id long, text string"), shards=8).collect()
    assert len({r.shard for r in few}) == 3 and all(r.place == 0 for r in few)
