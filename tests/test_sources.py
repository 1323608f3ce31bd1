import json
import os
import socket
import struct

import pytest
from pyspark.sql import functions as F

from siltstone.plans import pipelines
from siltstone.operators import clustering
from siltstone.sources import files, pcap, schemas
from siltstone.streaming import matcher


def test_flow_csv(spark, tmp_path):
    names = [*schemas.FLOW_FEATURES, *schemas.STAGES]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(["1"] * 43 + [""]) + "\n")
    (tmp_path / "a.txt").write_text("not this\n")
    df = files.read_csv(spark, str(tmp_path), schemas.flow_schema(), glob="*.csv")
    row = df.first()
    assert df.count() == 1 and row["flow_psh"] == 1.0 and row["action"] is None and len(df.columns) == 44


def test_window_table(spark, tmp_path):
    assert len(schemas.window_columns()) == 115 and "SrcIP_mu_1.5s" in schemas.window_columns()
    (tmp_path / "w.csv").write_text(",".join(map(str, range(115))) + "\n")
    assert files.read_windows(spark, str(tmp_path / "w.csv")).first()["Jitter_max_1min"] == 114.0


def test_groups_round_trip(spark, tmp_path):
    (tmp_path / "g.csv").write_text("b,a,\nc,,\n")
    groups = files.read_groups(spark, str(tmp_path / "g.csv"))
    assert [(r.group_id, r["items"]) for r in groups.collect()] == [(0, ["a", "b"]), (1, ["c"])]
    files.write_groups(groups, str(tmp_path / "out"))
    assert sorted(r["items"] for r in files.read_groups(spark, str(tmp_path / "out")).collect()) == [["a", "b"], ["c"]]


def test_json_lines_and_annotations(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": 1, "a": [1, 2]}\n{broken\n{"id": 2}\n')
    (tmp_path / "n.json").write_text(json.dumps({"1": "benign"}))
    rows = files.read_json_lines(spark, str(tmp_path / "r.json"), "id long, a array<int>")
    assert rows.count() == 2
    notes = files.read_dictionary(spark, str(tmp_path / "n.json"))
    assert {r.id: r.label for r in files.attach_labels(rows, notes).collect()} == {1: "benign", 2: "unknown"}


def test_zip_labels(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row long, v string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "ID long, x int")
    assert {r.v: r.Label for r in files.zip_labels(df, labels, "row", "ID").collect()} == {"a": 0, "b": 1}


def test_database_needs_an_address(spark, monkeypatch):
    monkeypatch.delenv("SILTSTONE_DB_URL", raising=False)
    with pytest.raises(ValueError):
        files.read_database(spark, "flows")


def test_database_scan(spark, tmp_path):
    """A table written to and read from an embedded database, whole and in parallel slices; filters and columns reach it."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    flows = spark.range(200).select(F.col("id").cast("int").alias("id"), (F.col("id") * 0.5).alias("rate"), F.concat(F.lit("s"), F.col("id") % 3).alias("kind"))
    flows.write.jdbc(url, "flows", properties={"driver": driver})
    whole = files.read_database(spark, "flows", url, driver=driver)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in flows.collect())
    cut = files.read_database(spark, "flows", url, driver=driver, partitionColumn="id", lowerBound="0", upperBound="200", numPartitions="4")
    assert cut.rdd.getNumPartitions() == 4
    some = cut.where("id < 50 and rate >= 10").select("rate")
    assert some.count() == 30 and "PushedFilters: [*IsNotNull" in some._jdf.queryExecution().executedPlan().toString()


def test_flow_table_ddl(spark):
    name = "siltstone_test_flows"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    files.create_flow_table(spark, name)
    files.create_flow_table(spark, name)
    made = spark.table(name)
    assert made.columns == ["id", *schemas.FLOW_FEATURES, *schemas.STAGES] and made.count() == 0
    assert [f.dataType.simpleString() for f in made.schema.fields][:2] == ["int", "double"]
    spark.sql(f"DROP TABLE {name}")


def test_variant_sink(spark, tmp_path):
    rows = [("accuracy", "macro", 0.5, "Original"), ("accuracy", "macro", 0.25, "Adjusted")]
    files.write_variants(spark.createDataFrame(rows, "metric string, average string, value double, variant string"), str(tmp_path / "v"))
    back = files.read_csv(spark, str(tmp_path / "v"))
    assert back.columns == ["variant", "metric", "average", "value"] and {r.variant: r.value for r in back.collect()} == {"Original": 0.5, "Adjusted": 0.25}


def test_csv_sinks(spark, tmp_path):
    df = spark.range(25).repartition(1)
    files.write_csv(df, str(tmp_path / "o"), rows_per_file=10)
    assert len(list((tmp_path / "o").glob("*.csv"))) == 3 and files.read_csv(spark, str(tmp_path / "o")).count() == 25


def capture(frames, order="<", link=1):
    head = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(f"{order}4I", 1700000000 + i, 250, len(f), len(f)) + f for i, f in enumerate(frames))


def ipv4(protocol, source="10.0.0.1", target="10.0.0.2"):
    return bytes([0x45, 0, 0, 20, 0, 0, 0, 0, 64, protocol, 0, 0]) + socket.inet_aton(source) + socket.inet_aton(target)


def test_pcap(spark, tmp_path):
    ether = lambda kind, body: b"\0" * 12 + kind.to_bytes(2, "big") + body
    six = bytes([0x60, 0, 0, 0, 0, 0, 58, 1]) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2"
    frames = [ether(0x0800, ipv4(6)), ether(0x0806, b"\0" * 28), ether(0x8100, b"\0\1\x08\0" + ipv4(17)), ether(0x86DD, six)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    (tmp_path / "b.pcap").write_bytes(capture([ipv4(1)], ">", 101) + b"\0\1")
    (tmp_path / "c.pcap").write_bytes(b"nothing")
    got = pcap.read_pcap(spark, str(tmp_path / "*.pcap"))
    assert got.columns == [f.name for f in schemas.PACKET_SCHEMA]
    assert sorted((r.Protocol, r.Source, r.Length) for r in got.collect()) == [("ICMP", "10.0.0.1", 20), ("ICMPv6", "::1", 54), ("TCP", "10.0.0.1", 34), ("UDP", "10.0.0.1", 38)]


def test_layouts():
    shapes = {
        "a": [("onehot", 1), ("scale", 9), ("scale", 9), ("scale", 7), ("plain", 8)],
        "b": [("onehot", 1), ("scale", 5), ("scale", 5), ("scale", 5), ("scale", 4), ("scale", 4), ("scale", 7), ("plain", 8)],
        "c": [("onehot", 1), ("scale", 15), ("scale", 8), ("scale", 7), ("plain", 8)],
        "d": [("onehot", 1), ("scale", 9), ("scale", 9), ("scale", 15)],
        "port": [("onehot", 1), ("scale", 23), ("scale", 15), ("scale", 24), ("plain", 12)],
        "protocol": [("onehot", 1), ("scale", 12), ("scale", 10), ("scale", 7), ("plain", 8)],
        "window": [("scale", 15), ("scale", 5), ("scale", 3)],
    }
    for layout, shape in shapes.items():
        blocks = schemas.flow_spec(layout).blocks
        assert [(b.kind, len(b.columns)) for b in blocks] == shape
        used = [c for b in blocks for c in b.columns]
        assert len(used) == len(set(used))
        if layout in "abcd":
            assert set(used) <= set(schemas.FLOW_FEATURES)
    a, b = schemas.flow_spec("a").blocks, schemas.flow_spec("b").blocks
    assert {"total_bhlen", "total_fhlen"} <= set(a[3].columns) and not {"total_bhlen", "total_fhlen"} & {c for x in b for c in x.columns}
    assert {"total_length_of_forward_packets", "total_length_of_backward_packets"} <= set(b[6].columns)
    assert set(schemas.flow_spec("window").blocks[0].columns) <= set(schemas.window_columns())
    assert schemas.labelled_schema("port").names[-1] == "Label" and len(schemas.labelled_schema("port")) == 76


def test_many_categories_are_kept(spark):
    from siltstone.operators import features

    df = spark.range(3000).select("id", (F.col("id") * 7 % 1500).cast("int").alias("port"))
    built = features.build(df, features.FeatureSpec((features.Block("onehot", ("port",)),)), "id")
    got = built.select("id", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("ones"), (F.array_position("v", 1.0) - 1).alias("at")).collect()
    assert all(r.n == 1500 and r.ones == 1 and r["at"] == r.id * 7 % 1500 for r in got)
    with pytest.raises(ValueError):
        features.categories(df, "port", 1499)


def flows(spark, n=80):
    rows = [(i, float(i % 2), float(i % 2) * 3 - 1, float(i % 5), float(i % 2), 0.0, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, p double, q double, r double, reconnaissance double, infection double, action double")


def test_pipelines(spark):
    df = flows(spark)
    mined = pipelines.mine_signatures(df, "id", schemas.STAGES)
    assert [g.seed for g in mined.groups][0] == "p" and mined.top.count() == min(5, len(mined.groups)) + 1
    assert all(r.TP + r.FP == 40 and r.TN + r.FN == 40 for r in mined.cells.collect())
    from siltstone.operators.features import Block, FeatureSpec

    rows, values = pipelines.embed_cluster_evaluate(df.withColumn("label", F.col("p").cast("int")), "id", FeatureSpec((Block("scale", ("p", "q")),)), "label", clustering.kmeans, axes=2)
    accuracy = {r.variant: r.value for r in values.where("metric = 'accuracy' and average = 'macro'").collect()}
    assert sorted(accuracy.values()) == [0.0, 1.0] and rows.count() == 80


def test_streaming_agrees_with_batch(spark, tmp_path):
    df = flows(spark)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    groups = [(0, ["p", "q"]), (1, ["r"]), (2, ["missing_is_false"][:0])]
    stream = matcher.match_signatures(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), groups)
    matcher.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {r.id: r.matches for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.matches for r in matcher.match_signatures(df, groups).collect()} and len(got) == 80


def test_windowed_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = matcher.windowed_counts(events, "ts", ["event_type"], "1 day")
    assert got.agg(F.sum("n")).first()[0] == events.count()


def test_entry_module_without_the_training_subpackage(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path)
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    done = run("-c", "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))")
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) > 50
    # every remaining test module can be imported, and the functions' tests pass
    listed = run("-m", "pytest", "tests", "--collect-only", "-q")
    assert listed.returncode == 0 and "error" not in listed.stdout.lower(), listed.stdout[-2000:]
    passed = run("-m", "pytest", "tests/test_functions.py", "-q", "-x")
    assert passed.returncode == 0, passed.stdout[-2000:]


def test_entry_module_with_a_missing_library(tmp_path):
    import pathlib
    import subprocess
    import sys

    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')\n")
    root = pathlib.Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"})
    assert done.returncode == 0, done.stderr
