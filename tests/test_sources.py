import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from veriloom.sources import manifest
from veriloom.streaming import online


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"image": {"sets": {"reg": ["a", "b"], "neg": []}, "items": {"a": {"path": "x", "sha256": "s"}, "b": {}}}, "audio": {"sets": {"reg": ["c"]}, "items": {}}}, indent=1))
    items, sets = manifest.read_manifest(spark, str(p))
    assert sorted((r.modality, r.item_id, r.path) for r in items.collect()) == [("image", "a", "x"), ("image", "b", None)]
    assert sorted((r.modality, r.set_name, r.item_id, r.ord) for r in sets.collect()) == [("audio", "reg", "c", 0), ("image", "reg", "a", 0), ("image", "reg", "b", 1)]


def test_records_catalogue_and_files(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump({"a": 1}, f)
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("a,b\n1,x\n")
    assert manifest.read_records(spark, str(tmp_path / "r.json.gz"), "a int, b string").collect() == [(1, None)]
    assert manifest.read_catalogue(spark, str(tmp_path / "c.csv.gz"), "a int, b string").collect() == [(1, "x")]
    (tmp_path / "f.bin").write_bytes(b"abc")
    f = manifest.read_files(spark, str(tmp_path), "*.bin").first()
    assert f.sha256 == hashlib.sha256(b"abc").hexdigest() and f.length == 3


def test_lock(spark):
    h = "ab" * 32
    files = spark.createDataFrame([("a", h), ("b", h.upper()), ("c", "00" * 32), ("d", None)], "k string, d string")
    lock = spark.createDataFrame([(k, h) for k in "abcd"], "k string, locked string")
    assert {r.k: r.status for r in manifest.verify(files, lock, "k", "d").collect()} == {"a": "equal", "b": "spelling", "c": "differs", "d": "missing"}
    with pytest.raises(PySparkException, match="digest differs"):
        manifest.verify(files, lock, "k", "d", strict=True).collect()


def test_descriptor_tables_prune_and_stale(spark, tmp_path):
    df = spark.createDataFrame([("m", "reg", "a", 1), ("n", "neg", "b", 2)], "method string, set_name string, item_id string, v int")
    manifest.write_descriptors(df, str(tmp_path / "d"))
    one = manifest.read_descriptors(spark, str(tmp_path / "d"), "m", ("reg",))
    assert one.count() == 1 and "PartitionFilters: [isnotnull(method" in one._jdf.queryExecution().toString()
    again = manifest.read_descriptors(spark, str(tmp_path / "d"))
    assert not manifest.stale(df, again.select(*df.columns)) and manifest.stale(df, df.unionByName(df)) and manifest.stale(df, df.drop("v"))
    manifest.write_records(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    back = manifest.read_records(spark, str(tmp_path / "j"), "item_id string, method string, set_name string, v int")
    assert sorted(map(tuple, back.collect())) == [("a", "m", "reg", 1), ("b", "n", "neg", 2)]
    assert manifest.register_set(df, df.select("item_id"), "extra").count() == 4


def test_stream_of_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i // 20}:{i % 60:02d}:00", "error" if i % 4 == 0 else "view") for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string").selectExpr("event_id", "cast(t as timestamp) as ts", "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {str(r.start): (r.n, r.errors) for r in online.run_windows(spark, str(tmp_path / "events.parquet")).collect()}
    want = {}
    for _, t, e in rows:
        n = want.setdefault(t[:13] + ":00:00", [0, 0])
        n[0] += 1
        n[1] += e == "error"
    assert {k: tuple(v) for k, v in want.items()} == got


def test_tar_of_json_lines(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        for name, data in (("a.json", b'{"x": 1}\n{"x": 2}\n'), ("b.json.gz", gzip.compress(b'{"x": 3}\n')), ("c.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = manifest.read_tar_lines(spark, str(tmp_path / "t.tar")).collect()
    assert sorted((r.member, r.line_no, json.loads(r.line)["x"]) for r in got) == [("a.json", 0, 1), ("a.json", 1, 2), ("b.json.gz", 0, 3)]


def test_evidence_tables(spark, tmp_path):
    p = spark.createDataFrame([("m", "s", True)], "method string, source_id string, hit boolean")
    manifest.write_evidence(p, p, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "neg")).count() == 1


def test_records_by_line_and_by_file(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"a": i}) for i in range(10)) + "\n{broken\n")
    (tmp_path / "one.json").write_text(json.dumps({"a": 10, "b": [1, 2]}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps([{"a": 11}, {"a": 12}], indent=1))
    (tmp_path / "flat.json").write_text(json.dumps([{"a": 13}, {"a": 14}]))
    (tmp_path / "empty.json").write_text("")
    got = [r.a for r in manifest.read_records(spark, str(tmp_path), "a int").collect()]
    assert sorted(x for x in got if x is not None) == list(range(15)) and got.count(None) == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from veriloom.plans import session

    class Cluster:
        class sparkContext:  # noqa: N801
            applicationId, master = "other", "spark://host:7077"  # noqa: N815

            @staticmethod
            def getConf():  # noqa: N802
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="share"):
        session.workspace(Cluster)


def test_drop_deletes_one_staged_table(spark):
    from veriloom.plans import session

    a, b = session.stage(spark.range(3).toDF("x"), "a"), session.stage(spark.range(4).toDF("x"), "b")
    session.drop(a)
    assert b.count() == 4
    with pytest.raises(Exception, match="."):
        spark.read.parquet(a.inputFiles()[0]).count()
