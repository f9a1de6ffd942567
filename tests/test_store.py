"""One store for tables and streams; pruning by the catalog; records from a wire; waiting for metadata inside ingest."""

import json
import os
import shutil
import time

from pyspark.sql import functions as F

from sievelog.operators import search
from sievelog.sources.store import LogStore, as_json
from sievelog.streaming.ingest import from_wire, ingest, stored

from .records import frame

NOON, S = 1780142400, 1_000_000_000  # 2026-05-30T12:00:00Z


def rows(spark, n, first=0, **kw):
    return frame(spark, [{"_ts_nanos": (NOON + first + i) * S, "offset": first + i + 1, "_message": json.dumps({"i": first + i})} | kw for i in range(n)])


def write_log(root, pod, text, mode="a"):
    folder = root / pod / "app"
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / "0.log", mode) as f:
        f.write(text)


def line(i, message="x"):
    return f"2026-05-30T12:00:{i:02d}Z stdout F {message}\n"


def test_tables_and_streams_share_a_store(spark, tmp_path):
    root, store = tmp_path / "pods", LogStore(spark, str(tmp_path / "store"))
    assert store.query().count() == 0 and store.fields().first()["pods"] == [] and store.watermarks().count() == 0
    write_log(root, "prod_web_u1", line(1) + line(2))
    run = lambda check="check": ingest(spark, str(root), store.path, str(tmp_path / check)).awaitTermination()
    run()
    store.write(rows(spark, 1))
    assert store.records().count() == 3
    write_log(root, "prod_web_u1", line(3))
    run()
    assert store.records().count() == 4 and store.catalog().count() == 3
    shutil.rmtree(tmp_path / "check")  # a lost checkpoint reads all again, and stores nothing twice
    run()
    write_log(root, "prod_web_u1", line(4))
    run("other")
    assert store.records().count() == 5 and store.watermarks().agg(F.sum("offset")).first()[0] == 4 * len(line(1)) + 1


def test_a_batch_that_is_written_again_replaces_itself(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for n in (3, 2):
        store.write(rows(spark, n), batch="s1-0000000001")
    assert store.records().count() == 2 and store.catalog().count() == 1
    os.makedirs(tmp_path / "store/records/batch=half/date=2026-05-30")  # begun and not committed
    assert store.records().count() == 2
    shutil.rmtree(tmp_path / "store/catalog")
    store.recover()
    assert store.records().count() == 2


def test_searches_read_only_what_the_catalog_allows(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.write(rows(spark, 50, _namespace="prod"))
    store.write(rows(spark, 50, 100, _namespace="staging"))
    store.write(rows(spark, 50, 86_400, _namespace="prod"))
    names = lambda q, *t: store.candidates(q, *t).count()
    assert names("") == 3 and names('_namespace = "prod" and i > 3') == 2 and names('_namespace = "prod" or _namespace = "staging"') == 3
    assert names('_namespace = "prod"', NOON, NOON + 60) == 1 and names('_pod = "none"') == 0 and names('not _namespace = "prod"') == 3
    assert store.query('_pod = "none"').count() == 0 and store.query('_namespace = "staging" and i >= 120').count() == 30
    assert len(store.query('_namespace = "prod"', NOON + 80_000).inputFiles()) < len(store.records().inputFiles())
    for q in ("", '_namespace = "prod"', 'i >= 10 and not _namespace = "prod"'):
        assert store.query(q).count() == search.matching(store.records(), q).count()


def test_compaction_keeps_all_rows(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for k in range(3):
        store.write(rows(spark, 5, 10 * k))
    store.write(rows(spark, 5, 86_400))
    before = sorted(r["offset"] for r in store.records().collect())
    assert store.compact("2026-05-30", files=1) and store.compact("2026-05-30") is None
    assert sorted(r["offset"] for r in store.records().collect()) == before and store.catalog().count() == 2
    store.vacuum()
    assert sorted(r["offset"] for r in store.records().collect()) == before


def test_repeated_keys_and_statistics(spark, tmp_path):
    df = frame(spark, [{"_message": '{"a":1,"a":2}'}, {"_message": '{"b":{"c":1}}', "_labels": {"x": "y"}}])
    assert search.matching(df, "a = 2").count() == 1 and search.matching(df, "a = 1").count() == 0
    stats = search.statistics(df).first()
    assert stats["records"] == 2 and {"a", "b"} <= set(stats["fields"]) and "x" in stats["labels"]


def test_records_from_a_wire(spark, tmp_path):
    df = rows(spark, 4).withColumn("source", F.expr("named_struct('node', 'n', 'path', '/p', 'dev', 1bd, 'ino', 2bd, 'ctime', 0L)"))
    lines = [r["line"] for r in as_json(df).collect()]
    values = [lines[0], "{", "[" + ",".join(lines[1:3]) + "]", "", '{"offset":1}', lines[3], None]
    path = str(tmp_path / "in")
    spark.createDataFrame([(v.encode() if v is not None else None,) for v in values], "value binary").write.parquet(path)
    assert from_wire(spark.read.parquet(path)).count() == 4
    store = LogStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("value binary").parquet(path)
    for _ in range(2):
        stored(from_wire(stream), store, str(tmp_path / "check")).awaitTermination()
    assert store.query("i >= 2").count() == 2 and store.records().count() == 4


def test_ingest_waits_for_pods_of_a_stream(spark, tmp_path):
    root, store = tmp_path / "pods", LogStore(spark, str(tmp_path / "store"))
    (tmp_path / "meta").mkdir()
    schema = "uid string, labels map<string,string>, annotations map<string,string>, node string, images map<string,string>"
    spark.createDataFrame([("u1", {"app": "web"}, {}, "n1", {"app": "img"}), ("u2", {}, {"logs": "false"}, "n2", {})], schema).write.mode("append").parquet(str(tmp_path / "meta"))
    for pod in ("prod_web_u1", "prod_out_u2", "prod_late_u3"):
        write_log(root, pod, line(1, pod))
    run = ingest(spark, str(root), store.path, str(tmp_path / "check"), pods=spark.readStream.schema(schema).parquet(str(tmp_path / "meta")), opt_out="logs", wait_ms=3_600_000, trigger={"processingTime": "1 second"})
    got = []
    for _ in range(90):
        time.sleep(1)
        got = store.query().select("_pod", "_node", "_image", F.col("_labels")["app"].alias("app")).collect()
        if got:
            break
    run.stop()
    assert [tuple(r) for r in got] == [("web", "n1", "img", "web")]
