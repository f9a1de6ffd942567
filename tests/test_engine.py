import json

import pytest
from pyspark.sql import functions as F

from sievelog.functions.times import format_time, nanos_of, parse_time, stamp_of
from sievelog.operators import dedup, enrich, search
from sievelog.sources import cri
from sievelog.sources.store import LogStore, as_json, histogram_json, ndjson

from .records import frame

NOON = 1780142400  # 2026-05-30T12:00:00Z
S = 1_000_000_000


def two_segments(n=50):
    return [{"_ts_nanos": (NOON + i) * S, "_namespace": "staging" if i % 2 == 0 else "prod", "_message": json.dumps({"level": "error" if i % 5 == 0 else "info", "i": i}), "offset": i + 1, "source_key": str(i // n)} for i in range(2 * n)]


@pytest.fixture(scope="module")
def segments(spark):
    return frame(spark, two_segments()).persist()


def times(df):
    return [r["_ts_nanos"] for r in df.collect()]


def test_search_orders_filters_and_limits(segments):
    assert times(search.search(segments)) == sorted(times(segments))
    assert times(search.search(segments, descending=True)) == sorted(times(segments), reverse=True)
    assert search.search(segments, '_namespace="prod"').count() == 50
    assert search.search(segments, 'level="error"').count() == 20
    assert search.search(segments, limit=7).count() == 7
    assert search.search(segments, limit=0).count() == search.search(segments, limit=-1).count() == 100


def test_open_rows_are_united(spark, segments):
    open_row = frame(spark, [{"_ts_nanos": (NOON + 3600) * S, "_message": "{}"}])
    assert search.search(search.with_open(segments, open_row), '_namespace="prod"').count() == 51


def test_time_range_is_inclusive(segments):
    assert search.matching(segments, "", NOON + 10, NOON + 20).count() == 11
    assert search.matching(segments, "", "2026-05-30T12:00:10Z", "").count() == 90


def test_histogram_of_thirty_minutes(spark):
    rows = frame(spark, [{"_ts_nanos": (NOON + 60 * i) * S, "_message": json.dumps({"level": "error" if i % 3 == 0 else "info"}), "offset": i + 1} for i in range(30)])
    h = search.histogram(rows, 'level="error"', "2026-05-30T11:00:00Z", "2026-05-30T14:00:00Z", 10)
    got = h.orderBy("bucket").collect()
    assert len(got) == 10 and sum(r["count"] for r in got) == 10
    out = json.loads(histogram_json(h, "a", "b", 18 * 60 * S))
    assert out["total"] == 10 and out["intervalMs"] == 18 * 60_000 and len(out["counts"]) == 10
    one = search.fields(rows).first()
    assert "level" in one["fields"] and "_ts" in one["fields"] and one["namespaces"] == ["prod"] and one["labels"] == ["app", "app.kubernetes.io/name"]


def test_histogram_edges(spark):
    rows = frame(spark, [{"_ts_nanos": NOON * S + i} for i in range(11)])
    counts = [r["count"] for r in search.histogram(rows, "", format_time(NOON * S), format_time(NOON * S + 10), 3).orderBy("bucket").collect()]
    assert counts == [3, 3, 5]  # the remainder and the end fall into the last bucket
    assert search.histogram(rows, "", NOON, NOON, 2).agg(F.sum("count")).first()[0] == 1
    with pytest.raises(ValueError):
        search.histogram(rows, "", "yesterday")


def test_top_k_is_planned(segments):
    assert "TakeOrderedAndProject" in search.search(segments, limit=5)._jdf.queryExecution().executedPlan().toString()


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters") :].splitlines()[0]


def test_store_prunes_and_pushes_down(spark, tmp_path, segments):
    store = LogStore(spark, str(tmp_path))
    later = segments.withColumn("_ts_nanos", F.col("_ts_nanos") + 86_400 * S)
    store.write(segments.unionByName(later))
    assert store.records().count() == 200 and store.query('_namespace="prod"', limit=9).count() == 9
    plan = search.matching(store.records(), '_namespace = "prod" and not (_pod != "web-abc" or _container =~ /x/)', NOON + 86_400)
    assert "EqualTo(_namespace,prod)" in pushed(plan) and "EqualTo(_pod,web-abc)" in pushed(plan) and "GreaterThanOrEqual(_ts_nanos" in pushed(plan)
    assert "Or(IsNull(_node),Not(EqualTo(_node,n)))" in pushed(search.matching(store.records(), '_node != "n"'))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text and {str(r["date"]) for r in plan.select("date").distinct().collect()} == {"2026-05-31"}
    assert store.statistics().count() == 2 and store.watermarks().count() == 2
    assert store.histogram("", NOON, NOON + 2 * 86_400, 4).agg(F.sum("count")).first()[0] == 200
    assert store.fields().first()["namespaces"] == ["prod", "staging"]


def test_json_lines(spark):
    rows = frame(spark, [{"_ts_nanos": NOON * S + 120, "_namespace": None, "_message": '{"a":1}'}])
    line = json.loads(next(ndjson(rows)))
    assert line["_ts"] == "2026-05-30T12:00:00.00000012Z" and line["_namespace"] == "" and line["body"] == {"a": 1} and as_json(rows).count() == 1


@pytest.mark.parametrize("text, nanos", [("2026-05-30T12:00:00Z", NOON * S), ("2026-05-30T14:00:00.000000001+02:00", NOON * S + 1), (str(NOON), NOON * S), ("", None), (None, None), ("1969-12-31T23:59:59.5Z", -S // 2)])
def test_times(text, nanos):
    assert parse_time(text) == nanos


@pytest.mark.parametrize("text", ["x", "2026-05-30", "2026-13-30T12:00:00Z", "1.5"])
def test_bad_times(text):
    with pytest.raises(ValueError):
        parse_time(text)


def test_times_in_columns(spark):
    stamps = ["2026-05-30T12:00:00.123456789Z", "2026-05-30T12:00:00Z", "1969-12-31T23:59:59.25Z", "2026-05-30T12:00:00+01:00", "nonsense", "2026-02-30T12:00:00Z"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i long, s string").withColumn("n", nanos_of(F.col("s")))
    got = df.select("i", "n", stamp_of(F.col("n")).alias("t")).orderBy("i").collect()
    assert [r["n"] for r in got] == [NOON * S + 123456789, NOON * S, -750_000_000, (NOON - 3600) * S, None, None]
    assert [r["t"] for r in got][:3] == stamps[:3]


def write_log(root, pod_dir, container, text, name="0.log"):
    path = root / pod_dir / container
    path.mkdir(parents=True, exist_ok=True)
    with open(path / name, "ab") as f:
        f.write(text.encode())


LOG = "\n".join([
    "2026-05-30T12:00:00Z stdout F {\"a\":1}", "2026-05-30T12:00:01Z stdout P part é ", "2026-05-30T12:00:02Z stderr P two ", "2026-05-30T12:00:03Z stdout F end", "bad line", "nope stdout F x",
    "2026-05-30T12:00:04Z stdout F", "2026-05-30T12:00:05Z other X kept", "2026-05-30T12:00:06Z stdout P ", "2026-05-30T12:00:07Z stderr P late ", "2026-05-30T12:00:08Z stdout F z", "2026-05-30T12:00:09Z stdout P never ended", "",
])


def test_container_files(spark, tmp_path):
    root = tmp_path / "pods"
    write_log(root, "prod_web_1_2", "app", LOG + "2026-05-30T12:00:10Z stdout F unfinished")
    write_log(root, "odd", "app", LOG)
    rows = cri.records(cri.read_files(spark, str(root)), node="n1").orderBy("offset").collect()
    assert [r["_message"] for r in rows] == ['{"a":1}', "part é two end", "", "kept", "late z"]
    assert [(r["_ts_nanos"] // S - NOON, r["_stream"]) for r in rows] == [(0, "stdout"), (1, "stdout"), (4, "stdout"), (5, "other"), (7, "stderr")]
    data = LOG.encode()
    assert rows[1]["offset"] == data.index(b"bad line") and rows[0]["offset"] == data.index(b"\n") + 1
    assert (rows[0]["_namespace"], rows[0]["_pod"], rows[0]["uid"], rows[0]["_container"], rows[0]["_node"]) == ("prod", "web", "1_2", "app", "n1")
    apart = cri.records(cri.read_files(spark, str(root)), by_stream=True).orderBy("offset").collect()
    assert [r["_message"] for r in apart] == ['{"a":1}', "part é end", "", "kept", "z"]


@pytest.mark.parametrize("message, body", [('{"a":1}', {"a": 1}), ("{}", {}), ("[1]", {"stdout": "[1]"}), ('{"a":1} x', {"stdout": '{"a":1} x'}), (' {"a":2}\t', {"a": 2}), ("5", {"stdout": "5"}), ("", {"stdout": ""}), ("{'a':1}", {"stdout": "{'a':1}"}), ('{"a":01}', {"stdout": '{"a":01}'}), ('{"a":1},{"b":2}', {"stdout": '{"a":1},{"b":2}'})])
def test_bodies(spark, message, body):
    df = spark.createDataFrame([(message,)], "m string")
    assert json.loads(df.select(F.to_json(cri.body_of(F.col("m"), F.lit("other"))).alias("b")).first()["b"]) == body


PODS = [("u1", {"app": "x"}, {"collect": "false"}, "n9", {"app": "img"}), ("u2", {}, {"collect": "true"}, "", {}), ("u3", {}, {}, None, None)]


def test_enrichment_and_opt_out(spark):
    pods = spark.createDataFrame(PODS, "uid string, labels map<string,string>, annotations map<string,string>, node string, images map<string,string>")
    rows = frame(spark, [{"_node": "old"} for _ in range(4)]).withColumn("uid", F.concat(F.lit("u"), (F.col("id") + 1).cast("string")))
    got = enrich.enrich(rows, pods).orderBy("id").collect()
    assert [r["_node"] for r in got] == ["n9", "old", "old", "old"] and [r["_image"] for r in got] == ["img", None, None, None]
    assert got[0]["_labels"] == {"app": "x"} and got[1]["_labels"]["app"] == "web"
    assert [r["uid"] for r in enrich.without_opted_out(rows, pods, "collect").orderBy("id").collect()] == ["u2", "u3", "u4"]
    assert enrich.without_opted_out(rows, pods, "").count() == 4
    assert enrich.without_namespaces(rows, ["prod"]).count() == 0 and enrich.without_namespaces(rows, []).count() == 4
    spec = spark.createDataFrame([("u", "a", "1"), ("u", "b", "2")], "uid string, container string, image string")
    assert enrich.images(spec, spark.createDataFrame([("u", "a", "9")], spec.schema)).first()["images"] == {"a": "9", "b": "2"}


def test_dedup_by_watermark(spark):
    feed = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 2, 3), ("s", 1, 4), ("s", 3, 5), ("t", 1, 6)], "source_key string, offset long, arrival long")
    kept = dedup.by_watermark(feed, ["arrival"]).orderBy("arrival").collect()
    assert [r["arrival"] for r in kept] == [1, 2, 5, 6]
    marks = spark.createDataFrame([("s", 2)], "source_key string, offset long")
    assert [r["arrival"] for r in dedup.by_watermark(feed, ["arrival"], marks=marks).orderBy("arrival").collect()] == [5, 6]


def test_tail_reads_appended_bytes_once(spark, tmp_path):
    from sievelog.sources.tail import tail

    root, out, check = tmp_path / "pods", str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        for _ in range(2):  # a restart replays a planned batch first
            tail(spark, str(root), exclude="kube", maxBytesPerFile=200).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["offset"], r["line"]) for r in spark.read.parquet(out).collect())

    write_log(root, "prod_web_1", "app", "".join(f"line {i}\n" for i in range(5)) + "half")
    write_log(root, "kube_x_1", "app", "skipped\n")
    assert [x for _, x in drain()] == [f"line {i}" for i in range(5)]
    write_log(root, "prod_web_1", "app", " done\nline 6\nline 7\n")
    got = drain()
    assert [x for _, x in got] == [f"line {i}" for i in range(5)] + ["half done", "line 6", "line 7"] and got[0][0] == 7


def test_stream_dedup_survives_restart(spark, tmp_path):
    from sievelog.streaming.follow import accepted

    schema = "source_key string, offset long, message string"
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        accepted(stream, marks={"s": 2}).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["message"] for r in spark.read.parquet(out).collect())

    assert push([("s", i, f"m{i}") for i in range(10)]) == [f"m{i}" for i in range(3, 10)]
    again = push([("s", i, f"m{i}") for i in range(5, 15)])  # the restarted agent sends from its last checkpoint
    assert again == sorted(f"m{i}" for i in range(3, 15))


def test_follow_replays_then_continues(spark, tmp_path):
    from sievelog.streaming.follow import sink

    store = LogStore(spark, str(tmp_path / "store"))
    store.write(frame(spark, two_segments(5)))
    live = store.follow('_namespace="prod"', NOON + 1).drop("body")
    run = lambda: sink(live.drop("date"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    store.write(frame(spark, [{"_ts_nanos": (NOON + 99) * S, "_message": "{}"}]))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
