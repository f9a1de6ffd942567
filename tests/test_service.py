import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request

import pytest
from pyspark.errors import AnalysisException

from sievelog.server import serve
from sievelog.sources.store import LogStore
from sievelog.streaming.ingest import ingest, wait_for_metadata

from .records import frame
from .test_engine import LOG, NOON, S, write_log


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("api")
    store = LogStore(spark, str(path / "store"))
    store.write(frame(spark, [{"_ts_nanos": (NOON + 60 * i) * S, "_message": json.dumps({"level": "error" if i % 3 == 0 else "info"}), "offset": i + 1} for i in range(30)]))
    server = serve(store, str(path / "follow"))
    yield lambda route, **ask: urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{route}?{urllib.parse.urlencode(ask)}", timeout=60)
    server.shutdown()


def test_query_over_http(api):
    lines = [json.loads(x) for x in api("/v1/query", expr='level="error"', limit=4, direction="desc").read().splitlines()]
    assert [x["offset"] for x in lines] == [28, 25, 22, 19] and lines[0]["body"]["level"] == "error" and lines[0]["_ts"] == "2026-05-30T12:27:00Z"
    assert len(api("/v1/query", expr='level="error"', limit="x").read().splitlines()) == 10


def test_histogram_and_fields_over_http(api):
    h = json.loads(api("/v1/histogram", expr='level="error"', start="2026-05-30T11:00:00Z", end="2026-05-30T14:00:00Z", buckets=10).read())
    assert h["total"] == 10 and len(h["counts"]) == 10 and h["intervalMs"] == 1_080_000
    f = json.loads(api("/v1/fields").read())
    assert "level" in f["fields"] and f["namespaces"] == ["prod"] and api("/healthz").read() == b"ok"


@pytest.mark.parametrize("ask", [{"expr": "level ="}, {"start": "yesterday"}])
def test_bad_requests(api, ask):
    with pytest.raises(urllib.error.HTTPError) as e:
        api("/v1/query", **ask)
    assert e.value.code == 400


def test_follow_over_http(api):
    with api("/v1/query", expr='level="error"', follow="true") as live:
        assert [json.loads(live.readline())["offset"] for _ in range(10)] == list(range(1, 31, 3))


def test_ingest_survives_a_restart(spark, tmp_path):
    root, store, check = tmp_path / "pods", str(tmp_path / "store"), str(tmp_path / "check")

    def drain():
        for _ in range(2):
            ingest(spark, str(root), store, check, node="n1").awaitTermination()
        return [r for r in LogStore(spark, store).query().collect()]

    text = LOG.splitlines(keepends=True)
    write_log(root, "prod_web_u1", "app", "".join(text[:2]))  # ends inside a partial line
    assert [r["_message"] for r in drain()] == ['{"a":1}']
    write_log(root, "prod_web_u1", "app", "".join(text[2:]))
    rows = drain()
    assert [r["_message"] for r in rows] == ['{"a":1}', "part é two end", "", "kept", "late z"]
    assert rows[1]["_stream"] == "stdout" and rows[1]["_node"] == "n1" and rows[1]["offset"] == "".join(text[:4]).encode().__len__()
    os.rename(root / "prod_web_u1/app/0.log", root / "prod_web_u1/app/0.log.old")
    write_log(root, "prod_web_u1", "app", "2026-05-30T13:00:00Z stdout F rotated\n")
    assert [r["_message"] for r in drain()][-1] == "rotated" and len(drain()) == 6


def test_records_wait_for_their_pod(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for name in ("record", "pod"):
        (tmp_path / name).mkdir()
    records, pods = (spark.readStream.schema(f"uid string, {c} string").parquet(str(tmp_path / c)) for c in ("record", "pod"))

    def push(until, record=(), pod=(), wait=3_600_000):
        for name, rows in (("record", record), ("pod", pod)):
            spark.createDataFrame(list(rows), f"uid string, {name} string").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        # with timers a stream never runs out of batches, so it is stopped when the rows are there
        run = wait_for_metadata(records, pods, wait).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="1 second").start()
        for _ in range(60):
            time.sleep(1)
            try:
                got = sorted((r["record"], r["pod"] or "") for r in spark.read.schema("record string, pod string").parquet(out).collect())
            except AnalysisException:
                got = []
            if until in got:
                break
        run.stop()
        return got

    assert push(("r2", "B"), record=[("a", "r1"), ("b", "r2")], pod=[("b", "B")]) == [("r2", "B")]
    assert push(("r3", "B"), record=[("b", "r3")], pod=[("a", "A")]) == [("r1", "A"), ("r2", "B"), ("r3", "B")]
    assert ("r4", "") in push(("r4", ""), record=[("c", "r4")], wait=1)
