"""From growing container files, or record batches on a wire, to stored records, as one stream.

    tail -> parse -> fold partial lines (state) -> wait for metadata (state) -> pod identity, body -> enrich -> store

Each micro-batch is one batch of the store, named by the stream and its number, so a batch
that is repeated after a crash replaces itself; offsets and state are committed after it.
What the store already holds of a source (its marks, but for those of this stream's own
batches) is dropped, so a lost checkpoint stores nothing twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import nanos_of, timestamp_of
from ..functions.values import configure
from ..operators import enrich as pods_ops
from ..operators.dedup import above
from ..schema import POD, RECORD, source_key
from ..sources import cri
from ..sources.store import LogStore
from ..sources.tail import tail

#: Records on the wire: times are texts.
WIRE = T.ArrayType(T.StructType([f if f.name != "_ts" else T.StructField("_ts", T.StringType()) for f in RECORD.fields if f.name != "_ts_nanos"]))
_FOLDED = "path string, dev long, ino long, offset long, _ts_nanos long, _stream string, _message string"


_LINES = ["path", "dev", "ino", "offset", "_ts_nanos", "_stream", "_message"]


def _folded(rows: pd.DataFrame, open_: tuple[str, int, str]) -> tuple[list[tuple], tuple[str, int, str]]:
    """The whole lines of one file generation, and the partial line (text, time, stream) that stays open."""
    text, at, stream = open_
    out = []
    for r in rows.sort_values("offset", kind="stable").itertuples(index=False):
        if r.partial:
            if not text:
                at, stream = int(r.nanos), r.stream_
            text += r.message
            continue
        out.append((r.path, int(r.dev), int(r.ino), int(r.offset), at if text else int(r.nanos), stream if text else r.stream_, text + r.message))
        text = ""
    return out, (text, at, stream)


def _parts(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "dev", "ino", "offset", F.col("_ts_nanos").alias("nanos"), F.col("_stream").alias("stream_"), "partial", F.col("_message").alias("message"))


def fold_stream(parsed: DataFrame, by_stream: bool = False) -> DataFrame:
    """cri.fold() on a stream: the open partial line of a file generation is its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, left = _folded(pd.concat(list(batches), ignore_index=True), state.get if state.exists else ("", 0, ""))
        state.update(left)
        yield pd.DataFrame(out, columns=_LINES)

    keys = ["path", "dev", "ino", *(["stream_"] if by_stream else [])]
    return _parts(parsed).groupBy(*keys).applyInPandasWithState(step, _FOLDED, "text string, at long, stream string", "append", GroupStateTimeout.NoTimeout)


def fold_and_wait(parsed: DataFrame, pods: DataFrame, by_stream: bool = False, wait_ms: int = 30_000) -> DataFrame:
    """Folded lines with their uid and pod (JSON, or NULL), held until a row of the pod has arrived or wait_ms have passed.

    fold_stream() and wait_for_metadata() in one state by uid, as a file belongs to one
    pod and Spark chains no two states of this kind. pods: a stream of (uid, pod).
    """
    lines = _parts(parsed).withColumn("uid", cri.pod_of(F.col("path"))["uid"]).where("uid is not null").withColumn("pod", F.lit(None).cast("string"))
    none = {f.name: F.lit(None).cast(f.dataType) for f in lines.schema.fields if f.name not in ("uid", "pod")}
    both = lines.unionByName(pods.select("uid", "pod").withColumns(none))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pod, passed, partial, held = state.get if state.exists else (None, False, "[]", "[]")
        waiting = [tuple(x) for x in json.loads(held)]
        open_ = {tuple(k): tuple(v) for k, v in json.loads(partial)}
        if state.hasTimedOut:
            passed = True
        else:
            new = pd.concat(list(batches), ignore_index=True)
            known = new["pod"].dropna()
            pod = known.iloc[-1] if len(known) else pod
            for k, rows in new[new["path"].notna()].groupby(["path", "dev", "ino", *(["stream_"] if by_stream else [])]):
                k = tuple(x if isinstance(x, str) else int(x) for x in k)
                out, open_[k] = _folded(rows, open_.get(k, ("", 0, "")))
                waiting += out
        if pod is not None or passed:
            yield pd.DataFrame([(key[0], pod, *x) for x in waiting], columns=["uid", "pod", *_LINES])
            waiting = []
        state.update((pod, passed, json.dumps([[k, v] for k, v in open_.items() if v[0]]), json.dumps(waiting)))
        if waiting:
            state.setTimeoutDuration(wait_ms)

    return both.groupBy("uid").applyInPandasWithState(step, f"uid string, pod string, {_FOLDED}", "pod string, passed boolean, partial string, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_records(folded: DataFrame, node: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of folded lines: source, envelope and body; uid stays for enrichment, and the columns to keep."""
    rows = folded.withColumns(cri.pod_of(F.col("path"))).where("uid is not null")
    source = F.struct(F.lit(node).alias("node"), F.col("path"), F.col("dev").cast("decimal(20,0)").alias("dev"), F.col("ino").cast("decimal(20,0)").alias("ino"), F.lit(0).cast("long").alias("ctime"))
    empty = F.create_map().cast("map<string,string>")
    return rows.select(
        source.alias("source"), source_key(source).alias("source_key"), "offset", timestamp_of(F.col("_ts_nanos")).alias("_ts"), "_ts_nanos", "_namespace", "_pod", "_container", F.nullif(F.lit(node), F.lit("")).alias("_node"),
        F.lit(None).cast("string").alias("_image"), F.nullif("_stream", F.lit("")).alias("_stream"), empty.alias("_labels"), empty.alias("_annotations"), "_message", cri.body_of(F.col("_message"), F.col("_stream")).alias("body"), "uid", *keep,
    )


def wait_for_metadata(records: DataFrame, pods: DataFrame, wait_ms: int = 30_000) -> DataFrame:
    """(uid, record, pod): records as JSON, held until a row of their pod has arrived or wait_ms have passed; pod is the pod as JSON, or NULL.

    Both inputs are streams: records (uid, record) and pods (uid, pod). A pod
    that timed out lets its later records through at once.
    """
    both = records.select("uid", F.col("record"), F.lit(None).cast("string").alias("pod")).unionByName(pods.select("uid", F.lit(None).cast("string").alias("record"), F.col("pod")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pod, open_, held = state.get if state.exists else (None, False, "[]")
        waiting = json.loads(held)
        if state.hasTimedOut:
            open_ = True
        else:
            for pdf in batches:
                known = pdf["pod"].dropna()
                pod = known.iloc[-1] if len(known) else pod
                waiting += pdf["record"].dropna().tolist()
        if pod is not None or open_:
            yield pd.DataFrame({"uid": [key[0]] * len(waiting), "record": waiting, "pod": [pod] * len(waiting)})
            waiting = []
        state.update((pod, open_, json.dumps(waiting)))
        if waiting:
            state.setTimeoutDuration(wait_ms)

    return both.groupBy("uid").applyInPandasWithState(step, "uid string, record string, pod string", "pod string, open boolean, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _identity(spark: SparkSession, checkpoint: str) -> str:
    """A name kept beside a checkpoint, as long as that lives."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/stream-name")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        with_ = fs.open(at)
        name = jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        with_.close()
        return name
    name = f"s{uuid.uuid4().hex[:16]}"
    out = fs.create(at)
    out.write(bytearray(name.encode()))
    out.close()
    return name


def stored(records: DataFrame, store: LogStore, checkpoint: str, trigger: dict | None = None):
    """Starts a stream of records (source_key, offset, …) into the store, each record above its source's mark."""
    name = _identity(records.sparkSession, checkpoint)
    days = store.catalog()
    if days is not None:
        others = days.where(~F.col("batch").startswith(f"{name}-")).select(F.explode("marks").alias("source_key", "offset"))
        records = above(records, others.groupBy("source_key").agg(F.max("offset").alias("offset")))

    def commit(batch: DataFrame, number: int) -> None:
        store.write(batch, batch=f"{name}-{number:010d}")

    return records.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest(spark: SparkSession, root: str, store: str, checkpoint: str, *, node: str = "", pods: DataFrame | None = None, opt_out: str = "", exclude: tuple[str, ...] = (), by_stream: bool = False, wait_ms: int = 30_000, trigger: dict | None = None, **options):
    """Starts the stream from the files under root into the store.

    pods: a table of pods, joined if given; or a stream of them (uid, labels,
    annotations, node, images): then lines wait for their pod, wait_ms at most, and
    opting out is decided by what arrived.
    """
    configure(spark)
    parsed = cri.parse_lines(tail(spark, root, exclude=",".join(exclude), **options))
    if pods is not None and pods.isStreaming:
        come = pods.select("uid", F.to_json(F.struct(*[f.name for f in POD.fields])).alias("pod"))
        lines = fold_and_wait(parsed, come, by_stream, wait_ms).drop("uid").withColumn("pod", F.from_json("pod", POD))
        if opt_out:
            lines = lines.where(F.coalesce(F.col("pod.annotations")[F.lit(opt_out)] != "false", F.lit(True)))
        rows = pods_ops.enriched(to_records(lines, node, keep=("pod",)), F.col("pod")).drop("pod")
    else:
        rows = to_records(fold_stream(parsed, by_stream), node)
        if pods is not None:
            rows = pods_ops.enrich(pods_ops.without_opted_out(rows, pods, opt_out), pods)
    return stored(rows.drop("uid"), LogStore(spark, store), checkpoint, trigger)


def from_wire(values: DataFrame, value: str = "value") -> DataFrame:
    """Records of a frame or stream of JSON values (binary or text): one record or an array of records each, by the wire names. Malformed ones are left out.

    Any source with such a column will do: Kafka, a socket, files.
    """
    configure(values.sparkSession)
    text = F.col(value).cast("string")
    boxed = F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    each = values.select(F.explode(F.from_json(boxed, WIRE)).alias("r")).select("r.*")
    nanos = nanos_of(F.col("_ts"))
    rows = each.withColumn("_ts_nanos", nanos).where("_ts_nanos is not null and source is not null and `offset` is not null")
    return rows.withColumns({"_ts": timestamp_of(F.col("_ts_nanos")), "source_key": source_key(F.col("source")), "_message": F.coalesce("_message", F.lit(""))})
