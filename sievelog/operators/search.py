"""Searches, histograms and discovery over records."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_time
from ..plans.compiler import predicate
from ..schema import ENVELOPE

DEFAULT_BUCKETS = 60
DEFAULT_SPAN = 24 * 3600 * 1_000_000_000


def between(records: DataFrame, start=None, end=None) -> Column:
    """start <= time <= end on exact nanoseconds, and on the date partitions where there are any."""
    start, end = parse_time(start), parse_time(end)
    test = F.lit(True)
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        at = F.col("_ts_nanos")
        test &= at >= F.lit(bound) if low else at <= F.lit(bound)
        if "date" in records.columns:
            day = F.date_from_unix_date(F.lit(bound // 86_400_000_000_000))
            test &= F.col("date") >= day if low else F.col("date") <= day
    return test


def order_key(records: DataFrame, descending: bool = False) -> list[Column]:
    """Time, then source and offset, so that equal times have one order."""
    way = Column.desc if descending else Column.asc
    keys = [F.col("_ts_nanos")]
    if "source_key" in records.columns:
        keys.append(F.col("source_key"))
    elif "source" in records.columns:
        keys.append(F.col("source"))
    if "offset" in records.columns:
        keys.append(F.col("offset"))
    return [way(k) for k in keys]


def matching(records: DataFrame, query: str = "", start=None, end=None) -> DataFrame:
    """The records of a time range that a query matches, in no order."""
    return records.where(between(records, start, end)).where(predicate(query, records))


def search(records: DataFrame, query: str = "", start=None, end=None, limit: int = 0, descending: bool = False) -> DataFrame:
    """matching() in time order, the first `limit` if positive: Spark plans a top-k, not a sort."""
    found = matching(records, query, start, end).orderBy(*order_key(records, descending))
    return found.limit(limit) if limit > 0 else found


def with_open(sealed: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Stored records together with those not stored yet."""
    return sealed.unionByName(open_rows, allowMissingColumns=True)


def histogram(records: DataFrame, query: str = "", start=None, end=None, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(bucket, bucket_start, count) for every bucket, empty ones too.

    Buckets are `buckets` equal spans of whole nanoseconds; times at the end
    and in the remainder fall into the last one. Counts are summed before they
    are shuffled, one row for each bucket and task.
    """
    end = parse_time(end)
    end = time.time_ns() if end is None else end
    start = parse_time(start)
    start = end - DEFAULT_SPAN if start is None else start
    if buckets <= 0:
        buckets = DEFAULT_BUCKETS
    span = end - start if end > start else 1_000_000_000
    width = span // buckets or 1_000_000
    index = F.least(F.greatest(F.expr(f"(_ts_nanos - {start}L) div {width}L"), F.lit(0)), F.lit(buckets - 1)).cast("long")
    in_range = records.where((F.col("_ts_nanos") >= start) & (F.col("_ts_nanos") <= end))
    if "date" in records.columns:
        in_range = records.where(between(records, _exact(start), _exact(end)))
    counts = in_range.where(predicate(query, records)).groupBy(index.alias("bucket")).agg(F.count("*").alias("count"))
    axis = records.sparkSession.range(buckets).select(F.col("id").alias("bucket"), (F.lit(start) + F.col("id") * F.lit(width)).alias("bucket_start"))
    return axis.join(counts, "bucket", "left").select("bucket", "bucket_start", F.coalesce("count", F.lit(0)).alias("count"))


def _exact(nanos: int) -> str:
    from ..functions.times import format_time

    return format_time(nanos)


def field_values(records: DataFrame) -> DataFrame:
    """(field, value): every distinct non-empty value of namespace, pod, node and container."""
    names = [n for n in ("_namespace", "_pod", "_node", "_container") if n in records.columns]
    # first distinct tuples, then their parts: one pass, and few rows are exploded
    seen = records.select(*names).distinct()
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])
    return seen.select(F.explode(pairs).alias("p")).select("p.field", "p.value").where("value is not null and value <> ''").distinct()


def field_keys(records: DataFrame) -> DataFrame:
    """(field, value): label keys and top-level body keys. Sets of keys repeat, so they are made distinct before being exploded."""
    out = None
    for col, name, keys in (("_labels", "label", lambda c: F.map_keys(c)), ("body", "body", lambda c: F.json_object_keys(F.to_json(c)))):
        if col in records.columns:
            part = records.select(keys(F.col(col)).alias("keys")).distinct().select(F.lit(name).alias("field"), F.explode("keys").alias("value")).where("value <> ''").distinct()
            out = part if out is None else out.unionByName(part)
    return records.sparkSession.createDataFrame([], "field string, value string") if out is None else out


def fields(records: DataFrame) -> DataFrame:
    """One row of sorted arrays: namespaces, pods, nodes, containers, labels, fields (envelope names and body keys)."""
    both = field_values(records).unionByName(field_keys(records))
    sets = {"namespaces": "_namespace", "pods": "_pod", "nodes": "_node", "containers": "_container", "labels": "label"}
    aggs = [F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(n) for n, f in sets.items()]
    names = F.array(*[F.lit(n) for n in ENVELOPE])
    return both.agg(*aggs, F.array_sort(F.array_distinct(F.concat(names, F.collect_set(F.when(F.col("field") == "body", F.col("value")))))).alias("fields"))


#: The distinct values that statistics keep: name of the array, envelope column.
_NAMES = {"namespaces": "_namespace", "pods": "_pod", "nodes": "_node", "containers": "_container"}


def _body_keys(body: Column) -> Column:
    return F.map_keys(F.try_variant_get(body, "$", "map<string,variant>"))


def statistics(records: DataFrame, *keys: str) -> DataFrame:
    """Per group: first and last time, number of records, the distinct names, label keys and top-level body keys, and their bytes."""
    aggs = [F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(n) for n, c in _NAMES.items() if c in records.columns]
    for n, c, of in (("labels", "_labels", F.map_keys), ("fields", "body", _body_keys)):
        if c in records.columns:  # sets of keys repeat, so few of them are joined
            aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(of(F.col(c)))))).alias(n))
    return records.groupBy(*keys).agg(F.min("_ts_nanos").alias("min_ts_nanos"), F.max("_ts_nanos").alias("max_ts_nanos"), F.count("*").alias("records"), F.sum(record_bytes(records)).cast("long").alias("bytes"), *aggs)


def merged_statistics(days: DataFrame, *keys: str) -> DataFrame:
    """statistics() of groups from the statistics of their parts."""
    arrays = [n for n in (*_NAMES, "labels", "fields") if n in days.columns]
    return days.groupBy(*keys).agg(
        F.min("min_ts_nanos").alias("min_ts_nanos"), F.max("max_ts_nanos").alias("max_ts_nanos"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(n)))).alias(n) for n in arrays],
    )


def fields_of(days: DataFrame) -> DataFrame:
    """fields() from statistics."""
    whole = merged_statistics(days)
    names = F.array(*[F.lit(n) for n in ENVELOPE])
    return whole.select("namespaces", "pods", "nodes", "containers", "labels", F.array_sort(F.array_distinct(F.concat(names, "fields"))).alias("fields"))


def watermarks(records: DataFrame, key: str = "source_key") -> DataFrame:
    """The highest offset of each source."""
    return records.groupBy(key).agg(F.max("offset").alias("offset"))


def record_bytes(records: DataFrame) -> Column:
    """Bytes of a record by the estimate that seals a segment: message, names, labels and body, and 64."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("_message", "_namespace", "_pod", "_container", "_node") if c in records.columns]
    if "_labels" in records.columns:
        text.append(F.coalesce(F.aggregate(F.map_entries("_labels"), F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0))), F.lit(0)))
    if "body" in records.columns:
        text.append(F.coalesce(F.octet_length(F.to_json("body")), F.lit(0)))
    return sum(text, F.lit(64))


def size_of(records: DataFrame) -> DataFrame:
    """Total of record_bytes()."""
    return records.agg(F.coalesce(F.sum(record_bytes(records)), F.lit(0)).cast("long").alias("bytes"))
