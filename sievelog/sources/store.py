"""Records in Parquet, committed batch by batch.

    <store>/records/batch=<name>/date=<day>/   the rows, sorted by time, with bloom filters on the names that searches compare
    <store>/catalog/batch=<name>/              one row a day of the batch: times, counts, distinct names and keys, source marks

A batch is seen once its catalog file is there, so writers of any kind (a call of
write(), each micro-batch of a stream) share one store, and a batch that is written again
under its name replaces itself. Searches ask the catalog first: batches and days whose
times or names cannot match are not even listed. compact() joins the small batches of
streams; what it replaces is told by its own catalog rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import parse_time, stamp_of
from ..functions.values import configure
from ..operators import search as ops
from ..plans.language import parse, required_equalities
from ..schema import RECORD, normalized, source_key

_BLOOMS = ("_namespace", "_pod", "_container", "_node")
#: Envelope names whose distinct values the catalog keeps.
SUMMARIES = {"_namespace": "namespaces", "_pod": "pods", "_node": "nodes", "_container": "containers"}
STORED = T.StructType([*RECORD.fields, T.StructField("source_key", T.StringType()), T.StructField("date", T.DateType())])


def day_of(nanos: Column) -> Column:
    return F.date_from_unix_date(F.floor(nanos.cast("decimal(20,0)") / 86_400_000_000_000).cast("int"))


class LogStore:
    def __init__(self, spark: SparkSession, path: str):
        configure(spark)
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, records: DataFrame, files: int | None = None, batch: str | None = None, replaces: tuple[str, ...] = ()) -> str | None:
        """Adds records as one batch and returns its name; None where there are none. Files hold disjoint ranges of time, so a search skips files and row groups by their bounds.

        files: how many ranges; by default as many as there are shuffle
        partitions, small ones being joined while the query runs. A busy day
        has many of them, and no day is one task. batch: a name; the batch of that name is replaced.
        """
        name = batch or f"w{uuid.uuid4().hex}"
        rows = normalized(records)
        rows = rows.withColumn("date", day_of(F.col("_ts_nanos")))
        if "source_key" not in rows.columns:
            rows = rows.withColumn("source_key", source_key(F.col("source")))
        order = ("date", "_ts_nanos", "source_key", "offset")
        rows = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        writer = rows.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("date").option("compression", "zstd")
        for column in _BLOOMS:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        folder = f"{self.path}/records/batch={name}"
        writer.parquet(folder)
        stored = self.spark.read.schema(T.StructType([*[f for f in rows.schema.fields if f.name != "date"], T.StructField("date", T.DateType())])).parquet(folder)
        marks = stored.groupBy("date", "source_key").agg(F.max("offset").alias("offset")).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct(F.col("source_key").cast("string"), "offset"))).alias("marks"))
        days = ops.statistics(stored, "date").join(marks, "date").withColumn("replaces", F.array(*[F.lit(x) for x in replaces]).cast("array<string>"))
        days.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalog/batch={name}")  # a row a day
        return name

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def catalog(self) -> DataFrame | None:
        """What is committed and not replaced: a row for each batch and day. None for an empty store."""
        if not self._there(f"{self.path}/catalog"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/catalog").withColumn("batch", F.col("batch").cast("string"))
        gone = rows.select("date", F.explode("replaces").alias("batch"))
        return rows.join(gone, ["date", "batch"], "left_anti")

    def _read(self, days: DataFrame | None) -> DataFrame:
        """The rows of catalog rows."""
        found = [] if days is None else days.select("batch", F.date_format("date", "yyyy-MM-dd").alias("date")).collect()  # a row a batch and day
        if not found:
            return self.spark.createDataFrame([], STORED)
        base = f"{self.path}/records"
        return self.spark.read.option("basePath", base).option("mergeSchema", "false").parquet(*[f"{base}/batch={r['batch']}/date={r['date']}" for r in found]).drop("batch")

    def candidates(self, query: str = "", start=None, end=None) -> DataFrame | None:
        """The catalog rows that may hold a match: their times overlap the range, and each text that all matches need is among their names."""
        days = self.catalog()
        if days is None:
            return None
        start, end = parse_time(start), parse_time(end)
        if start is not None:
            days = days.where(F.col("max_ts_nanos") >= start)
        if end is not None:
            days = days.where(F.col("min_ts_nanos") <= end)
        for name, text in required_equalities(parse(query)):
            if name in SUMMARIES and text:
                days = days.where(F.array_contains(SUMMARIES[name], text))
        return days

    def records(self) -> DataFrame:
        return self._read(self.catalog())

    def query(self, query: str = "", start=None, end=None, limit: int = 0, descending: bool = False) -> DataFrame:
        return ops.search(self._read(self.candidates(query, start, end)), query, start, end, limit, descending)

    def histogram(self, query: str = "", start=None, end=None, buckets: int = ops.DEFAULT_BUCKETS) -> DataFrame:
        return ops.histogram(self._read(self.candidates(query, start, end)), query, start, end, buckets)

    def fields(self) -> DataFrame:
        """Discovery from the catalog alone: no record is read."""
        days = self.catalog()
        if days is None:
            return ops.fields(self.spark.createDataFrame([], STORED))
        return ops.fields_of(days)

    def watermarks(self) -> DataFrame:
        """The highest offset of each source, from the catalog."""
        days = self.catalog()
        if days is None:
            return self.spark.createDataFrame([], "source_key string, offset long")
        return days.select(F.explode("marks").alias("source_key", "offset")).groupBy("source_key").agg(F.max("offset").alias("offset"))

    def statistics(self) -> DataFrame:
        """One row a day over all batches."""
        days = self.catalog()
        return ops.statistics(self.records(), "date") if days is None else ops.merged_statistics(days, "date")

    def compact(self, date: str, files: int | None = None) -> str | None:
        """Joins a day's batches to one; the old ones are no longer read, and vacuum() removes them."""
        days = self.catalog()
        days = days.where(F.col("date") == F.lit(date).cast("date")) if days is not None else None
        names = sorted(r["batch"] for r in days.select("batch").collect()) if days is not None else []
        return self.write(self._read(days).drop("date"), files, replaces=tuple(names)) if len(names) > 1 else None

    def vacuum(self) -> None:
        """Removes the folders of replaced days, when no search reads them any more."""
        if (days := self.catalog()) is None:
            return
        every = self.spark.read.parquet(f"{self.path}/catalog").select(F.explode("replaces").alias("batch"), F.date_format("date", "yyyy-MM-dd").alias("date")).collect()
        live = {(r["batch"], r["date"]) for r in days.select("batch", F.date_format("date", "yyyy-MM-dd").alias("date")).collect()}
        for r in every:
            if (r["batch"], r["date"]) not in live:
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/records/batch={r['batch']}/date={r['date']}")
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def recover(self) -> None:
        """Writes the catalog rows of batches that have none: what a writer that died before its commit left whole."""
        if not self._there(f"{self.path}/records"):
            return
        self.refresh()
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/records")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for entry in fs.listStatus(at):
            name = entry.getPath().getName().removeprefix("batch=")
            if not self._there(f"{self.path}/catalog/batch={name}") and self._there(f"{self.path}/records/batch={name}/_SUCCESS"):
                self.write(self.spark.read.parquet(f"{self.path}/records/batch={name}").drop("date"), batch=f"r{uuid.uuid4().hex}")

    def refresh(self) -> None:
        """Sees what others wrote."""
        for part in ("records", "catalog"):
            self.spark.catalog.refreshByPath(f"{self.path}/{part}")

    def follow(self, query: str = "", start=None) -> DataFrame:
        """A streaming frame of what is stored and will be, once each."""
        from ..streaming.follow import follow

        return follow(self.spark, f"{self.path}/records", query, start).drop("batch")


def as_json(records: DataFrame) -> DataFrame:
    """One JSON object a record, by the wire names; absent envelope texts are empty."""
    texts = [c for c in ("_namespace", "_pod", "_container", "_node", "_stream", "_message") if c in records.columns]
    cols: list[Column] = [stamp_of(F.col("_ts_nanos")).alias("_ts")]
    cols += [F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts]
    cols += [F.col(c) for c in ("source", "offset", "_image", "_labels", "_annotations", "body") if c in records.columns]
    return records.select(F.to_json(F.struct(*cols)).alias("line"))


def ndjson(records: DataFrame) -> Iterator[str]:
    """as_json() line by line, partition after partition."""
    for row in as_json(records).toLocalIterator(prefetchPartitions=True):
        yield row["line"]


def histogram_json(df: DataFrame, start: str, end: str, width_nanos: int) -> str:
    """The answer of a histogram as one JSON object."""
    counts = [r["count"] for r in df.orderBy("bucket").collect()]
    return json.dumps({"start": start, "end": end, "intervalMs": width_nanos // 1_000_000, "counts": counts, "total": sum(counts)})
