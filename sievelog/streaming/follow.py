"""Live views of the store, and stateful deduplication of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import parse_time
from ..plans.compiler import predicate


def follow(spark: SparkSession, path: str, query: str = "", start=None) -> DataFrame:
    """Stored records first, then those that are added, each once: one file stream read from its beginning."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path)
    at = parse_time(start)
    if at is not None:
        rows = rows.where(F.col("_ts_nanos") >= at)
    return rows.where(predicate(query, rows))


def accepted(records: DataFrame, key: str = "source_key", marks: dict[str, int] | None = None) -> DataFrame:
    """records of a stream whose offset exceeds every earlier one of their source.

    State is one number a source. Inside a micro-batch a source's records are
    taken by offset, as a file is read in order. marks seeds sources that were
    stored before the stream had state.
    """
    schema = records.schema
    seed = dict(marks or {})

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else seed.get(str(keys[0]), -1)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("offset", kind="stable")
        rows = rows[rows["offset"] > high].drop_duplicates("offset")
        if len(rows):
            state.update((int(rows["offset"].iloc[-1]),))
            yield rows

    return records.groupBy(key).applyInPandasWithState(step, schema, T.StructType([T.StructField("high", T.LongType())]), "append", GroupStateTimeout.NoTimeout)


def sink(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Writes a stream to Parquet by day; a batch becomes visible whole, through the sink's log."""
    rows = records.withColumn("date", F.date_from_unix_date(F.floor(F.col("_ts_nanos") / F.lit(86_400_000_000_000).cast("decimal(20,0)")).cast("int")))
    return rows.writeStream.format("parquet").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
