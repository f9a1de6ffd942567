"""The record: a fixed envelope, two maps and an open JSON body."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([
    T.StructField("node", T.StringType()), T.StructField("path", T.StringType()), T.StructField("dev", T.DecimalType(20, 0)),
    T.StructField("ino", T.DecimalType(20, 0)), T.StructField("ctime", T.LongType()),
])

RECORD = T.StructType([
    T.StructField("source", SOURCE), T.StructField("offset", T.LongType()), T.StructField("_ts", T.TimestampType()), T.StructField("_ts_nanos", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("_namespace", "_pod", "_container", "_node", "_image", "_stream")],
    T.StructField("_labels", T.MapType(T.StringType(), T.StringType())), T.StructField("_annotations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_message", T.StringType()), T.StructField("body", T.VariantType()),
])

POD = T.StructType([
    T.StructField("uid", T.StringType()), T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("annotations", T.MapType(T.StringType(), T.StringType())), T.StructField("node", T.StringType()), T.StructField("images", T.MapType(T.StringType(), T.StringType())),
])

#: Envelope names that hold text; an empty one counts as absent, but for the message.
TEXT_FIELDS = ("_namespace", "_pod", "_container", "_node", "_image", "_stream", "_message")
ENVELOPE = ("_namespace", "_pod", "_container", "_node", "_stream", "_image", "_message", "_ts")


def source_key(source: Column) -> Column:
    """One string for a generation of a file."""
    return F.concat_ws("\u0000", *[source[f.name].cast("string") for f in SOURCE.fields])


def normalized(records: DataFrame) -> DataFrame:
    """Empty envelope texts as NULL, once, so that predicates on bare columns reach the scan."""
    return records.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in TEXT_FIELDS[:-1] if c in records.columns})


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/sievelog"
    return base.rstrip("/")
