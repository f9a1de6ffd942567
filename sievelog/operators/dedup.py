"""At-least-once input to records that occur once: a record counts if its offset exceeds every earlier one of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_watermark(records: DataFrame, arrival: list[str], key: str = "source_key", marks: DataFrame | None = None) -> DataFrame:
    """records whose offset is above all that arrived before in their source, and above the source's stored mark.

    A window per source, in order of arrival; one source is one file and was
    written by one machine, so a group is bounded by what one file can hold.
    """
    before = F.max("offset").over(Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    if marks is not None:
        records = above(records, marks, key)
    return records.withColumn("before_", before).where("before_ is null or offset > before_").drop("before_")


def above(records: DataFrame, marks: DataFrame, key: str = "source_key") -> DataFrame:
    """records beyond the mark of their source: what a live feed adds to a replayed history."""
    m = marks.select(F.col(key), F.col("offset").alias("mark_"))
    return records.join(m, key, "left").where("mark_ is null or offset > mark_").drop("mark_").select(*records.columns)
