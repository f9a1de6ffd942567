"""Pod metadata on records, and the rules that leave pods out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of pods up to which they are sent to every executor; beyond, Spark plans the join by size.
BROADCAST_PODS = 50_000


def _sized(pods: DataFrame, most: int) -> DataFrame:
    return F.broadcast(pods) if pods.limit(most + 1).count() <= most else pods


def enrich(records: DataFrame, pods: DataFrame, uid: str = "uid", broadcast_pods: int = BROADCAST_PODS) -> DataFrame:
    """records with the labels, annotations, node and image of their pod where it has them."""
    fields = F.struct("labels", "annotations", "node", "images").alias("pod_")
    return enriched(records.join(_sized(pods.select(F.col("uid").alias(uid), fields), broadcast_pods), uid, "left"), F.col("pod_")).drop("pod_")


def enriched(records: DataFrame, pod: Column) -> DataFrame:
    """records with what pod, a struct that may be NULL, says of them; where it says nothing, their own stays."""
    kept = [c for c in records.columns if c not in ("_labels", "_annotations", "_node", "_image")]
    old = lambda c, t: F.col(c) if c in records.columns else F.lit(None).cast(t)
    some = lambda m: F.when(F.size(m) > 0, m)
    return records.select(
        *kept,
        F.coalesce(F.nullif(pod["node"], F.lit("")), old("_node", "string")).alias("_node"),
        F.coalesce(F.nullif(pod["images"][F.col("_container")], F.lit("")), old("_image", "string")).alias("_image"),
        F.coalesce(some(pod["labels"]), old("_labels", "map<string,string>")).alias("_labels"),
        F.coalesce(some(pod["annotations"]), old("_annotations", "map<string,string>")).alias("_annotations"),
    )


def images(spec: DataFrame, status: DataFrame) -> DataFrame:
    """(uid, images) of (uid, container, image) rows; the image in use beats the one asked for."""
    both = spec.select("uid", "container", "image", F.lit(0).alias("rank")).unionByName(status.select("uid", "container", "image", F.lit(1).alias("rank")))
    best = both.groupBy("uid", "container").agg(F.max_by("image", "rank").alias("image"))
    return best.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("container", "image"))).alias("images"))


def without_namespaces(records: DataFrame, namespaces: list[str]) -> DataFrame:
    return records.where(F.col("_namespace").isNull() | ~F.col("_namespace").isin(namespaces)) if namespaces else records


def without_opted_out(records: DataFrame, pods: DataFrame, key: str, uid: str = "uid", broadcast_pods: int = BROADCAST_PODS) -> DataFrame:
    """records but those of pods whose annotation `key` is "false"; unknown pods stay, and an empty key drops nothing."""
    if not key:
        return records
    out = pods.where(F.col("annotations")[F.lit(key)] == "false").select(F.col("uid").alias(uid))
    return records.join(_sized(out, broadcast_pods), uid, "left_anti")
