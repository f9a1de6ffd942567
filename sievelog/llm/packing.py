"""Best-fit packing planned on a histogram of lengths.

Best-fit decreasing runs on the driver over how many pieces there are of each
length, not over pieces: bins that hold the same lengths are one group with a
count. Each length opens at most four groups, so there are at most 4 * `context` of
them, of at most `context` entries each, whatever the corpus holds. Pieces take planned slots by their rank within
their length; ranks are counted inside (length, bucket) and shifted by the
totals of the buckets before, so the commonest length is no single task.

Defined cases: a null text is empty and packs its end id alone; repeated rows
are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_text_batches, stage
from .tokens import encoder

CONTEXT = 2048
#: Pieces of one length in one bucket of the ranking.
BUCKET = 10_000

def pieces(docs: DataFrame, vocabulary: str, *, context: int = CONTEXT, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32 (and ids as little-endian uint32). The first piece of a cut document takes the remainder."""
    small_text_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(vocabulary, spaces_join=True)
        for pdf in batches:
            rows = []
            for k, ids in zip(pdf["key"], enc.encode_all([t or "" for t in pdf["text"]])):
                ids += end
                n, at, i = len(ids) // 4, 0, 0
                while at < n:
                    length = min(context, n) if at or n <= context else (n % context or context)
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((k, i, at, length, zlib.crc32(part), *([part] if with_ids else [])))
                    at, i = at + length, i + 1
            out = pd.DataFrame(rows, columns=names)
            out["key"] = out["key"].astype("Int64") if long_key else out["key"]
            yield out

    long_key = docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    names = ["key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kind = "long" if long_key else docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], context: int = CONTEXT) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, last rank + 1, first bin, offset) for every slot of every group of like bins."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by what is left: (lengths held, bins)
    rooms: list[int] = []

    def put(left: int, held: tuple[int, ...], n: int) -> None:
        if not room[left]:
            insort(rooms, left)
        room[left].append((held, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                held, bins = room[left].pop()
                if not room[left]:
                    rooms.pop(at)
                used = min(n, bins)
                if bins > used:
                    put(left, held, bins - used)
                put(left - length, (*held, length), used)
                n -= used
            else:
                each = context // length
                if n >= each:
                    put(context - each * length, (length,) * each, n // each)
                    n %= each
                else:
                    put(context - n * length, (length,) * n, 1)
                    n = 0
    slots, rank, first = [], defaultdict(int), 0
    for left in sorted(room):
        for held, bins in room[left]:
            offset = 0
            for length in held:
                slots.append((length, rank[length], rank[length] + bins, first, offset))
                rank[length] += bins
                offset += length
            first += bins
    slots.sort()
    return slots


def pack(pieces_: DataFrame, context: int = CONTEXT, bucket: int = BUCKET) -> DataFrame:
    """pieces_ with sequence_id and offset."""
    rows = stage(pieces_, "packing-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `context` rows
    slots = plan(counts, context)
    # as many buckets as a length needs, so there are few groups in all and none is large
    n_buckets = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // bucket))) for n in range(context + 1)])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.get(n_buckets, F.col("length").cast("int"))))
    totals = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    shift = totals.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("shift"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece", "ids_crc32"))
    ranked = rows.withColumn("rank", within).join(shift, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("shift"))
    table = np.asarray(slots, dtype=np.int64).reshape(-1, 5)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = sent.value
        keys = t[:, 0] * (1 << 44) + t[:, 1]  # slots are in order of length and rank
        at = np.searchsorted(keys, length.to_numpy(np.int64) * (1 << 44) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 3] + rank.to_numpy(np.int64) - t[at, 1], "offset": t[at, 4]})

    return ranked.withColumn("slot", slot("length", "rank")).select(*pieces_.columns, "slot.sequence_id", "slot.offset")


def pack_documents(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """Per piece of docs: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, vocabulary, **how), how.get("context", CONTEXT))
