"""Near duplicates by SimHash, compared bit-sliced.

A fingerprint bit is 1 if it is set in more than half of the XXH64 hashes of a
document's shingles. Equal fingerprints are one class from the start, so copies
are never paired. Different ones meet where they agree on some of the
fingerprint's parts: at `radius` differing bits, `blocks` parts of which
`blocks - radius` must agree, so every link is found (pigeonhole). Within such a
bucket they are compared bit-sliced: 64 fingerprints stand as 64 words, one for
each bit; distances to a query grow in carry-save counters, 64 at a time, and a
block is abandoned once all its distances exceed the radius. A bucket yields
the edges of a spanning forest, not its pairs. Large buckets are cut into tiles
that are compared two by two, in tasks of bounded size.

keep_one(similarity=...) links by the Jaccard similarity of shingle sets instead:
see similar.py, which compares longer fingerprints by the same planes and counters.

Hot keys: fingerprints and buckets that hold more than a small share of all rows are
few, by that share; they are broadcast or tiled by hash, and no task gets one whole.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; rows that repeat a key are members of their fingerprint's class;
a class of rows whose keys are all null has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import one_of, small_text_batches, stage

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Parts of a fingerprint: with two parts agreeing of six, 15 tables with keys of 21 bits.
BLOCKS = 6
#: Fingerprints in one tile of a bucket.
TILE = 4096
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text, by whole-word shingles of its ASCII-lower-cased words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both act on ASCII only, as asked for
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([hash_(b" ".join(words), seed)], "<u8")
        return int(hashes[0])
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate([[0], ends[: len(words) - shingle]]).tolist()
    stop = (ends[shingle - 1 :] - 1).tolist()
    n, counts = len(begin), np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bits of a bounded number of hashes at once
        part = np.fromiter((hash_(joined[a:b], seed) for a, b in zip(begin[at : at + 65_536], stop[at : at + 65_536])), "<u8")
        for lo in range(0, len(part), 255):  # counts of 255 fit in bytes
            counts += np.add.reduce(np.unpackbits(part[lo : lo + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, text_hash, fp): fp as a signed long."""
    small_text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in pdf["text"]], "<u8").view("<i8")
            keys = pdf["key"].astype("Int64") if kind == "bigint" else pdf["key"]
            yield pd.DataFrame({"key": keys, "text_hash": pdf["text_hash"], "fp": fps})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInPandas(run, f"key {kind}, text_hash long, fp long")


def _part_bounds(blocks: int) -> list[tuple[int, int]]:
    return [(64 * i // blocks, 64 * (i + 1) // blocks) for i in range(blocks)]


def bucket_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """One key for every choice of blocks - radius parts: the choice's number and the bits of the parts."""
    keys = []
    for number, chosen in enumerate(combinations(_part_bounds(blocks), blocks - radius)):
        mask = sum(((1 << hi) - (1 << lo)) for lo, hi in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, or n x words of 64 bits), 64 to a block: out[block, bit] holds that bit of each, one lane a fingerprint."""
    fps = fps.reshape(len(fps), -1)
    n, words = -(-len(fps) // 64), fps.shape[1]
    padded = np.zeros((64 * n, words), "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 64, 8 * words), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8").reshape(n, 64 * words)


def near(query: np.ndarray, stored: np.ndarray, of: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For items (query number, block number, lanes that count): those with a lane within the radius, and their lanes.

    Two planes a step go through a full adder into the counters; a lane is lost
    when its counter has passed the radius, an item when all its lanes are.
    """
    query = query.reshape(len(query), -1)
    item = np.arange(len(of))
    alive = lanes.copy()
    depth = max(1, radius.bit_length())
    counters = [np.zeros(len(of), "<u8") for _ in range(depth)]
    for bit in range(0, stored.shape[1], 2):
        if bit % 64 == 0:
            q = query[of, bit // 64]
        a, b = (stored[block, k] ^ (-((q >> np.uint64(k % 64)) & np.uint64(1)).astype("<i8")).view("<u8") for k in (bit, bit + 1))
        low = counters[0]
        mixed = a ^ b
        carry = (a & b) | (low & mixed)
        counters[0] = low ^ mixed
        for k in range(1, depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        beyond = carry  # past all counters
        if bit + 2 <= radius:
            continue  # no lane can have passed the radius yet
        over, same = np.zeros_like(beyond), np.full_like(beyond, _FULL)
        for k in reversed(range(depth)):  # counter > radius, from the highest bit
            if radius >> k & 1:
                same &= counters[k]
            else:
                over |= same & counters[k]
                same &= ~counters[k]
        alive &= ~(beyond | over)
        if bit % 8 == 6:
            left = alive != 0
            if not left.all():
                item, q, of, alive, block = item[left], q[left], of[left], alive[left], block[left]
                counters = [c[left] for c in counters]
                if not len(item):
                    break
    return item, alive


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's class under the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            again = root[root]
            if (again == root).all():
                break
            root = again
        if (before == root).all():
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def linked(group: np.ndarray, fps: np.ndarray, second: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) of a spanning forest of the links inside each run of equal `group`; rows of two tiles (second: False, True) are compared across only."""
    n = len(fps)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    per = -(-sizes // 64)
    # every run starts a block of its own
    first_block = np.concatenate([[0], np.cumsum(per)[:-1]])
    run = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(n) - starts[run]
    slot = 64 * first_block[run] + within
    whole = np.zeros(64 * int(per.sum()), "<u8")
    whole[slot] = fps
    stored = planes(whole)
    row_of = np.full(len(whole), -1)
    row_of[slot] = np.arange(n)
    valid = np.packbits((row_of >= 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
    side = np.zeros(len(whole), bool)
    side[slot] = second
    side = np.packbits(side.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
    two = np.add.reduceat(second.astype(np.int64), starts) > 0
    left, right = [], []
    # items: each row with the blocks at or after its own, a bounded number at a time
    todo = per[run] - within // 64
    bounds = np.concatenate([[0], np.cumsum(todo)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 1_000_000, side="right")) - 1)
        of = np.repeat(np.arange(at, to), todo[at:to])
        step = np.arange(len(of)) - (bounds[of] - bounds[at])
        block = first_block[run[of]] + within[of] // 64 + step
        lanes = valid[block]
        own = step == 0
        lanes = np.where(own, lanes & ~((np.uint64(2) << (within[of] % 64).astype("<u8")) - np.uint64(1)), lanes)
        lanes = np.where(two[run[of]], lanes & np.where(second[of], ~side[block], side[block]), lanes)
        some = lanes != 0
        of, block, lanes = of[some], block[some], lanes[some]
        item, alive = near(fps, stored, of, block, lanes, radius)
        for lo in range(0, len(item), 65_536):
            hits = np.unpackbits(alive[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(hits)
            left.append(of[item[lo + i]])
            right.append(row_of[64 * block[item[lo + i]] + lane])
        at = to
        if sum(map(len, left)) > 4_000_000:
            left, right = _forest(n, left, right)
    left, right = _forest(n, left, right)
    return (left[0], right[0]) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def meeting(group: np.ndarray, fps: np.ndarray, stored: np.ndarray, asks: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of askers and the stored rows within the radius, inside each run of equal `group`, some at a time."""
    starts = np.concatenate([[True], group[1:] != group[:-1]])
    run = np.cumsum(starts) - 1
    kept = np.flatnonzero(stored)
    held = np.bincount(run[kept], minlength=run[-1] + 1)
    per = -(-held // 64)
    first_block = np.concatenate([[0], np.cumsum(per)[:-1]])
    slot = 64 * first_block[run[kept]] + np.arange(len(kept)) - np.concatenate([[0], np.cumsum(held)[:-1]])[run[kept]]
    whole = np.zeros((64 * int(per.sum()), fps.shape[1]), "<u8")
    whole[slot] = fps[kept]
    sliced = planes(whole)
    row_of = np.full(len(whole), -1)
    row_of[slot] = kept
    valid = np.packbits((row_of >= 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
    askers = np.flatnonzero(asks & (per[run] > 0))
    bounds = np.concatenate([[0], np.cumsum(per[run[askers]])])
    at = 0
    while at < len(askers):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 250_000, side="right")) - 1)
        some = askers[at:to]
        of = np.repeat(np.arange(len(some)), per[run[some]])
        block = first_block[run[some]][of] + np.arange(len(of)) - (bounds[at:to] - bounds[at])[of]
        item, alive = near(fps[some], sliced, of, block, valid[block], radius)
        for lo in range(0, len(item), 16_384):
            i, lane = np.nonzero(np.unpackbits(alive[lo : lo + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield some[of[item[lo + i]]], row_of[64 * block[item[lo + i]] + lane]
        at = to


def _forest(n: int, left: list, right: list) -> tuple[list, list]:
    if not left:
        return [], []
    root = _roots(n, np.concatenate(left), np.concatenate(right))
    rows = np.flatnonzero(root != np.arange(n))
    return [root[rows]], [rows]


#: Keys that hold more than one row in so many are hot; there are fewer than that of them, so a table of them can be broadcast.
HOT_SHARE = 1_000
HOT_BUCKETS = 100_000


def placed(rows: DataFrame, bucket: str, by: str, tile: int) -> DataFrame:
    """rows of buckets of two or more, with `own`, the tile of the row, and `tiles`, how many the bucket has.

    A bucket's rows are tiled by rank; those of hot ones, by hash, as a rank would
    take a whole bucket through one task.
    """
    counts = stage(rows.groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(4 * tile, total // HOT_BUCKETS))  # fewer than HOT_BUCKETS rows
    hot = hot.select(bucket, F.ceil(F.col("n") / tile).cast("long").alias("tiles"))
    w = Window.partitionBy(bucket)
    cold = rows.join(F.broadcast(hot.select(bucket)), bucket, "left_anti").withColumn("n", F.count("*").over(w)).where("n > 1")
    cold = cold.withColumns({"own": F.floor((F.row_number().over(w.orderBy(by)) - 1) / tile).cast("long"), "tiles": F.ceil(F.col("n") / tile).cast("long")}).drop("n")
    if not hot.limit(1).count():
        return cold
    warm = rows.join(F.broadcast(hot), bucket).withColumn("own", F.pmod(F.xxhash64(F.lit(7), by), F.col("tiles")))
    return cold.unionByName(warm.select(cold.columns))


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(a, b): edges between different fingerprints of fps(fp) within the radius; their classes are those of all links."""
    rows = fps.select("fp", F.explode(bucket_keys(F.col("fp"), radius, blocks)).alias("bucket"))
    rows = placed(rows, "bucket", "fp", tile)
    tiles, own = F.col("tiles"), F.col("own")
    # tile i meets every tile j: rows of i go to (i, j), as first or second side
    meets = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).alias("second")))
    rows = rows.select("fp", "bucket", F.explode(meets).alias("t")).select("fp", F.xxhash64("bucket", "t.i", "t.j").alias("pair"), "t.second")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def solved(pdf: pd.DataFrame) -> pd.DataFrame:
            fp = pdf["fp"].to_numpy(np.int64)
            a, b = linked(pdf["pair"].to_numpy(np.int64), fp.view("<u8"), pdf["second"].to_numpy(bool), radius)
            return pd.DataFrame({"a": fp[a], "b": fp[b]})

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["pair"] == pdf["pair"].iloc[-1]  # its run may go on in the next batch
            rest = pdf[last]
            if not last.all():
                yield solved(pdf[~last])
        if rest is not None and len(rest):
            yield solved(rest)

    shuffled = rows.repartition("pair").sortWithinPartitions("pair", "second", "fp")
    return shuffled.mapInPandas(run, "a long, b long").distinct()


def classes(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """(fp, root): for every fp in an edge, the fp of least rank in its class; rank(fp, least).

    Large-star and small-star steps alternate until nothing changes; the number
    of rounds grows with the logarithm of the longest chain. Every round is
    written to the shared folder.
    """
    named = stage(
        edges.join(rank.select(F.col("fp").alias("a"), F.col("least").alias("la")), "a").join(rank.select(F.col("fp").alias("b"), F.col("least").alias("lb")), "b")
        .select(F.struct(F.col("la").alias("least"), F.col("a").alias("fp")).alias("u"), F.struct(F.col("lb").alias("least"), F.col("b").alias("fp")).alias("v")),
        "simhash-edges",
    )
    high, low = F.greatest("u", "v"), F.least("u", "v")
    now = stage(named.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), "simhash-star")
    before = None
    while True:
        # large star: every larger neighbour of a node points to the node's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours, and itself, point to the least of them
        big = stage(big, "simhash-star")
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        next_ = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "simhash-star")
        mark = next_.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            return next_.select(F.col("u.fp").alias("fp"), F.col("v.fp").alias("root"), F.col("v.least").alias("root_least"))
        before, now = mark, next_


def assigned(rows: DataFrame, of: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """rows joined with of by column `name`; counts(name, n) tells the hot keys, whose few rows of `of` are broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(16, total // HOT_SHARE)).select(name)  # fewer than HOT_SHARE rows
    cold = rows.join(F.broadcast(hot), name, "left_anti").join(of.join(F.broadcast(hot), name, "left_anti"), name)
    return cold.unionByName(rows.join(F.broadcast(of.join(F.broadcast(hot), name)), name).select(cold.columns))


#: The first row of a class: keys before nulls, then by text hash.
FIRST = "struct(key is null as none, key, text_hash)"


def _classified(docs: DataFrame, radius: int, blocks: int, tile: int, shingle: int, seed: int, key: str, text: str) -> DataFrame:
    """Per row of docs: key, text_hash, fp and first, the FIRST of its component."""
    rows = stage(fingerprints(docs, key, text, shingle, seed), "simhash")
    rank = stage(rows.groupBy("fp").agg(F.min(F.expr(FIRST)).alias("least"), F.count("*").alias("n")), "simhash-classes")
    edges = stage(links(rank.select("fp"), radius, blocks, tile), "simhash-links")
    return with_first(rows, rank, edges)


def with_first(rows: DataFrame, rank: DataFrame, edges: DataFrame) -> DataFrame:
    """rows(key, text_hash, fp) with first, the FIRST of their component: classes of fp, with least and n in rank, joined by edges(a, b)."""
    found = classes(edges, rank.select("fp", "least"))
    of = rank.join(found, "fp", "left").select("fp", F.coalesce("root_least", "least").alias("first"))
    return assigned(rows, stage(of, "simhash-first"), rank.select("fp", "n"), "fp")


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, fp (signed long) and component (the smallest key reachable over links)."""
    return _classified(docs, radius, blocks, tile, shingle, seed, key, text).select("key", "fp", F.col("first.key").alias("component"))


def keep_one(docs: DataFrame, *, similarity: float | None = None, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest key stays (null keys last, then by text hash).

    similarity: links are then pairs of texts whose shingle sets have at least this Jaccard similarity,
    and radius and blocks are not used. Only keys and hashes are grouped.
    """
    if similarity is None:
        return one_of_each(docs, _classified(docs, radius, blocks, tile, shingle, seed, key, text), key, text)
    from .similar import classified

    return one_of_each(docs, classified(docs, similarity, shingle, tile, key, text), key, text)


#: Rows that go are broadcast up to this number (16 bytes each, and the hash table); beyond it they are joined by a shuffle.
BROADCAST_LOSERS = 1_000_000


def one_of_each(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """The row of docs that is the first of each component; rows(key, text_hash, first).

    The rows that go are told by key and text hash. Of rows that repeat both, the
    one of least hash stays; only their texts are grouped.
    """
    rows = stage(rows.select("key", "text_hash", "first"), "simhash-rows")
    stays = F.col("key").eqNullSafe(F.col("first.key")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
    each = rows.groupBy("key", "text_hash").agg(F.count("*").alias("n"), F.max(stays).alias("stays"))
    out = stage(each.where("not stays or n > 1"), "simhash-losers")
    names = {"key": one_of("loser_key", docs.columns), "text_hash": one_of("loser_hash", docs.columns)}
    hashed = one_of("hash_of_text", docs.columns)
    whose = F.col(key).eqNullSafe(F.col(names["key"])) & F.col(hashed).eqNullSafe(F.col(names["text_hash"]))
    sized = lambda df: F.broadcast(df) if df.count() <= BROADCAST_LOSERS else df
    told = docs.withColumn(hashed, F.xxhash64(text))
    kept = told.join(sized(out.select("key", "text_hash").withColumnsRenamed(names)), whose, "left_anti").select(*docs.columns)
    twice = out.where("stays").select("key", "text_hash").withColumnsRenamed(names)
    if not twice.limit(1).count():
        return kept
    again = told.join(sized(twice), whose, "left_semi")
    one = again.groupBy(key, hashed).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row_")).select("row_.*")
    return kept.unionByName(one)


def as_hex(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
