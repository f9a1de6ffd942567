"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one coordinate more, which makes the largest inner product the
smallest Euclidean distance, and a random rotation, after which any leading
coordinates tell much of a distance. Lists are the cells of centroids fitted on
a bounded sample; every row is indexed. Inside each probed list, distances grow
column block by column block; after each block a hypothesis test abandons the
pairs whose partial distance says that they end beyond the query's bound. The
bound is first the query's k-th distance within a few sampled rows; the nearest
list is scanned with it, which tightens it to the k-th distance found there, and
then the other probed lists. Scores of what is left are computed in double
precision from the original vectors. A query that finds fewer than k rows in its
lists is filled up from those rows.

Lists are cut into blocks, and the queries of a list into chunks, by their
counts: a task holds one block and streams its queries.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or differ in length from the commonest length take no part, nor do rows
without id; of rows that repeat a query's id one is searched for; rows that
repeat an id are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import least_hashed, stage

#: Rows on which centroids and the number of probes are fitted.
SAMPLE_ROWS = 65_536
#: Rows of those that give a query its first bound, and fill up a short answer.
BOUND_ROWS = 4_096
MAX_LISTS = 4_096
#: Share of true neighbours, measured on the sample, that the probed lists shall hold.
TARGET_RECALL = 0.97
BLOCK_ROWS = 4_096
CHUNK_QUERIES = 16_384
COLUMNS = 16
#: Width of the hypothesis test.
EPSILON = 2.1


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    top: float
    centroids: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray

    def stored(self, x: np.ndarray) -> np.ndarray:
        """Rotated coordinates of stored vectors, with the one that evens out lengths."""
        rest = np.sqrt(np.maximum(0.0, self.top**2 - (x.astype(np.float64) ** 2).sum(axis=1)))
        return (np.hstack([x, rest[:, None]]) @ self.rotation).astype(np.float32)

    def asked(self, q: np.ndarray) -> np.ndarray:
        return (np.hstack([q, np.zeros((len(q), 1))]) @ self.rotation).astype(np.float32)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, the same for a pair wherever it stands."""
    return (q.astype(np.float64) * x.astype(np.float64)).sum(axis=1)


def fit(rows: DataFrame, k: int, seed: int = 3, sample_rows: int = SAMPLE_ROWS, target: float = TARGET_RECALL) -> Index | None:
    """An index of rows(id, v); None without rows. Only the sample reaches the driver."""
    n, top = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    if not n:
        return None
    got = least_hashed(rows, sample_rows, f"neighbours {seed}", "id").toArrow()
    ids = got["id"].to_numpy()
    x = got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1] + 1,) * 2))[0]
    index = Index(rotation, float(top), np.zeros((1, x.shape[1] + 1), np.float32), 1, ids, x)
    y = index.stored(x)
    # centroids from one half, probes from the other: rows that centroids were fitted to lie nearer to them than others do
    order = rng.permutation(len(y))
    told = order[: max(1, len(y) // 2)] if len(y) >= 64 else order
    kept = order[len(y) // 2 :] if len(y) >= 64 else order
    lists = int(min(MAX_LISTS, max(1, round(n**0.5)), max(1, len(told) // 16)))
    centroids = y[told[:lists]]
    for _ in range(12):
        of = _distances(y[told], centroids).argmin(axis=1)
        size = np.bincount(of, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, of, y[told])
        centroids = np.where(size[:, None] > 0, total / np.maximum(1, size)[:, None], centroids).astype(np.float32)
    of = _distances(y[kept], centroids).argmin(axis=1)
    asked = rng.choice(len(y), min(400, len(y)), replace=False)
    q = index.asked(x[asked])
    true = x[asked].astype(np.float64) @ x[kept].astype(np.float64).T
    true[asked[:, None] == kept] = -np.inf
    near = np.argsort(-true, axis=1)[:, : min(k, max(1, len(kept) - 1))]
    rank = np.argsort(np.argsort(_distances(q, centroids), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, of[near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1
    some = order[:BOUND_ROWS]
    return Index(rotation, float(top), centroids, min(lists, probes), ids[some], x[some])


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -s))[:k]


def _scan(q: np.ndarray, bound: np.ndarray, x: np.ndarray, columns: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) whose distance may be within the query's bound (squared): the adaptive scan."""
    d = q.shape[1]
    limit = (bound * (1 + 1e-4) + 1e-6).astype(np.float32)
    part = _distances(q[:, :columns], x[:, :columns])
    at = min(columns, d)
    wide = lambda t: 1.0 if t >= d else t / d * (1 + epsilon / np.sqrt(t)) ** 2
    i, j = np.nonzero(part <= (limit * min(1.0, wide(at)))[:, None])
    part = part[i, j]
    while at < d and len(i):
        to = min(d, at + columns)
        part = part + ((q[i, at:to] - x[j, at:to]) ** 2).sum(axis=1)
        at = to
        stays = part <= limit[i] * min(1.0, wide(at))
        i, j, part = i[stays], j[stays], part[stays]
    return i, j


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, key: str = "vec_id", vector: str = "embedding", seed: int = 3, sample_rows: int = SAMPLE_ROWS, target: float = TARGET_RECALL, epsilon: float = EPSILON, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for every row where is_query holds."""
    spark = vectors.sparkSession
    sound = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks"))
    length = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = stage(sound.where(F.size("v") == (length["n"] if length else 0)), "neighbours-rows")
    out = "query_id long, rank int, id long, score double"
    index = fit(rows.select("id", "v"), k, seed, sample_rows, target)
    if index is None:
        return spark.createDataFrame([], out)
    sent = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids and BOUND_ROWS vectors
    kind = dict(rows.dtypes)["v"]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = sent.value
        for pdf in batches:
            if len(pdf):
                y = ix.stored(np.stack(pdf["v"].to_numpy()))
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "list": _distances(y, ix.centroids).argmin(axis=1)})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = sent.value
        stored = ix.stored(ix.sample)
        for whole in batches:
            for lo in range(0, len(whole), 512):
                pdf = whole.iloc[lo : lo + 512]
                v, ids = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy(np.int64)
                q = ix.asked(v)
                apart = _distances(q, stored)
                apart[ids[:, None] == ix.sample_ids] = np.inf
                m = min(k, len(stored))
                first = np.argpartition(apart, m - 1, axis=1)[:, :m]
                reach = np.take_along_axis(apart, first, axis=1)
                bound = np.where(np.isfinite(reach.max(axis=1)) & (m == k), reach.max(axis=1), np.finfo(np.float32).max / 4)
                lists = np.argsort(_distances(q, ix.centroids), axis=1, kind="stable")[:, : ix.probes]
                found_q, found_at = np.nonzero(np.isfinite(reach))
                places = first[found_q, found_at]
                yield pd.DataFrame({
                    "id": ids, "v": pdf["v"].to_numpy(), "bound": bound.astype(np.float64), "lists": list(lists.astype(np.int32)),
                    "near": _split(ix.sample_ids[places], found_q, len(pdf)), "near_score": _split(scores(v[found_q], ix.sample[places]), found_q, len(pdf)),
                })

    listed = stage(rows.select("id", "v").dropDuplicates(["id"]).mapInPandas(assign, f"id long, v {kind}, list int"), "neighbours-lists")
    asked = rows.where("asks").select("id", "v").dropDuplicates(["id"])
    asked = stage(asked.mapInPandas(probe, f"id long, v {kind}, bound double, lists array<int>, near array<long>, near_score array<double>"), "neighbours-queries")
    sizes = stage(listed.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "neighbours-sizes")

    def cells(probes: DataFrame) -> DataFrame:
        """The blocks of the lists that probes(id, v, bound, list) ask for, each with its queries."""
        asking = probes.groupBy("list").agg(F.ceil(F.count("*") / chunk_queries).cast("int").alias("chunks"))
        counts = F.broadcast(sizes.join(asking, "list"))  # at most MAX_LISTS rows
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
        left = listed.join(counts, "list").select("list", own(1, "blocks").alias("block"), each("chunks").alias("chunk"), F.lit(0).alias("tag"), "id", "v", F.lit(0.0).alias("bound"))
        right = probes.join(counts, "list").select("list", each("blocks").alias("block"), own(2, "chunks").alias("chunk"), F.lit(1).alias("tag"), "id", "v", "bound")
        dealt = left.unionByName(right).withColumn("cell", F.xxhash64("list", "block", "chunk")).select("cell", "tag", "id", "v", "bound")
        return dealt.repartition("cell").sortWithinPartitions("cell", "tag").mapInPandas(search, "query_id long, id long, score double")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = sent.value
        cell, held_ids, held, rotated = None, [], [], None
        for pdf in batches:
            for c, part in pdf.groupby("cell", sort=False):
                if c != cell:
                    cell, held_ids, held, rotated = c, [], [], None
                new = part[part["tag"] == 0]
                if len(new):
                    held_ids.append(new["id"].to_numpy(np.int64))
                    held.append(np.stack(new["v"].to_numpy()))
                queries = part[part["tag"] == 1]
                if not len(queries) or not held:
                    continue
                if rotated is None:
                    ids, x = np.concatenate(held_ids), np.concatenate(held)
                    rotated = ix.stored(x)
                for lo in range(0, len(queries), 512):
                    some = queries.iloc[lo : lo + 512]
                    qv, qid = np.stack(some["v"].to_numpy()), some["id"].to_numpy(np.int64)
                    i, j = _scan(ix.asked(qv), some["bound"].to_numpy(), rotated, COLUMNS, epsilon)
                    other = ids[j] != qid[i]
                    i, j = i[other], j[other]
                    s = scores(qv[i], x[j])
                    order = np.lexsort((ids[j], -s, i))
                    i, j, s = i[order], j[order], s[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    top = place < k
                    yield pd.DataFrame({"query_id": qid[i[top]], "id": ids[j[top]], "score": s[top]})

    first = stage(cells(asked.select("id", "v", "bound", F.col("lists")[0].alias("list"))), "neighbours-first")
    # the k-th score of a query's nearest list bounds its distance: d^2 = |q|^2 + top^2 - 2 score
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    reached = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    tight = F.least("bound", F.greatest(F.lit(0.0), length + F.lit(index.top) ** 2 - 2 * F.col("reached")))
    more = asked.join(reached, "id", "left").withColumn("bound", F.when(F.col("reached").isNotNull(), tight).otherwise(F.col("bound"))).select("id", "v", "bound", F.explode(F.slice("lists", 2, max(1, index.probes))).alias("list"))
    found = first.unionByName(cells(stage(more, "neighbours-probes"))).withColumn("fill", F.lit(0))
    sampled = asked.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "near_score")).alias("x")).select("query_id", F.col("x.near").alias("id"), F.col("x.near_score").alias("score"), F.lit(1).alias("fill"))
    both = found.unionByName(sampled).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min("fill").alias("fill"))
    held = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("fill", F.desc("score"), "id"))).where(F.col("rank") <= k)
    return held.withColumn("rank", F.row_number().over(by_score)).select("query_id", "rank", "id", "score")


def _split(values: np.ndarray, of: np.ndarray, n: int) -> list[np.ndarray]:
    """values by row: of is sorted and says which row each belongs to."""
    return np.split(values, np.searchsorted(of, np.arange(1, n)))
