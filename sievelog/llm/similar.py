"""Near duplicates by Jaccard similarity of word shingles, for simhash.keep_one(similarity=...).

Two texts are linked if their sets of word shingles have at least that similarity
(0.8 or more); near duplicates are the components of these links.

Such texts differ in some 10 of 64 bits of a SimHash, and up to 20 by chance, which is beyond what
parts of a fingerprint that agree can propose. So texts meet where they share a band of
minima instead: BANDS bands of ROWS minima make a pair of similarity 0.8 meet but for a chance of
(1 - 0.8^4)^32 = 5e-8, and one of more similarity sooner. Within a bucket, fingerprints of
64 * WORDS bits are compared bit-sliced, by planes and carry-save counters, at a radius that a
linked pair exceeds with a chance of about 1e-8; what is left is confirmed by the sets.
Texts with one set are one class from the start.

A bucket's tiles are first compared with their least members only; what that joins is one
component. In the second round the rows of a bucket whose component is not that of its least
member are compared with all of it, so a large family of copies costs its size and not its
square. A row that asks visits every tile; the others stay in theirs. A row that finds more than
FEW others puts out no pairs but joins them to a family (edges of a forest). A family's sets
meet in tiles, are compared there exactly, and put out edges of a forest again: texts that
resemble each other by the thousands and are not linked make no pairs.

Words are those of op1: separated by ASCII white space, ASCII-lower-cased. Defined
cases: a text of fewer words than a shingle has one shingle of all its words;
null and empty texts have no shingles and are one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_text_batches, stage
from .simhash import BROADCAST_LOSERS, FIRST, HOT_SHARE, _forest, assigned, classes, meeting, placed, with_first

LEAST_SIMILARITY = 0.8
SEED = 42
BANDS, ROWS = 32, 4
#: Words of a fingerprint.
WORDS = 4
#: Copies of a set that many pairs want.
SALTS = 64
#: Others that a row may find in a bucket and still be confirmed pair by pair.
FEW = 8
#: Shingles in one tile of a family, and columns of its incidence matrix at once.
TILE_SHINGLES = 1_000_000
COLUMNS = 4096
_PRIME = np.uint64(0x9E3779B185EBCA87)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted set of a text's shingles, as 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both act on ASCII only
    if not words:
        return np.zeros(0, "<u8")
    hash_ = xxhash.xxh64_intdigest
    each = np.fromiter((hash_(w, SEED) for w in words), "<u8", len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.full(n, min(shingle, len(words)), "<u8")
    for k in range(min(shingle, len(words))):
        out = out * _PRIME + each[k : k + n]
    return np.unique(_mixed(out))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a set under each of BANDS * ROWS hash functions."""
    least = np.full(BANDS * ROWS, 2**32 - 1, "<u8")
    for at in range(0, len(found), 2048):  # a bounded table at once
        least = np.minimum(least, ((found[at : at + 2048, None] * _TIMES + _PLUS) >> np.uint64(32)).min(axis=0))
    return least.astype("<u4")


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set in WORDS words."""
    counts = np.zeros((WORDS, 64), np.int64)
    for w in range(WORDS):
        h = _mixed(found * _TIMES[w] + _PLUS[w])
        for lo in range(0, len(h), 255):  # counts of 255 fit in bytes
            counts[w] += np.add.reduce(np.unpackbits(h[lo : lo + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), axis=1, bitorder="little").view("<u8").reshape(-1)


def radius_of(similarity: float) -> int:
    """Differing bits that sets of this similarity stay within, but for a chance of about 1e-8."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * WORDS * p + 5.75 * math.sqrt(64 * WORDS * p * (1 - p)))


def _signatures(docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """(key, text_hash, fp, n, bands, bits): fp names the set of shingles, n is its size, bits its fingerprint."""
    small_text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                found = shingles(t, shingle)
                least = minima(found)
                bands = [xxhash.xxh64_intdigest(least[ROWS * b : ROWS * b + ROWS].tobytes(), b) for b in range(BANDS)] if len(found) else []
                out.append((xxhash.xxh64_intdigest(found.tobytes(), SEED), len(found), np.array(bands, "<u8").view("<i8"), fingerprint(found).tobytes()))
            fps = np.array([x[0] for x in out], "<u8").view("<i8")
            keys = pdf["key"].astype("Int64") if kind == "bigint" else pdf["key"]
            yield pd.DataFrame({"key": keys, "text_hash": pdf["text_hash"], "fp": fps, "n": [x[1] for x in out], "bands": [x[2] for x in out], "bits": [x[3] for x in out]})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInPandas(run, f"key {kind}, text_hash long, fp long, n long, bands array<long>, bits binary")


def _by_run(run, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """run(rows) over whole runs of equal `pair`, which may reach over batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = (pdf["pair"] == pdf["pair"].iloc[-1]).to_numpy()
        if held and (last.all() and held[-1]["pair"].iloc[-1] == pdf["pair"].iloc[-1]):
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf[~last]], ignore_index=True) if held or not last.all() else pdf[:0]
        held = [pdf[last]]
        if len(whole):
            yield from run(whole)
    if held:
        yield from run(pd.concat(held, ignore_index=True))


def _pairs(rows: DataFrame, share: Fraction, first_asks: bool) -> DataFrame:
    """(a, b, many) from rows(pair, stored, asks, fp, n, bits, root): askers with the stored rows of their pair that are of another root.

    many: edges of a forest over rows that find more than FEW others, and those they find; else pairs to confirm.
    """
    radius = radius_of(float(share))

    def solved(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pair, fp, n, root = (pdf[c].to_numpy(np.int64) for c in ("pair", "fp", "n", "root"))
        bits = np.frombuffer(b"".join(pdf["bits"]), "<u8").reshape(len(pdf), WORDS)
        starts = np.concatenate([[True], pair[1:] != pair[:-1]])
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for i, j in meeting(pair, bits, pdf["stored"].to_numpy(bool), starts if first_asks else pdf["asks"].to_numpy(bool), radius):
            fine = (root[i] != root[j]) & (share.denominator * np.minimum(n[i], n[j]) >= share.numerator * np.maximum(n[i], n[j]))
            i, j = i[fine], j[fine]
            many = np.zeros(len(i), bool) if first_asks else (np.bincount(i, minlength=len(fp)) > FEW)[i]
            a, b = fp[i[~many]], fp[j[~many]]
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "many": False}).drop_duplicates()
            if many.any():
                left, right = _forest(len(fp), [*left, i[many]], [*right, j[many]])
        for i, j in zip(left, right):
            yield pd.DataFrame({"a": fp[i], "b": fp[j], "many": True})

    return rows.repartition("pair").sortWithinPartitions("pair", "fp").mapInPandas(lambda batches: _by_run(solved, batches), "a long, b long, many boolean").distinct()


def _sets(wanted: DataFrame, docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """(fp, s): the sets of wanted(fp, key, text_hash), each from the row of docs that it names."""
    texts = docs.select(F.col(key).alias("of_key"), F.col(text).alias("text"), F.xxhash64(text).alias("of_hash"))
    told = wanted.select("fp", "key", "text_hash")
    told = F.broadcast(told) if told.count() <= BROADCAST_LOSERS else told
    texts = texts.join(told, F.col("of_key").eqNullSafe(F.col("key")) & F.col("of_hash").eqNullSafe(F.col("text_hash"))).select("fp", "text").dropDuplicates(["fp"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"fp": pdf["fp"], "s": [shingles(t, shingle).view("<i8") for t in pdf["text"]]})

    return stage(texts.mapInPandas(run, "fp long, s array<long>"), "similar-sets")


def alike(sets: list[np.ndarray], second: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of sets as similar as that; across only where some rows are of a second side."""
    one = np.flatnonzero(~second)
    other = np.flatnonzero(second) if second.any() else one
    sizes = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    _, at, held = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    shared = held > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    of, at = of[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    common = np.zeros((len(one), len(other)), np.float32)  # whole numbers below 2^24 are exact
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(at, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[of[a:b], at[a:b] - lo] = 1
        common += m[one] @ m[other].T
    p, q = share.numerator, share.denominator
    i, j = np.nonzero((p + q) * common.astype(np.float64) >= p * (sizes[one][:, None] + sizes[other][None, :]))
    i, j = one[i], other[j]
    return i[i != j], j[i != j]


def _in_families(edges: DataFrame, docs: DataFrame, rank: DataFrame, place: DataFrame, each: DataFrame, share: Fraction, shingle: int, tile: int, key: str, text: str) -> DataFrame:
    """(a, b): edges of forests of the links within the families that edges(a, b) join."""
    found = classes(edges, rank.select("fp", "least")).select("fp", "root")
    members = stage(found.unionByName(found.select(F.col("root").alias("fp"), "root")).distinct().join(each.select("fp", F.col("n").alias("shingles")), "fp"), "similar-families")
    counts = stage(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("shingles").alias("s")), "similar-family-sizes")
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("s") / TILE_SHINGLES)).cast("long")
    rows = assigned(members, counts.select("root", tiles.alias("tiles")), counts.select("root", "n"), "root").withColumn("own", F.pmod(F.xxhash64(F.lit(8), "fp"), F.col("tiles")))
    sets = _sets(members.select("fp").join(place, "fp"), docs, shingle, key, text)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), (F.col("own") > j).alias("second")))
    rows = rows.join(sets, "fp").withColumn("t", F.explode(meets)).select(F.xxhash64("root", "t.i", "t.j").alias("pair"), "t.second", "fp", "s")

    def solved(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in pdf.groupby("pair", sort=False):
            i, j = alike(part["s"].tolist(), part["second"].to_numpy(bool), share)
            left, right = _forest(len(part), [i], [j]) if len(i) else ([], [])
            fp = part["fp"].to_numpy(np.int64)
            for a, b in zip(left, right):
                yield pd.DataFrame({"a": fp[a], "b": fp[b]})

    return rows.repartition("pair").sortWithinPartitions("pair", "second", "fp").mapInPandas(lambda batches: _by_run(solved, batches), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, one: DataFrame, share: Fraction, shingle: int, key: str, text: str) -> DataFrame:
    """The pairs whose sets are as similar as that; one(fp, key, text_hash) names a row of docs for each set."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    wanted = stage(ends.join(one, "fp"), "similar-wanted")
    total = wanted.agg(F.sum("n")).first()[0]
    sets = _sets(wanted, docs, shingle, key, text)
    # sets that more than a share of the pairs want (there are fewer than 2 * HOT_SHARE) stand SALTS times
    hot = F.broadcast(wanted.where(F.col("n") > max(SALTS, (total or 0) // (2 * HOT_SHARE))).select("fp", F.lit(SALTS).alias("salts")))
    many = sets.join(hot, "fp", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).select("fp", "salt", "s")
    both = pairs
    for name, other in (("b", "a"), ("a", "b")):
        side = both.join(hot.withColumnsRenamed({"fp": name}), name, "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)).drop("salts")
        both = side.join(many.withColumnsRenamed({"fp": name, "s": f"s{name}"}), [name, "salt"]).drop("salt")
    p, q = share.numerator, share.denominator
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where((p + q) * common >= p * (F.size("sa") + F.size("sb"))).select("a", "b").distinct()  # c / (x + y - c) >= p / q


def classified(docs: DataFrame, similarity: float, shingle: int, tile: int, key: str, text: str) -> DataFrame:
    """Per row of docs: key, text_hash and first, the FIRST of its component."""
    if not LEAST_SIMILARITY <= similarity <= 1:
        raise ValueError(f"bands are made for similarities of {LEAST_SIMILARITY} to 1")
    share = Fraction(similarity).limit_denominator(1000)
    rows = stage(_signatures(docs, shingle, key, text), "similar")
    rank = stage(rows.groupBy("fp").agg(F.min(F.expr(FIRST)).alias("least"), F.count("*").alias("n")), "similar-classes")
    place = rank.select("fp", "least.key", "least.text_hash")
    # a set that repeats has equal bands in all its rows; only buckets of two sets or more go on
    sized = stage(rows.select("fp", F.explode("bands").alias("bucket")).distinct(), "similar-bands")
    each = rows.select("fp", "n", "bits").dropDuplicates(["fp"])
    met = stage(placed(sized, "bucket", "fp", tile).join(each, "fp"), "similar-buckets")
    first = met.select(F.xxhash64("bucket", "own").alias("pair"), F.lit(True).alias("stored"), F.lit(False).alias("asks"), "fp", "n", "bits", F.col("fp").alias("root"))
    edges = stage(_confirmed(stage(_pairs(first, share, True).drop("many"), "similar-pairs"), docs, place, share, shingle, key, text), "similar-links")
    found = classes(edges, rank.select("fp", "least")).select("fp", "root")
    rooted = stage(met.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "similar-rooted")
    mains = rooted.groupBy("bucket").agg(F.min_by("root", "fp").alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    mains = stage(mains, "similar-open")
    open_ = assigned(rooted.withColumnRenamed("n", "shingles"), mains.select("bucket", "main"), mains.select("bucket", "n"), "bucket").withColumn("asks", F.col("root") != F.col("main"))
    visits = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.array("own"))
    again = open_.withColumn("t", F.explode(visits)).select(F.xxhash64("bucket", "t").alias("pair"), (F.col("t") == F.col("own")).alias("stored"), "asks", "fp", F.col("shingles").alias("n"), "bits", "root")
    proposed = stage(_pairs(again, share, False), "similar-pairs")
    edges = edges.unionByName(stage(_confirmed(proposed.where("not many").select("a", "b"), docs, place, share, shingle, key, text), "similar-links"))
    many = proposed.where("many").select("a", "b")
    if many.limit(1).count():
        edges = edges.unionByName(stage(_in_families(many, docs, rank, place, each, share, shingle, tile, key, text), "similar-links"))
    return with_first(rows.select("key", "text_hash", "fp"), rank, edges.distinct())
