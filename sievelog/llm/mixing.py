"""Mixing sources to target token weights by the cube method.

Every unit gets whole copies and a fraction of one; the fractions are inclusion
probabilities. The flight phase moves them three units at a time along the
null space of two constraints (units chosen, words chosen), so both totals of a
source stay exact until at most two units of it are fractional; the landing
phase decides those and may swap a few units for others of a fitting length. Flights run over chunks of a source, then over what the
chunks leave, level by level, so no task ever holds a source.

Defined cases: a null text has size 0; null is a source of its own, last in
order; rows that repeat a doc_id (or, without one, a text) within a source are
one unit and share its copies; sources or tables without words get targets of 0.
"""

from __future__ import annotations

import random
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, one_of, stage

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Units in one flight.
CHUNK = 4096
#: Leavings of so many chunks (two each at most) make the next flight.
FAN_IN = 1024
#: Swaps that a landing may make.
MAX_SWAPS = 8
#: Sources are broadcast only up to this number.
BROADCAST_SOURCES = 20_000
_EPS = 1e-9


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """Per source of sizes(source, size): source_size and target.

    Capping and sharing the excess again by weight ends where every target is
    min(cap * source_size, level * weight); the level is found on the sorted
    ratios of cap to weight. Windows without a key run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    per = per.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - before) / rest)
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(Window.partitionBy())
    # rounding may leave no level at the very top, where every source is at its cap
    per = per.withColumn("target", F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return per.select("source", "source_size", "n_units", "target")


def _flight(pdf: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    """Moves pi to 0 or 1 but for at most two units; decides those too if last.

    Long units first, so that those left fractional are short. Every choice
    depends on the units and the seed alone.
    """
    pdf = pdf.sort_values(["size", "rank"], ascending=[False, True], kind="stable").reset_index(drop=True)
    pi, size = pdf["pi"].tolist(), pdf["size"].astype(float).tolist()
    rng = random.Random(hash((seed, int(pdf["rank"].iloc[0]), len(pdf))))

    def move(ids: list[int], u: list[float]) -> None:
        up, down = [], []
        for k, x in zip(ids, u):
            if x > 0:
                up.append((1 - pi[k]) / x)
                down.append(pi[k] / x)
            elif x < 0:
                up.append(-pi[k] / x)
                down.append((pi[k] - 1) / x)
        a, b = min(up), min(down)
        step = a if rng.random() * (a + b) < b else -b
        for k, x in zip(ids, u):
            p = pi[k] + step * x
            pi[k] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p

    due_words = sum(p * w for p, w in zip(pi, size))
    active: list[int] = []
    for k in range(len(pi)):
        if not _EPS <= pi[k] <= 1 - _EPS:
            pi[k] = round(pi[k])
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]
            top = max(map(abs, u))
            move(active, [x / top for x in u] if top else [1.0, -1.0, 0.0])
            active = [x for x in active if 0 < pi[x] < 1]
    if last and active:  # the landing: of the few outcomes, the one nearest to the words due
        due = sum(pi[k] * size[k] for k in active)
        ways = [[(w >> i) & 1 for i in range(len(active))] for w in range(2 ** len(active))]
        best = min(ways, key=lambda w: (abs(sum(x * size[k] for x, k in zip(w, active)) - due), w))
        for k, x in zip(active, best):
            pi[k] = float(x)
    swaps = 0
    while last and swaps < MAX_SWAPS and _swap(pi, size, due_words):
        swaps += 1
    pdf["pi"] = pi
    return pdf


def _swap(pi: list[float], size: list[float], due: float) -> bool:
    """Changes one chosen unit for one left out if that brings the words nearer to those due; the number of units stays."""
    lack = due - sum(p * w for p, w in zip(pi, size))
    left = sorted((w, k) for k, (p, w) in enumerate(zip(pi, size)) if p == 0 and w)
    best = (abs(lack), -1, -1)
    for k, (p, w) in enumerate(zip(pi, size)):
        if p == 1:
            at = bisect_left(left, (w + lack, -1))
            for w2, k2 in left[max(0, at - 1) : at + 1]:
                best = min(best, (abs(lack - (w2 - w)), k, k2))
    if best[1] >= 0:
        pi[best[1]], pi[best[2]] = 0.0, 1.0
    return best[1] >= 0


def _flown(df: DataFrame, last: bool, seed: int) -> DataFrame:
    return df.groupBy("source_no", "chunk").applyInPandas(lambda pdf: _flight(pdf, last, seed), df.schema)


def _decided(units: DataFrame, seed: int, chunk: int, fan_in: int) -> DataFrame:
    """units(…, source_no, n_units, rank, size, pi) with every pi 0 or 1."""
    open_ = (F.col("pi") >= _EPS) & (F.col("pi") <= 1 - _EPS)
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n_units") / chunk))
    units = units.withColumn("chunk", F.pmod(F.col("rank"), n_chunks).cast("long"))
    level, most = units, units.agg(F.max("n_units")).first()[0] or 0
    most = max(1, -(-most // chunk))
    done: list[DataFrame] = []
    while True:
        level = stage(_flown(level, most == 1, seed), "mixing")
        done.append(level.where(~open_))
        if most == 1:
            break
        most = -(-most // fan_in)
        level = level.where(open_).withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = 5, chunk: int = CHUNK, fan_in: int = FAN_IN, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of docs: key, uid, source, size, source_size, target, copies (how often the mix takes it) and taken = copies * size.

    uid joins the copies back to the texts (unit_id()).
    """
    rows = stage(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), unit_id(docs[key], docs[text]).alias("uid"), words(docs[text]).alias("size")), "mixing-rows")
    per = targets(rows, weights, share, cap).withColumn("source_no", F.xxhash64("source"))
    small = stage(per, "mixing-sources")
    if small.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    units = rows.groupBy("uid", "source").agg(F.sum("size").alias("size"))
    units = units.alias("u").join(small.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.uid", "u.source", "u.size", "s.source_no", "s.source_size", "s.n_units", "s.target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("whole", F.floor(ratio + _EPS).cast("long")).withColumn("pi", F.greatest(F.lit(0.0), ratio - F.col("whole"))).withColumn("rank", F.xxhash64(F.lit(seed), "uid", "source"))
    units = units.withColumn("pi", F.when(F.col("size") > 0, F.col("pi")).otherwise(F.lit(0.0)))
    got = _decided(units, seed, chunk, fan_in).select("uid", "source", "source_size", "target", (F.col("whole") + F.col("pi").cast("long")).alias("copies"))
    out = rows.alias("r").join(got.alias("g"), (F.col("r.uid") == F.col("g.uid")) & F.col("r.source").eqNullSafe(F.col("g.source")))
    return out.select("r.key", "r.uid", "r.source", "r.size", "g.source_size", "g.target", "g.copies", (F.col("g.copies") * F.col("r.size")).alias("taken"))


def unit_id(key: Column, text: Column) -> Column:
    """Rows of a source with the same key are one unit; those without a key, with the same text."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.concat(F.lit("t"), F.xxhash64(text).cast("string")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as often as the mix takes each row, in the columns of docs."""
    got = mix(docs, **how).select("uid", "source", "copies").distinct().where("copies > 0")
    names = {n: one_of(f"mix_{n}", docs.columns) for n in ("uid", "source", "copies", "own")}
    got = got.withColumnsRenamed({n: names[n] for n in got.columns})
    left = docs.withColumn(names["own"], unit_id(docs[how.get("key", "doc_id")], docs[how.get("text", "text")]))
    out = left.join(got, (F.col(names["own"]) == F.col(names["uid"])) & left[how.get("source", "source")].eqNullSafe(F.col(names["source"])))
    return out.withColumn(names["uid"], F.explode(F.array_repeat(F.lit(1), F.col(names["copies"]).cast("int")))).select(*docs.columns)
