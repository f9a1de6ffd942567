"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; every run of consecutive sentences that has at
least RUN of them and MIN_WORDS words is hashed. Runs meet by hash over the
whole corpus; in all but the first place of a run its sentences are removed.
The first place is that of the smallest key, then text hash, then position.

Each batch of texts settles its own repeats: only the first place of a hash in
a batch is shuffled, so a passage that is everywhere sends a row for each batch
and not for each copy; the commonest hashes, of which there are few, are
pre-aggregated and broadcast. Texts are not shuffled by run, only once to meet their
spans.

Sentences end at . ! or ? followed by white space, and at line breaks; one
longer than LONG words is also cut after every LONG words, so that an unpunctuated
passage has runs too. As these cuts fall elsewhere when a sentence begins
otherwise, stretches of such sentences also have windows of 2 * LONG words at
places that their words choose: of every CHOICE windows in a row the one of least
hash. Two stretches that share 2 * LONG + CHOICE - 1 words share a window, and
windows leave less than CHOICE words at either end of what is shared. Words are
compared as written; white space is not.

Defined cases: null and empty texts have no sentences and stay as they are;
rows that repeat both key and text are one document; null keys come last; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, cut, one_of, small_text_batches, stage

RUN = 3
MIN_WORDS = 12
LONG = 16
CHOICE = 8
#: Hashes that are common enough to be joined by broadcast: fewer than this.
COMMON = 10_000
_PRIME = np.uint64(0x9E3779B185EBCA87)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(r"\S+")
_BREAK = re.compile(r"[.!?]\s|\n")


def sentences(text: str, long: int = LONG) -> tuple[list[int], list[int], list[int], list[str]]:
    """Start, end, number of words and words (joined by spaces) of every sentence with a word."""
    starts, ends, counts, said = [], [], [], []
    at = 0
    cuts = [m.start() + 1 for m in _BREAK.finditer(text)]
    cuts.append(len(text))
    for to in cuts:
        words = text[at:to].split()
        if words:
            if len(words) <= long:
                begin = at
                while text[begin].isspace():
                    begin += 1
                stop = to
                while text[stop - 1].isspace():
                    stop -= 1
                starts.append(begin)
                ends.append(stop)
                counts.append(len(words))
                said.append(" ".join(words))
            else:
                places = [(m.start(), m.end()) for m in _WORD.finditer(text, at, to)]
                for lo in range(0, len(places), long):
                    part = places[lo : lo + long]
                    starts.append(part[0][0])
                    ends.append(part[-1][1])
                    counts.append(len(part))
                    said.append(" ".join(text[a:b] for a, b in part))
        at = to
    return starts, ends, counts, said


def runs(text: str | None, run: int = RUN, min_words: int = MIN_WORDS, long: int = LONG) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the shortest run that fits from every sentence on."""
    starts, ends, counts, said = sentences(text or "", long)
    total = np.concatenate([[0], np.cumsum(counts)]).tolist()
    out, last, n = [], 0, len(starts)
    for first in range(n):
        last = max(last, first + run)
        while last <= n and total[last] - total[first] < min_words:
            last += 1
        if last > n:
            break
        value = xxhash.xxh3_64_intdigest("\n".join(said[first:last]))
        out.append((value - (1 << 64) if value >> 63 else value, starts[first], ends[last - 1]))
    return out


def windows(text: str | None, long: int = LONG, choice: int = CHOICE) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the chosen windows of 2 * long words in stretches of sentences of more than long words."""
    text, size, out, at = text or "", 2 * long, [], 0
    stretch: list[tuple[int, int]] = []
    for to in [*(m.start() + 1 for m in _BREAK.finditer(text)), len(text), None]:
        if to is not None:
            n = len(text[at:to].split())
            if n > long:
                stretch += [(m.start(), m.end()) for m in _WORD.finditer(text, at, to)]
            at = to
            if n > long or not n:
                continue
        if len(stretch) >= size:
            each = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in stretch], "<u8")
            n = len(each) - size + 1
            value = np.zeros(n, "<u8")
            for k in range(size):
                value = value * _PRIME + each[k : k + n]
            value = (value ^ (value >> np.uint64(32))) * _MIX
            value ^= value >> np.uint64(32)
            near = np.lib.stride_tricks.sliding_window_view(value, min(choice, n))
            chosen = np.unique(np.arange(len(near)) + near.argmin(axis=1))
            out += [(h, stretch[i][0], stretch[i + size - 1][1]) for h, i in zip(value[chosen].view("<i8").tolist(), chosen.tolist())]
        stretch = []
    return out


def hashed_runs(docs: DataFrame, run: int, min_words: int, long: int, key: str, text: str) -> DataFrame:
    """(doc, rank, hash, start, end, again): doc is the hash of key and text, rank orders documents; again: an earlier place in its batch has the same run."""
    small_text_batches(docs.sparkSession)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for doc, rank, t in zip(pdf["doc"], pdf["rank"], pdf["text"]):
                found = runs(t, run, min_words, long) + windows(t, long)
                if found:
                    h, a, b = np.array(found, np.int64).T
                    parts.append((np.full(len(h), doc), np.full(len(h), rank), h, a, b))
            if not parts:
                continue
            doc, rank, h, a, b = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((a, doc, rank, h))
            h, doc, rank, a, b = h[order], doc[order], rank[order], a[order], b[order]
            same = np.concatenate([[False], h[1:] == h[:-1]])
            place = np.concatenate([[False], (doc[1:] == doc[:-1]) & (a[1:] == a[:-1])])
            twin = same & place  # a row that repeats: the same place of the same document
            first = np.maximum.accumulate(np.where(~same, np.arange(len(h)), 0))
            again = same & ~((doc == doc[first]) & (a == a[first]))
            keep = ~twin
            yield pd.DataFrame({"doc": doc, "rank": rank, "hash": h, "start": a.astype(np.int32), "end": b.astype(np.int32), "again": again})[keep]

    rank = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)) if dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    rows = docs.select(F.xxhash64(key, text).alias("doc"), rank.alias("rank"), F.col(text).alias("text"))
    return rows.mapInPandas(cut_up, "doc long, rank long, hash long, start int, end int, again boolean")


def _common_hashes(firsts: DataFrame) -> DataFrame:
    """At most COMMON hashes that hold a large share of all rows, as one row in 32 documents tells. This says which way a hash goes, and changes no result."""
    some = firsts.where(F.pmod(F.xxhash64(F.lit(9), "doc"), F.lit(32)) == 0).groupBy("hash").agg(F.count("*").alias("n"))
    some = stage(some.where("n > 1"), "spans-common")
    total = some.agg(F.sum("n")).first()[0] or 0
    return some.where(F.col("n") > max(16, total // COMMON)).select("hash")


def repeated_spans(docs: DataFrame, *, run: int = RUN, min_words: int = MIN_WORDS, long: int = LONG, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans): the disjoint [start, end) spans to remove from each document that has any."""
    rows = stage(hashed_runs(docs, run, min_words, long, key, text), "spans-runs")
    firsts = rows.where("not again")
    # one shuffle: a hash has one row for each batch at most, and all but the least place are repeats
    place = F.struct("rank", "doc", "start")
    hot = F.broadcast(_common_hashes(firsts))
    cold = firsts.join(hot, "hash", "left_anti").withColumn("least", F.min(place).over(Window.partitionBy("hash"))).where(place > F.col("least"))
    warm = firsts.join(hot, "hash")  # of a hash that is everywhere only the least places of tasks meet
    warm = warm.join(F.broadcast(warm.groupBy("hash").agg(F.min(place).alias("least"))), "hash").where(place > F.col("least"))
    later = cold.unionByName(warm.select(cold.columns))
    # a later place in one batch is later in all, as each batch knows an earlier one
    covered = rows.where("again").select("doc", "start", "end").unionByName(later.select("doc", "start", "end"))
    # a run inside another adds nothing; without such, runs start and end in the same order
    earlier = Window.partitionBy("doc").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    covered = covered.withColumn("reach", F.max("end").over(earlier)).where("reach is null or end > reach").drop("reach")
    spans = covered.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))

    def islands(s):  # runs start and end in the same order: one begins anew where it starts beyond the end before
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] > F.get(s, i - 1)["end"]), x["start"])), lambda x: x.isNotNull())
        stops = F.filter(F.transform(s, lambda x, i: F.when((i == F.size(s) - 1) | (F.get(s, i + 1)["start"] > x["end"]), x["end"])), lambda x: x.isNotNull())
        return F.transform(F.arrays_zip(begins.alias("start"), stops.alias("end")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return spans.select("doc", bind(F.col("s"), islands).alias("spans"))


def deduplicated(docs: DataFrame, *, run: int = RUN, min_words: int = MIN_WORDS, long: int = LONG, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages cut from their texts, and removed_spans: array of struct(start, end) in the original text, empty for untouched rows."""
    doc, out = one_of("doc_hash", docs.columns), one_of("removed_spans", docs.columns)
    spans = repeated_spans(docs, run=run, min_words=min_words, long=long, key=key, text=text).select(F.col("doc").alias(doc), F.col("spans").alias(out))
    joined = docs.withColumn(doc, F.xxhash64(key, text)).join(spans, doc, "left").drop(doc)
    joined = joined.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<struct<start:int,end:int>>")))
    return joined.withColumn(text, F.when(F.size(out) > 0, cut(F.col(text), F.col(out))).otherwise(F.col(text)))
