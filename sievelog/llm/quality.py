"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Rules follow one another: a row stops at its first failure. What a rule costs and
rejects is measured on a bounded sample, and rules run in the order of rejections per
cost; the order changes the time, never a verdict, as a text is kept if no rule fails it.

judged() reports all measures of every text, so only what rules read beyond them is saved;
survivors() computes each measure where a rule asks for it, and no later rule of a text that failed.

Defined cases: a null or empty text has no words, fails the base and is not
kept; repeated rows get the same verdict; an empty table gives no rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, bind, one_of, stage

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rows on which costs and rejections are measured.
SAMPLE_ROWS = 1_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _covered(words: Column, width: int) -> Column:
    """Words that lie in windows of `width` words found at least twice."""

    def by_hash(h: Column) -> Column:
        def by_place(s: Column) -> Column:
            same = lambda x, k: (k > 0) & (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            places = F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
            return bind(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x))

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(placed, by_place))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(bind(hashes, by_hash))


def measures(text: Column, width: int = WINDOW) -> Column:
    """struct(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def whole(w: Column) -> Column:
        return bind(lines, lambda n: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size(n).cast("long").alias("n_lines"),
            (F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("n_dup_lines"), _covered(w, width).cast("long").alias("n_repeat_words"),
        ))

    return bind(words_of(text), whole)


@dataclass(frozen=True)
class Rule:
    """fails(measures, text): true for a text that the rule rejects; never NULL."""

    name: str
    fails: object


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


RULES = (
    Rule("symbols", lambda m, t: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m, t: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule("short_words", lambda m, t: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m, t: m["word_chars"] > 20 * m["n_words"]),
    Rule("few_letters", lambda m, t: 2 * F.regexp_count(t, F.lit(r"\p{L}")) < m["word_chars"]),
    Rule("digits", lambda m, t: 10 * F.regexp_count(t, F.lit("[0-9]")) > 3 * m["word_chars"]),
    Rule("endless_word", lambda m, t: t.rlike(r"[^\x20\x09-\x0D]{1000}")),
)


#: The base as rules, for survivors().
BASE_RULES = (
    Rule("base_words", lambda m, t: m["n_words"] < MIN_WORDS),
    Rule("base_repeats", lambda m, t: 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]),
)
#: How often a rule is evaluated on each row of the sample to tell its cost.
REPEATS = 2


def lazy_measures(text: Column, width: int = WINDOW) -> dict[str, Column]:
    """measures() one by one: what a rule does not read is not computed."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"), "word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"), "n_dup_lines": bind(lines, lambda n: F.size(n) - F.size(F.array_distinct(n))).cast("long"), "n_repeat_words": bind(words_of(text), lambda w: _covered(w, width)).cast("long"),
    }


def ordered(docs: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS, lazy: bool = False) -> list[Rule]:
    """rules by rejections per second on a sample of docs, the best first.

    A rule's cost is the time that one task takes to evaluate it REPEATS times on
    every row, less that of evaluating nothing; a first run that compiles it is not counted.
    """
    total = docs.count()
    if not total:
        return list(rules)
    some = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(fraction=min(1.0, 1.5 * rows / total), seed=6).limit(rows)
    sample = stage((some if lazy else some.withColumn("m", measures(F.col("t")))).coalesce(1), "quality-sample")
    m = lazy_measures(F.col("t")) if lazy else F.col("m")
    fails = [r.fails(m, F.col("t")) for r in rules]
    rejected = sample.agg(*[F.count_if(f).alias(f"r{i}") for i, f in enumerate(fails)]).first()
    many = sample.coalesce(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(test: Column) -> float:
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(test & (F.col("again") > 0))).collect()
        return time.perf_counter() - began

    nothing = seconds(F.length("t") >= 0)
    costs = [max(1e-4, seconds(f) - nothing) for f in fails]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-(rejected[i] + 0.5) / costs[i], i))]


def _cascade(order, m, t: Column) -> Column:
    """The name of the first rule of the order that fails, or NULL; later ones are not evaluated."""
    return reduce(lambda later, r: F.when(r.fails(m, t), F.lit(r.name)).otherwise(later), reversed(order), F.lit(None).cast("string"))


def judged(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, order: list[Rule] | None = None) -> DataFrame:
    """docs with column `quality`: the measures, base_failed, kept and failed (the rule that stopped the row, or null). order: instead of the one measured."""
    m, q = one_of("measures", docs.columns), one_of("quality", docs.columns)
    order = ordered(docs, rules, text, sample_rows) if order is None else order
    t = F.coalesce(F.col(text), F.lit(""))
    base = base_failed(F.col(m))
    failed = F.when(base, F.lit("base")).otherwise(_cascade(order, F.col(m), t))
    both = docs.withColumn(m, measures(F.col(text))).withColumn(q, F.struct(F.col(f"{m}.*"), base.alias("base_failed"), failed.alias("failed")))
    return both.withColumn(q, F.col(q).withField("kept", F.col(q)["failed"].isNull())).drop(m)


def survivors(docs: DataFrame, rules=(*BASE_RULES, *RULES), text: str = "text", sample_rows: int = SAMPLE_ROWS, order: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that judged() keeps, by the cascade alone."""
    order = ordered(docs, rules, text, sample_rows, lazy=True) if order is None else order
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.where(_cascade(order, lazy_measures(t), t).isNull())
