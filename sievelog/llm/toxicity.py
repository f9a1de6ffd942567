"""Toxicity by weak supervision.

Voters are lexicon words and patterns (word beginnings, beginnings that return,
shouting, masked words). Those beyond a short seed list are found on labelled
training rows. A generative label model, fitted by expectation maximization on the votes alone
of labelled and unlabelled rows, explains them by a number of kinds of text: within a
kind voters fire on their own, each with its own probability, so what makes voters move
together (a language, a word and its beginning) is what the kinds tell apart.
Labels only say which kinds are toxic, and how surely; a voter's accuracy and the
posterior label of every row follow. A linear classifier is trained on the posterior
labels and scores whole texts.

The fit uses a bounded sample: of each class, and of the rows without label, the
train_rows rows with the least hash. A voter must fire on one of SUPPORT toxic rows, so
there are at most SUPPORT times as many voters as a text has features. Scores depend on
the text alone.

Defined cases: a null text is empty and scores as one without any voter;
without labels of both classes, or where no kind of text is mostly toxic, only the
seed voters count; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, small_text_batches, stage

#: Labelled rows of each class, and rows without label (None), that a fit uses at most.
TRAIN_ROWS = {1: 4_000, 0: 8_000, None: 4_000}
PREFIXES = (4, 5, 6)
MIN_HITS = 4
#: A voter fires on at least one of so many toxic rows of the sample.
SUPPORT = 250
MIN_LIFT = 6.0
#: Kinds of text with votes that the label model tells apart.
KINDS = 32
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "pathetic", "worthless", "disgusting", "loser", "trash", "bastard", "bitch", "asshole", "fuck", "fucking", "shit", "whore", "slut", "retard", "dumbass", "imbecile")
#: The classifier's weight of a seed voter where there is nothing to learn from.
SEED_WEIGHT, SEED_BIAS = 4.0, -3.0

_LETTERS = re.compile(r"[^\W\d_]+")
_PATTERNS = {
    "masked word": re.compile(r"\b[^\W\d_]+[*@#$%]{2,}[^\W\d_]*"),
    "shouting": re.compile(r"(?:\b[A-Z]{4,}\b\W+){3}"),
    "exclamations": re.compile(r"!{3,}"),
    "threat": re.compile(r"\b(?:kill|hurt|beat|destroy) (?:you|yourself|him|her|them)\b", re.I),
    "address": re.compile(r"\byou (?:are|re) (?:an?|such|so)\b", re.I),
}


def features(text: str | None) -> set[str]:
    """All that may vote in a text: its words, their beginnings (once, and twice or more), and the patterns it shows."""
    words = Counter(_LETTERS.findall((text or "").lower()))
    out = {f"={w}" for w in words}
    for n in PREFIXES:
        begun: Counter = Counter()
        for w, k in words.items():
            if len(w) > n:
                begun[w[:n]] += k
        out.update(f"^{p}" for p in begun)
        out.update(f"2{p}" for p, k in begun.items() if k > 1)
    out.update(f"~{name}" for name, p in _PATTERNS.items() if p.search(text or ""))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def hits(self, text: str | None) -> list[str]:
        """The features of the model that a text has."""
        known, w = self._known, self.weights
        words = Counter(_LETTERS.findall((text or "").lower()))
        out = [f"={x}" for x in words.keys() & known[0]]
        for n in PREFIXES:
            begun: Counter = Counter()
            if known[n]:
                for x, k in words.items():
                    if len(x) > n and x[:n] in known[n]:
                        begun[x[:n]] += k
            for x, k in begun.items():
                out += [f for f in (f"^{x}", f"2{x}" if k > 1 else "") if f in w]
        return out + [f"~{name}" for name, p in _PATTERNS.items() if f"~{name}" in w and p.search(text or "")]

    @cached_property
    def _known(self) -> dict[int, set[str]]:
        """Words (0) and beginnings by their length."""
        out: dict[int, set[str]] = {0: set(), **{n: set() for n in PREFIXES}}
        for f in self.weights:
            if f[0] == "=":
                out[0].add(f[1:])
            elif f[0] in "^2":
                out[len(f) - 1].add(f[1:])
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.hits(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(key: Column, folds: int = 5) -> Column:
    """True for the fold that no fit may learn from."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: dict | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y): the training rows, at most rows[y] of each class and rows[None] without label."""
    fair = lambda df: df.where(F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("key"), *[c for c in ("toxic",) if c in df.columns and df is labels])
    known = fair(labels).groupBy("key").agg(F.max(F.when(F.col("toxic").isin(0, 1), F.col("toxic"))).cast("int").alias("y"))
    bare = fair(docs).distinct().join(known.select("key"), "key", "left_anti").select("key", F.lit(None).cast("int").alias("y"))
    parts = [least_hashed(known.where(F.col("y") == y) if y is not None else bare, n, "toxicity", "key") for y, n in (rows or TRAIN_ROWS).items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), "key")  # bounded by rows: broadcast is safe


def label_model(votes: np.ndarray, y: np.ndarray, kinds: int = KINDS, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, dict]:
    """Posterior probability of class 1 by row of a 0/1 matrix of votes, and the estimates.

    A mixture of kinds of text, the last of them those without votes at the
    start, is fitted to the votes alone. y: 1, 0, or -1 without label; it gives
    the share of toxic rows of each kind and enters nothing else.
    """
    v = np.ascontiguousarray(votes, np.float32)
    n, m = v.shape
    some = np.flatnonzero(v.any(axis=1))
    kinds = max(1, min(kinds, len(some)))
    rng = np.random.default_rng(seed)
    # a start: rows with votes by their direction, rare voters counting more
    far = v[some] * np.log(n / (v.sum(axis=0) + 1)).clip(0.1).astype(np.float32)
    far /= np.linalg.norm(far, axis=1, keepdims=True) + 1e-9
    middle = [far[int(v[some].sum(axis=1).argmax())]] if len(some) else [np.zeros(m, np.float32)]
    near = far @ middle[0]
    while len(middle) < kinds:
        p = (1 - near).clip(1e-9) ** 2
        middle.append(far[rng.choice(len(far), p=p / p.sum())])
        near = np.maximum(near, far @ middle[-1])
    middle = np.stack(middle)
    for _ in range(8):
        of = (far @ middle.T).argmax(axis=1)
        middle = np.stack([far[of == k].sum(axis=0) if (of == k).any() else middle[k] for k in range(kinds)])
        middle /= np.linalg.norm(middle, axis=1, keepdims=True) + 1e-9
    r = np.zeros((n, kinds + 1), np.float32)
    r[:, kinds] = 1
    r[some, kinds] = 0
    r[some, (far @ middle.T).argmax(axis=1)] = 1
    del far
    base = (v.sum(axis=0) + 0.01) / (n + 1)
    for _ in range(rounds):
        mass = r.sum(axis=0, dtype=np.float64)
        fire = np.clip((r.T @ v + 2 * base) / (mass[:, None] + 2), 1e-6, 1 - 1e-4)
        z = np.log((mass + 0.5) / (n + 0.5 * (kinds + 1))) + v @ np.log(fire / (1 - fire)).T.astype(np.float32) + np.log(1 - fire).sum(axis=1)
        new = np.exp(z - z.max(axis=1, keepdims=True))
        new = (new / new.sum(axis=1, keepdims=True)).astype(np.float32)
        moved = np.abs(new - r).max()
        r = new
        if moved < 1e-3:
            break
    told = y >= 0
    prior = float((y[told] == 1).mean()) if told.any() else 0.0
    share = (r[y == 1].sum(axis=0, dtype=np.float64) + 0.5 * prior) / (r[told].sum(axis=0, dtype=np.float64) + 0.5)
    q = np.clip(r.astype(np.float64) @ share, 0, 1)
    fired = v.sum(axis=0, dtype=np.float64)
    return q, {"prior": float(q.mean()), "kinds": share, "fire": fire, "accuracy": (q @ v + prior) / (fired + 1), "agrees": float(((q[told] >= 0.5) == (y[told] == 1)).mean()) if told.any() else 0.0}


def linear(parts: list[tuple[np.ndarray, np.ndarray]], ridge: float = 3e-4, share: float = 1 / 3, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, from parts (rows, labels), by Newton steps that are halved until the loss falls; the bias is not shrunk.

    Rows are weighed as if `share` of them were toxic, so that one sure voter
    is enough and rare classes are not drowned; the ridge grows with their number.
    Raises ArithmeticError where the slope does not vanish: no fit is returned that has not converged.
    """
    y = np.concatenate([q for _, q in parts])
    toxic = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    cut = [(x[at : at + 1000], q[at : at + 1000]) for x, q in parts for at in range(0, len(x), 1000)]  # widened a part at a time
    cut = [(x, q, q * share / toxic + (1 - q) * (1 - share) / (1 - toxic)) for x, q in cut]
    width = parts[0][0].shape[1] + 1
    wide = lambda x: np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    shrink = np.full(width, ridge * len(y))
    shrink[-1] = 1e-6
    loss = lambda w: float(0.5 * (shrink * w * w).sum() + sum((each * (np.logaddexp(0, z) - q * z)).sum() for x, q, each in cut for z in (x.astype(np.float64) @ w[:-1] + w[-1],)))
    w = np.zeros(width)
    w[-1] = np.log(share / (1 - share))
    now, enough = loss(w), 1e-9 * len(y)
    for _ in range(rounds):
        slope, curve = shrink * w, np.diag(shrink + 1e-9)
        for x, q, each in cut:
            x1 = wide(x)
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -500, 500)))
            slope += x1.T @ (each * (p - q))
            curve += (x1 * (each * p * (1 - p))[:, None]).T @ x1
        if np.abs(slope).max() <= enough:
            return w[:-1], float(w[-1])
        step, length = np.linalg.solve(curve, slope), 1.0
        gain = float(slope @ step)
        while (after := loss(w - length * step)) > now - 1e-4 * length * gain and length > 1e-10:
            length /= 2
        if after >= now:  # no better within the precision of numbers
            break
        w, now = w - length * step, after
    if np.abs(slope).max() > 1e-6 * len(y):
        raise ArithmeticError(f"the classifier did not converge: slope {np.abs(slope).max():.3g}")
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, rows: dict | None = None, kinds: int = KINDS, key: str = "doc_id", text: str = "text") -> Model:
    seeds = [f"={w}" for w in SEED_WORDS]
    fallback = Model({f: SEED_WEIGHT for f in seeds}, SEED_BIAS)
    small_text_batches(docs.sparkSession)
    train = stage(sample(docs, labels, rows, key, text), "toxicity-train")
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return fallback

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(pdf["text"], pdf["y"]):
                for f in features(t):
                    seen.setdefault(f, [0, 0])[int(y)] += 1
            yield pd.DataFrame({"feature": list(seen), "clean": [c[0] for c in seen.values()], "toxic": [c[1] for c in seen.values()]}, columns=["feature", "clean", "toxic"])

    counts = train.where("y is not null").mapInPandas(spell, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") + 0.1) / sizes[1] / ((F.col("clean") + 0.5) / sizes[0])
    picked = counts.where((F.col("toxic") >= max(MIN_HITS, sizes[1] / SUPPORT)) & (lift >= MIN_LIFT)).select("feature")
    voters = sorted({r["feature"] for r in picked.collect()} | set(seeds))  # bounded by the sample: see above
    model = Model(dict.fromkeys(voters, 1.0), 0.0)
    kind = docs.schema[key].dataType.simpleString()

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {f: i for i, f in enumerate(voters)}
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "y": pdf["y"].fillna(-1).astype("int32"), "hits": [np.array(sorted(place[f] for f in model.hits(t)), np.int32) for t in pdf["text"]]})

    ballots = train.mapInPandas(vote, f"key {kind}, y int, hits array<int>").orderBy("key", "y", "hits").toPandas()  # a bounded sample
    votes = np.zeros((len(ballots), len(voters)), np.uint8)
    for i, hit in enumerate(ballots["hits"]):
        votes[i, hit] = 1
    # voters that fire on the same rows are one, and share its weight
    alike: dict[bytes, list[int]] = {}
    for j in range(len(voters)):
        alike.setdefault(np.packbits(votes[:, j] > 0).tobytes(), []).append(j)
    alike.pop(bytes(-(-len(ballots) // 8)), None)
    if not alike:
        return fallback
    groups = sorted(alike.values())
    y = ballots["y"].to_numpy(np.int64)
    del ballots
    votes = votes[:, [g[0] for g in groups]].astype(np.float32)
    posterior, found = label_model(votes, y, kinds)
    if not (found["kinds"] > 0.5).any():
        return fallback
    # each voter alone, with its cautious precision by the posterior: one sure voter shall be enough
    yes, no = posterior @ votes, (1 - posterior) @ votes
    weights, bias = linear([(votes, posterior), (np.eye(len(groups), dtype=np.float32), (yes + 0.5) / (yes + no + 4))])
    return Model({f: SEED_WEIGHT for f in seeds} | {voters[j]: float(w) / len(g) for g, w in zip(groups, weights) for j in g}, bias)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """(key, score) for every row of docs."""
    small_text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf["key"].astype("Int64") if kind == "bigint" else pdf["key"]
            yield pd.DataFrame({"key": keys, "score": [model.score(t) for t in pdf["text"]]})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, score double").withColumnsRenamed({"key": key, "score": score})


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs whose score is below the threshold, with all their columns; the texts do not leave their task."""
    small_text_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return t.map(model.score).astype("float64")

    return docs.where(score(F.col(text)) < threshold)
