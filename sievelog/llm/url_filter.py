"""URL filters: listed rules first, gradient-boosted trees on lexical features for the rest.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest wins. Other URLs get the verdict of a boosted ensemble trained on
labelled URLs (by default those that a rule decides). Features are lengths,
depth, digit ratio, entropy, parameter counts, marks, and statistics of the
suffix (the last label of the host) among the labels of the sample, without the row's
own when it is learnt from. Trees are grown on the driver from a bounded sample and
scored in vectorized batches.

Defined cases: a null URL, or one without "://", has an empty host and path,
fits no rule and is judged by its features; repeated URLs get one verdict; with
labels of one kind only, that is the verdict; without labels all is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, one_of, stage

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs that a fit uses at most, those with the least hash.
TRAIN_ROWS = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "hyphens", "fragment", "secure", "longest_part", "vowel_ratio", "suffix_seen", "suffix_blocked")
_ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, in ASCII lower case; "" without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or NULL. Rules are few: they are tested in order of length."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def lexical(url: str | None, host: str, path: str, suffixes: dict[str, tuple[float, float]]) -> list[float]:
    url = url or ""
    digits = sum(c.isdigit() for c in url)
    query = url.partition("?")[2].partition("#")[0]
    seen, blocked = suffixes.get(host.rpartition(".")[2], (0.0, 0.5))
    parts = host.split(".")
    return [
        len(url), len(host), len(path), path.count("/"), len(parts), digits / max(1, len(url)), sum(c.isdigit() for c in host), _entropy(url), _entropy(host),
        query.count("&") + bool(query), len(query), host.count("-"), "#" in url, url[:6].lower() == "https:", max(map(len, parts)), sum(c in "aeiou" for c in host) / max(1, len(host)), seen, blocked,
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees of fixed depth in arrays: tree t splits node k on feature[t, k] at cut[t, k]; leaf holds the values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order gains on binned features."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(n, base), 2**depth - 1
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for k in range(inner):
            inside = np.flatnonzero(node == k)
            best = 1e-6
            gt, ht = g[inside].sum(), h[inside].sum()
            for j in range(m if len(inside) else 0):
                gl = np.cumsum(np.bincount(binned[inside, j], g[inside], bins + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[inside, j], h[inside], bins + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hl >= least / 10) & (ht - hl >= least / 10), gain, -1)[: len(edges[j])]
                if len(gain) and gain.max() > best:
                    best, f[k], c[k] = gain.max(), j, edges[j][int(gain.argmax())]
            node[inside] = 2 * k + 1 + (x[inside, f[k]] > c[k])
        place = node - inner
        value = -rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + ridge)
        margin += value[place]
        features.append(f)
        cuts.append(c)
        leaves.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), base)


@dataclass(frozen=True)
class Model:
    trees: Trees
    suffixes: dict[str, tuple[float, float]]

    def blocked(self, urls, hosts, paths) -> np.ndarray:
        if not len(urls):
            return np.zeros(0)
        x = np.array([lexical(*z, self.suffixes) for z in zip(urls, hosts, paths)], np.float64)
        return 1 / (1 + np.exp(-self.trees.margin(x)))


def _suffix(host: str) -> str:
    return host.rpartition(".")[2]


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of labelled(url, host, path, y: 1 to block), learnt from the `rows` different ones of least hash; None without labels."""
    sample = least_hashed(stage(labelled.select("url", "host", "path", "y").distinct(), "url-labels"), rows, "url", "url", "y").collect()
    if not sample:
        return None
    y = np.array([r["y"] for r in sample], np.float64)
    counts: dict[str, list[float]] = {}
    for r in sample:
        c = counts.setdefault(_suffix(r["host"]), [0, 0])
        c[0] += 1
        c[1] += r["y"]
    told = lambda n, b: (float(np.log1p(n)), (b + 1) / (n + 2))
    suffixes = {s: told(*c) for s, c in counts.items()}
    if y.min() == y.max():
        none = np.zeros((0, 1))
        return Model(Trees(none, none, none, 20.0 if y[0] else -20.0), suffixes)
    x = np.array([lexical(r["url"], r["host"], r["path"], {s: told(counts[s][0] - 1, counts[s][1] - r["y"])} if counts[s := _suffix(r["host"])][0] > 1 else {}) for r in sample], np.float64)
    return Model(boost(x, y), suffixes)


def judged(pages: DataFrame, *, rules=RULES, labelled: DataFrame | None = None, url: str = "url", rows: int = TRAIN_ROWS, name: str = "judged") -> DataFrame:
    """pages with a column `name` (with _ where pages has one so named): struct(host, path, rule, score, verdict), score being the model's, to block.

    labelled: (url, y) to learn from instead of the rules' own decisions.
    """
    struct = lambda u: F.struct(host_of(u).alias("host"), path_of(u).alias("path"))
    if labelled is None:
        held = pages.select(F.col(url).alias("url"), struct(F.col(url)).alias("p")).withColumn("r", rule_of(F.col("p.host"), F.col("p.path"), rules)).where("r is not null")
        train = held.select("url", "p.*", (F.col("r.verdict") == "block").cast("int").alias("y"))
    else:
        train = labelled.select("url", struct(F.col("url")).alias("p"), "y").where("y is not null").select("url", "p.*", "y")
    model = fit(train, rows)

    @F.pandas_udf("double")
    def score(u: pd.Series, h: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(model.blocked(u.tolist(), h.tolist(), p.tolist()))

    out = one_of(name, pages.columns)
    parts, rule, s = (one_of(n, [*pages.columns, out]) for n in ("url_parts", "url_rule", "url_score"))
    got = pages.withColumn(parts, struct(F.col(url))).withColumn(rule, rule_of(F.col(f"{parts}.host"), F.col(f"{parts}.path"), rules))
    got = got.withColumn(s, score(F.col(url), F.col(f"{parts}.host"), F.col(f"{parts}.path")) if model else F.lit(0.0))
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(s) >= 0.5, "block").otherwise("allow"))
    return got.select(*pages.columns, F.struct(F.col(f"{parts}.host").alias("host"), F.col(f"{parts}.path").alias("path"), F.col(f"{rule}.rule").alias("rule"), F.col(s).alias("score"), verdict.alias("verdict")).alias(out))
