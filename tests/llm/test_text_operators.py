"""Operators on texts against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievelog.llm import mixing, pii, quality, simhash, spans, toxicity

WORDS = "the quick brown fox jumps over a lazy dog while seven green birds sing about rivers mountains and old stone bridges near quiet villages".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def sentences_of(seed, n):
    return " ".join(f"{prose((seed, i), 7).capitalize()} {seed}x{i}." for i in range(n))


def corpus():
    rows = [(i, sentences_of(i, 6), "en", f"s{i % 4}", 1) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s0", 1), (101, rows[3][1] + " tail", "en", None, 1), (102, None, "en", "s1", 1), (103, "", None, "s1", 1), (None, "no key here", "en", "s2", 1), (None, None, None, None, None)]
    rows += [(104, sentences_of(104, 400), "en", "s2", 1), (105, "x" * 5000, "en", "s3", 1), (3, rows[3][1], "en", "s3", 1), (3, rows[3][1], "en", "s3", 1), (106, "é ñ\tß\nA\x0bB", "fr", "s3", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """df with columns by the names that operators use inside."""
    names = ["key", "fp", "text_hash", "measures", "quality_", "uid", "copies", "doc_hash", "pii_spans", "hash_of_text", "number_of_row", "stays_key", "r", "loser_key", "loser_hash", "base_spans", "more_spans", "pii_cover", "judged", "mix_uid", "mix_source", "mix_source_", "mix_copies", "mix_own", "removed_spans", "order_", "first", "component", "root"]
    return df.withColumns({n: F.lit(1) for n in names})


def fp_plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_plain(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_components(docs):
    got = [r for r in simhash.near_duplicates(docs, tile=3).collect()]
    rows = corpus()
    fps = [fp_plain(t) for _, t, *_ in rows]
    of = classes_plain(fps)
    least = {}
    for (k, *_), c in zip(rows, of):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    want = collections.Counter((k, f, least.get(c)) for (k, *_), f, c in zip(rows, fps, of))
    assert collections.Counter((r["key"], r["fp"] & (2**64 - 1), r["component"]) for r in got) == want


def test_bit_sliced_links_lose_nothing():
    rng = np.random.default_rng(1)
    fps = []
    for base in rng.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(rng.integers(1, 80)):
            x = int(base)
            for k in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(k)
            fps.append(x)
    fps = np.array(fps, np.uint64)
    group = np.sort(rng.integers(0, 4, len(fps)))
    a, b = simhash.linked(group, fps, np.zeros(len(fps), bool))
    got = simhash._roots(len(fps), a, b)
    for g in range(4):
        at = np.flatnonzero(group == g)
        want = classes_plain([int(x) for x in fps[at]])
        assert [int(x) - at[0] for x in got[at]] == want


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_distances_by_counters(radius):
    rng = np.random.default_rng(radius)
    stored = rng.integers(0, 2**16, 64, dtype=np.uint64)
    query = rng.integers(0, 2**16, 5, dtype=np.uint64)
    item, alive = simhash.near(query, simhash.planes(stored), np.arange(5), np.zeros(5, np.int64), np.full(5, 2**64 - 1, np.uint64), radius)
    got = {int(i): int(x) for i, x in zip(item, alive)}
    for i in range(5):
        assert got.get(i, 0) == sum(1 << k for k in range(64) if bin(int(query[i]) ^ int(stored[k])).count("1") <= radius)


def test_one_of_each_component_stays(docs, empty):
    kept = simhash.keep_one(clashing(docs))
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[3] == 1 and 100 not in ids and all(ids[i] == 1 for i in range(30)) and ids[102] + ids[103] + ids[None] >= 2
    assert kept.columns == clashing(docs).columns and simhash.keep_one(empty).count() == 0


def spans_plain(rows):
    seen, out = {}, collections.defaultdict(list)
    order = sorted({(k is None, k or 0, t or "") for k, t in rows})
    for none, k, t in order:
        for h, a, b in spans.runs(t):
            first = seen.setdefault(h, ((none, k, t), a))
            if first != ((none, k, t), a):
                out[none, k, t].append((a, b))
    cut = {}
    for doc, found in out.items():
        text, at = "", 0
        for a, b in found:
            text += doc[2][at : max(a, at)]
            at = max(b, at)
        cut[doc] = text + doc[2][at:]
    return cut


def test_sentence_spans(spark, docs, empty):
    passage = sentences_of(999, 8)
    rows = corpus() + [(200 + i, f"Start {i} here now. {passage} End of {i}.", "en", "s", 1) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collections.Counter((r["doc_id"], r["text"]) for r in spans.deduplicated(df).collect())
    cut = spans_plain([(k, t) for k, t, *_ in rows])
    want = collections.Counter((k, cut.get((k is None, k or 0, t or ""), t)) for k, t, *_ in rows)
    assert got == want
    texts = {r["doc_id"]: r["text"] for r in spans.deduplicated(df).collect()}
    assert passage in texts[200] and all("999x4" not in texts[200 + i] and f"End of {i}." in texts[200 + i] for i in range(1, 5))
    assert spans.deduplicated(empty).count() == 0 and set(docs.columns) < set(spans.deduplicated(clashing(docs)).columns)


def test_long_sentences_have_runs():
    text = " ".join(f"w{i}" for i in range(100))
    assert len(spans.runs(text)) == 5 and spans.runs("One. Two. Three.") == [] and spans.runs(None) == []


def measures_plain(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(spark, empty):
    texts = [t for _, t, *_ in corpus()] + ["a b c d e " * 40, "line one is here now\nline one is here now\n\n \nother", "##% $ & | < > * x" * 3, "a b c d e a b c d e f", "\x85   x y", "😀 😀😀 a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    got = quality.judged(df, sample_rows=50).select("doc_id", "quality", "quality_.*" if "quality_" in quality.judged(df, sample_rows=50).columns else "quality.*").orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        m = measures_plain(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m, t
        assert r["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (r["failed"] is None)
    assert quality.judged(empty).count() == 0


def test_order_of_rules_changes_no_verdict(spark, docs, empty):
    texts = ["##% $ & | < > * x a b c d e f", "1 2 3 4 5 6 7 8 9 10 11 12", "x" * 1200 + " a b c d e f g h i", "line here\n" * 12, "a b c d e f g h i j k", "! ! ! ! ! ! ! ! ! ! !"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    verdict = lambda order: collections.Counter(map(tuple, quality.judged(df, order=order).select("doc_id", "quality.kept").collect()))
    rules = list(quality.RULES)
    want = verdict(rules)
    assert len({k for _, k in want}) == 2
    for k in (2, 5):
        assert verdict(rules[k:] + rules[:k]) == verdict(rules[::-1]) == want
    kept = collections.Counter({i: n for (i, k), n in want.items() if k})
    every = [*quality.BASE_RULES, *rules]
    for order in (None, every, every[::-1]):
        assert collections.Counter(r["doc_id"] for r in quality.survivors(df, order=order).collect()) == kept
    assert {r.name for r in quality.ordered(df)} == {r.name for r in rules} and quality.survivors(empty).count() == 0


def base_plain(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(m[0]) if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


PII = [
    "a@b.c_d@e.f x@y.z.w. 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "é😀 4532-0151-1283-0366, 4111 1111 1111 1111 x", "+1 (23) 456-789x +12345678 +1-2-3", None, "", "@@ a@b a@b.", "1" * 4000, "a" * 20000 + "@", "1 " * 3000,
    "4111111111111111 4111111111111112", "mail me: joe.x+y@mail-3.example.com, or 10.0.0.1", "1.1.1.1.1 256.1.1.1", "....1.2.3.4....",
]


def test_pii_base_spans(spark, empty):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)], "doc_id long, text string")
    got = pii.with_spans(df, "s").select("doc_id", pii.listed(F.col("s"), pii.BASE).alias("x"), F.sha2(pii.listed(F.col("s"), pii.BASE), 256).alias("h")).orderBy("doc_id").collect()
    for r, t in zip(got, PII):
        want = base_plain(t or "")
        assert r["x"] == want and r["h"] == hashlib.sha256(want.encode()).hexdigest()
    assert pii.redacted(empty).count() == 0


def test_pii_of_one_text_takes_time_in_proportion(spark):
    """Many matches in one text: numbers that fail, spans that stay, and candidates of the method beside base spans."""
    import time

    def took(text, want):
        began = time.perf_counter()
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        rows = pii.redacted(pii.with_spans(df, "s")).select(F.size("s").alias("n"), F.length("text").alias("length"), F.get("s", F.size("s") - 1)["end"].alias("last")).collect()
        assert rows[0]["n"] == want and (not want or rows[0]["last"] <= len(text))
        return time.perf_counter() - began

    unit = "tel 212 555 1234, x@y.zz 1.2.3.4; "
    n = 200_000 // len(unit)
    small, large = took(unit * n, 3 * n), took(unit * 4 * n, 12 * n)
    assert large < 5 * small + 2, (small, large)
    assert took("12, " * 400_000, 0) < 60


def test_pii_among_other_digits(spark):
    texts = ["7536784127813050 4111111111111111", "+44 20 7946 0958 10.0.0.1", "4111111111111111", "9" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r["x"] for r in pii.with_spans(df, "s").orderBy("doc_id").select(pii.listed(F.col("s")).alias("x")).collect()]
    assert got == ["card_among:0:16,card_among:17:33", "ip:17:25,phone_among:0:16", "card:0:16", ""]


def test_scans_merges_and_cuts_against_loops(spark):
    from sievelog.llm.common import cut, merged, running

    rng = np.random.default_rng(8)
    rows = []
    for n in (0, 1, 255, 256, 257, 512, 513, 2000):
        text = "".join(rng.choice(list("aé😀b "), 3 * n + 5))
        rows.append((n, text, [(int(a), int(a) + int(rng.integers(1, 9))) for a in rng.integers(0, max(1, 3 * n - 5), n)]))
    df = spark.createDataFrame(rows, "n int, text string, s array<struct<start:int,end:int>>")
    scan = running(F.transform("s", lambda x: x["end"]), "int", lambda a, x: a + x, 0)
    out = df.select("n", scan.alias("scan"), merged(F.col("s")).alias("m"), cut(F.col("text"), merged(F.col("s")), "#").alias("cut")).orderBy("n").collect()
    for r, (n, text, s) in zip(out, rows):
        assert r["scan"] == np.cumsum([0, *[b for _, b in s]])[: len(s)].tolist()
        islands = []
        for a, b in sorted(s):
            if islands and a <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], b)
            else:
                islands.append([a, b])
        assert [[x["start"], x["end"]] for x in r["m"]] == islands
        want, at = "", 0
        for a, b in islands:
            want, at = want + text[at:a] + "#", b
        assert r["cut"] == want + text[at:]


def test_pii_checksums_context_and_redaction(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "part 123-45-6789", "call 212 555 1234 now", "item 212 555 1234", "é a@b.cd, 1.2.3.4!"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, pii_spans string")
    out = [r["text"] for r in pii.redacted(df).orderBy("doc_id").collect()]
    assert out == ["IBAN <pii> ok", texts[1], "ssn <pii>", texts[3], "call <pii> now", texts[5], "é <pii>, <pii>!"]


def targets_plain(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    t, capped, total = {}, set(), sum(sizes.values())
    while True:
        rest, mass = total - sum(3 * sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else rest * w[s] / mass for s in order}
        over = {s for s in order if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mix_targets_and_totals(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows = [(i, prose(i, int(rng.integers(1, 60))), "en", ["a", "b", "c", "d", None][min(4, i % 9)], 1) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, chunk=64, fan_in=4).collect()
    again = mixing.mix(df.repartition(5), chunk=64, fan_in=4).collect()
    key = lambda r: (r["key"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == 900
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = targets_plain(sizes)
    taken = collections.Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    assert mixing.mix(empty).count() == 0
    odd = mixing.mix(clashing(docs)).collect()
    assert len(odd) == len(corpus()) and all(r["taken"] == 0 for r in odd if r["size"] == 0)


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, prose(i, 20), "en", "a" if i < 5 else "b", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r["key"]: r["copies"] for r in mixing.mix(df).collect()}
    out = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(clashing(df)).collect())
    assert out == collections.Counter({k: n for k, n in taken.items() if n})


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = rng.choice(WORDS, 40).tolist()
        if toxic:
            for w in rng.choice(["grubwort", "grubling", "snarkel", "idiot"], 3):
                words.insert(int(rng.integers(0, 40)), w + ("" if w != "grubling" else rng.choice(["x", "y", "z"])))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled, docs, empty):
    df, labels = labelled
    model = toxicity.fit(df, labels)
    got = toxicity.scored(df, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").where("out").collect()
    assert len(got) > 60 and np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in got]) >= 0.97
    odd = toxicity.scored(docs, model).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.without_toxic(clashing(docs), model).count() == len(corpus())
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none.score("what an idiot you are, moron") >= 0.5 > none.score("a fine day") and none.score(None) < 0.5
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0


def test_labels_of_the_held_out_fold_are_not_used(spark, labelled):
    df, labels = labelled
    out = toxicity.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(df, labels).weights == toxicity.fit(df, flipped).weights


def test_label_model_tells_kinds_apart_from_votes_alone():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.3).astype(int)
    kind = rng.random(4000) < 0.5  # two languages with insults of their own, and a chatty kind of clean text
    fires = lambda p: rng.random(4000) < p
    votes = np.stack([fires(np.where((y == 1) & (kind == (j < 3)), 0.7, 0.02)) for j in range(6)] + [fires(np.where((y == 0) & kind, 0.6, 0.02)) for _ in range(3)], axis=1)
    told = np.where(rng.random(4000) < 0.25, y, -1)
    q, found = toxicity.label_model(votes.astype(np.float32), told, kinds=6)
    assert np.mean((q > 0.5) == y) > 0.9 and abs(found["prior"] - 0.3) < 0.05 and found["agrees"] > 0.9
    true = (y @ votes) / votes.sum(axis=0)
    assert np.abs(found["accuracy"] - true).max() < 0.15


def test_linear_converges_or_raises():
    rng = np.random.default_rng(3)
    x = (rng.random((3000, 300)) < 0.05).astype(np.float32)
    y = np.clip(x[:, 0] + x[:, 1] * 0.9, 0.001, 0.999)  # nearly separable, with voters that repeat
    x[:, 2] = x[:, 0]
    w, b = toxicity.linear([(x, y), (np.eye(300, dtype=np.float32), np.full(300, 0.5))])
    assert np.abs(w).max() < 50 and w[0] > 1 and abs(w[0] - w[2]) < 1e-6 and np.isfinite(b)
    with pytest.raises(ArithmeticError):
        toxicity.linear([(x, y)], rounds=1)


def test_toxicity_of_several_copies(spark):
    """Rows of five copies of a table under shifted ids: more rows than the sample takes, and voters that repeat."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    shift = lambda df, i: df.withColumn("doc_id", F.col("doc_id") + i * 10_000_000)
    many, told = docs, labels
    for i in range(1, 5):
        many, told = many.unionByName(shift(docs, i)), told.unionByName(shift(labels, i))
    model = toxicity.fit(many, told)
    assert max(map(abs, model.weights.values())) < 50 and -10 < model.bias < 0 and model.score(None) < 0.5
    got = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("called")).collect()
    called = {r["toxic"]: r["called"] for r in got}
    assert called[0] <= 0.02 and called[1] >= 0.85
