"""The pipeline's near-duplicate stage against brute force: five-word shingles, Jaccard similarity of 0.8 or more."""

import re

import numpy as np
import pytest

from sievelog.llm import similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles_plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_plain(rows):
    sets, root = [shingles_plain(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (key is None, key or 0))
    return sorted(least.values())


def families():
    """Texts with changed words: similarities on both sides of 0.8, chains, and one family beyond a tile."""
    rng = np.random.default_rng(5)
    rows = []
    for size, changes in ((12, 6), (12, 4), (6, 12), (40, 3), *[(3, 5)] * 6):
        base = [f"w{x}" for x in rng.integers(0, 5000, 250)]
        for _ in range(size):
            words = list(base)
            for at in rng.integers(0, 250, rng.integers(0, changes + 1)):
                words[at] = f"new{rng.integers(0, 10**6)}"
            rows.append(" ".join(words))
    base = [f"v{x}" for x in rng.integers(0, 5000, 300)]
    for _ in range(30):  # a family whose members are linked to few others: about 0.8 to the base, less among themselves
        words = list(base)
        for at in rng.choice(300, int(rng.integers(4, 8)), replace=False):
            words[at] = f"other{rng.integers(0, 10**6)}"
        rows.append(" ".join(words))
    rows += [rows[0], rows[0].upper(), "one two three four", "One two three  four", "one two three", "", None, " \n"]
    keys = [int(k) for k in rng.permutation(len(rows))]
    return [(None if k == 0 else k, t, "en", "s", 1) for k, t in zip(keys, rows)]


@pytest.mark.parametrize("tile", [3, 2048])
def test_one_of_each_family_stays(spark, tile):
    rows = families()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    keep = lambda df: simhash.keep_one(df, shingle=5, similarity=0.8, tile=tile)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in keep(docs).collect())
    assert got == kept_plain(rows) and keep(docs.limit(0)).count() == 0


def test_wide_fingerprints_meet_and_stay_within_the_radius():
    rng = np.random.default_rng(6)
    radius, far = similar.radius_of(0.8), []
    for n in (4, 9, 20, 100, 1000):
        for _ in range(60):
            common, own = int(np.ceil(8 * n / 9)), n - int(np.ceil(8 * n / 9))
            both = rng.integers(0, 2**63, common, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, own, dtype=np.uint64)])) for _ in range(2))
            far.append(int(np.bitwise_count(similar.fingerprint(a) ^ similar.fingerprint(b)).sum()))
    assert max(far) <= radius
    fps = rng.integers(0, 2**63, (300, similar.WORDS), dtype=np.uint64)
    for i in range(100, 200):  # neighbours at 0 to 99 bits
        fps[i] = fps[i - 100]
        for k in rng.choice(64 * similar.WORDS, i - 100, replace=False):
            fps[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    group = np.sort(rng.integers(0, 3, 300))
    stored, asks = rng.random(300) < 0.8, rng.random(300) < 0.5
    got = {(int(i), int(j)) for a, b in simhash.meeting(group, fps, stored, asks, radius) for i, j in zip(a, b)}
    near = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= radius
    assert got == {(i, j) for i in range(300) for j in range(300) if asks[i] and stored[j] and group[i] == group[j] and near(i, j)}


def test_sets_of_a_family_are_compared_exactly():
    rng = np.random.default_rng(7)
    from fractions import Fraction

    sets = [np.unique(np.concatenate([np.arange(60), rng.integers(0, 2000, int(k))])) for k in rng.integers(0, 30, 50)] + [np.zeros(0, np.int64)]
    for second in (np.zeros(51, bool), np.arange(51) > 25):
        i, j = similar.alike(sets, second, Fraction(4, 5))
        want = {(a, b) for a in range(51) for b in range(51) if a != b and (not second.any() or (not second[a] and second[b])) and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
        assert {(int(a), int(b)) for a, b in zip(i, j)} == want


def test_other_similarities_are_refused(spark):
    with pytest.raises(ValueError, match="0.8"):
        simhash.keep_one(spark.createDataFrame([], SCHEMA), similarity=0.5)


def test_the_stage_drops_copies_of_similarity_081(spark):
    cp = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (2, 547, 989, 7711)")
    assert sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, sf).collect()) == [2, 989]
