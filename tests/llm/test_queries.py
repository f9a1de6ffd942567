"""Each registered query over one small set of tables with nulls, empty and repeated rows, against plain versions."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from .test_other_operators import BYTE, URLS, WORD, ids_plain, judged_plain
from .test_text_operators import SCHEMA, base_plain, classes_plain, corpus, fp_plain, measures_plain, sentences_of, spans_plain, targets_plain

PASSAGE = sentences_of(999, 8)


def documents():
    rows = corpus() + [(300 + i, f"Start {i} here now. {PASSAGE} End of {i}. Mail a{i}@b.org or +4420794609{i:02d}.", "en", f"s{i % 4}", 1) for i in range(6)]
    return rows + [(400 + i, f"you idiot number {i} are such a worthless moron and {sentences_of(400 + i, 2)}", "en", "s1", 1) for i in range(12)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), SCHEMA).withColumns({"key": F.lit(1), "score": F.lit(2)}).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, int(k >= 400)) for k, *_ in documents() if k is not None and k != 3] + [(1, None, None), (None, 1, 1), (2, 0, 5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string").write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(120)] + [(140, None), (160, [0.0] * 8), (180, [float("nan")] * 8), (None, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, sf, start):
    name = next(n for n in entry.queries() if n.startswith(start))
    return entry.queries()[name](spark, sf).collect()


def test_op1(spark, sf):
    rows = documents()
    fps = [fp_plain(t) for _, t, *_ in rows]
    of, least = classes_plain(fps), {}
    for (k, *_), c in zip(rows, of):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    want = collections.Counter((k, f"{f:016x}", least.get(c)) for (k, *_), f, c in zip(rows, fps, of))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, sf, "op1_")) == want


def test_op2(spark, sf):
    cut = spans_plain([(k, t) for k, t, *_ in documents()])
    got = run(spark, sf, "op2_")
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((k, cut.get((k is None, k or 0, t or ""), t)) for k, t, *_ in documents())
    assert all((r["n_removed"] > 0) == bool(r["removed"]) for r in got) and sum("999x4" in (r["text"] or "") for r in got) == 1


def test_op3(spark, sf):
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["vec_id"] is not None and r["vec_id"] < 120]
    got = collections.defaultdict(list)
    for r in sorted(run(spark, sf, "op3_"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 120, 20))
    for q, found in got.items():
        x = dict(rows)[q]
        best = sorted(((-(x * v).sum(), i) for i, v in rows if i != q))[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda t: (-t[1], t[0]))
        assert len({i for i, _ in found} & {i for _, i in best}) >= 18


def test_op4(spark, sf):
    for r in run(spark, sf, "op4_"):
        host, path, rule, verdict = judged_plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((verdict,) if verdict else ("allow", "block"))


def test_op5(spark, sf):
    sizes = collections.Counter()
    for _, t, _, s, _ in documents():
        sizes[s] += len((t or "").split())
    want, taken = targets_plain(sizes), collections.Counter()
    got = run(spark, sf, "op5_")
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((k, len((t or "").split())) for k, t, *_ in documents())
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    longest = max(len((t or "").split()) for _, t, *_ in documents())
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)


def test_op6_and_op7(spark, sf):
    want = collections.Counter((k, *measures_plain(t)) for k, t, *_ in documents())
    got = run(spark, sf, "op6_")
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    base = [(k, base_plain(t or "")) for k, t, *_ in documents()]
    count = lambda b, kind: b.count(f"{kind}:")
    want = collections.Counter((k, *(count(b, x) for x in ("email", "ip", "card", "phone")), hashlib.sha256(b.encode()).hexdigest()) for k, b in base)
    got = run(spark, sf, "op7_")
    assert collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    by = {k: b for k, b in base}
    assert all(set(by[r["doc_id"]].split(",")) <= {*r["spans"].split(","), ""} for r in got if r["doc_id"] is not None)


def test_op8(spark, sf):
    want, bins = collections.Counter(), collections.defaultdict(list)
    for (k, *_), ids in zip(documents(), ids_plain(BYTE, [t for _, t, *_ in documents()])):
        ids = np.array([*ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = run(spark, sf, "op8_")
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_op9(spark, sf):
    got = run(spark, sf, "op9_")
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0
    assert collections.Counter((r["doc_id"], r["held_out"]) for r in got) == collections.Counter((k, out(k)) for k, *_ in documents())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    called = {r["doc_id"]: r["predicted"] for r in got}
    assert all(called[k] == (k >= 400) for k, *_ in documents() if k is not None)


def test_op10(spark, sf):
    ids = [(k, np.array([*x, 2], "<u4").tobytes()) for (k, *_), x in zip(documents(), ids_plain(WORD, [t for _, t, *_ in documents()]))]
    got = sorted(run(spark, sf, "op10_"), key=lambda r: r["start"])
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((k, len(x) // 4, zlib.crc32(x)) for k, x in ids)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((k is not None, k or 0) for k, _ in ids)


def test_pipeline(spark, sf):
    if "pipeline" not in entry.queries():
        pytest.skip("without the pipeline")
    got = run(spark, sf, "pipeline")
    ids = {r["doc_id"] for r in got}
    assert ids and not ids & set(range(400, 412)) and 100 not in ids and {k for k in range(30)} & ids
    per = collections.Counter(r["sequence_id"] for r in got for _ in range(r["length"]))
    assert max(per.values()) <= 2048
