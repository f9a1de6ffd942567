"""Neighbours, URL filter, packing, token files and the pipeline against brute force and round trips."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelog.llm import neighbours, packing, token_files, url_filter
from sievelog.llm.tokens import Encoder, default_vocabulary

BYTE, WORD = default_vocabulary("byte_bpe_50k.json"), default_vocabulary("word_bpe_49k.json")
TEXTS = [
    "Hello world, this is text.", "", None, " lead and  double", "tab\tand\nline\n\nbreaks  ", "don't STOP... it's 2024!", "İstanbul Σίσυφος éà naïve", "<|endoftext|> and a<|startoftext|>b", "   ", "x" * 3000,
    " ".join(f"word{i % 97}," for i in range(5000)), "日本語 テキスト", "e\u0301 a\u00a0b \x85c", "a . b , c", "trailing ", "Same Same same SAME",
]


def ids_plain(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path, joins", [(BYTE, True), (WORD, False)])
def test_encoder_gives_the_ids_of_whole_texts(path, joins):
    enc = Encoder(path, joins)
    for _ in range(2):  # the second time from what is kept
        got = enc.encode_all([t or "" for t in TEXTS])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids_plain(path, TEXTS)


def test_encoder_forgets_and_stays_right(monkeypatch):
    from sievelog.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 64)
    for path, joins in ((BYTE, True), (WORD, False)):
        enc = Encoder(path, joins)
        for t in TEXTS * 2:
            assert np.frombuffer(enc.encode(t or ""), "<u4").tolist() == ids_plain(path, [t])[0]
            assert len(enc.new) <= 64


def docs_of(spark, texts):
    return spark.createDataFrame([(i if t is not None else None, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, piece string")


def test_packing(spark):
    texts = [*TEXTS, *TEXTS[:3], *[f"short text {i}" for i in range(200)]]
    got = packing.pack_documents(docs_of(spark, texts), BYTE, context=256).collect()
    want = collections.Counter()
    for i, (t, ids) in enumerate(zip(texts, ids_plain(BYTE, texts))):
        ids = np.array([*ids, 0], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, len(ids)] if len(ids) <= 256 else [0, *range(first, len(ids) + 1, 256)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i if t is not None else None, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r["key"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 256) + 2
    assert packing.pack_documents(docs_of(spark, []), BYTE).count() == 0


def best_fit_plain(lengths, context):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(context - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_as_good_as_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400).tolist()
    slots = packing.plan(collections.Counter(lengths), 64)
    bins, held = collections.defaultdict(list), collections.Counter()
    for length, lo, hi, first, offset in slots:
        held[length] += hi - lo
        for k in range(hi - lo):
            bins[first + k].append((offset, length))
    assert held == collections.Counter(lengths) and len(bins) <= best_fit_plain(lengths, 64) + 1
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64


def test_token_files_round_trip(spark, tmp_path):
    texts = [*TEXTS, *[f"document number {i} of many" for i in range(50)]]
    df = docs_of(spark, texts).unionByName(docs_of(spark, texts).where("doc_id = 0"))
    path = str(tmp_path / "out")
    manifest = token_files.write(df, path, WORD, end_id=2, shard_docs=16)
    got = [(r["key"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_files.read(spark, path).collect()]
    ids = dict(zip(range(len(texts)), ids_plain(WORD, texts)))
    order = sorted([None] * texts.count(None) + [0] + [i for i, t in enumerate(texts) if t is not None], key=lambda k: (k is not None, k or 0))
    assert [k for k, *_ in sorted(got, key=lambda x: x[1])] == order
    at = 0
    for k, start, held in sorted(got, key=lambda x: x[1]):
        assert start == at and held == [*(ids[k] if k is not None else []), 2]
        at += len(held)
    assert len(manifest["shards"]) > 2 and at == sum(s["ids"] for s in manifest["shards"])
    assert token_files.read_document(path, manifest["shards"][0]["name"], 0).tolist() == [2]
    by_start = {start: held for _, start, held in got}
    at = 0
    for shard in manifest["shards"]:
        for place in range(shard["docs"]):
            held = token_files.read_document(path, shard["name"], place).tolist()
            assert held == by_start[at]
            at += len(held)
    with pytest.raises(IndexError):
        token_files.read_document(path, manifest["shards"][0]["name"], manifest["shards"][0]["docs"])
    raw = tmp_path / "out" / manifest["shards"][1]["name"]
    raw.write_bytes(raw.read_bytes()[:-40] + b"\0" * 40)
    with pytest.raises(Exception, match="damaged|unpack"):
        token_files.read(spark, path).collect()


def test_token_files_of_one_key(spark, tmp_path):
    """Rows that all have one key, or none, fill shards of like size."""
    df = spark.createDataFrame([(7 if i % 2 else None, f"text {i % 5}") for i in range(200)], "doc_id long, text string")
    manifest = token_files.write(df, str(tmp_path / "out"), WORD, end_id=2, shard_docs=20)
    assert sum(s["docs"] for s in manifest["shards"]) == 200 and max(s["docs"] for s in manifest["shards"]) <= 60
    assert token_files.read(spark, str(tmp_path / "out")).groupBy("key").count().count() == 2


def test_token_files_of_nothing(spark, tmp_path):
    assert token_files.write(docs_of(spark, []), str(tmp_path / "none"), WORD, end_id=2)["shards"] == []
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def vectors(n=3000, d=24, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, d))
    x = (centre[rng.integers(0, 12, n)] + 0.8 * rng.standard_normal((n, d))).astype(np.float32)
    x[5], x[7] = x[3], x[3]
    return x


def test_neighbours_recall_scores_and_ties(spark):
    x = vectors()
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(9000, None, 1), (9020, [0.0] * 24, 1), (9040, [float("nan")] + [1.0] * 23, 1), (9060, [1.0, 2.0], 1), (9080, [None] + [1.0] * 23, 1), (None, x[0].tolist(), 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, list int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, sample_rows=1000, block_rows=64, chunk_queries=16).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["id"], r["score"]))
    assert set(by) == set(range(0, 3000, 20))
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q, found in by.items():
        assert len(found) == 20 and q not in [i for i, _ in found]
        assert [(-v, i) for i, v in found] == sorted((-v, i) for i, v in found)
        assert max(abs(s[q, i] - v) for i, v in found) < 1e-9
        s[q, q] = -np.inf
        hits += len({i for i, _ in found} & set(np.argsort(-s[q], kind="stable")[:20].tolist()))
    assert hits / 20 / len(by) >= 0.9


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_found_by_lists_alone(spark, monkeypatch, clustered):
    """Recall over many more rows than the sample holds, in clusters and on a sphere without any."""
    monkeypatch.setattr(neighbours, "BOUND_ROWS", 200)
    x = vectors(20_000, 16, seed=2) if clustered else np.random.default_rng(4).standard_normal((20_000, 32)).astype(np.float32)
    x = x if clustered else x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, sample_rows=2000).collect()
    s = x[::100].astype(np.float64) @ x.astype(np.float64).T
    s[np.arange(200), np.arange(0, 20_000, 100)] = -np.inf
    true = [set(np.argsort(-r, kind="stable")[:10].tolist()) for r in s]
    found = collections.defaultdict(set)
    for r in got:
        found[r["query_id"] // 100].add(r["id"])
    assert all(len(v) == 10 for v in found.values()) and len(found) == 200
    assert np.mean([len(found[i] & true[i]) for i in range(200)]) >= 9


def test_neighbours_of_few_rows(spark):
    rows = [(i * 20, [float(i + 1), 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 20 and {r["rank"] for r in got} == {1, 2, 3, 4}
    assert neighbours.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(200)], df.schema)
    first = [r["id"] for r in neighbours.nearest(same, F.col("vec_id") == 40, 5).orderBy("rank").collect()]
    assert first == [0, 1, 2, 3, 4]


URLS = [None, "", "no scheme", "http://example.net/en/1", "HTTPS://A.Example.NET/de/1?x=1#y", "https://example.com/de/x", "https://xexample.com/de/x", "http://b.example.com/en/", "ftp://fr.org/fr/", "http://x.org#/fr/", "http://h?/a", "://", "http://net", "http://net/", "http://ünï.net/é?q", "http://a.b://c/d", "http://x.org/fr/\n1"]


def judged_plain(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else None


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "h", 5) for i, u in enumerate(URLS)], "page_id long, url string, host string, r int")
    got = url_filter.judged(df)
    assert got.columns == [*df.columns, "judged"] and {r["host"] for r in got.collect()} == {"h"}
    assert "judged_" in url_filter.judged(df.withColumn("judged", F.lit(1)).withColumn("url_parts", F.lit(2))).columns
    for r in got.select("page_id", "judged.*").collect():
        host, path, rule, verdict = judged_plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert url_filter.judged(df.limit(0)).count() == 0
    alone = url_filter.judged(df.where("page_id < 3"))
    assert {r["judged"]["verdict"] for r in alone.collect()} == {"allow"}


def test_url_trees_on_held_out_urls(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        bad = i % 2
        host = f"{'win' if bad else 'news'}{'-'.join(str(rng.integers(0, 99)) for _ in range(1 + 3 * bad))}.{rng.choice(['com', 'org', 'info'])}"
        rows.append((f"http://{host}/{'a/' * int(rng.integers(0, 3))}{rng.integers(0, 9)}{'?a=1&b=2' if bad and rng.random() < 0.7 else ''}", int(bad)))
    df = spark.createDataFrame(rows, "url string, y int")
    got = url_filter.judged(df.where("url like '%.com%'"), rules=(), labelled=df.where("url not like '%.com%'")).collect()
    assert len(got) > 300 and np.mean([(r["judged"]["verdict"] == "block") == bool(r["y"]) for r in got]) > 0.95


def test_pipeline_stages(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, step in cp.STAGES[:-1]:
        out = cp.stage(step(spark, docs, sf), f"test-{name}")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.dtypes == docs.dtypes, name
        if name in ("toxicity", "simhash_near_dedup"):
            assert 0.5 * before < out.count() <= docs.count()
        docs = out
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 3000, "en", None, 1)], docs.schema)
    # null and empty texts are one component, and a source without words takes nothing: the long text stays, in two pieces
    for docs, pieces in ((odd, 2), (odd.limit(0), 0)):
        for name, step in cp.STAGES:
            docs = cp.stage(step(spark, docs, sf), f"odd-{name}")
        assert docs.count() == pieces


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
