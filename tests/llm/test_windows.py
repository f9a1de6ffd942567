"""Passages shared by unpunctuated texts that begin otherwise."""

import pytest

from sievelog.llm import spans


def test_a_shared_passage_is_cut_at_every_offset(spark):
    passage = [f"p{i}" for i in range(80)]
    rows = [(k, " ".join([f"a{k}x{i}" for i in range(20 + k)] + passage + [f"z{k}x{i}" for i in range(30)])) for k in range(16)]
    got = {r["doc_id"]: r["text"].split() for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1].split()
    for k, t in rows[1:]:
        assert sum(w in passage for w in got[k]) < 2 * spans.CHOICE and [w for w in got[k] if w not in passage] == [w for w in t.split() if w not in passage]


@pytest.mark.parametrize("lead", range(16))
def test_shared_words_share_a_window(lead):
    shared = " ".join(f"s{i}" for i in range(2 * spans.LONG + spans.CHOICE - 1))
    one, other = (f"{' '.join(f'{c}{i}' for i in range(n))} {shared} {c}end" for c, n in (("a", 7), ("b", lead)))
    assert {h for h, *_ in spans.windows(one)} & {h for h, *_ in spans.windows(other)}
    assert spans.windows("One two. Three four.") == spans.windows(None) == []
