"""The queries op1 to op10 over whole tables, and their SQL where SQL can tell them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, table


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import deduplicated

    got = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return got.select("doc_id", F.size("removed_spans").cast("long").alias("n_removed"), spans.alias("removed"), "text")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    got = nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.score")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    q = judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, listed, with_spans

    held = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "found")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return held.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("found"), BASE), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import default_vocabulary

    packed = pack_documents(table(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.json"))
    return packed.withColumnRenamed("key", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, scored

    docs = table(spark, sf_dir, "documents")
    got = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files
    from .tokens import default_vocabulary

    path = new_dir(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, default_vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.checked(token_files.read(spark, path)).withColumnRenamed("key", "doc_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import as_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 reads of a URL and decides by rule alone."""
    from .url_filter import host_of, path_of, rule_of

    parts = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("r", rule_of(F.col("host"), F.col("path"))).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("verdict"))


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op5."""
    from .mixing import targets, words

    sizes = table(spark, sf_dir, "documents").select("source", words(F.col("text")).alias("size"))
    return targets(sizes).select("source", "source_size", F.col("n_units").alias("documents"), F.round("target", 6).alias("target"))


def llm_pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op7."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith(("op", "llm_")) and callable(f)}


_URL_SQL = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select *, case when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/en/') then 'example.net/en/' when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/de/') then 'example.com/de/'
  when (host = 'org' or suffix(host, '.org')) and prefix(path, '/fr/') then 'org/fr/' when (host = 'net' or suffix(host, '.net')) and prefix(path, '/') then 'net/' end as rule from p)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end as verdict from f
"""

_MIX_SQL = r"""
with s as (select source, cast(sum(coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0)) as bigint) as source_size, count(*) as documents from documents group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight from s),
r as (select *, 3.0 * source_size as most, 3.0 * source_size / weight as ratio, sum(source_size) over () as total from w),
l as (select *, (total - coalesce(sum(most) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
e as (select min_by(level, ratio) as level from l where level <= ratio)
select source, source_size, documents, round(least(most, coalesce(e.level, 'inf'::double) * weight), 6) as target from l, e
"""

_PII_SQL = r"""
with t as (select doc_id, row_number() over () as row_no, coalesce(text, '') as t from documents),
m as (select *, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as emails, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ips,
  list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as cards, list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as phones from t)
select doc_id, len(emails) as n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: strlen(ltrim(p, '0')) > 3 or coalesce(try_cast(right(p, 3) as int), 0) > 255)) = 0)) as n_ip,
  len(list_filter(cards, lambda d: strlen(d) between 16 and 19 and list_sum(list_transform(range(1, strlen(d) + 1), lambda i: case when i % 2 = 0 then case when 2 * cast(substr(d, strlen(d) - i + 1, 1) as int) > 9 then 2 * cast(substr(d, strlen(d) - i + 1, 1) as int) - 9
    else 2 * cast(substr(d, strlen(d) - i + 1, 1) as int) end else cast(substr(d, strlen(d) - i + 1, 1) as int) end)) % 10 = 0)) as n_card,
  len(list_filter(phones, lambda d: strlen(d) between 8 and 15)) as n_phone
from m
"""

_QUALITY_SQL = r"""
with t as (select doc_id, coalesce(text, '') as t, row_number() over () as row_no from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
grams as (select row_no, i, array_to_string(ws[i:i + 4], ' ') as g from (select row_no, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
twice as (select row_no, i from (select *, count(*) over (partition by row_no, g) as n from grams) where n > 1),
covered as (select row_no, count(distinct i + k) as n from twice, (select unnest(range(5)) as k) group by row_no),
m as (select w.row_no, doc_id, t, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from w left join covered c using (row_no)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 2 * len(regexp_extract_all(t, '\pL')) < word_chars or 10 * len(regexp_extract_all(t, '[0-9]')) > 3 * word_chars or regexp_matches(t, '[^\x20\x09-\x0D]{1000}')) as kept
from f
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_cascade": _QUALITY_SQL, "llm_url_rules": _URL_SQL, "llm_mix_targets": _MIX_SQL, "llm_pii_base": _PII_SQL}
