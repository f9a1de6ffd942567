"""The engine's queries over the driver's tables, with independent SQL for each.

`logs` reads the events as log records: user_id is the source, event_type the
container, props the JSON body of three records in four.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.times import stamp_of
from .operators import dedup, enrich, search
from .plans.compiler import predicate, truth
from .schema import shared_dir, source_key
from .sources import cri
from .sources.store import LogStore, as_json
from .streaming.ingest import from_wire, stored

_NS = "case user_id % 3 when 0 then 'prod' when 1 then 'staging' else 'dev' end"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the events table. Names are expressions over few columns, so only the columns that a query needs are read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.col("user_id").cast("string")
    message = F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit(" user="), user)).otherwise(F.col("props"))
    stream = F.when(F.col("event_type") == "error", "stderr").otherwise("stdout")
    rows = e.select(
        "event_id", F.col("ts").alias("_ts"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("_ts_nanos"), F.expr(_NS).alias("_namespace"), F.concat(F.lit("pod-"), user).alias("_pod"),
        F.col("event_type").alias("_container"), F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("_node"), stream.alias("_stream"), message.alias("_message"),
        F.col("user_id").alias("source_key"), (F.col("event_id") + 1).alias("offset"),
        F.create_map(F.lit("tier"), F.when(F.col("user_id") % 2 == 0, "gold").otherwise("basic"), F.lit("app.io/name"), F.col("event_type")).alias("_labels"),
        F.create_map(F.lit("collect"), F.when(F.col("user_id") % 7 == 0, "false").otherwise("true")).alias("_annotations"),
    )
    return rows.withColumn("body", cri.body_of(F.col("_message"), F.col("_stream")))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logs() with a JSON body of numbers, texts, truth values, null, objects and a key that repeats."""
    rows = logs(spark, sf_dir).drop("body")
    n = lambda x: x.cast("string")
    user, event = F.col("source_key"), F.col("event_id")
    text = [
        F.lit('{"user":{"id":'), n(user), F.lit(',"name":"u'), n(user), F.lit('"},"ok":'), F.when(event % 2 == 0, "true").otherwise("false"), F.lit(',"note":null,"tags":{"a.b":"t'), n(event % 10),
        F.lit('"},"code":" '), n(event % 600), F.lit(' ","ratio":'), n(user / 4), F.lit(',"größe":'), n(event % 7), F.lit(',"dup":1,"dup":'), n(event % 3), F.lit("}"),
    ]
    rows = rows.withColumn("_message", F.concat(*text))
    return rows.withColumn("body", cri.body_of(F.col("_message"), F.col("_stream")))


#: The same view for DuckDB.
LOGS = f"""logs as (
  select event_id, ts as _ts, epoch_us(ts) * 1000 as _ts_nanos, {_NS} as _namespace, 'pod-' || user_id::varchar as _pod, event_type as _container,
    'node-' || (user_id % 5)::varchar as _node, case when event_type = 'error' then 'stderr' else 'stdout' end as _stream,
    case when event_id % 4 = 0 then event_type || ' user=' || user_id::varchar else props end as _message, user_id as source_key, event_id + 1 as "offset",
    case when user_id % 2 = 0 then 'gold' else 'basic' end as tier, case when user_id % 7 = 0 then 'false' else 'true' end as collect,
    case when event_id % 4 = 0 then null else cast(props->>'k' as bigint) end as k, value
  from events)"""

START, END = "2024-01-05T00:00:00Z", "2024-01-12T06:30:00Z"
_RANGE = "_ts_nanos >= 1704412800000000000 and _ts_nanos <= 1705041000000000000"

#: name: (search text, the same in SQL)
FILTERS: dict[str, tuple[str, str]] = {
    "eq_envelope": ('_namespace = "prod"', "_namespace = 'prod'"),
    "ne_envelope": ('_container != "error"', "_container is null or _container <> 'error'"),
    "eq_number_body": ("k = 69", "k = 69"),
    "eq_string_of_number": ('k = "69"', "k = 69"),
    "cmp_lt": ("k < 10", "k < 10"),
    "cmp_le": ("k <= 10", "k <= 10"),
    "cmp_gt": ("k > 90", "k > 90"),
    "cmp_ge": ("k >= 90", "k >= 90"),
    "cmp_string_order": ('_container >= "error" and _container < "signup"', "_container >= 'error' and _container < 'signup'"),
    "cmp_bool_order": ("_container > true and not _container < false", "_container > ''"),
    "eq_bool": ("label.tier = true or annotation.collect = false", "collect = 'false'"),
    "regex_match": ("_pod =~ /-1[0-4]$/", "regexp_matches(_pod, '-1[0-4]$')"),
    "regex_not_match": ("_container !~ /^(view|click)$/", "not regexp_matches(_container, '^(view|click)$')"),
    "regex_classes": (r"_message =~ /\buser=[[:digit:]]{2}\b/", r"regexp_matches(_message, '\buser=[[:digit:]]{2}\b')"),
    "contains_text": ('_message : "user=1"', "contains(_message, 'user=1')"),
    "contains_number": ("k : 7", "contains(k::varchar, '7')"),
    "exists_field": ("k", "k is not null"),
    "not_exists": ("not k and not stderr", "k is null and _stream <> 'stderr'"),
    "absent_ne": ('k != "69" and missing != "x"', "k is null or k <> 69"),
    "absent_regex": ("k !~ /9$/", "k is null or not regexp_matches(k::varchar, '9$')"),
    "and_or_not": ('(_namespace="dev" or _container="error") and not _node="node-3"', "(_namespace = 'dev' or _container = 'error') and _node <> 'node-3'"),
    "precedence": ('_namespace="dev" or _namespace="prod" and _container="click"', "_namespace = 'dev' or (_namespace = 'prod' and _container = 'click')"),
    "not_pushdown": ('not (_namespace != "prod" or k > 50)', "_namespace = 'prod' and (k is null or k <= 50)"),
    "label_lookup": ('label.tier="gold" and label["app.io/name"]="view"', "tier = 'gold' and _container = 'view'"),
    "annotation_lookup": ('annotation.collect = "false"', "collect = 'false'"),
    "ts_numeric_cmp": ("_ts >= 1705000000000000000", "_ts_nanos::double >= 1705000000000000000::double"),
    "unknown_envelope": ("_nope != 1 and not _nope", "true"),
    "envelope_tail_ignored": ('_pod.x = "pod-7"', "_pod = 'pod-7'"),
    "text_body": ('stdout : "view" or body.stderr', "(k is null and _stream = 'stdout' and contains(_message, 'view')) or (k is null and _stream = 'stderr')"),
    "time_in_expression": ('_ts < 1704500000000000000 and _container = "error"', "_ts_nanos::double < 1704500000000000000::double and _container = 'error'"),
}
#: The same on records with a body of many kinds: rich().
RICH_FILTERS: dict[str, tuple[str, str]] = {
    "nested_path": ("user.id = 42 or body.user.name = \"u7\"", "user_id in (42, 7)"),
    "quoted_key": ('tags["a.b"] = "t3" and not tags.a', "event_id % 10 = 3"),
    "json_bool": ("ok = true", "event_id % 2 = 0"),
    "json_bool_text": ('ok =~ /^fal/ and ok : "als" and ok = "false" and ok != true', "event_id % 2 = 1"),
    "json_null": ('note = "" and not note and note != "x" and _container = "error"', "_container = 'error'"),
    "text_as_number": ('code >= 500 and code < 510.5 and code != "505"', "event_id % 600 between 500 and 510"),
    "fraction": ("ratio > 12.5 and ratio <= 1.75e1 and not ratio = 13", "user_id > 50 and user_id <= 70 and user_id <> 52"),
    "fraction_text": ('ratio : ".25" or ratio = "3.5"', "user_id % 4 = 1 or user_id = 14"),
    "repeated_keys": ("dup = 2", "event_id % 3 = 2"),
    "object_text": ('user : "\\"u9\\"" and user', "user_id = 9"),
    "keywords_any_case": ('_namespace = "prod" AND NOT ok = TRUE Or _container = "error" aNd ok', "(_namespace = 'prod' and event_id % 2 = 1) or _container = 'error'"),
    "unicode_names": ("größe >= 5", "event_id % 7 >= 5"),
    "string_escapes": ("_container = 'cl\\ick' or _container = \"vi\\ew\"", "_container in ('click', 'view')"),
    "regex_of_string": (r'_pod =~ "-1\\d$" or _pod =~ "pod-\d"', "regexp_matches(_pod, '-1[0-9]$')"),
    "regex_literal_escapes": (r"_message =~ /\"name\":\"u1\d?\"/ and _node !~ /node-[^0-3]/", "user_id in (1, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19) and user_id % 5 < 4"),
    "number_forms": ("user.id >= +5e1 and user.id < 60.0and ratio > -1", "user_id >= 50 and user_id < 60"),
    "all_operators": ('_pod != "pod-1" and _pod !~ /9$/ and _container > "c" and _container >= "click" and _container < "z" and _container <= "view" and _node : "node" and user.id =~ /^[0-4]+$/', "user_id <> 1 and not regexp_matches(_pod, '9$') and _container in ('click', 'error', 'purchase', 'signup', 'view') and regexp_matches(user_id::varchar, '^[0-4]+$')"),
    "white_space": ("\u2003user\u00a0.\tid\n=\u300042 and tags [ \"a.b\" ] : \"t\"", "user_id = 42"),
}
_SHOWN = ["event_id", "_ts_nanos", "_namespace", "_pod", "_container", "_message"]
_SHOWN_SQL = ", ".join(_SHOWN)

found: dict = {}
sql: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def keep(f):
        found[name] = f
        if oracle:
            sql[name] = f"with {LOGS}{oracle if oracle.startswith(",") else " " + oracle}" if " logs" in oracle else oracle
        return f

    return keep


for _name, (_text, _where) in FILTERS.items():
    _query(_name, f"select {_SHOWN_SQL} from logs where {_where}")(lambda spark, d, text=_text: search.matching(logs(spark, d), text).select(*_SHOWN))


for _name, (_text, _where) in RICH_FILTERS.items():
    _query(_name, f"select event_id, _pod, _container from logs, (select event_id as e_, user_id from events) where event_id = e_ and ({_where})")(lambda spark, d, text=_text: search.matching(rich(spark, d), text).select("event_id", "_pod", "_container"))


@_query("match_all", "select count(*) as n from logs")
def match_all(spark, d):
    return search.matching(logs(spark, d), "").agg(F.count("*").alias("n"))


@_query("truth_column", "select _container, coalesce(k >= 50, false) as hit, count(*) as n from logs group by all")
def truth_column(spark, d):
    rows = logs(spark, d)
    return rows.select("_container", truth("k >= 50", rows).alias("hit")).groupBy("_container", "hit").agg(F.count("*").alias("n"))


@_query("contains_documents", "select doc_id from documents where contains(text, 'the') and not contains(text, 'stupid')")
def contains_documents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("text", "_message")
    return docs.where(predicate('_message : "the" and not _message : "stupid"', docs)).select("doc_id")


@_query("regex_pages", r"select page_id from pages where regexp_matches(html, '<title>[A-Z]\w+ \w+')")
def regex_pages(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumnRenamed("html", "_message")
    return pages.where(predicate(r"_message =~ /<title>[A-Z]\w+ \w+/", pages)).select("page_id")


@_query("time_range", f"select {_SHOWN_SQL} from logs where {_RANGE}")
def time_range(spark, d):
    return search.matching(logs(spark, d), "", START, END).select(*_SHOWN)


@_query("order_desc_limit", f"select {_SHOWN_SQL} from logs where _container = 'error' and {_RANGE} order by _ts_nanos desc, source_key desc, \"offset\" desc limit 100")
def order_desc_limit(spark, d):
    return search.search(logs(spark, d), '_container = "error"', START, END, limit=100, descending=True).select(*_SHOWN)


@_query("order_asc_limit", f"select {_SHOWN_SQL} from logs where _namespace = 'prod' order by _ts_nanos, source_key, \"offset\" limit 50")
def order_asc_limit(spark, d):
    return search.search(logs(spark, d), '_namespace = "prod"', limit=50).select(*_SHOWN)


@_query("ordered_search", f"select {_SHOWN_SQL} from logs where _stream = 'stderr' order by _ts_nanos, source_key, \"offset\"")
def ordered_search(spark, d):
    return search.search(logs(spark, d), '_stream = "stderr"').select(*_SHOWN)


_SEALED, _OPEN = "1705000000000000000", "1705000000000000000"


@_query("union_open_buffer", "select _namespace, count(*) as n, max(_ts_nanos) as last from logs group by 1")
def union_open_buffer(spark, d):
    rows = logs(spark, d)
    both = search.with_open(rows.where(F.col("_ts_nanos") < int(_SEALED)), rows.where(F.col("_ts_nanos") >= int(_OPEN)))
    return search.matching(both, "").groupBy("_namespace").agg(F.count("*").alias("n"), F.max("_ts_nanos").alias("last"))


@_query("open_buffer_range", f"select {_SHOWN_SQL} from logs where {_RANGE} and _namespace = 'dev'")
def open_buffer_range(spark, d):
    """A time range over stored and open records."""
    rows = logs(spark, d)
    both = search.with_open(rows.where(F.col("_ts_nanos") < int(_SEALED)), rows.where(F.col("_ts_nanos") >= int(_OPEN)))
    return search.matching(both, '_namespace = "dev"', START, END).select(*_SHOWN)


def _histogram_sql(where: str, start: int, end: int, buckets: int) -> str:
    width = (end - start) // buckets
    return f"""select b.bucket, {start} + b.bucket * {width} as bucket_start, coalesce(c.n, 0) as count
    from (select unnest(range({buckets})) as bucket) b left join (
      select least(greatest((_ts_nanos - {start}) // {width}, 0), {buckets - 1}) as bucket, count(*) as n from logs
      where {where} and _ts_nanos >= {start} and _ts_nanos <= {end} group by 1) c using (bucket)"""


@_query("histogram", _histogram_sql("_container = 'error'", 1704067200000000000, 1706659200000000000, 60))
def histogram(spark, d):
    return search.histogram(logs(spark, d), '_container = "error"', "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z", 60)


@_query("histogram_clamped", _histogram_sql("true", 1704412800000000000, 1705041000000000000, 7))
def histogram_clamped(spark, d):
    return search.histogram(logs(spark, d), "", START, END, 7)


@_query("histogram_total", f"select count(*) as total from logs where k < 50 and {_RANGE}")
def histogram_total(spark, d):
    return search.histogram(logs(spark, d), "k < 50", START, END).agg(F.sum("count").alias("total"))


@_query("field_values", "select distinct * from (select '_namespace' as field, _namespace as value from logs union all select '_pod', _pod from logs union all select '_node', _node from logs union all select '_container', _container from logs)")
def field_values(spark, d):
    return search.field_values(logs(spark, d))


@_query("field_keys", "select distinct * from (select 'label' as field, unnest(['tier', 'app.io/name']) as value union all select 'body', case when k is null then _stream else 'k' end from logs)")
def field_keys(spark, d):
    return search.field_keys(logs(spark, d))


@_query("segment_stats", "select cast(_ts as date) as date, min(_ts_nanos) as min_ts_nanos, max(_ts_nanos) as max_ts_nanos, count(*) as records, count(distinct _pod) as n_pods from logs group by 1")
def segment_stats(spark, d):
    days = search.statistics(logs(spark, d).withColumn("date", F.col("_ts").cast("date")), "date")
    return days.select("date", "min_ts_nanos", "max_ts_nanos", "records", F.size("pods").cast("long").alias("n_pods"))


@_query("source_watermarks", 'select source_key, max("offset") as "offset" from logs group by 1')
def source_watermarks(spark, d):
    return search.watermarks(logs(spark, d))


_BYTES = """64 + strlen(_message) + strlen(_namespace) + strlen(_pod) + strlen(_container) + strlen(_node) + strlen('tier') + strlen(tier) + strlen('app.io/name') + strlen(_container)
    + case when k is null then strlen(_stream) + strlen(_message) + 7 else strlen(k::varchar) + 6 end"""


@_query("buffer_bytes", f"select cast(sum({_BYTES}) as bigint) as bytes from logs")
def buffer_bytes(spark, d):
    return search.size_of(logs(spark, d))


@_query("batch_watermarks", 'select event_id // 1000 as batch, source_key, max("offset") as "offset" from logs group by 1, 2')
def batch_watermarks(spark, d):
    """The highest offset of each source in each batch, and over them."""
    rows = logs(spark, d).withColumn("batch", F.floor(F.col("event_id") / 1000).cast("long"))
    return rows.groupBy("batch", "source_key").agg(F.max("offset").alias("offset"))


@_query("field_sets", """select string_agg(distinct _namespace, ',' order by _namespace) as namespaces, string_agg(distinct _container, ',' order by _container) as containers, 'app.io/name,tier' as labels,
    '_container,_image,_message,_namespace,_node,_pod,_stream,_ts,k,stderr,stdout' as fields from logs""")
def field_sets(spark, d):
    """Sorted distinct names, one row."""
    found = search.fields(logs(spark, d))
    return found.select(*[F.array_join(c, ",").alias(c) for c in ("namespaces", "containers", "labels", "fields")])


@_query("source_keys", "select distinct 'n' || (user_id % 5)::varchar || '|/' || event_type || '|7|' || user_id::varchar || '|0' as source_key from events")
def source_keys(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    node, path = F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")), F.concat(F.lit("/"), "event_type")
    source = F.struct(node.alias("node"), path.alias("path"), F.lit(7).cast("decimal(20,0)").alias("dev"), F.col("user_id").cast("decimal(20,0)").alias("ino"), F.lit(0).cast("long").alias("ctime"))
    return e.select(F.translate(source_key(source), "\u0000", "|").alias("source_key")).distinct()


def _store(spark: SparkSession, d: str) -> LogStore:
    """A store in the shared folder with the logs in two batches."""
    store = LogStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = logs(spark, d)
    for part in (rows.where("event_id % 3 = 0"), rows.where("event_id % 3 > 0")):
        store.write(part, files=4)
    return store


@_query("segment_prune", f"select {_SHOWN_SQL} from logs where _namespace = 'prod' and _node = 'node-2' and _container = 'purchase' and {_RANGE}")
def segment_prune(spark, d):
    """A search that asks the store's catalog which batches and days can match."""
    return _store(spark, d).query('_namespace="prod" and _node="node-2" and _container="purchase"', START, END).select(*_SHOWN)


@_query("store_compacted", f"select {_SHOWN_SQL} from logs where _stream = 'stderr'")
def store_compacted(spark, d):
    """A search of a store some of whose batches were joined."""
    store = _store(spark, d)
    store.compact("2024-01-06", files=2)
    store.vacuum()
    return store.query('_stream = "stderr"').select(*_SHOWN)


@_query("store_catalog", f"select cast(_ts as date) as date, min(_ts_nanos) as min_ts_nanos, max(_ts_nanos) as max_ts_nanos, count(*) as records, cast(sum({_BYTES}) as bigint) as bytes, string_agg(distinct _container, ',' order by _container) as containers, 'app.io/name,tier' as labels, string_agg(distinct case when k is null then _stream else 'k' end, ',' order by case when k is null then _stream else 'k' end) as fields from logs group by 1")
def store_catalog(spark, d):
    days = _store(spark, d).statistics()
    return days.select("date", "min_ts_nanos", "max_ts_nanos", "records", "bytes", *[F.array_join(c, ",").alias(c) for c in ("containers", "labels", "fields")])


@_query("store_watermarks", 'select source_key::varchar as source_key, max("offset") as "offset" from logs group by 1')
def store_watermarks(spark, d):
    return _store(spark, d).watermarks()


@_query("record_assembly", """, l as (select *, event_id % 5 = 0 as partial, strlen(strftime(_ts, '%Y-%m-%dT%H:%M:%S')) + case when _ts_nanos % 1000000000 = 0 then 0 else 1 + strlen(rtrim(lpad((_ts_nanos % 1000000000)::varchar, 9, '0'), '0')) end + 1 + strlen(' ' || _stream || ' F ' || _message) + 1 as size from logs where _container = 'error'),
    g as (select *, cast(sum(size) over (partition by source_key order by event_id) as bigint) as ends, coalesce(sum(case when partial then 0 else 1 end) over (partition by source_key order by event_id rows between unbounded preceding and 1 preceding), 0) as grp from l)
    select any_value(_namespace) as _namespace, any_value(_pod) as _pod, max(ends) as "offset", arg_min(_ts_nanos, event_id) as _ts_nanos, string_agg(_message, '' order by event_id) as _message from g group by source_key, grp having bool_or(not partial)""")
def record_assembly(spark, d):
    """Whole files of lines, a file for each user, as records."""
    rows = _lines(spark, d, _container="error").withColumnRenamed("line", "said")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "said"))), lambda x: F.concat(x["said"], F.lit("\n"))), "")
    path = F.concat(F.lit("/var/log/pods/"), "_namespace", F.lit("_"), "_pod", F.lit("_u/app/0.log"))
    files = rows.groupBy("_namespace", "_pod").agg(text.alias("content")).select(path.alias("path"), F.encode("content", "UTF-8").alias("content"))
    return cri.records(files).select("_namespace", "_pod", "offset", "_ts_nanos", "_message")


def _lines(spark: SparkSession, d: str, **only: str) -> DataFrame:
    """CRI lines made of the events: every fifth is partial and continued by the next event of its user."""
    rows = logs(spark, d)
    for name, value in only.items():
        rows = rows.where(F.col(name) == value)
    tag = F.when(F.col("event_id") % 5 == 0, "P").otherwise("F")
    return rows.select("source_key", "event_id", *(["_namespace", "_pod"] if only else []), F.concat_ws(" ", stamp_of(F.col("_ts_nanos")), "_stream", tag, "_message").alias("line"))


@_query("cri_parse", "select event_id, _ts_nanos, _stream, event_id % 5 = 0 as partial, _message from logs")
def cri_parse(spark, d):
    return cri.parse_lines(_lines(spark, d).drop("source_key"))


@_query(
    "cri_partial_fold",
    """, lines as (select *, event_id % 5 = 0 as partial, coalesce(sum(case when event_id % 5 = 0 then 0 else 1 end) over (partition by source_key order by event_id rows between unbounded preceding and 1 preceding), 0) as grp from logs)
    select source_key, max(event_id) as "offset", arg_min(_ts_nanos, event_id) as _ts_nanos, arg_min(_stream, event_id) as _stream, string_agg(_message, '' order by event_id) as _message
    from lines group by source_key, grp having bool_or(not partial)""",
)
def cri_partial_fold(spark, d):
    return cri.fold(cri.parse_lines(_lines(spark, d).withColumnRenamed("event_id", "offset")), ["source_key"])


@_query("line_offsets", """select doc_id, i - 1 as line_no, line, cast(sum(strlen(line) + 1) over (partition by doc_id order by i) as bigint) as "offset" from (
    select doc_id, unnest(pieces) as line, generate_subscripts(pieces, 1) as i, len(pieces) as n from (select doc_id, string_split(text || chr(10), chr(10)) as pieces from documents)) where i < n""")
def line_offsets(spark, d):
    files = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.encode(F.concat("text", F.lit("\n")), "UTF-8").alias("content"))
    return cri.lines(files).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", "offset")


@_query("json_or_text_body", "select event_id, k, case when k is null then _message end as text from logs")
def json_or_text_body(spark, d):
    rows = logs(spark, d)
    get = lambda path, kind: F.try_variant_get("body", path, kind)
    return rows.select("event_id", get("$.k", "long").alias("k"), F.coalesce(get("$.stdout", "string"), get("$.stderr", "string")).alias("text"))


@_query("path_identity", "select distinct _namespace, _pod, 'u_' || source_key::varchar as uid, _container from logs")
def path_identity(spark, d):
    path = F.concat(F.lit("/var/log/pods/"), "_namespace", F.lit("_"), "_pod", F.lit("_u_"), F.col("source_key").cast("string"), F.lit("/"), "_container", F.lit("/0.log"))
    return logs(spark, d).select(path.alias("path")).distinct().select(*[c.alias(n) for n, c in cri.pod_of(F.col("path")).items()])


def _pods(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    text = lambda kind: F.lit(None).cast(kind)
    return c.select(F.col("c_custkey").alias("uid"), F.create_map(F.lit("segment"), "c_mktsegment").alias("labels"), F.create_map(F.lit("collect"), F.when(F.col("c_mktsegment") == "MACHINERY", "false").otherwise("true")).alias("annotations"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("host-"), F.col("c_nationkey").cast("string"))).otherwise(text("string")).alias("node"), F.create_map(F.lit("error"), F.concat(F.lit("img:"), F.col("c_nationkey").cast("string"))).alias("images"))


@_query("enrich_left_join", "select event_id, case when c_nationkey % 2 = 0 then 'host-' || c_nationkey::varchar else _node end as _node, case when _container = 'error' then 'img:' || c_nationkey::varchar end as _image, c_mktsegment as segment from logs left join customer on source_key = c_custkey")
def enrich_left_join(spark, d):
    rows = logs(spark, d).withColumnRenamed("source_key", "uid")
    return enrich.enrich(rows, _pods(spark, d)).select("event_id", "_node", "_image", F.col("_labels")["segment"].alias("segment"))


@_query("enrich_optout_anti", "select event_id from logs left join customer on source_key = c_custkey where c_mktsegment is null or c_mktsegment <> 'MACHINERY'")
def enrich_optout_anti(spark, d):
    return enrich.without_opted_out(logs(spark, d).withColumnRenamed("source_key", "uid"), _pods(spark, d), "collect").select("event_id")


@_query("namespace_exclusion", "select event_id from logs where _namespace not in ('dev', 'kube-system')")
def namespace_exclusion(spark, d):
    return enrich.without_namespaces(logs(spark, d), ["dev", "kube-system"]).select("event_id")


def _redelivered(rows: DataFrame) -> DataFrame:
    again = rows.where(F.col("event_id") % 7 == 0).withColumn("arrival", F.col("event_id") + 20)
    return rows.withColumn("arrival", F.col("event_id")).unionByName(again)


@_query("dedup_watermark", """, feed as (select *, event_id as arrival from logs union all select *, event_id + 20 as arrival from logs where event_id % 7 = 0)
    select event_id, source_key, "offset" from (select *, max("offset") over (partition by source_key order by arrival, "offset" rows between unbounded preceding and 1 preceding) as before_ from feed) where before_ is null or "offset" > before_""")
def dedup_watermark(spark, d):
    return dedup.by_watermark(_redelivered(logs(spark, d)), ["arrival", "offset"]).select("event_id", "source_key", "offset")


@_query("follow_boundary_dedup", "select event_id from logs")
def follow_boundary_dedup(spark, d):
    """History up to a time, then a live feed that repeats the last part of it."""
    rows = logs(spark, d)
    history, live = rows.where("event_id < 6000"), rows.where("event_id >= 5000")
    return history.unionByName(dedup.above(live, search.watermarks(history))).select("event_id")


@_query("wire_json", "select event_id, _pod, _message from logs")
def wire_json(spark, d):
    """Records written as JSON lines and read again."""
    rows = logs(spark, d).drop("body", "source_key")
    back = F.from_json("line", "_pod string, _message string, offset long")
    return as_json(rows).select(back.alias("x")).select((F.col("x.offset") - 1).alias("event_id"), "x._pod", "x._message")


@_query("wire_records", "select event_id + 1 as \"offset\", _pod, _ts_nanos, _message, k from logs")
def wire_records(spark, d):
    """Records as JSON values on a wire, some malformed, read back with their bodies."""
    rows = logs(spark, d)
    source = F.struct(F.lit("n").alias("node"), F.col("_pod").alias("path"), F.lit(1).cast("decimal(20,0)").alias("dev"), F.lit(2).cast("decimal(20,0)").alias("ino"), F.lit(0).cast("long").alias("ctime"))
    good = as_json(rows.withColumn("source", source)).select(F.encode("line", "UTF-8").alias("value"))
    bad = spark.createDataFrame([("{",), ("",), ("[1]",), ('{"offset":"x"}',), ('{"offset":3}',)], "value string").select(F.encode("value", "UTF-8").alias("value"))
    return from_wire(good.unionByName(bad)).select("offset", "_pod", "_ts_nanos", "_message", F.try_variant_get("body", "$.k", "long").alias("k"))


@_query("stream_store", f"select {_SHOWN_SQL} from logs")
def stream_store(spark, d):
    """Two streams and a table write one store; the second stream brings again what the first one stored."""
    rows = logs(spark, d).withColumns({"arrival": F.col("event_id"), "source_key": F.col("source_key").cast("string")}).drop("body", "_labels", "_annotations")
    store = LogStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    last = F.col("event_id") % 10 == 9
    into = lambda path, stream: stored(stream.drop("arrival"), store, f"{path}/checkpoint").awaitTermination()
    _arriving(spark, d, rows.where(~last & (F.col("source_key") > "5")), "streamed", into)
    store.write(rows.where(~last & (F.col("source_key") <= "5")).drop("arrival"), files=2)
    _arriving(spark, d, rows.where(~last), "streamed", into)
    late = store.records().unionByName(rows.where(last).drop("arrival"), allowMissingColumns=True)
    return late.select(*_SHOWN)


def _arriving(spark: SparkSession, d: str, rows: DataFrame, name: str, run) -> str:
    """Writes rows to a folder in the shared one in two steps by order of arrival, with run(folder, stream of it) after each; returns the folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    middle = rows.agg(F.percentile_approx("arrival", 0.5)).first()[0]
    for part in (rows.where(F.col("arrival") <= middle), rows.where(F.col("arrival") > middle)):
        part.write.mode("append").parquet(f"{path}/in")
        run(path, spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    return path


def _kept(stream: DataFrame, path: str) -> None:
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@_query("stream_dedup", "select event_id, source_key, \"offset\" from logs")
def stream_dedup(spark, d):
    from .streaming.follow import accepted

    rows = _redelivered(logs(spark, d)).select("event_id", "source_key", "offset", "arrival")
    path = _arriving(spark, d, rows, "dedup", lambda path, stream: _kept(accepted(stream).drop("arrival"), path))
    return spark.read.parquet(f"{path}/out")


@_query("stream_follow", "select event_id, _container from logs where _container = 'error' and _ts_nanos >= 1704412800000000000")
def stream_follow(spark, d):
    from .streaming.follow import follow

    rows = logs(spark, d).select("event_id", "_container", "_ts_nanos", F.col("event_id").alias("arrival"))
    live = lambda path, _: _kept(follow(spark, f"{path}/in", '_container = "error"', START).select("event_id", "_container"), path)
    return spark.read.parquet(f"{_arriving(spark, d, rows, 'follow', live)}/out")


def queries() -> dict:
    return dict(found)


def oracle_sql() -> dict[str, str]:
    return dict(sql)
