"""Container log files as records: path, lines with byte offsets, partial lines, body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import nanos_of, timestamp_of
from ..functions.values import bound, configure, trimmed

_POD_DIR = r"(?:^|/)pods/([^/]*)/([^/]+)(?:/|$)"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of <root>/<pod directory>/<container>/<n>.log."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(f"{root.rstrip('/')}/*/*/*.log").select("path", "content", "modificationTime")


def pod_of(path: Column) -> dict[str, Column]:
    """Namespace, pod, uid and container of a path: .../pods/<namespace>_<pod>_<uid>/<container>/...; NULL if it has another form."""
    first = F.regexp_extract(path, _POD_DIR, 1)
    parts = F.split(first, "_", 3)
    ok = F.size(parts) == 3
    get = lambda i: F.when(ok, F.get(parts, F.lit(i)))
    return {"_namespace": get(0), "_pod": get(1), "uid": get(2), "_container": F.when(ok, F.regexp_extract(path, _POD_DIR, 2))}


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Every finished line with the byte offset of its end; an unfinished last line is left for later.

    Bytes are read as one character each, so lengths are byte lengths. Offsets
    are running sums inside a file, told apart by the other columns.
    """
    text = F.decode(F.col(content), "ISO-8859-1") if dict(files.dtypes)[content] == "binary" else F.decode(F.encode(F.col(content), "UTF-8"), "ISO-8859-1")
    rest = [c for c in files.columns if c != content]
    pieces = F.split(text, "\n")
    out = files.select(*rest, F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("line_no", "raw_"))
    end = F.sum(F.length("raw_").cast("long") + 1).over(Window.partitionBy(*rest).orderBy("line_no"))
    return out.select(*rest, "line_no", F.decode(F.encode("raw_", "ISO-8859-1"), "UTF-8").alias("line"), end.alias("offset"))


def parse_lines(df: DataFrame) -> DataFrame:
    """<time> <stream> <tag> <message> in column line -> _ts_nanos, _stream, partial, _message; lines without a valid time are dropped."""
    p = F.split(F.col("line"), " ", 4)
    at = nanos_of(F.get(p, F.lit(0)))
    out = df.withColumn("_ts_nanos", at).where((F.size(p) >= 3) & F.col("_ts_nanos").isNotNull())
    return out.withColumns({"_stream": F.get(p, F.lit(1)), "partial": F.get(p, F.lit(2)) == "P", "_message": F.coalesce(F.get(p, F.lit(3)), F.lit(""))}).drop("line")


def fold(parsed: DataFrame, file_keys: list[str], by_stream: bool = False) -> DataFrame:
    """Partial lines joined with the full line that ends them.

    Time and stream come from the first partial line with text, the offset
    from the full line; a group that no full line ends is left out. by_stream
    keeps the groups of the two streams apart.
    """
    keys = [*file_keys, *(["_stream"] if by_stream else [])]
    order = Window.partitionBy(*keys).orderBy("offset")
    group = F.coalesce(F.sum(F.when(F.col("partial"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parsed.withColumn("group_", group)
    said = F.col("partial") & (F.col("_message") != "")
    part = F.struct("offset", "_message")
    folded = rows.groupBy(*keys, "group_").agg(
        F.max("partial").alias("some_"), F.max(F.when(~F.col("partial"), F.col("offset"))).alias("offset"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["_message"]), "").alias("_message"),
        F.min(F.when(said, F.struct("offset", "_ts_nanos", "_stream"))).alias("first_"),
        F.max(F.when(~F.col("partial"), F.struct("offset", "_ts_nanos", "_stream"))).alias("last_"),
    )
    head = F.coalesce("first_", "last_")
    return folded.where("offset is not null").select(*[k for k in keys if k != "_stream"], "offset", head["_ts_nanos"].alias("_ts_nanos"), head["_stream"].alias("_stream"), "_message")


def body_of(message: Column, stream: Column) -> Column:
    """The JSON object a message is, or {stream: message}. The whole message must be one object: the parser alone would take what follows it."""
    configure(SparkSession.active())

    def parsed(m: Column) -> Column:
        text = F.when(m.startswith("{") & m.endswith("}"), m).otherwise(trimmed(m))
        # in brackets, what follows an object is an error or a second element
        boxed = bound(text, lambda t: F.when(t.startswith("{"), F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))))
        return bound(boxed, lambda b: F.when(F.variant_get(b, "$[1]", "variant").isNull(), F.variant_get(b, "$[0]", "variant")))

    obj = bound(message, lambda m: F.when(m.rlike(r"^[\{\s\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"), parsed(m)))
    name = F.when(stream.isin("stdout", "stderr"), stream).otherwise(F.lit("stdout"))
    plain = F.parse_json(F.to_json(F.map_from_arrays(F.array(name), F.array(F.coalesce(message, F.lit(""))))))
    return F.coalesce(obj, plain)


def records(files: DataFrame, node: str = "", by_stream: bool = False) -> DataFrame:
    """Records of (path, content) rows."""
    files = files.withColumns(pod_of(F.col("path"))).where("uid is not null")
    keys = ["path", "_namespace", "_pod", "uid", "_container"]
    out = fold(parse_lines(lines(files.select(*keys, "content"))), keys, by_stream)
    source = F.struct(F.lit(node).alias("node"), F.col("path"), F.lit(0).cast("decimal(20,0)").alias("dev"), F.lit(0).cast("decimal(20,0)").alias("ino"), F.lit(0).cast("long").alias("ctime"))
    empty = F.create_map().cast("map<string,string>")
    return out.select(
        source.alias("source"), "offset", timestamp_of(F.col("_ts_nanos")).alias("_ts"), "_ts_nanos", "_namespace", "_pod", "_container", F.nullif(F.lit(node), F.lit("")).alias("_node"),
        F.lit(None).cast("string").alias("_image"), "_stream", empty.alias("_labels"), empty.alias("_annotations"), "_message", body_of(F.col("_message"), F.col("_stream")).alias("body"), "uid",
    )
