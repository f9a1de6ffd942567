"""Records as plain data, and a plain evaluator of the search language to hold the compiler against."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelog.plans.language import All, And, Compare, Exists, Not, Or, parse, plain_number
from sievelog.sources.cri import body_of

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("_ts_nanos", T.LongType()), T.StructField("_namespace", T.StringType()), T.StructField("_pod", T.StringType()),
    T.StructField("_container", T.StringType()), T.StructField("_node", T.StringType()), T.StructField("_stream", T.StringType()),
    T.StructField("_labels", T.MapType(T.StringType(), T.StringType())), T.StructField("_annotations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_message", T.StringType()), T.StructField("source_key", T.StringType()), T.StructField("offset", T.LongType()),
])

BASE = {"_ts_nanos": 1780142400000000000, "_namespace": "prod", "_pod": "web-abc", "_container": "app", "_node": "node-1", "_stream": "stdout", "_labels": {"app": "web", "app.kubernetes.io/name": "frontend"}, "_annotations": {}, "source_key": "s", "offset": 1}


def frame(spark, rows):
    full = [{**BASE, "id": i, "_message": "", **r} for i, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA.fields) for r in full], SCHEMA)
    return df.withColumn("body", body_of(F.col("_message"), F.col("_stream")))


def resolve(field, record):
    """(kind, value) of a field, or None if absent."""
    if field.kind == "envelope":
        if field.key == "_ts":
            return "number", float(record["_ts_nanos"])
        if field.key == "_message":
            return "text", record.get("_message") or ""
        if field.key in BASE and field.key not in ("_labels", "_annotations") and record.get(field.key):
            return "text", record[field.key]
        return None
    if field.kind in ("label", "annotation"):
        held = record["_labels" if field.kind == "label" else "_annotations"] or {}
        return ("text", held[field.key]) if field.key in held else None
    message = record.get("_message") or ""
    try:
        body = json.loads(message) if message.strip().startswith("{") else None
    except ValueError:
        body = None
    if not isinstance(body, dict):
        body = {"stderr" if record["_stream"] == "stderr" else "stdout": message}
    for key in field.key:
        if not isinstance(body, dict) or key not in body:
            return None
        body = body[key]
    if body is None:
        return "null", None
    if isinstance(body, bool):
        return "truth", body
    if isinstance(body, (int, float)):
        return "number", float(body)
    return "text", body if isinstance(body, str) else json.dumps(body, separators=(",", ":"))


def text_of(kind, v):
    return {"null": lambda: "", "truth": lambda: str(v).lower(), "number": lambda: plain_number(v), "text": lambda: v}[kind]()


def number_of(kind, v):
    if kind == "number":
        return v
    if kind == "text":
        t = v.strip()
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t) and math.isfinite(float(t)):
            return float(t)
        if re.fullmatch(r"(?i)[+-]?inf(inity)?", t):
            return float(t)
    return None


def holds(tree, r):
    match tree:
        case All():
            return True
        case And(a, b):
            return holds(a, r) and holds(b, r)
        case Or(a, b):
            return holds(a, r) or holds(b, r)
        case Not(a):
            return not holds(a, r)
        case Exists(f):
            v = resolve(f, r)
            return v is not None and v[0] != "null" and v[1] != ""
        case Compare(f, op, x):
            v = resolve(f, r)
            if v is None:
                return op in ("!=", "!~")
            if op in ("=", "!="):
                if isinstance(x, bool):
                    same = v[1] is x if v[0] == "truth" else v[0] == "text" and v[1] == str(x).lower()
                elif isinstance(x, float):
                    same = number_of(*v) == x
                else:
                    same = text_of(*v) == x
                return same if op == "=" else not same
            if op in ("=~", "!~"):
                hit = re.search(x, text_of(*v)) is not None
                return hit if op == "=~" else not hit
            if op == ":":
                return x in text_of(*v)
            if isinstance(x, float):
                left = number_of(*v)
                if left is None:
                    return False
            else:
                left, x = text_of(*v).encode(), ("" if isinstance(x, bool) else x).encode()
            return {"<": left < x, "<=": left <= x, ">": left > x, ">=": left >= x}[op]
    raise TypeError(tree)


def outcomes(spark, rows, query):
    """What the compiler says for each row."""
    from sievelog.plans.compiler import truth

    df = frame(spark, rows)
    return [r["hit"] for r in df.select("id", truth(query, df).alias("hit")).orderBy("id").collect()]


def expected(rows, query):
    tree = parse(query)
    return [holds(tree, {**BASE, "_message": "", **r}) for r in rows]
