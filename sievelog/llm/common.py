"""Helpers shared by the corpus operators: tables, the shared work folder, and native array idioms."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import shared_dir

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of text sent to a Python worker at once; keeps a batch of very long texts within its memory.
TEXT_BATCH_ROWS = 256

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it reread: cuts lineage, survives lost executors, and is read column by column."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def small_text_batches(spark: SparkSession) -> None:
    """Bounds how many texts are sent to a Python worker at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def least_hashed(rows: DataFrame, n: int, salt: str, *columns: str) -> DataFrame:
    """The n rows of least hash of the columns: a sample that reruns agree on.

    The hashes beyond which no such row lies, but for a chance of about 1e-9, are
    filtered out first, so a task sends its share of n rows and not n of its own.
    """
    total = rows.count()
    order = one_of("order_", rows.columns)
    some = rows.withColumn(order, F.xxhash64(F.lit(salt), *columns))
    share = (n + 7 * n**0.5 + 40) / max(1, total)
    if share < 1:
        some = some.where(F.col(order) < int(-(2**63) + share * 2**64))
    return some.orderBy(order, *columns).limit(n).drop(order)


def bind(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda that mentions a column computes it anew for every element."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def one_of(name: str, taken: list[str]) -> str:
    """A column name that no column of the input has."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def chunks(n: int, size: int) -> Iterator[tuple[int, int]]:
    for at in range(0, n, size):
        yield at, min(n, at + size)


#: Values that one step of a running total holds: a step copies what it has so far.
_STEP = 256


def running(values: Column, kind: str, add, zero) -> Column:
    """What add(total, value) has made of the values before each of them, as an array: a scan.

    It goes over steps of _STEP values and then over the steps, so the work for n
    values is about n * _STEP / 2 + (n / _STEP)^2 / 2 and not n^2 / 2 copies. zero must be add's neutral value.
    """
    nothing, start = F.array().cast(f"array<{kind}>"), F.lit(zero).cast(kind)

    def scan(v: Column, first: Column) -> Column:
        return F.aggregate(v, F.struct(nothing.alias("out"), first.alias("at")), lambda a, x: F.struct(F.concat(a["out"], F.array(a["at"])).alias("out"), add(a["at"], x).cast(kind).alias("at")), lambda a: a["out"])

    def whole(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _STEP).cast("int")), lambda b: F.slice(v, b * _STEP + 1, F.lit(_STEP)))

        def joined(cut_: Column) -> Column:
            totals = F.transform(cut_, lambda c: F.aggregate(c, start, lambda a, x: add(a, x).cast(kind)))
            return bind(scan(totals, start), lambda before: F.flatten(F.transform(cut_, lambda c, b: scan(c, F.get(before, b)))))

        return F.when(F.size(v) == 0, nothing).when(F.size(v) <= _STEP, scan(v, start)).otherwise(bind(steps, joined))

    return bind(values, whole)


def merged(spans: Column) -> Column:
    """Sorted, disjoint [start, end) pairs covering an array of struct(start, end) in any order."""

    def whole(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), "int", F.greatest, -1)

        def islands(r: Column) -> Column:
            begins = F.filter(F.transform(s, lambda x, i: F.when(x["start"] > F.get(r, i), x["start"])), lambda x: x.isNotNull())
            stops = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i + 1)["start"] > F.greatest(F.get(r, i), x["end"]), F.lit(True)), F.greatest(F.get(r, i), x["end"]))), lambda x: x.isNotNull())
            return F.transform(F.arrays_zip(begins.alias("start"), stops.alias("end")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

        return bind(reach, islands)

    return bind(F.sort_array(spans), whole)


def cut(text: Column, spans: Column, fill: str = "") -> Column:
    """text with each of the sorted, disjoint [start, end) spans (in code points) replaced by fill.

    A place in a text is found by counting from its beginning, so the text is
    first cut into the parts that hold _STEP spans each.
    """

    def kept(t: Column, s: Column, at: Column, to: Column) -> Column:
        """t, which begins at code point `at` and ends at `to`, without its spans."""
        left = F.transform(s, lambda x, i: bind(F.when(i == 0, at).otherwise(F.get(s, i - 1)["end"]), lambda a: t.substr(a - at + 1, x["start"] - a)))
        return F.concat(F.array_join(F.concat(left, F.array(F.lit(""))), fill), t.substr(F.element_at(s, -1)["end"] - at + 1, to - F.element_at(s, -1)["end"]))

    def whole(t: Column) -> Column:
        def build(s: Column) -> Column:
            steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _STEP).cast("int")), lambda b: F.struct(F.slice(s, b * _STEP + 1, F.lit(_STEP)).alias("s"), F.when(b == 0, F.lit(0)).otherwise(F.get(s, b * _STEP - 1)["end"]).alias("at"), F.when((b + 1) * _STEP >= F.size(s), F.length(t)).otherwise(F.get(s, (b + 1) * _STEP - 1)["end"]).alias("to")))
            parts = F.transform(steps, lambda p: bind(t.substr(p["at"] + 1, p["to"] - p["at"]), lambda part: kept(part, p["s"], p["at"], p["to"])))
            return F.when(F.size(s) <= _STEP, kept(t, s, F.lit(0), F.length(t))).otherwise(F.array_join(parts, ""))

        return bind(spans, build)

    return F.when(F.size(spans) > 0, bind(text, whole)).otherwise(text)
