"""Times as integer nanoseconds since 1970, in Python for parameters and in Spark for columns."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})")
_STAMP = r"^\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d+)?(?:Z|[+-](?:(?:0\d|1[0-7]):[0-5]\d|18:00))$"


def parse_time(text: str | int | None) -> int | None:
    """Nanoseconds of an RFC 3339 time or of integer seconds; None for nothing."""
    if text is None or text == "":
        return None
    if isinstance(text, int):
        return text * 1_000_000_000
    if m := _RFC3339.fullmatch(text):
        try:
            at = datetime.fromisoformat(f"{m[1]}T{m[2]}{'+00:00' if m[4] == 'Z' else m[4]}")
        except ValueError:
            raise ValueError("expected RFC3339 or unix seconds") from None
        since = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return (since.days * 86_400 + since.seconds) * 1_000_000_000 + int(((m[3] or "") + "0" * 9)[:9])
    if re.fullmatch(r"[+-]?\d+", text) and -(2**63) <= int(text) < 2**63:
        return int(text) * 1_000_000_000
    raise ValueError("expected RFC3339 or unix seconds")


def format_time(nanos: int) -> str:
    """RFC 3339 in UTC, the fraction without trailing zeros."""
    seconds, rest = divmod(nanos, 1_000_000_000)
    fraction = f".{rest:09d}".rstrip("0") if rest else ""
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + fraction + "Z"


def nanos_of(stamp: Column) -> Column:
    """Nanoseconds of an RFC 3339 text; NULL if it is none.

    One pattern tells whether it is one; then all parts but the fraction have
    fixed places, counted from either end.
    """
    two = lambda at: F.substring(stamp, at, 2).cast("int")
    zulu = stamp.endswith("Z")
    zone = F.when(zulu, 0).otherwise(F.when(F.substring(stamp, -6, 1) == "-", -60).otherwise(60) * (60 * two(-5) + two(-2)))
    seconds = F.unix_date(F.substring(stamp, 1, 10).try_cast("date")).cast("long") * 86_400 + (3600 * two(12) + 60 * two(15) + two(18) - zone)
    said = F.length(stamp) - F.when(zulu, 21).otherwise(26)  # digits of the fraction
    fraction = F.when(said > 0, F.rpad(stamp.substr(F.lit(21), F.least(said, F.lit(9))), 9, "0").cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(stamp.rlike(_STAMP), seconds * 1_000_000_000 + fraction)


def timestamp_of(nanos: Column) -> Column:
    """The microsecond timestamp of nanoseconds."""
    return F.timestamp_micros(F.floor(nanos / F.lit(1000).cast("decimal(20,0)")).cast("long"))


def stamp_of(nanos: Column) -> Column:
    """RFC 3339 text of nanoseconds, in UTC."""
    nanos = nanos.cast("long")
    rest = F.pmod(nanos, F.lit(1_000_000_000).cast("long"))
    seconds = F.call_function("div", nanos - rest, F.lit(1_000_000_000).cast("long"))
    of_day = F.pmod(seconds, F.lit(86_400).cast("long"))
    day = F.date_from_unix_date(F.call_function("div", seconds - of_day, F.lit(86_400).cast("long")).cast("int"))
    part = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", part(F.floor(of_day / 3600)), part(F.floor(of_day % 3600 / 60)), part(of_day % 60))
    fraction = F.when(rest != 0, F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 9, "0"), F.lit("0")))).otherwise(F.lit(""))
    return F.concat(day.cast("string"), F.lit("T"), clock, fraction, F.lit("Z"))
