"""Values of record fields as Spark columns: presence, text, number and truth.

Fields have four kinds of value: null, text, number, truth. Text of a number
never has an exponent; a text is a number if all of it reads as one. Body
fields dispatch on the kind of their JSON leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(?:(?:\d+(?:_?\d)*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"
_INFINITE = r"(?i)^[+-]?inf(?:inity)?$"
_BLANK = r"[\t\n\x0B\f\r \x85\xA0  -     　]"
_UNICODE_SPACE = f"^{_BLANK}+|{_BLANK}+$"


def configure(spark: SparkSession) -> None:
    """Sets what the engine needs of a session: of JSON keys that repeat, the last one counts. The parser reads this when a query is planned, so it stays set."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def trimmed(text: Column) -> Column:
    """text without Unicode white space at its ends."""
    return F.regexp_replace(text, _UNICODE_SPACE, "")


def number_of(text: Column) -> Column:
    """The double that all of text reads as; NULL for other texts, for overflow and for NaN (which compares as false)."""
    t = trimmed(text)
    value = t.try_cast("double")
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    return F.when(t.rlike(_NUMBER) & ~t.contains("_"), finite).when(t.rlike(_INFINITE), F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def text_of_number(d: Column) -> Column:
    """Plain decimal digits of a double: no exponent, no trailing .0."""
    s = d.cast("string")
    form = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    frac = F.regexp_replace(F.regexp_extract(s, form, 3), "^0$", "")
    digits = F.concat(F.regexp_extract(s, form, 2), frac)
    power = F.regexp_extract(s, form, 4).try_cast("int")
    big = F.when(power >= F.length(frac), F.concat(digits, F.repeat(F.lit("0"), power - F.length(frac)))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    expanded = F.concat(F.regexp_extract(s, form, 1), F.when(power < 0, small).otherwise(big))
    whole = (F.abs(d) < F.lit(2.0**53)) & (d == F.floor(d)) & ~((d == 0) & s.startswith("-"))
    return F.when(whole, d.cast("long").cast("string")).when(s.contains("E"), expanded).otherwise(F.regexp_replace(s, r"\.0$", ""))


@dataclass
class Value:
    """present: NULL never. text, number, truth: NULL where the value has none. steady: text is the bare column, so comparisons with it push down."""

    present: Column
    text: Column
    number: Column
    truth_is: object
    filled: Column
    steady: bool = field(default=False)


def text_value(col: Column, always: bool = False) -> Value:
    """An envelope text (NULL if absent) or a map entry."""
    present = F.lit(True) if always else col.isNotNull()
    col = F.coalesce(col, F.lit("")) if always else col
    return Value(present, col, number_of(col), lambda b: col == F.lit("true" if b else "false"), col != "", True)


def number_value(col: Column) -> Value:
    text = text_of_number(col)
    return Value(col.isNotNull(), text, col, lambda b: F.lit(False), col.isNotNull(), False)


def absent_value() -> Value:
    nothing = F.lit(None).cast("string")
    return Value(F.lit(False), nothing, nothing.cast("double"), lambda b: F.lit(False), F.lit(False), False)


def json_path(path: tuple[str, ...]) -> str | None:
    """The variant path of keys; None if one has both kinds of quotes."""
    out = "$"
    for key in path:
        if '"' not in key and "\\" not in key:
            out += f'["{key}"]'
        elif "'" not in key and "\\" not in key:
            out += f"['{key}']"
        else:
            return None
    return out


def leaf_of(body: Column, path: tuple[str, ...]) -> Column:
    """The variant at a path of keys; NULL if there is none."""
    where = json_path(path)
    if where is not None:
        return F.variant_get(body, where, "variant")
    # such keys have no path syntax: look the key up among the object's entries
    for key in path:
        body = F.try_element_at(F.try_variant_get(body, "$", "map<string,variant>"), F.lit(key))
    return body


def body_value(leaf: Column, message: Column | None, path: tuple[str, ...]) -> Value:
    """The value of a leaf of the JSON body. Its kind, number and text are read from the leaf alone, so a caller binds it and the body is parsed once."""
    raw = F.to_json(leaf)
    if message is not None and not any("'" in k for k in path):
        raw = F.coalesce(F.get_json_object(message, "$" + "".join(f"['{k}']" for k in path)), raw)
    at = lambda kind: F.try_variant_get(leaf, "$", kind)
    kind = F.schema_of_variant(leaf)
    is_text, is_truth, is_null = kind == "STRING", kind == "BOOLEAN", kind == "VOID"
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    number, string = at("double"), at("string")
    text = F.when(is_text, string).when(is_number, text_of_number(number)).when(is_truth, at("boolean").cast("string")).when(is_null, F.lit("")).when(kind.isNotNull(), raw)
    return Value(
        leaf.isNotNull(), text, F.when(is_number, number).when(is_text, number_of(string)),
        lambda b: F.when(is_truth, at("boolean") == F.lit(b)).when(is_text, string == F.lit("true" if b else "false")).otherwise(F.lit(False)),
        ~is_null & (F.when(is_text, string != "").otherwise(F.lit(True))), False,
    )
