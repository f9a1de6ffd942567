"""Expression tree -> Spark column, in negation normal form.

The language is two-valued: an absent field makes every test false but != and
!~, which it makes true. As a filter takes NULL for false, plain tests stay
bare columns that Parquet scans can use; negation is pushed to the leaves,
where it adds "or absent". Nothing is wrapped in coalesce but body leaves under
negation, which no scan could use anyway.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import to_java
from ..functions.values import Value, absent_value, body_value, bound, configure, leaf_of, number_value, text_value
from ..schema import TEXT_FIELDS
from .language import All, And, Compare, Exists, Field, Not, Or, parse


def value_of(field: Field, columns: list[str]) -> Value:
    """The value of a field in records with these columns."""
    if field.kind == "envelope":
        if field.key == "_ts" and "_ts_nanos" in columns:
            return number_value(F.col("_ts_nanos").cast("double"))
        if field.key in TEXT_FIELDS and field.key in columns:
            return text_value(F.col(field.key), always=field.key == "_message")
        return absent_value()
    if field.kind in ("label", "annotation"):
        maps = "_labels" if field.kind == "label" else "_annotations"
        return text_value(F.col(maps)[F.lit(field.key)]) if maps in columns else absent_value()
    return absent_value()


def _on(field: Field, columns: list[str], test) -> Column:
    """test(value of field). A leaf of the body is bound first, so that a test that looks at its kind, number and text parses the body once."""
    if field.kind != "body" or "body" not in columns:
        return test(value_of(field, columns))
    message = F.col("_message") if "_message" in columns else None
    return bound(leaf_of(F.col("body"), field.key), lambda leaf: test(body_value(leaf, message, field.key)))


def _test(v: Value, op: str, x) -> Column:
    """A positive test: true, or else false or NULL."""
    if op == "=~":
        return v.text.rlike(to_java(x))
    if op == ":":
        return v.text.contains(F.lit(x)) if x else v.present
    if op == "=" and isinstance(x, bool):
        return v.truth_is(x)
    if isinstance(x, bool):  # ordering against a truth value compares texts with ""
        left, x = v.text, ""
    elif isinstance(x, float):
        left = v.number
    else:
        left = v.text
    right = F.lit(x)
    return {"=": left == right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _compile(tree, columns: list[str], negated: bool) -> Column:
    match tree:
        case All():
            return F.lit(not negated)
        case Not(inner):
            return _compile(inner, columns, not negated)
        case And(left, right) | Or(left, right):
            parts = [_compile(x, columns, negated) for x in (left, right)]
            return reduce(Column.__and__ if isinstance(tree, And) != negated else Column.__or__, parts)
        case Exists(field):
            return _on(field, columns, lambda v: ~v.present | ~v.filled if negated else v.present & v.filled)
        case Compare(field, op, x):
            if op in ("!=", "!~"):
                op, negated = {"!=": "=", "!~": "=~"}[op], not negated

            def outcome(v: Value) -> Column:
                test = _test(v, op, x)
                if not negated:
                    return test
                # the text of a present field is never NULL, so only other tests need a default
                plain = v.steady and (isinstance(x, str) or op == "=~")
                return ~v.present | ~(test if plain else F.coalesce(test, F.lit(False)))

            return _on(field, columns, outcome)
    raise TypeError(tree)


def predicate(query: str, records: DataFrame) -> Column:
    """The filter of a query text on records; NULL counts as false."""
    configure(records.sparkSession)
    return _compile(parse(query), records.columns, False)


def truth(query: str, records: DataFrame) -> Column:
    """The outcome as a column that is never NULL."""
    return F.coalesce(predicate(query, records), F.lit(False))
