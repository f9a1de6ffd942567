"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod 97 for IBANs), and words nearby move a candidate's score. The base kinds
(email, ip, card, phone) are fixed by pattern and checksum; the method adds
kinds that need a checksum or context. Spans are [start, end) in code points.

Places come from two readings of one pattern: the matches, and the pieces
between them. The patterns use possessive repeats and look behind a run's
start, so a text is read in time in proportion to its length.

Defined cases: a null text is empty and has no spans; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, cut, merged, one_of, running

_NAME = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A card or an international number among other digits, where the base patterns see one long match and drop it.
CARD_AMONG = r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])"
PHONE_AMONG = r"\+[0-9](?:[()\x20-]{0,2}[0-9]){7,14}(?![0-9]|\.[0-9])"
LOCAL_PHONE = r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

BASE = ("email", "ip", "card", "phone")
#: Code points on either side in which words count as context.
NEARBY = 48
#: A candidate of the method counts from this score on.
THRESHOLD = 0.6
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def found(text: Column, pattern: str, nearby: int = 0) -> Column:
    """array of struct(start, end, value, around): the leftmost matches that do not overlap, in time in proportion to the text.

    around: the match with the text of up to `nearby` code points on either
    side, read from the pieces and matches next to it.
    """
    kind = "array<struct<start:int,end:int,value:string,around:string>>"

    def placed(m: Column) -> Column:
        def joined(between: Column) -> Column:
            piece = lambda i: F.coalesce(F.when(i >= 0, F.get(between, i)), F.lit(""))
            match = lambda i: F.coalesce(F.when(i >= 0, F.get(m, i)), F.lit(""))

            def around(i: Column) -> Column:
                if not nearby:
                    return F.lit("")
                before, after = F.concat(F.right(piece(i - 1), F.lit(nearby)), match(i - 1), piece(i)), F.concat(piece(i + 1), match(i + 1), F.left(piece(i + 2), F.lit(nearby)))
                return F.concat(F.right(before, F.lit(nearby)), F.get(m, i), F.left(after, F.lit(nearby)))

            begins = running(F.transform(m, lambda v, i: F.length(F.get(between, i)) + F.length(v)), "int", lambda a, x: a + x, 0)
            spot = lambda b: F.transform(m, lambda v, i: F.struct((F.get(b, i) + F.length(F.get(between, i))).alias("start"), (F.get(b, i) + F.length(F.get(between, i)) + F.length(v)).alias("end"), v.alias("value"), around(i).alias("around")))
            return bind(begins, spot)

        return F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(bind(F.split(text, pattern, -1), joined))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""

    def total(d: Column) -> Column:
        def digit(i: Column) -> Column:  # the i-th from the right, from 1
            return d.substr(F.length(d) - i + 1, F.lit(1)).cast("int")

        doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i))) % 10 == 0

    return F.when(F.length(number) == 0, F.lit(False)).otherwise(bind(number, total))


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes its check: moved, with letters as 10 to 35, it leaves 1."""
    plain = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _ip_ok(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(p.substr(-3, 3).try_cast("int"), F.lit(999)) <= 255))


@dataclass(frozen=True)
class Kind:
    """pattern: proposes; needs: a cheap test that a text must pass first; ok(value): the checksum; sure and unsure: the score with and without it; near: context words that add to it."""

    name: str
    pattern: str
    needs: object
    ok: object
    sure: float = 1.0
    unsure: float = 0.0
    near: str = ""
    bonus: float = 0.0


_DIGIT = lambda t: t.rlike("[0-9]")
KINDS = (
    Kind("email", EMAIL, lambda t: t.contains("@"), lambda v: F.lit(True)),
    Kind("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip_ok),
    Kind("card", CARD, _DIGIT, lambda v: F.length(digits(v)).between(16, 19) & luhn(digits(v))),
    Kind("phone", PHONE, lambda t: t.contains("+"), lambda v: F.length(digits(v)).between(8, 15)),
    Kind("iban", IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), mod97, 0.9, 0.1, r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b", 0.2),
    Kind("ssn", SSN, lambda t: t.rlike("[0-9]-[0-9]"), lambda v: ~v.rlike("^(?:000|666|9)") & ~v.rlike("-00-|-0000$"), 0.4, 0.0, r"(?i)\b(?:ssn|social security|tax id)\b", 0.4),
    Kind("local_phone", LOCAL_PHONE, _DIGIT, lambda v: ~v.rlike(r"^\(?[01]"), 0.4, 0.1, r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell)\b", 0.4),
    Kind("card_among", CARD_AMONG, lambda t: t.rlike("[0-9]{4}[\x20-]?[0-9]{4}"), lambda v: luhn(digits(v))),
    Kind("phone_among", PHONE_AMONG, lambda t: t.contains("+"), lambda v: F.length(digits(v)).between(8, 15)),
)


def _accepted(text: Column, kind: Kind, threshold: float) -> Column:
    def score(x: Column) -> Column:
        s = F.when(kind.ok(x["value"]), F.lit(kind.sure)).otherwise(F.lit(kind.unsure))
        return s + F.when((s > 0) & x["around"].rlike(kind.near), F.lit(kind.bonus)).otherwise(F.lit(0.0)) if kind.near else s

    spans = F.transform(F.filter(found(text, kind.pattern, NEARBY if kind.near else 0), lambda x: score(x) >= threshold), lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(kind.needs(text), spans).otherwise(F.array().cast(_SPANS))


def _free(more: Column, base: Column) -> Column:
    """The spans of more, by kind and place, that no span of base overlaps: two scans over both in order of place."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k.name, i)])
    mark = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind")))
    far = 2**31 - 1

    def sift(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(-1))), "int", F.greatest, -1)
        ahead = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(F.lit(far)))), "int", F.least, far))
        alone = lambda r, a: F.filter(s, lambda x, i: (x["own"] == 1) & (F.get(r, i) <= x["start"]) & (F.get(a, i) >= x["end"]))
        ordered = bind(reach, lambda r: bind(ahead, lambda a: F.sort_array(F.transform(alone(r, a), lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))))
        return F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(bind(F.sort_array(F.concat(mark(base, 0), mark(more, 1))), sift))


def listed(found_: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, joined by commas."""
    some = F.filter(found_, lambda x: x["kind"].isin(*kinds)) if kinds else found_
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, name: str, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with column `name`: all spans by kind as listed, then by place; those of the method's own kinds only where no base span lies."""
    base, more = one_of("base_spans", [*docs.columns, name]), one_of("more_spans", [*docs.columns, name])
    whole = F.coalesce(F.col(text), F.lit(""))
    part = lambda own: F.concat(*[_accepted(whole, k, threshold) for k in KINDS if (k.name in BASE) == own])
    # columns used twice are computed once; nested in one expression they would take the analyzer long
    held = docs.withColumns({base: part(True), more: part(False)})
    return held.withColumn(name, F.concat(base, _free(F.col(more), F.col(base)))).drop(base, more)


def redacted(docs: DataFrame, text: str = "text", mask: str = "<pii>", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of their texts replaced by the mask; a null text stays null."""
    name = one_of("pii_spans", docs.columns)
    cover = one_of("pii_cover", [*docs.columns, name])
    bare = F.transform(F.col(name), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    held = with_spans(docs, name, text, threshold).withColumn(cover, merged(bare))
    return held.withColumn(text, F.when(F.size(cover) > 0, cut(F.col(text), F.col(cover), mask)).otherwise(F.col(text))).select(*docs.columns)
