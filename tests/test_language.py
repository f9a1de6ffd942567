import random

import pytest
from pyspark.sql import functions as F

from sievelog.functions.regex import BadPattern, to_java
from sievelog.functions.values import number_of, text_of_number
from sievelog.plans.compiler import predicate, truth
from sievelog.plans.language import QueryError, parse, plain_number, required_equalities

from .records import expected, frame, outcomes

ONE = {"_message": '{"level":"error","status":500,"ok":false,"user":{"id":42,"name":"ada"},"text":"a panic"}'}
TRUE = [
    "", '_namespace="prod"', '_namespace != "dev"', "_pod =~ /web-.*/", "_pod !~ /api-.*/", 'level="error"', 'body.level="error"', "status >= 500", "status = 500", "ok = false",
    "user.id = 42", 'body.user.name = "ada"', '_message : "panic"', 'label.app = "web"', 'label["app.kubernetes.io/name"] = "frontend"', 'missing != "x"', "level",
    '_namespace="dev" or level="error"', '_namespace="prod" and level="error"', 'not level="info"', '_namespace="dev" or _namespace="prod" and level="error"',
    'status = "500"', "status : 50", "ok > true", '_pod.x = "web-abc"', '_nope != "x"', "NOT missing", 'user["id"] = 42', "user . id=42", "ok", 'not (level != "error")', "not (level !~ /err/)", "level or level",
]
FALSE = [
    '_namespace="dev"', 'level="info"', "status > 500", "status < 400", "ok = true", '_message : "success"', 'missing = "x"', "missing", '_namespace="prod" and level="info"',
    '(_namespace="dev" or _namespace="prod") and level="info"', "ok < true", "_nope", r'_pod =~ "web-\d"', "level = 1", "user.name.first",
]
BROKEN = ["_pod =~ /[/", "level =", "level = ", '(level="error"', '= "x"', 'level == "x"', "a.and = 1", "x = 1.2.3", "x = 5-3", "x = 1e999", "x = .5", "x = /re/", "x[1]", "'abc", "a b", "x =~ 5", "not", "_pod =~ /(?=x)/"]


@pytest.fixture(scope="module")
def one(spark):
    df = frame(spark, [ONE])
    queries = TRUE + FALSE
    row = df.select(*[truth(q, df).alias(f"q{i}") for i, q in enumerate(queries)]).first()
    return dict(zip(queries, row))


@pytest.mark.parametrize("query", TRUE)
def test_true(one, query):
    assert one[query] is True


@pytest.mark.parametrize("query", FALSE)
def test_false(one, query):
    assert one[query] is False


@pytest.mark.parametrize("query", BROKEN)
def test_errors_at_parse(query):
    with pytest.raises(QueryError):
        parse(query)


def test_keywords_in_brackets():
    assert parse('a["and"] = 1').field.key == ("a", "and")


def test_number_then_word():
    assert parse("k = 500and x").left.value == 500.0


@pytest.mark.parametrize("query, n", [('_namespace="a"', 1), ('_namespace="a" and _pod="b"', 2), ('_namespace="a" or _pod="b"', 0), ('_namespace="a" or _namespace="a"', 1), ('not _namespace="a"', 0), ('level="a"', 0)])
def test_required_equalities(query, n):
    assert len(required_equalities(parse(query))) == n


ROWS = [
    {"_message": '{"x":null}'}, {"_message": '{"x":""}'}, {"_message": "{}"}, {"_message": '{"x":"500"}'}, {"_message": '{"x":500}'}, {"_message": '{"x":1.50}'}, {"_message": '{"x":true}'},
    {"_message": '{"x":"true"}'}, {"_message": '{"x":{"y":"z"}}'}, {"_message": '{"x":[1,2]}'}, {"_message": '{"x":" 5 "}'}, {"_message": '{"x":"1d"}'}, {"_message": '{"x":"nan"}'}, {"_message": '{"x":"-inf"}'},
    {"_message": '{"x":"1e999"}'}, {"_message": '{"x":1e21}'}, {"_message": '{"x":0.000001}'}, {"_message": "plain text"}, {"_message": '{"x":1} tail'}, {"_message": '{"x":1},{"x":2}'}, {"_message": "", "_stream": "stderr"},
    {"_message": "x", "_namespace": None, "_labels": None}, {"_message": '{"a":{"x":"deep"},"x":"a\\nb"}'}, {"_message": '{"x":"é"}'}, {"_message": '[{"x":1}]'}, {"_message": '{"x":-3.25}'},
]
LEAVES = [
    "x", 'x = ""', 'x != "x"', "x = 0", "x = 500", 'x = "500"', "x != 500", "x = true", "x != true", "x > true", "x < false", "x >= false", "x < 10", "x <= 5", "x > -5", "x >= 500", 'x < "5"', 'x >= "a"', 'x : "5"', 'x : ""', "x : 1.5",
    "x =~ /^[0-9]+$/", "x !~ /e/", "x.y", 'x.y = "z"', 'a["x"] = "deep"', "stdout", 'stderr = ""', 'stdout : "text"', '_namespace = "prod"', '_namespace != "prod"', "_namespace", '_namespace =~ "^p"', "label.app", 'label.app != "web"', '_message = ""',
    "_ts > 1", "_ts < 5.5", "x : true", "x = 1e21", 'x = "1000000000000000000000"', 'x = "0.000001"', 'x = "1.5"',
]


def test_leaves_against_plain_evaluation(spark):
    df = frame(spark, ROWS)
    both = LEAVES + [f"not {q}" for q in LEAVES]
    got = df.select("id", *[truth(q, df).alias(f"q{i}") for i, q in enumerate(both)]).orderBy("id").collect()
    for i, q in enumerate(both):
        assert [r[f"q{i}"] for r in got] == expected(ROWS, q), q


def test_trees_against_plain_evaluation(spark):
    rng = random.Random(7)

    def tree(depth):
        kind = rng.choice(["leaf", "and", "or", "not"]) if depth else "leaf"
        if kind == "leaf":
            return rng.choice(LEAVES)
        if kind == "not":
            return f"not ({tree(depth - 1)})"
        return f"({tree(depth - 1)}) {kind} ({tree(depth - 1)})"

    queries = [tree(3) for _ in range(40)]
    df = frame(spark, ROWS)
    got = df.select("id", *[truth(q, df).alias(f"q{i}") for i, q in enumerate(queries)]).orderBy("id").collect()
    kept = {i: {r["id"] for r in df.where(predicate(q, df)).select("id").collect()} for i, q in enumerate(queries[:6])}
    for i, q in enumerate(queries):
        want = expected(ROWS, q)
        assert [r[f"q{i}"] for r in got] == want, q
        if i in kept:
            assert kept[i] == {k for k, x in enumerate(want) if x}, q


@pytest.mark.parametrize("x", [0.0, -0.0, 1.0, 500.0, 1.5, 1e21, 1.25e-7, 123456789.125, -2.5e30, 2.0**53, 1e-5, 12345678.9])
def test_numbers_as_text(spark, x):
    assert spark.range(1).select(text_of_number(F.lit(x)).alias("t")).first()["t"] == plain_number(x)


def test_texts_as_numbers(spark):
    texts = ["5", " 5 ", "\t5", "1d", "0x10", "1_0", "1e3", "1e999", "nan", "inf", "-Infinity", "", ".5", "5.", "+7", "٣"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r["n"] for r in df.select("i", number_of(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [5, 5, 5, None, None, None, 1000, None, None, float("inf"), float("-inf"), None, 0.5, 5, 7, None]


PATTERNS = [r"^a$", r"\bb", r"[[:alpha:]]+-[[:digit:]]", r"(?P<n>x)y", r"a.c", r"(?i)ABC", r"[[a]", r"\s", r"\v", r"(?U)a+b", r"a{2,3}", r"[^\d]z", r"\Qa.b\E", r"[a&&b]", r"x*", r"(?m)^b$", r"[\w-]+@", r"\pL+\x{41}", r"é\b", r"[]a]", r"a|b$", r"(?s:a.c)", r"\D\W\S"]
TEXTS = ["a", "a\n", "éb", "ab-1", "xy", "a\nc", "abc", "[", "\x0b", "aaab", "aa", "7z", "qz", "a.b", "axb", "&", "", "a\nb", "joe-x@", "éA", "é", "]", "b\n", " .x"]


def test_patterns_mean_what_re2_means(spark):
    import duckdb

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    got = df.select("i", *[F.col("t").rlike(to_java(p)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).orderBy("i").collect()
    for k, p in enumerate(PATTERNS):
        want = [duckdb.execute("select regexp_matches(?, ?)", [t, p]).fetchone()[0] for t in TEXTS]
        assert [r[f"p{k}"] for r in got] == want, p


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "a++", "(?>a)", "a{1001}", "[", "(", ")", "*a", "a**", "\\", "[z-a]", "(?P<n", r"[[:nope:]]"])
def test_refused_patterns(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)


def test_outcomes_helper_matches(spark):
    assert outcomes(spark, [ONE], "status = 500") == [True]
