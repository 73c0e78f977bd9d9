import math

from pyspark.sql import functions as F

from litspark.functions import text as T


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_collapse_takes_every_blank(spark):
    assert one(spark, T.collapse, " a\t\n b\x1c　c ") == "a b c"
    assert one(spark, T.collapse, None) == ""


def test_clean(spark):
    assert one(spark, T.clean, " \\uselogo a\n\n\n\nb \n") == "a\n\nb"


def test_ids(spark):
    for link, key in {
        "http://x/abs/2608.1v2": "2608.1", "http://x/abs/2608.1/": "2608.1", "http://x/hep-th/9901001v1": "9901001v1", "2608.12345": "2608.12345",
    }.items():
        assert one(spark, T.paper_id, link) == key


def test_terms_keep_order_and_repeats(spark):
    assert one(spark, T.terms, "Memory of AI-agents: memory, ёжик Сеть of") == ["memory", "ai-agents", "memory", "жик", "сеть"]
    assert one(spark, T.terms, "is it ok") == []
    assert one(spark, T.terms, None) == []


def test_score_counts_substrings_of_repeated_terms(spark):
    assert one(spark, lambda c: T.score(c, ["agent", "agent", "aa"]), "agentic agents aaa") == 5


def test_tokens(spark):
    assert [one(spark, T.tokens, "x" * n) for n in (0, 3, 4, 32, 513)] == [1, 1, 1, 10, 160]


def test_clamp(spark):
    got = [one(spark, T.clamp, v) for v in ("0.7", None, "1.7", "-1", "high", "NaN")]
    assert got == [0.7, 0.5, 1.0, 0.0, 0.5, 1.0]
    assert not math.isnan(got[-1])


def test_prune(spark):
    assert one(spark, T.prune, "a" * 6000) == "a" * 6000
    got = one(spark, T.prune, "a" * 3500 + "b" * 1001 + "c" * 1500)
    assert got.startswith("a" * 3500 + "\n\n[... 1001 characters omitted") and got.endswith("]\n\n" + "c" * 1500)


def test_section_score(spark):
    df = spark.createDataFrame([("Methodology", False), ("Results and Discussion", True), (None, False)], "h string, f boolean")
    assert [r[0] for r in df.select(T.section_score(F.col("h"), F.col("f"))).collect()] == [20, 22, 0]


def test_dates(spark):
    df = spark.createDataFrame([("2026-08-20T00:00:00Z",), ("",), (None,)], "p string")
    keep = lambda a, b: [r[0] for r in df.select(T.in_dates(F.col("p"), a, b)).collect()]
    assert keep("2026-08-20", "2026-08-20") == [True, False, False]
    assert keep("2026-08-01", None) == [True, False, False]
    assert keep(None, "2026-08-19") == [False, True, True]
    assert keep(None, None) == [True, True, True]


def test_feed_query(spark):
    df = spark.createDataFrame([('graph "nets"', "2026-01-02", "2026-02-03"), ("x", "2026-01-02", None)], "k string, a string, b string")
    got = [r[0] for r in df.select(T.feed_query(F.col("k"), F.col("a"), F.col("b"))).collect()]
    assert got == ['all:"graph nets" AND submittedDate:[202601020000 TO 202602032359]', 'all:"x"']
