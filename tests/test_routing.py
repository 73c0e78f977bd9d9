from litspark.operators.routing import route

PAPERS = "arxiv_id string, title string, abstract string"


def test_several_domains_in_order(spark):
    df = spark.createDataFrame([("a", "Seismic wave agent", "An autonomous agent studies geological rock physics"), ("b", None, None)], PAPERS)
    got = [(r["cell"], r["hits"], r["score"], r["rationale"], r["place"]) for r in route(df).collect()]
    assert got == [
        ("geology", 3, 0.7999999999999999, "keyword hits: 3", 1),
        ("physics", 2, 0.6499999999999999, "keyword hits: 2", 2),
        ("ai_agents", 2, 0.6499999999999999, "keyword hits: 2", 3),
    ]


def test_other_domains_and_the_highest_score(spark):
    words = [f"w{i}" for i in range(9)]
    df = spark.createDataFrame([("a", " ".join(words), None)], PAPERS)
    assert [(r["cell"], r["score"]) for r in route(df, {"x": words, "y": ("nothing",)}).collect()] == [("x", 1.0)]


def test_empty_domains_mean_the_default_ones(spark):
    df = spark.createDataFrame([("a", "polymer", None)], PAPERS)
    assert [r["cell"] for r in route(df, {}).collect()] == ["chemistry"]
