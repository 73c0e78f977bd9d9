import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import mixing as M


def test_raking_meets_margins():
    draw = np.random.default_rng(2)
    tokens = draw.integers(50, 900, 24).astype(float)
    a, b = np.arange(24) % 4, np.arange(24) // 4 % 3
    wa, wb = np.array([4000.0, 3000, 2000, 1000]), np.array([5000.0, 3000, 2000])
    x = M.rake(tokens, [(a, wa), (b, wb)], np.full(24, 1e9))
    assert np.bincount(a, x) == pytest.approx(wa, rel=1e-6) and np.bincount(b, x) == pytest.approx(wb, rel=1e-3)


def test_caps_hold_and_the_rest_of_a_source_makes_up():
    tokens = np.array([100.0, 100, 100])
    of = np.zeros(3, dtype=int)
    x = M.rake(tokens, [(of, np.array([550.0])), (np.arange(3), np.array([500.0, 30, 20]))], tokens * 2)
    assert (x <= 200 + 1e-9).all() and x.sum() == pytest.approx(550)
    assert M.rake(tokens, [(of, np.array([900.0]))], tokens * 2).sum() == pytest.approx(600)


def test_misses_are_reported():
    tokens = np.array([100.0, 100, 100])
    of = np.zeros(3, dtype=int)
    x, rounds, miss = M.fitted(tokens, [(of, np.array([300.0])), (np.arange(3), np.array([100.0, 150, 50]))], tokens * 3)
    assert rounds < 10 and miss < 1e-6 and x == pytest.approx([100, 150, 50])
    x, _, miss = M.fitted(tokens, [(of, np.array([900.0]))], tokens * 2)
    assert x.sum() == pytest.approx(600) and miss == pytest.approx(1 / 3)


@pytest.fixture(scope="module")
def docs(spark):
    n = F.pmod(F.hash("id"), F.lit(90)) + 10
    source = F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small")
    return spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 97 != 0, source).alias("source"), F.when(F.col("id") % 3 == 0, "EN").when(F.col("id") % 3 == 1, "de").alias("lang"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 40).alias("collection_id"), F.repeat(F.lit("w "), n.cast("int")).alias("text"),
    )


TARGETS = [(1, "big", 0.2, 1), (1, "mid", 0.5, 4), (1, "small", 0.3, 8), (2, "big", 0.5, 1), (2, "small", 0.4, 3), (2, "gone", 0.1, 5)]


def test_shares_are_reached(spark, docs):
    sized = M.sized(docs)
    targets = spark.createDataFrame([*TARGETS, TARGETS[0], (3, None, 0.5, 1)], "mix_id int, source string, target_weight double, max_repeats int")
    weights = M.calibrated(M.cells_of(sized), targets)
    got = M.taken(sized, weights)
    assert got.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    total = sized.agg(F.sum("tokens")).first()[0]
    x = {(r[0], r[1]): (r[2], r[3]) for r in got.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")), F.max("repeats")).collect()}
    available = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("tokens")).collect()}
    assert (2, "gone") not in x and len(x) == 5
    for (mix, source), (tokens, most) in x.items():
        weight, cap = next((w, c) for m, s, w, c in TARGETS if (m, s) == (mix, source))
        assert most <= cap and tokens == pytest.approx(min(weight * total, available[source] * cap), rel=0.06)
    again = M.taken(M.sized(docs.repartition(7)), weights)
    assert again.exceptAll(got.select(again.columns)).count() == 0


def test_edge_cases(spark, docs):
    targets = spark.createDataFrame([(1, "big", None, None)], "mix_id int, source string, target_weight double, max_repeats int")
    sized = M.sized(docs.withColumn("text", F.lit(None).cast("string")))
    assert M.taken(sized, M.calibrated(M.cells_of(sized), targets)).count() == 0
    assert M.calibrated(M.cells_of(sized.limit(0)), targets).count() == 0
    assert {r["language"] for r in M.sized(docs).select("language").distinct().collect()} == {"en", "de", "other"}
