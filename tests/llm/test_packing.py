import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import packing as P


def test_pack_respects_all_limits():
    draw = np.random.default_rng(3)
    sizes = np.column_stack([draw.integers(0, 900, 800), np.ones(800), draw.integers(0, 500, 800)]).astype(float)
    limits = np.array([1024.0, 8.0, 600.0])
    box = P.pack(sizes, limits)
    assert box.min() == 0
    for i in range(3):
        assert (np.bincount(box, sizes[:, i]) <= limits[i]).all()
    need = max(sizes[:, 0].sum() / 1024, sizes[:, 2].sum() / 600, 100)
    assert box.max() + 1 <= 1.1 * need


def test_oversized_item_is_refused():
    with pytest.raises(ValueError, match="exceeds"):
        P.pack(np.array([[2.0, 1.0, 0.0]]), np.array([1.0, 1.0, 1.0]))


def test_documents(spark):
    texts = ["w " * n for n in (10, 500, 600, 1024, 1025, 3000, 30, 2)] + ["", None, "!? " * 40]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, container string").coalesce(1)
    rows = P.packed(df, "doc_id", "text").collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["id"], []).append(r["tokens"])
    assert {k: sorted(v) for k, v in parts.items()} == {
        0: [10], 1: [500], 2: [600], 3: [1024], 4: [1, 1024], 5: [952, 1024, 1024], 6: [30], 7: [2], 8: [0], 9: [0], 10: [40],
    }
    fill = {}
    for r in rows:
        assert r["loss"] <= r["tokens"]
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 1024 and len(fill) == 7


def test_little_space_is_left(spark):
    df = spark.range(30_000).select("id", F.repeat(F.lit("w "), (F.pmod(F.hash("id"), F.lit(380)) + 5).cast("int")).alias("text")).repartition(3)
    r = P.packed(df, "id", "text").agg(F.sum("tokens"), F.count_distinct("container"), F.count("*"), F.count_distinct("id")).first()
    assert r[2] == r[3] == 30_000 and r[0] / 1024 / r[1] > 0.98


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_fill_does_not_depend_on_the_split(spark, parts):
    df = spark.range(4000).select("id", F.repeat(F.lit("w "), (F.pmod(F.hash("id"), F.lit(640)) + 5).cast("int")).alias("text")).repartition(parts)
    rows = P.packed(df, "id", "text")
    r = rows.agg(F.sum("tokens"), F.count_distinct("container"), F.count("*"), F.count_distinct("id")).first()
    assert r[2] == r[3] == 4000 and r[0] / 1024 / r[1] > 0.98
    assert rows.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).where("t > 1024 OR n > 32").count() == 0


def test_items_that_fill_no_container_end_in_some(spark):
    df = spark.range(500).select("id", F.repeat(F.lit("w "), F.lit(600)).alias("text")).repartition(9)
    assert P.packed(df, "id", "text").agg(F.count_distinct("container"), F.count("*")).first() == (500, 500)


def test_pairs_under_a_loss_limit(spark):
    df = spark.createDataFrame([(i, "p " * 30, "r " * n) for i, n in enumerate((10, 60, 90, 100, 250))], "id long, p string, r string").coalesce(1)
    rows = P.packed_pairs(df, "id", "p", "r", (400, 3, 100)).collect()
    by = {}
    for r in rows:
        x = by.setdefault(r["container"], [0, 0, 0])
        x[0] += r["tokens"]
        x[1] += 1
        x[2] += r["loss"]
    assert all(a <= 400 and b <= 3 and c <= 100 for a, b, c in by.values())
    assert sum(r["tokens"] for r in rows) == 150 + 510 and {r["id"] for r in rows if r["parts"] > 1} == {4}
    assert sum(r["loss"] for r in rows) == 510


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert P.packed(df, "id", "text").count() == 0
