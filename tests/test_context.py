import random

from pyspark.sql import functions as F

from litspark.functions import context as C

BLOCKS = "b array<struct<name:string,text:string,priority:int,required:boolean>>"


def pack(spark, blocks, budget):
    r = spark.createDataFrame([(blocks,)], BLOCKS).select(C.pack(F.col("b"), budget).alias("f")).first()["f"]
    return r["text"], r["names"], r["used"]


def model(blocks, budget):
    used, names, text = 0, [], ""
    for n, t, p, r in sorted(blocks, key=lambda b: (not b[3], -b[2])):
        part = f"\n\n[{n}]\n{t.strip()}"
        cost = max(1, int(len(part) / 3.2))
        if r or used + cost <= budget:
            used, names, text = used + cost, [*names, n], text + part
    return text.strip(), names, used


def test_optional_block_that_does_not_fit_is_left_out(spark):
    text, names, used = pack(spark, [("required", "x" * 500, 100, True), ("optional", "y" * 5000, 10, False)], C.input_budget(1000, 200))
    assert names == ["required"] and used == 160 and text == "[required]\n" + "x" * 500


def test_later_blocks_are_tried_after_one_that_does_not_fit(spark):
    size = lambda tokens: "x" * int(tokens * 3.2 - 5)
    _, names, used = pack(spark, [("a", size(900), 1, True), ("b", size(500), 9, False), ("c", size(50), 8, False)], 1000)
    assert names == ["a", "c"] and used <= 1000


def test_required_blocks_may_exceed_the_budget(spark):
    assert pack(spark, [("a", "x" * 9000, 1, True), ("b", "", 2, False)], 1000)[1] == ["a"]


def test_random_blocks_equal_a_plain_model(spark):
    draw = random.Random(3)
    cases = [
        [(f"n{i}", " " + "z" * draw.randrange(0, 900), draw.randrange(3), draw.random() < 0.3) for i in range(draw.randrange(1, 8))] for _ in range(60)
    ]
    df = spark.createDataFrame([(c,) for c in cases], BLOCKS).coalesce(1)
    got = [(r["f"]["text"], r["f"]["names"], r["f"]["used"]) for r in df.select(C.pack(F.col("b"), 300).alias("f")).collect()]
    assert got == [model(c, 300) for c in cases]


def test_budget():
    assert C.input_budget(1000, 200) == 1000 and C.input_budget() == 6500
