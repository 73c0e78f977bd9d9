import random

import pytest

from litspark.llm import common as C
from litspark.llm.common import bounded_sample, connected_components, cut, small, token_count
from pyspark.sql import functions as F


def test_components_of_random_graphs(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(70)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def test_a_star_and_an_empty_graph(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(None, 1)], "a long, b long")
    got = connected_components(star)
    assert got.count() == 3000 and got.select("component").distinct().count() == 1
    assert connected_components(star.limit(0)).count() == 0


def test_bounded_sample(spark):
    df = spark.range(50_000).withColumn("id", F.col("id").cast("string"))
    a, b = (sorted(r[0] for r in bounded_sample(df.repartition(n), "id", 500).collect()) for n in (2, 7))
    assert len(a) == 500 and a == b
    assert bounded_sample(df.limit(10), "id", 500).count() == 10


def test_tokens(spark):
    rows = [("don't stop -- now_1", 6), ("данные: 42%", 4), (None, 0), ("", 0), (" \n\t ", 0), ("naïve²", 1)]
    df = spark.createDataFrame(rows, "t string, n long")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [n for _, n in rows]


def test_cut_is_a_reliable_checkpoint(spark):
    assert cut(spark.range(3)).count() == 3


def test_only_small_sides_are_broadcast(spark):
    plan = lambda most: spark.range(9).join(small(spark.range(5), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(1000) and "broadcast" not in plan(10)
    assert small(spark.range(0)).count() == 0


def test_pairs_within_blocks_meet_once(spark):
    from itertools import combinations

    draw = random.Random(3)
    rows = sorted({(draw.randrange(4) if draw.random() < 0.7 else 99, draw.randrange(60)) for _ in range(300)})
    blocks = {}
    for b, k in rows:
        blocks.setdefault(b, []).append(k)
    want = sorted(p for ks in blocks.values() for p in combinations(sorted(ks), 2))
    df = spark.createDataFrame(rows, "block int, k int")
    for chunk in (1, 7, 1000):
        assert sorted((r["a"], r["b"]) for r in C.pairs_within(df, "block", "k", chunk).collect()) == want


def test_kept_rows_are_the_same(spark):
    df = spark.createDataFrame([(1, "x", [1.5]), (None, None, None)], "a int, b string, c array<double>")
    got = C.kept(df)
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert C.kept(df.limit(0)).count() == 0


def test_a_cluster_needs_a_checkpoint_folder():
    class Session:
        class sparkContext:
            master = "local-cluster[3,2,3000]"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.ensure_checkpoint_dir(Session)


def test_components_raise_rather_than_stop_early(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="converge"):
        C.connected_components(df, max_rounds=1)
