import random

import pytest
from pyspark.sql import functions as F

from litspark.llm import splitting as S


def cut(spark, texts, limit=200, overlap=20):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = [[] for _ in texts]
    for r in S.split_items(df, F.col("text"), limit, overlap).orderBy("id", "no").collect():
        out[r["id"]].append((r["start"], r["piece"], r["of"]))
    return out


def check(text, pieces, limit, overlap):
    whole, to = "", 0
    for i, (start, piece, of) in enumerate(pieces):
        assert len(piece) <= limit and of == len(pieces) and text[start : start + len(piece)] == piece
        assert i == 0 or start == to - overlap
        whole += piece[overlap if i else 0 :]
        to = start + len(piece)
    assert whole == text


def test_round_trip_of_random_texts(spark):
    draw = random.Random(4)
    parts = ["word", " ", " ", ". ", "\n", "\n\n", "\r\n", ", ", "ü", "语言", "。", "😀", "é", "x" * 90, " ", "  "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(0, 400))) for _ in range(120)]
    for limit, overlap in ((200, 20), (50, 0), (64, 31)):
        for t, p in zip(texts, cut(spark, texts, limit, overlap)):
            check(t, p, limit, overlap)


def test_boundaries_by_strength(spark):
    first = lambda t: cut(spark, [t])[0][0][1]
    tail = " tail" * 60
    assert first("a" * 120 + "\n\n" + "b" * 30 + ". " + "c c " * 9 + "\n" + tail).endswith("a\n\n")
    assert first("a" * 120 + ". " + "b" * 20 + "\n" + "c " * 9 + tail).endswith("b\n")
    assert first("a" * 120 + ". B" + "b " * 9 + ", " + tail).endswith("a. ")
    assert first("a" * 120 + ", b" + "b " * 9 + tail.replace(" ", "x")).endswith(", ")
    assert first("a" * 150 + " " + "b" * 400).endswith("a ")
    assert first("y" * 500) == "y" * 200
    assert first("\n\n" + "y" * 500) == "\n\n" + "y" * 198


def test_composed_characters_stay_whole(spark):
    text = "x" * 199 + "é" + "y" * 300
    assert cut(spark, [text])[0][0][1] == "x" * 199


def test_limits(spark):
    a, b = cut(spark, ["z" * 200, "z" * 201])
    assert [len(p[1]) for p in a] == [200] and [len(p[1]) for p in b] == [200, 21]
    with pytest.raises(ValueError, match="overlap"):
        S.pieces(F.col("text"), 100, 50)


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, 1, "p"), ("", 2, "q"), ("same", 3, "r"), ("same", 3, "r")], "text string, no int, piece string")
    got = S.split_items(df, F.col("text"), 100, 10)
    assert got.columns == ["text", "of", "no", "start", "piece"]
    assert sorted(map(tuple, got.collect())) == [("", 1, 0, 0, ""), ("same", 1, 0, 0, "same"), ("same", 1, 0, 0, "same")]
    assert S.split_items(df.limit(0), F.col("text"), 100, 10).count() == 0


def test_very_long_text(spark):
    text = "".join(f"Sentence number {i} of many. " for i in range(40_000))
    df = spark.createDataFrame([(text,)], "text string")
    got = S.split_items(df, F.col("text")).orderBy("no").collect()
    check(text, [(r["start"], r["piece"], r["of"]) for r in got], S.LIMIT, S.OVERLAP)
    assert all(r["piece"].endswith(". ") for r in got)


def test_item(spark):
    df = spark.createDataFrame([("h", "t"), (None, "t"), ("h", None)], "h string, t string")
    assert [r[0] for r in df.select(S.item(F.col("h"), F.col("t"))).collect()] == ["h\n\nt", "\n\nt", None]
