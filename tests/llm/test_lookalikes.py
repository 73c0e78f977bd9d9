import pytest

from litspark.llm import lookalikes as L


@pytest.mark.parametrize(("text", "want"), [
    ("Ｆｕｌｌ　ｗｉｄｔｈ！", "Full width!"),
    ("ﬁne ﬂow", "fine flow"),
    ("𝐁𝐨𝐥𝐝", "Bold"),
    ("naïve café", "naïve café"),
    ("zero​width so­ft ﻿mark", "zerowidth soft mark"),
    ("a b c\td", "a b c d"),
    ("e​́", "é"),
    ("line\nfeed", "line\nfeed"),
    ("", ""),
    ("x² ½ …", "x² ½ …"),
])
def test_plain(text, want):
    assert L.plain(text) == want


def test_mixed_words_take_the_alphabet_of_their_own_letters():
    assert L.first_pass("frоm the grаph")[0] == "from the graph"
    assert L.first_pass("это отвeты")[0] == "это ответы"
    assert L.first_pass("τουλάχιστον oι λόγοι")[0] == "τουλάχιστον οι λόγοι"


@pytest.mark.parametrize(("text", "want"), [
    ("\u0555pen", "Open"), ("\u2c9fpen", "open"), ("\u1d00bc", "abc"), ("\u13aapple", "Apple"), ("\u0131stanbul is big in its ring", "istanbul is big in its ring"),
    ("\ua4d0right", "Bright"), ("\u13aa\u0440\u0440le", "Apple"), ("мblсль и слова", "мысль и слова"), ("\u1d04\u1d00\u1d18s", "caps"),
])
def test_letters_of_many_alphabets(text, want):
    assert L.first_pass(text)[0] == want


def test_frequencies_decide_between_letters_of_one_alphabet():
    at = L.contested()
    assert "У" in at and "Ү" in at
    counts = tuple(9 if c == "Ү" else 1 for c in at)
    assert L.letters()[1]["C"]["Y"] == "У" and L.letters(counts)[1]["C"]["Y"] == "Ү"


@pytest.mark.parametrize("text", ["Թե ոչ հող", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ılık su ve ağaç", "[kʌt] and [kɪt]", "ⲛⲟⲩⲧⲉ in Coptic", "a barn, not a bam"])
def test_genuine_words_of_many_alphabets_stay(text):
    assert L.first_pass(text)[0] == text


def test_genuine_words_and_symbols_stay():
    text = "The word данные and symbols μ, λ, β, 5 μm, naïve Größe"
    assert L.first_pass(text)[0] == text


def test_classes_are_transitive():
    u = L.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        u.join(a, b)
    assert sorted(map(sorted, u.classes().values())) == [["a", "b", "c", "d"], ["x", "y"]]
    inside = L.letters()[1]
    assert inside["L"]["Α"] == inside["L"]["А"] == "A" and inside["C"]["Α"] == "А"


ROWS = [
    (1, "the essays on space and coca", "x"),
    (2, "two essays of the same", "x"),
    (3, "the еѕѕауѕ here are words", "x"),  # all letters replaced
    (4, "это сосна и оса, а не оса", "x"),
    (5, "это оса и a она", "x"),  # a Latin letter stands for the word а
    (6, "the Russian word оса in an English text", "x"),
    (7, None, "x"),
    (8, "", None),
    (9, "а не", "x"),
]


def test_whole_words_follow_the_frequent_spelling(spark):
    df = spark.createDataFrame(ROWS, "id int, text string, normal string")
    got = {r["id"]: r["normal"] for r in L.consistent_form(df, ["id"], "text").collect()}
    assert got[3] == "the essays here are words"
    assert got[5] == "это оса и а она"
    assert got[6] == ROWS[5][1] and got[4] == ROWS[3][1]
    assert got[7] is None and got[8] == "" and len(got) == 9


def test_empty_table_repeated_rows_and_long_text(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert L.consistent_form(df, ["id"], "text").count() == 0
    long = "frоm " * 50_000
    df = spark.createDataFrame([(1, long), (1, long), (None, "ａ")], "id int, text string")
    got = [r["normal"] for r in L.consistent_form(df, ["id"], "text").collect()]
    assert sorted(got) == sorted(["from " * 50_000] * 2 + ["a"])
