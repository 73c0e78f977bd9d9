import random
from itertools import combinations

import numpy as np
import pytest

from litspark.llm import nearcopies as N


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [[draw.choice(words) for _ in range(draw.randrange(20, 60))] for _ in range(n)]
    for _ in range(n):
        t = list(draw.choice(texts))
        for _ in range(draw.randrange(0, 4)):
            t[draw.randrange(len(t))] = draw.choice(words)
        if draw.random() < 0.3:
            t.insert(draw.randrange(len(t)), draw.choice(words))
        texts.append(t)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def brute(texts, words, least):
    s = {k: set(N.shingles_of(t, words).tolist()) for k, t in texts.items()}
    return {(a, b) for a, b in combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) >= least * len(s[a] | s[b])}


def expanded(members, links):
    of = {}
    for r in members.collect():
        of.setdefault(r["sid"], []).append(r["k"])
    out = {tuple(sorted((a, b))) for r in links.collect() for a in of[r["a"]] for b in of[r["b"]]}
    return out | {p for ks in of.values() for p in combinations(sorted(ks), 2)}


def test_all_pairs_above_the_threshold(spark):
    texts = corpus(150, 1)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    for words, least in ((3, 0.5), (5, 0.8)):
        assert expanded(*N.near_copies(df, "id", "text", words, least)) == brute(texts, words, least)


def test_hot_variants_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 2)
    texts = corpus(60, 2)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert expanded(*N.near_copies(df, "id", "text", 3, 0.5)) == brute(texts, 3, 0.5)


def test_signatures_that_differ_little_share_a_variant():
    draw = random.Random(4)
    for _ in range(200):
        a = np.array(sorted({draw.getrandbits(64) for _ in range(40)}), dtype=np.uint64)
        keep = a[: draw.randrange(25, 40)]
        if len(keep) / len(a) >= 0.8:
            assert set(N.variants_of(a)) & set(N.variants_of(keep))


def test_edge_cases(spark):
    rows = [("a", "one two three four"), ("b", "One, two -- THREE four!"), ("c", None), ("d", ""), ("e", "too short"), ("f", "x " * 60_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "k string, t string, sid int")
    members, links = N.near_copies(df, "k", "t", 3, 0.5)
    got = {r["k"]: r["sid"] for r in members.collect()}
    assert set(got) == {"a", "b", "f"} and got["a"] == got["b"] and links.count() == 0
    g = {r["k"]: (r["group"], r["links"]) for r in N.groups(members, links).collect()}
    assert g["a"] == g["b"] and g["a"][1] == 0
    members, links = N.near_copies(df.limit(0), "k", "t")
    assert members.count() == links.count() == N.groups(members, links).count() == 0


def test_groups_are_components(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [base, base[:-6] + ["x"] * 6, base[:-12] + ["y"] * 12, ["z%d" % i for i in range(30)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    got = {r["k"]: r["group"] for r in N.groups(*N.near_copies(df, "id", "text", 3, 0.7)).collect()}
    assert got[0] == got[1] == got[2] != got[3]


def grouped(parts):
    out = {}
    for r in parts.collect():
        out.setdefault(r["component"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("hot", [48, 3])
def test_groups_without_all_pairs_are_the_components_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT", hot)
    texts = corpus(80, 5)
    draw = random.Random(6)
    template = [f"t{i}" for i in range(90)]
    for i in range(120):  # variants of one template, some of them near its edge
        t = list(template)
        for _ in range(draw.randrange(0, 16)):
            t[draw.randrange(90)] = f"e{draw.randrange(10**6)}"
        texts[1000 + i] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    sketches = N.cut(N.sketch(df, "id", "text", 3))
    assert grouped(N.similar_groups(sketches, 0.5)) == grouped(N.connected_components(N.similar_classes(sketches, 0.5)))


def test_many_variants_of_one_template_make_one_group(spark, monkeypatch):
    draw = random.Random(7)
    template, compared = [f"t{i}" for i in range(60)], []
    texts = {i: " ".join(f"e{i}" if k == draw.randrange(60) else w for k, w in enumerate(template)) for i in range(3000)}
    check = N.verified
    monkeypatch.setattr(N, "verified", lambda c, t, s: check(compared.append(c.distinct().count()) or c, t, s))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    parts = N.similar_groups(N.cut(N.sketch(df, "id", "text", 3)), 0.5)
    assert parts.select("component").distinct().count() == 1 and parts.count() > 1500
    assert sum(compared) < 40 * 3000  # not 4,500,000
