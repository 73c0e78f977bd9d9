import random

import numpy as np
import pytest

from litspark.llm import spans as S

LETTERS = "abcdefgh "


def records(n, seed):
    draw = random.Random(seed)
    text = lambda k: "".join(draw.choice(LETTERS) for _ in range(k))
    passages = [text(draw.choice((70, 99, 100, 101, 180))) for _ in range(12)]
    out = {}
    for i in range(n):
        t = text(draw.randrange(20, 300))
        if draw.random() < 0.5:
            at = draw.randrange(len(t))
            t = t[:at] + draw.choice(passages) + t[at:]
        out[f"r{i:03d}"] = t
    out["periodic1"], out["periodic2"], out["own"] = "ab" * 90, "x" + "ba" * 80, (p := text(120)) + text(30) + p
    return out


def covered(texts, span):
    where = {}
    for k, t in texts.items():
        for i in range(len(t) - span + 1):
            where.setdefault(t[i : i + span], set()).add(k)
    return {k: {x for i in range(len(t) - span + 1) if len(where[t[i : i + span]]) > 1 for x in range(i, i + span)} for k, t in texts.items()}


@pytest.mark.parametrize("hot", [24, 1])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = records(90, 6)
    df = spark.createDataFrame(list(texts.items()), "rid string, text string")
    found = S.shared_passages(df)
    want = {k: len(v) for k, v in covered(texts, S.SPAN).items()}
    assert {r["rid"] for r in found.where("exact").collect()} == {k for k, n in want.items() if n}
    assert {r["rid"]: r["shared"] for r in S.overlap(df, found).collect()} == want
    for r in found.where("exact AND other IS NOT NULL").collect():
        assert texts[r["rid"]][r["start"] : r["end"]] == texts[r["other"]][r["o_start"] : r["o_end"]]


def test_every_span_has_a_seed():
    draw = random.Random(8)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(90, 400))) for _ in range(30)]
    of, pos, _ = S.seeds(texts)
    at = [sorted(pos[of == i].tolist()) for i in range(len(texts))]
    for i, t in enumerate(texts):
        for a in range(len(t) - S.SPAN + 1):
            assert any(a <= p <= a + S.SPAN - S.K for p in at[i])


def test_same_window_same_hash():
    codes = np.array([ord(c) for c in "xyz" + "hello world" * 2], dtype=np.uint32)
    h = S.hashes(codes, 11)
    assert h[3] == h[14] and len(set(h.tolist())) == len(h) - 1


def test_sliding():
    x = np.random.default_rng(1).integers(0, 99, 57)
    for w in (1, 4, 57):
        assert S.sliding(x, w, True).tolist() == [min(x[i : i + w]) for i in range(57 - w + 1)]
        assert S.sliding(x, w, False).tolist() == [max(x[i : i + w]) for i in range(57 - w + 1)]


def best_chain(matches, k, gap):
    m, score = sorted(matches), []
    for i, (a, b) in enumerate(m):
        top = 0.0
        for j in range(i):
            if m[j][0] < a and m[j][1] < b:
                top = max(top, score[j] - gap * (a - m[j][0] + b - m[j][1]) - max(0, k - min(a - m[j][0], b - m[j][1])))
        score.append(k + top)
    return max(score)


def test_chains_are_in_order_and_far_ones_apart():
    matches = [(0, 100), (50, 150), (100, 205), (5000, 9000), (5050, 9050)]
    assert S.chains(matches, 40, 0.25) == [[(0, 100), (50, 150), (100, 205)], [(5000, 9000), (5050, 9050)]]
    draw = random.Random(2)
    for _ in range(50):
        m = list({(draw.randrange(400), draw.randrange(400)) for _ in range(12)})
        got = S.chains(m, 40, 0.25)
        assert sorted(x for c in got for x in c) == sorted(m)
        assert all(p[0] < q[0] and p[1] < q[1] for c in got for p, q in zip(c, c[1:]))


def test_fuzzy_passage(spark):
    draw = random.Random(9)
    p = "".join(draw.choice(LETTERS) for _ in range(400))
    df = spark.createDataFrame([("a", "k" * 30 + p), ("b", p[:200] + "#" + p[201:] + "l" * 25)], "rid string, text string")
    got = sorted((r["rid"], r["start"], r["end"], r["o_start"], r["o_end"], r["exact"], r["edits"]) for r in S.shared_passages(df).collect())
    assert got == [
        ("a", 30, 230, 0, 200, True, 0), ("a", 30, 430, 0, 400, False, 1), ("a", 231, 430, 201, 400, True, 0),
        ("b", 0, 200, 30, 230, True, 0), ("b", 0, 400, 30, 430, False, 1), ("b", 201, 400, 231, 430, True, 0),
    ]


def test_edge_cases(spark):
    draw = random.Random(3)
    long = "".join(draw.choice(LETTERS) for _ in range(120_000))
    df = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", "short", 1), ("d", long, 1), ("e", long[5:], 1)], "rid string, text string, h int")
    found = S.shared_passages(df)
    got = {r["rid"]: (r["shared"], r["share"]) for r in S.overlap(df, found).collect()}
    assert got == {"a": (0, 0.0), "b": (0, 0.0), "c": (0, 0.0), "d": (119_995, 119_995 / 120_000), "e": (119_995, 1.0)}
    assert S.shared_passages(df.limit(0)).count() == 0


def test_popular_passages_have_partners_and_fuzzy_passages(spark):
    draw = random.Random(4)
    text = lambda k: "".join(draw.choice(LETTERS) for _ in range(k))
    p = text(300)
    texts = {f"r{i:02d}": text(20 + i) + p + text(20) for i in range(S.HOT + 6)}
    texts["x"] = p[:150] + "#" + p[151:]
    df = spark.createDataFrame(list(texts.items()), "rid string, text string")
    found = S.shared_passages(df, pair_all=True).collect()
    pairs = {(a, b) for a in texts for b in texts if a != b}
    assert {(r["rid"], r["other"]) for r in found if r["exact"]} == pairs
    assert {(r["rid"], r["other"]) for r in found if not r["exact"]} == {x for x in pairs if "x" in x}
    assert all(r["edits"] == 1 for r in found if not r["exact"])
    assert all(r["end"] - r["start"] >= 300 for r in found if r["exact"] and "x" not in (r["rid"], r["other"]))


def test_chunks_of_popular_seeds_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(list(records(60, 5).items()), "rid string, text string")
    want = sorted(map(str, S.shared_passages(df, pair_all=True).collect()))
    monkeypatch.setattr(S, "HOT", 2)
    assert sorted(map(str, S.shared_passages(df, pair_all=True).collect())) == want


@pytest.mark.parametrize("n", [20, 40, 400])
def test_passages_are_alike_for_any_number_of_holders(spark, n):
    draw = random.Random(n)
    text = lambda k: "".join(draw.choice(LETTERS) for _ in range(k))
    p = text(360)
    texts = {f"r{i:03d}": text(20 + i % 90) + chr(0x4E00 + i) + "<" + p + ">" + chr(0x4E00 + i) for i in range(n)}
    texts["x"], texts["y"] = text(25) + "<" + p[:170] + "#" + p[171:] + ">", "<" + p[40:300]
    df = spark.createDataFrame(list(texts.items()), "rid string, text string")
    found = S.shared_passages(df)
    got = S.maximal(found).collect()
    assert {r["rid"]: r["shared"] for r in S.overlap(df, found).collect()} == {k: len(v) for k, v in covered(texts, S.SPAN).items()}
    for r in (r for r in got if r["exact"]):
        assert texts[r["rid"]][r["start"] : r["end"]] == texts[r["other"]][r["o_start"] : r["o_end"]]
    longest = {k: (t.index("<"), t.index("<") + 362) for k, t in texts.items() if k[0] == "r"}
    assert {r["rid"]: (r["start"], r["end"]) for r in got if r["exact"] and r["rid"] in longest} == longest  # one row each, as far as it goes
    fuzzy = {r["rid"]: r for r in got if not r["exact"]}
    assert fuzzy["x"]["edits"] == 1 and (fuzzy["x"]["start"], fuzzy["x"]["end"]) == (25, 387)
    assert len(got) <= 2 * len(texts) + 4


def test_longest_passages_despite_smaller_records_that_hold_parts(spark):
    draw = random.Random(12)
    text = lambda k: "".join(draw.choice(LETTERS) for _ in range(k))
    p = text(900)
    texts = {"a": text(9) + p[:420], "b": p[300:700] + text(9), "c": "#" + p[600:], "y": "*" + p + "*", "z": text(30) + p + "-"}
    got = S.maximal(S.shared_passages(spark.createDataFrame(list(texts.items()), "rid string, text string"))).collect()
    assert {(r["rid"], r["start"], r["end"]) for r in got if r["exact"] and r["rid"] in "yz"} == {("y", 1, 901), ("z", 30, 930)}


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_of_short_and_long_gaps():
    draw = random.Random(7)
    for n in [*range(40), 500, 900]:
        a = "".join(draw.choice("abc") for _ in range(n))
        b = "".join(draw.choice(["", c, c, c, c + "d"]) for c in a)
        assert S.edits(a, b) == plain_edits(a, b) and S.edits(b, a) == plain_edits(b, a)
    a = "".join(draw.choice(LETTERS) for _ in range(900))
    assert S.edits(a, "".join("#" if i % 90 == 0 else c for i, c in enumerate(a))) == 10
