import pytest

from litspark.llm import names as N


def clusters(spark, *names):
    df = spark.createDataFrame([(n, 1) for n in names], "name string, entity int")
    out = {}
    for r in N.entities(df).collect():
        out.setdefault(r["entity"], set()).add(r["name"])
    return sorted(map(sorted, out.values()))


def test_spellings_of_persons(spark):
    one = ["Katherine P. Lososahun", "katherine lososahun", "LOSOSAHUN Katherine", "Lososahun, K.", "Kate Lososahun", "Kathreine Lososahun", "Dr. Katherine Losoahun", "Katherine-Lososahun", "LososahunK", "Katherine Lososahun, PhD"]
    two = ["Jürgen Nohökeled", "Juergen Nohoekeled", "Jurgen Nohokeled", "J. Nohökeled"]
    assert clusters(spark, *one, *two, "Jonathan Lososahun", "Katherine Faligotan") == sorted(map(sorted, [one, two, ["Jonathan Lososahun"], ["Katherine Faligotan"]]))


def test_ambiguous_initials_and_nicknames_stay_alone(spark):
    names = ["Maria Keller", "Martin Keller", "M. Keller", "Alexander Braun", "Alexandra Braun-Holm", "Sandy Braun"]
    got = clusters(spark, *names)
    assert ["M. Keller"] in got and ["Maria Keller"] in got and ["Alexander Braun", "Sandy Braun"] in got


def test_two_initials_prefer_the_name_that_has_both(spark):
    assert clusters(spark, "H. L. Keller", "Henrik L. Keller", "Lucia Keller") == [["H. L. Keller", "Henrik L. Keller"], ["Lucia Keller"]]
    assert clusters(spark, "H. L. Keller", "Henrik Keller") == [["H. L. Keller", "Henrik Keller"]]
    assert clusters(spark, "H. L. Keller", "Henrik Keller", "Lucia Keller") == [["H. L. Keller"], ["Henrik Keller"], ["Lucia Keller"]]


def test_middle_initials_keep_people_apart(spark):
    got = clusters(spark, "Ann B. Carver", "Ann C. Carver", "Ann Carver")
    assert got == [["Ann B. Carver"], ["Ann C. Carver"], ["Ann Carver"]]
    assert clusters(spark, "Ann B. Carver", "Ann Carver", "Carver, Ann B") == [["Ann B. Carver", "Ann Carver", "Carver, Ann B"]]


def test_organisations(spark):
    one = ["Fasikol University, Department of Ocean Physics", "Department of Ocean Physics, Fasikol University", "Fasikol Univ., Ocean Dept", "Fasikol Univeristy, Department of Ocean Physics"]
    two = ["The Kurufoma Collaboration", "Kurufoma Collab.", "KURUFOMA collaboration", "The Kurufoma Colaboration"]
    assert clusters(spark, *one, *two, "Gipunu Institute of Ocean Physics") == sorted(map(sorted, [one, two, ["Gipunu Institute of Ocean Physics"]]))


def test_jaro_winkler():
    assert N.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert N.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert N.jaro_winkler("", "a") == 0 and N.jaro_winkler("a", "a") == 1


def test_one_error():
    assert all(N.one_error(a, b) and N.one_error(b, a) for a, b in (("hukirisort", "hukidisort"), ("abc", "ab"), ("abcd", "acbd"), ("abc", "abc"), ("xbc", "bc")))
    assert not any(N.one_error(a, b) for a, b in (("abcd", "badc"), ("abc", "a"), ("abcd", "abxy"), ("nepusaho", "penasuho")))
    assert N.same_token("hukirisort", "hukidisort", N.GIVEN) and not N.same_token("nepusaho", "penasuho", N.GIVEN)


def test_one_typing_error_keeps_a_common_variant():
    name = "guredigek"
    for typo in ("gurdigek", "gurredigek", "guerdigek", "gurepigek", "gureidgek"):
        assert set(N.variants(name)) & set(N.variants(typo)), typo


def test_edge_cases(spark):
    assert clusters(spark, "", " ", "Plato", "?", "李雷", "a b", "x" * 5000 + " y") == sorted([[n] for n in ("", " ", "Plato", "?", "李雷", "a b", "x" * 5000 + " y")])
    df = spark.createDataFrame([(None,), ("Ann Carver",), ("Ann Carver",)], "name string")
    assert [r["name"] for r in N.entities(df).collect()] == ["Ann Carver"]
    assert N.entities(df.limit(0)).count() == 0


def test_hot_blocks_lose_no_pair(spark, monkeypatch):
    names = [f"{a} {b}" for a in ("Katherine", "Kathreine", "Jonathan", "Jonahtan", "Benjamin") for b in ("Keller", "Braun", "Carver")] + ["K. Carver", "B. Keller"]
    want = clusters(spark, *names)
    monkeypatch.setattr(N, "HOT", 1)
    assert clusters(spark, *names) == want


@pytest.mark.parametrize("hot", [64, 3, 1])
def test_pairs_of_popular_blocks_meet(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT", hot)
    heads, tails = ("bano", "celi", "dumo", "fira", "gopu", "heku", "jilo", "kemu", "lapi", "mori"), ("dra", "gel", "kin", "lom", "nas", "pet", "rus")
    one = ["Fasikol University", *(f"Fasikol University, Department of {a}{b}" for a in heads for b in tails)]  # 71 of one token
    two = ["K. Kuhihede", "Kofi Kuhihefe"]  # their codes share the variant k only
    others = ["Kofi Kalimo", "Kofi Katuri", "Kofi Kasewo"]  # of that block, too
    assert clusters(spark, *one, *two, *others) == sorted([sorted(one), two, *([n] for n in others)])


def test_typing_errors_between_equal_consonants_keep_a_common_variant():
    pairs = [("carver", "carer"), ("margaret", "mararet"), ("nobogubuk", "noboubuk"), ("lililapon", "lilixlapon"), ("lililapon", "lilxlapon")]
    for name, typo in pairs:
        assert set(N.variants(name)) & set(N.variants(typo)), typo


def test_typing_error_between_equal_consonants_is_linked(spark):
    one, two = ["Ann Nobogubuk", "Ann Noboubuk"], ["Lililapon Keller", "Lilixlapon Keller"]
    assert clusters(spark, *one, *two) == [one, two]


def typed(draw, token):
    """The token with a letter left out, put in, replaced or swapped."""
    at, way = draw.randrange(len(token)), draw.randrange(4)
    letter = draw.choice("abcdefghijklmnoprstuvwz")
    if way == 0:
        return token[:at] + token[at + 1 :]
    if way == 1:
        return token[:at] + letter + token[at:]
    if way == 2:
        return token[:at] + letter + token[at + 1 :]
    return token[:at] + token[at : at + 2][::-1] + token[at + 2 :]


@pytest.mark.parametrize("hot", [64, 1])
def test_every_pair_that_is_accepted_is_a_candidate(spark, monkeypatch, hot):
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(N, "HOT", hot)
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(n)) + draw.choice(["", "n", "k", "t"])
    names = set()
    for _ in range(90):
        given, surname = draw.choice([word(3), "katherine", "nicholas", "wei"]), draw.choice([word(3), word(4), "wang", "keller"])
        names |= {f"{given} {surname}", f"{typed(draw, given)} {surname}", f"{surname} {typed(draw, given)}", f"{typed(draw, given)} {typed(draw, surname)}", f"{given[0]}. {typed(draw, surname)}"}
    for _ in range(25):
        place, field = word(3), draw.choice([word(4), "mathematics", "physics"])
        names |= {f"University of {place}", f"{typed(draw, place)} University, {field}", f"{place} University, {field[:5]}", f"Univ. {place} {typed(draw, field)}"}
    nodes = {}
    for n in sorted(names):
        key, _, weak, kind, full, short, blocks = N.node_of(n)
        nodes.setdefault(key, (weak, kind, full, short, blocks))
    df = spark.createDataFrame([(k, [tuple(x) for x in v[4]]) for k, v in nodes.items()], "node string, blocks array<struct<way: int, word: int, key: string>>")
    ids = {r["node"]: r["id"] for r in df.select("node", F.xxhash64("node").alias("id")).collect()}
    got = {(r["id_a"], r["id_b"]) for r in N.candidates(df.select(F.xxhash64("node").alias("id"), "blocks")).collect()}
    want = lost = 0
    keys = sorted(nodes)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            (wa, ka, fa, ia, _), (wb, kb, fb, ib, _) = nodes[a], nodes[b]
            if N.alike(ka, fa, ia, wa, kb, fb, ib, wb):
                want += 1
                lost += (min(ids[a], ids[b]), max(ids[a], ids[b])) not in got
    assert want > 400 and lost < 0.03 * want  # those with two errors in the consonants of one token
