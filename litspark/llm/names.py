"""Variant spellings of names typed by people, linked to entities.

A name is read as full tokens and initials, whatever their order. Names that agree after folding case,
accents, titles and nicknames are one node. Nodes are blocked by the phonetic codes of two of their tokens
in order, each code in all variants that lack one symbol, so that a typing error in either or both keeps a
block in common. Names of one token and initials look up full names by that token's code and an initial;
organisations look up others by the codes of their rarest word. Pairs of a block are compared with
Jaro-Winkler and the nickname table, and accepted pairs are clustered by connected components. Names that
give initials only, or a nickname of several names, join a cluster only if it is the only one that fits.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import connected_components, cut, pairs_within, spread, table

#: Jaro-Winkler similarity from which tokens beside an equal one, and surnames beside initials, are the same; and that of tokens of one phonetic code.
GIVEN, SURNAME, SOUNDS_ALIKE = 0.92, 0.92, 0.88
#: Tokens of at least so many letters are the same if one typing error parts them, where swaps that Jaro-Winkler sees in it bring it below its bound.
LONG = 7
#: Mean Jaro-Winkler similarity from which two misspelt tokens of a name are, beside each one's own bound.
BOTH = 0.935
#: Blocks of more nodes than this are compared in chunks of about so many, each chunk with each.
HOT = 64

# Nicknames of given names.
NICKNAMES = """
alexander alex sasha sandy xander; alexandra alex sasha sandra; anastasia nastya stacy ana; andrew andy drew; anthony tony; barbara barb;
benjamin ben benny; catherine cathy cate; charles charlie chuck; christina chris tina; christopher chris kit topher; daniel dan danny;
david dave; deborah deb debbie; dmitri dima mitya; edward ed eddie ted ned; elizabeth beth liz lizzie betty eliza lisa; emily em; francisco paco pancho fran;
frederick fred freddie fritz; gabriel gabe; gregory greg; hannelore hanne lore; henrik rik hank; henry harry hank; ingrid inga; isabella bella isa izzy;
ivan vanya; james jim jimmy jamie; jennifer jen jenny; john jack johnny; jonathan jon jonny; joseph joe; josephine josie jo; joshua josh; katherine kate katie kathy kat katya;
kenneth ken; leonard len leo lenny; lawrence larry; lucia lucy lu; margaret maggie meg peggy greta; matthew matt; michael mike mick mickey misha; natalia natasha;
nicholas nick nicky klaus; nadia nadya; oliver ollie; olga olya; patricia pat patty trish; pavel pasha; penelope penny nell; peter pete; philip phil; rebecca becky becca; richard rick dick rich;
robert bob rob bobby bert; ronald ron; samuel sam sammy; samantha sam; stephen steve; stephane steph; susan sue; sergei seryozha; teodora dora teddy; theodore theo ted teddy; thomas tom tommy;
timothy tim; tomas tom tomek; ulrich uli ulli; urszula ula; victoria vicky tori vika; vladimir vova volodya vlad; walter walt; william bill will billy liam; xenia ksenia ksyusha; yevgenia zhenya jenya genia; wanda wandzia; zainab zaynab zee
"""  # noqa: E501
# Titles and suffixes that aren't part of a name.
TITLES = frozenset("dr prof professor phd md msc bsc mr mrs ms mx sir dame ing dipl jr sr ii iii iv esq rev hon".split())
# Words of organisations with their short forms and common misspellings, and words that say nothing.
ORGANISATIONS = """
university univ universitat universite universidad uni; institute inst institut instituto; department dept dep; collaboration collab; laboratory lab labs laboratories;
centre center centro zentrum ctr; consortium consort; group grp gruppe; school sch; college coll; faculty fac; academy acad; society soc; foundation found; project proj; team; corporation corp; company co; hospital hosp; agency; council; network; observatory obs
"""  # noqa: E501
EMPTY_WORDS = frozenset("the of for and in at on de la le les des du der die das und et y el los of".split())


def _table(text: str) -> list[list[str]]:
    return [x.split() for x in text.split(";")]


@lru_cache(maxsize=1)
def nicknames() -> dict[str, frozenset[str]]:
    found: dict[str, set[str]] = {}
    for root, *short in _table(NICKNAMES):
        for s in short:
            found.setdefault(fold(s), set()).add(fold(root))
    roots = {fold(r[0]) for r in _table(NICKNAMES)}
    return {s: frozenset(r) for s, r in found.items() if s not in roots}


@lru_cache(maxsize=1)
def kinds() -> dict[str, str]:
    return {fold(w): words[0] for words in _table(ORGANISATIONS) for w in words}


def fold(token: str) -> str:
    """Lower case without accents; written-out umlauts as their plain vowel."""
    t = U.normalize("NFKD", token.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L"))
    t = "".join(c for c in t if not U.combining(c)).casefold()
    return re.sub("([aou])e", r"\1", t)


def code(token: str) -> str:
    """Phonetic code: the sounds of the consonants in order; of a token without any, the token."""
    t = token.translate(str.maketrans("cqzwyf", "kksvjp"))
    t = re.sub(r"[aeiouh]", "", t)
    return re.sub(r"(.)\1+", r"\1", t) or token


def variants(token: str) -> list[str]:
    """The code, and the code without any one of its symbols.

    A token of at most three letters has its code only: no other one that differs in a letter of it is
    accepted, and one with a letter more has this code among its own variants.
    """
    c = code(token)
    if len(c) < 2 or len(token) <= 3:
        return [c]
    less = {c[:i] + c[i + 1 :] for i in range(len(c))}
    return sorted({c, *less, *(re.sub(r"(.)\1+", r"\1", x) for x in less)})  # as code() has it without that symbol


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    theirs = [c for c, t in zip(b, taken) if t]
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def one_error(a: str, b: str) -> bool:
    """Whether a letter left out, put in, replaced or swapped with the next turns one token into the other."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return len(b) - len(a) == 1 and a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def same_token(a: str, b: str, least: float) -> bool:
    near = jaro_winkler(a, b)
    return near >= least or near >= SOUNDS_ALIKE and (code(a) == code(b) or min(len(a), len(b)) >= LONG and one_error(a, b))


def kind_of(token: str) -> str | None:
    """The word of organisations that a token is, misspelt ones included."""
    if token in kinds():
        return kinds()[token]
    if len(token) >= 7:
        for w in {v for v in kinds().values() if len(v) >= 7}:
            if jaro_winkler(token, w) >= 0.95:
                return w
    return None


def read(name: str) -> tuple[str, list[str], list[str]]:
    """('p' or an organisation's kind, full tokens sorted, initials or other words sorted)."""
    text = re.sub(r"\b(?:Ph\.? ?D|[MB]\.?Sc|[MJ]\.?D|D\.?Phil)\b\.?", " ", U.normalize("NFC", name))
    text = re.sub(r"(?<=\w)['’`´](?=\w)", "", text)
    text = re.sub(r"(?<=[^\W\d_]{2})(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ](?:\b|[A-ZÀ-Þ]?\b))", " ", text)
    words = [fold(w) for w in re.findall(r"[^\W_]+", text)]
    words = [w for w in words if w and w not in TITLES]
    org = [k for k in map(kind_of, words) if k]
    if org and len(words) > 1:
        rest = sorted({w for w in words if w not in EMPTY_WORDS and not kind_of(w) and len(w) > 1})
        main = sorted(set(org) - {"department", "faculty", "school", "group", "team"}) or sorted(set(org))
        if rest:
            return main[0], rest, []
    full = [w for w in words if len(w) > 1]
    short = [w for w in words if len(w) == 1]
    return "p", sorted(full), sorted(short)


def roots(token: str) -> frozenset[str]:
    return nicknames().get(token, frozenset((token,)))


#: Kinds of blocking keys: of full names, compared with each other; of names with initials, which look up full names; of organisations' words.
FULL, LOOKUP, LISTED, WORD = range(4)


def word_keys(kind: str, token: str) -> list[str]:
    """Keys of an organisation's word; one that abbreviates another begins as it does."""
    return [f"o|{kind}|{v}" for v in variants(token)] + ([f"o|{kind}|^{token[:4]}"] if len(token) >= 4 else [])


def node_of(name: str) -> tuple[str, str, bool, str, list[str], list[str], list[tuple[int, int, str]]]:
    """(tokens key, middle initials, weak, kind, full tokens, initials, blocks (kind of key, number of the word, key))."""
    kind, full, short = read(name)
    if kind != "p":
        blocks = [(WORD, i, k) for i, t in enumerate(full) for k in word_keys(kind, t)]
        return f"{kind}|" + " ".join(full), "", False, kind, full, [], blocks
    if len(full) >= 2:
        clear = sorted(next(iter(roots(t))) if len(roots(t)) == 1 else t for t in full)
        unclear = [t for t in full if len(roots(t)) > 1]
        keys = [sorted({v for x in (roots(t) if t in unclear else (t,)) for v in variants(x)}) for t in clear]
        blocks = []
        for i in range(len(clear)):
            for j in range(i + 1, len(clear)):
                blocks += [(FULL, 0, f"s|{min(x, y)}|{max(x, y)}") for x in keys[i] for y in keys[j]]
            if not unclear:
                blocks += [(LISTED, 0, f"w|{o[:1]}|{v}") for o in clear[:i] + clear[i + 1 :] for v in keys[i]]
        return "p|" + " ".join(clear), "".join(short), bool(unclear), "p", clear, short, sorted(set(blocks))
    if len(full) == 1 and short:
        blocks = [(LOOKUP, 0, f"w|{i}|{v}") for i in sorted(set(short)) for v in variants(full[0])]
        return f"p|{full[0]}|" + "".join(short), "", True, "p", full, short, blocks
    return "x|" + name, "", False, "x", full, short, []  # a single word, or nothing to read: only itself


NODES = (
    "name string, tokens string, middle string, weak boolean, kind string, full array<string>, initials array<string>, "
    "blocks array<struct<way: int, word: int, key: string>>"
)


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["name", "tokens", "middle", "weak", "kind", "full", "initials", "blocks"]
    for b in batches:
        rows = [(n, *node_of(n)) for n in b["name"]]
        yield pd.DataFrame([(*r[:-1], [{"way": w, "word": i, "key": k} for w, i, k in r[-1]]) for r in rows], columns=columns)


def nearness(x: str, y: str) -> float:
    """How near two tokens are, 0 if they aren't the same by any reading."""
    if roots(x) & roots(y):
        return 1.0
    return max((jaro_winkler(p, q) if same_token(p, q, GIVEN) else 0.0 for p in roots(x) for q in roots(y)), default=0.0)


def alike(kind_a: str, a: list[str], ia: list[str], weak_a: bool, kind_b: str, b: list[str], ib: list[str], weak_b: bool) -> int:
    """0 if two nodes can't be one entity, 2 if they agree but for initials and nicknames, 1 if a token is spelled differently or an initial stands for none."""
    if kind_a != kind_b or weak_a and weak_b:
        return 0
    if kind_a != "p":
        few, many = sorted((a, b), key=len)
        left, exact = list(many), 0
        for t in sorted(few, key=len, reverse=True):
            hit = next((m for m in left if m == t), None) or next(
                (m for m in left if len(t) >= 4 and m.startswith(t) or len(m) >= 4 and t.startswith(m) or same_token(t, m, GIVEN)), None
            )
            if hit is None:
                return 0
            exact += hit == t
            left.remove(hit)
        return 2 if exact == len(few) else 1
    if len(a) >= 2 and len(b) >= 2:
        if ia and ib and not (set(ia) <= set(ib) or set(ib) <= set(ia)):
            return 0
        if len(a) != len(b):
            few, many = sorted((a, b), key=len)
            more = [t for t in many if t not in few]
            return 2 if set(few) <= set(many) and all(t[0] in (ia if few is a else ib) for t in more) else 0
        left_a, left_b = [t for t in a if t not in b], [t for t in b if t not in a]
        if not left_a:
            return 2
        if len(left_a) == 2 and len(left_b) == 2:
            for y, z in (left_b, left_b[::-1]):
                one, two = nearness(left_a[0], y), nearness(left_a[1], z)
                if one and two and (one + two) / 2 >= BOTH:
                    return 2 if one == two == 1.0 else 1
            return 0
        if len(left_a) != 1 or len(left_b) != 1:
            return 0
        x, y = left_a[0], left_b[0]
        if roots(x) & roots(y):
            return 2
        return int(any(same_token(p, q, GIVEN) for p in roots(x) for q in roots(y)))
    few, many, si, mi = (a, b, ia, ib) if len(a) == 1 else (b, a, ib, ia)
    best = 0
    for t in many:
        others = [o[0] for o in many if o != t]
        rest = list(si)
        first = next((o for o in others if o in rest), None)
        if first is None:
            continue
        rest.remove(first)
        unknown = any(r not in mi and r not in others for r in rest)
        if mi and unknown:
            continue
        best = max(best, 2 if few[0] == t and not unknown else int(same_token(few[0], t, SURNAME)))
    return best


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [
            alike(*x)
            for x in zip(b["ka"], map(list, b["fa"]), map(list, b["ia"]), b["wa"], b["kb"], map(list, b["fb"]), map(list, b["ib"]), b["wb"])
        ]
        b = b[["a", "b", "wa", "wb"]].assign(how=got)
        yield b[b["how"] > 0]


def _within(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """(a, b) of probes and keys (id, block) that share a block; popular blocks are met chunk by chunk, each row of a side with each of the other."""
    size = keys.groupBy("block").agg(F.count("*").alias("n"))
    asked = probes.groupBy("block").agg(F.count("*").alias("m"))
    known = size.join(asked, "block")
    chunks = lambda c: F.ceil(F.col(c) / HOT)
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1))
    x = keys.join(known, "block").withColumn("x", F.pmod(F.xxhash64("id"), chunks("n"))).withColumn("_of", chunks("m")).withColumn("y", cell)
    y = probes.join(known, "block").withColumn("y", F.pmod(F.xxhash64("id"), chunks("m"))).withColumn("_of", chunks("n")).withColumn("x", cell)
    met = x.select("block", "x", "y", F.col("id").alias("p")).join(y.select("block", "x", "y", F.col("id").alias("q")), ["block", "x", "y"])
    return met.where("p <> q").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def candidates(nodes: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of nodes (id, blocks) that share a block and may be accepted.

    Full names meet each other. Names with initials meet full names only, as two of them are never
    accepted. Of two organisations every word of the one with fewer has its like in the other, so each
    looks up the others by its rarest word alone: a word that very many have costs as many rows as have it.
    """
    keys = cut(nodes.select("id", F.explode("blocks").alias("k")).select("id", "k.way", "k.word", F.xxhash64("k.key").alias("block")).distinct())
    of = lambda way: keys.where(F.col("way") == way).select("id", "block")
    pairs = pairs_within(of(FULL), "block", "id", HOT).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    pairs = pairs.union(_within(of(LISTED), of(LOOKUP)))
    words = keys.where(F.col("way") == WORD)
    common = words.groupBy("block").agg(F.count("*").alias("n"))
    rarest = words.join(common, "block").groupBy("id", "word").agg(F.max("n").alias("n")).groupBy("id").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    return pairs.union(_within(words.select("id", "block").distinct(), words.join(rarest, ["id", "word"]).select("id", "block").distinct())).distinct()


def entities(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, entity) of each distinct name; entity is the smallest node of its cluster.

    Null names are left out; a name without letters or with a single word is an entity of its own, as is
    one that fits several clusters. An empty table gives an empty result.
    """
    distinct = spread(names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct())
    read_names = cut(distinct.mapInPandas(_nodes, NODES))
    clash = read_names.where("middle <> ''").groupBy("tokens").agg((F.count_distinct("middle") > 1).alias("clash")).where("clash")
    node = F.when(F.col("clash") & (F.col("middle") != ""), F.concat("tokens", F.lit("|"), "middle")).otherwise(F.col("tokens"))
    weak = F.col("weak") | (F.coalesce("clash", F.lit(False)) & (F.col("middle") == ""))  # fits several people of these tokens
    named = read_names.join(clash, "tokens", "left").withColumn("weak", weak)
    named = named.withColumn("node", F.concat(node, F.when(F.col("weak"), "|?").otherwise("")))
    nodes = named.groupBy("node").agg(
        F.min("kind").alias("k"), F.min("weak").alias("w"), F.first("full").alias("f"),
        F.array_distinct(F.flatten(F.collect_set("initials"))).alias("i"), F.first("blocks").alias("blocks"),
    )  # the names of a node differ in case, accents, titles and order
    nodes = cut(nodes)
    pairs = candidates(nodes.select(F.xxhash64("node").alias("id"), "blocks"))
    side = lambda s: nodes.select(F.xxhash64("node").alias(f"id_{s}"), F.col("node").alias(s), *[F.col(c).alias(f"{c}{s}") for c in "kwfi"])
    both = spread(pairs.join(side("a"), "id_a").join(side("b"), "id_b"))
    accepted = cut(both.mapInPandas(_compare, "a string, b string, wa boolean, wb boolean, how int"))
    strong = connected_components(accepted.where("NOT wa AND NOT wb").select("a", "b"))
    fits = accepted.where("wa <> wb").select(
        F.when(F.col("wa"), F.col("a")).otherwise(F.col("b")).alias("weak"),
        F.when(F.col("wa"), F.col("b")).otherwise(F.col("a")).alias("node"), "how",
    )
    fits = fits.join(strong, "node", "left").select("weak", "how", F.coalesce("component", "node").alias("to"))
    bounds = lambda how: [f(F.when(F.col("how") == how, F.col("to"))) for f in (F.min, F.max)]
    (low2, high2), (low1, high1) = bounds(2), bounds(1)
    only = fits.groupBy("weak").agg(low2.alias("l2"), high2.alias("h2"), low1.alias("l1"), high1.alias("h1")).select(
        "weak", F.when(F.col("l2") == F.col("h2"), F.col("l2")).when(F.col("l2").isNull() & (F.col("l1") == F.col("h1")), F.col("l1")).alias("to")
    )
    return (
        named.select("name", "node").join(strong, "node", "left").join(only, F.col("node") == F.col("weak"), "left")
        .select("name", F.coalesce("to", "component", "node").alias("entity"))
    )


def author_names(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    authors = table(spark, sf_dir, "papers").select(F.explode(F.from_json("authors_json", "array<string>")).alias("name"))
    return authors.where("name IS NOT NULL").distinct()


def p5_entities(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Each spelling with its entity."""
    return entities(author_names(spark, sf_dir))


def p5_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """All pairs of spellings of one entity."""
    e = p5_entities(spark, sf_dir)
    other = e.select(F.col("name").alias("name_b"), F.col("entity").alias("e"))
    return e.join(other, (F.col("entity") == F.col("e")) & (F.col("name") < F.col("name_b"))).select(F.col("name").alias("name_a"), "name_b").distinct()
