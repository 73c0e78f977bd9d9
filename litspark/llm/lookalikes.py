"""Visually identical text with different characters, brought to one consistent form.

Characters and strings that look alike form classes: a union-find joins each compatibility form with its
plain characters, each base and combining mark with their composed character, and letters or groups of
letters of different alphabets that are drawn alike. A class has one representative per alphabet: its plain
member, of several the one that is the most frequent in the texts. Texts are rewritten greedily, the longest
match first, with a multi-pattern automaton; words that mix alphabets are then brought, by an automaton per
alphabet, to the one that they are written in. A word whose letters were all replaced can't be told by its
letters: the spellings of such words form classes of strings, and the spelling that is the most frequent in
texts of the same alphabet represents its class.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.common import cut, small, table

# Letters drawn alike in the Latin, Cyrillic and Greek alphabets.
LATIN_CYRILLIC = "aа cс eе oо pр xх yу sѕ iі jј hһ dԁ qԛ wԝ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ"
LATIN_GREEK = "oο AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ"
# Alike enough inside a word of the other alphabet, but symbols when they stand alone.
LATIN_GREEK_INSIDE = "aα iι kκ pρ uυ vν"
LATIN_CYRILLIC_INSIDE = "kк YҮ"
# Letters of other alphabets drawn as Latin ones, likewise.
LATIN_ARMENIAN_INSIDE = "oօ OՕ hհ nո uս gց qզ SՏ UՍ LԼ jյ wա"
LATIN_COPTIC_INSIDE = "oⲟ OⲞ cⲥ CⲤ pⲣ PⲢ kⲕ KⲔ MⲘ HⲎ NⲚ TⲦ BⲂ AⲀ IⲒ YⲨ XⲬ"
LATIN_CHEROKEE_INSIDE = "AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ IᏆ JᎫ KᏦ LᏞ MᎷ PᏢ RᎡ SᏚ TᎢ VᏙ WᎳ ZᏃ yᎩ"
LATIN_LISU_INSIDE = "BꓐPꓑDꓓTꓔGꓖKꓗJꓙCꓚZꓜFꓝMꓟNꓠLꓡSꓢRꓣVꓦHꓧWꓪXꓫYꓬAꓮEꓰIꓲOꓳUꓴ"
# Groups of Latin letters drawn as a Cyrillic one.
STRINGS = "bl=ы bI=Ы IO=Ю lo=ю"
# Kinds of compatibility forms that are other drawings of plain characters.
STYLED = ("<wide>", "<narrow>", "<font>", "<compat>", "<circle>", "<square>", "<small>", "<vertical>",
          "<initial>", "<medial>", "<final>", "<isolated>")

#: Code points that may belong to a class: no surrogates, private ones, Hangul syllables (composed by
#: normalisation) or ideographs of their main block.
ASSIGNED = (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200))
WORD = re.compile(r"[^\W\d_]+")


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: str, y: str) -> None:
        self.up[self.find(x)] = self.find(y)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


#: Alphabets by the beginning of their letters' names.
ALPHABETS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "A", "COPTIC": "K", "CHEROKEE": "R", "LISU": "S"}


@lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    """The alphabet of a letter, or an empty string."""
    return ALPHABETS.get(U.name(ch, "").split(" ")[0], "") if ch.isalpha() else ""


def is_invisible(ch: str) -> bool:
    cp = ord(ch)
    return (
        U.category(ch) in ("Cf", "Cc") and ch not in "\n\t\v\f\r\x85\x1c\x1d\x1e\x1f"
        or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0100 <= cp <= 0xE01EF
    )


def is_blank(ch: str) -> bool:
    return ch not in " \n" and ch.isspace()


@lru_cache(maxsize=1)
def rewrites() -> dict[str, str]:
    """Each string that isn't plain, with the representative of its class."""
    classes = UnionFind()
    for cp in ASSIGNED:
        ch = chr(cp)
        parts = U.decomposition(ch)
        if not parts or is_blank(ch):
            continue
        if parts[0] != "<":
            whole = U.normalize("NFD", ch)
            if U.normalize("NFC", whole) == ch:
                classes.join(whole, ch)
            continue
        plain = U.normalize("NFKC", ch)
        if parts.split()[0] in STYLED and plain != ch:
            if parts.startswith("<compat>") and not all(x.isalnum() for x in plain):
                continue
            if any(x.isspace() for x in plain):
                continue
            classes.join(ch, plain)
    out = {}
    for members in classes.classes().values():
        stands = [m for m in members if U.normalize("NFKC", m) == m] or [U.normalize("NFKC", members[0])]
        for m in members:
            if m != stands[0]:
                out[m] = stands[0]
    for cp in ASSIGNED:
        ch = chr(cp)
        if is_blank(ch):
            out[ch] = " "
        elif is_invisible(ch):
            out[ch] = ""
    return out


@lru_cache(maxsize=1)
def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in rewrites().items():
        a.add_word(k, (len(k), v))
    a.make_automaton()
    return a


ODD_ASCII = re.compile("[\x00-\x09\x0b-\x1f\x7f]")


@lru_cache(maxsize=1)
def odd() -> re.Pattern:
    """Any single character that is rewritten although a text of it is in compatibility form: invisible ones and blanks."""
    points = sorted(ord(k) for k, v in rewrites().items() if len(k) == 1 and v in ("", " "))
    ranges, start = [], points[0]
    for x, y in zip(points, [*points[1:], -1]):
        if y != x + 1:
            ranges.append(f"\\U{start:08x}-\\U{x:08x}")
            start = y
    return re.compile(f"[{''.join(ranges)}]")


def rewritten(text: str, patterns) -> str:  # noqa: ANN001
    """Greedily, the longest match first."""
    out, at = [], 0
    for end, (n, new) in patterns.iter_long(text):
        out += (text[at : end - n + 1], new)
        at = end + 1
    return "".join(out) + text[at:] if at else text


def plain(text: str) -> str:
    """Compatibility forms, marks, invisible characters and blanks brought to their representatives, until nothing changes.

    A removed character can bring a base and its mark together, so one round may not be enough. Every round
    that changes a text makes it shorter or replaces characters by plain ones, so the rounds end.
    """
    while True:
        if text.isascii():
            if not ODD_ASCII.search(text):
                return text
        elif U.is_normalized("NFKC", text) and not odd().search(text):
            return text
        new_text = U.normalize("NFC", rewritten(text, automaton()))
        if new_text == text:
            return text
        text = new_text


def pairs(*tables: str) -> list[tuple[str, str]]:
    """Pairs of a table: of two characters each, or with a sign between strings."""
    out = []
    for t in tables:
        for p in t.split():
            out += [tuple(p.split("="))] if "=" in p else [(p[i], p[i + 1]) for i in range(0, len(p), 2)]
    return out


def alphabet_of(x: str) -> str:
    """The alphabet of all letters of a string, or an empty string."""
    own = {script(c) for c in x}
    return own.pop() if len(own) == 1 else ""


ALONE = (LATIN_CYRILLIC, LATIN_GREEK)
INSIDE = (*ALONE, LATIN_GREEK_INSIDE, LATIN_CYRILLIC_INSIDE, LATIN_ARMENIAN_INSIDE, LATIN_COPTIC_INSIDE, LATIN_CHEROKEE_INSIDE, LATIN_LISU_INSIDE, STRINGS)


def classes_of(*tables: str) -> list[list[str]]:
    classes = UnionFind()
    for x, y in pairs(*tables):
        classes.join(x, y)
    return [sorted(m) for m in classes.classes().values()]


@lru_cache(maxsize=1)
def contested() -> tuple[str, ...]:
    """The members of classes that have several of one alphabet; their frequencies decide which stands for the class."""
    out: set[str] = set()
    for members in classes_of(*INSIDE):
        for s in ALPHABETS.values():
            own = [m for m in members if alphabet_of(m) == s]
            if len(own) > 1:
                out.update(own)
    return tuple(sorted(out))


#: How often each contested letter stands in the texts, in the order of contested(); none known: the plainest stands.
Counts = tuple[int, ...]


@lru_cache(maxsize=16)
def letters(counts: Counts = ()) -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]]]:
    """For each alphabet the letters and strings of others with their look-alike in it: safe alone, and inside a word."""
    often = dict(zip(contested(), counts))

    def build(*tables: str) -> dict[str, dict[str, str]]:
        to: dict[str, dict[str, str]] = {s: {} for s in ALPHABETS.values()}
        for members in classes_of(*tables):
            for s in to:
                own = [m for m in members if alphabet_of(m) == s and len(m) == 1]  # groups of letters become a letter, never the other way
                if not own:
                    continue
                best = min(own, key=lambda m: (-often.get(m, 0), len(m), m))
                to[s] |= {m: best for m in members if alphabet_of(m) != s}
        return to

    return build(*ALONE), build(*INSIDE)


@lru_cache(maxsize=64)
def into_alphabet(s: str, counts: Counts = ()):  # noqa: ANN201
    """The automaton that writes look-alikes of other alphabets in the letters of this one."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in letters(counts)[1][s].items():
        a.add_word(k, (len(k), v))
    if len(a):
        a.make_automaton()
    return a


# Letters of the alphabets, and two neighbouring letters of different ones.
_LETTERS = {
    "L": "A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ", "C": "\u0400-\u0481\u048a-\u052f\u1c80-\u1c88", "G": "\u0370-\u0373\u0376-\u037d\u037f\u0386\u0388-\u03e1\u03f0-\u03ff\u1f00-\u1fff",
    "A": "\u0531-\u0556\u0560-\u0588", "K": "\u03e2-\u03ef\u2c80-\u2cf3", "R": "\u13a0-\u13f5\u13f8-\u13fd\uab70-\uabbf", "S": "\ua4d0-\ua4ff",
}
RUNS = {s: re.compile(f"[{x}]+") for s, x in _LETTERS.items()}
OTHERS = re.compile(f"[{''.join(x for s, x in _LETTERS.items() if s != 'L')}]")
BORDER = re.compile("|".join(f"[{x}](?=[{''.join(y for t, y in _LETTERS.items() if t != s)}])" for s, x in _LETTERS.items()))
#: Small capitals that no alphabet has as letters; words of phonetic writing have none of them.
SMALL_CAPITALS = re.compile("[\u1d00\u1d04\u1d05\u1d07\u1d0a-\u1d0d\u1d0f\u1d18\u1d1b\u1d1c\u1d20-\u1d22\ua731]")


@lru_cache(maxsize=1)
def small_capitals() -> dict[int, str]:
    """By rule: a small capital of a single letter is drawn as that letter."""
    names = {cp: U.name(chr(cp), "").removeprefix("LATIN LETTER SMALL CAPITAL ") for cp in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D2C), *range(0xA730, 0xA732))}
    return {cp: n.lower() for cp, n in names.items() if len(n) == 1}


def without_dots_lost(text: str) -> str:
    """Dotless i as i, unless the text is in a language that has both."""
    n = text.count("ı")
    return text if not n or re.search("[ğĞşŞİəƏ]", text) or 3 * n > n + text.count("i") else text.replace("ı", "i")


def main_script(text: str) -> str:
    """The alphabet of most letters of a text; empty where it has none."""
    if not OTHERS.search(text):
        return "L" if RUNS["L"].search(text) else ""
    n = {s: sum(map(len, r.findall(text))) for s, r in RUNS.items()}
    return max(sorted(n), key=n.__getitem__)


def word_in_one_alphabet(word: str, around: str, counts: Counts = ()) -> str:
    """A word of mixed alphabets in the one that its own letters belong to; unchanged if they belong to several."""
    inside = letters(counts)[1]
    have = {script(c) for c in word} - {""}
    if len(have) < 2:
        return word
    written = {s: rewritten(word, into_alphabet(s, counts)) for s in sorted(have)}
    fits = [s for s, w in written.items() if all(script(c) in (s, "") for c in w)]
    if not fits:
        return word
    own = {s: sum(script(c) == s and not any(c in inside[t] for t in have - {s}) for c in word) for s in fits}
    return written[max(fits, key=lambda s: (own[s], s == around, sum(script(c) == s for c in word)))]


def spelled_alike(word: str, into: str) -> str | None:
    """A word of one alphabet, letter by letter in another; None where a letter has no look-alike there."""
    alone = letters()[0]
    out = [alone[into].get(c) for c in word]
    return None if None in out else "".join(out)


@lru_cache(maxsize=2)
def alike_words(ascii_only: bool = False) -> re.Pattern:
    """Words of one alphabet, all letters of which have a look-alike in another."""
    alone = letters()[0]
    own = {s: "".join(sorted({c for to in alone.values() for c in to if script(c) == s})) for s in "LCG"}
    if ascii_only:  # beside a digit no word is counted here
        return re.compile(rf"\b[{own['L']}]+\b", re.ASCII)
    return re.compile(r"(?<![^\W\d_])(?:" + "|".join(f"[{x}]+" for x in own.values()) + r")(?![^\W\d_])")


def first_pass(text: str | None, counts: Counts = ()) -> tuple[str | None, str, list[str]]:
    """The text but for wholly replaced words, its alphabet, and its different words that other alphabets can spell alike."""
    if text is None:
        return None, "", []
    text = plain(text)
    if not text.isascii():
        if SMALL_CAPITALS.search(text):
            text = WORD.sub(lambda m: m[0].translate(small_capitals()) if SMALL_CAPITALS.search(m[0]) else m[0], text)
        text = without_dots_lost(text)
    around = main_script(text)
    if not text.isascii() and BORDER.search(text):
        text = WORD.sub(lambda m: m[0] if m[0].isascii() else word_in_one_alphabet(m[0], around, counts), text)
    return text, around, list(set(alike_words(text.isascii()).findall(text)))


FIRST = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("around", T.StringType()),
    T.StructField("alike", T.ArrayType(T.StringType())),
])


def first_pass_of(text: Column, counts: Counts) -> Column:
    """first_pass() as a Column. Texts of printable ASCII are read in the JVM; only others go to Python."""

    @F.pandas_udf(FIRST)
    def others(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_pass(x, counts) for x in s], columns=["text", "around", "alike"])

    simple = ~text.rlike(r"[^\x20-\x7e\n]")
    around = F.when(text.rlike("[A-Za-z]"), "L").otherwise("")
    own = F.array_distinct(F.regexp_extract_all(text, F.lit(alike_words(True).pattern), F.lit(0)))
    return F.when(simple, F.struct(text.alias("text"), around.alias("around"), own.alias("alike"))).otherwise(others(F.when(~simple, text)))


def letter_counts(df: DataFrame, text: str) -> Counts:
    """How often the contested letters stand in all texts; one row, whatever their number."""
    many = lambda c: F.sum((F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).cast("long"))
    some = df.where(F.col(text).rlike(f"[{''.join(c for c in contested() if ord(c) > 127)}]"))
    return tuple(x or 0 for x in some.agg(*[many(c) for c in contested()]).first())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("into", T.StringType()), T.StructField("word", T.StringType())])))
def spellings_udf(word: pd.Series, around: pd.Series) -> pd.Series:
    """For a word that isn't in the alphabet around it: its spelling there."""
    return pd.Series([
        [] if not d or script(w[0]) == d or (x := spelled_alike(w, d)) is None else [(d, x)] for w, d in zip(word, around)
    ])


def with_words(text: Column, words: Column) -> Column:
    """A text with whole words replaced by a map, which is null for most texts."""
    entry = lambda t, e: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})"), e["key"], F.lit(r"(?!\p{L})")), e["value"])
    return F.when(words.isNull(), text).otherwise(F.aggregate(F.map_entries(words), text, entry))


def consistent_form(df: DataFrame, keys: list[str], text: str, out: str = "normal") -> DataFrame:
    """Add column `out`, the consistent form of `text`; the keys identify a row.

    Null stays null, an empty text empty, and blank texts are rewritten like others. Keys may be null. Rows
    that repeat their keys must hold the same text. All other columns stay; one that is named as `out` is
    replaced. An empty table gives an empty table. Letter and word statistics are taken over all rows; those
    of words are joined back, so nothing grows on the driver. Each text is read in Python at most once, and
    what that changes is written: only changed texts are joined to the rows.
    """
    notes = df.select(*keys, F.col(text).alias("__lk_text"), first_pass_of(F.col(text), letter_counts(df, text)).alias("__lk_first"))
    changed = F.when(F.col("__lk_text") != F.col("__lk_first.text"), F.col("__lk_first.text")).alias("__lk_changed")
    notes = cut(notes.select(*keys, changed, F.col("__lk_first.around").alias("__lk_around"), F.col("__lk_first.alike").alias("__lk_alike")))
    words = notes.select(*keys, "__lk_around", F.explode("__lk_alike").alias("__lk_word"))
    words = words.distinct()  # of a text each word once, and of repeated rows, too
    seen = words.groupBy("__lk_around", "__lk_word").agg(F.count("*").alias("__lk_n"))
    foreign = seen.withColumn("__lk_as", F.explode(spellings_udf("__lk_word", "__lk_around")))
    native = seen.select(F.col("__lk_around").alias("__lk_d"), F.col("__lk_word").alias("__lk_x"), F.col("__lk_n").alias("__lk_native"))
    home = seen.groupBy(F.col("__lk_word").alias("__lk_h")).agg(F.sum("__lk_n").alias("__lk_all"))
    choice = (
        foreign.join(native, (F.col("__lk_as.into") == F.col("__lk_d")) & (F.col("__lk_as.word") == F.col("__lk_x")), "left")
        .join(home, F.col("__lk_word") == F.col("__lk_h"), "left")
        .where(
            F.coalesce("__lk_native", F.lit(0)).cast("long").__ge__(F.col("__lk_n"))
            | (F.col("__lk_native").isNull() & (F.col("__lk_all") == F.col("__lk_n")) & (F.col("__lk_around") == "L") & (F.length("__lk_word") > 2))
        )
        .select("__lk_around", "__lk_word", F.col("__lk_as.word").alias("__lk_to"))
    )
    d, w = F.col("__lk_around"), F.col("__lk_word")
    at_home = (d == "L") & w.rlike(r"^\p{IsLatin}+$") | (d == "C") & w.rlike(r"^\p{IsCyrillic}+$") | (d == "G") & w.rlike(r"^\p{IsGreek}+$")
    choice = cut(choice)  # words, not texts
    per_text = (
        words.where(~at_home)  # frequent words of a text's own alphabet need no choice and stay out of the shuffle
        .join(choice, ["__lk_around", "__lk_word"])
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_set(F.struct("__lk_word", "__lk_to"))).alias("__lk_words"))
    )
    kind = per_text.schema["__lk_words"].dataType
    both = notes.where("__lk_changed IS NOT NULL").select(*keys, "__lk_changed", F.lit(None).cast(kind).alias("__lk_words")).unionByName(
        per_text.select(*keys, F.lit(None).cast("string").alias("__lk_changed"), "__lk_words")
    )
    patch = both.groupBy(*keys).agg(F.max("__lk_changed").alias("__lk_changed"), F.first("__lk_words", ignorenulls=True).alias("__lk_words"))
    patch = small(cut(patch))
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"f.{k}").eqNullSafe(F.col(f"p.{k}"))
    joined = df.alias("f").join(patch.alias("p"), on, "left")
    joined = joined.select("f.*", F.col("p.__lk_changed").alias("__lk_changed"), F.col("p.__lk_words").alias("__lk_words"))
    return joined.withColumn(out, with_words(F.coalesce("__lk_changed", F.col(text)), F.col("__lk_words"))).drop("__lk_changed", "__lk_words")


def paper_fields(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """(arxiv_id, field, text) of titles and abstracts; a repeated row of a paper repeats them."""
    papers = table(spark, sf_dir, "papers").select("arxiv_id", "title", "abstract")
    return papers.select(
        "arxiv_id",
        F.explode(F.array(
            F.struct(F.lit("title").alias("field"), F.col("title").alias("text")),
            F.struct(F.lit("abstract").alias("field"), F.col("abstract").alias("text")),
        )).alias("x"),
    ).select("arxiv_id", "x.field", "x.text")


def p3_normal(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Each title and abstract in its consistent form."""
    both = consistent_form(paper_fields(spark, sf_dir), ["arxiv_id", "field"], "text")
    return both.select("arxiv_id", "field", "normal").dropDuplicates(["arxiv_id", "field"])


def p3_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Fields whose consistent form differs from what is stored."""
    both = consistent_form(paper_fields(spark, sf_dir), ["arxiv_id", "field"], "text")
    return both.where("text <> normal").select("arxiv_id", "field").distinct()
