"""Near-duplicate records with small edits.

A record's signature has one minhash symbol per position; two records differ in a position with the
probability 1 - similarity. The signature is cut into segments, so few that a pair within the Hamming
threshold has a segment that differs in at most one position (with m segments: every pair that differs
in at most 2m - 1 positions). Each segment is indexed under its variants with one position deleted,
an equality join on the variants yields candidates, and each candidate is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import connected_components, cut, pairs_within, small, table
from litspark.llm.lookalikes import consistent_form

SEGMENTS, SEGMENT = 16, 4
#: Variants that more records share than this are resolved by their rarest shingles instead of pair by pair.
HOT = 48

#: Texts are worked on in groups of about so many characters; each text is always whole.
GROUP = 1_000_000
_random = np.random.default_rng(20_260_101)
MULTIPLY = _random.integers(1, 2**63, SEGMENTS * SEGMENT, dtype=np.uint64) | np.uint64(1)
ADD = _random.integers(0, 2**63, SEGMENTS * SEGMENT, dtype=np.uint64)
MIX = _random.integers(1, 2**63, (SEGMENTS, SEGMENT, SEGMENT), dtype=np.uint64) | np.uint64(1)
for _i in range(SEGMENT):
    MIX[:, _i, _i] = 0  # the variant that lacks position i
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Whether a code point below 0x20000 is a letter, digit or underscore; those above count as letters."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x20000)] + [True])


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    grow = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, dtype=np.uint64))))
    return grow(np.uint64(_BASE)), grow(np.uint64(pow(_BASE, -1, 1 << 64)))


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word sequences of each text, sorted by both."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    wordy = np.concatenate(([False], word_characters()[np.minimum(codes, np.uint32(0x20000))], [False]))
    edges = np.flatnonzero(wordy[1:] != wordy[:-1])
    at, to = edges[::2], edges[1::2]
    if len(at) < words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(1 << max(16, int(n).bit_length()))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(77)) * up[:n], dtype=np.uint64)))
        word = _mixed((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64))
        count = len(word) - words + 1
        h = np.zeros(count, dtype=np.uint64)
        for k in range(words):
            h = _mixed(h * np.uint64(_BASE) + word[k : k + count])
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), at, side="right")
    whole = text[words - 1 :] == text[:count]
    of, h = text[:count][whole], h[whole]
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def shingles_of(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the word sequences of a text, sorted."""
    return shingles([text or ""], words)[1]


def variants(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the one-deletion variants of the segments of each signature, a row for each set of shingles."""
    signature = np.empty((len(starts), SEGMENTS * SEGMENT), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEGMENTS * SEGMENT):
            x = h * MULTIPLY[k] + ADD[k]
            x ^= x >> np.uint64(29)
            signature[:, k] = np.minimum.reduceat(x * np.uint64(_BASE), starts)
        kept = signature.reshape(-1, SEGMENTS, 1, SEGMENT) * MIX
        kept ^= kept >> np.uint64(31)
        return (kept * MIX).sum(axis=3, dtype=np.uint64).reshape(len(starts), -1)


def variants_of(h: np.ndarray) -> np.ndarray:
    return variants(h, np.zeros(1, dtype=np.int64))[0]


def sketch(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, sid, shingles, variants); records of equal shingles have one sid; too short ones are left out."""

    def group(keys: pd.Series, texts: list[str]) -> pd.DataFrame:
        of, h = shingles(texts, words)
        if not len(h):
            return pd.DataFrame({"k": keys.iloc[:0], "sid": [], "shingles": [], "variants": []}).astype({"shingles": object, "variants": object})
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        with np.errstate(over="ignore"):
            sid = _mixed(np.add.reduceat(_mixed(h ^ np.uint64(_BASE)), starts) + np.diff(np.concatenate((starts, [len(h)]))).astype(np.uint64))
        rows = variants(h, starts).view(np.int64)
        parts = np.split(h.view(np.int64), starts[1:])
        return pd.DataFrame({"k": keys.iloc[of[starts]].to_numpy(), "sid": sid.view(np.int64), "shingles": parts, "variants": list(rows)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, at = [t or "" for t in b["t"]], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP):
                    size += len(texts[to]) + 1
                    to += 1
                yield group(b["k"].iloc[at:to], texts[at:to])
                at = to

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(
        run, f"k {kind}, sid long, shingles array<long>, variants array<long>"
    )


def one_per_class(sketches: DataFrame) -> DataFrame:
    """(sid, shingles, variants), a row per class. Only the numbers of further copies are shuffled, the sets stay where they are."""
    numbered = sketches.withColumn("u", F.monotonically_increasing_id())  # of what was written, so it stays the same
    classes = numbered.groupBy("sid").agg(F.min("u").alias("first"), F.count("*").alias("n")).where("n > 1")
    further = cut(numbered.select("u", "sid").join(classes, "sid").where("u <> first").select("u"))
    return numbered.join(small(further), "u", "left_anti").select("sid", "shingles", "variants")


def shared_variants(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of variants that two or three records share, and the rows (sid, v, n) of those that more share.

    Nearly all shared variants have two or three records, which follow from their minimum, maximum and parity.
    """
    index = texts.select("sid", F.explode("variants").alias("v"))
    counted = index.groupBy("v").agg(F.count("*").alias("n"), F.min("sid").alias("a"), F.max("sid").alias("c"), F.bit_xor("sid").alias("x"))
    shared = cut(counted.where("n > 1"))
    three = F.struct("a", F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("c")).alias("b"), "c")
    trio = shared.where("n = 3").select(three.alias("t"))
    pair = lambda p, q: F.struct(F.col(f"t.{p}").alias("a"), F.col(f"t.{q}").alias("b"))
    trios = trio.select(F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("p")).select("p.a", "p.b")
    few = shared.where("n = 2").select("a", F.col("c").alias("b")).union(trios)
    more = shared.where("n > 3").select("v", "n")
    if more.isEmpty():
        return few, texts.select("sid", F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("n")).where("false")
    return few, cut(index.join(small(more), "v").select("sid", "v", "n"))


def verified(candidates: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    candidates = cut(candidates.distinct())
    needed = small(cut(candidates.select(F.explode(F.array("a", "b")).alias("sid")).distinct()))
    side = texts.join(needed, "sid", "left_semi").select("sid", "shingles")
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        candidates.join(side.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(side.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b")
        .where(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
    )


def similar_classes(sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of sids whose shingle sets have at least this Jaccard similarity."""
    texts = one_per_class(sketches)
    candidates, more = shared_variants(texts)
    candidates = candidates.union(pairs_within(more.where(F.col("n") <= HOT), "v", "sid", HOT))
    hot = more.where(F.col("n") > HOT).select("sid").distinct()
    if not hot.isEmpty():
        candidates = candidates.union(pairs_within(rarest_shingles(texts, hot, similarity), "s", "sid", 16 * HOT))
    return verified(candidates, texts, similarity)


def rarest_shingles(texts: DataFrame, hot: DataFrame, similarity: float) -> DataFrame:
    """(sid, s): of the records of hot variants, the rarest shingles one of which any two similar ones share.

    Exact: of two sets with this similarity, each has a shared element among its first
    size - ceil(similarity * size) + 1, in any order that is common to all.
    """
    s = texts.join(hot, "sid", "left_semi").select("sid", "shingles", F.posexplode("shingles").alias("_", "s"))
    s = s.select("sid", F.size("shingles").alias("size"), "s")
    often = s.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    ranked = (
        s.join(often, "s", "left")
        .groupBy("sid", "size")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "s"))).alias("r"))
    )
    keep = F.col("size") - F.ceil(F.lit(similarity) * F.col("size")) + 1
    first = ranked.select("sid", F.explode(F.slice("r", F.lit(1), keep.cast("int"))).alias("x")).where("x.f > 1")
    return first.select("sid", F.col("x.s").alias("s"))


def crossing(rows: DataFrame, block: str) -> DataFrame:
    """(a, b): pairs of rows (block, sid, part) of a block that belong to different parts.

    The rows of a block's largest part don't meet each other: what is met are the rows outside of it with all
    others, so a block that is nearly one part costs about its size.
    """
    size = rows.groupBy(block, "part").agg(F.count("*").alias("n"))
    main = size.groupBy(block).agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    marked = rows.join(main, block)
    x, y = marked.where("part <> main").alias("x"), marked.alias("y")
    met = (F.col(f"x.{block}") == F.col(f"y.{block}")) & (F.col("x.part") != F.col("y.part"))
    once = (F.col("y.part") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid"))
    return x.join(y, met & once).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))


def similar_groups(sketches: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the similar classes, without pairing all of them.

    The records of a variant are compared with its representative, the smallest of them, first. Only pairs
    that the links found so far leave in different groups are compared after that, and all of these are, so
    the groups are those of similar_classes().
    """
    texts = one_per_class(sketches)
    few, more = shared_variants(texts)
    low = more.groupBy("v").agg(F.min("sid").alias("a"))
    stars = more.join(low, "v").where("sid <> a").select("a", F.col("sid").alias("b"))
    links = cut(verified(few.union(stars), texts, similarity))
    if more.isEmpty():
        return connected_components(links)
    parts = connected_components(links)
    known = more.join(parts, more.sid == parts.node, "left").select("v", "n", "sid", F.coalesce("component", "sid").alias("part"))
    left = crossing(known.where(F.col("n") <= HOT), "v")
    hot = known.where(F.col("n") > HOT).select("sid", "part").distinct()
    rare = rarest_shingles(texts, hot.select("sid"), similarity).join(hot, "sid")
    left = left.union(crossing(rare, "s"))
    return connected_components(links.union(verified(left, texts, similarity)))


def near_copies(df: DataFrame, key: str, text: str, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members (k, sid) of the classes of equal texts, and links (a, b) between similar classes.

    Rows that repeat their key hold the same text. Null and short texts have no shingles and belong to no
    class; an empty table gives empty results. Other columns are ignored, whatever their names.
    """
    sketches = cut(sketch(df, key, text, words))
    return sketches.select("k", "sid").distinct(), similar_classes(sketches, similarity)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(k, group, links): the connected group of each record, named by its smallest class, and its number of linked classes."""
    links = cut(links)
    parts = connected_components(links)
    degree = links.select(F.col("a").alias("sid")).union(links.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("links"))
    return (
        members.join(parts, members.sid == parts.node, "left").join(degree, "sid", "left")
        .select("k", F.coalesce("component", "sid").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def paper_texts(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """(arxiv_id, text): title, space and abstract in the consistent form; a repeated row of a paper repeats them."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    papers = table(spark, sf_dir, "papers").select("arxiv_id", F.concat(part("title"), F.lit(" "), part("abstract")).alias("text"))
    return consistent_form(papers, ["arxiv_id"], "text", "text")


#: Of papers: three-word sequences and a similarity of at least 0.5, as their definition says.
PAPER_WORDS, PAPER_SIMILARITY = 3, 0.5


def p1_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Pairs of papers whose title and abstract are near-duplicates, copies within a class included."""
    members, links = near_copies(paper_texts(spark, sf_dir), "arxiv_id", "text", PAPER_WORDS, PAPER_SIMILARITY)
    x, y = members.select(F.col("k").alias("x"), F.col("sid").alias("a")), members.select(F.col("k").alias("y"), F.col("sid").alias("b"))
    across = links.join(x, "a").join(y, "b").select("x", "y")
    inside = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.union(inside).select(F.least("x", "y").alias("arxiv_id_a"), F.greatest("x", "y").alias("arxiv_id_b")).distinct()


def p1_groups(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Each paper with the group of edited copies that it belongs to and the group's number of different texts."""
    sketches = cut(sketch(paper_texts(spark, sf_dir), "arxiv_id", "text", PAPER_WORDS))
    parts = similar_groups(sketches, PAPER_SIMILARITY)
    members = sketches.select(F.col("k").alias("arxiv_id"), "sid").distinct()
    size = parts.groupBy("component").agg(F.count("*").alias("texts"))
    grouped = members.join(parts.join(size, "component"), members.sid == parts.node, "left")
    return grouped.select("arxiv_id", F.coalesce("component", "sid").alias("group"), F.coalesce("texts", F.lit(1)).alias("texts"))
