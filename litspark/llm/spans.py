"""Long exact spans shared between records, and fuzzy passages around them.

Records are sampled at k-mer seeds by winnowing, so that every span of the wanted length has a seed at the
same place in each record that holds it. Seeds are joined: every holder of a seed meets the seed's
representative, the smallest record that holds it, so what a third of all records share costs a pair a
record. Where three or more hold a seed, the representative may share less than the wanted length with a
record that another one shares it with; the windows of that length around such seeds, and for fuzzy passages
pairs of seeds in order, have representatives of their own. For each pair of records a Fenwick tree chains
all seeds they share, in order in both, under gap costs, and the chains are aligned: matches are extended to
exact blocks, what lies between blocks is compared, and blocks of the wanted length are exact spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm.common import cut, kept, pairs_within, table

SPAN, K = 100, 40
#: With pair_all, seeds of more occurrences than this are paired in chunks of about so many.
HOT = 24
#: Cost of a character between matches that follow each other in a chain.
GAP = 0.25

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        grow = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, dtype=np.uint64))))
        _powers[base] = got = grow(np.uint64(base)), grow(np.uint64(inverse))
    return got[0][:n], got[1][:n]


def hashes(codes: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """A hash of each window of k code points."""
    if len(codes) < k:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers_of(base, len(codes) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(base)) * up[: len(codes)], dtype=np.uint64)))
        return _mix((sums[k:] - sums[:-k]) * down[: len(codes) - k + 1]) | np.uint64(1)


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each window of w values, in linear time."""
    f = np.minimum if least else np.maximum
    n = len(x) - w + 1
    pad = -len(x) % w
    full = np.concatenate((x, np.repeat(x[-1:], pad))).reshape(-1, w)
    left = f.accumulate(full, axis=1).ravel()
    right = f.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[:n], left[w - 1 : w - 1 + n])


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each begins, with the end last."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate(([0], np.cumsum(lengths)))


def seeds(texts: list[str], span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, offset, hash) of the seeds of texts of at least `span` characters."""
    empty = np.empty(0, dtype=np.int64)
    codes, starts = encode(texts)
    w = span - k + 1
    if len(codes) < span:
        return empty, empty, empty.astype(np.uint64)
    h = hashes(codes, k)
    low = sliding(h, w, True)
    own = np.repeat(np.arange(len(texts)), np.diff(starts))
    inside = np.arange(len(low)) + span <= starts[own[: len(low)] + 1]
    low[~inside] = 0
    edge = np.zeros(w - 1, dtype=np.uint64)
    high = sliding(np.concatenate((edge, low, edge)), w, False)
    at = np.flatnonzero(h == high[: len(h)])
    x, of = h[at], own[at]
    same = (x[1:] == x[:-1]) & (of[1:] == of[:-1]) & (np.diff(at) < w)  # of a run in periodic text only two at either end
    no = np.zeros(2, dtype=bool)
    left, right = np.concatenate((no, same)), np.concatenate((same, no))
    keep = ~(left[1:] & left[:-1] & right[1:] & right[:-1])
    at, x, of = at[keep], x[keep], of[keep]
    return of, at - starts[of], x


class Fenwick:
    """Prefix maxima with the position that holds them."""

    def __init__(self, n: int) -> None:
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Of the positions before i."""
        top = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > top[0]:
                top = self.best[i]
            i -= i & -i
        return top


def chains(matches: list[tuple[int, int]], k: int = K, gap: float = GAP) -> list[list[tuple[int, int]]]:
    """Ordered matches, best chains first; each match is in one chain.

    The scores are computed once. Chains are taken from the best end back to a match that a better one has
    taken already, so any number of chains costs no more than sorting the matches.
    """
    left = sorted(set(matches))
    ranks = {b: i for i, b in enumerate(sorted({b for _, b in left}))}
    tree, score, back = Fenwick(len(ranks)), [0.0] * len(left), [-1] * len(left)
    i = 0
    while i < len(left):
        j = i
        while j < len(left) and left[j][0] == left[i][0]:  # matches of one place can't follow each other
            a, b = left[j]
            best, who = tree.upto(ranks[b])
            gain = best - gap * (a + b) if who >= 0 else 0.0
            if who >= 0:  # what overlaps the match before counts once
                gain -= max(0, k - min(a - left[who][0], b - left[who][1]))
            score[j], back[j] = (k + gain, who) if gain > 0 else (float(k), -1)
            j += 1
        for x in range(i, j):
            tree.put(ranks[left[x][1]], score[x] + gap * sum(left[x]), x)
        i = j
    out, taken = [], [False] * len(left)
    for at in sorted(range(len(left)), key=lambda x: -score[x]):
        chain = []
        while at >= 0 and not taken[at]:
            taken[at] = True
            chain.append(left[at])
            at = back[at]
        if chain:
            out.append(chain[::-1])
    return out


def common_prefix(a: str, b: str) -> int:
    n, step = 0, 64
    most = min(len(a), len(b))
    while n < most and a[n : n + step] == b[n : n + step]:
        n += step
    n = min(n, most)
    while n < most and a[n] == b[n]:
        n += 1
    return n


def edits(a: str, b: str) -> int:
    """Edit distance of what lies between two blocks; a column of the table is two bit vectors (Myers 1999, Hyyrö 2003)."""
    if a == b:
        return 0
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last, cost = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    more, less = full, 0
    for y in b:
        same = at.get(y, 0)
        flat = same | less
        across = ((same & more) + more ^ more) | same
        up, down = less | full & ~(across | more), more & across
        cost += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, down << 1 & full
        more, less = down | full & ~(flat | up), up & flat
    return cost


def align(chain: list[tuple[int, int]], a: str, b: str, k: int = K) -> tuple[list[tuple[int, int, int]], tuple[int, int, int, int, int]] | None:
    """Exact blocks (start in a, start in b, length) of a chain, and its passage (start and end in a, in b, and edits)."""
    blocks: list[tuple[int, int, int]] = []
    for x, y in chain:
        if a[x : x + k] != b[y : y + k]:
            continue  # two k-mers of one hash
        if blocks and blocks[-1][0] - blocks[-1][1] == x - y and x + k <= blocks[-1][0] + blocks[-1][2]:
            continue
        before = common_prefix(a[:x][::-1][:4096], b[:y][::-1][:4096]) if min(x, y) <= 4096 else _back(a, b, x, y)
        blocks.append((x - before, y - before, before + k + common_prefix(a[x + k :], b[y + k :])))
    if not blocks:
        return None
    cost, end_a, end_b = 0, blocks[0][0], blocks[0][1]
    for x, y, n in blocks:
        cost += edits(a[end_a : max(x, end_a)], b[end_b : max(y, end_b)])
        end_a, end_b = max(end_a, x + n), max(end_b, y + n)
    return blocks, (blocks[0][0], end_a, blocks[0][1], end_b, cost)


def _back(a: str, b: str, x: int, y: int) -> int:
    n = 0
    while n < min(x, y) and a[x - n - 1] == b[y - n - 1]:
        n += 1
    return n


PASSAGES = "rid string, start int, end int, other string, o_start int, o_end int, exact boolean, edits int"


def common_seeds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the seeds (hashes in order, places) that two texts share."""
    h, place = b
    low, high = np.searchsorted(h, a[0], "left"), np.searchsorted(h, a[0], "right")
    n = high - low
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return list(zip(np.repeat(a[1], n).tolist(), place[np.repeat(low, n) + within].tolist()))


def _align_pairs(span: int, k: int):  # noqa: ANN202
    def known(rids: pd.Series, texts: pd.Series) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        once = ~rids.duplicated()
        rids, texts = list(rids[once]), list(texts[once])
        of, pos, h = seeds(texts, span, k)
        order = np.lexsort((h, of))
        pos, h = pos[order], h[order]
        ends = np.searchsorted(of[order], np.arange(len(rids) + 1))
        return {r: (h[x:y], pos[x:y]) for r, x, y in zip(rids, ends[:-1], ends[1:])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                p, rows = batch.iloc[at : at + 1000], []
                one, two = known(p["ra"], p["ta"]), known(p["rb"], p["tb"])
                for ra, rb, ta, tb in zip(p["ra"], p["rb"], p["ta"], p["tb"]):
                    for chain in chains(common_seeds(one[ra], two[rb]), k):
                        got = align(chain, ta, tb, k)
                        if got is None:
                            continue
                        blocks, (a0, a1, b0, b1, cost) = got
                        for x, y, n in blocks:
                            if n >= span:
                                rows += [(ra, x, x + n, rb, y, y + n, True, 0), (rb, y, y + n, ra, x, x + n, True, 0)]
                        if cost and min(a1 - a0, b1 - b0) >= span:
                            rows += [(ra, a0, a1, rb, b0, b1, False, cost), (rb, b0, b1, ra, a0, a1, False, cost)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PASSAGES.split(", ")])

    return run


def _stars(keys: DataFrame, *columns: str) -> DataFrame:
    """(ra, rb): each record (rid) of a key with the smallest one of it; keys of a single record have none.

    The smallest is found with a partial aggregate before the shuffle, and the join leaves a key of very many
    records to adaptive splitting: no task holds a key's records.
    """
    low = keys.groupBy(*columns).agg(F.min("rid").alias("ra"), F.max("rid").alias("_hi")).where("ra <> _hi").drop("_hi")
    return keys.join(low, list(columns)).where("rid <> ra").select("ra", F.col("rid").alias("rb"))


def _windows(span: int, k: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, text, at in zip(b["rid"], b["text"], b["at"]):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                one, two, at = hashes(codes, span), hashes(codes, span, _BASE2), np.asarray(at)
                take = np.zeros(len(one) + 1, dtype=np.int64)
                np.add.at(take, np.clip(at - (span - k), 0, len(one)), 1)
                np.add.at(take, np.clip(at + 1, 0, len(one)), -1)
                on = np.flatnonzero(np.cumsum(take)[:-1] > 0)
                rows.append(pd.DataFrame({"x": one[on].view(np.int64), "y": two[on].view(np.int64), "rid": rid}).drop_duplicates())
            yield pd.concat(rows) if rows else pd.DataFrame({"x": [], "y": [], "rid": []})

    return run


def _in_order(shared: DataFrame) -> DataFrame:
    """(x, y, rid): pairs of seeds that follow each other in a record, one, two, four, eight ... shared seeds apart."""
    by_record = shared.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda s: s.h).alias("g"))
    steps = "transform(sequence(0, 20), e -> shiftleft(1, e))"
    pairs = f"flatten(transform({steps}, d -> transform(slice(g, 1, greatest(0, size(g) - d)), (x, i) -> struct(x AS x, g[i + d] AS y))))"
    return by_record.select("rid", F.explode(F.expr(pairs)).alias("p")).select("p.x", "p.y", "rid")


def shared_passages(records: DataFrame, span: int = SPAN, k: int = K, pair_all: bool = False, fuzzy: bool = True) -> DataFrame:
    """Passages of records (rid, text) that other records hold too: (rid, start, end, other, o_start, o_end, exact, edits).

    Exact passages have at least `span` characters and extend as far as both records agree. Passages that
    aren't exact are chains with edits, at least as long in both. Each record is aligned with the smallest
    record of each seed, each window of `span` characters and each two seeds in order that it shares: every
    character that stands in a shared span is in an exact passage, and a record that shares two seeds in
    order is aligned with one that shares them. Without fuzzy the last of these is left out, which changes
    no exact passage's cover. With pair_all every pair of records that share a seed is aligned, whose number
    grows as the square of a passage's holders. Null and shorter texts have none; rids are unique.
    """
    long = records.where(F.length("text") >= span).select("rid", "text")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                of, pos, h = seeds(list(part["text"]), span, k)
                yield pd.DataFrame({"h": h.view(np.int64), "rid": part["rid"].to_numpy()[of], "pos": pos.astype(np.int32)})

    found = long.mapInPandas(sample, "h long, rid string, pos int")
    often = found.groupBy("h").agg(F.count("*").alias("n"), F.min("rid").alias("ra"), F.max("rid").alias("hi")).where("ra <> hi").drop("hi")
    shared = cut(found.join(often, "h"))
    if pair_all:
        pairs = pairs_within(shared.select("h", "rid").distinct(), "h", "rid", HOT).select(F.col("a").alias("ra"), F.col("b").alias("rb"))
    else:
        pairs = shared.where("rid <> ra").select("ra", F.col("rid").alias("rb"))
        many = shared.where("n > 2").groupBy("rid").agg(F.collect_set("pos").alias("at"))  # of two records the one is the other's representative
        spread = kept(many.join(long, "rid").mapInPandas(_windows(span, k), "x long, y long, rid string"))
        pairs = pairs.union(_stars(spread, "x", "y"))
        if fuzzy:
            pairs = pairs.union(_stars(kept(_in_order(shared)), "x", "y"))
    texts = lambda r, t: long.select(F.col("rid").alias(r), F.col("text").alias(t))
    both = cut(pairs.distinct()).join(texts("ra", "ta"), "ra").join(texts("rb", "tb"), "rb")
    return both.mapInPandas(_align_pairs(span, k), PASSAGES)


def maximal(passages: DataFrame) -> DataFrame:
    """One row per passage of a record that lies in no longer one of its kind, with the smallest other record that it was aligned with."""
    once = passages.groupBy("rid", "start", "end", "exact").agg(F.min(F.struct("other", "o_start", "o_end", "edits")).alias("x"))
    before = Window.partitionBy("rid", "exact").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = once.withColumn("_to", F.max("end").over(before)).where("_to IS NULL OR end > _to")
    return kept.select("rid", "start", "end", "x.other", "x.o_start", "x.o_end", "exact", "x.edits")


def overlap(records: DataFrame, passages: DataFrame) -> DataFrame:
    """(rid, length, shared, share): how many characters of each record lie in exact passages of other records, too."""
    spans = passages.where("exact").select("rid", "start", "end").distinct()
    covered = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    total = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda d, x: F.struct((d.n + F.greatest(F.lit(0), x.end - F.greatest(x.start, d.to))).alias("n"), F.greatest(d.to, x.end).alias("to")),
        lambda d: d.n,
    )
    length = records.select("rid", F.length("text").alias("length"))
    return length.join(covered.select("rid", total.alias("shared")), "rid", "left").select(
        "rid", "length", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce(F.try_divide("shared", "length"), F.lit(0.0)).alias("share")
    )


def span_records(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """(rid, text): quotes as q and their id, summaries as s and their paper; repeated rows once."""
    quotes = table(spark, sf_dir, "evidence").select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("rid"), F.col("quote").alias("text"))
    summaries = table(spark, sf_dir, "paper_memory").select(F.concat(F.lit("s"), F.col("paper_id")).alias("rid"), F.col("summary").alias("text"))
    return quotes.where("text IS NOT NULL").union(summaries.where("text IS NOT NULL")).dropDuplicates(["rid"])


def _named(df: DataFrame) -> DataFrame:
    field = F.when(F.substring("rid", 1, 1) == "q", F.lit("quote")).otherwise(F.lit("summary"))
    return df.withColumn("field", field).withColumn("record_key", F.expr("substring(rid, 2)")).drop("rid")


def p2_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Quotes and summaries that share a long exact span with another record."""
    found = shared_passages(span_records(spark, sf_dir), fuzzy=False).where("exact").select("rid").distinct()
    return _named(found).select("field", "record_key")


def p2_passages(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Each longest exact or fuzzy passage of a record with where it stands in another one."""
    return _named(maximal(shared_passages(span_records(spark, sf_dir)))).select(
        "field", "record_key", "start", "end", "other", "o_start", "o_end", "exact", "edits"
    )


def p2_overlap(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """For each quote and summary, how much of it also stands elsewhere."""
    records = span_records(spark, sf_dir)
    return _named(overlap(records, shared_passages(records, fuzzy=False))).select("field", "record_key", "length", "shared", "share")


_SQL_RECORDS = """
t AS (SELECT DISTINCT 'quote' AS field, CAST(id AS VARCHAR) AS record_key, quote AS x FROM evidence WHERE quote IS NOT NULL
  UNION SELECT DISTINCT 'summary', paper_id, summary FROM paper_memory WHERE summary IS NOT NULL),
w AS (SELECT field, record_key, i, substring(x, i, 100) AS s FROM (SELECT *, unnest(generate_series(1, length(x) - 99)) AS i FROM t WHERE length(x) >= 100)),
h AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT field || record_key) > 1),
m AS (SELECT w.field, w.record_key, w.i FROM w JOIN h USING (s))
"""
P2_FOUND_SQL = f"WITH {_SQL_RECORDS} SELECT DISTINCT field, record_key FROM m"
P2_OVERLAP_SQL = f"""
WITH {_SQL_RECORDS}, c AS (SELECT field, record_key, count(DISTINCT p) AS n FROM (SELECT field, record_key, unnest(generate_series(i, i + 99)) AS p FROM m) GROUP BY ALL)
SELECT t.field, t.record_key, CAST(length(x) AS INTEGER) AS length, CAST(coalesce(n, 0) AS INTEGER) AS shared,
  CASE WHEN length(x) > 0 THEN coalesce(n, 0)::DOUBLE / length(x) ELSE 0.0::DOUBLE END AS share
FROM t LEFT JOIN c USING (field, record_key)
"""
