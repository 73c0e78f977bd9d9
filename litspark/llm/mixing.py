"""Mixing sources to target weights.

Iterative proportional fitting: token weights of the cells source x language x topic are raked to the
targets of the sources and to the corpus's own shares of languages and topics, none above its cap.
Documents are then taken by the calibrated weight of their cell: its whole part as repeats, its
fraction as the probability of one more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm.common import cut, table, token_count

#: Languages apart from these are one class. Topics are the collections; with the sources they bound the cells of a mix.
LANGUAGES = ("en", "de", "fr", "es", "ru")
#: Fitting ends when no weight moves by more than this share of the largest one, or after so many rounds.
CLOSE, ROUNDS = 1e-9, 2000
#: A source falls short if it reaches less than its target by more than this share.
SHORT = 1e-9


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, language, topic, tokens). Null and empty texts have no tokens, null languages and topics are classes of their own."""
    lang = F.lower(F.trim("lang"))
    return documents.select(
        "doc_id",
        "source",
        F.when(lang.isin(*LANGUAGES), lang).otherwise(F.lit("other")).alias("language"),
        F.coalesce(F.col("collection_id").cast("long"), F.lit(-1).cast("long")).alias("topic"),
        token_count(F.col("text")).alias("tokens"),
    )


def fitted(tokens: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], cap: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Token weights fitted to margins, the rounds that took, and the largest relative miss of a margin.

    groups: for each margin the group of each cell and the wanted total by group; the first is met last, and
    exactly where the caps allow it. Margins that the caps or empty cells contradict can't all be met: the
    weights may then go on moving, and the miss says by how much.
    """
    x, rounds = tokens.astype(np.float64).copy(), 0
    for rounds in range(1, ROUNDS + 1):
        before = x.copy()
        for of, want in reversed(groups):
            have = np.bincount(of, x, len(want))
            x = np.minimum(x * np.divide(want, have, out=np.zeros(len(want)), where=have > 0)[of], cap)
        if np.abs(x - before).max(initial=0) <= CLOSE * max(1.0, x.max(initial=0)):
            break
    of, want = groups[0]
    while True:  # what caps held back goes to cells of the same source with room; each turn meets all targets or fills a cell
        have = np.bincount(of, x, len(want))
        room = np.bincount(of, np.where(x < cap, x, 0), len(want))
        short = np.where(room > 0, np.maximum(want - have, 0), 0)
        if not (short > SHORT / 10 * np.maximum(want, 1)).any():
            break
        x = np.where(x < cap, np.minimum(x * (1 + np.divide(short, room, out=np.zeros(len(want)), where=room > 0)[of]), cap), x)
    misses = [np.abs(np.bincount(o, x, len(w)) - w) / np.maximum(w, 1) for o, w in groups]
    return x, rounds, max((float(m.max(initial=0)) for m in misses), default=0.0)


def rake(tokens: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], cap: np.ndarray) -> np.ndarray:
    return fitted(tokens, groups, cap)[0]


def wanted(targets: DataFrame) -> DataFrame:
    """One row per mix and source; a missing weight is none, a missing cap means no repeats."""
    known = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").dropDuplicates(["mix_id", "source"])
    return known.select("mix_id", "source", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))


def calibrated(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, language, topic, tokens, repeats, rounds, miss): the mean number of times that a cell's documents are taken.

    rounds is what fitting the mix took, miss the largest relative miss of one of its margins.
    """
    targets = wanted(targets)
    total = cells.agg(F.sum("tokens").alias("total"))
    margin = lambda c: cells.groupBy(c).agg(F.sum("tokens").alias(f"{c}_tokens"))
    rows = (
        targets.join(cells, "source")
        .join(F.broadcast(margin("language")), "language")
        .join(margin("topic"), "topic")
        .crossJoin(F.broadcast(total))
    )  # the broadcast sides have at most 6 rows and 1 row

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["source", "language", "topic"], ignore_index=True)
        total = float(p["total"].iloc[0])
        groups, tokens = [], p["tokens"].to_numpy(np.float64)
        _, first, of = np.unique(p["source"], return_index=True, return_inverse=True)
        want = p["target_weight"].to_numpy(np.float64)[first] * total
        groups.append((of, want))
        for c in ("language", "topic"):
            _, first, of = np.unique(p[c], return_index=True, return_inverse=True)
            natural = p[f"{c}_tokens"].to_numpy(np.float64)[first]
            groups.append((of, natural / natural.sum() * want.sum()))
        x, p["rounds"], p["miss"] = fitted(tokens, groups, tokens * p["max_repeats"].to_numpy(np.float64))
        p["repeats"] = np.divide(x, tokens, out=np.zeros(len(x)), where=tokens > 0)
        return p[["mix_id", "source", "language", "topic", "tokens", "repeats", "rounds", "miss"]]

    kind = "mix_id int, source string, language string, topic long, tokens long, repeats double, rounds int, miss double"
    return rows.groupBy("mix_id").applyInPandas(fit, kind)


def taken(documents: DataFrame, weights: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, tokens, repeats) of the documents that each mix takes; the draw depends on mix and document only."""
    w = weights.select("mix_id", "source", "language", "topic", F.col("repeats").alias("w"))
    draw = F.pmod(F.xxhash64(F.lit("mix"), "mix_id", "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    times = (F.floor("w") + (draw < F.col("w") - F.floor("w")).cast("int")).cast("int")
    return documents.join(w, ["source", "language", "topic"]).select("mix_id", "doc_id", "source", "tokens", times.alias("repeats")).where("repeats > 0")


def cells_of(documents: DataFrame) -> DataFrame:
    """Token totals by cell; written once, as several margins are taken of them."""
    return cut(documents.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))


def p8_mix(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """The documents of each mix with their repeats."""
    docs = sized(table(spark, sf_dir, "documents"))
    return taken(docs, calibrated(cells_of(docs), table(spark, sf_dir, "mix_targets")))


def shares(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """For each source of each mix: what is available, wanted, expected of the calibrated weights, and whether that falls short.

    A source without documents has none available; sources that no mix names and documents without
    source count towards the total size only.
    """
    docs, targets = sized(table(spark, sf_dir, "documents")), wanted(table(spark, sf_dir, "mix_targets"))
    cells = cells_of(docs)
    total = cells.agg(F.sum("tokens").alias("total"))
    got = calibrated(cells, targets).groupBy("mix_id", "source").agg(F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("repeats")).alias("expected"))
    x = targets.join(got, ["mix_id", "source"], "left").crossJoin(F.broadcast(total))  # one row
    return x.select(
        "mix_id", "source", "target_weight", "max_repeats",
        F.coalesce("available", F.lit(0)).alias("available"),
        (F.col("target_weight") * F.coalesce("total", F.lit(0))).alias("wanted"),
        F.coalesce("expected", F.lit(0.0)).alias("expected"),
    ).withColumn("short", F.col("expected") < F.col("wanted") * (1 - SHORT))


def p8_shares(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Target and reached share of each source in each mix, counted over the documents taken."""
    reached = p8_mix(spark, sf_dir).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached"), F.max("repeats").alias("most_repeats"))
    size = reached.groupBy("mix_id").agg(F.sum("reached").alias("size"))
    return (
        wanted(table(spark, sf_dir, "mix_targets")).join(reached, ["mix_id", "source"], "left").join(size, "mix_id", "left")
        .select("mix_id", "source", "target_weight", F.coalesce("reached", F.lit(0)).alias("reached"), "most_repeats",
                F.coalesce(F.try_divide(F.coalesce("reached", F.lit(0)), "size"), F.lit(0.0)).alias("share"))
    )


def p8_margins(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Wanted and reached tokens of each language and topic in each mix, with the rounds and the miss of its fitting.

    Wanted is the corpus's own share of what the mix's sources are to give; reached is counted over the documents taken.
    """
    docs = sized(table(spark, sf_dir, "documents"))
    cells, targets = cells_of(docs), table(spark, sf_dir, "mix_targets")
    weights = cut(calibrated(cells, targets))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("margin"), F.col(c).cast("string").alias("value")) for c in ("language", "topic")])).alias("m")
    reached = taken(docs, weights).join(docs.select("doc_id", "language", "topic"), "doc_id")
    reached = reached.select("mix_id", kinds, (F.col("tokens") * F.col("repeats")).alias("t")).groupBy("mix_id", "m").agg(F.sum("t").alias("reached"))
    natural = weights.select("mix_id", "source", "rounds", "miss", kinds, "tokens")
    known = natural.select("mix_id", "m", "rounds", "miss").distinct()
    corpus = cells.select(kinds, "tokens").groupBy("m").agg(F.sum("tokens").alias("natural"))
    total = cells.agg(F.sum("tokens").alias("total"))
    size = wanted(targets).join(weights.select("mix_id", "source").distinct(), ["mix_id", "source"]).groupBy("mix_id").agg(F.sum("target_weight").alias("weight"))
    x = known.join(corpus, "m").join(size, "mix_id").crossJoin(F.broadcast(total)).join(reached, ["mix_id", "m"], "left")  # one row
    share = F.col("natural") / F.sum("natural").over(Window.partitionBy("mix_id", "m.margin"))  # of at most as many rows as there are topics
    return x.select(
        "mix_id", "m.margin", "m.value", (share * F.col("weight") * F.col("total")).alias("wanted"), F.coalesce("reached", F.lit(0)).alias("reached"), "rounds", "miss"
    )


def p8_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Sources that their cap keeps from filling their share of a mix."""
    return shares(spark, sf_dir).where("short").select("mix_id", "source")


def p8_expected(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Tokens that each source gives to each mix by the fitted weights, in whole numbers."""
    return shares(spark, sf_dir).select("mix_id", "source", F.floor(F.col("expected") + 1 / 3).alias("tokens"))  # no target ends in a third


P8_FOUND_SQL = r"""
WITH d AS (
  SELECT source, CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x{85}]+'))) AS DOUBLE) AS n
  FROM documents GROUP BY source
)
SELECT m.mix_id, m.source FROM mix_targets m LEFT JOIN d ON d.source = m.source
WHERE coalesce(d.n, 0) * m.max_repeats < m.target_weight * (SELECT sum(n) FROM d)
"""

P8_EXPECTED_SQL = (
    P8_FOUND_SQL[: P8_FOUND_SQL.index("SELECT m.mix_id")]
    + """
SELECT m.mix_id, m.source, CAST(floor(least(coalesce(d.n, 0) * m.max_repeats, m.target_weight * (SELECT sum(n) FROM d)) + 1.0::DOUBLE / 3) AS BIGINT) AS tokens
FROM mix_targets m LEFT JOIN d ON d.source = m.source
"""
)
