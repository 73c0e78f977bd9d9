"""Filling fixed-capacity containers with items.

Vector bin packing: an item takes up tokens, a segment and loss-bearing tokens of its container, each of
them limited. A container is filled with the item that has the largest dot product with what is left in
it. Items are packed in windows of a partition, so that the first round shuffles nothing; items of containers
that a window left underfull are packed again with the next one. What a partition leaves underfull at its end
is packed again with that of the others, in rounds that grow smaller, so the fill doesn't depend on how the
input is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import SIGNS, WORDS, cut, table

TOKENS, SEGMENTS = 1024, 32
#: Signs bear no loss; a container may hold at most so many tokens that do.
LOSS = 1024
WINDOW = 8192
#: Containers filled less than this are opened again in the next window.
FULL = 0.98


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container of each item, counted from 0. sizes: a row per item, each within the limits.

    Items of equal size are interchangeable, so each step looks at distinct sizes only.
    """
    if (sizes > limits).any():
        raise ValueError("an item exceeds a limit on its own")
    kinds, kind, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    starts = np.searchsorted(kind[order], np.arange(len(kinds)))
    share = kinds / limits
    taken = np.zeros(len(kinds), dtype=np.int64)
    out = np.full(len(sizes), -1)
    box, done, live = 0, 0, np.arange(len(kinds))
    while done < len(sizes):
        room = limits.astype(np.float64).copy()
        fits = live
        while True:
            fits = fits[(kinds[fits] <= room).all(axis=1) & (taken[fits] < left[fits])]
            if not len(fits):
                break
            best = fits[np.argmax(share[fits] @ (room / limits))]
            out[order[starts[best] + taken[best]]] = box
            taken[best] += 1
            room -= kinds[best]
            done += 1
        box += 1
        live = live[taken[live] < left[live]]
    return out


def _round(items: DataFrame, limits: tuple[int, int, int], number: int, last: bool) -> DataFrame:
    """Items with their container; it is null for those of underfull containers, unless the round is the last."""
    kind = dict(items.dtypes)["id"]
    most = np.array(limits, dtype=np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = TaskContext.get().partitionId()
        waiting, used = [], 0

        def window(rows: pd.DataFrame, keep: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            """The rows of containers that are ready, and the others; with keep at least one container is ready."""
            nonlocal used
            sizes = np.column_stack([rows["tokens"], np.ones(len(rows)), rows["loss"]]).astype(np.float64)
            box = pack(sizes, most)
            fill = (np.column_stack([np.bincount(box, sizes[:, i]) for i in range(3)]) / most).max(axis=1)
            ready = fill >= FULL
            if keep and not ready.any():
                ready[:] = True
            names = used + np.cumsum(ready) - 1
            used += int(ready.sum())
            gone = ready[box]
            out = rows[gone].copy()
            out["container"] = [f"{number}-{where}-{n}" for n in names[box[gone]]]
            if last and not keep:
                rest = rows[~gone].copy()
                _, again = np.unique(box[~gone], return_inverse=True)
                rest["container"] = [f"{number}-{where}-{used + n}" for n in again]
                out, gone = pd.concat([out, rest]), np.ones(len(rows), dtype=bool)
            return out, rows[~gone]

        for b in batches:
            waiting.append(b)
            while sum(map(len, waiting)) >= 2 * WINDOW:
                rows = pd.concat(waiting, ignore_index=True)
                out, again = window(rows.iloc[:WINDOW], True)
                waiting = [again, rows.iloc[WINDOW:]]
                yield out
        if waiting and sum(map(len, waiting)):
            rows = pd.concat(waiting, ignore_index=True)
            while len(rows) > 2 * WINDOW:
                out, again = window(rows.iloc[:WINDOW], True)
                rows = pd.concat([again, rows.iloc[WINDOW:]], ignore_index=True)
                yield out
            out, again = window(rows, False)
            if len(out):
                yield out
            if len(again):
                yield again.assign(container=None)

    return items.select("id", "part", "parts", "tokens", "loss").mapInPandas(
        run, f"id {kind}, part int, parts int, tokens long, loss long, container string"
    )


def pack_partitions(items: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """(id, part, parts, tokens, loss, container) of items (id, part, parts, tokens, loss) that fit a container each.

    The rounds end when what is left fits a partition, or when packing it again gained less than half of it:
    items that leave every container underfull are then in the best ones found.
    """
    left, done, number, before, last = items, None, 0, None, False
    while True:
        out = cut(_round(left, limits, number, last))
        full = out.where("container IS NOT NULL")
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        left = out.where("container IS NULL").drop("container")
        n = left.count()
        if not n:
            return done
        parts = -(-n // (4 * WINDOW))
        last = parts == 1 or before is not None and 2 * n > before
        left = left.repartition(parts, "id", "part").sortWithinPartitions("id", "part")  # in an order that a repeated task keeps
        number, before = number + 1, n


def cut_items(df: DataFrame, key: str, tokens: Column, loss: Column, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """(id, part, parts, tokens, loss): an item above a limit is divided into full parts and a rest, others are whole.

    Loss-bearing tokens are spread evenly over the parts of a divided item. Null sizes count as 0.
    """
    none = F.lit(0).cast("long")
    x = df.select(F.col(key).alias("id"), F.coalesce(tokens, none).alias("t"), F.coalesce(loss, none).alias("l"))
    dense = F.ceil(F.col("l") / limits[2]) > F.ceil(F.col("t") / limits[0])  # the loss limit divides it further
    step = F.when(dense, F.floor(F.col("t") * limits[2] / F.col("l"))).otherwise(F.lit(limits[0])).cast("long")
    x = x.withColumn("step", F.greatest(F.lit(1).cast("long"), step))
    x = x.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("t") / F.col("step"))).cast("int"))
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    size = F.least(F.col("step"), F.col("t") - F.col("part") * F.col("step")).cast("long")
    before = lambda n: F.floor(F.col("l") * F.least(F.col("t"), n * F.col("step")) / F.greatest(F.col("t"), F.lit(1)))
    share = F.least(before(F.col("part") + 1) - before(F.col("part")), size, F.lit(limits[2]))
    return x.select("id", "part", "parts", size.alias("tokens"), share.cast("long").alias("loss"))


def _tokens(c: Column) -> tuple[Column, Column]:
    count = lambda p: F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0)).cast("long")
    return count(WORDS), count(SIGNS)


def packed_pairs(df: DataFrame, key: str, prompt: str, response: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """Instruction pairs assigned to containers: all tokens count towards the first limit, those of the response bear the loss."""
    (a, b), (c, d) = _tokens(F.col(prompt)), _tokens(F.col(response))
    sized = df.select(F.col(key).alias("id"), (a + b + c + d).alias("t"), (c + d).alias("l"))
    return pack_partitions(cut_items(sized, "id", F.col("t"), F.col("l"), limits), limits)


def packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts assigned to containers, by their WordPunct tokens; words bear the loss, signs don't.

    Null and empty texts are items of no tokens, which still take a segment. Repeated rows are items each.
    Other columns are ignored, whatever their names; an empty table gives no containers.
    """
    words, signs = _tokens(F.col(text))
    sized = df.select(F.col(key).alias("id"), words.alias("w"), signs.alias("s"))
    return pack_partitions(cut_items(sized, "id", F.col("w") + F.col("s"), F.col("w")))


def p7_packed(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Each document, or each part of one above the capacity, with its container."""
    return packed(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Documents that stand in several containers: none is divided unless it alone exceeds one."""
    parts = p7_packed(spark, sf_dir).where("parts > 1").groupBy("doc_id").agg(F.count_distinct("container").alias("n"))
    return parts.where("n > 1").select("doc_id")


#: Of instruction data: the loss-bearing tokens of a container are limited below its tokens, and its segments too.
PAIR_LIMITS = (TOKENS, 16, 900)


def p7_pairs(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Research questions with their summaries, packed as instruction data under three limits that all bind."""
    memory = table(spark, sf_dir, "paper_memory").dropDuplicates(["paper_id"])
    return packed_pairs(memory, "paper_id", "research_question", "summary", PAIR_LIMITS).withColumnRenamed("id", "paper_id")


def p7_documents(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Tokens and parts of each document, summed over the containers that hold it."""
    return p7_packed(spark, sf_dir).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"))


def p7_limits(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """What all containers hold together, and whether they keep the limits and leave at most 2 % and a container unused."""
    boxes = p7_packed(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss").alias("l"))
    best = F.ceil(F.sum("t") / TOKENS)
    return boxes.agg(
        F.sum("t").alias("tokens"), F.sum("s").alias("items"), F.coalesce(F.max("t") <= TOKENS, F.lit(True)).alias("tokens_kept"),
        F.coalesce(F.max("s") <= SEGMENTS, F.lit(True)).alias("segments_kept"), F.coalesce(F.max("l") <= LOSS, F.lit(True)).alias("loss_kept"),
        F.coalesce(F.count("*") <= 1.02 * best + 1, F.lit(True)).alias("filled"),
    )


_COUNT = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x{85}]+'))"

P7_FOUND_SQL = f"SELECT DISTINCT doc_id FROM documents WHERE {_COUNT} > 1024"
P7_DOCUMENTS_SQL = f"""
SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil(n / 1024))) AS BIGINT) AS parts
FROM (SELECT doc_id, coalesce({_COUNT}, 0) AS n FROM documents) GROUP BY doc_id
"""
P7_LIMITS_SQL = f"""
SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil(n / 1024))) AS BIGINT) AS items,
  true AS tokens_kept, true AS segments_kept, true AS loss_kept, true AS filled
FROM (SELECT coalesce({_COUNT}, 0) AS n FROM documents)
"""
