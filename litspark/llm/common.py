"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java patterns of the WordPunct tokenizer's tokens: a run of letters, digits and underscores of any
#: script, or a run of other non-blank characters.
WORDS = r"[\p{L}\p{N}_]+"
SIGNS = r"[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir. Where it is unset make one in local mode; raise on a cluster, whose executors don't share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="litspark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written beside the checkpoints, compressed and by column, for many rows that are read more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to some tasks a core: for work whose cost is in Python, as adaptive execution sizes tasks by bytes only."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def small(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """The rows, marked for broadcast if they measure at most so many bytes; larger ones are left to a shuffled join.

    Meant for what was written before, as it is read for the measurement.
    """
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, those with the smallest hashes of their key.

    Rows that can't be among them are left out before sorting, so that the sort moves about twice the
    sample, not that many rows of each task.
    """
    rows = df.count()
    h = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40))
    kept = df if rows <= 2 * most else df.where(h < F.lit(int((1 << 40) * (2 * most + 200) / rows)))
    return kept.orderBy(h, key).limit(most)


def pairs_within(rows: DataFrame, block: str, key: str, chunk: int) -> DataFrame:
    """(a, b), a < b: the pairs of keys that share a block. rows have a key once a block.

    A block of more than `chunk` rows is divided into chunks of about that many and each chunk meets each, so
    every pair meets once and no task holds a block.
    """
    size = rows.groupBy(block).agg(F.count("*").alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / chunk)
    cells = rows.select(block, key).join(size, block).withColumn("_c", F.pmod(F.xxhash64(key), chunks))
    cells = cells.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    cells = cells.select(F.col(block).alias("_b"), F.col(key).alias("_k"), "_c", F.least("_c", "_d").alias("_low"), F.greatest("_c", "_d").alias("_high"))
    x, y = cells.alias("x"), cells.alias("y")
    met = (F.col("x._b") == F.col("y._b")) & (F.col("x._low") == F.col("y._low")) & (F.col("x._high") == F.col("y._high"))
    once = (F.col("x._c") < F.col("y._c")) | (F.col("x._low") == F.col("x._high")) & (F.col("x._k") < F.col("y._k"))
    return x.join(y, met & once).select(F.least("x._k", "y._k").alias("a"), F.greatest("x._k", "y._k").alias("b"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node of it.

    Alternates large-star and small-star steps (Kiveris et al. 2014): every step keeps the number of
    edges at or below that of the input and a hub's neighbours never gather in one row, as each step
    needs only the minimum of a neighbourhood, which is pre-aggregated before the shuffle. The rounds grow
    with the logarithm of the nodes, squared at worst; RuntimeError if `max_rounds` weren't enough.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low, large.u == low.k)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            low.select(F.col("k").alias("u"), F.col("m").alias("v"))
        )
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't converge in {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ).distinct()


def token_count(text: Column) -> Column:
    """Number of WordPunct tokens of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORDS}|{SIGNS}")), F.lit(0)).cast("long")
