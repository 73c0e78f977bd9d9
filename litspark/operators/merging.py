"""Changes of stored tables as functions of the old rows and the new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The last row of each key; all but that of each task are dropped before the shuffle."""
    by = [F.col(o).desc_nulls_last() if isinstance(o, str) else o for o in order] or [F.lit(1)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of both with new values in place of old ones; columns to keep retain the old value where there is one.

    Both have the old table's columns and at most a row per key.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = F.col(f"o.{keys[0]}") == F.col(f"n.{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    has_old = F.col(f"o.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        if c in keep:
            return F.when(has_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, on, "full").select(*[value(c) for c in old.columns])


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The rows that upsert() puts in place; of the old ones only those of the new keys are moved."""
    if not keep:
        return new.select(*old.columns)
    known = old.join(new.select(*keys), list(keys), "left_semi").select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_known"))
    both = new.join(known, list(keys), "left")
    return both.select(*[F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns])


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that insert_ignore() adds."""
    known = old.join(new.select(*keys), list(keys), "left_semi").select(*keys)
    return new.join(known, list(keys), "left_anti").select(*old.columns)


def updated(old: DataFrame, changes: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """The rows that update_where() changes, with their new values."""
    on = F.col(f"o.{keys[0]}") == F.col(f"c.{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(f"o.{k}") == F.col(f"c.{k}"))
    joined = old.alias("o").join(changes.alias("c"), on)
    return joined.select(*[values[c].alias(c) if c in values else F.col(f"o.{c}") for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows of other groups, and all new rows; groups may have no new row, which clears them."""
    return old.join(groups.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def update_where(old: DataFrame, changes: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Old rows with new values where a change has their key. values are expressions over o (old) and c (change)."""
    marked = changes.withColumn("_hit", F.lit(True)).alias("c")
    on = F.col(f"o.{keys[0]}") == F.col(f"c.{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(f"o.{k}") == F.col(f"c.{k}"))
    joined = old.alias("o").join(marked, on, "left")
    return joined.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(f"o.{c}")).alias(c) if c in values else F.col(f"o.{c}") for c in old.columns])


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that refer to no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def activate(collections: DataFrame, name: str) -> DataFrame:
    return collections.withColumn("active", F.when(F.col("name") == name, 1).otherwise(0))
