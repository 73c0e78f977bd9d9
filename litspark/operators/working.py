"""Working memory: what was done last, kept short."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many actions are kept.
MOST = 12


def recent(actions: DataFrame, keys: Sequence[str], *order: Column | str, most: int = MOST) -> DataFrame:
    """The last `most` actions of each task with column back, 1 for the last; all but that many of each task are dropped before the shuffle."""
    latest_first = [F.desc(o) if isinstance(o, str) else o for o in order]
    return actions.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest_first))).where(F.col("back") <= most)


def added(actions: Column, action: Column, most: int = MOST) -> Column:
    """A list of actions with one more, without those before the last `most`. A null list is empty."""
    longer = F.concat(F.coalesce(actions, F.array().cast("array<string>")), F.array(action))
    return F.slice(longer, F.greatest(F.lit(1), F.size(longer) - most + 1), F.lit(most))
