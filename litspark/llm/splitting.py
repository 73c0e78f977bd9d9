"""Splitting oversized items at natural boundaries.

One regular expression does the cutting: its alternatives are ordered by the strength of the boundary
that they end at, and each consumes as much as its bounded quantifier lets it. Offsets that look back
by the overlap then give consecutive pieces their common characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import table

LIMIT, OVERLAP = 4000, 200

# Boundaries in natural order, the strongest first, as lookbehinds.
BOUNDARIES = (
    r"(?<=\n[ \t\r]{0,8}\n)",  # paragraph
    r"(?<=[\n\r\x{2028}])(?!\n)",  # line
    r"(?<=[.!?…][\"'”’»)\]]{0,3}[ \t\x{a0}]|[。！？])",  # sentence
    r"(?<=[,;:)\]}–—][ \t\x{a0}]|[，；：、])",  # clause
    r"(?<=[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}])",  # word
    r"(?!\p{M}|\x{200d}|[\x{fe00}-\x{fe0f}])(?<!\x{200d})",  # character, not inside a composed one
    "",
)


def pattern(limit: int, overlap: int) -> str:
    """The first piece may fill the limit, others the limit without the overlap; a boundary counts from the half on."""

    def level(anchor: str, most: int) -> list[str]:
        least = max(1, most // 2)
        return [rf"{anchor}.{{1,{most}}}\z"] + [f"{anchor}.{{{least},{most}}}{b}" for b in BOUNDARIES] + [f"{anchor}.{{1,{most}}}"]

    return "(?s)" + "|".join(level(r"\A", limit) + level("", limit - overlap))


def item(heading: Column, text: Column) -> Column:
    return F.concat(F.coalesce(heading, F.lit("")), F.lit("\n\n"), text)


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<no, start, piece>>: pieces of at most `limit` characters; start counts from 0.

    Consecutive pieces share exactly `overlap` characters. Null gives null; an empty text gives one empty
    piece. Joining the pieces without their overlaps gives the text back.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    bodies = F.when(F.length(text) <= limit, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(pattern(limit, overlap)), F.lit(0)))
    spot = F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"))
    zero = F.struct(F.lit(0).alias("to"), F.array_repeat(spot, F.lit(0)).alias("spots"))

    def place(done: Column, n: Column) -> Column:  # offsets look back by the overlap, but for the first piece
        start = F.when(done.to == 0, F.lit(0)).otherwise(done.to - overlap)
        end = done.to + n
        return F.struct(end.alias("to"), F.concat(done.spots, F.array(F.struct(start.alias("start"), (end - start).alias("size")))).alias("spots"))

    spots = F.aggregate(F.transform(bodies, lambda b: F.length(b)), zero, place, lambda done: done.spots)
    return F.transform(spots, lambda s, i: F.struct(i.alias("no"), s.start.alias("start"), F.substring(text, s.start + 1, s.size).alias("piece")))


def split_items(df: DataFrame, text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """A row per piece with columns no, start, piece and of (their number), which replace columns of these names.

    Items of null text have no pieces, an empty one has one. Repeated items are split each for itself.
    """
    rest = [c for c in df.columns if c not in ("of", "no", "start", "piece")]
    x = df.select(*rest, pieces(text, limit, overlap).alias("__pieces"))
    return x.select(*rest, F.size("__pieces").alias("of"), F.explode("__pieces").alias("__p")).select(*rest, "of", "__p.*")


def p6_pieces(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """The pieces of every section item."""
    sections = table(spark, sf_dir, "sections").dropDuplicates(["paper_id", "idx"])
    x = sections.select("paper_id", "idx", item(F.col("heading"), F.col("text")).alias("item"))
    return split_items(x, F.col("item")).select("paper_id", "idx", "no", "of", "start", "piece")


def p6_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Section items that had to be split. Repeated rows of a record are the same, so they are merged after splitting."""
    x = table(spark, sf_dir, "sections").select("paper_id", "idx", item(F.col("heading"), F.col("text")).alias("item"))
    return x.where(F.size(pieces(F.col("item"))) > 1).select("paper_id", "idx").distinct()


P6_FOUND_SQL = """
SELECT DISTINCT paper_id, idx FROM sections WHERE length(coalesce(heading, '')) + 2 + length(text) > 4000
"""


def p6_rejoined(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Each section item put together again of its pieces, and whether all are within the limit and overlap as stated."""
    p = p6_pieces(spark, sf_dir)
    parts = p.groupBy("paper_id", "idx").agg(F.sort_array(F.collect_list(F.struct("no", "start", "piece"))).alias("p"), F.max(F.length("piece")).alias("longest"))
    bare = F.transform("p", lambda x: F.when(x.no == 0, x.piece).otherwise(F.substring(x.piece, OVERLAP + 1, LIMIT)))
    ends = F.transform("p", lambda x: F.struct((x.start + F.length(x.piece)).alias("to"), x.start.alias("start")))
    meet = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == F.size("p")) | (F.get(ends, i - 1).to - F.get(ends, i).start == OVERLAP))
    return parts.select("paper_id", "idx", F.array_join(bare, "").alias("item"), ((F.col("longest") <= LIMIT) & meet).alias("kept"))


P6_REJOINED_SQL = """
SELECT DISTINCT paper_id, idx, coalesce(heading, '') || chr(10) || chr(10) || text AS item, true AS kept FROM sections WHERE text IS NOT NULL
"""
