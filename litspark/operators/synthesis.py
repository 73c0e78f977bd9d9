"""Texts of collections, whole or only where they fit the context's budget.

Blocks of a context are taken whole or not at all, so there a text above the budget is never needed. Its
size is summed first, and only collections within the bound have their texts joined; a collection of any
size costs a pre-aggregated sum. The whole texts are joined in runs, whatever their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions.text import or_empty
from litspark.operators.retrieval import RUN


def summary_line() -> Column:
    return F.concat(F.lit("[arXiv:"), F.col("paper_id"), F.lit("] "), or_empty("title"), F.lit("\n"), or_empty("summary"))


def evidence_line() -> Column:
    return F.concat(F.lit("[arXiv:"), F.col("paper_id"), F.lit("] "), or_empty("claim"), F.lit(" :: "), or_empty("result"))


def joined_within(lines: DataFrame, group: str, line: str, order: str, separator: str, most: int) -> DataFrame:
    """(group, n, chars, text): text is null for a group whose joined lines have more than `most` characters."""
    sums = lines.groupBy(group).agg(F.count("*").alias("n"), (F.sum(F.length(line)) + (F.count("*") - 1) * len(separator)).alias("chars"))
    small = sums.where(F.col("chars") <= most).select(group)
    sep = separator.replace("\n", "\\n")
    texts = lines.join(small, group, "left_semi").groupBy(group).agg(F.expr(f"listagg({line}, '{sep}') WITHIN GROUP (ORDER BY {order})").alias("text"))
    return sums.join(texts, group, "left")


def joined(lines: DataFrame, group: str, line: str, order: str, separator: str, runs: dict[str, str]) -> DataFrame:
    """(group, n, chars, text): the lines of each group joined in order, whatever their number.

    runs: expressions of the leading order, each with its own direction; lines of a run are joined first,
    so the order of a group's very many lines isn't sorted out in one task.
    """
    sep = separator.replace("\n", "\\n")
    marks = [F.expr(x).alias(f"run{i}") for i, x in enumerate(runs)]
    by = ", ".join(f"run{i} {way}" for i, way in enumerate(runs.values()))
    within = lambda x, o: F.expr(f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {o})")
    parts = lines.groupBy(group, *marks).agg(F.count("*").alias("n"), within(line, order).alias("part"))
    texts = parts.groupBy(group).agg(F.sum("n").alias("n"), within("part", by).alias("text"))
    return texts.select(group, "n", F.length("text").cast("long").alias("chars"), "text")


def _summary_lines(links: DataFrame, papers: DataFrame, memory: DataFrame) -> DataFrame:
    m = memory.select("paper_id", "summary")
    p = papers.select(F.col("arxiv_id").alias("paper_id"), "title", "published")
    x = links.select("collection_id", "paper_id", "rank").join(p, "paper_id").join(m, "paper_id")
    return x.select("collection_id", "rank", "published", "paper_id", summary_line().alias("line"))


def _evidence_lines(links: DataFrame, papers: DataFrame, evidence: DataFrame) -> DataFrame:
    known = papers.select(F.col("arxiv_id").alias("paper_id"))
    e = evidence.join(known, "paper_id", "left_semi").select("paper_id", "id", evidence_line().alias("line"))
    return links.select("collection_id", "paper_id").join(e, "paper_id").select("collection_id", "id", "line")


_BY_RANK = "rank ASC NULLS FIRST, published DESC NULLS LAST, paper_id"


def summaries(links: DataFrame, papers: DataFrame, memory: DataFrame, most: int) -> DataFrame:
    """Summaries of each collection's papers, by rank, then the latest first."""
    return joined_within(_summary_lines(links, papers, memory), "collection_id", "line", _BY_RANK, "\n\n", most)


def evidence_texts(links: DataFrame, papers: DataFrame, evidence: DataFrame, most: int) -> DataFrame:
    """Evidence of each collection's papers in order of its id."""
    return joined_within(_evidence_lines(links, papers, evidence), "collection_id", "line", "id", "\n", most)


def whole_summaries(links: DataFrame, papers: DataFrame, memory: DataFrame) -> DataFrame:
    """As summaries(), of collections of any size."""
    runs = {"rank": "ASC NULLS FIRST", "substring(published, 1, 4)": "DESC NULLS LAST"}
    return joined(_summary_lines(links, papers, memory), "collection_id", "line", _BY_RANK, "\n\n", runs)


def whole_evidence_texts(links: DataFrame, papers: DataFrame, evidence: DataFrame) -> DataFrame:
    """As evidence_texts(), of collections of any size."""
    return joined(_evidence_lines(links, papers, evidence), "collection_id", "line", "id", "\n", {f"floor(id / {RUN})": "ASC"})
