"""Listings of collections, papers, evidence and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection(collections: DataFrame, name: str | None = None) -> DataFrame:
    """The collection of a name; without one (none or empty), the active collection of the highest id."""
    if name:
        return collections.where(F.col("name") == name).limit(1)
    return collections.where("active = 1").orderBy(F.desc("id")).limit(1)


def list_collections(collections: DataFrame, links: DataFrame) -> DataFrame:
    """Collections, the newest first, with their number of papers.

    The links, of which one collection may hold most, are counted before they are joined.
    """
    counts = links.groupBy("collection_id").agg(F.count("paper_id").alias("paper_count"))
    joined = collections.join(counts, collections.id == counts.collection_id, "left").drop("collection_id")
    return joined.withColumn("paper_count", F.coalesce("paper_count", F.lit(0))).orderBy(F.desc("id"))


def members(links: DataFrame, collections: DataFrame, name: str | None = None) -> DataFrame:
    """(paper_id, rank) of a collection."""
    ids = F.broadcast(collection(collections, name).select(F.col("id").alias("collection_id")))  # one row
    return links.join(ids, "collection_id", "left_semi").select("paper_id", "rank")


def collection_papers(papers: DataFrame, links: DataFrame, collections: DataFrame, name: str | None = None, limit: int | None = None) -> DataFrame:
    """Papers of a collection by rank, then the latest first; a limit of none or 0 is no limit."""
    m = members(links, collections, name)
    out = papers.join(m, papers.arxiv_id == m.paper_id).drop("paper_id").orderBy(F.asc_nulls_first("rank"), F.desc_nulls_last("published"), "arxiv_id")
    return out.limit(limit) if limit and limit > 0 else out


def evidence_for_collection(evidence: DataFrame, papers: DataFrame, links: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    m = members(links, collections, name).select("paper_id")
    titles = papers.select(F.col("arxiv_id").alias("paper_id"), "title")
    return evidence.join(m, "paper_id", "left_semi").join(titles, "paper_id").orderBy("id")


def list_cells(cells: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cells with the name of their parent and their number of papers, children after their parent."""
    counts = assignments.groupBy("cell_id").agg(F.count("*").alias("paper_count"))
    parents = cells.select(F.col("id").alias("_p"), F.col("name").alias("parent_name"))
    out = cells.join(parents, F.col("parent_id") == F.col("_p"), "left").join(counts, F.col("id") == F.col("cell_id"), "left").drop("_p", "cell_id")
    return out.withColumn("paper_count", F.coalesce("paper_count", F.lit(0))).orderBy(F.coalesce("parent_id", "id"), "id")
