"""Routing papers to research cells by keywords."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions.text import or_empty

# Default domains and their keywords.
DOMAINS: dict[str, tuple[str, ...]] = {
    "geology": ("geology", "geological", "rock", "mineral", "seismic", "tectonic", "sediment", "geochemistry"),
    "physics": ("physics", "quantum", "particle", "field theory", "condensed matter", "wave", "thermodynamic"),
    "biology": ("biology", "biological", "protein", "genome", "cell", "neural", "ecology"),
    "chemistry": ("chemistry", "chemical", "molecule", "reaction", "catalyst", "polymer"),
    "ai_agents": ("agent", "agentic", "multi-agent", "tool use", "memory agent", "autonomous agent"),
}


def hits(text: Column, keywords: Sequence[str]) -> Column:
    total = F.lit(0)
    for k in keywords:
        total = total + text.contains(k).cast("int")
    return total


def route(papers: DataFrame, domains: Mapping[str, Sequence[str]] | None = None, key: str = "arxiv_id") -> DataFrame:
    """(key, cell, hits, score, rationale, place): a row per paper and domain with a keyword in title or abstract.

    Keywords count as substrings. place numbers a paper's domains by falling score, ties in their order.
    No shuffle: the domains are expressions of the scan's own row.
    """
    domains = domains or DOMAINS
    text = F.lower(F.concat(or_empty("title"), F.lit(" "), or_empty("abstract")))
    found = [
        F.struct(F.lit(i).alias("at"), F.lit(name).alias("cell"), hits(F.col("_text"), words).alias("hits")) for i, (name, words) in enumerate(domains.items())
    ]
    some = F.filter(F.array(*found), lambda d: d.hits > 0)
    ordered = F.array_sort(F.transform(some, lambda d: F.struct((-score_of(d.hits)).alias("by"), d.at.alias("at"), d.cell.alias("cell"), d.hits.alias("hits"))))
    out = papers.select(key, text.alias("_text")).select(key, F.posexplode(ordered).alias("_place", "_d"))
    return out.select(
        key,
        F.col("_d.cell").alias("cell"),
        F.col("_d.hits").alias("hits"),
        (-F.col("_d.by")).alias("score"),
        F.concat(F.lit("keyword hits: "), F.col("_d.hits").cast("string")).alias("rationale"),
        (F.col("_place") + 1).alias("place"),
    )


def score_of(n: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.35) + n.cast("double") * F.lit(0.15))
