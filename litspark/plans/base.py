"""Registration of queries with their DuckDB equivalents, and the tables they read.

A repeated row of a table is the same record, so every view has one row per key, the one updated last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.operators.merging import latest
from litspark.operators.routing import DOMAINS, route

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return register


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    return latest(raw(spark, d, "papers"), ["arxiv_id"], "updated_at")


def memory(spark: SparkSession, d: str) -> DataFrame:
    return latest(raw(spark, d, "paper_memory"), ["paper_id"], "updated_at")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return latest(raw(spark, d, "evidence"), ["id"], "created_at")


def sections(spark: SparkSession, d: str) -> DataFrame:
    return latest(raw(spark, d, "sections"), ["paper_id", "idx"], "level")


def links(spark: SparkSession, d: str) -> DataFrame:
    return latest(raw(spark, d, "collection_papers"), ["collection_id", "paper_id"], "added_at")


def collections(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "collections")


#: Cells of the queries: the default domains and two children.
CELLS = [(i, n, None, "", "active", "2026-01-01T00:00:00Z") for i, n in enumerate(DOMAINS, 1)] + [
    (6, "seismology", 1, "", "active", "2026-01-01T00:00:00Z"),
    (7, "materials", 4, "", "active", "2026-01-01T00:00:00Z"),
]
CELLS_DDL = "id long, name string, parent_id long, description string, status string, created_at string"


def cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CELLS, CELLS_DDL)


def assignments(spark: SparkSession, d: str) -> DataFrame:
    named = F.broadcast(cells(spark).select(F.col("id").alias("cell_id"), F.col("name").alias("cell")))  # seven rows
    routed = route(papers(spark, d)).join(named, "cell")
    return routed.select(F.col("arxiv_id").alias("paper_id"), "cell_id", "score", "rationale")


def _latest(table: str, keys: str, order: str) -> str:
    return f"(SELECT * EXCLUDE _n FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC NULLS LAST) AS _n FROM {table}) WHERE _n = 1)"


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(_t, '{w}') AS INTEGER)" for w in words)


_routes = " UNION ALL ".join(
    f"SELECT arxiv_id, {i} AS ord, '{n}' AS cell, {_hits(w)} AS hits FROM (SELECT arxiv_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS _t FROM p)"
    for i, (n, w) in enumerate(DOMAINS.items())
)
_cells = ", ".join(f"({i}, '{n}', {'NULL' if q is None else q})" for i, n, q, *_ in CELLS)

VIEWS = {
    "p": _latest("papers", "arxiv_id", "updated_at"),
    "m": _latest("paper_memory", "paper_id", "updated_at"),
    "e": _latest("evidence", "id", "created_at"),
    "s": _latest("sections", "paper_id, idx", "level"),
    "cp": _latest("collection_papers", "collection_id, paper_id", "added_at"),
    "c": "(SELECT * FROM collections)",
    "rc": f"(SELECT CAST(id AS BIGINT) AS id, name, CAST(parent_id AS BIGINT) AS parent_id FROM (VALUES {_cells}) v(id, name, parent_id))",
    "r": f"(SELECT arxiv_id, cell, hits, score, 'keyword hits: ' || hits AS rationale, row_number() OVER (PARTITION BY arxiv_id ORDER BY score DESC, ord) AS place "
    f"FROM (SELECT *, least(1.0::DOUBLE, 0.35::DOUBLE + hits * 0.15::DOUBLE) AS score FROM ({_routes}) WHERE hits > 0))",
    "da": "(SELECT r.arxiv_id AS paper_id, rc.id AS cell_id, r.score, r.rationale FROM r JOIN rc ON rc.name = r.cell)",
}


def with_views(sql: str) -> str:
    """The statement after the views; an own WITH becomes part of theirs."""
    views = ", ".join(f"{k} AS {v}" for k, v in VIEWS.items())
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"
