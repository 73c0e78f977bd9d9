"""Queries of HTML pages, which are written of the stored papers and sections, and of the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.plans.base import papers, query, raw, sections
from litspark.plans.scalars import B
from litspark.sources.html import page_udf
from litspark.streaming.events import event_windows as windows
from litspark.streaming.events import run_to_end


def escaped(c):  # noqa: ANN001, ANN202
    c = T.or_empty(c)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _pages(spark, d):  # noqa: ANN001, ANN202
    """A page per section: title, heading and text in the element that the reader looks for."""
    s = sections(spark, d).where("text IS NOT NULL")
    p = papers(spark, d).select(F.col("arxiv_id").alias("paper_id"), "title")
    html = F.concat(
        F.lit("<html><head><title>other</title></head><body><article><h1 class='ltx_title_document'>"), escaped("title"), F.lit("</h1><section class='ltx_section'><h2>"),
        escaped("heading"), F.lit("</h2><p>"), escaped("text"), F.lit("</p><section><h3>Nested</h3><p>left out</p></section></section></article></body></html>"),
    )
    return s.join(p, "paper_id").select("paper_id", "idx", F.length(T.collapse(F.col("text"))).alias("chars"), html.alias("html"))


@query(f"""
SELECT s.paper_id, s.idx, trim(regexp_replace(coalesce(p.title, ''), '{B}+', ' ', 'g'), ' ') AS title
FROM s JOIN p ON p.arxiv_id = s.paper_id WHERE s.text IS NOT NULL AND trim(regexp_replace(coalesce(p.title, ''), '{B}+', ' ', 'g'), ' ') <> ''
""")
def html_title(spark, d):  # noqa: ANN001, ANN201
    return _pages(spark, d).select("paper_id", "idx", page_udf("html").title.alias("title")).where("title <> 'other'")


# What the reader makes of the parts of a page: blanks collapsed, the macro left out.
def sql_part(c: str) -> str:
    return f"trim(replace(trim(regexp_replace(coalesce({c}, ''), '{B}+', ' ', 'g'), ' '), chr(92) || 'uselogo', ''), ' ')"


def sql_text(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), chr(10) || chr(10))"


@query(f"""
SELECT * FROM (SELECT paper_id, idx, CAST(0 AS INTEGER) AS place, {sql_part("heading")} AS heading, {sql_text(sql_part("heading"), sql_part("text"))} AS text, CAST(2 AS INTEGER) AS level
FROM s WHERE text IS NOT NULL AND paper_id IN (SELECT arxiv_id FROM p)) WHERE length(text) >= 120
""")
def html_sections(spark, d):  # noqa: ANN001, ANN201
    read = _pages(spark, d).select("paper_id", "idx", page_udf("html").alias("page"))
    return read.select("paper_id", "idx", F.posexplode("page.sections").alias("place", "s")).select("paper_id", "idx", "place", "s.heading", "s.text", "s.level")


@query(f"""
SELECT s.paper_id, s.idx, {sql_text(sql_part("p.title"), sql_part("s.heading"), sql_part("s.text"), "'Nested'", "'left out'")} AS text
FROM s JOIN p ON p.arxiv_id = s.paper_id WHERE s.text IS NOT NULL
""")
def html_main_text(spark, d):  # noqa: ANN001, ANN201
    return _pages(spark, d).select("paper_id", "idx", page_udf("html").text.alias("text"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(24, 6))) AS DOUBLE) AS total FROM events GROUP BY ALL
""")
def event_windows(spark, d):  # noqa: ANN001, ANN201
    return windows(raw(spark, d, "events")).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "events", F.col("total").cast("double").alias("total"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(24, 6))) AS DOUBLE) AS total FROM events GROUP BY ALL
""")
def event_windows_stream(spark, d):  # noqa: ANN001, ANN201
    """The same windows from a stream over the table's files, run until all are read."""
    events = spark.readStream.schema(raw(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parq*")
    return run_to_end(windows(events)).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "events", F.col("total").cast("double").alias("total"))
