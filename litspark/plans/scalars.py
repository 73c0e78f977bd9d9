"""Queries of text functions and of feed scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.operators.retrieval import question_terms as terms_of
from litspark.plans.base import evidence, memory, papers, query, raw, sections
from litspark.sources.feed import parse_entries

B = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
QUESTION = "Which seismic wave agents compress memory, and does memory survive pruning of сейсмические графы?"
WORDS = terms_of(QUESTION)


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{B}+', ''), '{B}+$', '')"


def sql_score(hay: str, words: list[str]) -> str:
    return " + ".join(f"CAST((length({hay}) - length(replace({hay}, '{w}', ''))) / {len(w)} AS BIGINT)" for w in words)


@query(r"""
SELECT paper_id, CAST(ord AS INTEGER) AS place, term FROM (
  SELECT paper_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS ord
  FROM (SELECT paper_id, list_transform(regexp_extract_all(coalesce(research_question, ''), '[A-Za-zА-Яа-я0-9_-]{3,}'), lambda x: lower(x)) AS ts FROM m))
""")
def question_terms(spark, d):  # noqa: ANN001, ANN201
    return memory(spark, d).select("paper_id", F.posexplode(T.terms(F.col("research_question"))).alias("place", "term"))


@query(f"""
SELECT arxiv_id, {sql_score("h", WORDS)} AS score
FROM (SELECT arxiv_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS h FROM p)
""")
def term_score(spark, d):  # noqa: ANN001, ANN201
    return papers(spark, d).select("arxiv_id", T.score(T.haystack("title", "abstract"), WORDS).alias("score"))


@query(f"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{B}+', ' ', 'g'), ' ') AS text FROM documents")
def ws_collapse(spark, d):  # noqa: ANN001, ANN201
    return raw(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


CLEAN = sql_strip(r"regexp_replace(replace(text, '\uselogo', ''), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT paper_id, idx, {CLEAN} AS text FROM s")
def clean_text(spark, d):  # noqa: ANN001, ANN201
    return sections(spark, d).select("paper_id", "idx", T.clean(F.col("text")).alias("text"))


@query(f"SELECT paper_id, idx, {CLEAN} AS text, CAST(length({CLEAN}) AS INTEGER) AS chars FROM s WHERE length({CLEAN}) >= 120")
def section_filter(spark, d):  # noqa: ANN001, ANN201
    cleaned = sections(spark, d).select("paper_id", "idx", T.clean(F.col("text")).alias("text"))
    return cleaned.where(F.length("text") >= T.SECTION_LEAST).select("paper_id", "idx", "text", F.length("text").alias("chars"))


@query("SELECT arxiv_id, regexp_replace(coalesce(abs_url, ''), '[^A-Za-z0-9_.-]+', '_', 'g') AS path FROM p")
def safe_id(spark, d):  # noqa: ANN001, ANN201
    return papers(spark, d).select("arxiv_id", T.safe_id(T.or_empty("abs_url")).alias("path"))


@query(f"""
SELECT doc_id, length(text) > 6000 AS pruned, CASE WHEN length(text) <= 6000 THEN text
  ELSE substring(text, 1, 3500) || replace('{T.PRUNE_MARK[0]}', chr(92) || 'n', chr(10)) || (length(text) - 5000) || '{T.PRUNE_MARK[1]}' || right(text, 1500) END AS text
FROM documents
""")
def prune_text(spark, d):  # noqa: ANN001, ANN201
    return raw(spark, d, "documents").select("doc_id", (F.length("text") > T.PRUNE_AT).alias("pruned"), T.prune(F.col("text")).alias("text"))


@query("SELECT doc_id, greatest(1, CAST(trunc(length(text) / 3.2::DOUBLE) AS INTEGER)) AS tokens FROM documents")
def estimate_tokens(spark, d):  # noqa: ANN001, ANN201
    return raw(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query("""
SELECT id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(x AS DOUBLE), 0.5::DOUBLE))) AS confidence FROM (
  SELECT id, CASE id % 5 WHEN 0 THEN 'high' WHEN 1 THEN '-1' WHEN 2 THEN '1.7' ELSE CAST(confidence AS VARCHAR) END AS x FROM e)
""")
def confidence_clamp(spark, d):  # noqa: ANN001, ANN201
    way = F.col("id") % 5
    stored = F.when(way == 0, "high").when(way == 1, "-1").when(way == 2, "1.7").otherwise(F.col("confidence").cast("string"))
    return evidence(spark, d).select("id", T.clamp(stored).alias("confidence"))


SECTION_SCORE = " + ".join(f"CASE WHEN contains(h, '{t}') THEN 10 ELSE 0 END" for t in T.IMPORTANT_HEADINGS)


@query(f"SELECT paper_id, idx, CASE WHEN idx = 0 THEN 2 ELSE 0 END + {SECTION_SCORE} AS score FROM (SELECT paper_id, idx, lower(coalesce(heading, '')) AS h FROM s)")
def section_score(spark, d):  # noqa: ANN001, ANN201
    return sections(spark, d).select("paper_id", "idx", T.section_score(F.col("heading"), F.col("idx") == 0).alias("score"))


@query("""
SELECT arxiv_id, 'all:"' || replace(coalesce(title, ''), '"', '') || '"' || CASE WHEN coalesce(published, '') <> '' AND coalesce(updated, '') <> ''
  THEN ' AND submittedDate:[' || replace(substring(published, 1, 10), '-', '') || '0000 TO ' || replace(substring(updated, 1, 10), '-', '') || '2359]' ELSE '' END AS query
FROM p
""")
def feed_query_string(spark, d):  # noqa: ANN001, ANN201
    day = lambda c: F.substring(F.nullif(F.col(c), F.lit("")), 1, 10)
    return papers(spark, d).select("arxiv_id", T.feed_query(T.or_empty("title"), day("published"), day("updated")).alias("query"))


ID = r"regexp_replace(list_last(string_split(regexp_replace(abs_url, '/+$', ''), '/')), '^(\d{4}\.\d+)v\d+$', '\1')"


@query(f"SELECT arxiv_id, abs_url, {ID} AS id FROM p WHERE abs_url IS NOT NULL")
def id_normalize(spark, d):  # noqa: ANN001, ANN201
    return papers(spark, d).where("abs_url IS NOT NULL").select("arxiv_id", "abs_url", T.paper_id(F.col("abs_url")).alias("id"))


@query("SELECT arxiv_id, " + ", ".join(f"'https://arxiv.org/{k}/' || arxiv_id AS {k}_url" for k in ("abs", "pdf", "html")) + " FROM p")
def url_derive(spark, d):  # noqa: ANN001, ANN201
    return papers(spark, d).select("arxiv_id", *T.links(F.col("arxiv_id")))


@query("""
SELECT arxiv_id, substring(coalesce(published, ''), 1, 10) AS day FROM p
WHERE substring(coalesce(published, ''), 1, 10) >= '2021-03-01' AND substring(coalesce(published, ''), 1, 10) <= '2024-06-30'
UNION ALL
SELECT 'upper only ' || arxiv_id, substring(coalesce(published, ''), 1, 10) FROM p WHERE substring(coalesce(published, ''), 1, 10) <= '2020-12-31'
""")
def date_range_filter(spark, d):  # noqa: ANN001, ANN201
    p, day = papers(spark, d).select("arxiv_id", "published"), F.substring(T.or_empty("published"), 1, 10).alias("day")
    both = p.where(T.in_dates(F.col("published"), "2021-03-01", "2024-06-30")).select("arxiv_id", day)
    upper = p.where(T.in_dates(F.col("published"), None, "2020-12-31")).select(F.concat(F.lit("upper only "), "arxiv_id").alias("arxiv_id"), day)
    return both.union(upper)


@query("""
SELECT category, arxiv_id, CAST(row_number() OVER (PARTITION BY category ORDER BY published DESC NULLS LAST, arxiv_id) AS INTEGER) AS rank
FROM (SELECT coalesce(categories[1], 'none') AS category, arxiv_id, published FROM p)
""")
def assign_rank(spark, d):  # noqa: ANN001, ANN201
    x = papers(spark, d).select(F.coalesce(F.get("categories", F.lit(0)), F.lit("none")).alias("category"), "arxiv_id", "published")
    order = Window.partitionBy("category").orderBy(F.desc_nulls_last("published"), "arxiv_id")
    return x.select("category", "arxiv_id", F.row_number().over(order).alias("rank"))


def _xml(c: str):  # noqa: ANN202
    x = T.or_empty(c)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


_collapsed = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{B}+', ' ', 'g'), ' ')"


@query(f"""
SELECT arxiv_id AS key, arxiv_id, {_collapsed("title")} AS title, {_collapsed("abstract")} AS abstract, coalesce(published, '') AS published,
  coalesce(array_to_string(categories, ','), '') AS categories, 'someone' AS authors, 'https://arxiv.org/pdf/' || arxiv_id AS pdf_url
FROM p
""")
def feed_parse(spark, d):  # noqa: ANN001, ANN201
    """Feed entries written of the papers, with versioned ids, and parsed again."""
    tags = F.array_join(F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.concat(F.lit('<category term="'), c, F.lit('"/>'))), "")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), F.col("arxiv_id"), F.lit("v2</id><title>"), _xml("title"), F.lit("</title><summary>"), _xml("abstract"),
        F.lit("</summary><published>"), T.or_empty("published"), F.lit("</published><author><name> someone </name></author>"), tags, F.lit("</entry>"),
    )
    xml = papers(spark, d).select(F.col("arxiv_id").alias("key"), entry.alias("xml"))
    return parse_entries(xml, "xml").select(
        "key", "arxiv_id", "title", "abstract", "published", F.array_join("categories", ",").alias("categories"), F.array_join("authors", ",").alias("authors"), "pdf_url"
    )
