"""Queries of retrieval and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import retrieval as R
from litspark.operators.routing import DOMAINS, route
from litspark.operators.merging import latest
from litspark.plans.base import assignments, cells, collections, evidence, links, memory, papers, query, raw
from litspark.plans.scalars import QUESTION, WORDS, sql_score, sql_strip

NAMED, CELL = "tuned-vaccine", "geology"
NONSENSE = "Zzyzx qwertz plugh"
BATCH = {"q1": QUESTION, "q2": "Do graph networks filter seismic sensors?", "q3": "protein genome catalogues", "q4": "as in of"}

CANDIDATES = """
SELECT p.arxiv_id, p.title, p.abstract, m.summary, x.claims,
  lower(coalesce(p.title, '') || ' ' || coalesce(p.abstract, '') || ' ' || coalesce(m.summary, '') || ' ' || coalesce(x.claims, '')) AS h
FROM p LEFT JOIN m ON m.paper_id = p.arxiv_id
LEFT JOIN (SELECT paper_id, string_agg(claim, ' | ' ORDER BY id) AS claims FROM e GROUP BY paper_id) x ON x.paper_id = p.arxiv_id
"""


def sql_top(words: list[str], where: str = "TRUE", limit: int = 8) -> str:
    score = sql_score("h", words) if words else "0"
    return f"""
WITH k AS ({CANDIDATES}), z AS (SELECT *, {score} AS score FROM k WHERE {where})
SELECT arxiv_id, score FROM z
WHERE score > 0 OR ((SELECT max(score) FROM z) = 0 AND {sql_strip("coalesce(summary, '')")} <> '')
ORDER BY score DESC, arxiv_id LIMIT {limit}
"""


def _scored(spark, d, words, narrow=lambda p: p):  # noqa: ANN001, ANN202
    return R.scored(narrow(papers(spark, d)), memory(spark, d), evidence(spark, d), words)


def _of_collection(spark, d):  # noqa: ANN001, ANN202
    return lambda p: R.in_collection(p, links(spark, d), collections(spark, d), NAMED)


def _of_cell(spark, d):  # noqa: ANN001, ANN202
    return lambda p: R.in_cell(p, assignments(spark, d), cells(spark), CELL)


IN_COLLECTION = f"arxiv_id IN (SELECT cp.paper_id FROM cp JOIN c ON c.id = cp.collection_id WHERE c.name = '{NAMED}')"
IN_CELL = f"arxiv_id IN (SELECT da.paper_id FROM da JOIN rc ON rc.id = da.cell_id WHERE rc.name = '{CELL}')"


@query("SELECT paper_id, string_agg(claim, ' | ' ORDER BY id) AS claims FROM e WHERE claim IS NOT NULL GROUP BY paper_id")
def evidence_concat(spark, d):  # noqa: ANN001, ANN201
    return R.claim_texts(evidence(spark, d))


@query(f"""
WITH k AS ({CANDIDATES}) SELECT arxiv_id, title, summary, {sql_score("h", WORDS)} AS score FROM k
""")
def retrieval_candidates(spark, d):  # noqa: ANN001, ANN201
    return _scored(spark, d, WORDS).select("arxiv_id", "title", "summary", "score")


@query(sql_top(WORDS))
def rag_topk(spark, d):  # noqa: ANN001, ANN201
    return R.search(_scored(spark, d, WORDS)).select("arxiv_id", "score")


@query(sql_top(WORDS, IN_COLLECTION))
def scope_collection(spark, d):  # noqa: ANN001, ANN201
    return R.search(_scored(spark, d, WORDS, _of_collection(spark, d))).select("arxiv_id", "score")


@query(sql_top(WORDS, IN_CELL))
def scope_cell(spark, d):  # noqa: ANN001, ANN201
    return R.search(_scored(spark, d, WORDS, _of_cell(spark, d))).select("arxiv_id", "score")


@query(sql_top(WORDS, f"{IN_COLLECTION} AND {IN_CELL}", 20))
def scope_both(spark, d):  # noqa: ANN001, ANN201
    both = lambda p: _of_cell(spark, d)(_of_collection(spark, d)(p))
    return R.search(_scored(spark, d, WORDS, both), 20).select("arxiv_id", "score")


@query(sql_top(R.question_terms(NONSENSE)))
def rag_fallback(spark, d):  # noqa: ANN001, ANN201
    """No record holds a term, so papers with a summary come instead."""
    return R.search(_scored(spark, d, R.question_terms(NONSENSE))).select("arxiv_id", "score")


_batch = " UNION ALL ".join(f"SELECT '{q}' AS question_id, arxiv_id, {sql_score('h', R.question_terms(t)) or '0'} AS score FROM k" for q, t in BATCH.items())


@query(f"""
WITH k AS ({CANDIDATES}), z AS ({_batch})
SELECT question_id, arxiv_id, score, CAST(n AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, arxiv_id) AS n FROM z WHERE score > 0) WHERE n <= 8
""")
def rag_batch(spark, d):  # noqa: ANN001, ANN201
    asked = spark.createDataFrame(list(BATCH.items()), "question_id string, question string")
    return R.search_many(asked, papers(spark, d), memory(spark, d), evidence(spark, d))


@query(f"""
WITH k AS ({CANDIDATES}), z AS ({_batch}), y AS (
  SELECT question_id, arxiv_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, arxiv_id) AS n FROM z WHERE score > 0),
  o AS (SELECT arxiv_id, row_number() OVER (ORDER BY arxiv_id) AS n FROM k WHERE {sql_strip("coalesce(summary, '')")} <> '')
SELECT question_id, arxiv_id, CAST(score AS BIGINT) AS score, CAST(n AS INTEGER) AS place FROM y WHERE n <= 8
UNION ALL SELECT q.question_id, o.arxiv_id, 0, CAST(o.n AS INTEGER)
FROM (SELECT DISTINCT question_id FROM z EXCEPT SELECT question_id FROM y) q CROSS JOIN o WHERE o.n <= 8
""")
def rag_batch_fallback(spark, d):  # noqa: ANN001, ANN201
    """The same questions; those that nothing answers get papers with a summary."""
    asked = spark.createDataFrame(list(BATCH.items()), "question_id string, question string")
    return R.search_many(asked, papers(spark, d), memory(spark, d), evidence(spark, d), fallback=True)


def sql_prompt(column: str) -> str:
    return f"""
WITH k AS ({CANDIDATES}), z AS (SELECT *, {sql_score("h", WORDS)} AS score FROM k),
  f AS (SELECT * FROM z WHERE score > 0 ORDER BY score DESC, arxiv_id LIMIT 8)
SELECT 'QUESTION:' || chr(10) || '{QUESTION}' || chr(10) || chr(10) || 'RETRIEVED RECORDS:' || chr(10) || chr(10) || string_agg(
  '[arXiv:' || arxiv_id || ']' || chr(10) || 'TITLE: ' || coalesce(title, '') || chr(10) || 'SUMMARY: ' || coalesce(summary, '') || chr(10)
  || 'ABSTRACT: ' || substring(coalesce(abstract, ''), 1, 3000) || chr(10) || 'EVIDENCE: ' || coalesce(claims, ''), chr(10) || chr(10) ORDER BY score DESC, arxiv_id) AS {column}
FROM f
"""


@query(sql_prompt("prompt"))
def rag_prompt(spark, d):  # noqa: ANN001, ANN201
    return R.prompt(R.top(_scored(spark, d, WORDS)), raw(spark, d, "evidence"), QUESTION, lambda e: latest(e, ["id"], "created_at"))


@query("SELECT arxiv_id, cell, CAST(hits AS INTEGER) AS hits, score, rationale FROM r")
def route_papers(spark, d):  # noqa: ANN001, ANN201
    return route(papers(spark, d)).drop("place")


@query("SELECT arxiv_id, cell, score, CAST(place AS INTEGER) AS place FROM r")
def route_ranked(spark, d):  # noqa: ANN001, ANN201
    return route(papers(spark, d)).select("arxiv_id", "cell", "score", "place")


@query(f"SELECT arxiv_id AS paper_id, cell, score, rationale FROM r WHERE {IN_COLLECTION}")
def route_collection(spark, d):  # noqa: ANN001, ANN201
    p = R.in_collection(papers(spark, d), links(spark, d), collections(spark, d), NAMED)
    return route(p).select(F.col("arxiv_id").alias("paper_id"), "cell", "score", "rationale")


SAMPLES = [
    ("a", "Seismic wave agent", "An autonomous agent studies geological rock physics"),
    ("b", "Quantum particle field theory", "condensed matter waves"),
    ("c", "Multi-agent tool use", "memory agent with cellular protein reactions"),
    ("d", "Nothing here", None),
]
_values = ", ".join("({})".format(", ".join("NULL" if x is None else f"'{x}'" for x in row)) for row in SAMPLES)
_default = " UNION ALL ".join(
    f"SELECT k, {i} AS ord, '{n}' AS cell, " + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words) + " AS hits FROM x"
    for i, (n, words) in enumerate(DOMAINS.items())
)


@query(f"""
WITH x AS (SELECT k, lower(coalesce(a, '') || ' ' || coalesce(b, '')) AS t FROM (VALUES {_values}) v(k, a, b)), y AS ({_default})
SELECT k AS arxiv_id, cell, least(1.0::DOUBLE, 0.35::DOUBLE + hits * 0.15::DOUBLE) AS score, 'keyword hits: ' || hits AS rationale FROM y WHERE hits > 0
""")
def route_default_vocab(spark, d):  # noqa: ANN001, ANN201
    return route(spark.createDataFrame(SAMPLES, "arxiv_id string, title string, abstract string")).select("arxiv_id", "cell", "score", "rationale")
