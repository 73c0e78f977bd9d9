"""Queries of context assembly, providers and replies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.functions import context as C
from litspark.functions import text as T
from litspark.operators import synthesis as S
from litspark.plans.base import collections, evidence, links, memory, papers, query, sections
from litspark.plans.scalars import SECTION_SCORE, sql_strip
from litspark.providers import extract
from litspark.sources import replies

#: Budgets of the queries: small enough that blocks must be left out.
BUDGET = 1000
MOST = 20_800

CHOSEN = f"""
SELECT paper_id, idx, heading, text, score, CAST(n AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, idx) AS n FROM (
    SELECT *, CASE WHEN idx = 0 THEN 2 ELSE 0 END + {SECTION_SCORE} AS score FROM (SELECT *, lower(coalesce(heading, '')) AS h FROM s))) WHERE n <= 6
"""


def chosen(spark, d):  # noqa: ANN001, ANN201
    """The six sections of each paper that matter most."""
    scored = sections(spark, d).withColumn("score", T.section_score(F.col("heading"), F.col("idx") == 0))
    order = Window.partitionBy("paper_id").orderBy(F.desc("score"), F.asc("idx"))
    return scored.withColumn("place", F.row_number().over(order)).where("place <= 6")


def sql_pack(source: str, keys: str, budget: int) -> str:
    """source: rows of keys, req, pri, ord, name, text."""
    ws = sql_strip("text")
    return f"""
SELECT {keys}, CAST(f.used AS INTEGER) AS used, array_to_string(f.names, ',') AS names, {sql_strip("f.text")} AS text FROM (
  SELECT {keys}, list_reduce(list(y ORDER BY NOT req, -pri, ord), lambda a, x: CASE WHEN x.req OR a.used + x.used <= {budget}
    THEN {{'used': a.used + x.used, 'names': list_concat(a.names, x.names), 'req': false, 'text': a.text || x.text}} ELSE a END,
    {{'used': CAST(0 AS BIGINT), 'names': CAST([] AS VARCHAR[]), 'req': false, 'text': ''}}) AS f
  FROM (SELECT *, {{'used': CAST(greatest(1, trunc(length(r) / 3.2::DOUBLE)) AS BIGINT), 'names': [name], 'req': req, 'text': r}} AS y FROM (
    SELECT *, chr(10) || chr(10) || '[' || name || ']' || chr(10) || {ws} AS r FROM ({source}))) GROUP BY {keys})
"""


@query(f"SELECT paper_id, idx, CAST(score AS INTEGER) AS score, place FROM ({CHOSEN})")
def choose_sections(spark, d):  # noqa: ANN001, ANN201
    return chosen(spark, d).select("paper_id", "idx", "score", "place")


_memory_blocks = [("SUMMARY", "summary", 100, True), ("METHOD", "method", 60, False), ("QUESTION", "research_question", 80, False)]
_source = " UNION ALL ".join(f"SELECT paper_id, {r} AS req, {p} AS pri, {i} AS ord, '{n}' AS name, coalesce({c}, '') AS text FROM m" for i, (n, c, p, r) in enumerate(_memory_blocks))


@query(sql_pack(_source, "paper_id", 130))
def context_pack(spark, d):  # noqa: ANN001, ANN201
    blocks = F.array(*[C.block(n, F.col(c), p, r) for n, c, p, r in _memory_blocks])
    packed = memory(spark, d).select("paper_id", C.pack(blocks, 130).alias("f"))
    return packed.select("paper_id", "f.used", F.array_join("f.names", ",").alias("names"), "f.text")


_paper_source = f"""
SELECT arxiv_id, true AS req, 100 AS pri, 0 AS ord, 'TASK' AS name, '{C.SUMMARY_TASK}' AS text FROM p
UNION ALL SELECT arxiv_id, true, 100, 1, 'TITLE', coalesce(title, '') FROM p
UNION ALL SELECT arxiv_id, true, 95, 2, 'ABSTRACT', coalesce(abstract, '') FROM p
UNION ALL SELECT arxiv_id, false, 90, 3, 'RESEARCH_GOAL', coalesce(m.research_question, '') FROM p LEFT JOIN m ON m.paper_id = p.arxiv_id
UNION ALL SELECT z.paper_id, false, 81 - place, 3 + place, 'SECTION_' || lpad(CAST(place AS VARCHAR), 2, '0') || '_' || substring(coalesce(heading, ''), 1, 60), coalesce(text, '')
  FROM ({CHOSEN}) z JOIN p ON p.arxiv_id = z.paper_id
"""


def _paper_contexts(spark, d):  # noqa: ANN001, ANN202
    few = chosen(spark, d).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("place", "heading", "text"))).alias("sections"))
    m = memory(spark, d).select("paper_id", "research_question")
    p = papers(spark, d).select(F.col("arxiv_id").alias("paper_id"), "title", "abstract").join(m, "paper_id", "left").join(few, "paper_id", "left")
    picked = F.transform("sections", lambda s: F.struct(s.heading.alias("heading"), s.text.alias("text")))
    blocks = C.paper_blocks(F.col("title"), F.col("abstract"), picked, F.col("research_question"))
    return p.select(F.col("paper_id").alias("arxiv_id"), C.pack(blocks, BUDGET).alias("f"))


@query(sql_pack(_paper_source, "arxiv_id", BUDGET))
def paper_context(spark, d):  # noqa: ANN001, ANN201
    return _paper_contexts(spark, d).select("arxiv_id", "f.used", F.array_join("f.names", ",").alias("names"), "f.text")


_summaries = """
SELECT cp.collection_id, '[arXiv:' || p.arxiv_id || '] ' || coalesce(p.title, '') || chr(10) || coalesce(m.summary, '') AS line, cp.rank, p.published, p.arxiv_id
FROM cp JOIN p ON p.arxiv_id = cp.paper_id JOIN m ON m.paper_id = p.arxiv_id
"""
_evidence = """
SELECT cp.collection_id, '[arXiv:' || e.paper_id || '] ' || coalesce(e.claim, '') || ' :: ' || coalesce(e.result, '') AS line, e.id
FROM cp JOIN p ON p.arxiv_id = cp.paper_id JOIN e ON e.paper_id = p.arxiv_id
"""
_order = "rank NULLS FIRST, published DESC NULLS LAST, arxiv_id"


def _joined(rows: str, order: str, sep: str) -> str:
    return f"""
SELECT collection_id, n, CAST(length(text) AS BIGINT) AS chars, text
FROM (SELECT collection_id, count(*) AS n, string_agg(line, {sep} ORDER BY {order}) AS text FROM ({rows}) GROUP BY collection_id)
"""


SUMMARIES, EVIDENCE = _joined(_summaries, _order, "chr(10) || chr(10)"), _joined(_evidence, "id", "chr(10)")


@query(SUMMARIES)
def synthesis_summaries(spark, d):  # noqa: ANN001, ANN201
    """The joined summaries of every collection, whatever their length."""
    return S.whole_summaries(links(spark, d), papers(spark, d), memory(spark, d))


@query(EVIDENCE)
def synthesis_evidence_text(spark, d):  # noqa: ANN001, ANN201
    """The joined evidence of every collection, whatever its length."""
    return S.whole_evidence_texts(links(spark, d), papers(spark, d), evidence(spark, d))


# The plan leaves a text above the bound out by its length, as it can't fit the budget either; the SQL joins it and doesn't take it.
_synthesis_source = f"""
SELECT id, true AS req, 100 AS pri, 0 AS ord, 'TASK' AS name, '{C.SYNTHESIS_TASK}' AS text FROM c
UNION ALL SELECT id, true, 100, 1, 'RESEARCH_GOAL', 'Synthesize the scientific picture represented by collection ' || name FROM c
UNION ALL SELECT id, false, 70, 2, 'PREVIOUS_SYNTHESIS', coalesce(description, '') FROM c
UNION ALL SELECT c.id, false, 85, 3, 'PAPER_SUMMARIES', coalesce(a.text, '') FROM c LEFT JOIN ({SUMMARIES}) a ON a.collection_id = c.id
UNION ALL SELECT c.id, false, 90, 4, 'EVIDENCE', coalesce(b.text, '') FROM c LEFT JOIN ({EVIDENCE}) b ON b.collection_id = c.id
"""


@query(sql_pack(_synthesis_source, "id", 6500))
def synthesis_context(spark, d):  # noqa: ANN001, ANN201
    """The context of each collection's synthesis, with its description as the synthesis before."""
    p = papers(spark, d)
    a = S.summaries(links(spark, d), p, memory(spark, d), MOST).select(F.col("collection_id").alias("id"), F.struct("n", "text").alias("a"))
    b = S.evidence_texts(links(spark, d), p, evidence(spark, d), MOST).select(F.col("collection_id").alias("id"), F.struct("n", "text").alias("b"))
    x = collections(spark, d).join(a, "id", "left").join(b, "id", "left")
    goal = F.concat(F.lit("Synthesize the scientific picture represented by collection "), "name")
    blocks = C.synthesis_blocks(goal, F.col("a.text"), F.col("b.text"), F.col("description"))
    too_long = {"PAPER_SUMMARIES": F.col("a.n").isNotNull() & F.col("a.text").isNull(), "EVIDENCE": F.col("b.n").isNotNull() & F.col("b.text").isNull()}
    keep = lambda k: ~F.coalesce(F.when(k["name"] == "EVIDENCE", too_long["EVIDENCE"]).when(k["name"] == "PAPER_SUMMARIES", too_long["PAPER_SUMMARIES"]), F.lit(False))
    packed = x.select("id", C.pack(F.filter(blocks, keep), 6500).alias("f"))
    return packed.select("id", "f.used", F.array_join("f.names", ",").alias("names"), "f.text")


@query(f"SELECT arxiv_id, substring({sql_strip('coalesce(abstract, chr(0))')}, 1, 3000) AS reply FROM p WHERE abstract IS NOT NULL")
def extractive_summary(spark, d):  # noqa: ANN001, ANN201
    """What the extractive provider answers to each paper's packed context."""
    p = papers(spark, d).where("abstract IS NOT NULL")
    packed = p.select("arxiv_id", C.pack(C.paper_blocks(F.col("title"), F.col("abstract"), None, F.lit("goal")), BUDGET).text.alias("prompt"))
    return packed.select("arxiv_id", extract(F.col("prompt")).alias("reply"))


@query(f"SELECT arxiv_id, substring({sql_strip('abstract')}, 1, 2200) AS summary, '' AS method, '' AS research_question, 0 AS lists, 0 AS evidence FROM p WHERE abstract IS NOT NULL")
def extractive_json(spark, d):  # noqa: ANN001, ANN201
    p = papers(spark, d).where("abstract IS NOT NULL")
    packed = p.select("arxiv_id", C.pack(C.paper_blocks(F.col("title"), F.col("abstract")), BUDGET).text.alias("prompt"))
    read = replies.parse(packed.select("arxiv_id", extract(F.col("prompt"), True).alias("reply")), "reply")
    lists = F.flatten(F.array(*[f"parsed.{c}" for c in ("datasets", "baselines", "main_results", "limitations")]))
    return read.select("arxiv_id", "parsed.summary", "parsed.method", "parsed.research_question", F.size(lists).alias("lists"), F.size("parsed.evidence").alias("evidence"))


def _replies(spark, d):  # noqa: ANN001, ANN202
    """Replies written of the stored memory: bare, within prose, and broken ones."""
    m = memory(spark, d)
    lists = [F.col(c) for c in ("datasets", "baselines", "main_results", "limitations")]
    text = F.to_json(F.struct("summary", "research_question", "method", *lists))
    way = F.length("paper_id") + F.length(F.coalesce("summary", F.lit("")))
    reply = F.when(way % 3 == 0, F.concat(F.lit("Sure, here it is:\n"), text, F.lit("\nAnything else?"))).when(way % 3 == 1, F.concat(F.lit(" \n"), text)).otherwise(F.concat(F.lit("no "), F.substring(text, 2, 40)))
    return m.select("paper_id", way.alias("way"), reply.alias("reply"))


LISTS = ("datasets", "baselines", "main_results", "limitations")
_way = "(length(paper_id) + length(coalesce(summary, ''))) % 3"


@query(f"SELECT paper_id, {_way} <> 2 AS found, CASE WHEN {_way} <> 2 THEN summary END AS summary, CASE WHEN {_way} <> 2 THEN method END AS method FROM m")
def json_recover(spark, d):  # noqa: ANN001, ANN201
    json = _replies(spark, d).select("paper_id", replies.recover(F.col("reply")).alias("json"))
    return json.select("paper_id", F.col("json").isNotNull().alias("found"), *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("summary", "method")])


@query(f"""
SELECT paper_id, {sql_strip("coalesce(summary, '')")} AS summary, {sql_strip("coalesce(research_question, '')")} AS research_question, {sql_strip("coalesce(method, '')")} AS method,
  {", ".join(f"coalesce(array_to_string({c}, ';'), '') AS {c}" for c in LISTS)} FROM m WHERE {_way} <> 2
""")
def memory_from_json(spark, d):  # noqa: ANN001, ANN201
    read = replies.parse(_replies(spark, d), "reply").where("parsed IS NOT NULL")
    return replies.memory(read, "paper_id").select("paper_id", "summary", "research_question", "method", *[F.array_join(c, ";").alias(c) for c in LISTS])


def _evidence_replies(spark, d):  # noqa: ANN001, ANN202
    """A reply for each ten of a paper's evidence rows."""
    e = evidence(spark, d).withColumn("run", F.floor(F.col("id") / 10))
    item = F.struct("id", "claim", "evidence_type", "result", "section", "quote", "confidence", "tags")
    grouped = e.groupBy("paper_id", "run").agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    bare = F.transform("evidence", lambda x: x.dropFields("id"))
    return grouped.select(F.concat("paper_id", F.lit("/"), "run").alias("key"), F.to_json(F.struct(bare.alias("evidence"))).alias("reply"))


_items = "SELECT paper_id || '/' || CAST(floor(id / 10) AS BIGINT) AS key, CAST(row_number() OVER (PARTITION BY paper_id, floor(id / 10) ORDER BY id) AS INTEGER) AS n, * FROM e"


@query(f"""
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY n) - 1 AS INTEGER) AS place, {sql_strip("claim")} AS claim,
  {sql_strip("coalesce(evidence_type, 'claim')")} AS evidence_type, {sql_strip("coalesce(quote, '')")} AS quote, coalesce(confidence, 0.5::DOUBLE) AS confidence,
  {sql_strip("coalesce(result, '')")} AS result, {sql_strip("coalesce(section, '')")} AS section, coalesce(array_to_string(tags, ';'), '') AS tags
FROM ({_items}) WHERE coalesce(claim, '') <> ''
""")
def evidence_from_json(spark, d):  # noqa: ANN001, ANN201
    read = replies.evidence(replies.parse(_evidence_replies(spark, d), "reply"), "key")
    return read.select("key", "place", "claim", "evidence_type", "quote", "confidence", "result", "section", F.array_join("tags", ";").alias("tags"))


@query(f"SELECT key, count(*) AS items, sum(CASE WHEN coalesce(claim, '') <> '' THEN 1 ELSE 0 END)::BIGINT AS kept FROM ({_items}) GROUP BY key")
def evidence_filter(spark, d):  # noqa: ANN001, ANN201
    read = replies.parse(_evidence_replies(spark, d), "reply")
    kept = F.filter(F.col("parsed.evidence"), lambda e: F.coalesce(e.claim, F.lit("")) != "")
    return read.select("key", F.size("parsed.evidence").cast("long").alias("items"), F.size(kept).cast("long").alias("kept"))


@query("""
SELECT paper_id, paper_id AS summary, CAST(length(coalesce(summary, '')) AS VARCHAR) AS research_question, 'None' AS method, array_to_string(string_split(paper_id, ''), ',') AS datasets,
  '1,b,None' AS baselines, '' AS main_results, '7,c' AS claims, 'None,theory' AS types, 0.5::DOUBLE AS first_confidence, 1.0::DOUBLE AS last_confidence, 'x,y' AS tags
FROM m
""")
def reply_coercion(spark, d):  # noqa: ANN001, ANN201
    """Loosely typed replies: numbers and nulls for strings, strings for lists, items without claim, confidences out of range."""
    reply = F.format_string(
        'Here: {"summary": " %s ", "research_question": %d, "method": null, "datasets": "%s", "baselines": [1, "b", null], "main_results": null, "evidence": '
        '[{"claim": 7, "evidence_type": null, "confidence": "high"}, {"claim": ""}, 3, {"claim": " c", "evidence_type": "theory", "confidence": 2.5, "tags": "xy"}]}',
        "paper_id", F.length(F.coalesce("summary", F.lit(""))), "paper_id",
    )
    x = memory(spark, d).select("paper_id", replies.coerce_udf(reply).alias("r"))
    line = lambda c: F.array_join(c, ",")
    return x.select(
        "paper_id", "r.summary", "r.research_question", "r.method", line("r.datasets").alias("datasets"), line("r.baselines").alias("baselines"), line("r.main_results").alias("main_results"),
        line("r.evidence.claim").alias("claims"), line("r.evidence.evidence_type").alias("types"), F.get("r.evidence", F.lit(0)).confidence.alias("first_confidence"),
        F.element_at("r.evidence", -1).confidence.alias("last_confidence"), line(F.element_at("r.evidence", -1).tags).alias("tags"),
    )
