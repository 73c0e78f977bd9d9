"""Queries that write whole tables to a store of their own and read them back: the calls that users make."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import functions as F

from litspark import cli, pipelines
from litspark.config import Config, shared_folder
from litspark.functions.context import input_budget
from litspark.operators.routing import route
from litspark.plans.base import CELLS, evidence, memory, papers, query, raw, sections
from litspark.plans.pages import escaped, sql_part, sql_text
from litspark.plans.retrieval import sql_prompt
from litspark.plans.scalars import QUESTION, sql_strip
from litspark.providers import Extractive
from litspark.schema import schema
from litspark.sources.feed import FeedClient
from litspark.store import Store

STAMP = "2026-01-01T00:00:00Z"


def _store(spark) -> Store:  # noqa: ANN001
    return Store(spark, shared_folder(spark, "home") + "/store", lambda: STAMP).init()


def _papers(spark, d):  # noqa: ANN001, ANN202
    """Papers as the store has them: names as a list."""
    p = papers(spark, d).withColumn("authors", F.from_json("authors_json", "array<string>"))
    return p.select(*[f.name for f in schema("papers")])


def _filled(spark, d) -> Store:  # noqa: ANN001
    """A store of all papers in one collection."""
    store = _store(spark)
    pipelines.ingest(store, _papers(spark, d).withColumn("rank", F.length("arxiv_id")), "all", "q")
    return store


_late = "coalesce(published, '') >= '2021'"


@query(f"""
SELECT arxiv_id, CASE WHEN {_late} THEN 'new ' || coalesce(title, '') ELSE title END AS title, CASE WHEN arxiv_id LIKE '%1' THEN 'raw/' || arxiv_id END AS raw_path, '{STAMP}' AS created_at FROM p
""")
def store_papers(spark, d):  # noqa: ANN001, ANN201
    """All papers saved, some given paths, the late ones saved again: paths and creation stay."""
    store, p = _store(spark), _papers(spark, d).drop("raw_path", "clean_path", "sections_path")
    store.upsert_papers(p)
    some = p.where("arxiv_id LIKE '%1'").select("arxiv_id", F.concat(F.lit("raw/"), "arxiv_id").alias("raw_path"), F.lit("c").alias("clean_path"), F.lit("s").alias("sections_path"), F.lit("").alias("html_url"))
    store.update_artifacts(some)
    store.upsert_papers(p.where(_late).withColumn("title", F.concat(F.lit("new "), F.coalesce("title", F.lit("")))))
    return store.read("papers").select("arxiv_id", "title", "raw_path", "created_at")


@query("""
SELECT paper_id, CASE WHEN relevance >= 0.5 THEN 'again' ELSE summary END AS summary, CASE WHEN relevance >= 0.5 THEN 'second' ELSE 'first' END AS model, coalesce(relevance, 0.0::DOUBLE) AS relevance FROM m
""")
def store_memory(spark, d):  # noqa: ANN001, ANN201
    store, m = _store(spark), memory(spark, d)
    store.upsert_papers(_papers(spark, d))
    store.save_memory(m, "first")
    store.save_memory(m.where("relevance >= 0.5").withColumn("summary", F.lit("again")), "second")
    return store.read("paper_memory").select("paper_id", "summary", "model", "relevance")


@query("""
SELECT e.paper_id, e.claim, count(*) AS n FROM e WHERE e.paper_id NOT IN (SELECT paper_id FROM m) GROUP BY ALL
UNION ALL SELECT m.paper_id, m.summary, 1 FROM m WHERE m.relevance >= 0.5
""")
def store_evidence(spark, d):  # noqa: ANN001, ANN201
    """Evidence added, then that of papers with memory replaced, by one claim or by none; no id is given twice."""
    store, m = _store(spark), memory(spark, d)
    store.upsert_papers(_papers(spark, d))
    store.add_evidence(evidence(spark, d))
    store.replace_evidence(m.select("paper_id"), m.where("relevance >= 0.5").select("paper_id", F.col("summary").alias("claim")))
    return store.read("evidence").groupBy("paper_id", "claim").agg(F.count_distinct("id").alias("n"))


@query("""
SELECT event_type AS key, props AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def store_session(spark, d):  # noqa: ANN001, ANN201
    """The event log as writes of session keys, in two turns."""
    store, e = _store(spark), raw(spark, d, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), F.struct("ts", "event_id").alias("order"))
    middle = e.agg(F.percentile_approx("order.event_id", 0.5)).first()[0]
    early, rest = e.where(F.col("order.event_id") <= middle), e.where(F.col("order.event_id") > middle)
    store.set_sessions(early)
    store.set_sessions(rest.union(early))
    return store.read("session_state").select("key", "value")


@query("""
SELECT paper_id AS scope_id, claim AS synthesis, n AS version FROM (
  SELECT *, count(*) OVER (PARTITION BY paper_id) AS n, row_number() OVER (PARTITION BY paper_id ORDER BY id DESC) AS back FROM e) WHERE back = 1
""")
def store_syntheses(spark, d):  # noqa: ANN001, ANN201
    """Each claim saved as a synthesis of its paper, in two turns: versions go on, the last text stays."""
    store = _store(spark)
    e = evidence(spark, d).select(F.lit("paper").alias("scope_type"), F.col("paper_id").alias("scope_id"), F.col("claim").alias("synthesis"), F.lit(1).alias("evidence_count"), F.col("id").alias("order"))
    middle = e.agg(F.percentile_approx("order", 0.5)).first()[0]
    store.save_syntheses(e.where(F.col("order") <= middle))
    store.save_syntheses(e.where(F.col("order") > middle))
    return store.read("synthesis_memory").select("scope_id", "synthesis", "version")


@query("SELECT event_type, props AS payload_json, count(*) AS n FROM events GROUP BY ALL")
def store_events(spark, d):  # noqa: ANN001, ANN201
    """The log appended in two turns, each event with an id of its own."""
    store, e = _store(spark), raw(spark, d, "events").select("event_type", F.col("props").alias("payload_json"))
    store.log_events(e.where("event_type = 'view'"))
    store.log_events(e.where("event_type <> 'view' OR event_type IS NULL"))
    return store.read("event_log").groupBy("event_type", "payload_json").agg(F.count_distinct("id").alias("n"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS scope_id, coalesce(status, 'running') AS status, done AS progress_done, '{}' AS details_json FROM (
  SELECT user_id, count(*) OVER w AS done, last_value(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END IGNORE NULLS) OVER w AS status,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n = 1
""")
def store_pipeline_runs(spark, d):  # noqa: ANN001, ANN201
    """A run for each user, each of its events an update; an update without a status keeps the one before."""
    store, e = _store(spark), raw(spark, d, "events").withColumn("scope_id", F.col("user_id").cast("string"))
    store.create_pipeline_runs(e.select("scope_id").distinct().select(F.lit("p").alias("pipeline"), F.lit("user").alias("scope_type"), "scope_id", F.lit(0).cast("long").alias("progress_total")))
    ids = store.read("pipeline_runs").select("id", "scope_id")
    counted = e.join(ids, "scope_id").select("id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"), F.struct("ts", "event_id").alias("order"))
    done = counted.groupBy("id").agg(F.count("*").alias("progress_done"))
    store.update_pipeline_runs(counted.join(done, "id"))
    return store.read("pipeline_runs").select("scope_id", "status", "progress_done", "details_json")


@query("SELECT * FROM (VALUES (1::BIGINT, 'a', 'completed', 7::BIGINT), (2, 'b', 'failed', 8), (3, 'c', 'running', -1)) v(id, query, status, collection_id)")
def store_research_runs(spark, d):  # noqa: ANN001, ANN201
    store = _store(spark)
    a, b, _ = (store.start_research_run(q, "arxiv", None, None) for q in "abc")
    store.finish_research_run(b, 8, "failed")
    store.finish_research_run(a, 7)
    return store.read("research_runs").select("id", "query", "status", F.coalesce("collection_id", F.lit(-1)).alias("collection_id"))


_chosen = "arxiv_id NOT LIKE '%0'"


@query(f"""
SELECT name, active, n AS papers, CAST(best AS INTEGER) AS best FROM (
  SELECT 'first' AS name, 0 AS active, (SELECT count(*) FROM p) AS n, (SELECT min(length(arxiv_id) + 1) FROM p) AS best
  UNION ALL SELECT 'second', 1, (SELECT count(*) FROM p WHERE {_chosen}), (SELECT min(length(arxiv_id)) FROM p WHERE {_chosen})
  UNION ALL SELECT 'empty', 0, 0, -1)
""")
def store_collections(spark, d):  # noqa: ANN001, ANN201
    """Collections created and created again, papers attached and attached again with another rank."""
    store, p = _store(spark), _papers(spark, d)
    store.upsert_papers(p)
    first, second, _ = (store.create_collection(n, "d") for n in ("first", "second", "empty"))
    ranked = p.select("arxiv_id", F.length("arxiv_id").alias("rank"))
    store.attach(first, ranked)
    store.attach(second, ranked.where(_chosen))
    store.attach(first, ranked.withColumn("rank", F.col("rank") + 1))
    assert store.create_collection("second", "other") == second
    best = store.read("collection_papers").groupBy("collection_id").agg(F.min("rank").alias("best"))
    return store.list_collections().join(best, F.col("id") == F.col("collection_id"), "left").select("name", "active", F.col("paper_count").alias("papers"), F.coalesce("best", F.lit(-1)).alias("best"))


_named = ", ".join(f"('{n}', {'NULL' if q is None else repr(next(x[1] for x in CELLS if x[0] == q))})" for _, n, q, *_ in CELLS)


@query(f"""
SELECT v.name, v.parent_name, (SELECT count(*) FROM r WHERE r.cell = v.name) AS paper_count FROM (VALUES {_named}) v(name, parent_name)
WHERE v.parent_name IS NOT NULL OR EXISTS (SELECT * FROM r WHERE r.cell = v.name) OR v.name IN ('geology', 'chemistry')
""")
def store_cells(spark, d):  # noqa: ANN001, ANN201
    """Cells split, papers assigned twice, missing cells made on the way."""
    store = _store(spark)
    store.upsert_papers(_papers(spark, d))
    for _, name, parent, *_ in CELLS:
        if parent is not None:
            store.split_cell(next(x[1] for x in CELLS if x[0] == parent), [name])
    routes = route(papers(spark, d)).drop("place")
    store.assign(routes.withColumn("rationale", F.lit("first")))
    store.assign(routes)
    return store.list_cells().select("name", "parent_name", "paper_count")


@query(f"""
SELECT arxiv_id AS paper_id, substring({sql_strip("coalesce(abstract, '')")}, 1, 2200) AS summary, 'extractive-fallback:m' AS model, 1::BIGINT AS events FROM p
""")
def pipeline_summarize(spark, d):  # noqa: ANN001, ANN201
    """All papers ingested and summarised by extraction; each has one event."""
    store = _filled(spark, d)
    pipelines.summarize(store, Extractive(), "m", input_budget(), "all")
    logged = store.read("event_log").where("event_type = 'paper.summarized'").groupBy(F.get_json_object("payload_json", "$.paper_id").alias("paper_id")).agg(F.count("*").alias("events"))
    return store.read("paper_memory").join(logged, "paper_id").select("paper_id", "summary", "model", "events")


@query("SELECT arxiv_id AS paper_id, cell, score, rationale FROM r")
def pipeline_route(spark, d):  # noqa: ANN001, ANN201
    store = _filled(spark, d)
    pipelines.route_collection(store)
    cells = store.read("research_cells").select(F.col("id").alias("cell_id"), F.col("name").alias("cell"))
    return store.read("domain_assignments").join(cells, "cell_id").select("paper_id", "cell", "score", "rationale")


@query("SELECT 'all' AS scope_id, (SELECT count(*) FROM e) AS evidence_count, 2::BIGINT AS version, 2::BIGINT AS events")
def pipeline_synthesize(spark, d):  # noqa: ANN001, ANN201
    """A collection of all papers synthesised twice."""
    store = _filled(spark, d)
    store.save_memory(memory(spark, d), "m")
    store.add_evidence(evidence(spark, d))
    for _ in range(2):
        pipelines.synthesize(store, Extractive(), input_budget(), "all")
    events = store.read("event_log").where("event_type = 'synthesis.updated'").agg(F.count("*").alias("events"))
    return store.read("synthesis_memory").crossJoin(events).select("scope_id", "evidence_count", "version", "events")  # one row


class Echo:
    """A provider that answers with what it was asked."""

    name = "echo"

    def generate(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        return prompt


@query(sql_prompt("prompt"))
def pipeline_answer(spark, d):  # noqa: ANN001, ANN201
    """A question answered over a collection of all papers by a provider that repeats the prompt."""
    store = _filled(spark, d)
    store.save_memory(memory(spark, d), "m")
    store.add_evidence(evidence(spark, d).orderBy("id"))  # new ids in the order of the old
    said = pipelines.answer(store, Echo(), QUESTION, "all")
    return spark.createDataFrame([(said,)], "prompt string")


def _pages(spark, d):  # noqa: ANN001, ANN202
    """A page of each paper that has sections, with all of them."""
    s = sections(spark, d).where("text IS NOT NULL").select("paper_id", F.struct("idx", "heading", "text").alias("s"))
    html = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: F.concat(F.lit("<section class='ltx_section'><h2>"), escaped(x.heading), F.lit("</h2><p>"), escaped(x.text), F.lit("</p></section>"))), "")
    pages = s.groupBy(F.col("paper_id").alias("arxiv_id")).agg(F.concat(F.lit("<article>"), html, F.lit("</article>")).alias("html"))
    return pages.join(papers(spark, d).select("arxiv_id"), "arxiv_id", "left_semi")


@query(f"""
SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY idx) - 1 AS INTEGER) AS idx, heading, text, true AS kept FROM (
  SELECT paper_id, idx, {sql_part("heading")} AS heading, {sql_text(sql_part("heading"), sql_part("text"))} AS text
  FROM s WHERE text IS NOT NULL AND paper_id IN (SELECT arxiv_id FROM p)) WHERE length(text) >= 120
""")
def pipeline_pages(spark, d):  # noqa: ANN001, ANN201
    """Pages kept as artifacts, their sections in the store, and the papers' paths naming the artifacts."""
    store = _store(spark)
    store.upsert_papers(_papers(spark, d))
    pipelines.save_pages(store, _pages(spark, d), "pages")
    paths = store.read("papers").where("raw_path LIKE '%/artifacts/pages#%'").select(F.col("arxiv_id").alias("paper_id"), F.lit(True).alias("kept"))
    return store.read("sections").join(paths, "paper_id").select("paper_id", "idx", "heading", "text", "kept")


def _feed(url: str) -> str:
    """A feed of 250 entries, one a day, the latest first, in pages."""
    asked = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items() if re.fullmatch(r"\d+", v[0])}
    day = lambda i: f"2025-{(249 - i) // 28 + 1:02d}-{(249 - i) % 28 + 1:02d}"
    entries = range(asked["start"], min(250, asked["start"] + asked["max_results"]))
    return "<feed>" + "".join(f"<entry><id>http://x/abs/2501.{i:05d}v3</id><title>T {i}</title><published>{day(i)}T00:00:00Z</published></entry>" for i in entries) + "</feed>"


@query("""
SELECT arxiv_id, title, CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS rank, 'completed' AS status FROM (
  SELECT i, '2501.' || lpad(CAST(i AS VARCHAR), 5, '0') AS arxiv_id, 'T ' || i AS title,
    '2025-' || lpad(CAST((249 - i) // 28 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST((249 - i) % 28 + 1 AS VARCHAR), 2, '0') AS day
  FROM generate_series(0, 219) t(i)) WHERE day BETWEEN '2025-03-05' AND '2025-09-01'
""")
def pipeline_search(spark, d):  # noqa: ANN001, ANN201
    """A search of 220 entries in three pages, of which the days outside the range are dropped; no network."""
    store = _store(spark)
    pipelines.search(store, FeedClient(_feed, 0.0), "q", "2025-03-05", "2025-09-01", "found", 220)
    status = store.read("research_runs").select("status")
    return store.collection_papers("found").crossJoin(status).select("arxiv_id", "title", "rank", "status")  # one row


_cell_lines = "(SELECT v.name, v.parent, (SELECT count(*) FROM r WHERE r.cell = v.name) AS n FROM (VALUES ('geology', '-'), ('physics', '-'), ('biology', '-'), ('chemistry', '-'), ('ai_agents', '-'), ('seismology', 'geology')) v(name, parent))"


@query(f"""
SELECT 'collections' AS command, '* ' || rpad('all', 28, ' ') || ' papers=' || (SELECT count(*) FROM p) || ' created=' AS line
UNION ALL SELECT 'papers', line FROM (SELECT arxiv_id || chr(9) || substring(coalesce(published, ''), 1, 10) || chr(9) || coalesce(title, '') AS line
  FROM p ORDER BY length(arxiv_id), published DESC NULLS LAST, arxiv_id LIMIT 20)
UNION ALL SELECT 'papers', 'Total shown: ' || least(20, (SELECT count(*) FROM p))
UNION ALL SELECT 'split', 'Split geology -> seismology'
UNION ALL SELECT 'cells', rpad(name, 20, ' ') || ' parent=' || rpad(parent, 20, ' ') || ' papers=' || n FROM {_cell_lines} WHERE n > 0 OR name IN ('geology', 'seismology')
""")
def cli_lines(spark, d):  # noqa: ANN001, ANN201
    """What the commands of few lines say over a collection of all papers."""
    store = _filled(spark, d)
    pipelines.route_collection(store)
    config = Config(home=store.root.removesuffix("/store"), provider="extractive")
    said = []
    for name, argv in (
        ("collections", ["collections"]), ("papers", ["papers", "--limit", "20"]),
        ("split", ["cells", "split", "geology", "seismology"]), ("cells", ["cells", "list"]),
    ):
        said += [(name, re.sub(r"created=\S*$", "created=", line)) for line in cli.lines(cli.parser().parse_args(argv), spark, config)]
    return spark.createDataFrame(said, "command string, line string")
