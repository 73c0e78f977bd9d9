"""Queries of listings, changes and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import catalog, merging, working
from litspark.operators.merging import insert_ignore, latest, replace_groups, update_where, upsert
from litspark.plans.base import CELLS_DDL, assignments, cells, collections, evidence, links, memory, papers, query, raw

NAMED = "tuned-vaccine"


@query("SELECT arxiv_id, title, published FROM p WHERE arxiv_id = (SELECT min(arxiv_id) FROM papers)")
def paper_lookup(spark, d):  # noqa: ANN001, ANN201
    """A point lookup; the filter on the key reaches the scan, below the choice of the latest row."""
    key = raw(spark, d, "papers").agg(F.min("arxiv_id")).first()[0]
    return latest(raw(spark, d, "papers").where(F.col("arxiv_id") == key), ["arxiv_id"], "updated_at").select("arxiv_id", "title", "published")


@query("SELECT id, name FROM c WHERE active = 1 ORDER BY id DESC LIMIT 1")
def active_collection(spark, d):  # noqa: ANN001, ANN201
    return catalog.collection(collections(spark, d)).select("id", "name")


@query("""
SELECT c.id, c.name, c.active, count(cp.paper_id) AS paper_count FROM c LEFT JOIN cp ON cp.collection_id = c.id GROUP BY c.id, c.name, c.active
""")
def list_collections(spark, d):  # noqa: ANN001, ANN201
    return catalog.list_collections(collections(spark, d), links(spark, d)).select("id", "name", "active", "paper_count")


@query(f"""
SELECT p.arxiv_id, p.title, p.published, cp.rank FROM p JOIN cp ON cp.paper_id = p.arxiv_id JOIN c ON c.id = cp.collection_id WHERE c.name = '{NAMED}'
""")
def collection_papers(spark, d):  # noqa: ANN001, ANN201
    return catalog.collection_papers(papers(spark, d), links(spark, d), collections(spark, d), NAMED).select("arxiv_id", "title", "published", "rank")


@query(f"""
SELECT e.id, e.paper_id, e.claim, p.title FROM e JOIN p ON p.arxiv_id = e.paper_id JOIN cp ON cp.paper_id = p.arxiv_id
JOIN c ON c.id = cp.collection_id WHERE c.name = '{NAMED}'
""")
def evidence_for_collection(spark, d):  # noqa: ANN001, ANN201
    out = catalog.evidence_for_collection(evidence(spark, d), papers(spark, d), links(spark, d), collections(spark, d), NAMED)
    return out.select("id", "paper_id", "claim", "title")


@query("""
SELECT rc.id, rc.name, q.name AS parent_name, (SELECT count(*) FROM da WHERE da.cell_id = rc.id) AS paper_count
FROM rc LEFT JOIN rc q ON q.id = rc.parent_id
""")
def list_cells(spark, d):  # noqa: ANN001, ANN201
    return catalog.list_cells(cells(spark), assignments(spark, d)).select("id", "name", "parent_name", "paper_count")


@query("""
SELECT event_type AS key, props AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def session_latest(spark, d):  # noqa: ANN001, ANN201
    """The event log read as writes of a key-value table: the last value of each key."""
    return latest(raw(spark, d, "events"), ["event_type"], "ts", "event_id").select(F.col("event_type").alias("key"), F.col("props").alias("value"))


SYNTHESES = """
SELECT paper_id AS scope_id, id, claim AS synthesis,
  row_number() OVER (PARTITION BY paper_id ORDER BY created_at, id) AS version, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, id DESC) AS back FROM e
"""


@query(f"SELECT scope_id, synthesis, version FROM ({SYNTHESES}) WHERE back = 1")
def synthesis_version(spark, d):  # noqa: ANN001, ANN201
    """Each claim saved as a synthesis of its paper: the number of saves is the version, the last text stays."""
    e = evidence(spark, d).select("paper_id", "claim", F.struct("created_at", "id").alias("at"))
    kept = e.groupBy("paper_id").agg(F.max_by("claim", "at").alias("synthesis"), F.count("*").alias("version"))
    return kept.select(F.col("paper_id").alias("scope_id"), "synthesis", "version")


@query(f"SELECT scope_id, synthesis, version FROM ({SYNTHESES}) WHERE back = 1 AND scope_id = (SELECT min(paper_id) FROM evidence)")
def synthesis_lookup(spark, d):  # noqa: ANN001, ANN201
    key = raw(spark, d, "evidence").agg(F.min("paper_id")).first()[0]
    e = latest(raw(spark, d, "evidence").where(F.col("paper_id") == key), ["id"], "created_at")
    kept = e.groupBy("paper_id").agg(F.max_by("claim", F.struct("created_at", "id")).alias("synthesis"), F.count("*").alias("version"))
    return kept.select(F.col("paper_id").alias("scope_id"), "synthesis", "version")


STAMP = "2026-11-01T00:00:00Z"
_old, _new = "coalesce(published, '') < '2023'", "coalesce(published, '') >= '2021'"


@query(f"""
SELECT arxiv_id, CASE WHEN {_new} THEN 'new ' || coalesce(title, '') ELSE title END AS title, CASE WHEN {_new} THEN '' ELSE html_url END AS html_url,
  CASE WHEN {_old} THEN raw_path ELSE 'draft' END AS raw_path, CASE WHEN {_old} THEN created_at ELSE '{STAMP}' END AS created_at,
  CASE WHEN {_new} THEN '{STAMP}' ELSE updated_at END AS updated_at
FROM p
""")
def upsert_papers(spark, d):  # noqa: ANN001, ANN201
    """Papers to 2022 are stored; those from 2021 on arrive again with other metadata."""
    columns = ["arxiv_id", "title", "html_url", "raw_path", "created_at", "updated_at"]
    p = papers(spark, d)
    new = p.where(_new).select(
        "arxiv_id", F.concat(F.lit("new "), F.coalesce("title", F.lit(""))).alias("title"), F.lit("").alias("html_url"),
        F.lit("draft").alias("raw_path"), F.lit(STAMP).alias("created_at"), F.lit(STAMP).alias("updated_at"),
    )
    return upsert(p.where(_old).select(*columns), new, ["arxiv_id"], ("created_at", "raw_path"))


@query("SELECT collection_id, paper_id, rank, added_at FROM cp")
def attach_last_wins(spark, d):  # noqa: ANN001, ANN201
    return links(spark, d).select("collection_id", "paper_id", "rank", "added_at")


@query(f"""
SELECT name, description, CASE WHEN name = '{NAMED}' THEN 1 ELSE 0 END AS active FROM c
UNION ALL SELECT 'august', 'new here', 0
""")
def activate_collection(spark, d):  # noqa: ANN001, ANN201
    """Two collections are created, one of a known name, which keeps its description and becomes active."""
    old = collections(spark, d).select("name", "description", "active")
    new = spark.createDataFrame([("august", "new here", 1), (NAMED, "ignored", 1)], old.schema)
    return merging.activate(insert_ignore(old, new, ["name"]), NAMED)


@query("""
SELECT paper_id, CASE WHEN relevance >= 0.5 THEN 'second run' ELSE model END AS model, CASE WHEN relevance >= 0.5 THEN 'again: ' || coalesce(summary, '') ELSE summary END AS summary
FROM m WHERE relevance < 0.8 OR relevance >= 0.5
""")
def upsert_memory(spark, d):  # noqa: ANN001, ANN201
    m = memory(spark, d).select("paper_id", "model", "summary", "relevance")
    old, new = m.where("relevance < 0.8"), m.where("relevance >= 0.5").withColumns({"model": F.lit("second run"), "summary": F.concat(F.lit("again: "), F.coalesce("summary", F.lit("")))})
    return upsert(old, new, ["paper_id"]).select("paper_id", "model", "summary")


@query("""
SELECT e.id, e.paper_id, e.claim FROM e WHERE e.paper_id NOT IN (SELECT paper_id FROM m)
UNION ALL SELECT 0, m.paper_id, m.summary FROM m WHERE m.relevance >= 0.5
""")
def replace_evidence(spark, d):  # noqa: ANN001, ANN201
    """Every paper with memory is done again: half of them get a new claim, the others end up without any."""
    m = memory(spark, d).select("paper_id", "summary", "relevance")
    new = m.where("relevance >= 0.5").select(F.lit(0).cast("long").alias("id"), "paper_id", F.col("summary").alias("claim"))
    return replace_groups(evidence(spark, d).select("id", "paper_id", "claim"), new, m.select("paper_id"), ["paper_id"])


@query("""
SELECT p.arxiv_id, CASE WHEN m.paper_id IS NULL THEN p.raw_path ELSE 'pages/' || p.arxiv_id END AS raw_path,
  CASE WHEN m.paper_id IS NOT NULL AND m.relevance >= 0.5 THEN 'final/' || p.arxiv_id ELSE p.html_url END AS html_url
FROM p LEFT JOIN m ON m.paper_id = p.arxiv_id
""")
def update_artifacts(spark, d):  # noqa: ANN001, ANN201
    """Papers with memory get a path; a new link replaces the old one only where it isn't empty."""
    m = memory(spark, d)
    changes = m.select(
        F.col("paper_id").alias("arxiv_id"), F.concat(F.lit("pages/"), "paper_id").alias("raw_path"),
        F.when(F.col("relevance") >= 0.5, F.concat(F.lit("final/"), "paper_id")).otherwise("").alias("html_url"),
    )
    link = F.when(F.col("c.html_url") != "", F.col("c.html_url")).otherwise(F.col("o.html_url"))
    return update_where(papers(spark, d).select("arxiv_id", "raw_path", "html_url"), changes, ["arxiv_id"], {"raw_path": F.col("c.raw_path"), "html_url": link})


@query("""
SELECT user_id AS run, status, done FROM (
  SELECT user_id, count(*) OVER w AS done, last_value(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END IGNORE NULLS) OVER w AS status,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n = 1
""")
def pipeline_run_latest(spark, d):  # noqa: ANN001, ANN201
    """Updates of runs in the log: an update without a status keeps the last one that was given."""
    e = raw(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"))
    given = F.max_by("status", F.when(F.col("status").isNotNull(), F.col("at")))
    return e.groupBy(F.col("user_id").alias("run")).agg(given.alias("status"), F.count("*").alias("done"))


@query("SELECT name, parent_id FROM rc UNION ALL SELECT 'tectonics', 1")
def cell_create_ignore(spark, d):  # noqa: ANN001, ANN201
    """A cell that exists isn't put under another parent."""
    new = spark.createDataFrame([(8, "tectonics", 1, "", "active", ""), (9, "seismology", 2, "", "active", "")], CELLS_DDL)
    return insert_ignore(cells(spark), new, ["name"]).select("name", "parent_id")


@query("""
SELECT rc.name, q.name AS parent_name FROM rc LEFT JOIN rc q ON q.id = rc.parent_id
UNION ALL SELECT x, 'biology' FROM (VALUES ('genomics'), ('neuroscience')) v(x)
""")
def cell_split(spark, d):  # noqa: ANN001, ANN201
    """biology is split in three, of which one exists elsewhere and stays there."""
    old = cells(spark)
    request = spark.createDataFrame([("biology", ["genomics", "neuroscience", "materials"])], "parent string, children array<string>")
    wanted = request.select("parent", F.posexplode("children").alias("at", "name"))
    parent = old.select(F.col("name").alias("parent"), F.col("id").alias("parent_id"))
    new = wanted.join(parent, "parent").select((F.col("at") + 100).cast("long").alias("id"), "name", "parent_id", F.lit("").alias("description"), F.lit("active").alias("status"), F.lit("").alias("created_at"))
    both = insert_ignore(old, new, ["name"])
    return both.join(both.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name")), "parent_id", "left").select("name", "parent_name")


@query("SELECT paper_id, cell_id, CASE WHEN score < 0.6 THEN 1.0::DOUBLE ELSE score END AS score, CASE WHEN score < 0.6 THEN 'by hand' ELSE rationale END AS rationale FROM da")
def assign_last_wins(spark, d):  # noqa: ANN001, ANN201
    old = assignments(spark, d).select("paper_id", "cell_id", "score", "rationale", F.lit(1).alias("seq"))
    new = old.where("score < 0.6").withColumns({"score": F.lit(1.0), "rationale": F.lit("by hand"), "seq": F.lit(2)})
    return latest(old.union(new), ["paper_id", "cell_id"], "seq").drop("seq")


@query("SELECT p.arxiv_id FROM p WHERE p.arxiv_id NOT IN (SELECT paper_id FROM m)")
def pending_papers(spark, d):  # noqa: ANN001, ANN201
    p = raw(spark, d, "papers").select("arxiv_id").distinct()
    return p.join(raw(spark, d, "paper_memory").select(F.col("paper_id").alias("arxiv_id")), "arxiv_id", "left_anti")


@query("SELECT p.arxiv_id, m.summary, 'cached' AS source FROM p JOIN m ON m.paper_id = p.arxiv_id")
def cached_papers(spark, d):  # noqa: ANN001, ANN201
    p = raw(spark, d, "papers").select(F.col("arxiv_id").alias("paper_id"))
    return memory(spark, d).join(p, "paper_id", "left_semi").select(F.col("paper_id").alias("arxiv_id"), "summary", F.lit("cached").alias("source"))


@query("""
SELECT user_id, event_id, event_type, CAST(n AS INTEGER) AS back FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 12
""")
def recent_actions(spark, d):  # noqa: ANN001, ANN201
    return working.recent(raw(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "back")


@query("""
SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS actions FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 12 GROUP BY user_id
""")
def working_memory(spark, d):  # noqa: ANN001, ANN201
    """The actions of each user added to a list one by one; only those that can stay are gathered."""
    few = working.recent(raw(spark, d, "events"), ["user_id"], "ts", "event_id")
    steps = few.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "event_type"))).alias("steps"))
    folded = F.aggregate("steps", F.array().cast("array<string>"), lambda done, x: working.added(done, x.event_type))
    return steps.select("user_id", F.array_join(folded, ",").alias("actions"))


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_counts(spark, d):  # noqa: ANN001, ANN201
    return raw(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
