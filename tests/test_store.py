import json

import pytest

from litspark import pipelines
from litspark.cli import main
from litspark.functions.context import input_budget
from litspark.operators import merging
from litspark.providers import Extractive
from litspark.sources.fetch import PageFetcher
from litspark.store import Change, Conflict, Orphans, Store

PAPER = (
    "arxiv_id string, title string, authors array<string>, abstract string, published string, updated string, categories array<string>, "
    "abs_url string, pdf_url string, html_url string, rank int"
)


def papers(spark, *rows):
    return spark.createDataFrame([(k, t, ["Alice"], a, d, d, ["cs.AI"], "", "", "h", i) for i, (k, t, a, d) in enumerate(rows, 1)], PAPER)


@pytest.fixture
def store(spark, tmp_path):
    ticks = iter(range(100_000))
    return Store(spark, str(tmp_path / "s"), lambda: f"2026-01-01T00:00:00.{next(ticks):05d}Z").init()


def test_collection_round_trip(spark, store):
    n = pipelines.ingest(store, papers(spark, ("2608.12345", "Agent Memory", "test", "2026-08-20")), "august", "q", "2026-08-01", "2026-08-31")
    assert n == 1
    got = store.collection_papers("august").collect()
    assert [(r["title"], r["rank"], r["authors"]) for r in got] == [("Agent Memory", 1, ["Alice"])]
    assert store.get_collection()["name"] == "august" and store.get_collection("")["name"] == "august"
    assert store.get_session("active_collection") == "august" and store.get_session("other", "none") == "none"
    assert store.read("research_runs").first()["status"] == "completed"
    assert json.loads(store.read("event_log").first()["payload_json"])["count"] == 1


def test_known_papers_keep_creation_and_paths(spark, store):
    store.upsert_papers(papers(spark, ("a", "old", "x", "2026-01-01")).drop("rank"))
    first = store.paper("a")
    store.update_artifacts(spark.createDataFrame([("a", "r", "c", "s", "")], "arxiv_id string, raw_path string, clean_path string, sections_path string, html_url string"))
    assert (store.paper("a")["raw_path"], store.paper("a")["html_url"]) == ("r", "h")
    store.upsert_papers(papers(spark, ("a", "new", "x", "2026-01-01"), ("b", "b", "y", "2026-01-02")).drop("rank"))
    a = store.paper("a")
    assert (a["title"], a["raw_path"], a["created_at"]) == ("new", "r", first["created_at"]) and a["updated_at"] > first["updated_at"]
    assert store.paper("b")["title"] == "b" and store.paper("c") is None


def test_collections(spark, store):
    a, b = store.create_collection("a", "first"), store.create_collection("b")
    assert b > a and store.get_collection()["name"] == "b"
    assert store.create_collection("a", "again") == a
    assert store.get_collection("a")["description"] == "first" and store.get_collection()["name"] == "a"
    assert [(r["name"], r["paper_count"]) for r in store.list_collections().collect()] == [("b", 0), ("a", 0)]
    assert store.collection_papers("none").count() == 0


def test_order_and_limit_of_a_listing(spark, store):
    store.upsert_papers(papers(spark, ("a", "", "", "2026-01-01"), ("b", "", "", "2026-01-03"), ("c", "", "", "2026-01-02")).drop("rank"))
    n = store.create_collection("x")
    store.attach(n, spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "arxiv_id string, rank int"))
    store.attach(n, spark.createDataFrame([("a", 2)], "arxiv_id string, rank int"))
    keys = lambda limit: [r["arxiv_id"] for r in store.collection_papers("x", limit).collect()]
    assert keys(None) == ["c", "b", "a"] and keys(0) == ["c", "b", "a"] and keys(1) == ["c"]


def test_evidence_is_replaced_by_paper(spark, store):
    store.upsert_papers(papers(spark, ("a", "", "", ""), ("b", "", "", "")).drop("rank"))
    items = lambda *r: spark.createDataFrame(list(r), "paper_id string, claim string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "paper_id string")
    store.replace_evidence(keys("a", "b"), items(("a", "1"), ("a", "2"), ("b", "3")))
    before = {r["id"] for r in store.read("evidence").collect()}
    store.replace_evidence(keys("a", "b"), items(("b", "4")))
    store.add_evidence(items(("b", "5")))
    after = store.read("evidence").orderBy("id").collect()
    assert [(r["paper_id"], r["claim"]) for r in after] == [("b", "4"), ("b", "5")] and not before & {r["id"] for r in after}
    with pytest.raises(Orphans):
        store.add_evidence(items(("gone", "x")))


def test_versions_and_runs(spark, store):
    assert [store.save_synthesis("collection", "x", t, 1) for t in ("one", "two")] == [1, 2]
    assert store.get_synthesis("collection", "x")["synthesis"] == "two" and store.get_synthesis("cell", "x") is None
    run = store.create_pipeline_run("summarize", "collection", "x", 3)
    store.update_pipeline_run(run, 1, details={"a": 1})
    store.update_pipeline_run(run, 2)
    r = store.read("pipeline_runs").first()
    assert (r["status"], r["progress_done"], r["details_json"]) == ("running", 2, "{}")
    store.update_pipeline_run(run, 3, "completed")
    assert store.read("pipeline_runs").first()["status"] == "completed"


def test_cells(spark, store):
    store.split_cell("geology", ["seismology", "tectonics"])
    with pytest.raises(ValueError, match="unknown parent"):
        store.create_cell("x", parent="nowhere")
    assert store.create_cell("seismology", parent="tectonics")["parent_id"] == store.create_cell("geology")["id"]
    store.upsert_papers(papers(spark, ("a", "", "", "")).drop("rank"))
    routes = lambda s: spark.createDataFrame([("a", "geology", s, "r"), ("a", "fresh", s, "r")], "arxiv_id string, cell string, score double, rationale string")
    store.assign(routes(0.5))
    store.assign(routes(0.8))
    assert {r["score"] for r in store.read("domain_assignments").collect()} == {0.8}
    got = [(r["name"], r["parent_name"], r["paper_count"]) for r in store.list_cells().collect()]
    assert got == [("geology", None, 1), ("seismology", "geology", 0), ("tectonics", "geology", 0), ("fresh", None, 1)]


def test_a_second_writer_fails(store):
    version, m = store._manifest()
    store.set_session("a", "1")
    with pytest.raises(Conflict):
        store._write_manifest(version + 1, m)
    assert store.get_session("a") == "1"


def test_interleaved_writers_conflict(spark, store):
    other = Store(spark, store.root, store.now)
    mine, theirs = store.snapshot(), other.snapshot()
    row = lambda k: Change(store.rows("session_state", (k, "v", "t")))
    other.commit(theirs, {"session_state": row("kb")})
    with pytest.raises(Conflict):
        store.commit(mine, {"session_state": row("ka")})
    assert other.get_session("kb") == "v" and store.get_session("ka") == ""
    store.set_session("ka", "w")
    assert {r["key"] for r in other.read("session_state").collect()} == {"ka", "kb"}


def test_a_change_is_computed_again_after_a_conflict(spark, store):
    other, tried = Store(spark, store.root, store.now), []

    def make(at):
        tried.append(at.version)
        if len(tried) == 1:
            other.log_event("theirs", {})
        events = spark.createDataFrame([("mine", "{}")], "event_type string, payload_json string").coalesce(1)
        return {"event_log": Change(at.new_ids("event_log", store._stamped(events, "created_at")))}

    store.change(make)
    got = store.read("event_log").collect()
    assert len(tried) == 2 and sorted(r["event_type"] for r in got) == ["mine", "theirs"] and len({r["id"] for r in got}) == 2


def test_changes_are_merged_and_nothing_else_changes(spark, store):
    store.set_sessions(spark.createDataFrame([(f"k{i}", "0", 0) for i in range(200)], "key string, value string, order int"))
    base = store.snapshot().segments("session_state")["base"]
    want = {f"k{i}": "0" for i in range(200)}
    for i in range(12):
        store.set_session(f"k{i % 5}", str(i))
        want[f"k{i % 5}"] = str(i)
    held = store.snapshot().segments("session_state")
    assert held["base"] == base and len(held["changes"]) <= 8  # a small change doesn't rewrite the base
    read = lambda: {r["key"]: r["value"] for r in store.read("session_state").collect()}
    assert read() == want
    assert store.compact("session_state", 0, 0.0) and not store.snapshot().segments("session_state")["changes"] and read() == want
    assert store.vacuum() > 0 and read() == want and not store.compact("session_state", 0)


def test_removed_rows_stay_removed(spark, store):
    store.upsert_papers(papers(spark, ("a", "", "", ""), ("b", "", "", "")).drop("rank"))
    items = lambda *r: spark.createDataFrame(list(r), "paper_id string, claim string")
    store.add_evidence(items(("a", "1"), ("b", "2")))
    store.replace_evidence(spark.createDataFrame([("a",)], "paper_id string"), items(("b", "3")).where("false"))
    assert [r["claim"] for r in store.read("evidence").collect()] == ["2"]
    store.compact("evidence", 0, 0.0)
    assert [r["claim"] for r in store.read("evidence").collect()] == ["2"]


def test_repeated_memory_rows_are_one(spark, store):
    store.upsert_papers(papers(spark, ("a", "", "", "")).drop("rank"))
    store.save_memory(spark.createDataFrame([("a", "x"), ("a", "x")], "paper_id string, summary string"), "m")
    assert store.read("paper_memory").count() == 1


class Flaky:
    """A model that answers some papers without JSON and fails for others."""

    name = "flaky"

    def __init__(self, mended=False):
        self.mended = mended

    def generate(self, prompt, system="", json_mode=False):
        if not self.mended and "About memory 17." in prompt:
            return "no braces here"
        if not self.mended and "About memory 18." in prompt:
            raise KeyError("lost")
        return '{"summary": "fine", "evidence": [{"claim": "c"}]}'


def test_bad_replies_are_set_aside_and_the_next_run_goes_on(spark, store):
    rows = [(f"p{i:03d}", "t", f"About memory {i}.", "2026-08-01") for i in range(100)]
    pipelines.ingest(store, papers(spark, *rows), "august")
    with pytest.raises(pipelines.RejectedReplies, match="2 of 100"):
        pipelines.summarize(store, Flaky(), "m", input_budget(), batch=40)
    assert store.read("paper_memory").count() == 98 == store.read("evidence").count()
    run = store.read("pipeline_runs").first()
    assert (run["status"], run["progress_done"], json.loads(run["details_json"])["rejected"]) == ("failed", 98, 2)
    kinds = [r["event_type"] for r in store.read("event_log").collect()]
    assert kinds.count("paper.summarized") == 98 and kinds.count("paper.rejected") == 2
    again = [r["source"] for r in pipelines.summarize(store, Flaky(True), "m", input_budget()).collect()]
    assert sorted(again) == ["cached"] * 98 + ["flaky"] * 2


def a_page(url):
    if url.endswith("p2"):
        raise OSError("no such page")
    return (429, url, "") if url.endswith("p3") else (200, url + "v1", "<article><section><h2>Method</h2>" + "x " * 100 + "</section></article>")


def test_deep_reading_fetches_pages(spark, store):
    pipelines.ingest(store, papers(spark, *[(f"p{i}", "t", "a", "2026-08-01") for i in (1, 2, 3)]), "august")
    fetcher = PageFetcher(a_page, 0.0)
    got = {r["arxiv_id"]: (r["status"], r["error"]) for r in fetcher.fetch(store.read("papers")).collect()}
    assert got == {"p1": (200, None), "p2": (None, "no such page"), "p3": (429, "HTTP 429")}
    assert {r["source"] for r in pipelines.summarize(store, Extractive(), "m", input_budget(), fetcher=fetcher).collect()} == {"extractive-fallback"}
    assert [r["paper_id"] for r in store.read("sections").collect()] == ["p1"] and store.paper("p1")["html_url"].endswith("p1v1")
    assert store.paper("p3")["raw_path"] is None


def test_a_refused_client_waits_and_stops():
    waits = []
    fetcher = PageFetcher(lambda url: (403, url, ""), 1.0, sleep=waits.append)
    errors = [r[4] for r in fetcher.rows(iter("abcde"))]
    assert errors[:3] == ["HTTP 403"] * 3 and errors[3].startswith("not asked") and waits == [2.0, 4.0]


def test_pipelines(spark, store):
    rows = [(f"p{i}", f"Seismic agent {i}", f"About memory {i}.", f"2026-08-0{i}") for i in (1, 2, 3)]
    pipelines.ingest(store, papers(spark, *rows), "august")
    budget = input_budget()
    first = {r["arxiv_id"]: (r["summary"], r["source"]) for r in pipelines.summarize(store, Extractive(), "m", budget, limit=2).collect()}
    assert first == {"p1": ("About memory 1.", "extractive-fallback"), "p2": ("About memory 2.", "extractive-fallback")}
    page = "<article><section><h2>Method</h2>" + "x " * 100 + "</section></article>"
    pages = spark.createDataFrame([("p3", page)], "arxiv_id string, html string")
    again = {r["arxiv_id"]: r["source"] for r in pipelines.summarize(store, Extractive(), "m", budget, pages=pages).collect()}
    assert again == {"p1": "cached", "p2": "cached", "p3": "extractive-fallback"}
    assert [(r["paper_id"], r["heading"], r["level"]) for r in store.read("sections").collect()] == [("p3", "Method", 2)]
    assert store.paper("p3")["sections_path"].endswith("#p3/sections_json") and store.paper("p3")["html_url"] == "h" and store.paper("p1")["raw_path"] is None
    assert store.memory("p3")["model"] == "extractive-fallback:m" and store.memory("p3")["relevance"] == 0.0
    assert pipelines.route_collection(store).count() == 6
    assert [r["arxiv_id"] for r in pipelines.find(store, "memory 2", "august", "geology").collect()][0] in {"p1", "p2", "p3"}
    assert pipelines.find(store, "memory", "august", "no such cell").count() == 0
    assert pipelines.answer(store, Extractive(), "memory") == ""
    assert pipelines.synthesize(store, Extractive(), budget) == "" and store.get_synthesis("collection", "august")["version"] == 1
    kinds = [r["event_type"] for r in store.read("event_log").collect()]
    assert kinds.count("paper.summarized") == 3 and "collection.routed" in kinds and "synthesis.updated" in kinds
    with pytest.raises(pipelines.NoCollection):
        pipelines.route_collection(store, "none")


def test_failed_ingest_leaves_an_empty_active_collection(spark, store):
    from pyspark.sql import functions as F

    broken = papers(spark, ("a", "", "", "")).withColumn("title", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        pipelines.ingest(store, broken, "august")
    assert store.read("research_runs").first()["status"] == "failed" and store.get_collection()["name"] == "august"


def test_merging_keeps_all_rows_of_both(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 1, "x")], "k string, v int, w string")
    new = spark.createDataFrame([("b", None, "y"), ("c", 2, "z")], "k string, v int, w string")
    got = sorted(map(tuple, merging.upsert(old, new, ["k"], ("w",)).collect()))
    assert got == [("a", 1, None), ("b", None, "x"), ("c", 2, "z")]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("LITSPARK_HOME", str(tmp_path))
    monkeypatch.setenv("LITSPARK_PROVIDER", "extractive")
    entry = "<entry><id>http://x/abs/2608.{i}v1</id><published>2026-08-{i}T00:00:00Z</published><title>Agent {i}</title><summary>Seismic memory.</summary></entry>"
    (tmp_path / "feed.xml").write_text("<feed>" + "".join(entry.format(i=i) for i in (11, 12, 25)) + "</feed>")
    main(["collections"], spark)
    main(["search", "--query", "q", "--from", "2026-08-01", "--to", "2026-08-20", "--name", "aug", "--files", str(tmp_path / "feed.xml")], spark)
    main(["papers", "--limit", "1"], spark)
    main(["cells", "create", "geology"], spark)
    main(["route"], spark)
    main(["cells"], spark)
    main(["summarize"], spark)
    main(["rag", "--question", "zz"], spark)
    main(["doctor"], spark)
    out = capsys.readouterr().out
    for part in ("No collections", "Found: 2", "- 2608.12 2026-08-12 Agent 12", "Total shown: 1", "Created cell: geology", "ai_agents:0.50", "papers=2", "[extractive-fallback]", "Provider: extractive-fallback"):
        assert part in out
