"""Ingesting, summarising, routing, synthesising and answering, each as a few plans over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions import context as C
from litspark.functions import text as T
from litspark.operators import retrieval as R
from litspark.operators import synthesis as S
from litspark.operators.routing import route
from litspark.providers import ANSWER_SYSTEM, SUMMARY_SUFFIX, SUMMARY_SYSTEM, SYNTHESIS_SUFFIX, SYNTHESIS_SYSTEM, Extractive, Provider, generate
from litspark.sources import replies
from litspark.sources.feed import FeedClient
from litspark.sources.fetch import PageFetcher
from litspark.sources.html import page_udf
from litspark.store import Store


class NoCollection(ValueError):
    pass


def _collection(store: Store, name: str | None):  # noqa: ANN202
    row = store.get_collection(name)
    if row is None:
        raise NoCollection("there is no such collection; search first or name one")
    return row


def ingest(store: Store, papers: DataFrame, name: str, query: str = "", date_from: str | None = None, date_to: str | None = None) -> int:
    """Save ranked papers (with column rank) as a collection, which becomes the active one; their number.

    The collection exists before its papers are read: where that fails, it stays empty and the run failed.
    """
    run = store.start_research_run(query, "arxiv", date_from, date_to)
    number = store.create_collection(name, f"arXiv search: {query} ({date_from}..{date_to})", True)
    try:
        store.upsert_papers(papers.drop("rank"))
        store.attach(number, papers.select("arxiv_id", "rank"))
        count = papers.count()
    except Exception:
        store.finish_research_run(run, number, "failed")
        raise
    store.finish_research_run(run, number, "completed")
    store.set_session("active_collection", name)
    store.log_event("search.completed", {"run_id": run, "collection": name, "count": count})
    return count


def search(store: Store, client: FeedClient, query: str, date_from: str | None, date_to: str | None, name: str, most: int = 100) -> int:
    found = client.search(store.spark, query, date_from, date_to, most).cache()  # pages are fetched on the driver already
    try:
        return ingest(store, found, name, query, date_from, date_to)
    finally:
        found.unpersist()


def contexts(papers: DataFrame, budget: int, goal: str = "", sections: DataFrame | None = None) -> DataFrame:
    """(arxiv_id, prompt, names, used) of papers; sections: (paper_id, idx, heading, text)."""
    picked = None
    if sections is not None:
        scored = sections.withColumn("_score", T.section_score(F.col("heading"), F.col("idx") == 0))
        order = Window.partitionBy("paper_id").orderBy(F.desc("_score"), F.asc("idx"))
        best = scored.withColumn("_n", F.row_number().over(order)).where("_n <= 6")
        few = best.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("_n", "heading", "text"))).alias("_few"))
        papers = papers.join(few, papers.arxiv_id == few.paper_id, "left").drop("paper_id")
        picked = F.transform("_few", lambda s: F.struct(s.heading.alias("heading"), s.text.alias("text")))
    blocks = C.paper_blocks(F.col("title"), F.col("abstract"), picked, F.lit(goal) if goal else None)
    return papers.select("arxiv_id", C.pack(blocks, budget).alias("f")).select("arxiv_id", F.col("f.text").alias("prompt"), "f.names", "f.used")


class RejectedReplies(RuntimeError):
    """Some replies held no JSON, or the model failed; all others are saved."""


def summarize(
    store: Store, of: Provider, model: str, budget: int, name: str | None = None, limit: int | None = None, force: bool = False,
    pages: DataFrame | None = None, fetcher: PageFetcher | None = None, batch: int = 5000,
) -> DataFrame:
    """Memory and evidence for the collection's papers that have none yet, or for all of them with force.

    pages (arxiv_id, html) or a fetcher add sections of the papers' HTML; papers without a page use their
    abstract only. A model's replies are taken and committed for about `batch` papers at a time, so that what
    is done stays done when a later batch fails; the next run goes on with the papers that have no memory.
    Replies without JSON, and papers for which the model failed, are kept in the run's folder, named in the
    event log, and raise RejectedReplies once all others are saved.
    Returns (arxiv_id, summary, source), source being cached or the provider.
    """
    row = _collection(store, name)
    papers = store.collection_papers(row["name"], limit).select("arxiv_id", "title", "abstract")
    known = store.read("paper_memory").select(F.col("paper_id").alias("arxiv_id"), F.col("summary").alias("_old"))
    run = store.create_pipeline_run("summarize", "collection", row["name"], papers.count())
    folder, deep, done, rejected = f"{store.root}/runs/summarize-{run}", pages is not None or fetcher is not None, 0, 0
    try:
        pending = papers if force else papers.join(known, "arxiv_id", "left_anti")
        if fetcher is not None:
            pages = fetcher.fetch(pending.select("arxiv_id")).where("html IS NOT NULL").select("arxiv_id", "html", "url")
        sections = None
        if pages is not None:
            read = save_pages(store, pages.join(pending.select("arxiv_id"), "arxiv_id", "left_semi"), f"summarize-{run}")
            sections = read.select(F.col("arxiv_id").alias("paper_id"), F.posexplode("sections").alias("idx", "s")).select("paper_id", "idx", "s.heading", "s.text")
        made = contexts(pending, budget, f"Collection: {row['name']}", sections)
        asked = made.withColumn("prompt", F.concat("prompt", F.lit(SUMMARY_SUFFIX)) if of.name == "ollama" else F.col("prompt"))
        asked.withColumn("names", F.array_join("names", ",")).write.parquet(f"{folder}/asked")
        asked = store.spark.read.parquet(f"{folder}/asked")
        total = asked.count()
        batches = 1 if of.name == Extractive.name else max(1, -(-total // batch))
        done = papers.count() - total
        for i in range(batches):
            mine = asked.where(F.pmod(F.xxhash64("arxiv_id"), F.lit(batches)) == i)
            generate(mine, "prompt", of, SUMMARY_SYSTEM, True, keep_errors=True).drop("prompt").write.parquet(f"{folder}/replies/{i}")  # once, read several times
            read = replies.parse(store.spark.read.parquet(f"{folder}/replies/{i}"), "reply")
            good = read.where("parsed IS NOT NULL")
            payload = F.to_json(F.struct(F.col("arxiv_id").alias("paper_id"), F.lit(row["name"]).alias("collection"), F.lit(deep).alias("deep"), F.col("used").alias("context_tokens_est"), F.split("names", ",").alias("blocks")))
            bad = read.where("parsed IS NULL").select("arxiv_id", "reply", "error")
            why = F.to_json(F.struct(F.col("arxiv_id").alias("paper_id"), F.coalesce("error", F.lit("the reply holds no JSON")).alias("error")))
            events = good.select(F.lit("paper.summarized").alias("event_type"), payload.alias("payload_json")).union(bad.select(F.lit("paper.rejected"), why))
            items = replies.evidence(good, "arxiv_id").withColumnRenamed("arxiv_id", "paper_id").drop("place")
            store.save_summaries(replies.memory(good, "arxiv_id").withColumnRenamed("arxiv_id", "paper_id"), items, events, f"{of.name}:{model}")
            wrong = bad.count()
            if wrong:
                bad.write.parquet(f"{folder}/rejected/{i}")
            rejected, done = rejected + wrong, done + mine.count() - wrong
            store.update_pipeline_run(run, done)
        if rejected:
            raise RejectedReplies(f"{rejected} of {total} replies hold no JSON; see {folder}/rejected")
        store.update_pipeline_run(run, done, "completed", {"llm": of.name, "deep": deep})
    except Exception as e:
        store.update_pipeline_run(run, done, "failed", {"error": str(e)[:1000], "rejected": rejected})
        raise
    fresh = store.read("paper_memory").select(F.col("paper_id").alias("arxiv_id"), "summary").join(asked.select("arxiv_id"), "arxiv_id", "left_semi")
    fresh = fresh.withColumn("source", F.lit(of.name))
    old = papers.join(known, "arxiv_id").join(asked.select("arxiv_id"), "arxiv_id", "left_anti").select("arxiv_id", F.col("_old").alias("summary"), F.lit("cached").alias("source"))
    return fresh.union(old)


def save_pages(store: Store, pages: DataFrame, name: str) -> DataFrame:
    """Keep pages (arxiv_id, html, and url if known) as artifacts: raw HTML, clean text and sections as JSON, a row per paper.

    The papers' paths name the columns, and the store's sections of these papers are replaced.
    """
    url = F.col("url") if "url" in pages.columns else F.lit("")
    read = pages.select("arxiv_id", F.col("html").alias("raw_html"), url.alias("html_url"), page_udf("html").alias("p"))
    path = f"{store.root}/artifacts/{name}"
    read.select("arxiv_id", "raw_html", "html_url", F.col("p.title").alias("title"), F.col("p.text").alias("clean_text"), "p.sections", F.to_json("p.sections").alias("sections_json")).write.parquet(path)
    kept = store.spark.read.parquet(path)
    folder = F.concat(F.lit(f"{path}#"), T.safe_id(F.col("arxiv_id")))
    paths = [F.concat(folder, F.lit(f"/{c}")).alias(p) for p, c in (("raw_path", "raw_html"), ("clean_path", "clean_text"), ("sections_path", "sections_json"))]
    store.update_artifacts(kept.select("arxiv_id", *paths, "html_url"))
    rows = kept.select(F.col("arxiv_id").alias("paper_id"), F.posexplode("sections").alias("idx", "s")).select("paper_id", "idx", "s.heading", "s.text", "s.level")
    store.replace_sections(kept.select(F.col("arxiv_id").alias("paper_id")), rows)
    return kept


def route_collection(store: Store, name: str | None = None) -> DataFrame:
    """Assign the collection's papers to cells; earlier assignments stay. Returns (arxiv_id, cell, score, rationale, place)."""
    row = _collection(store, name)
    papers = store.collection_papers(row["name"])
    routes = route(papers)
    store.assign(routes.drop("place"))
    store.log_event("collection.routed", {"collection": row["name"], "papers": papers.count()})
    return routes


def synthesize(store: Store, of: Provider, budget: int, name: str | None = None, goal: str = "") -> str:
    """A new version of the collection's synthesis."""
    row = _collection(store, name)
    links = store.read("collection_papers").where(F.col("collection_id") == row["id"])
    most = int((budget + 1) * 3.2)
    a = S.summaries(links, store.read("papers"), store.read("paper_memory"), most).first()
    b = S.evidence_texts(links, store.read("papers"), store.read("evidence"), most).first()
    before = store.get_synthesis("collection", row["name"])
    goal = goal or f"Synthesize the scientific picture represented by collection {row['name']}"
    text = lambda r: r["text"] if r else ""
    values = [(goal, text(a), text(b), before["synthesis"] if before else "")]
    one = store.spark.createDataFrame(values, "goal string, summaries string, evidence string, previous string")
    blocks = C.synthesis_blocks(F.col("goal"), F.col("summaries"), F.col("evidence"), F.col("previous"))
    fits = F.filter(blocks, lambda k: ~((k["name"] == "PAPER_SUMMARIES") & F.col("summaries").isNull() | (k["name"] == "EVIDENCE") & F.col("evidence").isNull()))
    packed = one.select(C.pack(fits, budget).alias("f")).select(F.concat("f.text", F.lit(SYNTHESIS_SUFFIX)).alias("prompt"), "f.used")
    out = generate(packed, "prompt", of, SYNTHESIS_SYSTEM).select(T.strip(F.col("reply")).alias("reply"), "used").first()
    count = b["n"] if b else 0
    store.save_synthesis("collection", row["name"], out["reply"], count)
    store.log_event("synthesis.updated", {"collection": row["name"], "evidence_count": count, "context_tokens_est": out["used"]})
    return out["reply"]


def find(store: Store, question: str, collection: str | None = None, cell: str | None = None, limit: int = 8) -> DataFrame:
    """Retrieval in the given scopes, the whole store without any."""
    papers = store.read("papers")
    if collection:
        papers = R.in_collection(papers, store.read("collection_papers"), store.read("collections"), collection)
    if cell:
        papers = R.in_cell(papers, store.read("domain_assignments"), store.read("research_cells"), cell)
    return R.search(R.scored(papers, store.read("paper_memory"), store.read("evidence"), R.question_terms(question)), limit)


def answer(store: Store, of: Provider, question: str, collection: str | None = None, cell: str | None = None, limit: int = 8) -> str | None:
    """The provider's answer over the records found; None where there are none."""
    found = find(store, question, collection, cell, limit).cache()  # at most `limit` rows
    try:
        if found.isEmpty():
            return None
        asked = R.prompt(found, store.read("evidence"), question)
        return generate(asked, "prompt", of, ANSWER_SYSTEM).first()["reply"]
    finally:
        found.unpersist()

