"""Tables of the store. Lists are native arrays, times are ISO strings in UTC; JSON exists at the edges only."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Columns of the store's tables in their order.
DDL = {
    "research_runs": "id long, query string, source string, date_from string, date_to string, status string, created_at string, completed_at string, collection_id long",
    "collections": "id long, name string, description string, created_at string, active int",
    "papers": "arxiv_id string, title string, authors array<string>, abstract string, published string, updated string, categories array<string>, "
    "abs_url string, pdf_url string, html_url string, raw_path string, clean_path string, sections_path string, created_at string, updated_at string",
    "collection_papers": "collection_id long, paper_id string, rank int, added_at string",
    "paper_memory": "paper_id string, summary string, research_question string, method string, datasets array<string>, baselines array<string>, "
    "main_results array<string>, limitations array<string>, relevance double, model string, updated_at string",
    "evidence": "id long, paper_id string, claim string, evidence_type string, result string, section string, quote string, confidence double, tags array<string>, created_at string",
    "sections": "paper_id string, idx int, heading string, text string, level int",
    "synthesis_memory": "scope_type string, scope_id string, synthesis string, evidence_count long, version long, updated_at string",
    "research_cells": "id long, name string, parent_id long, description string, status string, created_at string",
    "domain_assignments": "paper_id string, cell_id long, score double, rationale string, created_at string",
    "pipeline_runs": "id long, pipeline string, scope_type string, scope_id string, status string, progress_done long, progress_total long, "
    "details_json string, created_at string, updated_at string",
    "session_state": "key string, value string, updated_at string",
    "event_log": "id long, event_type string, payload_json string, created_at string",
}

KEYS = {
    "research_runs": ["id"],
    "collections": ["id"],
    "papers": ["arxiv_id"],
    "collection_papers": ["collection_id", "paper_id"],
    "paper_memory": ["paper_id"],
    "evidence": ["id"],
    "sections": ["paper_id", "idx"],
    "synthesis_memory": ["scope_type", "scope_id"],
    "research_cells": ["id"],
    "domain_assignments": ["paper_id", "cell_id"],
    "pipeline_runs": ["id"],
    "session_state": ["key"],
    "event_log": ["id"],
}

#: Child table and column, parent table and column: links that must hold before a write.
REFERENCES = (
    ("collection_papers", "collection_id", "collections", "id"),
    ("collection_papers", "paper_id", "papers", "arxiv_id"),
    ("paper_memory", "paper_id", "papers", "arxiv_id"),
    ("evidence", "paper_id", "papers", "arxiv_id"),
    ("domain_assignments", "paper_id", "papers", "arxiv_id"),
    ("domain_assignments", "cell_id", "research_cells", "id"),
    ("research_cells", "parent_id", "research_cells", "id"),
)


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])
