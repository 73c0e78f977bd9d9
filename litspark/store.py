"""The store: Parquet segments of all tables under one manifest.

A table is a base, with one row per key, and the changes since: each commit adds a segment of the rows that it
writes and the keys that it removes, so its cost follows the change and not the table. Readers put the changes
in place of the base's rows. Changes are merged as they grow in number, and with the base once they reach a
share of it, so that each row is rewritten a logarithmic number of times.

A commit is made against the snapshot that its changes were computed from. The next manifest is created by an
operation that fails if it exists; a writer that comes second gets Conflict, or computes its change again. Ids
lie above the snapshot's high-water mark, which the manifest keeps, and are therefore never used twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litspark.operators import catalog, merging
from litspark.operators.merging import inserted, latest, orphans, updated, upserted
from litspark.schema import DDL, KEYS, REFERENCES, schema

#: Changes of a table are merged into one above this number, and with its base from this share of its rows on.
SEGMENTS, SHARE = 8, 0.25
#: How often a change is computed again when another writer was faster.
TRIES = 5


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Conflict(RuntimeError):
    """Another writer committed first."""


class Orphans(ValueError):
    """Rows refer to no parent."""


@dataclass
class Change:
    """Rows to put in place of those of the same key, and keys of rows to remove; of a key in both, the row stays."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Snapshot:
    """All tables as of one manifest."""

    def __init__(self, store: Store, version: int, manifest: dict) -> None:
        self.store, self.version, self.manifest = store, version, manifest

    def segments(self, table: str) -> dict:
        return self.manifest["tables"].get(table, {"base": [], "changes": []})

    def mark(self, table: str) -> int:
        return self.manifest["marks"].get(table, 0)

    def _load(self, table: str, parts: list[dict], kind: StructType) -> DataFrame:
        spark = self.store.spark
        paths = [f"{self.store.root}/{p['path']}" for p in parts]
        return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)

    def changes(self, table: str) -> DataFrame:
        """The last change of each key, with the columns _gone and _at."""
        kind = StructType(schema(table).fields).add("_gone", "boolean").add("_at", "long")
        return latest(self._load(table, self.segments(table)["changes"], kind), KEYS[table], "_at", F.col("_gone").asc())

    def read(self, table: str) -> DataFrame:
        base = self._load(table, self.segments(table)["base"], schema(table))
        if not self.segments(table)["changes"]:
            return base
        last = self.changes(table)
        return base.join(last.select(*KEYS[table]), KEYS[table], "left_anti").select(*base.columns).unionByName(last.where("NOT _gone").select(*base.columns))

    def new_ids(self, table: str, df: DataFrame) -> DataFrame:
        """Add an id above the table's mark to each row; ids rise in the order of the rows, with gaps."""
        return df.withColumn("id", F.monotonically_increasing_id() + F.lit(self.mark(table) + 1))

    def checked(self, table: str, df: DataFrame) -> DataFrame:
        """The rows, if all of their references hold."""
        for child, column, parent, key in REFERENCES:
            if child == table and column in df.columns and not orphans(df, column, self.read(parent), key).isEmpty():
                raise Orphans(f"{table}.{column} refers to rows that {parent} doesn't have")
        return df


class Store:
    def __init__(self, spark: SparkSession, root: str, now: Callable[[], str] = utc_now) -> None:
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Snapshots and manifests.

    def init(self) -> Store:
        """Make an empty store; an existing one stays as it is."""
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        if self._version() == 0:
            try:
                self._write_manifest(1, {"tables": {}, "marks": {}})
            except Conflict:
                pass  # another one made it meanwhile
        return self

    def _version(self) -> int:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def _manifest(self) -> tuple[int, dict]:
        at = self._version()
        if not at:
            raise FileNotFoundError(f"no store in {self.root}")
        stream = self._fs.open(self._path(f"{self.root}/manifests/{at:012d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return at, json.loads(text)

    def _put(self, path, content: dict) -> None:  # noqa: ANN001
        out = self._fs.create(path, False)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()

    def _write_manifest(self, version: int, content: dict) -> None:
        """Create a manifest, whole or not at all; fails if there is one of this version.

        Local disks link a finished file to the name, name nodes rename it: neither replaces a file. Object
        stores show a file only when it is closed, and refuse to create one that exists.
        """
        final = self._path(f"{self.root}/manifests/{version:012d}.json")
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        kind = self._fs.getScheme()
        try:
            if kind not in ("file", "hdfs", "viewfs"):
                self._put(final, content)
                return
            self._put(draft, content)
            if kind == "file":
                local = lambda p: unquote(urlparse(self._fs.makeQualified(p).toUri().toString()).path)
                os.link(local(draft), local(final))
            elif not self._fs.rename(draft, final):
                raise FileExistsError
        except Exception as e:
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e) or self._fs.exists(final):
                raise Conflict(f"manifest {version} exists already") from e
            raise
        finally:
            self._fs.delete(draft, False)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, *self._manifest())

    def read(self, table: str) -> DataFrame:
        return self.snapshot().read(table)

    def _write(self, table: str, df: DataFrame) -> dict:
        """A new segment: where it is, its number of rows, and its largest id if the table has ids."""
        path = f"tables/{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        top = F.max("id") if DDL[table].startswith("id long") else F.lit(None)
        rows, top = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}").agg(F.count("*"), top).first()
        return {"path": path, "rows": rows, "top": top}

    def commit(self, base: Snapshot, changes: dict[str, Change]) -> int:
        """Make changes, which were computed from the snapshot, current together; the new version.

        Raises Conflict if another commit was made since the snapshot: nothing is changed then.
        """
        m, at = json.loads(json.dumps(base.manifest)), base.version + 1
        for table, change in changes.items():
            names = [f.name for f in schema(table)]
            held = m["tables"].setdefault(table, {"base": [], "changes": []})
            parts = []
            if change.rows is not None:
                typed = change.rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table)])
                parts.append(typed.withColumn("_gone", F.lit(False)))
            if change.gone is not None:
                keys = {f.name: F.col(f.name) if f.name in KEYS[table] else F.lit(None) for f in schema(table)}
                parts.append(change.gone.select(*[keys[f.name].cast(f.dataType).alias(f.name) for f in schema(table)]).withColumn("_gone", F.lit(True)))
            if not parts:
                continue
            if not held["base"] and not held["changes"] and change.gone is None:
                piece = self._write(table, parts[0].select(*names))
                held["base"] = [piece]
            else:
                piece = self._write(table, (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).withColumn("_at", F.lit(at).cast("long")))
                held["changes"].append(piece)
            m["marks"][table] = max(m["marks"].get(table, 0), piece["top"] or 0)
        if self._version() != base.version:
            raise Conflict(f"the store is at another version than {base.version}")
        self._write_manifest(at, m)
        for table in changes:
            if len(m["tables"][table]["changes"]) > SEGMENTS:
                self.compact(table)
        return at

    def change(self, make: Callable[[Snapshot], dict[str, Change]]) -> Snapshot:
        """Commit what `make` computes from the current snapshot, again from a newer one if another writer was faster; the new snapshot."""
        for left in reversed(range(TRIES)):
            base = self.snapshot()
            try:
                self.commit(base, make(base))
                return self.snapshot()
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def compact(self, table: str, most: int = SEGMENTS, share: float = SHARE) -> bool:
        """Merge a table's changes if there are more than `most`; whether they were. A faster writer's commit takes precedence."""
        base = self.snapshot()
        held = base.segments(table)
        if len(held["changes"]) <= most:
            return False
        old, new = (sum(p["rows"] for p in held[k]) for k in ("base", "changes"))
        m = json.loads(json.dumps(base.manifest))
        if new >= share * old:
            m["tables"][table] = {"base": [self._write(table, base.read(table))], "changes": []}
        else:
            m["tables"][table]["changes"] = [self._write(table, base.changes(table))]
        try:
            self._write_manifest(base.version + 1, m)
        except Conflict:
            return False
        return True

    def vacuum(self) -> int:
        """Delete the segments and manifests that the current manifest doesn't name; their number. No other reader or writer may be at work."""
        version, m = self._manifest()
        used = {p["path"].rsplit("/", 1)[1] for t in m["tables"].values() for k in ("base", "changes") for p in t[k]}
        old = [f for f in self._fs.listStatus(self._path(f"{self.root}/manifests")) if f.getPath().getName() != f"{version:012d}.json"]
        for table in m["tables"]:
            old += [f for f in self._fs.listStatus(self._path(f"{self.root}/tables/{table}")) if f.getPath().getName() not in used]
        for f in old:
            self._fs.delete(f.getPath(), True)
        return len(old)

    def rows(self, table: str, *values: tuple) -> DataFrame:
        names = [f.name for f in schema(table)]
        return self.spark.createDataFrame(list(values), schema(table)) if values else self.spark.createDataFrame([], schema(table)).select(*names)

    def _stamped(self, df: DataFrame, *columns: str) -> DataFrame:
        now = self.now()
        return df.withColumns({c: F.lit(now) for c in columns})

    def _filled(self, table: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table)])

    def _upsert(self, table: str, new: Callable[[Snapshot], DataFrame], keep: Sequence[str] = ()) -> None:
        """Put rows in place of those of their keys; of several of one key the last is taken."""
        self.change(lambda at: {table: Change(upserted(at.read(table), at.checked(table, new(at)), KEYS[table], keep))})

    # Collections.

    def create_collection(self, name: str, description: str = "", active: bool = True) -> int:
        """The collection's id; an existing one keeps its description, and becomes the active one if wanted."""

        def make(at: Snapshot) -> dict[str, Change]:
            old = at.read("collections")
            fresh = at.new_ids("collections", self.spark.createDataFrame([(name, description)], "name string, description string").coalesce(1))
            fresh = inserted(old, self._stamped(fresh, "created_at").withColumn("active", F.lit(int(active))), ["name"])
            if active:
                both = old.withColumn("_was", F.col("active")).unionByName(fresh.withColumn("_was", F.lit(None).cast("int")))
                fresh = merging.activate(both, name).where("_was IS NULL OR _was <> active").drop("_was")
            return {"collections": Change(fresh)}

        return catalog.collection(self.change(make).read("collections"), name).first()["id"]

    def get_collection(self, name: str | None = None) -> Row | None:
        """By name; without one, the newest active collection."""
        return catalog.collection(self.read("collections"), name).first()

    def list_collections(self) -> DataFrame:
        at = self.snapshot()
        return catalog.list_collections(at.read("collections"), at.read("collection_papers"))

    def collection_papers(self, name: str | None = None, limit: int | None = None) -> DataFrame:
        at = self.snapshot()
        return catalog.collection_papers(at.read("papers"), at.read("collection_papers"), at.read("collections"), name, limit)

    def attach(self, collection_id: int, ranked: DataFrame) -> None:
        """Put papers (arxiv_id, rank) into a collection; those that are in it get the new rank."""
        new = ranked.select(F.lit(collection_id).cast("long").alias("collection_id"), F.col("arxiv_id").alias("paper_id"), F.col("rank").cast("int"))
        new = latest(self._stamped(new, "added_at"), KEYS["collection_papers"], "rank")
        self._upsert("collection_papers", lambda at: new)

    # Papers.

    def upsert_papers(self, papers: DataFrame) -> None:
        """New metadata in place of the old; the time of creation and artifact paths of known papers stay."""
        new = self._filled("papers", self._stamped(latest(papers, ["arxiv_id"], "updated"), "created_at", "updated_at"))
        self._upsert("papers", lambda at: new, ("created_at", "raw_path", "clean_path", "sections_path"))

    def paper(self, arxiv_id: str) -> Row | None:
        return self.read("papers").where(F.col("arxiv_id") == arxiv_id).first()

    def update_artifacts(self, changes: DataFrame) -> None:
        """Paths (arxiv_id, raw_path, clean_path, sections_path, html_url); an empty html_url leaves the old one."""
        c = F.col
        values: dict[str, Column] = {p: c(f"c.{p}") for p in ("raw_path", "clean_path", "sections_path")}
        values["html_url"] = F.when(F.coalesce("c.html_url", F.lit("")) != "", c("c.html_url")).otherwise(c("o.html_url"))
        values["updated_at"] = F.lit(self.now())
        few = latest(changes, ["arxiv_id"])
        self.change(lambda at: {"papers": Change(updated(at.read("papers"), few, ["arxiv_id"], values))})

    # Memory, evidence and sections.

    def _memory_rows(self, memory: DataFrame, model: str) -> DataFrame:
        new = self._filled("paper_memory", self._stamped(memory, "updated_at").withColumn("model", F.lit(model)))
        return latest(new.withColumn("relevance", F.coalesce("relevance", F.lit(0.0))), KEYS["paper_memory"])

    def _evidence_rows(self, at: Snapshot, items: DataFrame) -> DataFrame:
        return at.checked("evidence", self._filled("evidence", self._stamped(at.new_ids("evidence", items.drop("id")), "created_at")))

    def save_memory(self, memory: DataFrame, model: str = "") -> None:
        """Memory (paper_id, summary, ...) in place of what the papers had; of several rows of a paper one is kept."""
        new = self._memory_rows(memory, model)
        self._upsert("paper_memory", lambda at: new)

    def memory(self, paper_id: str) -> Row | None:
        return self.read("paper_memory").where(F.col("paper_id") == paper_id).first()

    def add_evidence(self, items: DataFrame) -> None:
        self.change(lambda at: {"evidence": Change(self._evidence_rows(at, items))})

    def _replaced(self, at: Snapshot, table: str, papers: DataFrame, new: DataFrame) -> Change:
        return Change(new, at.read(table).join(papers.select("paper_id"), "paper_id", "left_semi").select(*KEYS[table]))

    def replace_evidence(self, papers: DataFrame, items: DataFrame) -> None:
        """The evidence of these papers (paper_id) becomes these items; a paper without any is cleared."""
        self.change(lambda at: {"evidence": self._replaced(at, "evidence", papers, self._evidence_rows(at, items))})

    def replace_sections(self, papers: DataFrame, rows: DataFrame) -> None:
        """The sections of these papers (paper_id) become these rows."""
        self.change(lambda at: {"sections": self._replaced(at, "sections", papers, latest(rows, KEYS["sections"]))})

    def save_summaries(self, memory: DataFrame, items: DataFrame, events: DataFrame, model: str = "") -> None:
        """Memory of papers, their evidence in place of what they had, and events (event_type, payload_json), in one commit."""
        new = self._memory_rows(memory, model)
        self.change(lambda at: {
            "paper_memory": Change(at.checked("paper_memory", new)),
            "evidence": self._replaced(at, "evidence", memory.select("paper_id").distinct(), self._evidence_rows(at, items)),
            "event_log": Change(at.new_ids("event_log", self._stamped(events, "created_at"))),
        })

    def evidence_for_collection(self, name: str) -> DataFrame:
        r = self.snapshot().read
        return catalog.evidence_for_collection(r("evidence"), r("papers"), r("collection_papers"), r("collections"), name)

    # Syntheses, session, events, runs.

    def save_synthesis(self, scope_type: str, scope_id: str, text: str, evidence_count: int) -> int:
        """The version that the text got: one more than the scope's last."""
        mine = (F.col("scope_type") == scope_type) & (F.col("scope_id") == scope_id)

        def make(at: Snapshot) -> dict[str, Change]:
            old = at.read("synthesis_memory").where(mine).first()
            return {"synthesis_memory": Change(self.rows("synthesis_memory", (scope_type, scope_id, text, evidence_count, old["version"] + 1 if old else 1, self.now())))}

        return self.change(make).read("synthesis_memory").where(mine).first()["version"]

    def save_syntheses(self, rows: DataFrame) -> None:
        """Many saves at once (scope_type, scope_id, synthesis, evidence_count, order): each raises its scope's version, the last text stays."""
        key = KEYS["synthesis_memory"]
        last = rows.groupBy(*key).agg(F.max_by(F.struct("synthesis", "evidence_count"), "order").alias("x"), F.count("*").alias("n"))

        def make(at: Snapshot) -> dict[str, Change]:
            old = at.read("synthesis_memory").join(last.select(*key), key, "left_semi").select(*key, F.col("version").alias("before"))
            new = last.join(old, key, "left").select(*key, "x.synthesis", "x.evidence_count", (F.coalesce("before", F.lit(0)) + F.col("n")).alias("version"))
            return {"synthesis_memory": Change(self._stamped(new, "updated_at"))}

        self.change(make)

    def get_synthesis(self, scope_type: str, scope_id: str) -> Row | None:
        return self.read("synthesis_memory").where((F.col("scope_type") == scope_type) & (F.col("scope_id") == scope_id)).first()

    def set_session(self, key: str, value: str) -> None:
        self._upsert("session_state", lambda at: self.rows("session_state", (key, value, self.now())))

    def set_sessions(self, rows: DataFrame) -> None:
        """Many writes at once (key, value, order): the last of each key stays."""
        last = self._stamped(latest(rows, ["key"], "order").select("key", "value"), "updated_at")
        self._upsert("session_state", lambda at: last)

    def get_session(self, key: str, default: str = "") -> str:
        row = self.read("session_state").where(F.col("key") == key).first()
        return row["value"] if row else default

    def log_event(self, kind: str, payload: dict) -> None:
        row = self.spark.createDataFrame([(kind, json.dumps(payload, ensure_ascii=False))], "event_type string, payload_json string")
        self.log_events(row.coalesce(1))

    def log_events(self, events: DataFrame) -> None:
        """Events (event_type, payload_json) of many rows at once."""
        self.change(lambda at: {"event_log": Change(at.new_ids("event_log", self._stamped(events, "created_at")))})

    def _append(self, table: str, values: dict) -> int:
        """The id of the new row: of a single row in a single partition it is the next one."""
        types = {f.name: f.dataType.simpleString() for f in schema(table)}
        row = self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[k]}" for k in values)).coalesce(1)
        given: list[int] = []

        def make(at: Snapshot) -> dict[str, Change]:
            given.append(at.mark(table) + 1)
            return {table: Change(self._filled(table, row.withColumn("id", F.lit(given[-1]).cast("long"))))}

        self.change(make)
        return given[-1]

    def _change(self, table: str, number: int, values: dict) -> None:
        few = self.spark.createDataFrame([(number,)], "id long")
        self.change(lambda at: {table: Change(updated(at.read(table), few, ["id"], {k: F.lit(v) for k, v in values.items()}))})

    def start_research_run(self, query: str, source: str, date_from: str | None, date_to: str | None) -> int:
        return self._append("research_runs", {"query": query, "source": source, "date_from": date_from, "date_to": date_to, "status": "running", "created_at": self.now()})

    def finish_research_run(self, run: int, collection_id: int, status: str = "completed") -> None:
        self._change("research_runs", run, {"status": status, "completed_at": self.now(), "collection_id": collection_id})

    def create_pipeline_run(self, pipeline: str, scope_type: str, scope_id: str, total: int = 0) -> int:
        now = self.now()
        return self._append("pipeline_runs", {
            "pipeline": pipeline, "scope_type": scope_type, "scope_id": scope_id, "status": "running",
            "progress_done": 0, "progress_total": total, "details_json": "{}", "created_at": now, "updated_at": now,
        })

    def create_pipeline_runs(self, runs: DataFrame) -> None:
        """Many runs at once (pipeline, scope_type, scope_id, progress_total), all running."""
        new = self._stamped(runs, "created_at", "updated_at").withColumns({"status": F.lit("running"), "progress_done": F.lit(0).cast("long"), "details_json": F.lit("{}")})
        self.change(lambda at: {"pipeline_runs": Change(self._filled("pipeline_runs", at.new_ids("pipeline_runs", new)))})

    def update_pipeline_run(self, run: int, done: int, status: str | None = None, details: dict | None = None) -> None:
        """Without a status the old one stays; without details they become empty."""
        values = {"progress_done": done, "details_json": json.dumps(details or {}, ensure_ascii=False), "updated_at": self.now()}
        self._change("pipeline_runs", run, values | ({"status": status} if status is not None else {}))

    def update_pipeline_runs(self, updates: DataFrame) -> None:
        """Many updates at once (id, progress_done, status, order), applied in their order; a null status keeps the one before."""
        given = F.max_by("status", F.when(F.col("status").isNotNull(), F.col("order")))
        last = updates.groupBy("id").agg(F.max_by("progress_done", "order").alias("done"), given.alias("status"))
        values = {"progress_done": F.col("c.done"), "status": F.coalesce("c.status", "o.status"), "details_json": F.lit("{}"), "updated_at": F.lit(self.now())}
        self.change(lambda at: {"pipeline_runs": Change(updated(at.read("pipeline_runs"), last, ["id"], values))})

    # Cells.

    def create_cell(self, name: str, description: str = "", parent: str | None = None) -> Row:
        """The cell; an existing one keeps its parent. An unknown parent raises ValueError."""
        self.create_cells([name], description, parent)
        return self.read("research_cells").where(F.col("name") == name).first()

    def create_cells(self, names: Sequence[str], description: str = "", parent: str | None = None) -> None:
        def make(at: Snapshot) -> dict[str, Change]:
            old, parent_id = at.read("research_cells"), None
            if parent:
                row = old.where(F.col("name") == parent).first()
                if row is None:
                    raise ValueError(f"unknown parent cell: {parent}")
                parent_id = row["id"]
            new = at.new_ids("research_cells", self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string").coalesce(1))
            new = self._stamped(new, "created_at").select(
                "id", "name", F.lit(parent_id).cast("long").alias("parent_id"), F.lit(description).alias("description"), F.lit("active").alias("status"), "created_at"
            )
            return {"research_cells": Change(inserted(old, new, ["name"]))}

        self.change(make)

    def split_cell(self, parent: str, children: Sequence[str]) -> None:
        self.create_cells([parent])
        self.create_cells(children, parent=parent)

    def list_cells(self) -> DataFrame:
        at = self.snapshot()
        return catalog.list_cells(at.read("research_cells"), at.read("domain_assignments"))

    def assign(self, routes: DataFrame) -> None:
        """Assignments (arxiv_id, cell, score, rationale); missing cells are created, repeated ones replaced."""
        known = self.read("research_cells").select(F.col("name").alias("cell"))
        missing = [r["cell"] for r in routes.select("cell").distinct().join(known, "cell", "left_anti").orderBy("cell").collect()]
        if missing:  # names of cells, as many as there are domains
            self.create_cells(missing)

        def rows(at: Snapshot) -> DataFrame:
            ids = at.read("research_cells").select(F.col("id").alias("cell_id"), F.col("name").alias("cell"))
            new = self._stamped(routes.join(ids, "cell"), "created_at").select(
                F.col("arxiv_id").alias("paper_id"), "cell_id", "score", "rationale", "created_at"
            )
            return latest(new, KEYS["domain_assignments"])

        self._upsert("domain_assignments", rows)
