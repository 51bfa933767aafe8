"""Everything that a project holds, read once, and the pipelines over it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cached_property, reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekit.functions import code as C
from lorekit.functions import diff, markdown, providers
from lorekit.functions import text as X
from lorekit.operators import drift, graph, locale, search, stats
from lorekit.sources import config as cfg
from lorekit.sources import lock as locks
from lorekit.sources import pages as P
from lorekit.sources import specs, tree


@dataclass
class Project:
    """A documentation project at a root directory."""

    spark: SparkSession
    root: Path
    config: cfg.Config = field(default_factory=cfg.Config)
    embedder: search.Embedder | None = None
    reranker: search.Reranker | None = None

    def __post_init__(self) -> None:
        self.root = Path(self.root)

    def at(self, relative: str) -> Path:
        return self.root / relative

    @cached_property
    def docs(self) -> str:
        return str(self.at(self.config.docs_content))

    @cached_property
    def operations(self) -> DataFrame:
        return specs.operations(specs.text_frame(self.spark, str(self.at(self.config.openapi))))

    @cached_property
    def public(self) -> DataFrame:
        return specs.public_operations(self.operations, specs.allowlist(specs.text_frame(self.spark, str(self.at(self.config.expected_public_operations)))))

    @cached_property
    def pages(self) -> DataFrame:
        return markdown.with_blocks(P.read_pages(self.spark, self.docs))

    @cached_property
    def slugs(self) -> DataFrame:
        return P.valid_slugs(self.pages, tree.read_tree(self.spark, self.docs).where("is_dir"))

    @cached_property
    def methods(self) -> DataFrame | None:
        path = self.at(self.config.sdk_manifest)
        return specs.sdk_methods(specs.text_frame(self.spark, str(path)), self.config.sdk_prefix) if path.is_file() else None

    @cached_property
    def competitors(self) -> DataFrame:
        return tree.competitors(self.spark, str(self.at(self.config.competitors)))

    @cached_property
    def segments(self) -> DataFrame:
        return markdown.segments(self.sources.join(self.pages, "relative_path", "left_semi"))

    @cached_property
    def sources(self) -> DataFrame:
        return P.source_pages(self.pages, self.config.docs_content, self.config.i18n.mdx.include, self.config.i18n.mdx.exclude)

    def lock(self) -> tuple[DataFrame, bool]:
        return locks.read_lock(self.spark, self.at(self.config.i18n.lock_cache))

    @cached_property
    def code(self) -> Code:
        files = tree.scan_sources(self.spark, [r for r in self.config.code_root_paths(self.root) if Path(r).is_dir()])
        return Code(files)

    @cached_property
    def vectors(self) -> DataFrame | None:
        """Embeddings of the code elements where an embedder is set, computed once."""
        return search.populate_vectors(self.code.elements, self.embedder).cache() if self.embedder else None

    def search_context(self, queries: list[str], limit: int) -> str:
        """Code context of a query list: keyword and vector score, the best of them reranked where a reranker is set."""
        return search.context(self.code.elements, queries, limit, self.vectors, self.embedder, self.reranker)

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.knowledge_nodes(self.operations, self.pages, self.methods)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.knowledge_edges(self.pages, self.nodes)


class Code:
    """Elements, imports, calls and graphs of source files; the files are parsed once for all of them."""

    def __init__(self, files: DataFrame):
        self.files = files
        self.parsed = C.parse_files(files).cache()
        elements = C.elements(self.parsed)
        # Overloads share an id; the last one stands for all.
        once = Window.partitionBy("id").orderBy(F.desc("start_line"), F.desc("end_line"))
        self.elements = elements.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
        self.imports, self.calls = C.imports(self.parsed), C.calls(self.parsed)

    @cached_property
    def edges(self) -> DataFrame:
        parts = [graph.dependency_edges(self.imports, self.elements), graph.inheritance_edges(self.elements), graph.call_edges(self.calls, self.imports, self.elements)]
        return reduce(DataFrame.unionByName, parts)

    def stats(self) -> DataFrame:
        return stats.scan_totals(self.files, self.parsed, self.elements, graph.graph_stats(self.elements, self.edges))


def drift_report(project: Project, script: str | None = None) -> DataFrame:
    """All drift issues in order; with those of an external script's output where it is given."""
    found = drift.report(project.public, project.pages, project.slugs, project.methods, prefix=project.config.sdk_prefix)
    if script is None:
        return found
    external = drift.script_errors(project.spark.createDataFrame([(script,)], "output string"))
    return found.unionByName(drift.numbered([external], first=EXTERNAL))


#: Numbers of the parts of a report that follow those of the drift report.
EXTERNAL, LOCALES = 100, 200


def sync_locales(project: Project, scaffold: bool = False, refresh_lock: bool = False, check_only: bool = False) -> dict:
    """Locale issues; with stubs written for missing pages and the lock renewed where asked for and not only checking."""
    old, exists = project.lock()
    targets = project.config.i18n.targets
    issues = drift.numbered(locale.sync_issues(project.pages, project.segments, old, exists, targets, project.sources), first=LOCALES).cache()
    written: list[str] = []
    if scaffold and not check_only:
        missing = locale.pairs(project.sources, project.pages, targets).where("NOT present").join(project.pages.select("relative_path", "frontmatter", "blocks"), "relative_path")
        written = write_files(markdown.with_stub(missing.drop("relative_path").withColumnRenamed("target_path", "relative_path")), "stub", project.docs)
    if refresh_lock and not check_only:
        locks.write_lock(project.segments, project.at(project.config.i18n.lock_cache))
    return {"issues": issues, "next_steps": [r["step"] for r in drift.locale_next_steps(issues).collect()], "scaffolded": sorted(written), "lock_updated": refresh_lock and not check_only}


def _write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def write_files(df: DataFrame, text: str, root: str) -> list[str]:
    """Write each row's text to (root, relative_path), by the tasks that hold the rows; the paths written, in order.

    The root has to be a folder that all executors see. A row is written whole under another name and then renamed, so a
    task that is run again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = Path(root) / path
                part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
                _write(part, value)
                part.replace(target)
            yield b.select([0])

    done = df.select("relative_path", text).mapInArrow(run, "relative_path string")
    return [r[0] for r in done.orderBy("relative_path").collect()]


def translate_locales(project: Project, model: providers.Provider | None = None, force: bool = False, check_only: bool = False, dry_run: bool = False, refresh_lock: bool = True) -> dict:
    """Translate new and changed segments page by page; pages (relative_path, target_path, segments, written)."""
    old, exists = project.lock()
    todo = locale.pending(project.segments, old, project.config.i18n.targets, force).cache()
    counts = locale.pending_counts(todo).withColumn("target_path", X.sibling(F.col("relative_path"), F.col("target")))
    plan = counts.orderBy("relative_path", "target").collect()
    writes = not (check_only or dry_run)
    if writes and plan:
        done = providers.translate_segments(todo, model or providers.provider(project.config.llm), project.config.i18n.source)
        updates = done.groupBy("relative_path", "target").agg(F.map_from_entries(F.collect_list(F.struct("seg_key", "translated"))).alias("updates"))
        own = project.pages.select("relative_path", "frontmatter", "blocks")
        sibling = project.pages.select(F.col("relative_path").alias("target_path"), F.col("frontmatter").alias("t_meta"), F.col("blocks").alias("t_blocks"))
        rows = updates.join(own, "relative_path").withColumn("target_path", X.sibling(F.col("relative_path"), F.col("target"))).join(sibling, "target_path", "left")
        write_files(markdown.with_updates(rows).select(F.col("target_path").alias("relative_path"), "page"), "page", project.docs)
        if refresh_lock:
            locks.write_lock(project.segments, project.at(project.config.i18n.lock_cache))
    return {
        "pages": [(r["relative_path"], r["target_path"], r["segments"], writes) for r in plan],
        "pending_segments": sum(r["segments"] for r in plan),
        "lock_exists": exists,
        "provenance": cfg.git_provenance(project.root),
        "lock_updated": writes and bool(plan) and refresh_lock,
    }


def snapshot_tables(project: Project, folder: str) -> dict[str, str]:
    """Write the entities of a scan as tables below a folder, by the executors; the path of each."""
    tables = {
        "elements": project.code.elements,
        "operations": project.operations,
        "pages": project.pages.drop("blocks"),
        "segments": project.segments,
        "slugs": project.slugs,
        "sdk_methods": project.methods,
        "competitors": project.competitors,
        "nodes": project.nodes,
        "edges": project.edges.select("from", "to", "relation"),
        "drift_issues": drift_report(project),
    }
    out = {}
    for name, df in tables.items():
        if df is not None:
            out[name] = f"{folder.rstrip('/')}/{name}.parquet"
            df.write.mode("overwrite").parquet(out[name])
    return out


def snapshot(project: Project) -> dict:
    """Counts and entities of a scan, as plain values for a JSON file: an export for people and tools, through the driver.

    ``snapshot_tables`` writes a scan of any size.
    """
    rows = lambda df: [json.loads(x) for x in df.toJSON().toLocalIterator()]
    return {
        "scanned_at": datetime.now(UTC).isoformat(),
        "root": str(project.root),
        "code_element_count": project.code.elements.count(),
        "code_stats": rows(project.code.stats()),
        "operations": rows(project.operations.orderBy("path", "method")),
        "pages": rows(project.pages.drop("raw", "body", "blocks", "frontmatter").orderBy("relative_path")),
        "valid_slugs": sorted(r[0] for r in project.slugs.collect()),
        "sdk_methods": rows(project.methods.orderBy("qualified")) if project.methods is not None else None,
        "competitors": rows(project.competitors.orderBy("relative_path")),
        "graph": {"nodes": rows(project.nodes), "edges": rows(project.edges.select("from", "to", "relation"))},
        "drift_issues": rows(drift_report(project).orderBy("seq")),
    }


def save_snapshot(project: Project, values: dict) -> None:
    for relative, value in ((project.config.index_cache, values), (project.config.graph_cache, values["graph"])):
        _write(project.at(relative), json.dumps(value, indent=2, ensure_ascii=False))


def load_snapshot(project: Project) -> dict:
    return json.loads(project.at(project.config.index_cache).read_text(encoding="utf-8"))


def drift_from_snapshot(spark: SparkSession, values: dict) -> DataFrame:
    rows = [(i["category"], i["message"], i.get("file"), (i["seq"]["part"], i["seq"].get("file"), i["seq"]["message"])) for i in values["drift_issues"]]
    return spark.createDataFrame(rows, "category string, message string, file string, seq struct<part:int,file:string,message:string>")


def graph_export(project: Project) -> dict:
    """The saved graph, else a fresh one."""
    path = project.at(project.config.graph_cache)
    if path.is_file():
        return json.loads(path.read_text(encoding="utf-8"))
    return snapshot(project)["graph"]


def page_query_rows(page_rows: DataFrame) -> DataFrame:
    """(relative_path, query) of pages: their operation, title, and path segments of more than three bytes."""
    meta = lambda k: F.element_at("frontmatter", k)
    method, path = F.upper(meta("method")), meta("path")
    parts = F.filter(F.split("relative_path", "/"), lambda s: (F.octet_length(s) > 3) & ~s.endswith(".mdx"))
    own = F.array(method, F.concat_ws(" ", F.when(path.isNotNull(), method), F.when(method.isNotNull(), path)), F.when(method.isNotNull(), path), meta("operationId"), meta("title"))
    said = F.filter(F.array_distinct(F.concat(own, parts)), lambda q: q.isNotNull() & (q != ""))
    return page_rows.select("relative_path", F.explode(said).alias("query"))


def page_queries(page: str, meta: dict[str, str]) -> list[str]:
    """The same of one page, sorted, on the driver."""
    out = set()
    if meta.get("method") is not None:
        out.add(meta["method"].upper())
        if meta.get("path") is not None:
            out |= {f"{meta['method'].upper()} {meta['path']}", meta["path"]}
    out |= {meta[k] for k in ("operationId", "title") if meta.get(k) is not None}
    out |= {s for s in page.split("/") if len(s.encode()) > 3 and not s.endswith(".mdx")}
    return sorted(out)


def issue_queries(issues: DataFrame, limit: int = 40) -> DataFrame:
    """(query) of the first issues: controller segments, paths as words, operations, SDK methods."""
    first = issues.orderBy("seq").limit(limit)
    parts = F.when(F.col("file").isNotNull(), F.concat(F.transform(F.filter(F.split("file", "/"), lambda s: F.contains(s, F.lit("Controller"))), lambda s: F.replace(s, F.lit(".mdx"), F.lit(""))), F.array(F.translate(F.replace("file", F.lit(".mdx"), F.lit("")), "/", " "))))
    op = F.nullif(F.regexp_extract("message", r"OpenAPI operation missing MDX: (.*)", 1), F.lit(""))
    sdk = F.when(F.contains("message", F.lit("SDK method not mentioned")), F.get(F.split("message", ": "), F.lit(1)))
    each = first.select(F.explode(F.array_compact(F.concat(F.coalesce(parts, F.array().cast("array<string>")), F.array(op, sdk)))).alias("query"))
    return each.distinct().orderBy("query")


# Priority of an issue's action by category, 4 for all others; an external check's issue that names its generator comes first.
PRIORITIES = {"missing_endpoint": 1, "orphan_doc": 2, "guide_dead_link": 2, "sdk_unmentioned": 3, "ts_drift": 2}
GENERATOR = "pnpm run generate"


def actions(issues: DataFrame, locale_issues: DataFrame, tool: str = "lorekit", limit: int = 30, scripts: dict[str, str] | None = None) -> DataFrame:
    """(source, priority, command, title, detail): one for each of the first issues, and two sums of locale issues.

    ``scripts`` are the project's own commands: ``generate``, which an external check may ask for, and ``check``, that check.
    """
    scripts = scripts or {}
    c, m = F.col("category"), F.col("message")
    asks = (c == "ts_drift") & F.contains(m, F.lit(GENERATOR))
    by_category = F.element_at(F.create_map(*[F.lit(x) for p in PRIORITIES.items() for x in p]), c)
    priority = F.when(asks, 1).otherwise(F.coalesce(by_category, F.lit(4)))
    command = F.when(c == "missing_endpoint", f"{tool} scaffold").when(asks, F.lit(scripts.get("generate"))).when(c == "ts_drift", F.lit(scripts.get("check")))
    first = issues.orderBy("seq").limit(limit).select(F.lit("drift").alias("source"), priority.alias("priority"), command.alias("command"), c.alias("title"), m.alias("detail"))
    sums = locale_issues.agg(F.count_if(c == "locale_gap").alias("gap"), F.count_if(c == "locale_structure").alias("structure"))
    own = [
        (2, f"{tool} sync-i18n --scaffold-missing", "locale_gap", "pages without a sibling in a target locale: %d", "gap"),
        (3, f"{tool} translate-i18n --dry-run", "locale_structure", "page pairs whose headings, keys or links differ: %d", "structure"),
    ]
    said = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(run).alias("command"), F.lit(title).alias("title"), F.format_string(text, n).alias("detail"), F.col(n).alias("n")) for p, run, title, text, n in own])
    second = sums.select(F.explode(said).alias("a")).where("a.n > 0").select(F.lit("i18n").alias("source"), "a.priority", "a.command", "a.title", "a.detail")
    return first.unionByName(second)


def with_recommendations(acts: DataFrame, recommended: DataFrame) -> DataFrame:
    """Actions and those recommended ones whose title is no action's yet."""
    return acts.unionByName(recommended.join(acts.select("title").distinct(), "title", "left_anti"))


def suggest(project: Project, script: str | None = None, with_locales: bool = True, model: providers.Provider | None = None) -> dict:
    """Prioritised actions from all issues, with a model's plan where a model is given."""
    issues = drift_report(project, script).cache()
    none = issues.limit(0)
    local = sync_locales(project, check_only=True)["issues"] if with_locales else none
    everything = issues.unionByName(local) if with_locales else issues
    steps = [r["step"] for r in drift.next_steps(everything).collect()]
    acts = actions(issues, local, scripts=project.config.scripts)
    context = project.search_context([r["query"] for r in issue_queries(everything).collect()], 15)
    plan = None
    if model is not None:
        summary = drift.category_summary(everything).first()["summary"]
        plan = model.plan(summary, steps, providers.plan_prompt(summary, steps, context, graph_size(project)))
        more = [("ai", r["priority"], r["command"], r["title"], r["rationale"]) for r in plan["recommendations"]]
        if more:
            acts = with_recommendations(acts, project.spark.createDataFrame(more, "source string, priority int, command string, title string, detail string"))
    structure = F.count_if((F.col("category") == "locale_structure") & F.col("file").startswith("api/"))
    return {
        "actions": acts.orderBy("priority", "title", "detail"),
        "commands": steps,
        "summary": plan["summary"] if plan else None,
        "drift_issue_count": issues.count(),
        "i18n_issue_count": local.count(),
        "i18n_by_category": {r["category"]: r["n"] for r in drift.by_category(local).collect()},
        "i18n_api_structure_count": local.agg(structure).first()[0],
        "code_context_chars": len(context),
    }


def graph_size(project: Project) -> str:
    path = project.at(project.config.graph_cache)
    if not path.is_file():
        return "(run a scan to refresh the knowledge graph)"
    saved = json.loads(path.read_text(encoding="utf-8"))
    return f"graph nodes={len(saved['nodes'])} edges={len(saved['edges'])}"


def matching_operations(operations: DataFrame, method: str | None, path: str | None) -> DataFrame:
    """Operations of a method, ignoring case, and a path; a missing one matches all."""
    ops = operations if method is None else operations.where(F.col("method") == method.upper())
    return ops if path is None else ops.where(F.col("path") == path)


def operation_context(project: Project, meta: dict[str, str]) -> str:
    """The operations that a page's frontmatter names, as text."""
    method, path = meta.get("method"), meta.get("path")
    if method is None and path is None:
        return "(no OpenAPI operation on this page)"
    rows = matching_operations(project.operations, method, path).orderBy("path", "method").collect()
    found = [f"{r['method']} {r['path']}\n" + (f"{r['summary']}\n" if r["summary"] else "") + "\n" for r in rows]
    return "".join(found) or "(operation not found in OpenAPI)"


def topic_documents(competitors: DataFrame, page: str, first: int = 50, keep: int = 3) -> DataFrame:
    """(title, relative_path) of the first documents whose path or lower-case title holds the page's topic."""
    topic = page.split("/")[1] if "/" in page else "docs"
    title = F.coalesce("title", "relative_path")
    some = competitors.orderBy("relative_path").limit(first)
    hits = some.where(F.contains("relative_path", F.lit(topic)) | F.contains(F.lower(title), F.lit(topic))).orderBy("relative_path").limit(keep)
    return hits.select(title.alias("title"), "relative_path")


def competitor_context(project: Project, page: str) -> str:
    """At most three of the first fifty documents of other providers on the page's topic, as text."""
    hits = topic_documents(project.competitors, page).orderBy("relative_path").collect()
    return "\n".join(f"- {r[0]}: {r[1]}" for r in hits) or "(no competitor snippets for this topic)"


def improve(project: Project, page: str, model: providers.Provider | None = None, output: str | Path | None = None) -> dict:
    """An improved page with its diff, written below ``output`` where that is given."""
    page = page.lstrip("/")
    row = project.pages.where(F.col("relative_path") == page).first()
    if row is None:
        raise FileNotFoundError(page)
    guide = project.at(project.config.style_guide)
    style = guide.read_text(encoding="utf-8") if guide.is_file() else "Write clear and short technical prose. Stay true to the interface."
    context = project.search_context(page_queries(page, row["frontmatter"]), 12)
    prompt = providers.improve_prompt(page, row["raw"], style, operation_context(project, row["frontmatter"]), context, competitor_context(project, page))
    better = (model or providers.provider(project.config.llm)).improve(row["raw"], prompt)
    if output is not None:
        _write(Path(output) / page, better)
    return {"path": page, "improved": better, "diff": diff.unified(page, row["raw"], better), "written_to": str(Path(output) / page) if output else None, "provenance": cfg.git_provenance(project.root)}


def page_diff(project: Project, page: str, proposed: str | Path | None = None) -> dict:
    """Diff of a page with a proposed file, or with itself."""
    page = page.lstrip("/")
    original = (Path(project.docs) / page).read_text(encoding="utf-8")
    new = Path(proposed).read_text(encoding="utf-8") if proposed else original
    return {"path": page, "format": "unified", "patch": diff.unified(page, original, new), "changed": new != original}


def doctor(project: Project) -> DataFrame:
    """(id, label, status, detail) of eight checks of the project's files and tools."""
    import shutil

    c = project.config
    file = lambda rel, bad: ("ok" if project.at(rel).is_file() else bad, str(project.at(rel)))
    folder = lambda rel, bad: ("ok" if project.at(rel).is_dir() else bad, str(project.at(rel)))
    tool = shutil.which("pnpm")
    rows = [
        ("monorepo", "Project root", *file(cfg.MARKER, "fail")),
        ("openapi", "OpenAPI spec", *file(c.openapi, "fail")),
        ("docs_content", "Docs content", *folder(c.docs_content, "fail")),
        ("pnpm", "pnpm", "ok" if tool else "warn", tool or "not on PATH"),
        ("i18n_lock", "Locale lock", *file(c.i18n.lock_cache, "warn")),
        ("scan_index", "Scan index cache", *file(c.index_cache, "warn")),
        ("competitors", "Competitor corpus", *folder(c.competitors, "warn")),
        ("reranker_model", "Reranker", "warn", "none is configured; the first hits are kept as they are"),
    ]
    return project.spark.createDataFrame(rows, "id string, label string, status string, detail string")
