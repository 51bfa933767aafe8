from pathlib import Path

import pytest
import yaml
from pyspark.sql import functions as F

from lorekit import cli
from lorekit.functions import providers
from lorekit.operators import drift, graph, search
from lorekit.plans import corpus
from lorekit.sources import config as cfg
from lorekit.sources import lock as locks
from tests import project as fixture


@pytest.fixture
def project(spark, tmp_path):
    return corpus.Project(spark, fixture.write(tmp_path))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_sources(project):
    assert rows(project.operations, "op_key") == [("GET /items",), ("GET /status",), ("POST /orders",)]
    assert project.public.count() == 2
    assert project.pages.count() == 8
    assert rows(project.pages.where("relative_path like '%moved.mdx'"), "slug", "locale", "title", "description") == [("build/guides/moved", "en", "Moved", "A: b")]
    assert {r[0] for r in project.slugs.collect()} == {"api/items/ItemsController_list", "api/lone/LoneController_only", "build/guides/first-steps", "build/guides/moved", "build/guides/only", "start/trial", "api/items", "api/lone", "api/empty", "build/guides"}
    assert rows(project.competitors, "provider", "title") == [("acme", "Acme guides")]
    assert rows(project.methods, "qualified") == [("sdk.items.list",), ("sdk.orders.create",), ("sdk.orders.neverNamed",)]
    assert project.sources.count() == 5


def test_drift(project):
    found = corpus.drift_report(project)
    got = [(r["category"], r["file"] or r["message"].split(": ")[1]) for r in found.orderBy("seq").collect()]
    assert got == [
        ("missing_endpoint", "POST /orders"),
        ("orphan_doc", "api/lone/LoneController_only.mdx"),
        ("locale_gap", "api/lone/LoneController_only.mdx"),
        ("locale_gap", "build/guides/first-steps.mdx"),
        ("locale_gap", "start/trial.mdx"),
        ("sdk_unmentioned", "sdk.orders.neverNamed"),
        ("guide_dead_link", "build/guides/first-steps.mdx"),
    ]
    assert [r[0] for r in drift.next_steps(found).collect()] == ["lorekit scaffold", "lorekit sync-i18n --scaffold-missing", "Fix dead internal links in MDX"]
    assert drift.category_summary(found).first()[0] == "guide_dead_link: 1, locale_gap: 3, missing_endpoint: 1, orphan_doc: 1, sdk_unmentioned: 1"
    assert not drift.is_clean(found)
    more = corpus.drift_report(project, "bad one\n\n  \nbad two\n").where("category = 'ts_drift'").orderBy("seq").collect()
    assert [r["message"] for r in more] == ["bad one", "bad two"]


def test_locales_and_translation(project, spark):
    out = corpus.sync_locales(project, check_only=True)
    assert rows(out["issues"], "category", "file") == [("locale_gap", "api/lone/LoneController_only.mdx"), ("locale_gap", "build/guides/first-steps.mdx"), ("locale_gap", "start/trial.mdx"), ("locale_orphan", "build/guides/only.fr.mdx"), ("locale_structure", "build/guides/moved.mdx")]
    assert out["issues"].where("category = 'locale_structure'").first()["message"] == "Heading count mismatch EN=1 FR=2 for build/guides/moved.mdx"
    plan = corpus.translate_locales(project, providers.Mock(), check_only=True)
    assert plan["pending_segments"] == 3 + 2 + 2 + 4 + 2 and not plan["lock_exists"]
    page = project.pages.where("relative_path like '%first-steps.mdx'").first()
    assert [(b["kind"], b["content"]) for b in page["blocks"]] == [("prose", "See here and there.Call sdk.items.list now.")]
    # A lock in which one page is stale.
    path = project.at(project.config.i18n.lock_cache)
    old = project.segments.withColumn("hash", F.when(F.col("relative_path").like("%moved.mdx") & (F.col("seg_key") == "body:0"), "0").otherwise(F.col("hash")))
    assert locks.write_lock(old, path) == 5
    assert yaml.safe_load(path.read_text())["version"] == 1
    stale = corpus.sync_locales(project, check_only=True)["issues"].where("category = 'locale_stale'")
    assert rows(stale, "file") == [("build/guides/moved.mdx",)]
    assert [p[:3] for p in corpus.translate_locales(project, check_only=True)["pages"]] == [("build/guides/moved.mdx", "build/guides/moved.fr.mdx", 1)]
    done = corpus.translate_locales(project, providers.Mock(), force=True)
    text = (Path(project.docs) / "start/trial.fr.mdx").read_text()
    assert "[FR] Trial" in text and done["lock_updated"]
    fresh = corpus.Project(spark, project.root)
    assert fresh.pages.count() == 11
    assert corpus.translate_locales(fresh, check_only=True)["pending_segments"] == 0


def test_scaffold(project):
    out = corpus.sync_locales(project, scaffold=True, refresh_lock=True)
    assert out["scaffolded"] == ["api/lone/LoneController_only.fr.mdx", "build/guides/first-steps.fr.mdx", "start/trial.fr.mdx"] and out["lock_updated"]
    text = (Path(project.docs) / "start/trial.fr.mdx").read_text()
    assert text.startswith("---\ntitle: [TODO] Trial\n---\n\n{/* TODO") and "Try it" not in text


def test_code_graph(project):
    c = project.code
    assert c.files.count() == 6 and c.parsed.count() == 5  # a JSON file is listed, not parsed
    names = {(r["element_type"], r["name"]) for r in c.elements.collect()}
    assert {("class", "Pay"), ("function", "Pay.run"), ("function", "helper"), ("function", "twice"), ("class", "Worker"), ("function", "Worker.go"), ("function", "run"), ("function", "tool"), ("function", "log")} <= names
    assert ("function", "inner") not in names and ("function", "skipped") not in names
    path = {r["id"]: r["name"] for r in c.elements.collect()}
    e = sorted((r["graph"], path[r["src"]], path[r["dst"]]) for r in c.edges.collect())
    assert ("dependency", "__init__.py", "core.py") in e and ("dependency", "core.py", "util.py") in e
    assert ("inheritance", "Pay", "Base") in e and ("inheritance", "Worker", "Other") in e
    assert ("call", "Pay.run", "helper") in e and ("call", "helper", "log") in e and ("call", "run", "tool") in e
    stats = c.stats().first()
    assert stats["total_files"] == 6 and stats["total_classes"] == 4 and stats["total_elements"] == len(path)
    worker = c.elements.where("name = 'Worker.go'").first()
    assert worker["signature"] == "def go(self, a, *rest, key, **more)" and worker["code"].strip().startswith("def go")
    file = c.elements.where("name = 'util.py'").first()
    assert file["summary"] == "python file, 1 class: Other, 1 function: tool, 6 lines"
    links = graph.file_links(c.edges, c.elements)
    assert {r["link_type"] for r in links.collect()} == {"dependency", "dependent"}
    core = c.elements.where("name = 'core.py'").first()["id"]
    assert {path[r["id"]] for r in graph.neighbors(c.edges.where("graph = 'dependency'"), core, "in").collect()} == {"__init__.py"}


def test_search_and_suggest(project):
    hits = search.search(project.code.elements, [(0, "helper"), (1, "worker go")])
    first = hits.where("rank = 1").orderBy("query_no").collect()
    # A keyword that equals the query counts twice: name, signature and code of the function.
    assert first[0]["name"] == "helper" and first[0]["score"] == 2 * (10 + 5 + 1)
    assert first[1]["name"].startswith("Worker")
    assert "### helper (function)" in search.context(project.code.elements, ["helper", "log"], 3)
    out = corpus.suggest(project, model=providers.Mock())
    assert out["drift_issue_count"] == 7 and out["i18n_by_category"] == {"locale_gap": 3, "locale_orphan": 1, "locale_structure": 1}
    acts = [(r["source"], r["priority"], r["title"]) for r in out["actions"].collect()]
    assert acts[0] == ("ai", 1, "Step 1: lorekit scaffold") and ("i18n", 2, "locale_gap") in acts
    assert [a[1] for a in acts] == sorted(a[1] for a in acts)


def test_knowledge_graph_and_snapshot(project, spark):
    assert project.nodes.count() == 3 + 5 + 3
    assert rows(project.edges, "to", "dangling") == [("op:GET /items", False), ("op:GET /lone", True)]
    values = corpus.snapshot(project)
    corpus.save_snapshot(project, values)
    again = corpus.load_snapshot(project)
    assert again["code_element_count"] == values["code_element_count"] and len(again["graph"]["nodes"]) == 11
    assert corpus.drift_from_snapshot(spark, again).count() == 7
    assert corpus.graph_export(project) == again["graph"]
    assert corpus.graph_size(project) == "graph nodes=11 edges=2"


def test_improve_diff_doctor(project, tmp_path):
    out = corpus.improve(project, "/build/guides/moved.mdx", providers.Mock(), tmp_path / "out")
    assert out["improved"].endswith("{/* read by a stand-in for a model */}\n") and Path(out["written_to"]).is_file()
    assert corpus.competitor_context(project, "build/guides/moved.mdx") == "- Acme guides: acme/docs/guides.md"
    assert corpus.operation_context(project, {"method": "get", "path": "/items"}).startswith("GET /items\nAll items")
    same = corpus.page_diff(project, "start/trial.mdx")
    assert not same["changed"] and same["patch"].startswith("--- a/start/trial.mdx\n+++ b/start/trial.mdx\n ---\n")
    status = {r["id"]: r["status"] for r in corpus.doctor(project).collect()}
    assert status["monorepo"] == status["openapi"] == status["docs_content"] == "ok" and status["i18n_lock"] == "warn" and len(status) == 8
    assert corpus.page_queries("api/items/x.mdx", {"method": "GET", "path": "/i", "title": "T"}) == ["/i", "GET", "GET /i", "T", "items"]


def test_config(tmp_path):
    keys = "\n".join(f'{k} = "x"' for k in ("openapi", "agent_openapi", "docs_content", "sdk_manifest", "mcp_manifest", "expected_public_operations", "competitors", "index_cache", "graph_cache"))
    (tmp_path / "lorekit.config.toml").write_text(keys + '\ncode_roots = ["a"]\n[i18n]\ntargets = ["es"]\n[i18n.mdx]\ninclude = ["d/*.mdx"]\n')
    c = cfg.load(base=tmp_path)
    assert c.i18n.targets == ["es"] and c.i18n.source == "en" and c.i18n.mdx.include == ["d/*.mdx"] and c.code_roots == ["a"]
    with pytest.raises(ValueError):
        cfg.parse('openapi = "x"')
    assert cfg.load(base=tmp_path / "none") == cfg.Config()
    fixture.write(tmp_path)
    assert cfg.find_root(tmp_path / "apps/api/src") == tmp_path.resolve()
    with pytest.raises(FileNotFoundError):
        cfg.find_root("/")


def test_cli(project, capsys):
    root = str(project.root)
    assert cli.main(["--root", root, "--json", "drift", "--skip-ts"]) == 1
    assert '"issue_count": 7' in capsys.readouterr().out
    assert cli.main(["--root", root, "--json", "sync-i18n", "--check"]) == 1
    assert cli.main(["--root", root, "--json", "translate-i18n", "--dry-run"]) == 0
    assert cli.main(["--root", root, "improve", "x.mdx"]) == 1
    assert cli.main(["--root", root, "--json", "scan"]) == 0
    assert cli.main(["--root", root, "--json", "graph"]) == 0
    assert cli.main(["--root", root, "--json", "diff", "start/trial.mdx"]) == 0
    assert cli.main(["--root", root, "--json", "doctor"]) == 0
    assert cli.main(["--root", root, "--json", "suggest", "--skip-ts", "--skip-ai"]) == 0


def test_vectors_and_reranker_in_the_plans(project, spark):
    project.embedder, project.reranker = providers.HashEmbedder(), providers.OverlapReranker()
    assert project.vectors.count() == project.code.elements.count()
    text = project.search_context(["go", "helper"], 4)
    assert 0 < text.count("### ") <= 4
    hits = search.best_hits(project.code.elements, ["helper"], 3, project.vectors, project.embedder, project.reranker).orderBy("rank").collect()
    assert [h["rank"] for h in hits] == [1, 2, 3] and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)


def test_tables_in_place_of_files(project, spark, tmp_path):
    path = tmp_path / "lock.parquet"
    assert locks.read_lock(spark, path)[1] is False
    assert locks.write_lock(project.segments, path) == 5
    rows_, there = locks.read_lock(spark, path)
    assert there and rows_.count() == project.segments.count()
    tables = corpus.snapshot_tables(project, str(tmp_path / "scan"))
    assert spark.read.parquet(tables["drift_issues"]).count() == 7 and spark.read.parquet(tables["pages"]).count() == 8
    assert spark.read.parquet(tables["elements"]).count() == project.code.elements.count()


def test_files_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([(f"a/{i}.mdx", f"text {i} é") for i in range(20)], "relative_path string, page string")
    assert corpus.write_files(df, "page", str(tmp_path)) == sorted(f"a/{i}.mdx" for i in range(20))
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted(f"{i}.mdx" for i in range(20)) and (tmp_path / "a/7.mdx").read_text() == "text 7 é"
