"""Command line: ``python -m lorekit.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lorekit.functions import providers
from lorekit.operators import drift, stats
from lorekit.plans import corpus
from lorekit.sources import config as cfg


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorekit")
    p.add_argument("--config")
    p.add_argument("--root")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("scan")
    sub.add_parser("check")
    sub.add_parser("scaffold")
    sub.add_parser("drift").add_argument("--skip-ts", action="store_true")
    sub.add_parser("graph").add_argument("--output")
    sync = sub.add_parser("sync-i18n")
    for flag in ("--check", "--dry-run", "--scaffold-missing", "--lock"):
        sync.add_argument(flag, action="store_true")
    translate = sub.add_parser("translate-i18n")
    for flag in ("--check", "--dry-run", "--force"):
        translate.add_argument(flag, action="store_true")
    improve = sub.add_parser("improve")
    improve.add_argument("path")
    improve.add_argument("--stdout", action="store_true")
    improve.add_argument("--output")
    compare = sub.add_parser("diff")
    compare.add_argument("path")
    compare.add_argument("--proposed")
    suggest = sub.add_parser("suggest")
    for flag in ("--skip-ts", "--skip-ai", "--no-i18n"):
        suggest.add_argument(flag, action="store_true")
    sub.add_parser("doctor")
    return p


def use_json(flag: bool) -> bool:
    """JSON where asked for, and where nobody reads along."""
    return flag or not sys.stdout.isatty()


def _plain(value):
    if isinstance(value, DataFrame):
        return [json.loads(x) for x in value.toJSON().collect()]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _say(value, as_json: bool) -> None:
    value = _plain(value)
    if as_json:
        print(json.dumps(value, indent=2, ensure_ascii=False, default=str))
    else:
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            print(f"{k}: {v}")


def _script(project: corpus.Project, name: str) -> tuple[bool, str] | None:
    try:
        return cfg.script_output(["pnpm", name], project.at("apps/docs"))
    except OSError:
        return None


def main(argv: list[str] | None = None) -> int:
    """Runs a command; 1 for drift, for issues under --check, for failed checks and for a missing output target."""
    a = parser().parse_args(argv)
    if a.command == "improve" and not (a.stdout or a.output):
        print("give --stdout or --output", file=sys.stderr)
        return 1
    root = Path(a.root) if a.root else cfg.find_root(".")
    spark = SparkSession.builder.appName("lorekit").getOrCreate()
    project = corpus.Project(spark, root, cfg.load(a.config, root))
    as_json = use_json(a.json)
    if a.command == "scan":
        values = corpus.snapshot(project)
        corpus.save_snapshot(project, values)
        _say({"elements": values["code_element_count"], "stats": values["code_stats"], "pages": len(values["pages"]), "issues": len(values["drift_issues"])}, as_json)
    elif a.command in ("check", "scaffold"):
        done = _script(project, "docs:check" if a.command == "check" else "docs:scaffold")
        _say({"ok": bool(done and done[0]), "output": done[1] if done else "pnpm is not on PATH"}, as_json)
        return int(not (done and done[0]))
    elif a.command == "drift":
        done = None if a.skip_ts else _script(project, "docs:drift")
        found = corpus.drift_report(project, done[1] if done and not done[0] else None)
        _say({"issues": found, "issue_count": found.count(), "next_steps": [r[0] for r in drift.next_steps(found).collect()]}, as_json)
        return int(not drift.is_clean(found))
    elif a.command == "graph":
        text = json.dumps(corpus.graph_export(project), indent=2, ensure_ascii=False)
        if a.output:
            Path(a.output).write_text(text, encoding="utf-8")
        else:
            print(text)
    elif a.command == "sync-i18n":
        check = a.check or a.dry_run
        out = corpus.sync_locales(project, a.scaffold_missing, a.lock, check)
        _say(out, as_json)
        return int(a.check and not drift.is_clean(out["issues"]))
    elif a.command == "translate-i18n":
        out = corpus.translate_locales(project, None, a.force, a.check, a.dry_run)
        _say(out, as_json)
        return int(a.check and out["pending_segments"] > 0)
    elif a.command == "improve":
        out = corpus.improve(project, a.path, None, a.output)
        _say(out if a.stdout else {k: v for k, v in out.items() if k != "improved"}, as_json)
    elif a.command == "diff":
        out = corpus.page_diff(project, a.path, a.proposed)
        print(json.dumps(out, ensure_ascii=False) if as_json else out["patch"])
    elif a.command == "suggest":
        done = None if a.skip_ts else _script(project, "docs:drift")
        _say(corpus.suggest(project, done[1] if done and not done[0] else None, not a.no_i18n, None if a.skip_ai else providers.provider(project.config.llm)), as_json)
    else:
        checks = corpus.doctor(project)
        counts = stats.status_counts(checks)
        _say({"checks": checks, "counts": counts}, as_json)
        return int(counts.first()["fail_count"] > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
