"""Project configuration (TOML), root discovery and git provenance; all on the driver."""

from __future__ import annotations

import subprocess
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

# Where configurations are looked for, and the layout of a project that has none of its own.
CANDIDATES = ("lorekit.config.toml", "apps/lorekit/lorekit.config.toml")
MARKER = "apps/docs/package.json"


@dataclass
class Mdx:
    include: list[str] = field(default_factory=lambda: ["apps/docs/content/docs/**/*.mdx"])
    exclude: list[str] = field(default_factory=lambda: [f"**/*.{x}.mdx" for x in ("fr", "es", "zh")])


@dataclass
class I18n:
    source: str = "en"
    targets: list[str] = field(default_factory=lambda: ["fr"])
    lock_cache: str = ".lorekit/i18n.lock"
    mdx: Mdx = field(default_factory=Mdx)


@dataclass
class Config:
    """Places in a project; the defaults are fixed values, those of the layout that the tools expect."""

    openapi: str = "apps/docs/openapi.json"
    agent_openapi: str = "apps/docs/agent-openapi.json"
    docs_content: str = "apps/docs/content/docs"
    sdk_manifest: str = "apps/sdks/ts/src/generated/sdk-public-methods.json"
    mcp_manifest: str = "apps/mcp/src/generated/tools-manifest.json"
    expected_public_operations: str = "apps/docs/lib/scripts/manual-api/_expected-public-operations.json"
    code_roots: list[str] = field(default_factory=lambda: ["apps/api", "apps/cli", "apps/mcp", "apps/sdks"])
    competitors: str = "apps/design/docs/competitors"
    index_cache: str = ".lorekit/index.json"
    graph_cache: str = ".lorekit/graph.json"
    style_guide: str = "apps/docs/STYLE_GUIDE.md"
    sdk_prefix: str = "sdk"
    i18n: I18n = field(default_factory=I18n)
    llm: dict = field(default_factory=dict)
    scripts: dict = field(default_factory=lambda: {"generate": "cd apps/mcp && pnpm run generate", "check": "cd apps/docs && pnpm docs:drift"})

    def code_root_paths(self, root: Path) -> list[str]:
        return [str(root / r) for r in self.code_roots]


#: Keys that a configuration file may leave out.
_OPTIONAL = {"i18n", "llm", "scripts", "style_guide", "sdk_prefix"}


def parse(text: str) -> Config:
    """All keys but the optional ones are required; unknown keys are passed over."""
    raw = tomllib.loads(text)
    missing = {f.name for f in fields(Config)} - _OPTIONAL - raw.keys()
    if missing:
        raise ValueError(f"configuration lacks {sorted(missing)}")
    own = {k: v for k, v in raw.items() if k in {f.name for f in fields(Config)} and k != "i18n"}
    i18n = dict(raw.get("i18n", {}))
    mdx = Mdx(**i18n.pop("mdx", {}))
    return Config(**own, i18n=I18n(**{k: v for k, v in i18n.items() if k in {"source", "targets", "lock_cache"}}, mdx=mdx))


def load(path: str | Path | None = None, base: str | Path = ".") -> Config:
    """A named file, else the first candidate that exists, else the defaults."""
    if path:
        return parse(Path(path).read_text(encoding="utf-8"))
    found = next((Path(base) / c for c in CANDIDATES if (Path(base) / c).is_file()), None)
    return parse(found.read_text(encoding="utf-8")) if found else Config()


def find_root(start: str | Path, marker: str = MARKER) -> Path:
    """The first directory from start upwards that holds the marker file."""
    here = Path(start).resolve()
    for d in [here, *here.parents]:
        if (d / marker).is_file():
            return d
    raise FileNotFoundError(f"no {marker} at or above {start}")


def git_provenance(root: str | Path) -> dict[str, str | None]:
    """Commit, branch and last subject; None for what git doesn't tell."""

    def ask(*args: str) -> str | None:
        try:
            out = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return out.stdout.strip() or None if out.returncode == 0 else None

    return {"commit": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "subject": ask("log", "-1", "--format=%s")}


def script_output(command: list[str], cwd: str | Path) -> tuple[bool, str]:
    """Whether a check script succeeded, and what it wrote to stderr and stdout."""
    out = subprocess.run(command, cwd=cwd, capture_output=True, text=True)
    return out.returncode == 0, out.stderr + out.stdout
