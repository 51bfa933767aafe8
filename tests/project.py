"""A small project with one case of each kind of drift, written to a folder."""

from __future__ import annotations

import json
from pathlib import Path

DOCS = "apps/docs/content/docs"
FILES = {
    "apps/docs/package.json": "{}",
    "apps/docs/openapi.json": json.dumps({"paths": {"/items": {"get": {"operationId": "ItemsController_list", "summary": "All items"}, "parameters": []}, "/orders": {"post": {"operationId": "OrdersController_create"}}, "/status": {"get": {"summary": "Up"}}, "/odd": "text"}}),
    "apps/docs/lib/scripts/manual-api/_expected-public-operations.json": '["GET /items", "POST /orders", "GET /items"]',
    "apps/sdks/ts/src/generated/sdk-public-methods.json": json.dumps({"generatedAt": "x", "sdk": {"items": ["list"], "orders": ["create", "neverNamed"]}}),
    f"{DOCS}/api/items/ItemsController_list.mdx": "---\ntitle: List items\nmethod: get\npath: /items\noperationId: ItemsController_list\n---\n\n## Use\n\nReturns created items.\n",
    f"{DOCS}/api/items/ItemsController_list.fr.mdx": "---\ntitle: Lister\nmethod: GET\npath: /items\noperationId: ItemsController_list\n---\n\n## Usage\n\nRenvoie.\n",
    f"{DOCS}/api/lone/LoneController_only.mdx": "---\ntitle: Lone\nmethod: GET\npath: /lone\n---\n\nNot public.\n",
    f"{DOCS}/build/guides/first-steps.mdx": "---\ntitle: First steps\n---\n\nSee [here](/start/trial) and [there](/api/nowhere).\n\nCall `sdk.items.list` now.\n",
    f"{DOCS}/build/guides/moved.mdx": "---\ntitle: Moved\ndescription: \"A: b\"\n---\n\n## One\n\nText.\n",
    f"{DOCS}/build/guides/moved.fr.mdx": "---\ntitle: Déplacé\ndescription: b\n---\n\n## Un\n\n## Deux\n\nTexte.\n",
    f"{DOCS}/build/guides/only.fr.mdx": "---\ntitle: Seul\n---\n\nSans source.\n",
    f"{DOCS}/start/trial.mdx": "---\ntitle: Trial\n---\n\nTry it.\n",
    "apps/api/src/pay.ts": "/** Payments of the sample. */\nimport { log } from './log';\n\nexport class Base {}\n\nexport class Pay extends Base {\n  async run(a: number, b = 2): Promise<number> {\n    return helper(a);\n  }\n}\n\nexport function helper(x: number): number {\n  return log(x) + 1;\n}\n\nconst twice = async (y: number) => helper(y) * 2;\n",
    "apps/api/src/log.ts": "export const log = (x) => x;\n",
    "apps/api/node_modules/x/skip.ts": "export function skipped() {}\n",
    "apps/cli/app/__init__.py": '"""Package."""\nfrom .core import run\n',
    "apps/cli/app/core.py": '"""Core."""\nimport os\nfrom app.util import tool as t, Other\nfrom . import util\n\n\nclass Worker(Other):\n    """Works."""\n\n    def go(self, a, *rest, key=1, **more) -> int:\n        return t(a)\n\n\n@property\nasync def run():\n    def inner():\n        return tool()\n    return inner()\n\n\nrun()\n',
    "apps/cli/app/util.py": "class Other:\n    pass\n\n\ndef tool(x=1):\n    return x\n",
    "apps/design/docs/competitors/acme/docs/guides.md": "intro\n# Acme guides\n",
}


def write(root: Path) -> Path:
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    (root / DOCS / "api" / "empty").mkdir()
    return root
