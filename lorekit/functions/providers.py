"""Text models behind a protocol: a deterministic mock, and a client of the chat completion interface."""

from __future__ import annotations

import json
import os
import urllib.request
import zlib
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.functions import text as X


class Provider(Protocol):
    def translate(self, texts: list[str], source: str, target: str) -> list[str]: ...

    def improve(self, content: str, prompt: str) -> str: ...

    def plan(self, drift_summary: str, next_steps: list[str], prompt: str) -> dict: ...


class Mock:
    """Marks what it is given; the same on every run."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str]:
        return [f"[FR] {t}" for t in texts]  # a fixed value: the mark that translated segments carry

    def improve(self, content: str, prompt: str) -> str:
        return f"{content}\n\n{{/* read by a stand-in for a model */}}\n"

    def plan(self, drift_summary: str, next_steps: list[str], prompt: str) -> dict:
        steps = [{"priority": i + 1, "title": f"Step {i + 1}: {s}", "command": s, "rationale": "a finding of this kind is open"} for i, s in enumerate(next_steps[:3])]
        return {"summary": f"Open findings by kind: {drift_summary}.", "recommendations": steps}


@dataclass
class Chat:
    """A server with the chat completion interface; the key is read where the call is made."""

    base_url: str
    model: str
    temperature: float = 0.2
    key_variable: str = "LOREKIT_LLM_API_KEY"

    def _ask(self, prompt: str, as_json: bool = False) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        if as_json:
            body["response_format"] = {"type": "json_object"}
        request = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ[self.key_variable]}"})
        with urllib.request.urlopen(request, timeout=120) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    def translate(self, texts: list[str], source: str, target: str) -> list[str]:
        return json.loads(self._ask(translate_prompt(texts, source, target), True))["translations"]

    def improve(self, content: str, prompt: str) -> str:
        return self._ask(prompt).strip()

    def plan(self, drift_summary: str, next_steps: list[str], prompt: str) -> dict:
        return json.loads(self._ask(prompt, True))


def _post(url: str, body: dict, key: str, timeout: float = 60) -> dict:
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
        return json.load(reply)


@dataclass
class HttpEmbedder:
    """A server with the embeddings interface, asked for all texts at once; where that fails for each alone, and a text that fails gets no vector."""

    base_url: str
    model: str
    key_variable: str = "LOREKIT_EMBEDDING_API_KEY"

    def embed(self, texts: list[str]) -> list[list[float]]:
        key = os.environ.get(self.key_variable)
        if not key:
            raise KeyError(f"{self.key_variable} is not set")

        def ask(some: list[str]) -> list[list[float]]:
            rows = _post(f"{self.base_url}/embeddings", {"model": self.model, "input": some}, key)["data"]
            by = {r.get("index", i): r["embedding"] for i, r in enumerate(rows)}
            return [by.get(i, []) for i in range(len(some))]

        def alone(text: str) -> list[float]:
            try:
                return ask([text])[0]
            except OSError:
                return []

        try:
            return ask(texts) if texts else []
        except OSError:
            return [alone(t) for t in texts]


@dataclass
class HashEmbedder:
    """Vectors of hashed words, for tests and for work without a server; the same on every run."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for w in text.lower().split():
                h = zlib.crc32(w.encode("utf-8", "replace"))
                v[h % self.size] += 1.0 if h >> 31 else -1.0
            out.append(v)
        return out


def embedder(config: dict | None = None) -> HttpEmbedder | None:
    """The first of the configured embedding servers whose key is set, by default one and a second to fall back on; None without a key."""
    config = config or {}
    servers = config.get("embedders") or [{"key_variable": "LOREKIT_EMBEDDING_API_KEY", "base": "LOREKIT_EMBEDDING"}, {"key_variable": "LOREKIT_LLM_API_KEY", "base": "LOREKIT_LLM"}]
    for s in servers:
        if os.environ.get(s["key_variable"]):
            of = lambda name, s=s: s.get(name) or os.environ.get(f"{s.get('base', 'LOREKIT_EMBEDDING')}_{name.upper()}", "")
            return HttpEmbedder(of("base_url"), of("model"), s["key_variable"])
    return None


class OverlapReranker:
    """Share of the query's words that a document holds: a deterministic stand-in for a cross-encoder."""

    def score(self, query: str, documents: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(d.lower().split())) / max(1, len(words)) for d in documents]


@dataclass
class HttpReranker:
    """A server with the rerank interface; without an answer documents keep their order."""

    base_url: str
    model: str
    key_variable: str = "LOREKIT_RERANK_API_KEY"

    def score(self, query: str, documents: list[str]) -> list[float]:
        try:
            found = _post(f"{self.base_url}/rerank", {"model": self.model, "query": query, "documents": documents}, os.environ.get(self.key_variable, ""))["results"]
        except OSError:
            return [-float(i) for i in range(len(documents))]
        by = {r["index"]: float(r["relevance_score"]) for r in found}
        return [by.get(i, float("-inf")) for i in range(len(documents))]


def provider(config: dict | None = None) -> Provider:
    """The mock where the configuration or LOREKIT_LLM_MOCK=1 asks for it or no key is set, else a chat client."""
    config = config or {}
    key = config.get("key_variable", "LOREKIT_LLM_API_KEY")
    if config.get("provider") == "mock" or os.environ.get("LOREKIT_LLM_MOCK") == "1" or not os.environ.get(key):
        return Mock()
    return Chat(os.environ.get("LOREKIT_LLM_BASE_URL", config.get("base_url", "")), os.environ.get("LOREKIT_LLM_MODEL", config.get("model", "")), float(config.get("temperature", 0.2)), key)


def translate_prompt(texts: list[str], source: str, target: str) -> str:
    names = X.LANGUAGE_NAMES
    rules = ("Keep Markdown and MDX markup, code, link paths and the values of method, path and operationId as they are.", "Write as a native author would.", 'Answer with JSON: {"translations": [one string for each segment, in order]}.')
    return f"Translate documentation segments from {names.get(source, source)} to {names.get(target, target)}.\n" + "\n".join(f"- {r}" for r in rules) + "\n\nSegments:\n" + json.dumps(texts, ensure_ascii=False)


def improve_prompt(page: str, content: str, style: str, operations: str, code: str, competitors: str) -> str:
    parts = (("Style guide", style), ("Operations", operations), ("Code", code), ("How others document it", competitors), (f"Page {page}", content))
    return "Improve this documentation page. Keep it true to the code and keep its markup. Answer with the page only.\n\n" + "\n\n".join(f"## {h}\n{t}" for h, t in parts)


def plan_prompt(drift_summary: str, next_steps: list[str], code: str, graph: str) -> str:
    parts = (("Issues", drift_summary), ("Commands at hand", "\n".join(next_steps)), ("Code", code), ("Graph", graph))
    return 'Plan how to bring this documentation up to date. Answer with JSON: {"summary": text, "recommendations": [{"priority", "title", "command", "rationale"}]}.\n\n' + "\n\n".join(f"## {h}\n{t}" for h, t in parts)


def translate_segments(todo: DataFrame, model: Provider, source: str = "en", chunk: int | None = None) -> DataFrame:
    """Add ``translated`` to (relative_path, target, seg_key, value), in calls of one page and target at most ``chunk`` long.

    Without a chunk size each page's own token budget sets it. A page's segments go to one task, which its size bounds.
    A provider that does not answer each segment is an error.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_key").reset_index(drop=True)
        out: list[str] = []
        values = pdf["value"].tolist()
        estimate = sum(max(len(v) // 4, 1) for v in values) + max(len(translate_prompt(values, source, pdf["target"][0]).encode()) // 4, 1)
        size = chunk or min(X.MAX_CHUNK, max(1, (X.TOKENS_IN - X.TOKENS_OUT) // max(estimate, 1) * len(values)))
        for i in range(0, len(values), size):
            answer = model.translate(values[i : i + size], source, pdf["target"][0])
            if len(answer) != len(values[i : i + size]):
                raise ValueError(f"{len(answer)} translations for {len(values[i : i + size])} segments")
            out += answer
        return pdf.assign(translated=out)

    return todo.groupBy("relative_path", "target").applyInPandas(run, "relative_path string, target string, seg_key string, value string, translated string")


def token_budget(texts: DataFrame, text: str = "value", prompt_bytes: int = 0) -> DataFrame:
    """(n, tokens, chunk_size) of all segments together with a prompt."""
    out = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(X.token_estimate(F.col(text))), F.lit(0)).alias("content"))
    tokens = F.col("content") + (max(prompt_bytes // 4, 1) if prompt_bytes else 0)
    return out.select("n", tokens.alias("tokens"), X.chunk_size(tokens, F.col("n")).alias("chunk_size"))


__all__ = ["Chat", "HashEmbedder", "HttpEmbedder", "HttpReranker", "Mock", "OverlapReranker", "Provider", "embedder", "improve_prompt", "plan_prompt", "provider", "token_budget", "translate_prompt", "translate_segments"]
