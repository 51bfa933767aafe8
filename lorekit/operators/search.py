"""Search over code elements: keyword score, cosine, threshold, top k, context; vectors and rerankers behind protocols."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekit.functions import text as X

# Weights of a term in name, signature, docstring and code; of the cosine; and the least score.
WEIGHTS = (("name", 10.0), ("signature", 5.0), ("docstring", 3.0), ("code", 1.0))
SEMANTIC_WEIGHT, THRESHOLD = 30.0, 0.1
# Hits before and after reranking, and snippets of a context.
CANDIDATES, HITS, BATCH = 50, 15, 32


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, documents: list[str]) -> list[float]: ...


def keyword_score(terms: Column, weights: tuple[tuple[str, float], ...] = WEIGHTS) -> Column:
    """Sum over terms and fields of the field's weight where the lower-case field holds the term; null fields hold none."""
    fields = F.array(*[F.struct(F.lower(F.coalesce(F.col(c), F.lit(""))).alias("text"), F.lit(w).alias("w")) for c, w in weights])
    hit = lambda f, t: F.when(F.contains(f["text"], t), f["w"]).otherwise(0.0)
    return X.let(fields, lambda fs: F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.aggregate(fs, F.lit(0.0), lambda a, f: a + hit(f, t))))


#: Queries that one pass over the elements answers.
QUERIES = 200


def search(elements: DataFrame, queries: list[tuple[int, str]], k: int = HITS, weights=WEIGHTS, order: tuple[str, ...] = ("relative_path", "start_line", "id"), vectors: DataFrame | None = None, query_vectors: dict[int, list[float]] | None = None, unicode: bool = True) -> DataFrame:
    """Top k elements of each query: (query_no, rank, score, element columns).

    The queries are a stated set that the caller names; they go into the plan as constants in batches of QUERIES, so
    elements are read once for a batch and only hits above the threshold leave the scan. Ranking is per query with a
    total order. Vectors, where given, are joined on id once.
    """
    rows = elements if vectors is None else elements.join(vectors.select("id", "embedding"), "id", "left")
    # The terms of all queries are found in one small job, and a batch goes into the plan as one constant.
    asked = elements.sparkSession.createDataFrame(queries, "query_no long, query string")
    terms = {r[0]: r[1] for r in asked.select("query_no", X.search_terms(F.col("query"), unicode).alias("terms")).collect()}
    parts = []
    for i in range(0, max(1, len(queries)), QUERIES):
        batch = [{"query_no": n, "terms": terms[n], "vector": (query_vectors or {}).get(n)} for n, _ in queries[i : i + QUERIES]]
        values = F.from_json(F.lit(json.dumps(batch)), "array<struct<query_no:int,terms:array<string>,vector:array<double>>>")
        scored = X.let(
            values,
            lambda v: F.transform(v, lambda q: F.struct(q["query_no"].alias("query_no"), (keyword_score(q["terms"], weights) + _semantic(q["vector"], vectors is not None)).alias("score"))),
        )
        hits = rows.withColumn("_h", F.explode(F.filter(scored, lambda x: x["score"] > THRESHOLD)))
        parts.append(hits.select("_h.query_no", "_h.score", *elements.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out, k, order)


def _semantic(vector: Column, on: bool) -> Column:
    return F.coalesce(F.lit(SEMANTIC_WEIGHT) * X.cosine(vector, F.col("embedding").cast("array<double>")), F.lit(0.0)) if on else F.lit(0.0)


def top_k(scored: DataFrame, k: int, order: tuple[str, ...], by: str = "query_no") -> DataFrame:
    """The k best of each query with ``rank`` from 1; Spark cuts each task's groups to k before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, id_: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k vectors nearest to one query vector: (id, score)."""
    return vectors.select(id_, X.cosine(F.col(embedding), F.lit(query).cast("array<double>")).alias("score")).orderBy(F.desc("score"), id_).limit(k)


def rerank(hits: DataFrame, queries: list[tuple[int, str]], reranker: Reranker | None, k: int = HITS, text: str = "code") -> DataFrame:
    """The k best of each query's first CANDIDATES hits under a reranker; the first k where there is none. k = 0 keeps all.

    A query's candidates, CANDIDATES at most, are scored together in one task; ``rank`` and ``score`` are those of the
    reranker. Equal scores keep the order of the hits.
    """
    first = hits.where(F.col("rank") <= CANDIDATES)
    if reranker is None:
        return first.where(F.col("rank") <= k) if k else first
    asked = dict(queries)

    def score(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        scores = reranker.score(asked[t["query_no"][0].as_py()], [x or "" for x in t[text].to_pylist()])
        best = sorted(range(len(t)), key=lambda i: -scores[i])[: k or len(t)]
        out = t.take(pa.array(best, pa.int64()))
        out = out.set_column(out.schema.get_field_index("rank"), out.schema.field("rank"), pa.array(range(1, len(best) + 1), out.schema.field("rank").type))
        return out.set_column(out.schema.get_field_index("score"), out.schema.field("score"), pa.array([float(scores[i]) for i in best], pa.float64()))

    return first.groupBy("query_no").applyInArrow(score, first.schema)


def populate_vectors(elements: DataFrame, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """(id, embedding) of elements with a snippet, in batches; texts for which the embedder gives nothing are left out."""
    rows = elements.select("id", X.embed_snippet(*[F.col(c) for c in ("name", "signature", "docstring", "code")]).alias("snippet")).where("snippet <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.slice(i, batch)
                vectors = embedder.embed(part.column(1).to_pylist())
                kept = [(x, v) for x, v in zip(part.column(0).to_pylist(), vectors, strict=True) if v]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], b.schema.field(0).type), pa.array([v for _, v in kept], pa.list_(pa.float32()))], names=["id", "embedding"])

    return rows.mapInArrow(run, f"id {elements.schema['id'].dataType.simpleString()}, embedding array<float>")


def upsert_vectors(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new vectors in place of old ones of the same id."""
    both = store.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy("id").agg(F.max_by("embedding", "_v").alias("embedding"))


def assemble(hits: DataFrame, limit: int) -> DataFrame:
    """Snippets of several queries: first hit of each element in the order of queries and ranks, at most ``limit``; (query_no, rank, id, snippet)."""
    once = Window.partitionBy("id").orderBy("query_no", "rank")
    first = hits.withColumn("_n", F.row_number().over(once)).where("_n = 1").orderBy("query_no", "rank").limit(limit)
    return first.select("query_no", "rank", "id", X.snippet(F.col("name"), F.col("element_type"), F.col("relative_path"), F.col("start_line"), F.col("code")).alias("snippet"))


def best_hits(elements: DataFrame, queries: list[str], k: int = HITS, vectors: DataFrame | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, **kw) -> DataFrame:
    """The k hits of each query that an answer is built from: CANDIDATES by keyword and vector score, then reranked."""
    asked = list(enumerate(queries))
    query_vectors = None
    if vectors is not None and embedder is not None:
        query_vectors = {i: [float(x) for x in v] for (i, _), v in zip(asked, embedder.embed(queries), strict=True) if v}
    return rerank(search(elements, asked, CANDIDATES, vectors=vectors, query_vectors=query_vectors, **kw), asked, reranker, k)


def context(elements: DataFrame, queries: list[str], limit: int = HITS, vectors: DataFrame | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None) -> str:
    """Code context for a model: the snippets joined; at most ``limit`` of them reach the driver."""
    if not queries:
        return "(no code search queries)"
    found = assemble(best_hits(elements, queries, HITS, vectors, embedder, reranker), limit).orderBy("query_no", "rank").collect()
    return "\n".join(r["snippet"] for r in found) or "(no matching code elements; run a scan after API changes)"


def grep(files: DataFrame, pattern: str, regex: bool = True, path: str = "relative_path", text: str = "content") -> DataFrame:
    """(path, line_number, line) of matching lines, trimmed, numbered from 1."""
    each = files.select(path, F.posexplode(X.lines(F.col(text))).alias("_i", "_line"))
    test = F.col("_line").rlike(pattern) if regex else F.contains("_line", F.lit(pattern))
    return each.where(test).select(path, (F.col("_i") + 1).alias("line_number"), X.strip(F.col("_line")).alias("line"))


def filter_elements(elements: DataFrame, element_type: str | None = None, file_path: str | None = None) -> DataFrame:
    out = elements if element_type is None else elements.where(F.col("element_type") == element_type)
    out = out if file_path is None else out.where((F.col("file_path") == file_path) | (F.col("relative_path") == file_path))
    return out.orderBy("file_path", "start_line")
