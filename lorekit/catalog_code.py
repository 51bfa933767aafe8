"""Registered queries on code: a file of each language for every part, with the declarations that each should give in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.catalog import _t, query
from lorekit.functions import code
from lorekit.functions import text as X
from lorekit.operators import graph, search
from lorekit.operators.spread import spread
from lorekit.sources import tree

#: Language, extension and text; {k} stands for the part's key.
FILES = {
    "python": ("py", '"""Module {k}.\n\n  More.\n"""\nimport os, sys as s\nfrom a.b import c\n\n\n@deco\nclass C{k}(Base, m.Other):\n    """\n    Class {k}.\n    """\n\n    @property\n    async def run(self, a, *args, b: int = 1, **kw) -> int:\n        """Runs."""\n        return self.go(a)\n\n\ndef f{k}(x):\n    return os.path.join(x)\n'),
    "typescript": ("ts", "/**\n * Module of part {k}.\n */\nimport { Base, util as u } from './base_x';\nimport * as all from \"lib-{k}\";\n\n/** Class {k}. */\nexport class C{k} extends Base {\n  run(a: number, b = 1): string {\n    return f{k}(a);\n  }\n}\n\n/** Makes {k}. */\nexport async function f{k}(x, ...rest) {\n  return this.log(x);\n}\n\nexport const g{k} = (y) => y + 1;\n"),
    "javascript": ("js", "import def{k} from 'm{k}';\n\nclass C{k} {\n  go(a) {\n    return def{k}.make(a);\n  }\n}\n\nfunction f{k}(a, b) {\n  return g(a);\n}\n"),
    "rust": ("rs", "//! Crate {k}.\nuse crate::base::Base{k};\n\n/// Struct {k}.\npub struct S{k} {\n    a: u32,\n}\n\npub trait T{k} {\n    fn go(&self);\n}\n\nimpl T{k} for S{k} {\n    fn go(&self) {\n        f{k}(self.a);\n    }\n}\n\n/// Makes {k}.\npub fn f{k}(x: u32) -> u32 {\n    util::g(x)\n}\n"),
    "go": ("go", 'package p{k}\n\nimport (\n\t"fmt"\n\tm "lib/m{k}"\n)\n\ntype S{k} struct {\n\tA int\n}\n\nfunc F{k}(x, y int) int {\n\treturn fmt.Sprint(x)\n}\n'),
    "java": ("java", "package a.b;\n\nimport java.util.List;\n\n/** Class {k}. */\npublic class C{k} extends Base implements Runnable {\n  /** Runs. */\n  public void run(int a) {\n    go(a);\n  }\n}\n"),
    "cpp": ("cpp", '#include <vector>\n#include "base{k}.h"\n\nstruct S{k} {\n  int a;\n};\n\nint f{k}(int x, int y) {\n  return g(x);\n}\n'),
}
#: (kind, name, first and last line, signature, docstring) of each declaration; a file's docstring is the module's.
DECLARED = {
    "python": [("file", "p{k}.py", 1, 22, None, "Module {k}.\n\n  More."), ("class", "C{k}", 10, 18, "class C{k}(Base, m.Other)", "Class {k}."), ("function", "C{k}.run", 16, 18, "async def run(self, a, *args, b, **kw)", "Runs."), ("function", "f{k}", 21, 22, "def f{k}(x)", None)],
    "typescript": [("file", "p{k}.ts", 1, 19, None, "Module of part {k}."), ("class", "C{k}", 8, 12, "class C{k}(Base)", "Class {k}."), ("function", "C{k}.run", 9, 11, "def run(a, b)", None), ("function", "f{k}", 15, 17, "async def f{k}(x, ...rest)", "Makes {k}."), ("function", "g{k}", 19, 19, "def g{k}(y)", None)],
    "javascript": [("file", "p{k}.js", 1, 11, None, None), ("class", "C{k}", 3, 7, "class C{k}", None), ("function", "C{k}.go", 4, 6, "def go(a)", None), ("function", "f{k}", 9, 11, "def f{k}(a, b)", None)],
    "rust": [("file", "p{k}.rs", 1, 22, None, "Crate {k}."), ("class", "S{k}", 5, 7, "class S{k}", "Struct {k}."), ("class", "T{k}", 9, 11, "class T{k}", None), ("function", "S{k}.go", 14, 16, "def go(&self)", None), ("function", "f{k}", 20, 22, "def f{k}(x)", "Makes {k}.")],
    "go": [("file", "p{k}.go", 1, 14, None, None), ("class", "S{k}", 8, 10, "class S{k}", None), ("function", "F{k}", 12, 14, "def F{k}(x, y)", None)],
    "java": [("file", "p{k}.java", 1, 11, None, None), ("class", "C{k}", 6, 11, "class C{k}(Base)", "Class {k}."), ("function", "C{k}.run", 8, 10, "def run(a)", "Runs.")],
    "cpp": [("file", "p{k}.cpp", 1, 10, None, None), ("class", "S{k}", 4, 6, "class S{k}", None), ("function", "f{k}", 8, 10, "def f{k}(x, y)", None)],
}
#: (module, names, line, whether names are taken from a module, level) of each import.
IMPORTED = {
    "python": [("os", "os", 5, False, 0), ("sys", "sys", 5, False, 0), ("a.b", "c", 6, True, 0)],
    "typescript": [("./base_x", "Base,util", 4, True, 1), ("lib-{k}", "all", 5, True, 0)],
    "javascript": [("m{k}", "def{k}", 1, True, 0)],
    "rust": [("crate.base.Base{k}", "Base{k}", 2, True, 0)],
    "go": [("fmt", "fmt", 4, False, 0), ("lib/m{k}", "m{k}", 5, False, 0)],
    "java": [("java.util.List", "List", 3, True, 0)],
    "cpp": [("vector", "vector", 1, False, 0), ("base{k}.h", "base{k}.h", 2, False, 0)],
}
#: (name, qualifier, line) of each call.
CALLED = {
    "python": [("go", "self", 18), ("join", "os.path", 22)],
    "typescript": [("f{k}", None, 10), ("log", "this", 16)],
    "javascript": [("make", "def{k}", 5), ("g", None, 10)],
    "rust": [("f{k}", None, 15), ("g", "util", 21)],
    "go": [("Sprint", "fmt", 13)],
    "java": [("go", None, 9)],
    "cpp": [("g", None, 9)],
}


def _files(spark, d, language: str | None = None) -> DataFrame:
    """(path, relative_path, language, content) of the files of a language, or of all."""
    key = spread(_t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k")))
    each = [key.select(F.concat(F.lit("src/p"), "k", F.lit(f".{ext}")).alias("path"), F.lit(name).alias("language"), F.replace(F.lit(text), F.lit("{k}"), F.col("k")).alias("content")) for name, (ext, text) in FILES.items() if language in (None, name)]
    return reduce(DataFrame.unionByName, each).withColumn("relative_path", F.col("path"))


def _value(x) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''").replace("{k}", "' || p_partkey || '").replace("\n", "' || chr(10) || '") + "'"


def _rows(language: str, table: list[tuple], names: tuple[str, ...]) -> str:
    path = _value("src/p{k}." + FILES[language][0])
    return " UNION ALL ".join(f"SELECT {path} AS relative_path, " + ", ".join(f"{_value(v)} AS {n}" for v, n in zip(row, names, strict=True)) + " FROM part" for row in table)


def _register(language: str) -> None:
    def declarations(spark, d):
        found = code.elements(code.parse_files(_files(spark, d, language), ("declarations",)))
        return found.select("relative_path", "element_type", "name", "start_line", "end_line", "signature", "docstring")

    def imports(spark, d):
        return code.imports(code.parse_files(_files(spark, d, language), ("imports",))).select("relative_path", "module", F.array_join("names", ",").alias("names"), "line", "is_from", "level")

    def calls(spark, d):
        return code.calls(code.parse_files(_files(spark, d, language), ("calls",))).select("relative_path", "callee_name", "qualifier", "line")

    tables = ((declarations, DECLARED, ("element_type", "name", "start_line", "end_line", "signature", "docstring")), (imports, IMPORTED, ("module", "names", "line", "is_from", "level")), (calls, CALLED, ("callee_name", "qualifier", "line")))
    for f, table, names in tables:
        f.__name__ = f"{language}_{f.__name__}"
        query(_rows(language, table[language], names))(f)


for _name in FILES:
    _register(_name)


@query("""WITH f AS (SELECT unnest(['py', 'ts', 'js', 'rs', 'go', 'java', 'cpp']) AS ext, unnest(['python', 'typescript', 'javascript', 'rust', 'go', 'java', 'cpp']) AS language, unnest([22, 19, 11, 22, 14, 11, 10]) AS n, unnest([1, 1, 1, 2, 1, 1, 1]) AS classes, unnest([1, 2, 1, 1, 1, 0, 1]) AS functions, unnest([3, 2, 1, 1, 2, 1, 2]) AS imports)
SELECT 'src/p' || p_partkey || '.' || ext AS relative_path, n AS total_lines, classes AS class_count, functions AS function_count, imports AS import_count FROM part, f""")
def file_metadata(spark, d):
    return code.file_metadata(code.parse_files(_files(spark, d), ("declarations", "imports"))).select("relative_path", "total_lines", "class_count", "function_count", "import_count")


_PATHS = "SELECT p_partkey, ['src', 'lib/.cache', 'node_modules/x', 'a/build', 'docs'][p_partkey % 5 + 1] || '/n' || p_partkey || ['.py', '.RS', '.txt', '', '.tar.ts', '.md', '.json'][p_partkey % 7 + 1] AS path FROM part"


def _paths(spark, d):
    key = F.col("p_partkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src", "lib/.cache", "node_modules/x", "a/build", "docs")]), (key % 5 + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(x) for x in (".py", ".RS", ".txt", "", ".tar.ts", ".md", ".json")]), (key % 7 + 1).cast("int"))
    path = F.concat(folder, F.lit("/n"), key.cast("string"), end)
    return _t(spark, d, "part").select("p_partkey", path.alias("path"), path.alias("relative_path"))


@query(f"WITH p AS ({_PATHS}) SELECT p_partkey, path, ['python', 'rust', NULL, NULL, 'typescript', 'markdown', 'json'][p_partkey % 7 + 1] AS language FROM p WHERE p_partkey % 7 NOT IN (2, 3) AND p_partkey % 5 IN (0, 4)")
def source_files(spark, d):
    """Files of a scan: those of a known language, outside hidden and ignored directories."""
    return tree.source_files(_paths(spark, d)).drop("relative_path")


@query(f"WITH p AS ({_PATHS}) SELECT p_partkey, ['py', 'rs', 'txt', '', 'ts', 'md', 'json'][p_partkey % 7 + 1] AS extension, p_partkey % 7 IN (0, 1, 4) AS parseable, p_partkey % 5 IN (1, 2, 3) AS ignored FROM p")
def path_predicates(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("p_partkey", X.extension(p).alias("extension"), X.is_parseable(p).alias("parseable"), X.in_ignored_dir(p).alias("ignored"))


# Elements out of order, by kind and path, and looked up by id.


def _elements(spark, d):
    part = _t(spark, d, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "class").otherwise("function")
    return part.select(F.col("p_partkey").cast("string").alias("id"), kind.alias("element_type"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.concat(F.lower("p_brand"), F.lit(".py")).alias("relative_path"), F.col("p_size").alias("start_line"), F.col("p_type").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.concat("p_name", F.lit(" of "), "p_type").alias("code"))


_ELEMENTS = "e AS (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'function' END AS element_type, p_name AS name, p_brand AS file_path, lower(p_brand) || '.py' AS relative_path, p_size AS start_line, p_type AS signature, p_name || ' of ' || p_type AS code FROM part)"


@query(f"WITH {_ELEMENTS} SELECT id, file_path, start_line FROM e WHERE element_type = 'class' AND file_path = 'Brand#11'")
def element_filter(spark, d):
    return search.filter_elements(_elements(spark, d), "class", "Brand#11").select("id", "file_path", "start_line")


@query(f"WITH {_ELEMENTS} SELECT id, name, replace(regexp_replace(relative_path, '\\.py$', ''), '/', '.') AS module FROM e WHERE id IN (SELECT l_partkey::VARCHAR FROM lineitem WHERE l_orderkey % 7 = 0)")
def element_lookup(spark, d):
    ids = _t(spark, d, "lineitem").where("l_orderkey % 7 = 0").select(F.col("l_partkey").cast("string").alias("id")).distinct()
    return graph.lookup(ids, _elements(spark, d)).select("id", "name", "module")


# Calls that resolve in the file, in an imported file, anywhere, or nowhere.


def _symbols(spark, d):
    """Each supplier is a file with one function; files import the file of the next supplier, by name or with a star."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda k: F.concat(F.lit("s"), k.cast("string"), F.lit(".py"))
    of = lambda kind, id_, n, end: s.select(F.lit(kind).alias("element_type"), F.concat(F.lit(id_), F.col("k").cast("string")).alias("id"), n.alias("name"), name(F.col("k")).alias("relative_path"), F.lit(1).alias("start_line"), F.lit(end).alias("end_line"))
    elements = of("file", "file", name(F.col("k")), 20).unionByName(of("function", "fn", F.concat(F.lit("f"), F.col("k").cast("string")), 9))
    imports = s.select(name(F.col("k")).alias("relative_path"), F.concat(F.lit("s"), (F.col("k") + 1).cast("string")).alias("module"), F.when(F.col("k") % 2 == 0, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("f"), (F.col("k") + 1).cast("string")))).alias("names"), F.lit(1).alias("line"), F.lit(0).alias("level"))
    callee = F.concat(F.lit("f"), (F.col("k") + F.col("o")).cast("string"))
    calls = s.withColumn("o", F.explode(F.array(*[F.lit(x) for x in (0, 1, 5, 100000)]))).select(name(F.col("k")).alias("relative_path"), callee.alias("callee_name"), F.lit(None).cast("string").alias("qualifier"), (F.lit(2) + F.when(F.col("o") == 5, 15).otherwise(0)).alias("line"), F.col("o").alias("_o"))
    return elements, imports, calls


@query("""WITH o AS (SELECT unnest([0, 1, 5, 100000]) AS o) SELECT 's' || s_suppkey || '.py' AS relative_path, 'f' || (s_suppkey + o) AS callee_name, CASE WHEN s_suppkey + o IN (SELECT s_suppkey FROM supplier) THEN 'fn' || (s_suppkey + o) END AS callee_id FROM supplier, o""")
def resolved_calls(spark, d):
    elements, imports, calls = _symbols(spark, d)
    return graph.resolve_calls(calls, imports, elements).select("relative_path", "callee_name", "callee_id")


@query("""WITH o AS (SELECT unnest([0, 1]) AS o) SELECT 'call' AS graph, 'fn' || s_suppkey AS src, 'fn' || (s_suppkey + o) AS dst, 'calls' AS label FROM supplier, o WHERE o > 0 AND s_suppkey + o IN (SELECT s_suppkey FROM supplier)""")
def resolved_call_edges(spark, d):
    """Calls outside all functions (line 17) and of unknown names give no edge, nor do calls of itself."""
    elements, imports, calls = _symbols(spark, d)
    return graph.call_edges(calls, imports, elements)


@query("SELECT 's' || a.s_suppkey || '.py' AS relative_path, 'file' || b.s_suppkey AS target_file_id FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def resolved_imports(spark, d):
    elements, imports, _ = _symbols(spark, d)
    return graph.resolve_imports(imports, elements).select("relative_path", "target_file_id")


# Search with vectors and a reranker: the query set is small and stated; elements are all parts.


class Sizes:
    """Embeds a text as its length and its number of spaces; the same on every run."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" "))] for t in texts]


class Commons:
    """Scores a document by its number of letters e, so that the order differs from that of the search."""

    def score(self, query: str, documents: list[str]) -> list[float]:
        return [float(d.count("e")) for d in documents]


_SNIPPET = "name || chr(10) || signature || chr(10) || code"


@query(f"WITH {_ELEMENTS} SELECT id, length({_SNIPPET})::INT AS x, (length({_SNIPPET}) - length(replace({_SNIPPET}, ' ', '')))::INT AS y FROM e")
def vector_population(spark, d):
    v = search.populate_vectors(_elements(spark, d), Sizes())
    return v.select("id", F.get("embedding", F.lit(0)).cast("int").alias("x"), F.get("embedding", F.lit(1)).cast("int").alias("y"))


_TERMS = ["small", "brass"]


def _hybrid_sql() -> str:
    score = lambda t: f"CASE WHEN contains(lower(name), '{t}') THEN 10.0 ELSE 0.0 END + CASE WHEN contains(lower(signature), '{t}') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(lower(code), '{t}') THEN 1.0 ELSE 0.0 END"
    cosine = lambda t: f"30.0 * list_cosine_similarity([length({_SNIPPET})::DOUBLE, (length({_SNIPPET}) - length(replace({_SNIPPET}, ' ', '')))::DOUBLE], [{float(len(t))}, 0.0])"
    each = " UNION ALL ".join(f"SELECT {i} AS query_no, *, round(2 * ({score(t)}) + {cosine(t)}, 6)::DOUBLE AS score FROM e" for i, t in enumerate(_TERMS))
    return f"WITH {_ELEMENTS}, s AS ({each}), r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, relative_path, start_line, id) AS rank FROM s WHERE score > 0.1)"


def _vectors(spark, d):
    return search.populate_vectors(_elements(spark, d), Sizes())


@query(_hybrid_sql() + " SELECT query_no, count(*) AS n, round(max(score), 4) AS best, round(min(score), 4) AS least FROM r WHERE rank <= 50 GROUP BY query_no")
def hybrid_search(spark, d):
    """Keyword score and 30 times the cosine, above the threshold, 50 of each query. A query of one word counts twice, as itself and as its keyword."""
    asked = {i: v for i, v in enumerate(Sizes().embed(_TERMS))}
    found = search.search(_elements(spark, d), list(enumerate(_TERMS)), search.CANDIDATES, vectors=_vectors(spark, d), query_vectors=asked)
    rounded = F.round("score", 4)
    return found.groupBy("query_no").agg(F.count(F.lit(1)).alias("n"), F.max(rounded).alias("best"), F.min(rounded).alias("least"))


def _keyword_sql() -> str:
    score = lambda t: f"2 * (CASE WHEN contains(lower(name), '{t}') THEN 10.0 ELSE 0.0 END + CASE WHEN contains(lower(signature), '{t}') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(lower(code), '{t}') THEN 1.0 ELSE 0.0 END)"
    each = " UNION ALL ".join(f"SELECT {i} AS query_no, *, {score(t)} AS score FROM e" for i, t in enumerate(_TERMS))
    return f"WITH {_ELEMENTS}, s AS ({each}), r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, relative_path, start_line, id) AS rank FROM s WHERE score > 0.1)"


@query(_keyword_sql() + ", c AS (SELECT *, length(code) - length(replace(code, 'e', '')) AS again FROM r WHERE rank <= 50), n AS (SELECT query_no, id, again::DOUBLE AS score, row_number() OVER (PARTITION BY query_no ORDER BY again DESC, rank) AS rank FROM c) SELECT query_no, rank::INT AS rank, id, score FROM n WHERE rank <= 15")
def reranked_search(spark, d):
    return search.best_hits(_elements(spark, d), _TERMS, reranker=Commons()).select("query_no", "rank", "id", "score")


@query(f"WITH {_ELEMENTS} SELECT id, {_SNIPPET} AS snippet FROM e")
def embed_snippets(spark, d):
    return _elements(spark, d).select("id", X.embed_snippet(F.col("name"), F.col("signature"), F.col("docstring"), F.col("code")).alias("snippet"))
