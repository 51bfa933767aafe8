"""Code and knowledge graphs: import resolution, inheritance, calls, links and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekit.functions import text as X
from lorekit.operators.spread import corpus

SYMBOLS = ("class", "function", "header", "tag")


def last_wins(df: DataFrame, keys: list[str], value: Column, order: Column, name: str = "id") -> DataFrame:
    """One value for each key: that of the last row in the given order."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def position(path: str = "relative_path", line: str = "start_line", id_: str = "id") -> Column:
    return F.struct(path, line, id_)


def modules(elements: DataFrame) -> DataFrame:
    """(module, file_id): file elements by dotted module path."""
    files = elements.where("element_type = 'file'").withColumn("module", X.module_path(F.col("relative_path"))).where("module IS NOT NULL")
    return last_wins(files, ["module"], F.col("id"), position(), "file_id")


def target_module(path: Column, module: Column, level: Column) -> Column:
    """Module that an import names: absolute as it stands; relative below the importer's module less ``level`` parts."""
    own = F.split(X.module_path(path), r"\.")
    cut = F.when(path.endswith("__init__.py"), level - 1).otherwise(level)

    def relative(parts: Column) -> Column:
        base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - cut, F.lit(0))), ".")
        return F.when(cut <= F.size(parts), F.when(module == "", base).otherwise(F.concat(base, F.lit("."), module)))

    return F.when(level > 0, X.let(own, relative)).otherwise(module)


def resolve_imports(imports: DataFrame, elements: DataFrame) -> DataFrame:
    """Imports with ``file_id`` of the importer and ``target_file_id`` where the module is known; others are left out."""
    files = elements.where("element_type = 'file'").select("relative_path", F.col("id").alias("file_id"))
    keyed = imports.join(corpus(files), "relative_path").withColumn("target", target_module(F.col("relative_path"), F.col("module"), F.col("level")))
    known = modules(elements).select(F.col("module").alias("target"), F.col("file_id").alias("target_file_id"))
    return keyed.join(corpus(known), "target")


def edges(df: DataFrame, graph: str, src: str, dst: str, label: str) -> DataFrame:
    """Edge rows without self-loops; parallel edges stay."""
    return df.where(F.col(src) != F.col(dst)).select(F.lit(graph).alias("graph"), F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(label).alias("label"))


def dependency_edges(imports: DataFrame, elements: DataFrame) -> DataFrame:
    return edges(resolve_imports(imports, elements), "dependency", "file_id", "target_file_id", "imports")


def inheritance_edges(elements: DataFrame) -> DataFrame:
    """Class to base by name over the whole corpus; of classes with one name the last wins."""
    classes = elements.where("element_type = 'class'")
    named = last_wins(classes, ["name"], F.col("id"), position()).select(F.col("name").alias("base"), F.col("id").alias("base_id"))
    based = classes.select("id", F.explode("bases").alias("base")).join(corpus(named), "base")
    return edges(based, "inheritance", "id", "base_id", "extends")


def _number(df: DataFrame, c: str) -> Column:
    """A position as a number; days of dates, seconds of timestamps."""
    kind = df.schema[c].dataType.typeName()
    if kind == "date":
        return F.unix_date(c)
    return F.unix_seconds(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c)


def enclosing(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, order: list[str], keep: list[str]) -> DataFrame:
    """For each point the smallest range of the same key that holds it, the first in order on a tie; points outside go.

    Points and ranges meet in bins as wide as a key's ranges are on average. So all ranges of a key together lie in at
    most two bins each on average, and a point meets the ranges around it and not all of its key. Points need not be
    unique: equal points get equal answers, so the join runs over distinct ones.
    """
    asked = points.select(*by, at).distinct()
    own = ranges.select(*by, start, end, *[c for c in dict.fromkeys([*order, *keep]) if c not in (*by, start, end)]).where(F.col(start) <= F.col(end))
    first, last, place = _number(own, start), _number(own, end), _number(asked, at)
    width = own.groupBy(*by).agg(F.greatest(F.ceil(F.avg(last - first)), F.lit(1)).cast("long").alias("_w"))
    bin_ = lambda x: F.floor(x / F.col("_w")).cast("long")
    spread = own.join(corpus(width), by).withColumn("_bin", F.explode(F.sequence(bin_(first), bin_(last)))).drop("_w")
    met = asked.join(corpus(width), by).withColumn("_bin", bin_(place)).drop("_w").join(corpus(spread), [*by, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = met.groupBy(*by, at).agg(F.min_by(F.struct(*keep), F.struct((F.col(end) - F.col(start)).alias("_width"), *order)).alias("_best"))
    return points.join(corpus(best), [*by, at]).select(*points.columns, "_best.*")


def lookup(ids: DataFrame, elements: DataFrame, id_: str = "id") -> DataFrame:
    """Elements by id with path and module, for a frame of ids; unknown ids are left out."""
    return ids.select(F.col(id_).alias("id")).join(elements, "id").withColumn("module", X.module_path(F.col("relative_path")))


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def resolve_calls(calls: DataFrame, imports: DataFrame, elements: DataFrame) -> DataFrame:
    """Calls with ``callee_id``: a definition of the file, else an export of an imported file, else any function of the name."""
    symbols = elements.where(F.col("element_type").isin(*SYMBOLS))
    both = symbols.select("relative_path", "id", "start_line", F.explode(F.array_distinct(F.array(simple_name(F.col("name")), F.col("name")))).alias("callee_name"))
    local = last_wins(both, ["relative_path", "callee_name"], F.col("id"), position(), "local_id")
    exported = last_wins(symbols.withColumn("callee_name", simple_name(F.col("name"))), ["relative_path", "callee_name"], F.col("id"), position(), "export_id")
    files = elements.where("element_type = 'file'").select(F.col("id").alias("target_file_id"), F.col("relative_path").alias("_target_path"))
    seen = resolve_imports(imports, elements).join(corpus(files), "target_file_id").select("relative_path", "line", "_target_path", F.explode("names").alias("_name"))
    exports = exported.withColumnRenamed("relative_path", "_target_path")
    named = seen.where("_name <> '*'").join(corpus(exports.withColumnRenamed("callee_name", "_name")), ["_target_path", "_name"]).select("relative_path", "line", F.col("_name").alias("callee_name"), "export_id")
    starred = seen.where("_name = '*'").join(corpus(exports), "_target_path").select("relative_path", "line", "callee_name", "export_id")
    imported = named.unionByName(starred).groupBy("relative_path", "callee_name").agg(F.min_by("export_id", F.struct("line", "export_id")).alias("import_id"))
    functions = elements.where("element_type = 'function'").withColumn("callee_name", simple_name(F.col("name")))
    anywhere = last_wins(functions, ["callee_name"], F.col("id"), position(), "global_id")
    met = calls.join(corpus(local), ["relative_path", "callee_name"], "left").join(corpus(imported), ["relative_path", "callee_name"], "left").join(corpus(anywhere), "callee_name", "left")
    return met.withColumn("callee_id", F.coalesce("local_id", "import_id", "global_id")).drop("local_id", "import_id", "global_id")


def call_edges(calls: DataFrame, imports: DataFrame, elements: DataFrame) -> DataFrame:
    """Caller to callee; the caller is the smallest function around the call, and both have to be known."""
    functions = elements.where("element_type = 'function'").select("relative_path", F.col("start_line").alias("_start"), F.col("end_line").alias("_end"), F.col("id").alias("caller_id"))
    inside = enclosing(resolve_calls(calls, imports, elements), functions, ["relative_path"], "line", "_start", "_end", ["_start", "caller_id"], ["caller_id"])
    return edges(inside.where("callee_id IS NOT NULL"), "call", "caller_id", "callee_id", "calls")


def graph_stats(elements: DataFrame, all_edges: DataFrame) -> DataFrame:
    """(graph, nodes, edges): dependency nodes are all files, others the ends of edges. A graph without edges is left out but for dependency."""
    files = elements.where("element_type = 'file'").select(F.lit("dependency").alias("graph"), F.col("id").alias("node"))
    ends = all_edges.select("graph", F.explode(F.array("src", "dst")).alias("node"))
    nodes = files.unionByName(ends).groupBy("graph").agg(F.countDistinct("node").alias("nodes"))
    counts = all_edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(counts, "graph", "left").select("graph", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def neighbors(all_edges: DataFrame, node: Column | str, direction: str = "out") -> DataFrame:
    """(id) one hop along or against the edges; parallel edges give repeats."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return all_edges.where(F.col(a) == node).select(F.col(b).alias("id"))


def file_links(all_edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Both directions of every dependency with names: (file_id, source_id, target_id, link_type, source_name, target_name)."""
    name = lambda c: elements.select(F.col("id").alias(c), F.col("relative_path").alias(f"{c}_name"))
    named = all_edges.where("graph = 'dependency'").join(name("src"), "src").join(name("dst"), "dst")
    row = lambda file, kind: named.select(F.col(file).alias("file_id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit(kind).alias("link_type"), F.col("src_name").alias("source_name"), F.col("dst_name").alias("target_name"))
    return row("src", "dependency").unionAll(row("dst", "dependent"))


def knowledge_nodes(operations: DataFrame, page_rows: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """(id, kind, label) of operations, English pages and SDK methods. Ids can repeat where two pages share a slug."""
    key = F.concat_ws(" ", "method", "path")
    parts = [
        operations.select(F.concat(F.lit("op:"), key).alias("id"), F.lit("operation").alias("kind"), key.alias("label")),
        page_rows.where("locale = 'en'").select(F.concat(F.lit("doc:"), "slug").alias("id"), F.when(F.col("method").isNotNull(), "api_doc").otherwise("guide").alias("kind"), F.coalesce("title", "slug").alias("label")),
    ]
    if methods is not None:
        parts.append(methods.select(F.concat(F.lit("sdk:"), "qualified").alias("id"), F.lit("sdk_method").alias("kind"), F.col("qualified").alias("label")))
    return reduce(DataFrame.unionByName, parts)


def knowledge_edges(page_rows: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(from, to, relation) of pages that document an operation; with ``dangling`` where the nodes are given."""
    rows = page_rows.where("locale = 'en' AND method IS NOT NULL AND path IS NOT NULL")
    out = rows.select(F.concat(F.lit("doc:"), "slug").alias("from"), F.concat(F.lit("op:"), F.concat_ws(" ", "method", "path")).alias("to"), F.lit("documents").alias("relation"))
    if nodes is None:
        return out
    known = nodes.select(F.col("id").alias("to"), F.lit(False).alias("_known")).distinct()
    return out.join(known, "to", "left").select("from", "to", "relation", F.coalesce("_known", F.lit(True)).alias("dangling"))
