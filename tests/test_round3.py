import pytest
from pyspark.sql import functions as F

from lorekit import catalog
from lorekit.functions import code, markdown
from lorekit.operators.spread import corpus, spread
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The tables with documents whose text is empty, a line end, blank, or without an end."""
    folder = tmp_path_factory.mktemp("odd")
    for t in oracle.TABLES:
        if t != "documents":
            (folder / f"{t}.parquet").symlink_to(f"{FOLDER}/{t}.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = spark.createDataFrame([(900_001 + i, t, "en", "web", len(t)) for i, t in enumerate(["", "\n", "\n\n", " ", "a", "a\n", "a\n\nb"])], docs.schema)
    docs.limit(20).unionByName(more).toPandas().to_parquet(folder / "documents.parquet", index=False)
    return str(folder)


@pytest.mark.parametrize("name", ["diff_text", "header_ranges", "frontmatter", "scaffold_stub"])
def test_empty_documents(spark, odd, name):
    """An empty text is one empty line in SQL, and was no line at all here."""
    assert oracle.spark_rows(catalog.QUERIES[name](spark, odd)) == oracle.sql_rows(oracle.connect(odd), catalog.SQL[name])


def test_headers_of_rows_that_agree_in_key(spark):
    """The second text cut the ranges of the first, as all rows of a key were taken for one text."""
    df = spark.createDataFrame([(1, "# A\nx\ny\nz\n"), (1, "\n# B\n")], "k int, t string")
    assert sorted(tuple(r) for r in markdown.headings(df, "t").collect()) == [(1, "A", 1, 1, 4), (1, "B", 1, 2, 2)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_work_is_dealt(spark):
    """Files made from one small table of keys were all parsed by the one task that read it."""
    keys = spark.range(0, 9000, 1, 1)
    assert spread(keys).rdd.getNumPartitions() == 5
    sizes = [len(x) for x in spread(keys).rdd.glom().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2 * min(sizes)
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 1


def _files(spark):
    text = "class A:\n    def m(self):\n        return f(1)\n\n\ndef f(x):\n    return x\n"
    return spark.createDataFrame([("a.py", "a.py", "python", text), ("b.py", "b.py", "python", "import os\n")], "path string, relative_path string, language string, content string")


def test_files_are_parsed_once(spark):
    """Each kind of element parsed all files again, and so did plans that read nothing of it."""
    parsed = code.parse_files(_files(spark))
    assert _plan(code.elements(parsed)).count("ArrowEvalPython [") == 1
    assert _plan(code.imports(parsed)).count("ArrowEvalPython [") == 1
    assert "ArrowEvalPython" not in _plan(parsed.select("relative_path", "total_lines"))


def test_parts_of_a_file(spark):
    all_parts = {r["relative_path"]: r["parsed"] for r in code.parse_files(_files(spark)).collect()}
    for part, names in (("declarations", ("docstring", "classes", "functions")), ("imports", ("imports",)), ("calls", ("calls",))):
        for r in code.parse_files(_files(spark), (part,)).collect():
            for n in r["parsed"].asDict():
                assert r["parsed"][n] == (all_parts[r["relative_path"]][n] if n in names else None if n == "docstring" else [])


def test_blocks_are_split_where_they_are_read(spark):
    pages = spark.createDataFrame([("a", "# H\n")], "relative_path string, body string")
    assert "ArrowEvalPython" not in _plan(markdown.with_blocks(pages).select("relative_path"))
    assert markdown.with_blocks(pages).first()["blocks"][0]["content"] == "H"


def test_corpus_sides_are_not_broadcast(spark):
    """Rows made from a small file of keys seemed small, and went through the driver."""
    small = spark.range(5)
    assert "Broadcast" in _plan(small.join(F.broadcast(small), "id")) and "Broadcast" not in _plan(small.join(corpus(small), "id"))
    assert "BroadcastHashJoin" not in _plan(catalog.QUERIES["code_edges"](spark, FOLDER))
