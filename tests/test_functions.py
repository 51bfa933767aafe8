import datetime
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekit.functions import code, diff, markdown, providers
from lorekit.functions import text as X
from lorekit.operators import drift, graph, search, stats
from lorekit.sources import pages as P
from lorekit.streaming import incremental


def one(spark, value, **cols):
    df = spark.createDataFrame([tuple(cols.values()) or (0,)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in cols.items()) or "x int")
    return df.select(value.alias("v")).first()["v"]


def col(f, *names):
    return f(*[F.col(n) for n in names])


@pytest.mark.parametrize("text, want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r", ["a", "b\r"]), ("\n\n", ["", ""]), ("a\n\nb", ["a", "", "b"])])
def test_lines(spark, text, want):
    assert one(spark, X.lines(F.col("t")), t=text) == want == markdown.line_list(text)


def test_line_functions(spark):
    assert one(spark, X.code_lines(F.col("t")), t="a\n # x\n\n// y\nb") == 2
    assert one(spark, X.line_range(F.col("t"), F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"
    assert one(spark, X.first_title(F.col("t")), t="x\n# One \n# Two") == "One"
    assert one(spark, X.first_title(F.col("t")), t="x") is None


@pytest.mark.parametrize("path, ext, lang, module", [("app/services/auth.py", "py", "python", "app.services.auth"), ("app/__init__.py", "py", "python", "app"), ("a/B.TSX", "tsx", "tsx", "a.B"), ("x/.env", "", None, "x..env"), ("Makefile", "", None, "Makefile"), ("a.b/c", "", None, "a.b.c"), ("x.y.rs", "rs", "rust", "x.y"), ("__init__.py", "py", "python", "__init__")])
def test_paths(spark, path, ext, lang, module):
    assert one(spark, X.extension(F.col("p")), p=path) == ext
    assert one(spark, X.language(F.col("p")), p=path) == lang
    assert one(spark, X.module_path(F.col("p")), p=path) == module
    assert one(spark, X.is_parseable(F.col("p")), p=path) == (lang in X.PARSEABLE)


def test_ignored_dirs(spark):
    for path, want in (("a/node_modules/x.js", True), (".git/x.py", True), ("a/b.py", False), ("build", False), ("target/x.rs", True)):
        assert one(spark, X.in_ignored_dir(F.col("p")), p=path) == want


@pytest.mark.parametrize("path, locale, slug, source", [("a/b.mdx", "en", "a/b", "a/b.mdx"), ("a/b.fr.mdx", "fr", "a/b", "a/b.mdx"), ("a/index.zh.mdx", "zh", "a", "a/index.mdx"), ("a/index.mdx", "en", "a", "a/index.mdx")])
def test_locales(spark, path, locale, slug, source):
    assert one(spark, X.locale(F.col("p")), p=path) == locale
    assert one(spark, X.slug(F.col("p")), p=path) == slug
    assert one(spark, X.source_path(F.col("p")), p=path) == source
    assert one(spark, X.sibling(F.col("p"), F.lit("es")), p="a/b.mdx") == "a/b.es.mdx"
    assert one(spark, X.sibling(F.col("p"), F.lit("en")), p="a/b.mdx") == "a/b.mdx"
    assert one(spark, X.source_path(F.col("p"), "fr"), p="a/b.mdx") is None


def test_ids(spark):
    assert one(spark, X.element_id("class", F.col("a"), F.col("b")), a="p.py", b="N") == "class_" + hashlib.md5(b"p.py::N").hexdigest()[:12]


@pytest.mark.parametrize("pattern, path, want", [("docs/**/*.mdx", "docs/a/b.mdx", True), ("docs/**/*.mdx", "docs/b.mdx", True), ("**/*.fr.mdx", "docs/a/b.fr.mdx", True), ("docs/*.mdx", "docs/a/b.mdx", False), ("a?.md", "ab.md", True), ("a+b.md", "aab.md", False)])
def test_globs(spark, pattern, path, want):
    assert one(spark, X.matches_any(F.col("p"), [pattern]), p=path) == want


@pytest.mark.parametrize(
    "raw, meta, body",
    [
        ("---\na: 1\nb : \"x: y\"\nnote\nc: 'z'\na: 2\n---\n\n  Body\n", {"a": "2", "b": "x: y", "c": "z"}, "Body\n"),
        ("no matter\n---\n", {}, "no matter\n---\n"),
        ("---\na: 1\n", {}, "---\na: 1\n"),
        ("---\r\nq: \"\r\n---\r\nx", {"q": '"'}, "x"),
        ("", {}, ""),
    ],
)
def test_frontmatter(spark, raw, meta, body):
    row = P.with_frontmatter(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row["frontmatter"] == meta and row["body"] == body


@pytest.mark.parametrize("text, want", [("the cat is on the mat", "en"), ("le chat est sur la table avec vous", "fr"), ("el perro está en la casa de los niños", "es"), ("der Hund ist auf dem Tisch und nicht hier", "de"), ("il gatto è sul tavolo con noi e voi non", "it"), ("o gato não está em casa você", "pt"), ("你好世界你好", "zh"), ("こんにちはみなさん", "ja"), ("안녕하세요 여러분", "ko"), ("hi there", "en"), ("", "en"), ("xx yy zz", "en"), ("漢字かなかなかな", "ja"), ("漢字漢字かなかなかな", "zh")])
def test_language(spark, text, want):
    assert one(spark, X.detect_language(F.col("t")), t=text) == want


def test_queries(spark):
    assert one(spark, X.expand_query(F.col("q"), F.lit("en")), q="How do the payments work") == "How do the payments work OR payments OR work"
    assert one(spark, X.expand_query(F.col("q"), F.lit("en")), q="is it") == "is it"
    assert one(spark, X.query_keywords(F.col("q"), F.lit("fr")), q="le éa ab quoi") == ["éa", "quoi"]
    assert one(spark, X.search_terms(F.col("q")), q="helper") == ["helper", "helper"]
    assert one(spark, X.language_directive(F.col("c")), c="en") == "" and "French" in one(spark, X.language_directive(F.col("c")), c="fr")
    assert one(spark, X.language_name(F.col("c")), c="xx") == "xx"


def test_budgets_and_vectors(spark):
    assert one(spark, X.token_estimate(F.col("t")), t="abc") == 1 and one(spark, X.token_estimate(F.col("t")), t="a" * 41) == 10
    for estimate, n, want in ((0, 0, 1), (10, 5, 100), (200_000, 7, 1), (60_000, 10, 10)):
        assert one(spark, X.chunk_size(F.col("e"), F.col("n")), e=estimate, n=n) == want
    assert abs(one(spark, col(X.cosine, "a", "b"), a=[1.0, 2.0, 9.0], b=[2.0, 4.0]) - 1) < 1e-9
    assert one(spark, col(X.cosine, "a", "b"), a=[0.0], b=[1.0]) == 0
    assert one(spark, col(X.embed_snippet, "n", "s", "d", "c"), n="a", s="b", d="c", c="x" * 600) == "a\nb\nc\n" + "x" * 512


BODY = """Intro *with* `code` and [link](/start/x) &amp; more.
Second line.

Next paragraph.

## Title ##

```js
if (a) {}
```

<Card a="b">
  inner

Setext
======

    indented

- item one
- item two

> quote

<Last/>
"""


def test_blocks():
    got = [(b.kind, b.content) for b in markdown.split_blocks(BODY)]
    assert got == [
        ("prose", "Intro with code and link & more.\nSecond line.Next paragraph."),
        ("heading", "Title"),
        ("code_fence", "```js\nif (a) {}\n```"),
        ("jsx", '<Card a="b">\n  inner'),
        ("heading", "Setext"),
        ("code_fence", "```\nindented\n```"),
        ("prose", "item oneitem twoquote"),
        ("jsx", "<Last/>"),
    ]
    assert [b.index for b in markdown.split_blocks(BODY)] == list(range(8))
    assert markdown.split_blocks("") == [] and [b.kind for b in markdown.split_blocks("```\nopen")] == ["code_fence"]
    assert [b.kind for b in markdown.split_blocks("```\na\n<b>\n```")] == ["code_fence", "jsx"]
    assert markdown.inline(r"\*a\* **b _c_** snake_case_name <http://x.y> ![alt](u) <i>t</i>") == "*a* b c snake_case_name http://x.y alt t"


def test_write_back():
    meta, blocks = {"title": "A: b", "x": "y"}, markdown.split_blocks("Text.\n\n```\nc\n```\n")
    text = markdown.serialize(meta, blocks)
    assert text == '---\ntitle: "A: b"\nx: y\n---\n\nText.\n\n```\nc\n```\n\n'
    new_meta, new = markdown.apply_updates(meta, blocks, {"frontmatter:title": "T", "body:0": "Neu.", "frontmatter:none": "z"}, blocks)
    assert new_meta == {"title": "T", "x": "y"} and [b.content for b in new] == ["Neu.", "```\nc\n```"]
    assert "<!-- TODO: translate -->" in markdown.stub(meta, blocks) and 'title: "[TODO] A: b"' in markdown.stub(meta, blocks)


def test_headings_links_tags(spark):
    df = spark.createDataFrame([(1, "# A\nx [[Note]] #tag\n## B c\ny\n"), (2, "none")], "id int, t string")
    assert [tuple(r) for r in markdown.headings(df, "t").orderBy("start_line").collect()] == [(1, "A", 1, 1, 2), (1, "B c", 2, 3, 4)]
    assert [tuple(r) for r in markdown.wiki_links(df, "t").collect()] == [(1, "Note", 2)]
    assert [tuple(r) for r in markdown.tags(df, "t").collect()] == [(1, "#tag", 2)]


@settings(max_examples=60, deadline=None)
@given(st.text("ab\n \x0b\r", max_size=40), st.text("ab\n \x0b\r", max_size=40))
def test_diff_round_trip(a, b):
    patch = diff.unified("p", a, b)
    if a or b:
        end = lambda t: t if t.endswith("\n") or not t else t + "\n"
        assert diff.apply(patch) == (end(a), end(b))
    else:
        assert patch == ""


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.lists(st.tuples(st.booleans(), st.integers(0, 30), st.integers(0, 8), st.text(max_size=5)), max_size=12))
def test_buffer(text, edits):
    b, plain = diff.Buffer(text), text
    for insert, at, n, new in edits:
        if insert:
            b.insert(at, new)
            plain = plain[:at] + new + plain[at:]
        else:
            b.delete(at, n)
            plain = plain[:at] + plain[at + n :]
    assert b.text() == plain and len(b) == len(plain)


def test_edit_column(spark):
    assert one(spark, diff.edit(F.col("t"), F.lit(1), F.lit(2), F.lit("XY")), t="abcd") == "aXYd"
    row = diff.with_diff(spark.createDataFrame([("p", "a\n", None)], "p string, a string, b string"), "p", "a", "b").first()
    assert row["patch"] == "--- a/p\n+++ b/p\n-a\n" and row["changed"]


def names(xs):
    return [x.name for x in xs]


def test_python_parser():
    p = code.parse_file('"""Doc."""\nfrom ..x import a as b, c\nimport os.path as q\n\n@dec\nclass K(Base, m.Mixin, metaclass=M):\n    """KD."""\n    async def f(self, a: int = 1, *args, k, **kw) -> str:\n        """FD."""\n        return self.g(q.join(a))\n\ndef top():\n    pass\n', "python")
    assert p.docstring == "Doc." and names(p.classes) == ["K"] and p.classes[0].bases == ["Base", "m.Mixin"] and p.classes[0].decorators == ["@dec"] and p.classes[0].docstring == "KD."
    f = p.classes[0].methods[0]
    assert (f.name, f.parameters, f.return_type, f.is_async, f.docstring, f.start_line, f.end_line) == ("f", ["self", "a", "*args", "k", "**kw"], "str", True, "FD.", 8, 10)
    assert [(i.module, i.names, i.level) for i in p.imports] == [("x", ["a", "c"], 2), ("os.path", ["os.path"], 0)]
    assert {(c.callee_name, c.qualifier) for c in p.calls} == {("g", "self"), ("join", "q")}
    broken = code.parse_file("class A(B):\n    def m(self, x=1):\n        return go(x)\n\ndef f(:\n", "python")
    assert names(broken.classes) == ["A"] and names(broken.classes[0].methods) == ["m"] and broken.classes[0].methods[0].parameters == ["self", "x"]


def test_javascript_parser():
    p = code.parse_file("/** Mod. */\nimport d, { a as b, c } from '../x';\nimport * as ns from \"y\";\nexport default class K extends B {\n  constructor(private a: string) { super(a); }\n  static async go(x = {y: 1}): Promise<void> { if (x) { call(x) } }\n}\n/** F. */\nexport async function f<T>(a: T, ...rest) { return ns.g(a); }\nexport const h = (z) => { f(z); };\nconst i = q => q + 1;\nfunction outer() { function inner() {} }\n", "typescript")
    assert p.docstring == "Mod." and names(p.classes) == ["K"] and p.classes[0].bases == ["B"] and names(p.classes[0].methods) == ["constructor", "go"]
    assert p.classes[0].methods[1].is_async and p.classes[0].methods[0].parameters == ["a"]
    assert names(p.functions) == ["f", "h", "i", "outer"] and p.functions[0].docstring == "F." and p.functions[0].parameters == ["a", "...rest"]
    assert [(i.module, i.names, i.level) for i in p.imports] == [("../x", ["d", "a", "c"], 2), ("y", ["ns"], 0)]
    assert {("call", None), ("g", "ns"), ("f", None), ("super", None)} == {(c.callee_name, c.qualifier) for c in p.calls}


def test_other_parsers():
    r = code.parse_file("//! Crate.\nuse a::b;\n/// S doc.\npub struct S { x: u8 }\ntrait T { fn t(&self); }\nimpl T for S {\n    /// M doc.\n    pub async fn m(&mut self, n: u8) -> u8 { self.k(n); a::go() }\n}\nfn main() { let s = \"fn no() {}\"; }\n", "rust")
    assert r.docstring == "Crate." and names(r.classes) == ["S", "T"] and names(r.classes[0].methods) == ["m"] and r.classes[0].docstring == "S doc." and names(r.functions) == ["main"]
    m = r.classes[0].methods[0]
    assert m.parameters == ["&mut self", "n"] and m.return_type == "u8" and m.is_async and m.docstring == "M doc."
    assert r.imports[0].module == "a.b" and ("go", "a") in {(c.callee_name, c.qualifier) for c in r.calls}
    g = code.parse_file('package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\ntype S struct { a int }\nfunc (s *S) M(a int, b string) error { fmt.Println(a) }\nfunc F() {}\n', "go")
    assert names(g.classes) == ["S"] and names(g.functions) == ["M", "F"] and [i.module for i in g.imports] == ["fmt", "a/b"] and ("Println", "fmt") in {(c.callee_name, c.qualifier) for c in g.calls}
    j = code.parse_file("import a.b.C;\nimport d.*;\n/** K. */\npublic class K extends L implements M {\n  public K(int a) { init(a); }\n  @Override\n  public List<String> go(String s, int n) throws E { return x.y(s); }\n}\ninterface I { void no(); }\n", "java")
    assert names(j.classes) == ["K", "I"] and j.classes[0].bases == ["L"] and names(j.classes[0].methods) == ["K", "go"] and [(i.module, i.names) for i in j.imports] == [("a.b.C", ["C"]), ("d", ["*"])]
    c = code.parse_file('#include <a.h>\n#include "b.h"\nstruct P { int x; };\nstatic int *f(const char *s, int n[]) { return g(s); }\nint main(void) { return 0; }\nint proto(int);\n', "c")
    assert names(c.classes) == ["P"] and names(c.functions) == ["f", "main"] and c.functions[0].parameters == ["s", "n"] and [i.module for i in c.imports] == ["a.h", "b.h"]
    assert code.parse_file("x", "ruby") is None
    assert code.clean_docstring("/**\n * A\n * b\n */") == "A\nb"


def test_import_targets(spark):
    f = lambda path, module, level: one(spark, graph.target_module(F.col("p"), F.col("m"), F.col("l")), p=path, m=module, l=level)
    assert f("pkg/sub/a.py", "x", 1) == "pkg.sub.x" and f("pkg/sub/a.py", "", 2) == "pkg" and f("pkg/sub/__init__.py", "x", 1) == "pkg.sub.x"
    assert f("pkg/a.py", "m.n", 0) == "m.n" and f("a.py", "x", 1) == ".x" and f("a.py", "x", 3) is None


class Letters:
    def embed(self, texts):
        return [[] if t.startswith("skip") else [float(t.count(c)) for c in "ab"] for t in texts]

    def score(self, query, documents):
        return [float(d.count(query)) for d in documents]


def test_vectors_and_rerank(spark):
    e = spark.createDataFrame([("1", "aab", None, None, "aa", "p", 1, "function"), ("2", "skip", None, None, "", "p", 2, "function"), ("3", "bb", "bsig", "bdoc", "b", "p", 3, "class")], "id string, name string, signature string, docstring string, code string, relative_path string, start_line int, element_type string")
    v = search.populate_vectors(e, Letters())
    assert {r["id"]: r["embedding"] for r in v.collect()} == {"1": [4.0, 1.0], "3": [0.0, 5.0]}
    new = search.upsert_vectors(v, spark.createDataFrame([("1", [9.0, 9.0])], "id string, embedding array<float>"))
    assert {r["id"]: r["embedding"] for r in new.collect()}["1"] == [9.0, 9.0] and new.count() == 2
    hits = search.search(e, [(0, "b")], vectors=v, query_vectors={0: [0.0, 1.0]})
    assert [r["id"] for r in hits.orderBy("rank").collect()] == ["3", "1"]
    assert [r["id"] for r in search.rerank(hits, [(0, "a")], Letters(), 2).orderBy("rank").collect()] == ["1", "3"]
    assert search.rerank(hits, [(0, "a")], None, 1).count() == 1
    assert search.cosine_top_k(v, [1.0, 0.0], 1).first()["id"] == "1"
    assert search.filter_elements(e.withColumn("file_path", F.lit("/r/p")), "class", "p").count() == 1


def test_providers(spark):
    todo = spark.createDataFrame([("p", "fr", f"body:{i}", f"t{i}") for i in range(5)], "relative_path string, target string, seg_key string, value string")
    assert {r["translated"] for r in providers.translate_segments(todo, providers.Mock(), chunk=2).collect()} == {f"[FR] t{i}" for i in range(5)}
    assert isinstance(providers.provider({"provider": "mock"}), providers.Mock)
    row = providers.token_budget(todo, prompt_bytes=400).first()
    assert (row["n"], row["tokens"], row["chunk_size"]) == (5, 105, 100)

    class Short(providers.Mock):
        def translate(self, texts, source, target):
            return texts[1:]

    with pytest.raises(Exception, match="translations for"):
        providers.translate_segments(todo, Short()).collect()


def test_stats(spark):
    df = spark.createDataFrame([(1, "a", "l"), (1, "b", "r"), (1, "a", "r"), (2, "x", "l"), (2, "x", "r"), (3, "q", "z")], "g int, k string, s string")
    assert sorted(tuple(r) for r in stats.key_sets(df, "g", "k", "s", "l", "r").collect()) == [(1, 0, 1, 1, False), (2, 0, 0, 1, True)]


def test_streams(spark, tmp_path):
    segments = spark.createDataFrame([("p", "body:0", "new", "h1", True), ("p", "body:1", "old", "h2", True)], "relative_path string, seg_key string, value string, hash string, translatable boolean")
    segments.write.parquet(str(tmp_path / "in"))
    lock = spark.createDataFrame([("p", "body:1", "h2")], "relative_path string, seg_key string, hash string")
    got = []
    stream = spark.readStream.schema(segments.schema).parquet(str(tmp_path / "in"))
    q = incremental.stream_pending(stream, lambda: lock, lambda df, n: got.extend(tuple(r) for r in df.collect()), ["fr"], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert got == [("p", "fr", "body:0", "new")]
    t = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(t, 1, "a", 1.0), (t + datetime.timedelta(minutes=10), 1, "a", 2.0), (t + datetime.timedelta(hours=3), 1, "b", 4.0)], "ts timestamp, user_id int, event_type string, value double")
    assert sorted(r["n"] for r in incremental.windowed_counts(events).collect()) == [1, 2]
    assert sorted(r["n"] for r in incremental.sessions(events).collect()) == [1, 2]


def test_needles_over_several_automata(spark, monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choices("abcé ", k=r.randint(0, 40))) for _ in range(60)] + [None, ""]
    needles = sorted({"".join(r.choices("abcé", k=r.randint(1, 6))) for _ in range(200)})
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    asked = spark.createDataFrame([(n,) for n in [*needles, None, needles[0]]], "needle string")
    want = sorted(n for n in needles if any(n in t for t in texts if t is not None))
    assert sorted(x[0] for x in drift.found_needles(df, "raw", asked).collect()) == want
    monkeypatch.setattr(drift, "NEEDLE_BYTES", 300)
    assert sorted(x[0] for x in drift.found_needles(df, "raw", asked).collect()) == want
    assert [x[0] for x in drift.found_needles(df, "raw", spark.createDataFrame([("",)], "needle string")).collect()] == [""]
    assert drift.found_needles(df, "raw", asked.limit(0)).count() == drift.found_needles(df.limit(0), "raw", asked).count() == 0


def test_enclosing_equals_brute_force(spark):
    r = random.Random(2)
    ranges = [(k, a, a + r.choice([0, 1, 3, 8, 40, 900]), i) for i, (k, a) in enumerate((r.choice("xyz"), r.randint(-50, 1000)) for _ in range(400))] + [("x", 5, 3, 999)]
    points = [(r.choice("xyzq"), r.randint(-60, 1100)) for _ in range(300)]
    got = graph.enclosing(spark.createDataFrame(points, "k string, p int"), spark.createDataFrame(ranges, "k string, a int, b int, id int"), ["k"], "p", "a", "b", ["a", "id"], ["id"])
    want = []
    for k, p in points:
        best = min(((b - a, a, i) for x, a, b, i in ranges if x == k and a <= p <= b), default=None)
        if best:
            want.append((k, p, best[2]))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 100


def test_embedders_and_rerankers(monkeypatch):
    for name in ("LOREKIT_EMBEDDING_API_KEY", "LOREKIT_LLM_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert providers.embedder() is None
    monkeypatch.setenv("LOREKIT_LLM_API_KEY", "k")
    monkeypatch.setenv("LOREKIT_LLM_BASE_URL", "http://second")
    assert providers.embedder() == providers.HttpEmbedder("http://second", "", "LOREKIT_LLM_API_KEY")
    monkeypatch.setenv("LOREKIT_EMBEDDING_API_KEY", "e")
    assert providers.embedder({}).key_variable == "LOREKIT_EMBEDDING_API_KEY"
    asked = []

    def post(url, body, key, timeout=60):
        asked.append(body.get("input"))
        if len(body.get("input", [])) > 1 or body.get("input") == ["bad"]:
            raise OSError
        if "rerank" in url:
            return {"results": [{"index": 1, "relevance_score": 2}, {"index": 0, "relevance_score": 1}]}
        return {"data": [{"index": 0, "embedding": [1.0]}]}

    monkeypatch.setattr(providers, "_post", post)
    assert providers.embedder().embed(["a", "bad", "c"]) == [[1.0], [], [1.0]] and asked[0] == ["a", "bad", "c"]
    assert providers.embedder().embed([]) == []
    assert providers.HttpReranker("http://r", "m").score("q", ["a", "b", "c"]) == [1.0, 2.0, float("-inf")]
    assert providers.OverlapReranker().score("a b", ["b a x", "a", ""]) == [1.0, 0.5, 0.0]
    assert providers.HashEmbedder(8).embed(["x y", "y x"])[0] == providers.HashEmbedder(8).embed(["y x"])[0]
