import hashlib

import corpus_pipeline as cp
from lorekit.llm import jaccard, mixing, quality, secrets
from tests.llm.test_jaccard import plain as near
from tests.llm.test_secrets import plain as base_spans


def test_stages_on_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    before = docs
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        after = cp.common.materialise(stage(spark, before, path), "test")
        assert sorted(after.columns) == sorted(columns) and dict(after.dtypes) == dict(docs.dtypes)
        seen[name] = (before, after)
        before = after
    a, b = seen["quality rules"]
    want = {x.doc_id: x.cleaned for x in quality.judge(a).collect() if x.kept}
    assert {x.doc_id: x.text for x in b.collect()} == want and len(want) > 100
    a, b = seen["n-gram Jaccard join"]
    rows = [(x.doc_id, x.text) for x in a.collect()]
    assert sorted(x.doc_id for x in b.collect()) == sorted({int(c) for _, _, c, _ in near(rows, 5, 80)})
    a, b = seen["secret scans"]
    assert a.count() == b.count() and not any(base_spans(x.text) for x in b.collect())
    a, b = seen["mixing sources"]
    copies = {x.doc_id: x.copies for x in mixing.copies(a, "doc_id", cp.common.word_count(a["text"])).collect()}
    got = {}
    for x in b.collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + 1
    assert got == {d: n for d, n in copies.items() if n}
    out = cp.encode(spark, before, path).collect()
    texts = {x.doc_id: x.text for x in before.collect()}
    assert len(out) == before.count()
    assert all(x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest() and x.n_tokens == len(x.ids) for x in out)


def test_odd_documents(spark):
    good = "This is a plain sentence with enough words to stand here. " * 1 + "It says one more thing, and then it ends."
    rows = [(1, good, "en", "a", 5, "x"), (1, good, "en", "a", 5, "x"), (2, good, None, None, None, None), (None, good + " Tail.", "en", None, 1, None), (3, None, "en", "a", 0, ""), (4, "", "en", "b", 0, ""), (5, good + " token = 'abcdefghijklmnop'", "en", "b", 9, "")]
    rows.append((6, "\n".join(" ".join(f"word{i * 10 + j}," for j in range(10)) + "." for i in range(6000)), "en", "c", 1, ""))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in cp.STAGES:
        df = cp.common.materialise(stage(spark, df, ""), "odd")
    ids = {x.doc_id for x in df.collect()}
    assert ids <= {1, 5, 6, None} and {1, 6} <= ids
    assert df.where("doc_id = 6").first()["n_tokens"] > 100_000
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        empty = cp.common.materialise(stage(spark, empty, ""), "empty")
    assert empty.count() == 0


def test_null_and_repeated_ids_with_unrelated_texts(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    ids = [(None, 1), (None, 2), (None, 3), (None, 3), (5, 4), (5, 5), (-7, 6), (0, 7), (1, 8), (1, 7), (None, 7), (9, 3), (9, 9), (9, 9)]
    rows = [(d, text(n), "en", "a", 0) for d, n in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((repr(x.doc_id), x.text) for x in cp.deduplicate(spark, df, "").collect())
    assert got == sorted((repr(d), text(n)) for d, n in [(None, 1), (None, 2), (9, 3), (5, 4), (5, 5), (-7, 6), (0, 7), (1, 8), (9, 9)])


def test_run_matches_stages(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256"]
    assert jaccard.join and secrets.scan
