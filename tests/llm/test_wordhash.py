import random

import numpy as np

from lorekit.llm import wordhash


def test_words_and_runs(monkeypatch):
    r = random.Random(4)
    texts = [b"", b"  ", b"a", b"a b\x0bc\r\n d ", "é ü x 😀".encode(), b"x" * 5000 + b" y"] + [bytes(r.choice(b"ab \n") for _ in range(r.randint(0, 50))) for _ in range(300)]
    wide = wordhash.word_hashes(texts)
    assert wide[1].tolist() == [len(t.split()) for t in texts]
    words = [w for t in texts for w in t.split()]
    seen = dict(zip(words, wide[0].tolist(), strict=True))
    assert all(seen[w] == h for w, h in zip(words, wide[0].tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    monkeypatch.setattr(wordhash, "BLOCK", 64)
    wordhash._tables.cache_clear()
    assert np.array_equal(wordhash.word_hashes(texts[:5] + texts[6:])[0], np.delete(wide[0], sum(len(t.split()) for t in texts[:5]) + np.arange(2)))
    long = wordhash.word_hashes([b"z" * 64, b"z" * 65, b"z" * 1000, b"z" * 1000])[0]
    assert long[2] == long[3] and len(set(long.tolist())) == 3
    wordhash._tables.cache_clear()
    assert wordhash.word_hashes([])[0].size == 0


def test_runs_tell_order():
    h = wordhash.word_hashes([b"a b c d e f g h a b c"])[0]
    for n in range(1, 12):
        got = wordhash.runs(h, n)
        want = [tuple(b"abcdefghabc"[i : i + n]) for i in range(11 - n + 1)]
        assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))
    assert wordhash.runs(h, 12).size == 0


def test_tables_are_deleted(spark, tmp_path):
    import os

    from lorekit.llm import common, jaccard

    since = common.made()
    folder = f"{common.shared_dir(spark)}/lorekit"
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = spark.createDataFrame([(i, f"a b c d e f g h i {i % 3}") for i in range(30)], "doc_id long, text string")
    assert jaccard.join(df).count() == 30
    left = set(os.listdir(folder)) - there
    assert len(left) == 3, left
    plain, bucketed = common.materialise(df, "x"), common.materialise(df.limit(0), "y", bucket="doc_id")
    assert bucketed.count() == 0
    common.discard(bucketed, df)
    common.keep_only(since, plain)
    assert plain.count() == 30 and len(set(os.listdir(folder)) - there) == 1
    common.discard(plain)
    assert set(os.listdir(folder)) == there and not spark.sql("SHOW TABLES").where("tableName LIKE 'y%' OR tableName LIKE 'jaccard%'").count()
