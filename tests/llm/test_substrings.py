import hashlib
import random

from lorekit.llm import substrings


def plain(rows, window=20):
    """Windows of every document in order of (key, null last); one entry for each distinct row."""
    split = lambda t: (t or "").encode().split()
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.setdefault(k, (d, i))
        out[d, t] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return sorted([(repr(d), *out[d, t]) for d, t in rows])


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    return sorted((repr(x.doc_id), x.n_words, x.n_removed, x.kept) for x in substrings.find(df).collect())


def test_equals_brute_force_on_shared_passages(spark):
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "ab", "é", "c,", "D"])
    text = lambda n: " ".join(word() + str(r.randint(0, 50)) for _ in range(n))
    passages = [text(n) for n in (19, 20, 21, 55, 300)]
    rows = []
    for i in range(150):
        parts = [text(r.randint(0, 40)) for _ in range(3)] + r.sample(passages, r.randint(0, 3))
        r.shuffle(parts)
        rows.append((r.randint(0, 10**6) * 1000 + i, " \n".join(parts)))
    rows += [(7, None), (8, ""), (9, " \t\n"), (10, "x " * 70), (11, "x " * 20), (12, "x " * 19), (13, "p q " * 500), (None, passages[3])]
    rows += [(14, rows[0][1]), (14, rows[0][1]), (5, passages[4] + " " + passages[4]), (6, "w " * 100)]
    assert run(spark, rows) == plain(rows)


def test_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = {eval(d): (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in plain(rows)}
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.op6_substrings(spark, path).collect()} == want
    assert sum(g for _, g, _ in want.values()) > 0


def test_empty_table_and_one_common_passage(spark):
    assert substrings.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"start{i} {passage} end{i}") for i in range(400)]
    assert run(spark, rows) == plain(rows)


def test_automaton_alone_decides_and_windows_of_one_hash_stay_apart(spark, monkeypatch):
    import pyarrow as pa
    import numpy as np

    word = [f"w{i}" for i in range(60)]
    rows = pa.table({"_chunk": pa.array([0, 0], pa.int32()), "_key": [1, 2], "_text": [" ".join(word), " ".join(word[30:] + word[:30])], "_order": pa.array([1, 2]), "_tie": pa.array([5, 6])})
    chunk = substrings.Chunk(rows)
    chunk.read(20)
    phrase = " ".join(word[3:11]).encode()
    found = substrings.automata(chunk, [phrase, b"a b c d e f g h"], 8)
    assert np.flatnonzero(found).tolist() == [3, 93] and not substrings.automata(chunk, [], 8).any()
    assert not len(substrings.around(chunk, np.zeros(len(chunk.hashes), bool), 20, 8))
    # All windows agree in their first 64 bits here: the other 32 tell them apart.
    plain_windows = substrings.Chunk.windows
    monkeypatch.setattr(substrings.Chunk, "windows", lambda self, places, n: (np.zeros(len(places), np.uint64), plain_windows(self, places, n)[1]))
    first, more = chunk.windows(np.array([0, 1, 60]), 20)
    assert len(set(first.tolist())) == 1 and len(set(more.tolist())) == 3


def test_many_rows_of_one_key_and_text_and_a_long_text(spark):
    same = " ".join(f"s{i % 37}" for i in range(90))
    rows = [(1, same)] * 40 + [(None, same)] * 40 + [(2, " ".join(f"l{i * i % 1009}" for i in range(60_000)))] + [(None, None)] * 5
    assert run(spark, rows) == plain(rows)
