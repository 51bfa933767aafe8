import math
import zlib
from collections import Counter

import numpy as np

from lorekit.llm import scoring


def tokens(text):
    return (text or "").encode().lower().split()


def transitions(text, order):
    s = scoring.END * order + b"".join(w + b" " for w in tokens(text)) + scoring.END
    return [(s[i - order : i], s[i]) for i in range(order, len(s))]


def test_steps(monkeypatch):
    texts = ["", "a", None, " Ab\t\ncd  ", "é😀", "x" * 30]
    for order in (3, 5, 6):
        monkeypatch.setattr(scoring, "SLICE", 7)
        coded, owner = map(np.concatenate, zip(*scoring.steps([scoring.spelt(t) for t in texts], order), strict=True))
        got = [(bytes(reversed(int(x).to_bytes(8, "little")[1 : order + 1])), int(x) & 255) for x in coded]
        assert got == [y for t in texts for y in transitions(t, order)]
        assert np.bincount(owner).tolist() == [len(transitions(t, order)) for t in texts]


def trie_of(texts, order):
    trie = {}
    for t in texts:
        for ctx, s in transitions(t, order):
            for k in range(len(ctx) + 1):
                trie.setdefault(ctx[len(ctx) - k :], Counter())[s] += 1
    return trie


def prob(trie, ctx, s):
    p, gone = 1.0, set()
    for k in range(len(ctx), -1, -1):
        node = {x: n for x, n in trie.get(ctx[len(ctx) - k :], {}).items() if x not in gone}
        if node:
            m, q = sum(node.values()), len(node)
            if s in node:
                return p * (2 * node[s] - 1) / (2 * m)
            p, gone = p * q / (2 * m), gone | node.keys()
    return p / max(1, scoring.SYMBOLS - len(gone))


def plain(rows, order=scoring.ORDER):
    """PPM by hand: one trie of all training transitions, walked for every byte."""
    kept = [t for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    c = Counter(w for t in kept for w in [*tokens(t), scoring.END])
    trie = trie_of(kept, order)
    total, size = sum(c.values()), len(c)
    known = {}
    out = []
    for d, t in rows:
        w = [*tokens(t), scoring.END]
        mine = 0.0
        for y in transitions(t, order):
            if y not in known:
                known[y] = math.log10(prob(trie, *y))
            mine += known[y]
        out.append((d, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + size + 1)) for x in w), mine))
    return out


def test_probabilities_of_a_context_sum_to_one():
    """Over all symbols, at seen and unseen contexts, with the subtries dealt as the operator deals them."""
    order = 4
    train = ["the cat sat on the mat", "the dog", "a cat and a dog", "é x"]
    steps, n = np.unique(next(scoring.steps([scoring.spelt(t) for t in train], order))[0], return_counts=True)
    low = [scoring.edges_of(steps, n, k) for k in range(scoring.TAIL)]
    symbols = [b for b in range(256) if b not in (9, 11, 12, 13, *range(65, 91), 0xC0, 0xC1, *range(0xF5, 256))]
    assert len(symbols) == scoring.SYMBOLS
    number = lambda ctx, s: int.from_bytes(bytes([s]) + bytes(reversed(ctx)), "little")
    trie = trie_of(train, order)
    for ctx in (b"the ", b" cat", b"\n\n\n\n", b"zzzz", b"qqth", b"he d"):
        asked = np.union1d(steps, [number(ctx, s) for s in symbols])
        counts = np.zeros(len(asked), np.int64)
        counts[np.searchsorted(asked, steps)] = n
        got = scoring.costs(asked, counts, low, order)
        mine = {int(a) & 255: 10**c for a, c in zip(asked, got, strict=True) if int(a) >> 8 == number(ctx, 0) >> 8}
        assert len(mine) == len(symbols) and abs(sum(mine.values()) - 1) < 1e-9
        assert all(abs(mine[s] - prob(trie, ctx, s)) < 1e-12 for s in symbols)


def test_table():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    asked = np.random.default_rng(2).permutation(np.repeat(keys, 3))
    table = scoring.Table(keys)
    assert (keys[table.find(asked)] == asked).all()
    assert len(scoring.Table(keys[:0]).find(asked[:0])) == 0


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3])
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) < 1e-6


def test_equals_plain_ppm(spark):
    rows = [(i, t) for i, t in enumerate(["The cat sat on the mat", "the CAT sat", None, "", "é😀 x", "a" * 3000, "the cat sat on the mat", " \t\n", "zzz qqq the"] * 3)]
    rows += [(None, "the end"), (None, None), (4, "é😀 x"), (4, "é😀 x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    close(scoring.score(df).collect(), plain(rows))


def test_documents_and_held_out_fit(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = scoring.op9_scoring(spark, "/root/testdata/sf0.001").collect()
    close(got, plain(rows))
    # Held-out code length: below three bits a byte, and below that of shorter contexts.

    held = {x.doc_id: x.score for x in got if x.held_out}
    size = sum(len(w) + 1 for d, t in rows if d in held for w in tokens(t))
    assert held and -sum(held.values()) / math.log10(2) < 3 * size
    for order in (1, 2):
        assert sum(held.values()) > sum(x[5] for x in plain(rows, order) if x[0] in held)


def test_contexts_cross_words_and_long_texts(spark):
    rows = [(i, "alpha beta gamma delta") for i in range(40)] + [(100, "delta gamma beta alpha"), (101, "alpha beta gamma delta"), (102, "word " * 100_000), (103, "w" * 300_000)]
    got = scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    close(got, plain(rows))
    by = {r.doc_id: r for r in got}
    assert by[101].score > by[100].score + 1 and abs(by[101].base_score - by[100].base_score) < 1e-9


def test_no_training_rows_and_empty_table(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    df = spark.createDataFrame([(i, "only held out") for i in ids], "doc_id long, text string")
    close(scoring.score(df).collect(), plain([(i, "only held out") for i in ids]))
    assert scoring.score(df.limit(0)).count() == 0
