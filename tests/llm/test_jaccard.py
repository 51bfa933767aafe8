import random

import numpy as np
import pytest

from lorekit.llm import jaccard
from lorekit.llm.components import components


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    post, links = {}, [0] * len(rows)
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in post[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted((repr(d), len(s), repr(low.get(root(i))), links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    return sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id), x.n_links) for x in jaccard.join(df, count_links=True, **kw).collect())


def corpus(seed, n, words=300):
    r = random.Random(seed)
    text = lambda m: [f"w{r.randint(0, words)}" for _ in range(m)]
    rows, bases = [], [text(r.randint(5, 120)) for _ in range(12)]
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.7 else text(r.randint(0, 60))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            if w:
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 1)] = text(r.randint(0, 2))
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [256, 8])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "BLOCK", 4 * cell)
    rows = corpus(1, 600)
    assert run(spark, rows) == plain(rows)


def test_other_parameters_and_odd_rows(spark):
    rows = corpus(2, 120) + [(None, None), (None, ""), (900, " \n"), (901, "a"), (902, "A"), (903, "a b c"), (904, "a b  C"), (905, "a b"), (None, "a b c"), (1, "x y z w v"), (1, "x y z w v"), (1, "other")]
    rows += [(950, "q " * 5000), (951, "Q " * 4000)]
    for k, percent in ((5, 80), (3, 50)):
        assert run(spark, rows, k=k, percent=percent) == plain(rows, k, percent)
    assert run(spark, []) == []


def test_groups_that_minima_miss(spark, monkeypatch):
    """With a useless grouping the matrix finds all links by itself."""
    monkeypatch.setattr(jaccard, "_grouped", lambda named, classes, k, percent: classes.sparkSession.createDataFrame([], "a long, b long"))
    rows = corpus(3, 300)
    assert run(spark, rows) == plain(rows)


def test_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id), x.n_links) for x in jaccard.op3_jaccard(spark, path).collect())
    assert got == plain(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, j) for j in range(101, 200)] + [(300, 300), (7, 3), (3, 7)]
    random.Random(5).shuffle(edges)
    got = {x.v: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(range(1, 61)) | set(range(100, 200))
    assert len({got[i] for i in range(1, 61)}) == len({got[i] for i in range(100, 200)}) == 1 and got[1] != got[100]


def test_short_texts_are_no_shingles():
    a, b = jaccard.shingle_sets(["a b c", "a b c d"], 4)
    assert len(a) == len(b) == 1 and not np.intersect1d(a, b).size
