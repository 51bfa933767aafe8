"""Sharding, mixing and quality rules against plain Python, on odd rows and on the small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekit.llm import common, mixing, quality, queries, sharding
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one two three", "a b c d e " * 30, "same line here\nsame line here\n\nother", "x" * 100_000, "é😀 ñ " * 50, "THE LOUD WORDS GO ON AND ON AND ON!!", "a | b | c | d | e", "w### x&&& y%%% z*** a b c d e f g h"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert oracle.spark_rows(queries.QUERIES[name](spark, FOLDER)) == oracle.sql_rows(oracle.connect(FOLDER), queries.ORACLE[name])


# Sharding.


def shard(key, shards):
    u = lambda i: int(hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:12], 16) / 2**48 + 2**-49
    return min((-math.log(u(i)) / w, i) for i, w in shards)[1]


def test_rendezvous(spark):
    keys = [None, "", "7", "7", *map(str, range(3000))]
    df = spark.createDataFrame([(k, "old") for k in keys], "k string, shard string")
    shards, grown = [(0, 1.0), (1, 2.0), (5, 1.0)], [(0, 1.0), (1, 2.0), (5, 1.0), (9, 4.0)]
    got = sharding.assign(df, "k", shards, grown).collect()
    assert len(got) == len(keys)
    for x in got:
        assert x["shard"] == shard(x["k"], shards) and x["grown_shard"] in (x["shard"], 9)
    n = Counter(x["shard"] for x in got)
    assert abs(n[1] / len(keys) - 0.5) < 0.05
    assert abs(sum(x["grown_shard"] == 9 for x in got) / len(keys) - 0.5) < 0.05
    with pytest.raises(ValueError):
        sharding.assign(df, "k", [])


def test_slots_and_query(spark):
    out = sharding.op5_sharding(spark, FOLDER).collect()
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(x.doc_id for x in out) == sorted(texts)
    slots = {}
    for x in out:
        t = (texts[x.doc_id] or "").encode()
        assert (x["size"], x.text_crc32, x.law) == (len(t) + 1, zlib.crc32(t), "key") and x["shard"] == shard(x.doc_id, [(i, 1.0) for i in range(8)])
        slots.setdefault(x["shard"], []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rows = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 3, "doc_id long, t string")
    same = sharding.with_slots(sharding.assign(rows, "doc_id", [(0, 1.0)]))
    assert sorted(x.slot for x in same.collect()) == list(range(53))
    assert sharding.with_slots(sharding.assign(rows.limit(0), "doc_id", [(0, 1.0)])).count() == 0


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    sharding.write_shards(sharding.assign(df, "doc_id", [(0, 1.0), (1, 1.0)]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50 and (tmp_path / "out/shard=0").is_dir()


# Mixing.


def water(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        open_ -= full
    return out


@pytest.mark.parametrize("sizes, share", [({"a": 100, "b": 50, "c": 10, None: 7}, 1.5), ({"a": 1, "b": 1, "c": 1000}, 1.5), ({"x": 5}, 1.5), ({"a": 0, "b": 4}, 1.5), ({"a": 0, "b": 0}, 1.5), ({"a": 3, "b": 4}, 2.5), ({f"s{i}": i * i for i in range(1, 30)}, 1.5)])
def test_targets(spark, sizes, share):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x.source: x.target for x in mixing.targets(df, share=share).collect()}
    want = water(sizes, share=share) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_copies_and_mix(spark):
    rows = [(i, "w " * (i % 90), f"s{i % 4}" if i % 5 else None, i, 3) for i in range(2000)] + [(None, None, None, None, 1), (7, "a b", "s1", None, None), (7, "a b", "s1", None, None), (8, "", "empty", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies int")
    size = common.word_count(F.col("text"))
    out = mixing.copies(df, "doc_id", size).collect()
    assert len(out) == len(rows)
    words = lambda t: len((t or "").encode().split())
    totals = Counter()
    for _, t, s, *_ in rows:
        totals[s] += words(t)
    want, taken = water(totals), Counter()
    for x in out:
        assert x["size"] == words(x.text) and x.source_size == totals[x.source] and 0 <= x.copies <= 2 and abs(x.target - want[x.source]) < 1e-6
        taken[x.source] += x.copies * x["size"]
    assert all(abs(taken[s] - want[s]) <= 90 for s in want)
    assert sorted(map(repr, mixing.copies(df, "doc_id", size).collect())) == sorted(map(repr, out))
    mixed = mixing.mix(df, "doc_id", size)
    assert mixed.columns == df.columns and mixed.count() == sum(x.copies for x in out)
    assert mixing.copies(df.limit(0), "doc_id", size).count() == 0


# Quality rules.


def repeated(words):
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(hit)


def test_base_counts_and_odd_texts(spark):
    docs = [x.text for x in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD + docs)], "doc_id long, text string, n_words int")
    for x in quality.judge(df).collect():
        t = x.text or ""
        w = [y.decode() for y in t.encode().split()]
        lines = [y for y in t.split("\n") if y.encode().split()]
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated(w))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base, t[:80]
        assert x.base_failed == (len(w) < 10 or 100 * base[4] > 20 * len(w)) and not (x.kept and x.base_failed)
        assert (x.cleaned is None) == (x.text is None)


def test_verdicts_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    both = quality.op8_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert good.kept.mean() > 0.99 and bad.kept.mean() < 0.15


def test_lines_that_fail(spark):
    clean = "The plain words of a good line stand here, and they end well."
    bad = ["w### x&&& y%%% z***", "Home | News | Shop | About", "ALL THESE WORDS ARE SHOUTED AT THE READER NOW", "go! no! ho! wo! yo! lo! mo! to!", "buy buy buy buy buy buy buy buy buy buy", "All rights reserved by us."]
    for line in bad:
        row = quality.judge(spark.createDataFrame([(f"{clean}\n{line}\n{clean[:-1]}!",)], "text string")).first()
        assert row.cleaned == f"{clean}\n{clean[:-1]}!" and row.n_lost == len(line.split()), line
    assert quality.judge(spark.createDataFrame([], "text string")).count() == 0


def test_columns_of_the_input_stay(spark):
    clean = "This is a plain sentence with enough words to stand here, and it ends well."
    df = spark.createDataFrame([(1, clean, "s", 7, 8, 9, 10, 11, 12)], "doc_id long, text string, source string, _v int, _class int, _piece int, _rank int, _copy int, _source int")
    extra = ["_v", "_class", "_piece", "_rank", "_copy", "_source"]
    for out in (quality.judge(df), quality.keep(df), mixing.copies(df, "doc_id", common.word_count(F.col("text"))), mixing.mix(df, "doc_id", common.word_count(F.col("text"))), sharding.with_slots(sharding.assign(df, "doc_id", [(0, 1.0)]))):
        assert [out.first()[c] for c in extra] == [7, 8, 9, 10, 11, 12]


def test_long_clean_line_and_lines_without_marks(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(4000)]
    long = " ".join(r.choice(words) + ("," if i % 9 == 0 else "") for i in range(60_000)) + "."
    bare = " ".join(r.sample(words, 40))
    spam = "buy now, cheap pills " * 200
    policy = "our privacy policy"
    paragraph = " ".join(r.choice(words) for _ in range(60)) + ", " + policy + "."
    got = {x.text: x for x in quality.judge(spark.createDataFrame([(t,) for t in (long, bare, spam, policy, paragraph, "Politique et mentions LÉGALES ici")], "text string")).collect()}
    assert got[long].n_lost == 0 and got[bare].n_lost == 40 and got[spam].n_lost == 800
    assert got[policy].n_lost == 3 and got[paragraph].n_lost == 0 and got["Politique et mentions LÉGALES ici"].n_lost == 5


def test_taken_words_are_near_the_targets(spark):
    out = mixing.op2_mixing(spark, "/root/testdata/sf0.01")
    by = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("most")).collect()
    # A document is taken whole, so one that makes up most of its source leaves a gap of a part of itself.
    assert all(abs(x.n - x.t) <= max(0.02 * x.t, 0.5 * x.most) for x in by)
    assert sum(abs(x.n - x.t) <= 0.01 * x.t for x in by) > 0.8 * len(by)
