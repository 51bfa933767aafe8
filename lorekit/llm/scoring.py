"""LM scoring by prediction by partial matching (PPM) over the bytes of texts.

A text is coded as its lower-cased words, a space after each, and one end; it starts after ORDER ends, so every byte has
a context of ORDER bytes, which runs across words. The model is the trie of these contexts with the counts of the bytes
that follow. At a context with n observations of q symbols a symbol seen c times has probability (2c-1)/2n, an escape
q/2n (method D); after an escape the symbols of the longer context are excluded from the shorter ones; below order 0 the
remaining symbols are equally likely. The score of a text is the log10 probability of all its steps.

How it is spread: documents lie in chunks of bounded size. A chunk names its distinct words (64-bit hashes, for the base
score) and steps (context and symbol in one number) with their counts in training documents. Counts meet by step; the
trie is dealt by the last TAIL bytes of the context, so that a bucket holds whole subtries and codes their steps; the
costs travel back to the chunks that named the steps. What is gathered grows with the corpus: no step is left out.
Broadcast are only the counts of contexts shorter than TAIL, at most SYMBOLS ** TAIL entries of 16 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .wordhash import word_hashes

#: Longest context in bytes, from TAIL to 6, and the last bytes of it by which subtries are dealt.
ORDER, TAIL = 5, 3
#: Bytes that lower-cased UTF-8 words can hold (256 without 6 white spaces, 26 capitals and 13 that UTF-8 never uses), the gap and the end.
SYMBOLS, END, GAP = 213, b"\n", b" "
#: Bytes coded at a time, counts merged at a time, and steps in a bucket of the trie.
SLICE, MERGE, BUCKET = 1 << 19, 500_000, 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mask(k: int) -> int:
    """Bits of a step that its symbol and the last k bytes of its context take."""
    return (1 << 8 * (k + 1)) - 1


def spelt(text: str | None) -> bytes:
    """The bytes that are coded for a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return GAP.join([*words, END])


def steps(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps of coding spelt texts, as numbers, and the text of each, about SLICE at a time.

    In a number the symbol is lowest, then the context backwards.
    """
    plain = np.frombuffer(b"".join(END * order + x for x in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + order
    starts = np.cumsum(sizes) - sizes
    for a in range(0, len(plain), SLICE):
        since = max(0, a - order)
        part = plain[since : a + SLICE].astype(np.int64)
        out = part.copy()
        for k in range(1, order + 1):
            part <<= 8
            out[k:] |= part[:-k]
        place = np.arange(a, since + len(part))
        owner = np.searchsorted(starts, place, side="right") - 1
        coded = place - starts[owner] >= order
        yield out[a - since :][coded], owner[coded]


def slices(column: pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    """Where some rows start, and their texts as they are coded, about SLICE bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    since = 0
    while since < len(column):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[since:]), SLICE, side="right")))
        yield since, [spelt(x) for x in column.slice(since, n).to_pylist()]
        since += n


class Tally:
    """Counts of distinct values; what is added is merged when it has become MERGE values."""

    def __init__(self):
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(self, values: np.ndarray) -> None:
        self.pairs.append(np.unique(values, return_counts=True))
        if sum(len(v) for v, _ in self.pairs[1:]) > MERGE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values, sorted, and their counts."""
        values, n = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        by = np.argsort(values, kind="stable")
        values, n = values[by], n[by]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
        self.pairs = [(values[first], np.add.reduceat(n, first) if len(first) else n)]
        return self.pairs[0]


class Table:
    """Places of numbers in a sorted list of distinct ones, by one probe of a hash table in most cases."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.at = np.zeros(1 << int(np.uint64(64) - self.shift), np.int32)
        self.at[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * _ODD) >> self.shift

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of x, all of which are in the list."""
        at = self.at[self._slot(x)]
        other = np.flatnonzero(self.keys[at] != x)
        at[other] = np.searchsorted(self.keys, x[other])
        return at


def _lookup(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def edges_of(asked: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of length k with a symbol, as numbers, and how often they were seen."""
    values, place = np.unique(asked[n > 0] & _mask(k), return_inverse=True)
    out = np.zeros(len(values), np.int64)
    np.add.at(out, place, n[n > 0])
    return values, out


def costs(asked: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> np.ndarray:
    """log10 probability of each of some distinct steps, seen ``n`` times in training.

    ``low[k]`` are the counts of all steps with contexts cut to k bytes, for k below TAIL; those of longer contexts are
    summed from the steps, which must hold whole subtries: all steps that agree in the last TAIL bytes of context.
    """
    edges = [low[k] if k < len(low) else edges_of(asked, n, k) for k in range(order + 1)]
    nodes = []
    for values, counts in edges:
        context, first = np.unique(values >> 8, return_index=True)
        nodes.append((context, np.add.reduceat(counts, first) if len(first) else counts, np.diff(np.append(first, len(values))), first))
    out, escaped = np.zeros(len(asked)), np.zeros(len(asked))
    alive = np.ones(len(asked), bool)
    gone_n, gone_q = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)  # what the longer context excludes
    for k in range(order, -1, -1):
        step = asked & _mask(k)
        at, known = _lookup(nodes[k][0], step >> 8)
        if not len(nodes[k][0]):
            continue
        total, kinds = nodes[k][1][at] - gone_n, nodes[k][2][at] - gone_q
        use = alive & known & (kinds > 0)
        place, seen = _lookup(edges[k][0], step)
        hit, miss = use & seen, use & ~seen
        out[hit] = escaped[hit] + np.log10((2 * edges[k][1][place[hit]] - 1) / (2 * total[hit]))
        escaped[miss] += np.log10(kinds[miss] / (2 * total[miss]))
        alive &= ~hit
        if k:
            # Every symbol of this context has been seen in the shorter one as well: these counts leave it.
            shorter = edges[k - 1][1][np.searchsorted(edges[k - 1][0], edges[k][0] & _mask(k - 1))]
            excluded = np.add.reduceat(shorter, nodes[k][3])
            gone_n, gone_q = np.where(known, excluded[at], 0), np.where(known, nodes[k][2][at], 0)
    out[alive] = escaped[alive] - np.log10(max(1, SYMBOLS - len(edges[0][0])))
    return out


def held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is left out of the training: crc32 of its key as text, modulo ``folds``. A null key is ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds)) == fold


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of the input.

    Trains on the rows that are not held out and scores all. Null and empty texts are the end token alone. Repeated
    rows count as often as they occur; no training rows give a base of V = N = 0 and a uniform model. Other columns are
    not read.
    """
    if not TAIL <= order <= 6:
        raise ValueError(f"the order lies between {TAIL} and 6")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), held_out(F.col(key)).alias("_held"))
    docs = common.in_chunks(rows, "_text", "lm-texts", target_bytes=24 << 20, least=8)

    def count(t: pa.Table) -> pa.Table:
        held = np.asarray(t["_held"].to_pylist(), bool)
        found: dict[str, list[np.ndarray]] = {"word": [], "code": [], "n": []}
        parts = {(w, h): Tally() for w in (True, False) for h in (True, False)}
        for h in (True, False):
            for _, texts in slices(t["_text"].filter(pa.array(held == h))):
                parts[True, h].add(word_hashes(texts)[0].view(np.int64))
                for coded, _ in steps(texts, order):
                    parts[False, h].add(coded)
        for word in (True, False):
            (learnt, n), (other, _) = parts[word, False].merge(), parts[word, True].merge()
            fresh = other[~_lookup(learnt, other)[1]]
            found["word"].append(np.full(len(learnt) + len(fresh), word))
            found["code"] += [learnt, fresh]
            found["n"] += [n, np.zeros(len(fresh), np.int64)]
        out = {k: pa.array(np.concatenate(v)) for k, v in found.items()}
        return pa.table({"_chunk": pa.array(np.full(len(out["n"]), t["_chunk"][0].as_py()), pa.int32())} | out)

    asked = common.materialise(docs.groupBy("_chunk").applyInArrow(count, "_chunk int, word boolean, code long, n long"), "lm-asked")
    of_words = W.partitionBy("code")
    counted = asked.where("word").select("_chunk", "code", "n", F.sum("n").over(of_words).alias("all"), F.row_number().over(of_words.orderBy("_chunk")).alias("i"))
    words = common.materialise(counted.select("_chunk", "code", F.col("all").cast("double").alias("value"), "n", (F.col("i") == 1).alias("first")), "lm-words")
    seen, distinct = words.agg(F.sum("n"), F.count_if(F.col("first") & (F.col("value") > 0))).first()
    ends = docs.where(~F.col("_held")).count()
    total_tokens, distinct = (seen or 0) + ends, (distinct or 0) + (ends > 0)

    met = common.materialise(asked.where("NOT word").groupBy("code").agg(F.sum("n").alias("n")), "lm-steps")
    shared = spark.sparkContext.broadcast(_low(met))
    buckets = max(common.partitions(spark), -(-met.count() // BUCKET))
    tail = F.shiftright("code", 8).bitwiseAND(F.lit(_mask(TAIL - 1)))

    def cost(t: pa.Table) -> pa.Table:
        return pa.table({"code": t["code"], "value": pa.array(costs(t["code"].to_numpy(), t["n"].to_numpy(), shared.value, order))})

    dealt = met.withColumn("_bucket", F.pmod(F.xxhash64(tail), F.lit(buckets)))
    known = common.materialise(dealt.groupBy("_bucket").applyInArrow(cost, "code long, value double"), "lm-costs")
    common.discard(met)
    answers = asked.where("NOT word").select("_chunk", "code").join(known, "code").select("_chunk", F.lit(False).alias("word"), "code", "value")
    told = words.select("_chunk", F.lit(True).alias("word"), "code", "value").unionByName(answers)
    step = float(np.log10(total_tokens + distinct + 1))

    def add(t: pa.Table, told: pa.Table) -> pa.Table:
        word = told["word"].to_numpy()
        code, value = told["code"].to_numpy(), told["value"].to_numpy()
        tables = []
        for mine in (word, ~word):
            by = np.argsort(code[mine])
            tables.append((Table(code[mine][by]), value[mine][by]))
        cols: dict[str, np.ndarray] = {"n_tokens": np.zeros(len(t), np.int64), "n_known": np.zeros(len(t), np.int64), "base_score": np.zeros(len(t)), "score": np.zeros(len(t))}
        for i, texts in slices(t["_text"]):
            j = i + len(texts)
            hashes, sizes = word_hashes(texts)
            n = tables[0][1][tables[0][0].find(hashes.view(np.int64))]
            total = lambda x, doc=np.repeat(np.arange(j - i), sizes), m=j - i: np.bincount(doc, x, m)
            cols["n_tokens"][i:j] = sizes + 1
            cols["n_known"][i:j] = total(n > 0).astype(np.int64) + int(ends > 0)
            cols["base_score"][i:j] = total(np.log10(n + 1) - step) + np.log10(ends + 1) - step
            for coded, doc in steps(texts, order):
                cols["score"][i:j] += np.bincount(doc, tables[1][1][tables[1][0].find(coded)], j - i)
        out = {k: pa.array(v) for k, v in cols.items()}
        return pa.table({"_key": t["_key"], "held_out": t["_held"], "n_tokens": out["n_tokens"], "n_known": out["n_known"], "train_tokens": pa.array(np.full(len(t), total_tokens)), "base_score": out["base_score"], "score": out["score"]})

    kind = df.schema[key].dataType.simpleString()
    out = docs.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(add, f"_key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("_key", key)


def _low(met: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of all steps with contexts cut to less than TAIL bytes; at most SYMBOLS ** TAIL rows reach the driver."""
    short = F.col("code").bitwiseAND(F.lit(_mask(TAIL - 1)))
    rows = met.where("n > 0").groupBy(short.alias("code")).agg(F.sum("n").alias("n")).toArrow()
    code, n = rows["code"].to_numpy(), rows["n"].to_numpy()
    return [edges_of(code, n, k) for k in range(TAIL)]


def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of those that are not held out."""
    return score(common.table(spark, sf_dir, "documents"))
