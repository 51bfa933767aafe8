"""Substring dedup: words covered by a window whose word sequence also starts earlier are removed.

1. Passages recur where phrases do. In each window of ``window`` words the phrase (a run of ``seed`` words) with the
   least hash is marked, so two equal windows mark the same phrase. A chunk of documents names the hashes of its marked
   phrases; those that are named twice are candidates.
2. Chunks spell their candidates out, and the spellings meet: a phrase is confirmed where its words stand at two places
   or more. Confirmed phrases go back to the chunks that spelt them.
3. A chunk compiles its confirmed phrases into Aho-Corasick automata, shards of the whole set of at most PHRASES phrases,
   and streams all its documents through them. Only windows around a hit are looked at further. They meet the equal
   windows of other chunks, and all but the first place of each go.

Chunks have a bounded size and every table between the steps has at most one row for each chunk and phrase or window, so
a passage that a third of all documents share is one row a chunk. Windows are compared by 96 bits (two independent
polynomials over 64-bit hashes of words): at 10^13 distinct windows, those of 100 TB, the chance that any two of them
are taken for one is below 1 in 1000.
"""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .wordhash import mix, runs, word_hashes

WINDOW, SEED = 20, 8
#: Phrases in one automaton; their words need less than 32^4 numbers.
PHRASES = 50_000
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class Chunk:
    """Words of the documents of a chunk, each distinct (key, text) once.

    Documents are held in the order of starts, so an earlier place is a smaller number.
    """

    def __init__(self, t: pa.Table):
        order, tie = t["_order"].to_numpy(), t["_tie"].to_numpy()
        by = np.lexsort((tie, order))
        new = np.ones(len(by), bool)
        new[1:] = (order[by][1:] != order[by][:-1]) | (tie[by][1:] != tie[by][:-1])
        #: Document of each row.
        self.of_row = np.empty(len(by), np.int64)
        self.of_row[by] = np.cumsum(new) - 1
        one = by[new]
        self.order, self.tie = order[one], tie[one]
        self.texts = [(x or "").encode("utf-8", "replace") for x in t["_text"].take(pa.array(one)).to_pylist()]

    def read(self, window: int) -> None:
        """Hash the words and find the places where a whole window starts."""
        self.hashes, self.sizes = word_hashes(self.texts)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        ends = np.repeat(self.starts[1:], self.sizes)
        #: Whether a whole window starts at a word.
        self.whole = np.arange(len(self.hashes)) + window <= ends

    def seeds(self, seed: int) -> np.ndarray:
        """Hash of the ``seed`` words from each place on."""
        return runs(self.hashes, seed)

    def windows(self, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits that stand for the words of the windows at these places."""
        return runs(self.hashes, window)[places], (runs(mix(self.hashes ^ _OTHER), window)[places] >> np.uint64(32)).astype(np.int64)


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    out, step = values, 1
    while step * 2 <= n:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(values) - n + 1], out[n - step : n - step + len(values) - n + 1]) if len(values) >= n else values[:0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def automata(chunk: Chunk, phrases: list[bytes], seed: int) -> np.ndarray:
    """Whether one of the phrases starts at each place of the chunk's words.

    An automaton takes PHRASES phrases. Their words are numbered from 1, all other words are 0, and a number is four
    digits of base 32 with an alphabet for each digit: nodes have few children, and a match can only begin at a word.
    """
    found = np.zeros(len(chunk.hashes), bool)
    for i in range(0, len(phrases), PHRASES):
        spelt, sizes = word_hashes(phrases[i : i + PHRASES])
        if (sizes != seed).any():
            raise ValueError("a phrase has the words of a seed")
        used, number = np.unique(spelt, return_inverse=True)
        at = np.minimum(np.searchsorted(used, chunk.hashes), len(used) - 1)

        def text(numbers: np.ndarray) -> str:
            digits = np.stack([(numbers >> 5 * k) % 32 + 32 * k for k in range(4)], 1).astype(np.uint8)
            return digits.tobytes().decode("latin-1")

        patterns = text(number + 1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in range(0, len(patterns), 4 * seed):
            automaton.add_word(patterns[p : p + 4 * seed])
        automaton.make_automaton()
        ends = np.fromiter((end for end, _ in automaton.iter(text(np.where(used[at] == chunk.hashes, at + 1, 0)))), np.int64)
        found[(ends + 1) // 4 - seed] = True
    # A hit that runs over the end of a document lies in none.
    return found & (np.arange(len(found)) + seed <= np.repeat(chunk.starts[1:], chunk.sizes))


def around(chunk: Chunk, found: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Places of the windows whose marked phrase is among those found."""
    bit = np.uint64(1)
    flagged = (chunk.seeds(seed) & ~bit) | found[: max(0, len(found) - seed + 1)].astype(np.uint64)
    first = least(flagged, window - seed + 1)
    return np.flatnonzero(((first & bit) == 1) & chunk.whole[: len(first)])


def find(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_removed, kept): one row for each row of the input; ``kept`` is the remaining words joined by a space.

    Order of starts: smaller key, null last; among rows of one key, smaller hash of the text, then place. Repeated rows
    (same key and text) count as one document: they get the same result, that of the first. Null and empty texts have no
    words. The key must be an integer. Other columns are not read.
    """
    # A null key counts as the largest; the tie among equal keys is broken by a hash of the text, the same on every run.
    order = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), order.alias("_order"), F.xxhash64(text).alias("_tie"))
    docs = common.in_chunks(rows, "_text", "substring-texts")

    def of(t: pa.Table, n: int) -> pa.Array:
        return pa.array(np.full(n, t["_chunk"][0].as_py()), pa.int32())

    def mark(t: pa.Table) -> pa.Table:
        c = Chunk(t)
        c.read(window)
        h = c.seeds(seed)
        first = least(h, window - seed + 1)
        all_, n = np.unique(h, return_counts=True)
        marked = np.unique(first[c.whole[: len(first)]])
        n = n[np.searchsorted(all_, marked)]
        return pa.table({"_chunk": of(t, len(marked)), "seed": _signed(marked), "n": pa.array(np.minimum(n, 2), pa.int32())})

    marked = docs.groupBy("_chunk").applyInArrow(mark, "_chunk int, seed long, n int")
    named = marked.withColumn("all", F.sum("n").over(W.partitionBy("seed"))).where(F.col("all") > 1).select("_chunk", "seed")
    candidates = common.materialise(named, "substring-seeds")

    def spell(t: pa.Table, r: pa.Table) -> pa.Table:
        if not len(r):
            return pa.table({"_chunk": of(t, 0), "phrase": pa.array([], pa.binary()), "n": pa.array([], pa.int32())})
        c = Chunk(t)
        c.read(window)
        wanted = np.sort(r["seed"].to_numpy())
        h = c.seeds(seed).view(np.int64)
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        places = np.flatnonzero((wanted[at] == h) & (np.arange(len(h)) + seed <= np.repeat(c.starts[1:], c.sizes)[: len(h)]))
        spelt: dict[bytes, int] = {}
        since = 0
        for x, i, j in zip(c.texts, c.starts[:-1].tolist(), c.starts[1:].tolist(), strict=True):
            upto = since + int(np.searchsorted(places[since:], j)) if since < len(places) else since
            if upto > since:
                w = x.split()
                for p in (places[since:upto] - i).tolist():
                    phrase = b" ".join(w[p : p + seed])
                    spelt[phrase] = spelt.get(phrase, 0) + 1
            since = upto
        return pa.table({"_chunk": of(t, len(spelt)), "phrase": pa.array(list(spelt), pa.binary()), "n": pa.array([min(n, 2) for n in spelt.values()], pa.int32())})

    spelt = docs.groupBy("_chunk").cogroup(candidates.groupBy("_chunk")).applyInArrow(spell, "_chunk int, phrase binary, n int")
    confirmed = spelt.withColumn("all", F.sum("n").over(W.partitionBy("phrase"))).where(F.col("all") > 1).select("_chunk", "phrase")
    phrases = common.materialise(confirmed, "substring-phrases")
    common.discard(candidates)
    located_as = "_chunk int, hash long, more long, order long, tie long, at int, place int"

    def locate(t: pa.Table, r: pa.Table) -> pa.Table:
        c = Chunk(t)
        c.read(window)
        where = around(c, automata(c, r["phrase"].to_pylist(), seed), window, seed) if len(r) and len(c.hashes) else np.zeros(0, np.int64)
        hashes, more = c.windows(where, window)
        by = np.lexsort((where, more, hashes))
        new = np.ones(len(by), bool)
        new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (more[by][1:] != more[by][:-1])
        # One row for the first place of each window, in the order of documents, and one for each run of later places.
        first = np.sort(by[new])
        later = np.sort(where[by[~new]])
        head = np.ones(len(later), bool)
        head[1:] = later[1:] > later[:-1] + 1
        tail = np.append(head[1:], True)[: len(later)]
        d = np.searchsorted(c.starts, where[first], side="right") - 1
        n = int(head.sum())
        pad = lambda x, fill: pa.concat_arrays([x, pa.array(fill, x.type)]) if n else x
        nulls = pa.nulls(n, pa.int64())
        return pa.table(
            {
                "_chunk": of(t, len(first) + n),
                "hash": pad(_signed(hashes[first]), nulls),
                "more": pad(pa.array(more[first], pa.int64()), nulls),
                "order": pad(pa.array(c.order[d], pa.int64()), nulls),
                "tie": pad(pa.array(c.tie[d], pa.int64()), nulls),
                "at": pad(pa.array(where[first] - c.starts[d], pa.int32()), (later[tail] - later[head] + window).astype(np.int32)),
                "place": pad(pa.array(where[first], pa.int32()), later[head].astype(np.int32)),
            }
        )

    located = docs.groupBy("_chunk").cogroup(phrases.groupBy("_chunk")).applyInArrow(locate, located_as)
    place = F.struct("order", "tie", "at")
    # A chunk is told its windows whose first place lies elsewhere; runs of later places inside it it has named itself.
    met = located.withColumn("first", F.min(place).over(W.partitionBy("hash", "more", F.when(F.col("hash").isNull(), F.col("place")))))
    told = met.where(F.col("hash").isNull() | (F.col("first") != place)).select("_chunk", "place", F.when(F.col("hash").isNull(), F.col("at")).otherwise(F.lit(window)).alias("size"))
    told = common.materialise(told, "substring-places")
    common.discard(phrases)

    def remove(t: pa.Table, r: pa.Table) -> pa.Table:
        c = Chunk(t)
        words = [x.split() for x in c.texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        gone = np.zeros(int(starts[-1]) + 1, np.int64)
        if len(r):
            p = r["place"].to_numpy()
            np.add.at(gone, p, 1)
            np.add.at(gone, p + r["size"].to_numpy(), -1)
        out = np.cumsum(gone)[:-1] > 0
        removed = np.diff(np.concatenate(([0], np.cumsum(out)))[starts])
        stays = (~out).tolist()
        kept = [b" ".join(compress(w, stays[i : i + len(w)]) if n else w).decode() for w, i, n in zip(words, starts.tolist(), removed.tolist(), strict=False)]
        rows = pa.array(c.of_row)
        return pa.table({"_key": t["_key"], "n_words": pa.array(sizes).take(rows), "n_removed": pa.array(removed).take(rows), "kept": pa.array(kept, pa.string()).take(rows)})

    kind = df.schema[key].dataType.simpleString()
    out = docs.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(remove, f"_key {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("_key", key)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated windows of twenty words."""
    out = find(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER next AS seq, count(*) OVER next AS n FROM p WINDOW next AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY seq, n = 20 ORDER BY doc_id, i) > 1 AS later FROM s),
c AS (SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
