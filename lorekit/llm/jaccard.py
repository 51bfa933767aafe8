"""N-gram Jaccard join by a token-group matrix.

Documents with the same shingle set form a class; from then on only classes count. Similar classes are partitioned
into groups, each with the union of its members' tokens; the matrix says which group holds which token. A class can
only be similar to a member of a group if the group's union has enough of its tokens, so this bound decides which
groups are opened and only members of opened groups are compared.

1. Groups: classes that agree in one of KEYS minima of hashed shingles are compared in cells of at most CELL classes;
   found links join them to groups (connected components). Any grouping is right; a good one saves work later.
2. Matrix: of each class the first floor((1-t)n)+1 shingles in one global order are indexed, for two sets of Jaccard
   t or more share one of these. The order is by hash, shingles that are frequent in a sample of classes last: which
   ones these are changes the work and never the result. The index has one row for each (shingle, group).
3. Bound: for two groups that share c indexed shingles no pair of members can overlap in more than
   c + max(n - prefix) shingles; where that is below what t asks for, nothing is opened.
4. Opened groups are compared in blocks, again with the union first: a member of one is compared to a block of the
   other only if enough of its shingles are in the block's union.

Links inside a group need no further search for the components, which are exact: its members are connected already.
The number of links of each document is counted afterwards, within components and in blocks; pairs are never listed.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .wordhash import mix, runs, word_hashes

#: Minima by which classes are grouped, and classes or members in a cell.
KEYS, CELL = 3, 256
#: Classes in a block of a component whose links are counted.
BLOCK = 1024
#: One text in SAMPLE is looked at for frequent shingles; those seen FREQUENT times or more, at most MAX_FREQUENT, come last in the order.
SAMPLE, FREQUENT, MAX_FREQUENT = 32, 4, 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text, A-Z lower-cased; fewer words are one shingle, none are none."""
    h, sizes = word_hashes([(t or "").encode("utf-8", "replace").lower() for t in texts])
    full = runs(h, k)
    ends = np.cumsum(sizes)
    out = []
    for i, n in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(full[i : i + n - k + 1]))
        else:  # the length tells a short text from a shingle
            out.append(mix(runs(h[i : i + n], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def links(sets: list[np.ndarray], queries: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Without queries: a spanning forest of the similar pairs of sets. With queries: (query, set) of one link of each query, if it has any.

    A set that is reached leaves the list, so a cluster costs about as many comparisons as it has members.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    union, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out: list[tuple[int, int]] = []

    def similar(x: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which of the sets ``among`` are similar to x; none if the union of all holds too little of x."""
        at = np.searchsorted(union, x)
        at = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == x)]
        if 100 * len(at) < percent * len(x):
            return among[:0]
        n = sizes[among]
        among = among[(100 * np.minimum(n, len(x)) >= percent * np.maximum(n, len(x))) & (n > 0)]
        if not len(among):
            return among
        has = np.zeros(len(union), bool)
        has[at] = True
        flat = np.concatenate([place[starts[i] : ends[i]] for i in among])
        common_ = np.add.reduceat(has[flat].astype(np.int64), np.cumsum([0, *sizes[among][:-1]]))
        return among[100 * common_ >= percent * (sizes[among] + len(x) - common_)]

    if queries is not None:
        for i, q in enumerate(queries):
            found = similar(q, np.arange(len(sets)))
            if len(found):
                out.append((i, int(found[0])))
        return out
    rest = np.arange(len(sets))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            v = front.pop()
            found = similar(sets[v], rest)
            out += [(v, int(u)) for u in found]
            front += found.tolist()
            rest = np.setdiff1d(rest, found, assume_unique=True)
    return out


def _late(df: DataFrame, k: int) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, at most MAX_FREQUENT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(0).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sets or [np.zeros(0, np.uint64)])), pa.int64())], names=["token"])

    sample = df.where(F.pmod(F.xxhash64("_text"), F.lit(SAMPLE)) == 0).groupBy(F.xxhash64("_text")).agg(F.min("_text").alias("_text")).select("_text")
    seen = sample.mapInArrow(run, "token long").groupBy("token").count()
    top = seen.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    return np.sort(top["token"].to_numpy().view(np.uint64))


def _sets_frame(df: DataFrame, k: int, percent: int) -> DataFrame:
    """(_key, _row, _n, _class, _keys, _prefix): size of the set, a hash of the set, its minima under KEYS hash functions, and the shingles of it to index."""
    kind = df.schema["_key"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(_late(df, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for b in common.sliced(batches):
            sets = shingle_sets(b.column(b.schema.get_field_index("_text")).to_pylist(), k)
            marks = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            minima = [[int(_signed(mix(s * _ODD + np.uint64(2 * i + 1)).min(keepdims=True))[0]) for i in range(KEYS)] if len(s) else [] for s in sets]
            prefixes = []
            for s in sets:
                if len(late) and len(s):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    s = s[np.argsort(late[at] == s, kind="stable")]  # by hash, frequent ones last
                prefixes.append(_signed(s[: len(s) * (100 - percent) // 100 + 1]))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("_key")),
                    b.column(b.schema.get_field_index("_row")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(marks, pa.int64()),
                    pa.array(minima, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]))),
                ],
                names=["_key", "_row", "_n", "_class", "_keys", "_prefix"],
            )

    return df.mapInArrow(run, f"_key {kind}, _row long, _n long, _class long, _keys array<long>, _prefix array<long>")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, count_links: bool = False) -> DataFrame:
    """(key, n_shingles, class_id, component_id), one row for each row of the input; class_id is the smallest key of the rows with an equal set.

    With ``count_links`` also ``n_links``, the number of other rows that a row links with: see ``_counted`` for its cost.

    Two rows link when 100 * intersection >= percent * union of their shingle sets. component_id is the smallest key
    that is reachable by links, the row's own included; null keys do not count, and it is null where no row has a key.
    Rows without words (null, empty, white space) link with nothing and get their own key. Repeated rows and equal keys
    with other texts are rows of their own. Other columns are not read.
    """
    since = common.made()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(key, text).alias("_row"))
    found = common.materialise(_sets_frame(rows, k, percent), "jaccard-found")
    # A class is named by one of its rows; only that row's text is carried on.
    one = found.where(F.col("_n") > 0).groupBy("_class").agg(F.min("_row").alias("id"), F.first("_n").alias("n"), F.first("_keys").alias("keys"), F.first("_prefix").alias("prefix"))
    named = common.materialise(one, "jaccard-named")
    marked = common.materialise(found.select("_key", "_n", "_class"), "jaccard-rows")
    worded = marked.where(F.col("_n") > 0)
    common.discard(found)
    texts = rows.groupBy(F.col("_row").alias("id")).agg(F.first("_text").alias("text"))
    classes = common.materialise(texts.join(named.select("id", "n"), "id"), "jaccard-classes", bucket="id")

    first = common.materialise(_grouped(named, classes, k, percent), "jaccard-links")
    groups = components(first)
    opened = common.materialise(_opened(named, groups, percent), "jaccard-opened")
    more = common.materialise(_across(classes, groups, opened, k, percent), "jaccard-across")
    common.discard(opened, first)
    label = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    renamed = more
    for c in ("a", "b"):
        renamed = renamed.join(groups.select(F.col("v").alias(c), F.col("comp").alias(f"_{c}")), c, "left")
    across = components(renamed.select(label("a"), label("b")))

    whole = groups.join(across.select(F.col("v").alias("comp"), F.col("comp").alias("_up")), "comp", "left").select("v", F.coalesce("_up", "comp").alias("comp"))
    alone = across.select("v", "comp").join(groups.select("v"), "v", "left_anti")  # classes that are in no group of several
    labels = whole.unionByName(alone)
    least = worded.groupBy("_class").agg(F.min("_key").alias("_min"), F.count(F.lit(1)).alias("_rows"))
    of_class = named.select("_class", "id").join(labels.select(F.col("v").alias("id"), "comp"), "id", "left").join(least, "_class")
    of_class = common.materialise(of_class.select("_class", "id", "_min", "_rows", F.coalesce("comp", "id").alias("_comp")), "jaccard-members")
    # Written, so that the join that follows reads two plain tables and a large component can be split.
    ends = common.materialise(of_class.groupBy("_comp").agg(F.min("_min").alias("component_id")), "jaccard-ends")
    final = of_class.join(ends, "_comp").select("_class", "id", "_rows", F.col("_min").alias("class_id"), "component_id")
    used, columns = [marked, of_class, ends], ["class_id", "component_id"]
    if count_links:
        used.append(common.materialise(_counted(of_class, classes, k, percent), "jaccard-counts"))
        columns.append("n_links")
        final = final.join(used[-1], "id", "left").withColumn("n_links", F.col("_rows") - 1 + F.coalesce("links", F.lit(0)))
    common.keep_only(since, *used)
    out = worded.select("_key", "_n", "_class").join(final.select("_class", *columns), "_class", "left")
    empty = marked.where(F.col("_n") == 0).select("_key", "_n", "_class").withColumns({"class_id": F.col("_key"), "component_id": F.col("_key"), "n_links": F.lit(0).cast("long")})
    out = out.unionByName(empty.select("_key", "_n", "_class", *columns))
    return out.select(F.col("_key").alias(key), F.col("_n").alias("n_shingles"), *columns)


def _counted(of_class: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, links) of classes in components of several: how many rows of other classes each links with.

    Similarity does not carry over from link to link, so each two classes of a component have to be compared: m classes
    are m(m-1)/2 comparisons. They are made in pairs of blocks of BLOCK classes and only counts leave a block, so pairs
    are never listed; a text is sent to m/BLOCK tasks. Classes of different components do not link.
    """
    sizes = common.materialise(of_class.groupBy("_comp").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "jaccard-sizes")
    blocks = F.ceil(F.col("m") / BLOCK)
    own = of_class.join(sizes, "_comp").select("_comp", "id", "_rows", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("own"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = other.select("id", "_rows", F.xxhash64("_comp", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), (F.col("own") == F.least("own", "other")).alias("first"), (F.col("own") == F.col("other")).alias("alone"))
    full = placed.join(classes.select("id", "text"), "id")

    def count(t: pa.Table) -> pa.Table:
        ids, rows = t["id"].to_numpy(), t["_rows"].to_numpy()
        first, alone = np.asarray(t["first"].to_pylist(), bool), bool(t["alone"][0].as_py())
        links = linked_rows(shingle_sets(t["text"].to_pylist(), k), rows, np.ones(len(ids), bool) if alone else first, alone, percent)
        return pa.table({"id": pa.array(ids), "links": pa.array(links)})

    return full.groupBy("pair").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def linked_rows(sets: list[np.ndarray], rows: np.ndarray, first: np.ndarray, alone: bool, percent: int) -> np.ndarray:
    """For each set how many rows stand behind the similar sets of the other side; of all others where a block meets itself (``alone``)."""
    n = np.array([len(s) for s in sets], np.int64)
    union, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    side = np.flatnonzero(~first) if not alone else np.arange(len(sets))
    flat = np.concatenate([place[ends[j] - n[j] : ends[j]] for j in side] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(side)), n[side])
    out, has = np.zeros(len(sets), np.int64), np.zeros(len(union), bool)
    for i in np.flatnonzero(first):
        mine = place[ends[i] - n[i] : ends[i]]
        has[mine] = True
        shared = np.bincount(owner[has[flat]], minlength=len(side))
        has[mine] = False
        hit = side[100 * shared >= percent * (n[side] + n[i] - shared)]
        hit = hit[hit != i]
        out[i] += rows[hit].sum()
        if not alone:
            out[hit] += rows[i]
    return out


def _grouped(named: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among classes that share a minimum, searched in cells of about CELL classes.

    Classes that all share their first minimum meet there, and not once more for another one.
    """
    keyed = named.select("id", F.get("keys", F.lit(0)).alias("own"), F.posexplode("keys").alias("i", "key"))
    several = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("m"), F.min("own").alias("x"), F.max("own").alias("y")).where((F.col("m") > 1) & ((F.col("i") == 0) | (F.col("x") != F.col("y"))))
    several = common.materialise(several, "jaccard-shared")  # so that the join reads two plain tables and a hot minimum can be split
    cells = F.ceil(F.col("m") / CELL)
    placed = keyed.select("id", "i", "key").join(several.select("i", "key", "m"), ["i", "key"]).select("id", F.xxhash64("i", "key", F.pmod(F.xxhash64("id", "i"), cells)).alias("cell"))
    full = placed.join(classes.select("id", "text"), "id")

    def search(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        found = links(shingle_sets(t["text"].to_pylist(), k), None, percent)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return full.groupBy("cell").applyInArrow(search, "a long, b long")


def _opened(named: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (g, h) that the bound does not rule out."""
    known = named.join(groups.select(F.col("v").alias("id"), "comp"), "id", "left").select(F.coalesce("comp", "id").alias("g"), "n", F.explode("prefix").alias("token"))
    matrix = known.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    several = matrix.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where(F.col("x") != F.col("y")).select("token")
    cells = common.materialise(matrix.join(several, "token"), "jaccard-matrix")
    other = cells.select("token", F.col("g").alias("h"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = cells.join(other, "token").where((F.col("g") < F.col("h")) & (100 * F.col("high") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low")))
    met = pairs.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("low2").alias("low2"), F.max("high2").alias("high2"))
    # The shorter prefix, in the common order, lies below the end of the other, so its shared part is counted whole.
    rest = lambda n: n - (F.floor(n * (100 - percent) / 100) + 1)
    most = F.col("c") + F.greatest(rest(F.col("high")), rest(F.col("high2")))
    return met.where((100 + percent) * most >= percent * (F.col("low") + F.col("low2"))).select("g", "h")


def _across(classes: DataFrame, groups: DataFrame, opened: DataFrame, k: int, percent: int) -> DataFrame:
    """One link for each member of the smaller group of an opened pair to a block of the larger, where there is one."""
    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    pairs = opened
    for c in ("g", "h"):
        pairs = pairs.join(sizes.select(F.col("comp").alias(c), F.col("m").alias(f"m{c}")), c, "left").withColumn(f"m{c}", F.coalesce(f"m{c}", F.lit(1)))
    small = F.col("mg") <= F.col("mh")
    pairs = pairs.select(F.when(small, F.col("g")).otherwise(F.col("h")).alias("q"), F.when(small, F.col("h")).otherwise(F.col("g")).alias("s"), F.ceil(F.greatest("mg", "mh") / CELL).alias("blocks"))
    # Only ids are dealt out; a group that is no component is its one member.
    of = lambda df, c: df.join(groups.select(F.col("v").alias("id"), F.col("comp").alias(c)), c, "left").withColumn("id", F.coalesce("id", c))
    sets = of(pairs.select("s", "blocks").distinct(), "s").select("s", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id")
    askers = of(pairs, "q").select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id")
    # A block meets its askers in parts of about CELL, with a copy of the block for each.
    # Both are written, so that the joins on (s, block) read plain tables and a large block can be split.
    askers = common.materialise(askers, "jaccard-askers")
    parts = common.materialise(askers.groupBy("s", "block").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts")), "jaccard-parts")
    askers = askers.join(parts, ["s", "block"]).select("s", "block", "id", F.lit(True).alias("asks"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    sets = sets.join(parts, ["s", "block"]).select("s", "block", "id", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    full = askers.unionByName(sets).join(classes.select("id", "text"), "id")

    def search(t: pa.Table) -> pa.Table:
        ids, asks = t["id"].to_numpy(), np.asarray(t["asks"].to_pylist(), bool)
        all_sets = shingle_sets(t["text"].to_pylist(), k)
        q, s = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = links([all_sets[i] for i in s], [all_sets[i] for i in q], percent) if len(q) and len(s) else []
        return pa.table({"a": pa.array([ids[q[i]] for i, _ in found], pa.int64()), "b": pa.array([ids[s[j]] for _, j in found], pa.int64())})

    return full.groupBy("s", "block", "part").applyInArrow(search, "a long, b long")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 of 100 on shingles of four words, and each document's number of links."""
    return join(common.table(spark, sf_dir, "documents"), count_links=True)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN 'short ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
k AS (SELECT doc_id, md5(string_agg(sh, ' | ' ORDER BY sh)) AS k FROM s GROUP BY doc_id), m AS (SELECT k, min(doc_id) AS class_id FROM k GROUP BY k),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
l AS (SELECT a, count(*) AS n_links FROM u GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(class_id, doc_id) AS class_id, min(b) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM d JOIN r ON doc_id = r.a LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN m USING (k) LEFT JOIN l ON l.a = doc_id GROUP BY ALL
"""
