"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

A candidate run of characters is scored by the log-likelihood ratio of its character transitions under two bigram
models, both trained from labelled samples; runs above a threshold are reported as kind ``markov``. Where a pattern
covers part of a run, the pieces that it leaves are scored instead. Ordinary samples are words of the texts themselves,
whatever their languages, and names as programs have them, joined as identifiers, paths and compounds are; random ones
are digests in the usual alphabets, with and without digits. All of it is one projection over the text. The trained table
has one number for each pair of symbols of a fixed alphabet, whatever the input, so it goes into the plan as a constant.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: kind, pattern, group whose length counts, least length; in the order in which kinds are listed.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # maximal runs: the same as the short ones of [0-9a-f]+ dropped
)
KINDS = (*[p[0] for p in PATTERNS], "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
#: Characters in a candidate, or in what patterns leave of one, at least.
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/=_-]{%d,}" % LEAST
#: Mean log-likelihood ratio a transition, in nats, from which a candidate counts as random.
THRESHOLD = 0.5
PLACEHOLDER = "[SECRET]"

#: Parts of names in programs, for the labelled samples.
PARTS = (
    "user name account customer order item price total index value count list array map set get put add remove delete update create read write open close start stop begin end "
    "first last next previous current parent child node tree graph table row column field record file path folder directory image video audio message text string number integer "
    "float double boolean date time second minute hour day week month year session request response server client service handler manager factory builder controller view model "
    "config option setting default public private static final class function method object module package import export version release build test check valid error warning "
    "information debug log trace event listener queue stack buffer cache memory storage device network address port host domain page title header footer content section summary"
).split()
#: Labelled samples of each kind at most, and texts whose words they take.
SAMPLES, TEXTS = 4000, 2000


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _joined(parts: Column, salt: Column) -> Column:
    """Some words as one string: a compound, an identifier, a path."""
    style = F.pmod(_hash(salt, F.lit("style")), F.lit(8))
    number = F.pmod(_hash(salt, F.lit("number")), F.lit(1000)).cast("string")
    glue = lambda c: F.array_join(parts, c)
    capitals = F.array_join(F.transform(parts, F.initcap), "")
    return (
        F.when(style == 0, glue("_"))
        .when(style == 1, F.concat(F.lower(parts[0]), F.substring(capitals, F.length(parts[0]) + 1, F.length(capitals))))
        .when(style == 2, F.concat(glue("-"), F.lit("-"), number))
        .when(style == 3, glue("/"))
        .when(style == 4, F.upper(glue("_")))
        .when(style == 5, F.concat(capitals, number))
        .otherwise(glue(""))
    )


def labelled_samples(spark: SparkSession, n: int = SAMPLES, docs: DataFrame | None = None, text: str = "text", fold: int = 0) -> DataFrame:
    """(text, label): n random strings (1), n names of programs and n strings of words of the texts (0); other folds give others.

    About TEXTS distinct texts are read for their words, chosen by hash. Without texts there are no words.
    """
    i = F.concat(F.lit(f"{fold}:"), F.col("id").cast("string"))
    raw = F.concat(*[F.unhex(F.sha2(F.concat(F.lit(f"random{k}:"), i), 256)) for k in range(2)])
    coded = F.regexp_replace(F.base64(raw), "\\s", "")
    letters = F.regexp_replace(coded, "[^A-Za-z]", "")
    size = (F.pmod(_hash(i, F.lit("size")), F.lit(24)) + LEAST).cast("int")
    kinds = [coded, F.translate(coded, "+/=", "-_"), F.regexp_replace(coded, "[^A-Za-z0-9]", ""), letters, F.lower(letters), F.lower(F.regexp_replace(coded, "[^A-Za-z0-9]", "")), F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")), F.lower(F.hex(raw))]
    random = F.substring(F.element_at(F.array(*kinds), (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int")), F.lit(1), size)
    part = lambda k: F.element_at(F.array(*[F.lit(p) for p in PARTS]), (F.pmod(_hash(i, F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    rows = spark.range(0, n, 1, 1)
    out = rows.select(random.alias("text"), F.lit(1).alias("label")).unionByName(rows.select(_joined(F.array(*[part(k) for k in range(4)]), i).alias("text"), F.lit(0).alias("label")))
    if docs is None:
        return out
    every = max(1, docs.count() // TEXTS)
    named = docs.where(F.length(text) > 0).select(F.col(text).alias("t"), _hash(F.col(text), F.lit(fold)).alias("h"))
    some = named.where(F.pmod("h", F.lit(every)) == 0).groupBy("h").agg(F.min("t").alias("t"))
    found = F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0))
    fours = common.let(found, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(4)), lambda k: F.slice(w, k, 4)))
    words = some.select(F.explode(fours).alias("w")).where(F.size("w") == 4).orderBy(_hash("w", F.lit(fold)), "w").limit(n)
    return out.unionByName(words.select(_joined(F.col("w"), F.array_join("w", " ")).alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of transitions, row by row over the alphabet (index 0: any other symbol).

    The counts have at most 2 x (len(ALPHABET) + 1)^2 rows and are read on the driver. Null texts and labels other
    than 0 and 1 are passed over; without samples every ratio is 0.
    """
    k = len(ALPHABET) + 1
    chars = F.split("text", "")
    symbol = lambda c: F.call_function("instr", F.lit(ALPHABET), c)
    pairs = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.struct(symbol(F.get(chars, i - 1)).alias("a"), symbol(F.get(chars, i)).alias("b")))
    counted = samples.where((F.length("text") > 1) & F.col("label").isin(0, 1)).select("label", F.explode(pairs).alias("p")).groupBy("label", "p.a", "p.b").count().collect()
    counts = [[[smoothing] * k for _ in range(k)] for _ in range(2)]
    for r in counted:
        counts[r["label"]][r["a"]][r["b"]] += r["count"]
    out = []
    for a in range(k):
        totals = [sum(counts[y][a]) for y in range(2)]
        out += [round(math.log(counts[1][a][b] / totals[1]) - math.log(counts[0][a][b] / totals[0]), 6) for b in range(k)]
    return out


#: Elements that a running fold takes at a time, so that long arrays are not copied at each step.
_BLOCK = 256
_NO_SPANS = "array<struct<start:int,end:int,rank:int,value:string>>"


def before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of ints the fold of those before it, from 0 on."""
    zero = F.lit(0)

    def folded(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(_BLOCK)), lambda s: F.size(v) > 0)
        step = lambda a, x: F.array_append(a, combine(F.element_at(a, -1), x))
        totals = F.transform(starts, lambda s: F.aggregate(F.slice(v, s, _BLOCK), zero, combine))

        def blocks(offsets: Column) -> Column:
            inner = F.transform(starts, lambda s, k: F.aggregate(F.slice(v, s, _BLOCK), F.array(F.get(offsets, k)), step, lambda a: F.slice(a, 1, F.size(a) - 1)))
            return F.flatten(inner)

        return common.let(F.aggregate(totals, F.array(zero), step), blocks)

    return common.let(values, folded)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, end, rank, value) of the matches of one kind, in order, short ones left out."""
    p, rank = F.lit(pattern), F.lit(KINDS.index(kind))
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("all"), (F.regexp_extract_all(text, p, F.lit(group)) if group else F.regexp_extract_all(text, p, F.lit(0))).alias("part"))

    def placed(f: Column) -> Column:
        sizes = F.transform(f["all"], lambda m, i: F.length(m) + F.length(F.get(f["gaps"], i)))

        def spans(since: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(since, i) + F.length(F.get(f["gaps"], i))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), rank.alias("rank"), F.get(f["part"], i).alias("value"))

            return F.filter(F.transform(f["all"], one), lambda x: F.length(x["value"]) >= least)

        return common.let(before(sizes, lambda a, x: a + x), spans)

    return F.when(text.rlike(pattern), common.let(found, placed)).otherwise(F.array().cast(_NO_SPANS))


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of a string; null below two characters."""
    k = len(ALPHABET) + 1
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    symbol = lambda c: F.call_function("instr", F.lit(ALPHABET), c)
    ids = F.transform(F.split(value, ""), symbol)

    def mean(s: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda a, i: a + F.get(table, F.get(s, i - 1) * k + F.get(s, i)))
        return F.when(F.size(s) > 1, total / (F.size(s) - 1))

    return common.let(ids, mean)


def _outside(run: Column, base: Column) -> Column:
    """The pieces of a candidate of at least LEAST characters that lie outside all base spans, as spans of its rank."""
    met = F.array_sort(F.filter(base, lambda x: (x["start"] < run["end"]) & (run["start"] < x["end"])))

    def cut(spans: Column) -> Column:
        # A piece lies before each span and after the last; it starts where all earlier spans have ended.
        stops = F.array_append(F.transform(spans, lambda x: x["start"]), run["end"])
        ends = F.transform(spans, lambda x: x["end"] - run["start"])
        begins = F.transform(before(F.array_append(ends, F.lit(0)), lambda a, x: F.greatest(a, x)), lambda a: a + run["start"])

        def piece(stop: Column, i: Column, since: Column) -> Column:
            begin = F.get(since, i)
            return F.struct(begin.alias("start"), stop.alias("end"), run["rank"].alias("rank"), F.substring(run["value"], begin - run["start"] + 1, stop - begin).alias("value"))

        return common.let(begins, lambda since: F.filter(F.transform(stops, lambda s, i: piece(s, i, since)), lambda x: x["end"] - x["start"] >= LEAST))

    return F.when(F.size(met) > 0, common.let(met, cut)).otherwise(F.array(run))


def scan(df: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``spans``: array of (start, end, rank, value) by start, then kind; offsets in code points, end exclusive.

    Null and empty texts have no spans. Each row is scanned alone and whole. A column named ``spans`` gives way.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[_spans(t, *p) for p in PATTERNS])

    def with_markov(b: Column) -> Column:
        pieces = F.flatten(F.transform(_spans(t, "markov", CANDIDATE, 0, LEAST), lambda s: _outside(s, b)))
        added = F.filter(pieces, lambda s: ratio(s["value"], model) >= threshold)
        key = F.transform(F.concat(b, added), lambda s: F.struct(s["start"], s["rank"], s["end"], s["value"]))
        return F.transform(F.array_sort(key), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["value"].alias("value")))

    return df.withColumn("spans", common.let(base, with_markov))


def redact(df: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """The same rows with every span of ``text`` replaced by a placeholder; overlapping spans by one. Null stays null.

    A column named ``spans`` is left out.
    """
    found = scan(df, model, text)
    t = F.col(text)

    def clean(ended: Column) -> Column:
        between = lambda s, i: F.when(s["start"] >= F.get(ended, i), F.concat(F.substring(t, F.get(ended, i) + 1, s["start"] - F.get(ended, i)), F.lit(PLACEHOLDER))).otherwise("")
        rest = F.substring(t, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(t))
        return F.concat(F.array_join(F.transform("spans", between), ""), rest)

    ended = before(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    return found.withColumn(text, F.when(F.size("spans") > 0, common.let(ended, clean)).otherwise(t)).drop("spans")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(spark, docs=docs))).select("doc_id", F.col("spans").alias("s"))
    of = lambda r: F.size(F.filter("s", lambda x: x["rank"] == r)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(told(F.filter("s", lambda x: x["rank"] < len(PATTERNS))), 256).alias("base_sha256"),
        told(F.col("s")).alias("spans"),
        of(3).alias("n_markov"),
    )


#: The base spans, for texts in which the models find no further string.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES ('assign', 0, 12), ('access', 1, 18), ('hex', 2, 16)) AS v(kind, rank, least)),
m AS (SELECT doc_id, kind, rank, least,
  CASE rank WHEN 0 THEN regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS found,
  CASE rank WHEN 0 THEN regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS part,
  CASE rank WHEN 0 THEN regexp_split_to_array(t, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') WHEN 1 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+') ELSE regexp_split_to_array(t, '[0-9a-f]+') END AS gaps FROM d, p),
e AS (SELECT doc_id, kind, rank, least, unnest(found) AS f, unnest(part) AS g, unnest(gaps[1:len(found)]) AS gap, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0),
s AS (SELECT doc_id, kind, rank, least, length(f) AS n, length(g) AS size, (sum(length(gap) + length(f)) OVER (PARTITION BY doc_id, rank ORDER BY i))::BIGINT AS stop FROM e),
k AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, rank) AS spans FROM s WHERE size >= least GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, 0::BIGINT AS n_markov FROM d LEFT JOIN k USING (doc_id)
"""
