"""Line-first cleaning: rules judge every line, failing lines go, and a text that loses too much is rejected.

Everything is one projection over the text: no shuffle, no Python. Lines are split at \\n. A line without words is
neither judged nor counted as lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A line fails when ...
MAX_SYMBOL_SHARE = 5  # ... more than this many of its words in a hundred end in one of the symbols below,
MAX_SEPARATOR_SHARE = 20  # ... more than this many of its words are bare separators, as in menus,
MAX_CAPITAL_SHARE = 60  # ... more than this many of its letters are capitals, in a line of MIN_JUDGED words,
MAX_SHOUT_SHARE = 30  # ... more than this many of its words end in ! or ?, in a line of MIN_JUDGED words,
MIN_DISTINCT_SHARE = 20  # ... fewer than this many of its words, or of MAX_JUDGED if it has more, are distinct, in a line of MIN_JUDGED words,
MIN_JUDGED, MAX_JUDGED = 8, 500
MIN_MARKED = 30  # ... it has this many words and no mark of punctuation among them,
MARKS = r"[.,;:!?…。，、；：！？]"
#: ... or it has at most MAX_PHRASE words and one of these phrases, in one of four languages. Letters that case folding treats differently are written out.
MAX_PHRASE = 40
BOILERPLATE = r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|click here to|subscribe to our newsletter|skip to (?:main )?content|tous droits r[eéÉ]serv[eéÉ]s|mentions l[eéÉ]gales|accepter (?:tous )?les cookies|alle rechte vorbehalten|datenschutzerkl[aäÄ]rung|cookies akzeptieren|todos los derechos reservados|pol[iíÍ]tica de privacidad|aceptar (?:todas )?las cookies"
#: A text is rejected when more than this many of its words in a hundred stand in failing lines.
MAX_LOST_SHARE = 40

_COUNT = lambda text, pattern: F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """Verdict on one line that has a word."""

    def judge(parts: Column) -> Column:
        n = parts["n"]
        return (
            (parts["symbols"] * 100 > n * MAX_SYMBOL_SHARE)
            | (parts["separators"] * 100 > n * MAX_SEPARATOR_SHARE)
            | ((n >= MIN_JUDGED) & ((parts["capitals"] * 100 > parts["letters"] * MAX_CAPITAL_SHARE) | (parts["shouts"] * 100 > n * MAX_SHOUT_SHARE)))
            | ((n >= MIN_JUDGED) & (F.size(F.array_distinct(F.split(F.trim(line), common.SPACE))) * 100 < F.least(n, F.lit(MAX_JUDGED)) * MIN_DISTINCT_SHARE))
            | ((n >= MIN_MARKED) & ~line.rlike(MARKS))
            | ((n <= MAX_PHRASE) & line.rlike(BOILERPLATE))
        )

    parts = F.struct(
        _COUNT(line, common.WORD).alias("n"),
        _COUNT(line, r"[#*$%&<>]{2,}(?=[\x20\x09-\x0D]|$)").alias("symbols"),
        _COUNT(line, r"(?<![^\x20\x09-\x0D])[|»›•·>/-](?![^\x20\x09-\x0D])").alias("separators"),
        _COUNT(line, r"\p{Lu}").alias("capitals"),
        _COUNT(line, r"\p{L}").alias("letters"),
        _COUNT(line, r"[!?](?=[\x20\x09-\x0D]|$)").alias("shouts"),
    )
    return common.let(parts, judge)


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words covered by windows of consecutive words that the text has twice or more, the first included."""

    def of_hashes(h: Column) -> Column:
        spots = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            starts = F.array_sort(F.transform(hit, lambda i: F.get(s, i)["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            add = lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end"))
            return F.aggregate(starts, zero, add, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(common.let(spots, covered))

    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    return common.let(words, lambda w: F.when(F.size(w) <= window, F.lit(0)).otherwise(common.let(hashes(w), of_hashes))).cast("long")


def verdict(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost, kept and ``cleaned`` of a text.

    Null and empty texts have no words, fail the base rule and are not kept; ``cleaned`` is then null or empty.
    """
    t = F.coalesce(text, F.lit(""))
    has_word = lambda line: line.rlike(common.WORD)
    lines = F.split(t, "\n", -1)
    worded = F.filter(lines, has_word)
    # Each array is bound once per row; plain references would be inlined and computed again inside the lambdas.
    marked = common.let(lines, lambda ls: F.transform(ls, lambda x: F.struct(x.alias("line"), (has_word(x) & line_fails(x)).alias("fails"))))
    parts = common.let(
        marked,
        lambda m: F.struct(
            common.word_count(t).alias("n_words"),
            F.length(F.regexp_replace(t, common.SPACE, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            common.let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
            repeated_words(common.words(t)).alias("n_repeat_words"),
            F.aggregate(F.filter(m, lambda x: x["fails"]), F.lit(0), lambda a, x: a + F.regexp_count(x["line"], F.lit(common.WORD))).cast("long").alias("n_lost"),
            F.when(text.isNotNull(), F.array_join(F.transform(F.filter(m, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")).alias("cleaned"),
        ),
    )

    def judged(p: Column) -> Column:
        failed = (p["n_words"] < 10) | (p["n_repeat_words"] * 100 > p["n_words"] * 20)
        own = [p[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost", "cleaned")]
        return F.struct(*own, failed.alias("base_failed"), (~failed & (p["n_lost"] * 100 <= p["n_words"] * MAX_LOST_SHARE)).alias("kept"))

    return common.let(parts, judged)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "kept", "cleaned")


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the fields of ``verdict`` to every row.

    Every row is judged alone, so ties, repeated rows and other columns do not matter; columns of these names are replaced.
    """
    (v,) = common.fresh(df, "_v")
    return df.withColumn(v, verdict(F.col(text))).withColumns({c: F.col(f"{v}.{c}") for c in FIELDS}).drop(v)


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with their cleaned text.

    The verdict is generated where it is positive: a filter on it would be pushed down and have it computed twice.
    """
    (v,) = common.fresh(df, "_v")
    kept = df.withColumn(v, F.explode(F.filter(F.array(verdict(F.col(text))), lambda x: x["kept"])))
    return kept.withColumn(text, F.col(f"{v}.cleaned")).drop(v)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents."""
    out = judge(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS ls FROM d),
x AS (SELECT doc_id, unnest(ls) AS line FROM l),
m AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM x),
v AS (SELECT doc_id, n, line, n > 0 AND (
    len(list_filter(lw, lambda a: regexp_matches(a, '[#*$%&<>]{2,}$'))) * 100 > n * 5
 OR len(list_filter(lw, lambda a: regexp_full_match(a, '[|»›•·>/-]'))) * 100 > n * 20
 OR (n >= 8 AND len(regexp_extract_all(line, '\p{Lu}')) * 100 > len(regexp_extract_all(line, '\p{L}')) * 60)
 OR (n >= 8 AND len(list_filter(lw, lambda a: regexp_matches(a, '[!?]$'))) * 100 > n * 30)
 OR (n >= 8 AND len(list_distinct(lw)) * 100 < least(n, 500) * 20)
 OR (n >= 30 AND NOT regexp_matches(line, '[.,;:!?…。，、；：！？]'))
 OR (n <= 40 AND regexp_matches(line, '(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|click here to|subscribe to our newsletter|skip to (?:main )?content|tous droits r[eéÉ]serv[eéÉ]s|mentions l[eéÉ]gales|accepter (?:tous )?les cookies|alle rechte vorbehalten|datenschutzerkl[aäÄ]rung|cookies akzeptieren|todos los derechos reservados|pol[iíÍ]tica de privacidad|aceptar (?:todas )?las cookies'))) AS fails FROM m),
g AS (SELECT doc_id, coalesce(sum(n) FILTER (fails), 0)::BIGINT AS n_lost, (count(line) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup_lines FROM v GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM l),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS c FROM p),
c AS (SELECT DISTINCT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS j FROM h WHERE c > 1),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM c GROUP BY doc_id),
o AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, g.n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, g.n_lost
  FROM l JOIN g USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed,
  (NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND n_lost * 100 <= n_words * 40) AS kept, n_lost FROM o
"""
