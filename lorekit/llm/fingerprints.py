"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves of a few words.

Sections end at blank lines or before headings (and after at most MAX_PARAGRAPHS paragraphs), paragraphs at line ends,
leaves at full stops, after one word in ENDS (by its hash) and before LEAF code points are passed; a longer word is cut
after one pair of code points in WORD_ENDS. That is one rule for all lengths, told by the text around a cut alone. Leaves
hold their separators, so they join to the text again; the hash of a node is that of its children's hashes, up to the
root: equal roots mean equal texts. Two trees are compared from the root down: a branch that both have is counted as a
whole, and only differing branches are opened, down to the leaves that differ.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Code points in a leaf, and paragraphs in a section, at most; one word in ENDS ends a leaf, in a long word one pair of code points in WORD_ENDS.
LEAF, MAX_PARAGRAPHS, ENDS, WORD_ENDS = 48, 16, 2, 12
#: Hex digits of the root, and of a leaf as a fingerprint shows it.
ROOT, SHOWN = 32, 12
#: Code points of a text whose paragraphs are remembered for its edit.
REMEMBERED = 1 << 20
#: Ranges of keys at most, and rows sampled for each to find where they end.
RANGES, SAMPLED = 1 << 16, 20


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


#: Whether a word ends a leaf, for words that a worker has met.
_ends: dict[str, bool] = {}
_MEMORY = 200_000


def _end(word: str) -> bool:
    if len(_ends) >= _MEMORY:
        _ends.clear()
    bare = word.rstrip("\n")
    out = _ends[word] = bare.endswith(".") or not zlib.crc32(bare.encode("utf-8", "replace")) % ENDS
    return out


def _pieces(word: str) -> list[str]:
    """A long word in pieces of at most LEAF code points, cut where its own code points tell."""
    out, since = [], 0
    for i in range(1, len(word)):
        if i - since >= LEAF or (i - since > 1 and not (31 * ord(word[i - 2]) + 7 * ord(word[i - 1])) % WORD_ENDS):
            out.append(word[since:i])
            since = i
    return [*out, word[since:]]


def leaves(paragraph: str) -> list[str]:
    """Pieces that join to the paragraph (a line with its end) again."""
    out: list[str] = []
    since = at = 0
    size, known = len(paragraph), _ends.get
    for word in paragraph.split(" "):
        n = len(word)
        end = at + n + 1
        if end > size:
            if at == size:
                break  # nothing follows the last space
            end = size
        if at + n - since > LEAF and at > since:
            out.append(paragraph[since:at])
            since = at
        if n > LEAF:
            out += _pieces(paragraph[at:end])
            since = end
        elif known(word) or (word not in _ends and _end(word)):
            out.append(paragraph[since:end])
            since = end
        at = end
    if since < size or not out:
        out.append(paragraph[since:])
    return out


def tree(text: str | None, *met: dict[str, list[bytes]]) -> list[list[list[bytes]]]:
    """Leaf hashes by section and paragraph. A null text is empty: one section of one paragraph of one empty leaf.

    Paragraphs that ``met`` holds are not hashed again; the first of ``met`` is told of new ones.
    """
    text = text or ""
    lines = text.split("\n")
    sections: list[list[list[bytes]]] = [[]]
    for i, line in enumerate(lines):
        if sections[-1] and (line.startswith("#") or len(sections[-1]) >= MAX_PARAGRAPHS):
            sections.append([])
        whole = line + "\n" if i < len(lines) - 1 else line
        if whole or not i:
            found = next((x for m in met if (x := m.get(whole)) is not None), None)
            if found is None:
                found = [_hash(x.encode("utf-8", "replace")) for x in leaves(whole)]
                if met:
                    met[0][whole] = found
            sections[-1].append(found)
        if not line.strip():
            sections.append([])
    return [s for s in sections if s]


def _node(children: list[str]) -> str:
    return _hash("".join(children).encode()).hex()


def fingerprint(text: str | None, *met: dict[str, list[bytes]]) -> str:
    """The tree as text: its root, then sections split by ``|``, paragraphs by ``/``, each paragraph its leaves' hashes in a row.

    The root follows from the whole hashes of the leaves; shown of a leaf are SHOWN digits, for comparison.
    """
    t = tree(text, *met)
    root = _hash(b"".join(_hash(b"".join(_hash(b"".join(p)) for p in s)) for s in t)).hex()
    return root + ":" + "|".join("/".join(b"".join([x[: SHOWN // 2] for x in p]).hex() for p in s) for s in t)


def parse(mark: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """Root, then (hash, paragraphs) of each section with (hash, leaves) of each paragraph."""
    root, _, body = mark.partition(":")
    out = []
    for s in body.split("|"):
        paragraphs = [[p[i : i + SHOWN] for i in range(0, len(p), SHOWN)] for p in s.split("/")]
        nodes = [(_node(p), p) for p in paragraphs]
        out.append((_node([h for h, _ in nodes]), nodes))
    return root, out


def _unshared(a: list, b: list) -> tuple[list, list, list]:
    """Nodes that both lists have (as a multiset, by hash) and what is left of each, in order."""
    left = Counter(h for h, _ in b)
    both, only_a = [], []
    for x in a:
        if left[x[0]] > 0:
            left[x[0]] -= 1
            both.append(x)
        else:
            only_a.append(x)
    only_b = []
    for x in reversed(b):
        if left[x[0]] > 0:
            left[x[0]] -= 1
            only_b.append(x)
    return both, only_a, only_b[::-1]


def likeness(a, b) -> float:
    """Share of leaves in common, of those of the larger tree: 1 for equal roots, 0 if no leaf is shared."""
    if a[0] == b[0]:
        return 1.0
    size = lambda sections: sum(len(p) for _, ps in sections for _, p in ps)
    sections, rest_a, rest_b = _unshared(a[1], b[1])
    shared = size(sections)
    paragraphs, rest_a, rest_b = _unshared([p for _, s in rest_a for p in s], [p for _, s in rest_b for p in s])
    shared += sum(len(p) for _, p in paragraphs)
    la, lb = Counter(x for _, p in rest_a for x in p), Counter(x for _, p in rest_b for x in p)
    shared += sum(min(n, lb[x]) for x, n in la.items())
    return min(shared / max(size(a[1]), size(b[1])), 1.0 - 1e-9)


def edits(a, b) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) of the leaves of ``a`` that ``b`` does not have, found in differing branches only."""
    out = []
    other_sections = Counter(h for h, _ in b[1])
    other_paragraphs = Counter(h for _, s in b[1] for h, _ in s)
    other_leaves = Counter(x for _, s in b[1] for _, p in s for x in p)
    for i, (h, s) in enumerate(a[1]):
        if other_sections[h]:
            continue
        for j, (h2, p) in enumerate(s):
            if other_paragraphs[h2]:
                continue
            out += [(i, j, k) for k, x in enumerate(p) if not other_leaves[x]]
    return out


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each row's text; a null text counts as empty. Equal texts get equal fingerprints.

    A column that is named like the new one gives way to it.
    """
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            marks = [fingerprint(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def _ordinal(df: DataFrame, key: str) -> Column:
    """A long that sorts as the key does, null lowest. Texts are numbered by hash: any order that is the same on every run will do for them."""
    kind = df.schema[key].dataType
    number = F.col(key).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(key)
    return F.when(F.col(key).isNull(), F.lit(-(1 << 63))).otherwise(number)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows by falling key over ranges, each followed by a copy of the row that opens the next range.

    Adds ``_range`` and ``_tail``; partitions are sorted, so that the row after each row is the next one, and the copy
    (``_tail``) is the last. The last range ends in a copy of the very first row. Null keys come last; rows of one key
    are ordered by a hash of the text, and keys that are no integers by their own hash. Ranges end at (key, hash) pairs
    of a sample, so many texts under one key or null are many ranges; only rows that agree in key and text stay
    together. The number of ranges follows the number of partitions; of each at most SAMPLED rows' pairs reach the driver.
    """
    spark = df.sparkSession
    n = min(RANGES, max(4, 2 * common.partitions(spark)))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), _ordinal(df, key).alias("_order"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_tie"))
    pairs = rows.select("_order", "_tie")
    every = max(1, df.count() // (SAMPLED * n))
    sample = pairs.where(F.pmod(F.xxhash64("_order", "_tie", F.monotonically_increasing_id()), F.lit(every)) == 0).limit(4 * SAMPLED * n).toArrow()
    seen = sorted(zip(sample["_order"].to_pylist(), sample["_tie"].to_pylist(), strict=True), reverse=True)
    cuts = sorted({seen[i * len(seen) // n] for i in range(1, n)} if seen else set(), reverse=True)

    def longs(values: list[int]) -> Column:
        return F.from_json(F.lit(str(values)), "array<long>") if values else F.array().cast("array<long>")

    # Range of a row: how many cuts lie above it, by halves.
    high, low = longs([c[0] for c in cuts]), longs([c[1] for c in cuts])
    powers = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    above = lambda at: (F.get(high, at) > F.col("_order")) | ((F.get(high, at) == F.col("_order")) & (F.get(low, at) > F.col("_tie")))
    place = F.aggregate(F.array(*[F.lit(x) for x in powers]), F.lit(0), lambda at, x: F.when((at + x <= len(cuts)) & above(at + x - 1), at + x).otherwise(at))
    dealt = rows.withColumn("_range", place if cuts else F.lit(0))
    heads = {r["_range"]: (r["m"]["_order"], r["m"]["_tie"]) for r in dealt.groupBy("_range").agg(F.max(F.struct("_order", "_tie")).alias("m")).collect()}
    used = sorted(heads)
    # The first row of a range also ends the one before; that of the first range ends the last one.
    before = F.get(F.from_json(F.lit(str([used[used.index(r) - 1] if r in heads else -1 for r in range((used[-1] if used else 0) + 1)])), "array<int>"), F.col("_range"))
    opens = [longs([heads.get(r, (0, 0))[k] for r in range((used[-1] if used else 0) + 1)]) for k in (0, 1)]
    first = (F.get(opens[0], F.col("_range")) == F.col("_order")) & (F.get(opens[1], F.col("_range")) == F.col("_tie"))
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("tail"))
    copies = F.when(first, F.array(own, F.struct(before.alias("r"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    spread = dealt.withColumn("_c", F.explode(copies)).select("_key", "_text", "_order", "_tie", F.col("_c.r").alias("_range"), F.col("_c.tail").alias("_tail"))
    return spread.repartition(max(1, len(used)), "_range").sortWithinPartitions("_range", "_tail", F.col("_order").desc(), F.col("_tie").desc())


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit by the next row's text, with their likenesses.

    Null and empty texts are both empty. A single row follows itself. Other columns are not read. See ``with_next`` for the order.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, key, text, mark, tree, paragraphs) of the row that waits for the next one
        for b in common.sliced(batches):
            out = []
            for k, t, r, tail in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_key", "_text", "_range", "_tail")], strict=True):
                if tail and held is None:
                    continue  # of several copies the first one counts
                t = t or ""
                met = ({},) if len(t) <= REMEMBERED else ()
                mark = fingerprint(t, *met)
                now = (r, k, t, mark, parse(mark), met)
                if held is not None and held[0] == r:
                    new = edited(held[2], t)
                    new_mark = fingerprint(new, {}, *held[5], *met)
                    out.append((held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), held[3], new_mark, likeness(held[4], parse(new_mark)), likeness(held[4], now[4])))
                held = None if tail else now
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("_key").type), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:5]], *[pa.array(c, pa.float64()) for c in cols[5:]]], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(df, key, text).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return compare(common.table(spark, sf_dir, "documents"))
