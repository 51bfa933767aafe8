import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lorekit.llm import fingerprints as fp


def cut(text):
    """Sections of paragraphs of leaves, by the rules as the module states them, a code point at a time."""
    sections, paragraphs = [], []
    lines = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
    for line in lines:
        if paragraphs and (line.startswith("#") or len(paragraphs) == fp.MAX_PARAGRAPHS):
            sections.append(paragraphs)
            paragraphs = []
        leaves, leaf = [], ""
        for unit in re.findall(r"[^ ]* |[^ ]+$", line) or [""]:
            word = unit[:-1] if unit.endswith(" ") else unit
            if leaf and len(leaf) + len(word) > fp.LEAF:
                leaves.append(leaf)
                leaf = ""
            if len(word) > fp.LEAF:
                piece = ""
                for c in unit:
                    if len(piece) == fp.LEAF or (len(piece) > 1 and (31 * ord(piece[-2]) + 7 * ord(piece[-1])) % fp.WORD_ENDS == 0):
                        leaves.append(piece)
                        piece = ""
                    piece += c
                leaves.append(piece)
                continue
            leaf += unit
            word = word.rstrip("\n")
            if word[-1:] == "." or zlib.crc32(word.encode()) % fp.ENDS == 0:
                leaves.append(leaf)
                leaf = ""
        paragraphs.append(leaves + [leaf] if leaf or not leaves else leaves)
        if not line.strip():
            sections.append(paragraphs)
            paragraphs = []
    return sections + [paragraphs] if paragraphs else sections


def mark(text):
    h = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    t = [[[h(x.encode()) for x in p] for p in s] for s in cut(text)]
    root = h(b"".join(h(b"".join(h(b"".join(p)) for p in s)) for s in t)).hex()
    return root + ":" + "|".join("/".join("".join(x.hex()[:12] for x in p) for p in s) for s in t)


def like(a, b):
    """Share of leaves in common, counted on the leaves themselves."""
    x, y = (Counter(leaf for s in cut(t) for p in s for leaf in p) for t in (a, b))
    return 1.0 if a == b else min(sum((x & y).values()) / max(sum(x.values()), sum(y.values())), 1 - 1e-9)


def plain(rows, tie):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + n[:half]
        out.append((repr(d), len(t), hashlib.sha256(new.encode()).hexdigest(), mark(t), mark(new), like(t, new), like(t, n)))
    return sorted(out)


def ties(spark, rows):
    """The hash by which texts of one key are ordered."""
    df = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string")
    return {x.t: x.h for x in df.selectExpr("t", "coalesce(xxhash64(t), 0) h").collect()}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    return sorted((repr(x[0]), *x[1:]) for x in fp.compare(df).collect())


def test_equals_plain_order_on_odd_rows(spark):
    rows = [(i * 7 % 101, f"Text {i}. " * i + "é😀\n\nx" * (i % 3)) for i in range(100)] + [(500, None), (501, ""), (502, "a"), (503, "x" * 200_000), (None, "none"), (-5, "low")]
    assert run(spark, rows) == plain(rows, ties(spark, rows))
    assert run(spark, rows[:1]) == plain(rows[:1], ties(spark, rows))
    assert run(spark, []) == []


def test_repeated_keys_and_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "b"), (None, None), (None, None), (2, "c")] * 3
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert len({x[3] for x in got if x[1] == 7}) == 1


def test_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = sorted((repr(x[0]), *x[1:]) for x in fp.op7_fingerprints(spark, path).collect())
    assert got == plain(rows, ties(spark, rows))
    long = [x for x in got if x[1] > 200]
    assert sum(x[5] > x[6] for x in long) > 0.97 * len(long)
    # Half of the text is common to a text and its edit.
    assert abs(sum(x[5] for x in long) / len(long) - 0.5) < 0.05 and sum(x[6] for x in long) / len(long) < 0.1


def test_root_and_edits():
    a, b = "One. Two\nThree four. Five\n\nSix", "One. Two\nThree FOUR. Five\n\nSix"
    x, y = fp.parse(fp.fingerprint(a)), fp.parse(fp.fingerprint(b))
    assert x[0] != y[0] and 0 < fp.likeness(x, y) < 1 and fp.likeness(x, x) == 1
    assert fp.edits(x, y) and all(i == 0 and j == 1 for i, j, _ in fp.edits(x, y))
    assert fp.fingerprint(None) == fp.fingerprint("") != fp.fingerprint(" ")
    assert fp.likeness(fp.parse(fp.fingerprint("abc\n")), fp.parse(fp.fingerprint("abc "))) < 1


def test_one_rule_for_all_lengths():
    """No length at which a code point more changes more than the leaves around it."""
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 9))) + r.choice(["", "", "", ".", "\n", "\n\n"])
    texts = [" ".join(word() for _ in range(300)), "".join(r.choices("abcdefgh", k=1500)), " ".join(f"word{i}" for i in range(200))]
    for text in texts:
        for n in range(60, len(text), 7):
            size = max(len([x for s in cut(text[:m]) for p in s for x in p]) for m in (n, n + 1))
            assert fp.likeness(fp.parse(fp.fingerprint(text[:n])), fp.parse(fp.fingerprint(text[: n + 1]))) >= 1 - 3 / size
    for n in (390, 397, 399, 400, 410, 2000):
        text = texts[0][:n]
        assert like(text, text + " two words") > 0.9 and like(text, "two words " + text) > 0.9
    assert fp.leaves("") == [""] and "".join(fp.leaves("a b. c  d " + "x" * 148 + "\n")) == "a b. c  d " + "x" * 148 + "\n"
    assert fp.likeness(fp.parse(fp.fingerprint(texts[1])), fp.parse(fp.fingerprint("q" + texts[1]))) > 0.95


def test_one_key_for_many_texts(spark):
    """Null keys and one key with many texts are dealt over ranges; keys may be texts."""
    rows = [(None, f"text number {i}. And {i * i % 17} more") for i in range(300)] + [(4, f"other {i}") for i in range(300)]
    assert run(spark, rows) == plain(rows, ties(spark, rows))
    df = spark.createDataFrame([(None if k is None else str(k), t) for k, t in rows], "doc_id string, text string")
    placed = fp.with_next(df).select("_range", "_tail", F.spark_partition_id().alias("p")).collect()
    sizes = Counter(x["_range"] for x in placed if not x["_tail"])
    assert sum(sizes.values()) == 600 and max(sizes.values()) < 250
    assert fp.compare(df).count() == 600


def test_frame(spark):
    df = spark.createDataFrame([("a. b",), (None,)], "text string")
    assert {x.fingerprint for x in fp.add_fingerprint(df).collect()} == {fp.fingerprint("a. b"), fp.fingerprint("")}
