"""Page bodies as blocks: JSX runs, headings, code and prose; segments, stubs and write-back.

Two levels: lines that begin with ``<`` open a JSX run up to the next blank line, wherever they stand; the rest is read
as CommonMark, of which this module knows headings (ATX, setext), code (fenced, indented), quotes, lists, rules,
inline code, emphasis, links, images, autolinks, inline HTML, breaks, escapes and references. Text events of one run
are joined as they come, so paragraphs that follow one another are one prose block without a gap.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROSE, CODE, JSX, HEADING = "prose", "code_fence", "jsx", "heading"
# Frontmatter keys that are never translated.
FROZEN = ("method", "path", "operationid")
_BLOCKS = pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("content", pa.string())]))
BLOCK_TYPE = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("content", T.StringType())]))

#: Pages that exist as Python objects at a time.
PAGES_AT_ONCE = 500

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\n]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_INLINE = re.compile(r"\\([!-/:-@\[-`{-~])|(`+)(.+?)(?<!`)\2(?!`)|!?\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>|</?[a-zA-Z][^<>]*>|<!--.*?-->|(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);)|(?:\\|[ \t]{2,})?\n[ \t]*", re.S)
_EMPHASIS = re.compile(r"(?<![\w*])(\*{1,3})(?=\S)(.+?)(?<=\S)\1(?![\w*])|(?<![\w_])(_{1,3})(?=\S)(.+?)(?<=\S)\3(?![\w_])", re.S)


@dataclass(frozen=True)
class Block:
    index: int
    kind: str
    content: str


def line_list(text: str) -> list[str]:
    """Lines without their ends (\\n or \\r\\n); a final line end opens no further line."""
    *ended, last = text.split("\n")
    out = [x.removesuffix("\r") for x in ended]
    return [*out, last] if last else out


def inline(text: str) -> str:
    """Text of a paragraph or heading: markup goes, what it shows stays."""
    kept: list[str] = []

    def hold(value: str) -> str:
        kept.append(value)
        return f"\0{len(kept) - 1}\0"

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return hold(m[1])
        if m[2] is not None:
            code = m[3].replace("\n", " ")
            return hold(code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code)
        if m[4] is not None:
            return hold(inline(m[4]))
        if m[5] is not None:
            return hold(m[5])
        if m[6] is not None:
            return hold(html.unescape(m[6]))
        return "\n" if "\n" in m[0] and not m[0].lstrip(" \t").startswith("<") else ""

    out = _INLINE.sub(one, text.replace("\0", "\ufffd"))
    while True:
        less = _EMPHASIS.sub(lambda m: m[2] if m[2] is not None else m[4], out)
        if less == out:
            break
        out = less
    while "\0" in out:
        out = re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], out)
    return out


def _markdown(text: str) -> Iterator[tuple[str, str]]:
    """(kind, content) of a run of Markdown; prose comes in pieces that the caller joins."""
    para: list[str] = []

    def paragraph() -> Iterator[tuple[str, str]]:
        if para:
            yield PROSE, inline("\n".join(x.strip(" \t") if i == len(para) - 1 else x.lstrip(" \t") for i, x in enumerate(para)))
            para.clear()

    lines, i = line_list(text), 0
    while i < len(lines):
        line = lines[i]
        # Quotes and list markers only open containers; their text is prose like any other.
        while re.match(r" {0,3}>", line) or (_ITEM.match(line) and not _RULE.match(line) and not (para and re.match(r" {0,3}\d", line) and not re.match(r" {0,3}1[.)]", line))):
            yield from paragraph()
            line = re.sub(r"^ {0,3}> ?", "", line, count=1) if re.match(r" {0,3}>", line) else line[_ITEM.match(line).end() :]
        fence = _FENCE.match(line)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            yield from paragraph()
            body, indent = [], len(line) - len(line.lstrip(" "))
            i += 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$", lines[i]):
                body.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                i += 1
            i += 1
            info = html.unescape(fence[2].strip())
            yield CODE, "```" + info + "\n" + "".join(x + "\n" for x in body) + "```"
            continue
        if not line.strip():
            yield from paragraph()
        elif not para and line.startswith(("    ", "\t")):
            body = []
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                body.append(re.sub(r"^( {1,4}|\t)", "", lines[i]))
                i += 1
            while body and not body[-1].strip():
                body.pop()
            yield CODE, "```\n" + "".join(x + "\n" for x in body) + "```"
            continue
        elif m := _ATX.match(line):
            yield from paragraph()
            yield HEADING, inline((m[2] or "").strip())
        elif para and re.match(r" {0,3}(=+|-+)[ \t]*$", line):
            title = "\n".join(x.strip() for x in para)
            para.clear()
            yield HEADING, inline(title)
        elif _RULE.match(line):
            yield from paragraph()
        else:
            para.append(line)
        i += 1
    yield from paragraph()


def _opens(line: str) -> bool:
    """Whether a line opens a JSX run: it begins with ``<`` and is no comment and no bare address."""
    return line.startswith("<") and not line.startswith(("<!--", "<http"))


def _text_blocks(lines: list[str]) -> Iterator[tuple[str, str]]:
    """Blocks of a run of CommonMark lines; texts in a row are one block of prose."""
    said: list[str] = []
    for kind, content in chain(_markdown("\n".join(lines) + "\n"), [(None, "")]):
        if kind == PROSE:
            said.append(content)
            continue
        if text := "".join(said).strip():
            yield PROSE, text
        said.clear()
        if kind == CODE:
            yield CODE, content
        elif kind is not None and content.strip():
            yield kind, content.strip()


def split_blocks(body: str) -> list[Block]:
    """Blocks of a body with their running index."""
    lines = line_list(body)
    # A line is in a JSX run if it is not blank and opens one, or follows a line that is in one.
    inside = list(accumulate(lines, lambda before, x: bool(x.strip()) and (before or _opens(x.strip())), initial=False))[1:]
    found: list[tuple[str, str]] = []
    for jsx, run in groupby(zip(inside, lines, strict=True), key=lambda x: x[0]):
        own = [line for _, line in run]
        found += [(JSX, "\n".join(own).rstrip())] if jsx else _text_blocks(own)
    return [Block(i, kind, content) for i, (kind, content) in enumerate(found)]


def with_blocks(df: DataFrame, body: str = "body", out: str = "blocks") -> DataFrame:
    """Add the blocks of a body as array<struct<index, kind, content>>; a null body has none. Rows are independent.

    A plan that does not read the blocks does not split the bodies.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [pa.array([[vars(x) for x in split_blocks(t)] if t is not None else [] for t in texts.slice(i, PAGES_AT_ONCE).to_pylist()], _BLOCKS) for i in range(0, len(texts), PAGES_AT_ONCE)]
            yield pa.concat_arrays(done) if done else pa.array([], _BLOCKS)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Marked as not deterministic so that no filter on the blocks makes the plan split a body twice.
    return df.withColumn(out, F.arrow_udf(run, BLOCK_TYPE).asNondeterministic()(body))


def segments(df: DataFrame) -> DataFrame:
    """(relative_path, seg_key, value, hash, translatable) from pages with ``frontmatter`` and ``blocks``.

    Title, description and every block are segments; titles, descriptions, prose and headings are translated.
    """
    meta = F.filter(F.map_entries("frontmatter"), lambda e: e["key"].isin("title", "description"))
    head = F.transform(meta, lambda e: F.struct(F.concat(F.lit("frontmatter:"), e["key"]).alias("seg_key"), e["value"].alias("value"), F.lit(True).alias("translatable")))
    body = F.transform("blocks", lambda b: F.struct(F.concat(F.lit("body:"), b["index"].cast("string")).alias("seg_key"), b["content"].alias("value"), b["kind"].isin(PROSE, HEADING).alias("translatable")))
    rows = df.select("relative_path", F.explode(F.concat(head, body)).alias("s")).select("relative_path", "s.*")
    return rows.select("relative_path", "seg_key", "value", F.md5("value").alias("hash"), "translatable")


def headings(df: DataFrame, text: str) -> DataFrame:
    """Headers of a Markdown text with the range of lines up to the next header: (.., name, level, start_line, end_line).

    Each row is read by itself, so rows may agree in all other columns.
    """
    from lorekit.functions import text as X

    keys = [c for c in df.columns if c != text]
    pattern = r"^(#{1,6})\s+(.+)$"

    def ranges(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("head")))
        return X.let(F.filter(marked, lambda h: h["head"].rlike(pattern)), lambda heads: F.transform(heads, lambda h, i: F.struct(
            F.regexp_extract(h["head"], pattern, 2).alias("name"), F.length(F.regexp_extract(h["head"], pattern, 1)).alias("level"), h["line"].alias("start_line"),
            F.coalesce(F.get(heads, i + 1)["line"] - 1, F.size(lines)).alias("end_line"),
        )))

    return df.select(*keys, F.explode(X.let(X.lines(F.col(text)), ranges)).alias("_h")).select(*keys, "_h.*")


def wiki_links(df: DataFrame, text: str) -> DataFrame:
    """(.., note, line) of ``[[note]]`` links."""
    from lorekit.functions import text as X

    keys = [c for c in df.columns if c != text]
    each = df.select(*keys, F.posexplode(X.lines(F.col(text))).alias("_i", "_line"))
    return each.select(*keys, F.explode(F.regexp_extract_all("_line", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("note"), (F.col("_i") + 1).alias("line"))


def tags(df: DataFrame, text: str) -> DataFrame:
    """(.., tag, line) of ``#tag`` words."""
    from lorekit.functions import text as X

    keys = [c for c in df.columns if c != text]
    each = df.select(*keys, F.posexplode(X.lines(F.col(text))).alias("_i", "_line"))
    return each.select(*keys, F.explode(F.regexp_extract_all("_line", F.lit(r"(?:\s|^)(#[a-zA-Z0-9_\-]+)"), F.lit(1))).alias("tag"), (F.col("_i") + 1).alias("line"))


def _meta_lines(meta: dict[str, str]) -> list[str]:
    return [f'{k}: "{v}"' if ":" in v or '"' in v else f"{k}: {v}" for k, v in sorted(meta.items())]


def serialize(meta: dict[str, str], blocks: Iterable[Block]) -> str:
    """A page as text: sorted frontmatter, then each block and a blank line."""
    head = "---\n" + "".join(x + "\n" for x in _meta_lines(meta)) + "---\n\n" if meta else ""
    return head + "".join(b.content + ("" if b.content.endswith("\n") else "\n") + "\n" for b in blocks)


def stub(meta: dict[str, str], blocks: Iterable[Block]) -> str:
    """Stub of a missing locale page: marked title and description, prose left to the translator, all else as it is."""
    marked, body = _stub(meta, blocks)
    return "---\n" + "".join(x + "\n" for x in _meta_lines(marked)) + "---\n\n" + body


def _stub(meta: dict[str, str], blocks: Iterable[Block]) -> tuple[dict[str, str], str]:
    marked = {k: f"[TODO] {v}" if k in ("title", "description") else v for k, v in meta.items()}
    out = "{/* TODO: translate from EN */}\n\n"
    for b in blocks:
        if b.kind == PROSE:
            out += "<!-- TODO: translate -->\n\n"
        else:
            out += b.content + ("" if b.kind != HEADING and b.content.endswith("\n") else "\n") + "\n"
    return marked, out


def stub_parts(meta: dict[str, str], blocks: Iterable[Block]) -> tuple[dict[str, str], list[Block]]:
    """Frontmatter and blocks of a stub, as they are read from its text."""
    marked, body = _stub(meta, blocks)
    return marked, split_blocks(body)


def with_stub(df: DataFrame, out: str = "stub") -> DataFrame:
    """(relative_path, stub) of pages with ``frontmatter`` and ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            metas, blocks = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("frontmatter", "blocks"))
            own = [stub(dict(m or ()), [Block(**x) for x in bs or ()]) for m, bs in zip(metas, blocks, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("relative_path")), pa.array(own, pa.string())], names=["relative_path", out])

    return df.select("relative_path", "frontmatter", "blocks").mapInArrow(run, f"relative_path string, {out} string")


def apply_updates(meta: dict[str, str], blocks: list[Block], updates: dict[str, str], source: list[Block] | None = None) -> tuple[dict[str, str], list[Block]]:
    """A target page with new segment values; blocks that are not translated are those of the source, where it is given."""
    meta = {k: updates.get(f"frontmatter:{k}", v) for k, v in meta.items()}
    out = []
    for i, b in enumerate(blocks):
        content = updates.get(f"body:{i}", b.content)
        # Whether a block is translated is decided by the target's own blocks.
        if source is not None and i < len(source) and f"body:{i}" not in updates and b.kind not in (PROSE, HEADING):
            content = source[i].content
        out.append(Block(b.index, b.kind, content))
    return meta, out


def with_updates(df: DataFrame, out: str = "page") -> DataFrame:
    """(target_path, page) of rows with a source page's ``frontmatter`` and ``blocks``, the target's ``t_meta`` and ``t_blocks`` and ``updates``.

    A target that does not exist (null blocks) starts as a stub of the source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = []
            for r in b.to_pylist():
                own = [Block(**x) for x in r["blocks"]]
                meta, blocks = (dict(r["t_meta"]), [Block(**x) for x in r["t_blocks"]]) if r["t_blocks"] is not None else stub_parts(dict(r["frontmatter"]), own)
                pages.append(serialize(*apply_updates(meta, blocks, dict(r["updates"]), own)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("target_path")), pa.array(pages, pa.string())], names=["target_path", out])

    return df.select("target_path", "frontmatter", "blocks", "t_meta", "t_blocks", "updates").mapInArrow(run, f"target_path string, {out} string")


def hash_value(value: str) -> str:
    return hashlib.md5(value.encode()).hexdigest()
