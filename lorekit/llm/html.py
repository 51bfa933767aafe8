"""HTML extraction: a suffix array over the token streams of a host's pages, read together with the structure of a page.

A page is cut into blocks of text, each with the elements around it and a zone that its tags tell: ``MAIN`` inside an
article or main element, ``FRAME`` inside menus, headers, footers, sidebars, notices, adverts, forms or comments,
``PLAIN`` where tags say neither. Scripts, styles and hidden elements give no blocks.

The tokens of all blocks of a host's pages are one stream. Its suffixes are sorted by their first RUN tokens, dealt by
the hash of (host, tokens): each bucket is an interval of the host's suffix array whose members have RUN or more tokens
in common, and its number of pages is the frequency of the tokens that it covers. Longer repeats are chains of such
intervals. Every suffix is in the array. Chunks of pages count their own suffixes, and ask about the others in two steps:
first, in packed sets, for the leading bits of each, which tells all that some other chunk may have as well; then, of
these only, with whole hashes and numbers of pages.

A token that m pages have weighs 1/m, so text that is a page's own weighs most and boilerplate next to nothing. Where the
zone MAIN holds TRUST or more of a page's weight it is the text. Else the text is the smallest element that holds MOST of
the weight, without the elements in it that repeated runs fill; if that is the whole body, without all repeated runs.
What repeats is what more pages have than the page's own text (copies of a page share its text as well).
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, hashsets
from .wordhash import mix, runs, word_hashes

#: Tokens in common that make an interval of the suffix array; ends of blocks count as tokens.
RUN = 6
#: Share of a page's weight that marked content holds at least, and that the text's element holds at least where marks do not decide.
TRUST, MOST = 0.1, 0.7
MAIN, PLAIN, SOFT_MAIN, SOFT, FRAME, HIDDEN = range(6)
_END = "\x1e"
#: Bytes of pages in a chunk, at most (but for one page), and in a piece of it, which is packed and parsed at once.
CHUNK, PIECE = 16 << 20, 1 << 20
#: The leading bits of a suffix tell this many times as many values apart as there are suffixes, or more (a power of two).
SPARE = 32

_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math canvas object select".split())
#: Elements that can hold the text of a page, or a piece of boilerplate.
_CONTAINERS = frozenset("article aside div dl fieldset footer form header li main nav ol section table tbody td th tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FRAME_TAGS = frozenset("nav aside footer form menu dialog button fieldset".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCKS - {"caption", "body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "button"}
#: An open element of the key's kind ends when one of the values' kinds starts.
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Parts of class, id and role values that mark an element as frame, if its other parts are such or say nothing.
_FRAME_MARKS = frozenset(
    "nav navbar navigation menu submenu sidebar sidebars aside footer foot colophon contentinfo complementary ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login register popup modal overlay "
    "breadcrumb breadcrumbs pagination pager toolbar widget widgets masthead skip copyright disclaimer search searchbox paywall".split()
)
_COMMENT_MARKS = frozenset("comment comments commentlist respond replies".split())
_WEAK_MARKS = frozenset("header head top topbar meta tags".split())
_MAIN_MARKS = frozenset("article main content post entry story articlebody".split())
_NEUTRAL_MARKS = frozenset("site page global left right primary secondary inner outer wrap wrapper container box block area section list item items single link links row col column bar form posts stories thread body text left right bottom".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)} if source.strip() else {}


def _marks(attributes: dict[str, str]) -> tuple[bool, bool, bool, bool]:
    """Whether class, id, role and itemprop values mark an element as comments, frame, weakly as frame, and content."""
    comment = frame = weak = content = False
    for k in ("class", "id", "role", "itemprop"):
        for token in attributes.get(k, "").split():
            parts = {p.lower() for p in _PARTS.findall(token) if not p.isdigit()}
            known = parts <= _FRAME_MARKS | _COMMENT_MARKS | _WEAK_MARKS | _MAIN_MARKS | _NEUTRAL_MARKS
            if known and parts & _COMMENT_MARKS:
                comment = True
            elif known and parts & _FRAME_MARKS:
                frame = True
            elif known and parts & _WEAK_MARKS:
                weak = True
            elif known and parts & _MAIN_MARKS:
                content = True
    return comment, frame, weak, content


def _zone(tag: str, source: str, parent: int) -> int:
    """Zone inside an element, from its tag and attributes and the zone around it.

    Article and main elements are content whatever their class says, except among comments; inside an element that only
    its class marks as frame they are content of last resort (a list of related articles has them too).
    """
    if parent >= FRAME and tag != "html":
        return MAIN if tag == "main" and parent == FRAME else parent  # a page's one main element is no part of its frame
    if tag in _FRAME_TAGS:
        return FRAME
    if tag == "head":
        return HIDDEN
    a = _attributes(source)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return HIDDEN
    comment, frame, weak, content = _marks(a) if a else (False,) * 4
    if tag in ("html", "body"):
        return parent
    if comment:
        return FRAME
    if tag == "main":
        return MAIN
    if tag == "article":
        return SOFT_MAIN if parent in (SOFT, SOFT_MAIN) else MAIN
    if frame or (weak and not content) or (tag == "header" and parent != MAIN):
        return SOFT
    if content and tag in ("div", "section", "td") and parent == PLAIN:
        return MAIN
    return parent


@dataclass
class Page:
    """Blocks of a page in order: text, zone, and the innermost element; parents of elements, 0 being the page itself."""

    texts: list[str] = field(default_factory=list)
    zones: list[int] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])


def parse(page: str | None) -> Page:
    """The blocks of a page; references decoded, white space runs one space, empty ones left out."""
    page = (page or "").replace(_END, " ")
    out = Page()
    stack: list[tuple[str, int, int]] = []
    parts: list[str] = []
    zone, owner, at, n = PLAIN, 0, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text and zone != HIDDEN:
                out.texts.append(text)
                out.zones.append(zone)
                out.owners.append(owner)
            parts.clear()

    def close(names: tuple[str, ...], limit: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of these names, with all inside it."""
        nonlocal zone, owner
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                if any(x in _BLOCKS for x, _, _ in stack[i:]):
                    flush()
                zone, owner = stack[i][1:]
                del stack[i:]
                return
            if stack[i][0] in limit:
                return

    lower = None
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        source = m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag in _BLOCKS:
                flush()
            close((tag,), frozenset(("td", "th", "table")) if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else frozenset())
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _RAW:
            if not source.rstrip().endswith("/") or tag not in ("svg", "math"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at) if len(lower) == n else page.find(f"</{tag}", at)
                if end < 0:
                    break  # the rest of the page belongs to it
                close_at = page.find(">", end)
                at = n if close_at < 0 else close_at + 1
            continue
        if tag in _BLOCKS:
            flush()
            if tag in _CLOSES_P:
                close(("p",), frozenset(("td", "th", "table", "button")))
            if tag in _SAME:
                close(_SAME[tag], frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        if tag in _VOID:
            continue
        stack.append((tag, zone, owner))
        if tag in _CONTAINERS:
            out.parents.append(owner)
            owner = len(out.parents) - 1
        inner = _zone(tag, source, zone)
        if inner != zone:
            flush()
            zone = inner
    flush()
    return out


def streams(pages: list[Page], hosts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The token stream of some pages: hash of (host, first RUN tokens) of each suffix, whether it has as many, and page and block of each token.

    A block ends in a token of its own. Suffixes that are shorter than RUN tokens in their page begin no run.
    """
    texts = [f" {_END} ".join([*p.texts, ""]).encode("utf-8", "replace") for p in pages]
    hashes, sizes = word_hashes(texts)
    lengths = np.array([t.count(" ") + 2 for p in pages for t in p.texts], np.int64)
    block = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    page = np.repeat(np.arange(len(pages), dtype=np.int32), sizes)
    grams = np.zeros(len(hashes), np.uint64)
    full = runs(hashes, RUN)
    grams[: len(full)] = full
    of_host = np.array([int.from_bytes(zlib.crc32(h.encode("utf-8", "replace")).to_bytes(4, "little") + len(h).to_bytes(4, "little"), "little") for h in hosts] or [0], np.uint64)
    grams = mix(grams ^ mix(of_host)[page]) if len(hashes) else grams
    whole = np.arange(len(hashes)) + RUN <= np.repeat(np.cumsum(sizes), sizes)
    return grams, whole, page, block


def frequencies(grams: np.ndarray, whole: np.ndarray, block: np.ndarray, pages_with: np.ndarray) -> np.ndarray:
    """How many pages have the run around each token: the most of the array's intervals that cover it.

    ``pages_with`` has the number of pages of each whole suffix. Tokens of pages shorter than RUN are the page's own.
    """
    out = np.ones(len(block), np.int64)
    at = np.flatnonzero(whole)
    for k in range(RUN):
        out[at + k] = np.maximum(out[at + k], pages_with)
    return out


def suffixes(found: Iterable[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct whole suffixes of several streams, sorted, and how many pages have each."""
    keys = [np.zeros(0, np.uint64)]
    for grams, whole, page, _ in found:
        g, p = grams[whole], page[whole]
        by = np.argsort(g)
        g, p = g[by], p[by]
        first = hashsets.first_of(g)
        at = np.flatnonzero(~first | ~np.append(first[1:], True))  # those that are there twice; a page counts once
        at = at[np.lexsort((p[at], g[at]))]
        keep = np.ones(len(g), bool)
        keep[at[1:][(g[at][1:] == g[at][:-1]) & (p[at][1:] == p[at][:-1])]] = False
        keys.append(g[keep])
    g = np.concatenate(keys)
    keys.clear()
    g.sort()
    start = np.flatnonzero(hashsets.first_of(g))
    return g[start], np.diff(np.append(start, len(g)))


def assemble(page: Page, counts: list[np.ndarray], structure: bool = True) -> str:
    """The main text of a page from its blocks and the number of pages that have each token (a last one for the block's end).

    ``structure=False`` leaves out what tags say, for comparison.
    """
    zones = page.zones if structure else [PLAIN] * len(page.zones)
    if structure and MAIN not in zones:  # content inside a frame that only its class marks, else that frame's text
        last = next((z for z in (SOFT_MAIN, PLAIN, SOFT) if z in zones), PLAIN)
        zones = [MAIN if z == last == SOFT_MAIN else PLAIN if z == last else z for z in zones]
    own = [i for i, z in enumerate(zones) if z in (MAIN, PLAIN)]
    weights = {i: float((1.0 / counts[i][:-1]).sum()) for i in own}
    total = sum(weights.values())
    main = [i for i in own if zones[i] == MAIN]
    if main and sum(weights[i] for i in main) >= TRUST * total:
        return "\n".join(page.texts[i] for i in main)
    if not own:
        return ""
    held = [0.0] * len(page.parents)
    for i in own:
        held[page.owners[i]] += weights[i]
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
    place = 0
    while inner := [e for e in range(place + 1, len(held)) if page.parents[e] == place and held[e] >= MOST * total]:
        place = inner[0]
    inside = [e == place for e in range(len(held))]
    for e in range(place + 1, len(held)):
        inside[e] = inside[e] or inside[page.parents[e]]
    blocks = [i for i in own if inside[page.owners[i]]]
    # The page's own text has the least numbers of pages that hold half of the weight of the element.
    flat = np.sort(np.concatenate([counts[i][:-1] for i in blocks]))
    base = flat[np.searchsorted(np.cumsum(1.0 / flat), (1.0 / flat).sum() / 2)]
    filled: dict[int, bool] = {}
    for i in blocks:
        e = page.owners[i]
        repeated = bool((counts[i][:-1] > base).all())
        while e != place:
            filled[e] = filled.get(e, True) and repeated
            e = page.parents[e]
    out = []
    for i in blocks:
        if filled.get(page.owners[i], False):
            continue
        words = page.texts[i].split(" ")
        if place == 0:
            gone = counts[i][:-1] > base
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a < RUN and b - a < len(gone):
                    gone[a:b] = False  # a run that only reaches into the block from the next one
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        if words:
            out.append(" ".join(words))
    return "\n".join(out)


def host(url: Column) -> Column:
    """Host of an address in lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", structure: bool = True, array: bool = True) -> DataFrame:
    """(key, url, text), one row for each row of the input.

    Null and empty pages give an empty text; pages without an address share the host ''. Every row is a page of its own,
    also where rows agree. Other columns are not read. ``structure`` and ``array`` switch off what tags and what other
    pages say, for comparison.
    """
    spark = df.sparkSession
    kinds = [df.schema[c].dataType.simpleString() for c in (key, url)]
    place = F.monotonically_increasing_id()
    rows = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host(F.col(url)).alias("_host"), F.col(page).alias("_html"), place.alias("_place"))
    total = df.agg(F.sum(F.octet_length(page))).first()[0] or 0
    size = min(CHUNK, -(-total // common.partitions(spark)))
    bits = (max(common.partitions(spark), -(-total // CHUNK)) - 1).bit_length()  # buckets of suffixes: 2^bits
    lead = min(64, max(1, bits, (SPARE * total // 7).bit_length()))  # a token of a page takes some 7 bytes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Chunks are rows that follow each other in the input: a host may have any number of pages.
        chunk, filled = None, 0
        for b in common.sliced(batches, 250):
            octets = np.maximum(pc.fill_null(pc.binary_length(b.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64), 64)  # empty ones are rows too
            start = 0
            while start < len(b):
                stop = start + max(1, int(np.searchsorted(np.cumsum(octets[start:]), PIECE, side="right")))
                part = b.slice(start, stop - start)
                if chunk is None or filled + int(octets[start:stop].sum()) > size:
                    chunk, filled = part.column(4)[0].as_py(), 0
                filled += int(octets[start:stop].sum())
                found = [parse(x) for x in part.column(3).to_pylist()]
                fields = [[getattr(p, x) for p in found] for x in ("texts", "zones", "owners", "parents")]
                plain = json.dumps(fields, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(i)) for i in range(3)]
                packed = pa.Codec("zstd", compression_level=9).compress(plain, asbytes=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), *lists, pa.array([len(plain)], pa.int64()), pa.array([packed], pa.binary())],
                    names=["_chunk", "_keys", "_urls", "_hosts", "_size", "_packed"],
                )
                start = stop

    chunks = rows.mapInArrow(pack, f"_chunk long, _keys array<{kinds[0]}>, _urls array<{kinds[1]}>, _hosts array<string>, _size long, _packed binary")

    def pieces(t: pa.Table) -> Iterator[tuple[list[Page], list[str]]]:
        for hosts, n, x in zip(t["_hosts"].to_pylist(), t["_size"].to_pylist(), t["_packed"], strict=True):
            yield [Page(*p) for p in zip(*json.loads(pa.Codec("zstd").decompress(x.as_buffer(), n, asbytes=True)), strict=True)], hosts

    def ask(t: pa.Table) -> pa.Table:
        """The leading bits of a chunk's suffixes, for each bucket."""
        values = hashsets.tops(np.sort(np.concatenate([g[w] for g, w, _, _ in (streams(*x) for x in pieces(t))])), lead)
        edges = hashsets.edges(values, lead, bits)
        inside = np.uint64((1 << (lead - bits)) - 1)
        used = np.flatnonzero(np.diff(edges))
        sets = [hashsets.pack(values[edges[b] : edges[b + 1]] & inside, lead - bits) for b in used]
        return pa.table(
            {
                "_bucket": pa.array(used, pa.int32()),
                "_chunk": pa.array([t["_chunk"][0].as_py()] * len(used), pa.int64()),
                "n": pa.array(np.diff(edges)[used], pa.int32()),
                "suffixes": pa.array(sets, pa.binary()),
            }
        )

    def tell(t: pa.Table) -> pa.Table:
        """Which of them another chunk has."""
        sizes = t["n"].to_pylist()
        again = hashsets.repeated(np.concatenate([hashsets.unpack(x, n, lead - bits) for x, n in zip(t["suffixes"].to_pylist(), sizes, strict=True)]))
        marks = [hashsets.pack_marks(x) if x.any() else None for x in np.split(again, np.cumsum(sizes)[:-1])]
        out = pa.table({"_chunk": t["_chunk"], "_bucket": t["_bucket"], "marks": pa.array(marks, pa.binary())})
        return out.filter(pc.is_valid(out["marks"]))

    def marked(g: np.ndarray, told: pa.Table) -> np.ndarray:
        """Whether marks name the leading bits of each suffix."""
        values = hashsets.tops(g, lead)
        edges = hashsets.edges(values, lead, bits)
        out = np.zeros(len(values), bool)
        for b, x in zip(told["_bucket"].to_pylist(), told["marks"].to_pylist(), strict=True):
            out[edges[b] : edges[b + 1]] = hashsets.unpack_marks(x, edges[b + 1] - edges[b])
        return out[np.cumsum(hashsets.first_of(g >> np.uint64(64 - lead))) - 1] if len(g) else out

    def ask_whole(t: pa.Table, told: pa.Table) -> pa.Table:
        """The whole suffixes that are left, with their numbers of pages."""
        g, m = suffixes(streams(*x) for x in pieces(t)) if len(told) else suffixes([])
        mine = marked(g, told)
        g, m = g[mine], m[mine]
        edges = hashsets.edges(g, 64, bits)
        inside = np.uint64((1 << (64 - bits)) - 1)
        asked = [(b, x, slice(edges[b], edges[b + 1])) for b, x in zip(told["_bucket"].to_pylist(), told["marks"].to_pylist(), strict=True)]
        return pa.table(
            {
                "_bucket": pa.array([b for b, _, _ in asked], pa.int32()),
                "_chunk": pa.array([t["_chunk"][0].as_py()] * len(asked), pa.int64()),
                "n": pa.array([s.stop - s.start for _, _, s in asked], pa.int32()),
                "marks": pa.array([x for _, x, _ in asked], pa.binary()),
                "suffixes": pa.array([hashsets.pack(g[s] & inside, 64 - bits) for _, _, s in asked], pa.binary()),
                "m": pa.array([zlib.compress(m[s].astype("<i8").tobytes(), 1) for _, _, s in asked], pa.binary()),
            }
        )

    def tell_whole(t: pa.Table) -> pa.Table:
        """The numbers of pages in all chunks."""
        sizes = t["n"].to_pylist()
        g = np.concatenate([hashsets.unpack(x, n, 64 - bits) for x, n in zip(t["suffixes"].to_pylist(), sizes, strict=True)])
        m = np.concatenate([np.frombuffer(zlib.decompress(x), "<i8") for x in t["m"].to_pylist()])
        sums = [zlib.compress(x.tobytes(), 1) for x in np.split(hashsets.totals(g, m), np.cumsum(sizes)[:-1])]
        return pa.table({"_chunk": t["_chunk"], "_bucket": t["_bucket"], "marks": t["marks"], "m": pa.array(sums, pa.binary())})

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("_bucket")
        read = list(pieces(t))
        found = [streams(*x) for x in read]
        g, m = suffixes(found)
        if len(told):
            m[marked(g, told)] = np.concatenate([np.frombuffer(zlib.decompress(x), "<i8") for x in told["m"].to_pylist()])
        g, m = g[m > 1], m[m > 1]
        out = []
        for (pages, _), (grams, whole, _, block) in zip(read, found, strict=True):
            mine = grams[whole]
            with_ = np.ones(len(mine), np.int64)
            if len(g) and array:
                at = np.minimum(np.searchsorted(g, mine), len(g) - 1)
                with_ = np.where(g[at] == mine, m[at], 1)
            counts = np.split(frequencies(grams, whole, block, with_), np.cumsum(np.bincount(block))[:-1]) if len(block) else []
            at = 0
            for p in pages:
                out.append(assemble(p, counts[at : at + len(p.texts)], structure))
                at += len(p.texts)
        return pa.table({"_key": pc.list_flatten(t["_keys"]), "_url": pc.list_flatten(t["_urls"]), "_text": pa.array(out, pa.string())})

    asked = chunks.groupBy("_chunk").applyInArrow(ask, "_bucket int, _chunk long, n int, suffixes binary")
    told = asked.groupBy("_bucket").applyInArrow(tell, "_chunk long, _bucket int, marks binary")
    asked = chunks.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(ask_whole, "_bucket int, _chunk long, n int, marks binary, suffixes binary, m binary")
    told = asked.groupBy("_bucket").applyInArrow(tell_whole, "_chunk long, _bucket int, marks binary, m binary")
    out = chunks.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(finish, f"_key {kinds[0]}, _url {kinds[1]}, _text string")
    return out.select(F.col("_key").alias(key), F.col("_url").alias(url), F.col("_text").alias("text"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = extract(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Over pages whose text is an article of h1, p, b and br, as those of the given tables are.
OP1_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:h1|p)>') AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
