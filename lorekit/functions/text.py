"""Column functions on texts, paths and identifiers. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "python": "py pyw pyi", "javascript": "js mjs cjs", "typescript": "ts mts cts", "tsx": "tsx", "jsx": "jsx", "rust": "rs", "go": "go", "java": "java", "c": "c h",
    "cpp": "cpp cc cxx hpp hxx hh", "csharp": "cs", "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt kts", "scala": "scala", "r": "r", "lua": "lua", "shell": "sh bash zsh",
    "sql": "sql", "markdown": "md markdown", "json": "json", "yaml": "yaml yml", "toml": "toml", "xml": "xml", "html": "html htm", "css": "css", "scss": "scss sass", "vue": "vue",
    "svelte": "svelte", "dart": "dart", "elixir": "ex exs", "erlang": "erl hrl", "haskell": "hs", "ocaml": "ml mli", "terraform": "tf tfvars", "protobuf": "proto", "graphql": "graphql gql",
}
# Languages whose files are parsed for code elements.
PARSEABLE = ("python", "javascript", "jsx", "typescript", "tsx", "rust", "go", "java", "c", "cpp")
# Directories that a source scan does not enter, besides those that start with a dot.
IGNORED_DIRS = ("node_modules", "__pycache__", "target", "build", "dist", "out", "venv", "env", "vendor", "Pods", "coverage")
# Stop words by language, in the order in which ties are decided. The Portuguese list holds one word twice, and it counts twice.
STOP_WORDS = {
    "en": "the is are was were you your we our it its this that with for from have has will can do not but also what how when where who which a an and in to of on at by as be or if my so up out about all any no yes",
    "fr": "le la les un une des est sont vous nous mon et en de du il elle ils elles pas que qui sur avec dans pour par au aux été très mais comme aussi ça je tu",
    "es": "el la los las un una es son usted nosotros y en de del que por para con su sus al lo se me si no más como pero muy este esta yo tu",
    "pt": "o a os as um uma é são você nós e em de do da que por para com não se me mas muito como este este eu tu",
    "de": "der die das ein eine ist sind du wir und in von zu mit für auf dem den nicht aber auch wie was wenn bei sich ich er sie es",
    "it": "il la i le un una è sono voi noi e in di del che per con su al lo non ma anche come questo questa io tu lui",
}
# Language names, and locales that a page name can carry.
LANGUAGE_NAMES = {"en": "English", "fr": "French", "es": "Spanish", "pt": "Portuguese", "de": "German", "it": "Italian", "zh": "Chinese", "ja": "Japanese", "ko": "Korean"}
LOCALES = ("fr", "es", "zh")
# Code point ranges of the scripts that are counted.
SCRIPTS = {"han": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", "hiragana": r"[\x{3040}-\x{309F}]", "katakana": r"[\x{30A0}-\x{30FF}]", "hangul": r"[\x{AC00}-\x{D7AF}\x{3131}-\x{3163}]"}
# Fixed value: an internal link of a page, by its slug.
INTERNAL_LINK = r"\]\(/((?:start|build|api|resources)/[^)\s#]+)"
# The token budget of a model call, the tokens kept for the answer, and the largest chunk.
TOKENS_IN, TOKENS_OUT, MAX_CHUNK = 128_000, 16_000, 100


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column, unicode: bool = True) -> Column:
    flag = "(?U)" if unicode else ""
    return F.regexp_replace(text, rf"{flag}^\s+|{flag}\s+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    pieces = F.split(text, r"\r?\n", -1)
    return let(pieces, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def tokens(text: Column, unicode: bool = True) -> Column:
    """Pieces between white space; ASCII white space only where ``unicode`` is off."""
    return F.filter(F.split(text, r"(?U)\s+" if unicode else r"\s+", -1), lambda w: w != "")


def code_lines(text: Column) -> Column:
    """Number of lines that are neither blank nor begin with # or //."""
    return F.size(F.filter(lines(text), lambda x: ~F.regexp_like(x, F.lit(r"(?U)^\s*($|#|//)"))))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1, both included."""
    return F.array_join(F.slice(lines(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")


# Paths and identifiers.


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; '' if there is none. A leading dot opens a name, not an extension."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def language(path: Column) -> Column:
    """Language of a file by its extension, null for other files."""
    pairs = [(e, name) for name, ends in LANGUAGES.items() for e in ends.split()]
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), extension(path))


def is_parseable(path: Column) -> Column:
    return F.coalesce(language(path).isin(*PARSEABLE), F.lit(False))


def in_ignored_dir(relative: Column) -> Column:
    """Whether a directory above the file is hidden or ignored; the scan root itself is exempt."""
    dirs = let(F.split(relative, "/"), lambda p: F.slice(p, 1, F.size(p) - 1))
    return F.exists(dirs, lambda d: d.startswith(".") | d.isin(*IGNORED_DIRS))


def module_path(relative: Column) -> Column:
    """Dotted module of a path below the root: no extension, no final ``__init__``; null if nothing is left."""
    stem = F.regexp_replace(relative, r"(?<=[^/])\.[^./]*$", "")
    dotted = F.regexp_replace(F.translate(stem, "/\\", ".."), r"\.__init__$", "")
    return F.nullif(dotted, F.lit(""))


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("::", *parts))


def element_id(kind: Column | str, *parts: Column) -> Column:
    """Kind and twelve hex digits of the parts' hash."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit("_"), F.substring(digest(*parts), 1, 12))


def locale(path: Column) -> Column:
    """Locale by the suffix of a page's path; en if it carries none."""
    return reduce(lambda rest, loc: F.when(path.endswith(f".{loc}.mdx"), loc).otherwise(rest), reversed(LOCALES), F.lit("en"))


def slug(path: Column) -> Column:
    """Path without page suffix, locale and final index; each suffix is taken off as often as it occurs, in this order."""
    return reduce(lambda p, end: F.regexp_replace(p, rf"({end})+$", ""), (r"\.mdx", r"\.fr", r"\.es", r"\.zh", "/index"), path)


def sibling(path: Column, target: Column) -> Column:
    """Path of the page in another locale."""
    return F.when(target == "en", path).otherwise(F.replace(path, F.lit(".mdx"), F.concat(F.lit("."), target, F.lit(".mdx"))))


def source_path(path: Column, source: str = "en") -> Column:
    """Path of the source page of a locale page; itself for a source page; null for en if en is not the source."""
    loc = locale(path)
    return F.when(loc == source, path).when(loc != "en", F.replace(path, F.concat(F.lit("."), loc, F.lit(".mdx")), F.lit(".mdx")))


def operation_key(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", method, path)


def glob_pattern(pattern: str) -> str:
    """A glob as a regular expression over whole paths: ``**`` any directories, ``*`` and ``?`` within one name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            c = pattern[i]
            out, i = out + (c if c.isalnum() or c in "/_" else "\\" + c), i + 1
    return f"^{out}$"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    return reduce(lambda a, g: a | path.rlike(glob_pattern(g)), globs, F.lit(False))


# Frontmatter.


def frontmatter_parts(raw: Column) -> Column:
    """Struct (frontmatter, body): the text between a leading ``---`` and the next line that begins with it, and the rest."""
    end = F.instr(F.substr(raw, F.lit(4)), "\n---")
    split = raw.startswith("---") & (end > 0)
    head = strip(F.substr(raw, F.lit(4), end - 1))
    body = F.regexp_replace(F.substr(raw, end + 7), r"(?U)^\s+", "")
    return F.struct(F.when(split, head).otherwise("").alias("frontmatter"), F.when(split, body).otherwise(raw).alias("body"))


def frontmatter(text: Column) -> Column:
    """Map of ``key: value`` lines, one layer of quotes taken off; the last line of a key wins, other lines are passed over.

    A value of one lone quote stays as it is.
    """

    def entry(x: Column) -> Column:
        at = F.instr(x, ":")
        value = strip(F.substr(x, at + 1))
        quoted = value.rlike(r"""(?s)^(".*"|'.*')$""")
        return F.struct(strip(F.substr(x, F.lit(1), at - 1)).alias("key"), F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    entries = F.transform(F.filter(lines(text), lambda x: F.contains(x, F.lit(":"))), entry)
    last = let(entries, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"])))
    return F.map_from_entries(last)


def internal_links(text: Column) -> Column:
    """Slugs of the internal links of a text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(INTERNAL_LINK), F.lit(1))


def first_title(text: Column) -> Column:
    """Text of the first line that begins with ``# ``, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1)), F.lit(""))


# Languages and queries.


def script_counts(text: Column) -> Column:
    return F.struct(*[F.regexp_count(text, F.lit(p)).alias(name) for name, p in SCRIPTS.items()])


def stop_word_scores(words: Column) -> Column:
    """Struct of the number of stop list entries that occur among the words, by language."""
    out = []
    for code, entries in STOP_WORDS.items():
        once, twice = sorted(set(entries.split())), sorted({w for w in entries.split() if entries.split().count(w) > 1})
        n = F.size(F.array_intersect(words, F.lit(once)))
        out.append((n + F.size(F.array_intersect(words, F.lit(twice))) if twice else n).alias(code))
    return F.struct(*out)


def detect_language(text: Column, unicode: bool = True) -> Column:
    """Code of a text's language: by script from four characters on, else by stop words from three words on, else en."""

    def by_words(w: Column) -> Column:
        def best(s: Column) -> Column:
            top = F.greatest(*[s[c] for c in STOP_WORDS])
            return reduce(lambda rest, c: F.when(s[c] == top, c).otherwise(rest), reversed(list(STOP_WORDS)), F.lit("en"))

        return F.when(F.size(w) < 3, "en").otherwise(let(stop_word_scores(w), lambda s: F.when(F.greatest(*[s[c] for c in STOP_WORDS]) == 0, "en").otherwise(best(s))))

    count = lambda name: F.regexp_count(text, F.lit(SCRIPTS[name]))
    script = F.when(count("han") > 3, "zh").when(count("hiragana") + count("katakana") > 3, "ja").when(count("hangul") > 3, "ko")
    return F.coalesce(F.when(F.regexp_like(text, F.lit(r"\S")), script), let(tokens(F.lower(text), unicode), by_words), F.lit("en"))


def query_keywords(query: Column, code: Column, unicode: bool = True) -> Column:
    """Lower-case words of a query that are no stop words of its language and have three bytes or more."""
    stops = reduce(lambda rest, c: F.when(code == c, F.lit(STOP_WORDS[c].split())).otherwise(rest), [c for c in STOP_WORDS if c != "en"], F.lit(STOP_WORDS["en"].split()))
    return let(stops, lambda s: F.filter(tokens(F.lower(query), unicode), lambda w: ~F.array_contains(s, w) & (F.octet_length(w) >= 3)))


def expand_query(query: Column, code: Column, unicode: bool = True) -> Column:
    """The query and its keywords joined by OR."""
    return F.array_join(F.concat(F.array(query), query_keywords(query, code, unicode)), " OR ")


def search_terms(query: Column, unicode: bool = True) -> Column:
    """Terms that a search looks for: the query as it stands and its keywords; a keyword counts as often as it occurs."""
    terms = F.split(expand_query(query, detect_language(query, unicode), unicode), " OR ")
    return F.filter(F.transform(terms, lambda t: strip(t, unicode)), lambda t: t != "")


def language_directive(code: Column) -> Column:
    """Instruction to answer in the user's language; '' for English."""
    name = F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGE_NAMES.items() for x in p]), code)
    return F.when(code == "en", "").otherwise(F.format_string("\n\n# LANGUAGE\nThe user writes in %s. Answer in %s for the whole conversation.", name, name))


def language_name(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in ("en", "fr", "es", "zh") for x in (c, LANGUAGE_NAMES[c])]), code), code)


# Budgets, vectors and previews.


def token_estimate(text: Column) -> Column:
    """A token for each four characters, one at least."""
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("long")


def chunk_size(estimate: Column, n: Column) -> Column:
    """Segments to a model call, given the estimated tokens of n segments."""
    fit = F.floor(F.lit(TOKENS_IN - TOKENS_OUT) / F.greatest(estimate, F.lit(1))) * n
    return F.when(n == 0, 1).otherwise(F.least(F.lit(MAX_CHUNK), F.greatest(F.lit(1), fit))).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 where a norm is 0."""

    def over(n: Column) -> Column:
        x, y = (F.transform(F.slice(v, 1, n), lambda e: e.cast("double")) for v in (a, b))
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
        dot, na, nb = (total(F.zip_with(p, q, lambda e, f: e * f)) for p, q in ((x, y), (x, x), (y, y)))
        return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))

    return let(F.least(F.size(a), F.size(b)), over)


def embed_snippet(name: Column, signature: Column, docstring: Column, code: Column) -> Column:
    return F.concat_ws("\n", name, signature, docstring, F.nullif(F.substring(code, 1, 512), F.lit("")))


def snippet(name: Column, kind: Column, path: Column, line: Column, code: Column) -> Column:
    return F.format_string("### %s (%s) — %s:%d\n%s\n", name, kind, path, line, F.substring(code, 1, 800))
