"""Registered queries on pages and reports: every part is a page with markup, and some have a French sibling.

English pages lie below api/ (every third part, with its operation) or build/guides/. Even parts have a French page with
the same blocks; of those, every third has one heading more, every fifth no description and every seventh another link.
French pages of parts that 11 divides have no English page.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.catalog import _t, query
from lorekit.functions import diff, markdown, providers
from lorekit.functions import text as X
from lorekit.operators import drift, locale, stats
from lorekit.operators.spread import spread
from lorekit.plans import corpus
from lorekit.sources import pages as P
from lorekit.sources import specs, tree

BODY = """# Head {k}

See [one](/build/guides/g{l}) and [two](/api/none/{k}#x).

```ts
const x = "[no](/start/never)";
```

<Card href="/start/c{k}">
inner
</Card>

Last `code` text.
"""
_META = "---\ntitle: Part {k}\n{d}method: get\npath: /parts/{k}\noperationId: op{k}\n---\n\n"


def _rows(spark, d) -> DataFrame:
    """(k, relative_path, raw) of all pages."""
    k = F.col("p_partkey")
    part = spread(_t(spark, d, "part").select(k.alias("n")))
    n, key = F.col("n"), F.col("n").cast("string")
    name = F.when(n % 3 == 0, F.concat(F.lit("api/parts/P"), key)).otherwise(F.concat(F.lit("build/guides/g"), key))
    own = part.where("n % 11 <> 0").select(n, name.alias("name"), F.lit("").alias("end"), F.lit(True).alias("described"), F.lit(False).alias("headed"), key.alias("link"))
    french = part.where("n % 2 = 0").select(n, name.alias("name"), F.lit(".fr").alias("end"), (n % 5 != 0).alias("described"), (n % 3 == 0).alias("headed"), F.when(n % 7 == 0, F.lit("other")).otherwise(key).alias("link"))
    rows = own.unionByName(french)
    meta = F.replace(F.replace(F.lit(_META), F.lit("{d}"), F.when(F.col("described"), 'description: "A: {k}"\n').otherwise("")), F.lit("{k}"), key)
    body = F.replace(F.replace(F.lit(BODY), F.lit("{k}"), key), F.lit("{l}"), F.col("link"))
    return rows.select("n", F.concat("name", "end", F.lit(".mdx")).alias("relative_path"), F.concat(meta, body, F.when(F.col("headed"), "\n## More\n").otherwise("")).alias("raw"))


def _pages(spark, d) -> DataFrame:
    return markdown.with_blocks(P.pages(_rows(spark, d)))


_P = """p AS (SELECT p_partkey AS n, p_partkey::VARCHAR AS k, CASE WHEN p_partkey % 3 = 0 THEN 'api/parts/P' ELSE 'build/guides/g' END || p_partkey AS name FROM part),
a AS (SELECT n, k, name, name || '.mdx' AS relative_path, 'en' AS locale, true AS described, false AS headed, k AS link FROM p WHERE n % 11 <> 0
  UNION ALL SELECT n, k, name, name || '.fr.mdx', 'fr', n % 5 <> 0, n % 3 = 0, CASE WHEN n % 7 = 0 THEN 'other' ELSE k END FROM p WHERE n % 2 = 0)"""


@query(f"WITH {_P} SELECT relative_path, name AS slug, locale, 'Part ' || k AS title, CASE WHEN described THEN 'A: ' || k END AS description, 'GET' AS method, '/parts/' || k AS path, 'op' || k AS operation_id, '# Head ' || k AS first_line FROM a")
def page_rows(spark, d):
    """Pages of a tree: slug, locale and frontmatter."""
    out = P.pages(_rows(spark, d))
    return out.select("relative_path", "slug", "locale", "title", "description", "method", "path", "operation_id", F.get(F.split("body_preview", "\n"), F.lit(0)).alias("first_line"))


_BLOCKS = f"""{_P}, x AS (SELECT relative_path, 0 AS index, 'heading' AS kind, 'Head ' || k AS content FROM a UNION ALL SELECT relative_path, 1, 'prose', 'See one and two.' FROM a
UNION ALL SELECT relative_path, 2, 'code_fence', '```ts' || chr(10) || 'const x = "[no](/start/never)";' || chr(10) || '```' FROM a UNION ALL SELECT relative_path, 3, 'jsx', '<Card href="/start/c' || k || '">' || chr(10) || 'inner' || chr(10) || '</Card>' FROM a
UNION ALL SELECT relative_path, 4, 'prose', 'Last code text.' FROM a UNION ALL SELECT relative_path, 5, 'heading', 'More' FROM a WHERE headed)"""


@query(f"WITH {_BLOCKS} SELECT * FROM x")
def page_blocks(spark, d):
    return _pages(spark, d).select("relative_path", F.explode("blocks").alias("b")).select("relative_path", "b.index", "b.kind", "b.content")


_SEGMENTS = f"""{_BLOCKS}, s AS (SELECT relative_path, 'body:' || index AS seg_key, md5(content) AS hash, content AS value, kind IN ('prose', 'heading') AS translatable FROM x
UNION ALL SELECT relative_path, 'frontmatter:title', md5('Part ' || k), 'Part ' || k, true FROM a UNION ALL SELECT relative_path, 'frontmatter:description', md5('A: ' || k), 'A: ' || k, true FROM a WHERE described)"""


@query(f"WITH {_SEGMENTS} SELECT relative_path, seg_key, hash, translatable FROM s")
def page_segments(spark, d):
    return markdown.segments(_pages(spark, d)).drop("value")


@query(f"WITH {_SEGMENTS} SELECT relative_path, 'fr' AS target, seg_key, value FROM s WHERE translatable AND relative_path NOT LIKE '%.fr.mdx'")
def translatable_segments(spark, d):
    own = P.english(_pages(spark, d))
    segments = markdown.segments(own)
    return locale.pending(segments, segments.select("relative_path", "seg_key", "hash").limit(0), ["fr"], force=True)


@query(f"WITH {_P} SELECT relative_path, unnest(['build/guides/g' || link, 'api/none/' || k, 'start/never']) AS slug FROM a")
def page_links(spark, d):
    """Links of the raw text: those in code count, those in attributes do not."""
    return drift.links(P.pages(_rows(spark, d)))


@query(f"""WITH {_P}, l AS (SELECT relative_path, unnest(['build/guides/g' || link, 'api/none/' || k, 'start/never']) AS slug FROM a WHERE locale = 'en')
SELECT 'guide_dead_link' AS category, 'Dead internal link in ' || relative_path || ': /' || slug AS message, relative_path AS file FROM l WHERE slug NOT IN (SELECT name FROM a) AND slug NOT IN ('api/parts', 'build/guides')""")
def page_dead_links(spark, d):
    rows = P.pages(_rows(spark, d))
    return drift.dead_links(rows, P.valid_slugs(rows))


@query(f"WITH {_P} SELECT DISTINCT name AS slug FROM a UNION SELECT 'api/parts' UNION SELECT 'build/guides'")
def valid_slugs(spark, d):
    return P.valid_slugs(P.pages(_rows(spark, d)))


@query(f"WITH {_P} SELECT relative_path, CASE WHEN headed THEN 2 ELSE 1 END AS headings, CASE WHEN described THEN ['description', 'title'] ELSE ['title'] END AS keys, ['start/never'] AS links FROM a")
def page_structure(spark, d):
    """Headings, translated frontmatter keys and links of the blocks, whose prose keeps no link."""
    return locale.structure(_pages(spark, d))


_PAIRED = "j AS (SELECT e.relative_path, f.n, f.headed, f.described FROM a e JOIN a f ON e.n = f.n AND e.locale = 'en' AND f.locale = 'fr')"


@query(f"""WITH {_P}, {_PAIRED} SELECT 'locale_structure' AS category, 'Heading count mismatch EN=1 FR=2 for ' || relative_path AS message, relative_path AS file FROM j WHERE headed
UNION ALL SELECT 'locale_structure', 'Frontmatter key mismatch for ' || relative_path, relative_path FROM j WHERE NOT described""")
def page_structure_issues(spark, d):
    rows = _pages(spark, d)
    return locale.structure_issues(locale.pairs(P.english(rows), rows, ["fr"]), locale.structure(rows))


@query(f"""WITH {_P}, {_PAIRED}, i AS (SELECT 'locale_structure' AS category, 'Heading count mismatch EN=1 FR=2 for ' || relative_path AS message, relative_path AS file FROM j WHERE headed
UNION ALL SELECT 'locale_structure', 'Frontmatter key mismatch for ' || relative_path, relative_path FROM j WHERE NOT described
UNION ALL SELECT 'locale_orphan', 'Orphan fr page with no EN source: ' || relative_path, relative_path FROM a WHERE locale = 'fr' AND n % 11 = 0
UNION ALL SELECT 'locale_gap', 'Missing fr sibling for ' || relative_path, relative_path FROM a WHERE locale = 'en' AND n % 2 <> 0
UNION ALL SELECT 'locale_stale', 'EN segments changed since lock for ' || relative_path, relative_path FROM j WHERE n % 4 = 0)
SELECT category, message, file FROM i""")
def locale_report(spark, d):
    """All locale issues, against a lock that has other hashes for the first block of every fourth page.

    Bodies are split once; the hashes and structures that several joins read are kept on the executors' disks.
    """
    rows = P.pages(_rows(spark, d))
    split = markdown.with_blocks(rows).select("relative_path", "locale", "frontmatter", "blocks").persist(StorageLevel.DISK_ONLY)
    segments = markdown.segments(P.english(split)).select("relative_path", "seg_key", "hash").persist(StorageLevel.DISK_ONLY)
    shapes = locale.structure(split).persist(StorageLevel.DISK_ONLY)
    for x in (split, segments, shapes):
        x.count()  # here and not by each of the joins that start at once
    split.unpersist()
    number = F.regexp_extract("relative_path", r"(\d+)\.mdx$", 1).cast("long")
    lock = segments.select("relative_path", "seg_key", F.when((F.col("seg_key") == "body:0") & (number % 4 == 0), F.lit("0")).otherwise(F.col("hash")).alias("hash"))
    return drift.numbered(locale.sync_issues(rows, segments, lock, True, ["fr"], shapes=shapes)).drop("seq")


@query(f"WITH {_P}, {_PAIRED}, s AS (SELECT 'Manually align FR structure with EN source' AS step WHERE EXISTS (SELECT 1 FROM j WHERE headed OR NOT described) UNION ALL SELECT 'Remove orphan FR pages or restore EN source' WHERE EXISTS (SELECT 1 FROM a WHERE locale = 'fr' AND n % 11 = 0) UNION ALL SELECT 'lorekit sync-i18n --scaffold-missing' UNION ALL SELECT 'lorekit sync-i18n lock') SELECT step FROM s")
def locale_steps(spark, d):
    return drift.locale_next_steps(locale_report(spark, d))


# Operations: those of the parts that 5 divides are not public, those of the parts that 13 divides are known but no page has them.


def _operations(spark, d):
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('{"paths":{"/parts/'), key, F.lit('":{"get":{"operationId":"op'), key, F.lit('","summary":"Part '), key, F.lit('"}},"/extra/'), key, F.lit('":{"delete":{"operationId":"no'), key, F.lit('"},"parameters":[]}}}'))
    return specs.operations(_t(spark, d, "part").select(text.alias("json")))


def _public(spark, d):
    part = _t(spark, d, "part").where("p_partkey % 5 <> 0")
    allowed = part.select(F.concat(F.lit('["GET /parts/'), F.col("p_partkey").cast("string"), F.lit('"]')).alias("json"))
    more = _t(spark, d, "part").where("p_partkey % 13 = 0").select(F.concat(F.lit('["DELETE /extra/'), F.col("p_partkey").cast("string"), F.lit('"]')).alias("json"))
    return specs.public_operations(_operations(spark, d), specs.allowlist(allowed.unionByName(more)))


@query("SELECT 'GET /parts/' || p_partkey AS op_key FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'DELETE /extra/' || p_partkey FROM part WHERE p_partkey % 13 = 0")
def public_operations(spark, d):
    return _public(spark, d).select("op_key")


def _methods(spark, d):
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"generatedAt":"x","sdk":{"s'), key, F.lit('":["make'), key, F.lit('","operationId"]}}'))
    return specs.sdk_methods(_t(spark, d, "supplier").select(text.alias("json")))


@query("SELECT 's' || s_suppkey AS service, unnest(['make' || s_suppkey, 'operationId']) AS method, 'sdk.s' || s_suppkey || '.' || unnest(['make' || s_suppkey, 'operationId']) AS qualified FROM supplier")
def sdk_manifest(spark, d):
    return _methods(spark, d)


@query("SELECT 'GET /parts/' || p_partkey AS op_key, 'op' || p_partkey AS operation_id FROM part UNION ALL SELECT 'DELETE /extra/' || p_partkey, 'no' || p_partkey FROM part")
def operation_map(spark, d):
    twice = _operations(spark, d)
    return specs.operation_map(twice.unionByName(twice)).select("op_key", F.col("operation.operation_id").alias("operation_id"))


@query(f"WITH {_P} SELECT 'GET /parts/' || k AS op_key, relative_path FROM a WHERE locale = 'en'")
def documented_operations(spark, d):
    return P.documented_operations(P.pages(_rows(spark, d)))


@query("SELECT 'GET' AS method, '/parts/7' AS path, 'op7' AS operation_id FROM part WHERE p_partkey = 7")
def matching_operations(spark, d):
    return corpus.matching_operations(_operations(spark, d), "get", "/parts/7").select("method", "path", "operation_id")


_REPORT = f"""{_P}, l AS (SELECT relative_path, unnest(['build/guides/g' || link, 'api/none/' || k, 'start/never']) AS slug FROM a WHERE locale = 'en'),
r AS (SELECT 0 AS part, 'missing_endpoint' AS category, 'OpenAPI operation missing MDX: GET /parts/' || k AS message, NULL AS file FROM p WHERE n % 5 <> 0 AND n % 11 = 0
UNION ALL SELECT 0, 'missing_endpoint', 'OpenAPI operation missing MDX: DELETE /extra/' || k, NULL FROM p WHERE n % 13 = 0
UNION ALL SELECT 1, 'orphan_doc', 'MDX documents unknown or non-public OpenAPI operation: GET /parts/' || k, relative_path FROM a WHERE locale = 'en' AND n % 5 = 0
UNION ALL SELECT 2, 'locale_gap', 'Missing French sibling for ' || relative_path, relative_path FROM a WHERE locale = 'en' AND n % 2 <> 0
UNION ALL SELECT 3, 'sdk_unmentioned', 'SDK method not mentioned in docs: sdk.s' || s_suppkey || '.make' || s_suppkey, NULL FROM supplier
UNION ALL SELECT 4, 'guide_dead_link', 'Dead internal link in ' || relative_path || ': /' || slug, relative_path FROM l WHERE slug NOT IN (SELECT name FROM a) AND slug NOT IN ('api/parts', 'build/guides'))"""


def _report(spark, d):
    rows = _pages(spark, d)
    return drift.report(_public(spark, d), rows, P.valid_slugs(rows), _methods(spark, d))


@query(f"WITH {_REPORT} SELECT category, message, file, (row_number() OVER (PARTITION BY category ORDER BY file, message))::INT AS place FROM r")
def drift_report(spark, d):
    """The whole report; ``place`` shows that seq sorts by file and message within a kind of check."""
    from pyspark.sql import Window

    return _report(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("seq"))).drop("seq")


@query(f"WITH {_REPORT}, s AS (SELECT min(part) AS part, CASE category WHEN 'missing_endpoint' THEN 'lorekit scaffold' WHEN 'locale_gap' THEN 'lorekit sync-i18n --scaffold-missing' WHEN 'guide_dead_link' THEN 'Fix dead internal links in MDX' END AS step FROM r GROUP BY step) SELECT step, (row_number() OVER (ORDER BY part))::INT AS place FROM s WHERE step IS NOT NULL")
def report_steps(spark, d):
    """Next steps in the order in which their issues first appear."""
    steps = drift.next_steps(_report(spark, d)).collect()
    return spark.createDataFrame([(r["step"], i + 1) for i, r in enumerate(steps)], "step string, place int")


@query(f"WITH {_REPORT}, f AS (SELECT * FROM r ORDER BY part, file NULLS FIRST, message LIMIT 30) SELECT 'drift' AS source, CASE category WHEN 'missing_endpoint' THEN 1 WHEN 'orphan_doc' THEN 2 WHEN 'guide_dead_link' THEN 2 WHEN 'sdk_unmentioned' THEN 3 ELSE 4 END AS priority, CASE category WHEN 'missing_endpoint' THEN 'lorekit scaffold' END AS command, category AS title, message AS detail FROM f UNION ALL SELECT 'i18n', 2, 'lorekit sync-i18n --scaffold-missing', 'locale_gap', 'pages without a sibling in a target locale: ' || (SELECT count(*) FROM a WHERE locale = 'en' AND n % 2 <> 0)")
def suggested_actions(spark, d):
    """Actions of the first thirty issues, and the sum of the gaps."""
    found = _report(spark, d)
    return corpus.actions(found, found.where("category = 'locale_gap'"))


@query(f"WITH {_REPORT}, f AS (SELECT * FROM r ORDER BY part, file NULLS FIRST, message LIMIT 40), q AS (SELECT replace(message, 'OpenAPI operation missing MDX: ', '') AS query FROM f WHERE category = 'missing_endpoint' UNION SELECT replace(replace(file, '.mdx', ''), '/', ' ') FROM f WHERE file IS NOT NULL UNION SELECT replace(message, 'SDK method not mentioned in docs: ', '') FROM f WHERE category = 'sdk_unmentioned') SELECT query FROM q")
def issue_queries(spark, d):
    return corpus.issue_queries(_report(spark, d))


@query("SELECT 'drift' AS source, 'locale_gap' AS title FROM part WHERE p_partkey = 1 UNION ALL SELECT 'ai', 'New ' || r_regionkey FROM region")
def recommended_actions(spark, d):
    """Recommended actions are added unless an action has their title."""
    acts = spark.range(1).select(F.lit("drift").alias("source"), F.lit(1).alias("priority"), F.lit("c").alias("command"), F.lit("locale_gap").alias("title"), F.lit("d").alias("detail"))
    region = _t(spark, d, "region")
    new = region.select(F.lit("ai").alias("source"), F.lit(1).alias("priority"), F.lit("c").alias("command"), F.explode(F.array(F.concat(F.lit("New "), F.col("r_regionkey").cast("string")), F.lit("locale_gap"))).alias("title"), F.lit("d").alias("detail"))
    return corpus.with_recommendations(acts, new).select("source", "title")


@query(f"WITH {_P} SELECT relative_path, unnest(['GET', 'GET /parts/' || k, '/parts/' || k, 'op' || k, 'Part ' || k] || CASE WHEN n % 3 = 0 THEN ['parts'] ELSE ['build', 'guides'] END) AS query FROM a")
def page_queries(spark, d):
    return corpus.page_query_rows(P.pages(_rows(spark, d)))


@query(f"WITH {_P} SELECT relative_path FROM a WHERE locale = 'en' AND name LIKE 'api/%'")
def source_pages(spark, d):
    return P.source_pages(P.pages(_rows(spark, d)), "docs", ["docs/api/**/*.mdx", "docs/build/**"], ["docs/build/guides/*"]).select("relative_path")


@query(f"WITH {_P} SELECT relative_path FROM a WHERE locale = 'en'")
def source_pages_fallback(spark, d):
    """Globs that take nothing leave all English pages."""
    return P.source_pages(P.pages(_rows(spark, d)), "docs", ["other/**"], []).select("relative_path")


_HEAD = "'---' || chr(10) || CASE WHEN described THEN 'description: \"A: ' || k || '\"' || chr(10) ELSE '' END || 'method: get' || chr(10) || 'operationId: op' || k || chr(10) || 'path: /parts/' || k || chr(10)"
_TAIL = """chr(10) || chr(10) || '```ts' || chr(10) || 'const x = "[no](/start/never)";' || chr(10) || '```' || chr(10) || chr(10) || '<Card href="/start/c' || k || '">' || chr(10) || 'inner' || chr(10) || '</Card>' || chr(10) || chr(10)"""


def _with_updates(spark, d, updates):
    own = _pages(spark, d).where("locale = 'fr'").select("relative_path", "frontmatter", "blocks")
    return markdown.with_updates(own.select(F.col("relative_path").alias("target_path"), "frontmatter", "blocks", F.col("frontmatter").alias("t_meta"), F.col("blocks").alias("t_blocks"), updates.alias("updates")))


@query(f"WITH {_P} SELECT relative_path AS target_path, {_HEAD} || 'title: Part ' || k || chr(10) || '---' || chr(10) || chr(10) || 'Head ' || k || chr(10) || chr(10) || 'See one and two.' || {_TAIL} || 'Last code text.' || chr(10) || chr(10) || CASE WHEN headed THEN 'More' || chr(10) || chr(10) ELSE '' END AS page FROM a WHERE locale = 'fr'")
def serialized_pages(spark, d):
    return _with_updates(spark, d, F.create_map().cast("map<string,string>"))


@query(f"WITH {_P} SELECT relative_path AS target_path, {_HEAD} || 'title: Pièce' || chr(10) || '---' || chr(10) || chr(10) || 'Head ' || k || chr(10) || chr(10) || 'Voir.' || {_TAIL} || 'Last code text.' || chr(10) || chr(10) || CASE WHEN headed THEN 'More' || chr(10) || chr(10) ELSE '' END AS page FROM a WHERE locale = 'fr'")
def updated_pages(spark, d):
    """Pages with a new title and a new second block."""
    return _with_updates(spark, d, F.create_map(F.lit("frontmatter:title"), F.lit("Pièce"), F.lit("body:1"), F.lit("Voir.")))


@query(f"WITH {_P} SELECT relative_path, '---' || chr(10) || 'description: \"[TODO] A: ' || k || '\"' || chr(10) || 'method: get' || chr(10) || 'operationId: op' || k || chr(10) || 'path: /parts/' || k || chr(10) || 'title: [TODO] Part ' || k || chr(10) || '---' || chr(10) || chr(10) || '{{/* TODO: translate from EN */}}' || chr(10) || chr(10) || 'Head ' || k || chr(10) || chr(10) || '<!-- TODO: translate -->' || {_TAIL} || '<!-- TODO: translate -->' || chr(10) || chr(10) AS stub FROM a WHERE locale = 'en'")
def page_stubs(spark, d):
    return markdown.with_stub(P.english(_pages(spark, d)))


@query(f"WITH {_P} SELECT locale, count(*) AS n FROM a GROUP BY locale")
def pages_by_locale(spark, d):
    return stats.histogram(P.pages(_rows(spark, d)), "locale")


# Texts: every customer has a note.


def _notes(spark, d):
    c = _t(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("intro\n# Note "), k, F.lit("\nsee [[N"), k, F.lit("]] and [[x|y]] #tag"), k, F.lit("\r\n\n#a-b c#d\n  \nlast "), "c_mktsegment")
    return c.select("c_custkey", "c_mktsegment", "c_name", text.alias("content"))


@query("SELECT c_custkey, 'N' || c_custkey AS note, 3 AS line FROM customer UNION ALL SELECT c_custkey, 'x|y', 3 FROM customer")
def wiki_links(spark, d):
    return markdown.wiki_links(_notes(spark, d).select("c_custkey", "content"), "content")


@query("SELECT c_custkey, '#tag' || c_custkey AS tag, 3 AS line FROM customer UNION ALL SELECT c_custkey, '#a-b', 5 FROM customer")
def tags(spark, d):
    return markdown.tags(_notes(spark, d).select("c_custkey", "content"), "content")


@query("SELECT 'ts_drift' AS category, unnest(['intro', '# Note ' || c_custkey, 'see [[N' || c_custkey || ']] and [[x|y]] #tag' || c_custkey, '#a-b c#d', 'last ' || c_mktsegment]) AS message, NULL AS file FROM customer")
def script_errors(spark, d):
    """An issue for each line of a script's output that is not blank."""
    return drift.script_errors(_notes(spark, d), "content")


@query("SELECT c_custkey, 'Note ' || c_custkey AS title FROM customer")
def first_titles(spark, d):
    return _notes(spark, d).select("c_custkey", X.first_title(F.col("content")).alias("title"))


@query("""SELECT c_mktsegment AS provider, c_mktsegment || '/' || c_name || '.md' AS relative_path, 'Note ' || c_custkey AS title, 10::BIGINT AS size_bytes FROM customer""")
def provider_documents(spark, d):
    """Documents of other providers: provider is the first directory."""
    files = _notes(spark, d).select(F.concat("c_mktsegment", F.lit("/"), "c_name", F.lit(".md")).alias("relative_path"), "content", F.lit(10).cast("long").alias("size_bytes"))
    return tree.documents_of(files)


@query("""WITH f AS (SELECT 'Note ' || c_custkey AS title, c_mktsegment || '/' || c_name || '.md' AS relative_path FROM customer ORDER BY relative_path LIMIT 50) SELECT title, relative_path FROM f WHERE contains(relative_path, '7') OR contains(lower(title), '7') ORDER BY relative_path LIMIT 3""")
def topic_documents(spark, d):
    """At most three of the first fifty documents on the topic of a page."""
    return corpus.topic_documents(provider_documents(spark, d), "build/7/x.mdx")


_NAMES = {"en": "English", "fr": "French", "es": "Spanish", "de": "German"}
_CASE = " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in _NAMES.items())


@query(f"SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE CASE lang {_CASE} END END AS name, CASE WHEN lang = 'en' THEN '' ELSE chr(10) || chr(10) || '# LANGUAGE' || chr(10) || 'The user writes in ' || CASE lang {_CASE} END || '. Answer in ' || CASE lang {_CASE} END || ' for the whole conversation.' END AS directive FROM documents")
def language_directives(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.language_name(F.col("lang")).alias("name"), X.language_directive(F.col("lang")).alias("directive"))


@query("SELECT count(*) AS n, (sum(greatest(length(text) // 4, 1)) + 100)::BIGINT AS tokens, least(100, greatest(1, (112000 // (sum(greatest(length(text) // 4, 1)) + 100)) * count(*)))::INT AS chunk_size FROM conversations")
def token_budget(spark, d):
    return providers.token_budget(_t(spark, d, "conversations"), "text", prompt_bytes=400)


@query("""SELECT c_custkey::VARCHAR AS path, '--- a/' || c_custkey || chr(10) || '+++ b/' || c_custkey || chr(10) || ' first' || chr(10) || '-' || c_mktsegment || chr(10) || '+' || c_name || chr(10) || ' last' || chr(10) AS patch, true AS changed FROM customer""")
def diff_replaced_line(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("first\n"), "c_mktsegment", F.lit("\nlast\n")).alias("a"), F.concat(F.lit("first\n"), "c_name", F.lit("\nlast\n")).alias("b"))
    return diff.with_diff(rows, "path", "a", "b")


@query("SELECT c_custkey, substr(c_name, 1, 3) || '<' || c_mktsegment || '>' || substr(c_name, 6) AS edited FROM customer")
def text_edits(spark, d):
    return _t(spark, d, "customer").select("c_custkey", diff.edit(F.col("c_name"), F.lit(3), F.lit(2), F.concat(F.lit("<"), "c_mktsegment", F.lit(">"))).alias("edited"))
