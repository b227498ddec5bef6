"""Plans over texts and pages: ids, cleaning, extraction, sectioning, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from sparkgrove.functions import segment
from sparkgrove.functions import text as T
from sparkgrove.operators import chunking, corpus, overview
from sparkgrove.plans.registry import query
from sparkgrove.sources import files, urls
from sparkgrove.storage import bound_batches
from sparkgrove.tables import table

_SLUG = "coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), ''), 'doc')"


def made(spark: SparkSession, sf_dir: str, name: str, /, **columns: str) -> DataFrame:
    """Rows made from those of a table by SQL expressions that both engines read alike."""
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def made_sql(name: str, /, **columns: str) -> str:
    """The same rows in DuckDB."""
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {name})"


@query("doc_ids_slugs", f"SELECT page_id, {_SLUG.format('url')} || '-' || substr(sha1(url), 1, 6) AS doc_id FROM pages")
def doc_ids_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.document_id(F.col("url"), F.col("url")).alias("doc_id"))


@query("part_slugs", f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug FROM part")
def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("clean_text", f"SELECT doc_id, sha1({_CLEAN.format('text')}) AS cleaned, sha1(trim(regexp_replace(text, '[\\s ]+', ' ', 'g'))) AS collapsed FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.clean(F.col("text")).cast("binary")).alias("cleaned"), F.sha1(T.collapse(F.col("text")).cast("binary")).alias("collapsed"))


@query("html_to_text", r"SELECT page_id, sha1(trim(regexp_replace(regexp_replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), chr(160), ' '), '\s+', ' ', 'g'), '^ | $', '', 'g'))) AS plain FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(T.plain(F.col("html")).cast("binary")).alias("plain"))


def _visible_sql(html: str, left_out: str) -> str:
    """Text of a page in SQL: some elements and all comments go, headings get marks, blocks part words, entities are letters."""
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<({left_out})[ >].*?</({left_out})>', '', 'g')"
    for level in range(1, 7):
        out = f"regexp_replace({out}, '<h{level}[^>]*>', ' {'#' * level} ', 'g')"
    out = f"regexp_replace({out}, '</?(p|div|li|tr|br|section|article|h1|h2|h3|h4|h5|h6|pre|blockquote|td|th|ul|ol|table)[^>]*>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for entity, letter in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'")):
        out = f"replace({out}, '{entity}', {letter})"
    return f"trim(regexp_replace({out}, '[\\s' || chr(160) || ']+', ' ', 'g'))"


_PAGE = _visible_sql("regexp_replace(html, '(?s)<div class=.ad.>.*?</div>', '', 'g')", "head|script|style|nav|header|footer|aside|form|noscript|svg")


@query(
    "html_extract",
    f"""WITH t AS (SELECT page_id, trim(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', chr(34)), '&amp;', '&')) AS title, {_PAGE} AS near, {_visible_sql("html", "head|script|style|noscript|svg")} AS every FROM pages),
    u AS (SELECT page_id, title, CASE WHEN len(near) < 200 AND len(every) > len(near) THEN every ELSE near END AS text FROM t)
    SELECT page_id, title, CASE WHEN len(text) >= 100 THEN len(text) END::VARCHAR AS characters, CASE WHEN len(text) >= 100 THEN sha1(text) END AS text_sha1 FROM u""",
)
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.html_documents(table(spark, sf_dir, "pages").select("page_id", "html")).withColumn("text", T.collapse(F.col("text")))
    return found.select("page_id", "title", F.length("text").cast("string").alias("characters"), F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


@query("html_title", "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(
    "url_route",
    "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://[a-z-]+(\\.m)?\\.wikipedia\\.org/') THEN 'wikipedia' WHEN regexp_matches(url, '(?i)^https?://((www\\.)?github|raw\\.githubusercontent)\\.com/') THEN 'github' ELSE 'web' END AS route, "
    "coalesce(nullif(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''), regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS title, regexp_matches(lower(url), '^https?://') AS is_url FROM pages",
)
def url_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.route(u).alias("route"), urls.fallback_title(u).alias("title"), T.is_url(u).alias("is_url"))


@query("url_strip_query", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def url_strip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.without_query(F.col("url")).alias("url"))


#: Addresses of files, bare repositories, folders and other pages, one of each kind in turn.
_REPOS = {
    "id": "page_id",
    "url": "CASE page_id % 5 WHEN 0 THEN 'https://github.com/a' || page_id || '/b/blob/main/docs/x' || page_id || '.md?raw=1#top' WHEN 1 THEN 'https://github.com/a' || page_id || '/b' WHEN 2 THEN 'https://github.com/a/b' || page_id || '.git' WHEN 3 THEN 'https://github.com/a/b' || page_id || '/tree/main/docs' ELSE url END",
}


@query(
    "code_urls",
    f"""SELECT id, CASE WHEN regexp_matches(url, 'github\\.com/[^/]+/[^/]+/blob/') THEN 'https://raw.githubusercontent.com/' || regexp_replace(regexp_extract(url, 'github\\.com/([^?#]+)', 1), '/blob/', '/') END AS raw,
    CASE WHEN regexp_matches(url, 'github\\.com/[^/]+/[^/]+$') THEN 'https://raw.githubusercontent.com/' || regexp_replace(regexp_extract(url, 'github\\.com/([^?#]+)', 1), '\\.git$', '') || '/main/README.md' END AS first_try
    FROM {made_sql("pages", **_REPOS)}""",
)
def code_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return made(spark, sf_dir, "pages", **_REPOS).select("id", urls.raw_file(u).alias("raw"), F.get(urls.readme_candidates(u), F.lit(0)).alias("first_try"))


#: Articles with parts of references before, between and after others.
_WIKI = {
    "id": "doc_id",
    "text": "text || chr(10) || '== ' || CASE doc_id % 3 WHEN 0 THEN 'See also' WHEN 1 THEN 'History' ELSE 'REFERENCES ' END || ' ==' || chr(10) || lang || chr(10) || '=== Sub ===' || chr(10) || source || chr(10) || '==Uses ==' || chr(10) || 'end' || chr(10) || '== Notes' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '2' END || ' ==' || chr(10) || source",
}
_LINES = "l AS (SELECT id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM w)"


@query(
    "wiki_strip",
    f"""WITH w AS {made_sql("documents", **_WIKI)}, {_LINES},
    m AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*==\\s*[^=].*?\\s*==\\s*$') THEN lower(trim(regexp_extract(line, '^\\s*==\\s*([^=].*?)\\s*==\\s*$', 1))) IN ('bibliography', 'citations', 'external links', 'further reading', 'notes', 'references', 'see also', 'sources') END AS d FROM l),
    s AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY id ORDER BY n), false) AS skip FROM m)
    SELECT id, count(*) FILTER (NOT skip) AS lines, sha1(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT skip), '')) AS text_sha1 FROM s GROUP BY id""",
)
def wiki_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    stripped = F.udf(segment.without_reference_parts, ST.StringType(), useArrow=True)
    kept = made(spark, sf_dir, "documents", **_WIKI).select("id", stripped("text").alias("text"))
    return kept.select("id", F.size(chunking.lines(F.col("text"))).cast("bigint").alias("lines"), F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


#: Pages with and without a leading block; some repeat a key, some have no address.
_FRONT = {
    "id": "p_partkey",
    "text": "CASE p_partkey % 4 WHEN 0 THEN p_name || chr(10) || p_brand ELSE '---' || chr(10) || 'Title: \"' || p_name || '\"' || chr(10) || '# note: x' || chr(10) || CASE p_partkey % 4 WHEN 1 THEN 'source_url: https://x.org/' || p_partkey || '?a:b' || chr(10) WHEN 2 THEN 'title: ' || p_type || chr(10) ELSE '' END || '---' || chr(10) || '# ' || p_name || chr(10) || p_brand END",
}


@query(
    "front_matter",
    f"""WITH w AS {made_sql("part", **_FRONT)}, f AS (SELECT id, text, regexp_extract(text, '(?s)\\A---[ \\t]*\\n(.*?)\\n---[ \\t]*\\n', 1) AS block FROM w)
    SELECT id, list_last(regexp_extract_all(block, '(?im)^title:\\s*"?([^"\\n]*)"?$', 1)) AS title, nullif(regexp_extract(block, '(?m)^source_url:\\s*(.*)$', 1), '') AS url, regexp_replace(text, '(?s)\\A---[ \\t]*\\n(.*?)\\n---[ \\t]*\\n', '') AS body FROM f""",
)
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = T.front_matter(F.col("text"))
    return made(spark, sf_dir, "part", **_FRONT).select("id", F.try_element_at(meta, F.lit("title")).alias("title"), F.try_element_at(meta, F.lit("source_url")).alias("url"), T.without_front_matter(F.col("text")).alias("body"))


_HEADS = {
    "id": "p_partkey",
    "line": "CASE p_partkey % 9 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '   ## ' || p_name || ' ##' WHEN 2 THEN '    # ' || p_name WHEN 3 THEN '== ' || p_name || ' ==' WHEN 4 THEN '=== ' || p_name || '===' WHEN 5 THEN '== ' || p_name || ' ===' WHEN 6 THEN '#' || p_name WHEN 7 THEN '###### ' || p_type ELSE p_name END",
}


@query(
    "headings_levels",
    f"""WITH w AS {made_sql("part", **_HEADS)}, a AS (SELECT *, CASE WHEN starts_with(line, '    ') THEN '' ELSE regexp_extract(ltrim(line), '^(#+) ', 1) END AS h, regexp_extract(line, '^(=+)', 1) AS o, regexp_extract(line, '(=+)$', 1) AS c FROM w)
    SELECT id, (CASE WHEN h <> '' THEN len(h) WHEN o <> '' AND len(c) >= len(o) THEN len(o) END)::VARCHAR AS level,
      CASE WHEN h <> '' THEN trim(trim(line), '# ') WHEN o <> '' AND len(c) >= len(o) THEN trim(substr(line, len(o) + 1, len(line) - 2 * len(o))) END AS name FROM a""",
)
def headings_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.heading(F.col("line"))
    return made(spark, sf_dir, "part", **_HEADS).select("id", h["level"].cast("string").alias("level"), h["name"].alias("name"))


#: Every text under headings whose levels jump, with fenced code, and some in wiki style.
_SECTIONED = {
    "id": "doc_id",
    "text": "CASE WHEN doc_id % 5 = 0 THEN 'start ' || source || chr(10) || '== One ==' || chr(10) || text || chr(10) || '=== Two ===' || chr(10) || lang || chr(10) || '== Three ==' || chr(10) || ' ' || chr(10) || '== Four ==' || chr(10) || 'c' "
    "ELSE 'lead ' || source || chr(10) || '# ' || source || chr(10) || lang || chr(10) || repeat('#', 1 + CAST(doc_id % 4 AS INT)) || ' Deep ' || doc_id || chr(10) || text || chr(10) || '## Next' || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || 'next text' END",
}


@query(
    "section_paths",
    f"""WITH RECURSIVE w AS {made_sql("documents", **_SECTIONED)}, {_LINES},
    f AS (SELECT *, coalesce(sum(starts_with(line, '```')::INT) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside, starts_with(line, '```') AS fence FROM l),
    h AS (SELECT *, CASE WHEN inside OR fence THEN NULL WHEN regexp_matches(line, '^#+ ') THEN len(regexp_extract(line, '^(#+)', 1)) WHEN regexp_matches(line, '^={{2,}} .* ={{2,}}$') THEN len(regexp_extract(line, '^(=+)', 1)) END AS level, trim(line, '#= ') AS name FROM f),
    s AS (SELECT *, sum((level IS NOT NULL)::INT) OVER (PARTITION BY id ORDER BY n) AS sec FROM h),
    hd AS (SELECT id, sec, level, name FROM s WHERE level IS NOT NULL),
    st AS (SELECT id, 0::HUGEINT AS sec, []::STRUCT(l BIGINT, n VARCHAR)[] AS stack FROM w
      UNION ALL SELECT st.id, hd.sec, list_append(list_filter(stack, lambda x: x.l < hd.level), {{'l': hd.level, 'n': hd.name}}) FROM st JOIN hd ON hd.id = st.id AND hd.sec = st.sec + 1),
    b AS (SELECT id, sec, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (level IS NULL), '') AS body FROM s GROUP BY ALL)
    SELECT id, array_to_string(list_transform(stack, lambda x: x.n), ' > ') AS path, sha1(body) AS body_sha1 FROM b JOIN st USING (id, sec) WHERE trim(body, E' \\n') <> ''""",
)
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = made(spark, sf_dir, "documents", **_SECTIONED).select("id", F.explode(chunking.sections(F.col("text"))).alias("s"))
    return found.select("id", F.array_join("s.path", " > ").alias("path"), F.sha1(F.col("s.body").cast("binary")).alias("body_sha1"))


@query(
    "fence_parity",
    f"""WITH w AS {made_sql("documents", **_SECTIONED)}, {_LINES}
    SELECT id, n, coalesce(sum(starts_with(line, '```')::INT) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT % 2 AS inside FROM l""",
)
def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "documents", **_SECTIONED).select("id", F.posexplode(chunking.lines(F.col("text"))).alias("n", "line"))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("id", (F.col("n") + 1).cast("bigint").alias("n"), (F.coalesce(F.sum(T.is_fence(F.col("line")).cast("int")).over(before), F.lit(0)) % 2).cast("bigint").alias("inside"))


# the boundary is marked by a character that no text holds, since the pattern language has no look-behind
_SPLIT = r"""string_split(regexp_replace(regexp_replace({0}, '([.?!]["'')\]]?)\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '([.?!]["'')\]]?)\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
_JOINED = (
    "list_reduce(list_transform({0}, lambda x: {{'done': []::VARCHAR[], 'now': x}}), lambda a, b: CASE WHEN regexp_matches(a.now, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:al|approx|cf|dr|e\\.g|etc|fig|i\\.e|no|vs)\\.$') OR regexp_matches(a.now, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]\\.$') "
    "THEN {{'done': a.done, 'now': trim(a.now || ' ' || b.now)}} ELSE {{'done': CASE WHEN a.now = '' THEN a.done ELSE list_append(a.done, a.now) END, 'now': b.now}} END)"
)
_FLAT = "trim(regexp_replace(text, '[\\s ]+', ' ', 'g'))"
_SENTENCES = f"(SELECT doc_id, source, list_filter(list_transform(CASE WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END, lambda s: trim(s)), lambda s: s <> '') AS ss FROM (SELECT doc_id, source, {_JOINED.format(_SPLIT.format(_FLAT))} AS r FROM documents))"


@query("sentence_split", f"SELECT doc_id, len(ss) AS n, md5(array_to_string(ss, '|')) AS digest FROM {_SENTENCES}")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.sentences(T.collapse(F.col("text"))).alias("ss"))
    return found.select("doc_id", F.size("ss").cast("bigint").alias("n"), F.md5(F.array_join("ss", "|").cast("binary")).alias("digest"))


# packing as a recursion over the sentences of each document
_CHUNKS = f"""RECURSIVE s AS {_SENTENCES},
k AS (SELECT doc_id, source, ss, 1 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS cur, 0::BIGINT AS size FROM s
  UNION ALL SELECT doc_id, source, ss, i + 1, CASE WHEN flush THEN list_append(done, array_to_string(cur, ' ')) ELSE done END,
    list_append(CASE WHEN flush THEN cur[len(cur) - t + 1:] ELSE cur END, ss[i]), CASE WHEN flush THEN coalesce(list_sum(list_transform(cur[len(cur) - t + 1:], lambda x: len(x) + 1)), 0) ELSE size END::BIGINT + len(ss[i]) + 1
  FROM (SELECT *, len(cur) > 0 AND size + len(ss[i]) + 1 > 1400 AS flush,
    coalesce(list_max(list_filter(range(0, len(cur) + 1), lambda j: j = 0 OR coalesce(list_sum(list_transform(cur[len(cur) - j + 2:], lambda x: len(x) + 1)), 0) + len(cur[len(cur) - j + 1]) <= 200)), 0) AS t FROM k WHERE i <= len(ss))),
p AS (SELECT doc_id, source, ss, CASE WHEN len(cur) > 0 THEN list_append(done, array_to_string(cur, ' ')) ELSE done END AS ps FROM k WHERE i = len(ss) + 1),
g AS (SELECT doc_id, source, unnest(CASE WHEN len(list_filter(ps, lambda x: len(x) >= 120)) > 0 THEN list_filter(ps, lambda x: len(x) >= 120) ELSE list_filter(ps, lambda x: len(x) = list_max(list_transform(ps, lambda y: len(y))))[:1] END) AS text,
  unnest(range(0, CASE WHEN len(list_filter(ps, lambda x: len(x) >= 120)) > 0 THEN len(list_filter(ps, lambda x: len(x) >= 120)) ELSE 1 END)) AS chunk_no FROM p)"""


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.lit("").alias("url"), "text")


@query(
    "chunk_documents",
    f"WITH {_CHUNKS} SELECT doc_id || '#' || chunk_no AS chunk_id, doc_id, '' AS section, chunk_no, len(text) AS size, md5(text) AS text_md5, md5(source || chr(10) || chr(10) || text) AS embed_md5 FROM g",
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk(_titled(spark, sf_dir))
    return found.select("chunk_id", "doc_id", "section", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("text").cast("bigint").alias("size"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(F.col("embed_text").cast("binary")).alias("embed_md5"))


@query("chunk_pack", f"WITH {_CHUNKS} SELECT doc_id, unnest(range(0, len(ps))) AS n, unnest(list_transform(ps, lambda x: len(x))) AS size, unnest(list_transform(ps, lambda x: md5(x))) AS text_md5 FROM p")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.pack(T.sentences(T.collapse(F.col("text"))))).alias("n", "piece"))
    return packed.select("doc_id", F.col("n").cast("bigint").alias("n"), F.length("piece").cast("bigint").alias("size"), F.md5(F.col("piece").cast("binary")).alias("text_md5"))


@query("chunk_size_stats", f"WITH {_CHUNKS} SELECT count(*) AS chunks, max(len(text)) AS largest, list_sort(list(len(text)))[count(*) // 2 + 1] AS median FROM g")
def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_sizes(chunking.chunk(_titled(spark, sf_dir)))


#: Questions about the collection and about facts in it, one form in turn, and the turns themselves.
_QUESTIONS = {
    "conv_id": "conv_id",
    "turn": "turn",
    "q": "CASE conv_id % 14 WHEN 0 THEN 'Summarise everything in the ' || role WHEN 1 THEN 'What topics do these texts cover, ' || role || '?' WHEN 2 THEN 'how many documents are there' WHEN 3 THEN 'List all the articles' WHEN 4 THEN 'TL;DR' WHEN 5 THEN 'give me an overview' WHEN 6 THEN 'What is in the corpus?' "
    "WHEN 7 THEN 'Tell me about your collection' WHEN 8 THEN 'What is the limit of ' || role || '?' WHEN 9 THEN 'Who wrote an overview of ' || role WHEN 10 THEN 'How many ' || role || ' requests are there' WHEN 11 THEN 'list of ports' ELSE text END",
}


@query(
    "route_questions",
    f"""SELECT conv_id, turn, regexp_matches(lower(q), '^summarise everything in|^what topics do these|^how many documents|^list all the articles|^tl;dr$|^give me an overview|^what is in the corpus|^tell me about your collection') AS corpus_level FROM {made_sql("conversations", **_QUESTIONS)}""",
)
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "conversations", **_QUESTIONS).select("conv_id", "turn", T.is_corpus_question(F.col("q")).alias("corpus_level"))


#: Sources stand for documents and languages for their sections.
_CHUNKED = "c AS (SELECT source AS doc_id, source AS title, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || ' > x' END AS section, doc_id AS idx, source || '#' || doc_id AS chunk_id, text FROM documents)"


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat("lang", F.lit(" > x")))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("source").alias("title"), section.alias("section"), F.col("doc_id").alias("idx"), F.concat_ws("#", "source", F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("").alias("url"), "text")


_MANIFEST = f"""{_CHUNKED}, n AS (SELECT doc_id, count(*) AS n, arg_min(title, idx) AS title FROM c GROUP BY 1),
s AS (SELECT doc_id, split_part(section, ' > ', 1) AS name, min(idx) AS first FROM c WHERE section <> '' GROUP BY ALL),
m AS (SELECT doc_id, title, n, coalesce(x.sections, '(no subsections)') AS sections FROM n LEFT JOIN (SELECT doc_id, string_agg(name, ', ' ORDER BY first) AS sections FROM s GROUP BY 1) x USING (doc_id))"""


@query("manifest", f"WITH {_MANIFEST} SELECT *, '- ' || title || ' (' || n || ' passages) - sections: ' || sections AS line FROM m")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.manifest(_by_source(spark, sf_dir))


@query("lead_chunks", f"WITH {_CHUNKED} SELECT doc_id, idx, chunk_id FROM c WHERE section = '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) = 1")
def lead_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.leads(_by_source(spark, sf_dir)).select("doc_id", "idx", "chunk_id")


@query(
    "overview_context",
    f"""WITH {_MANIFEST}, l AS (SELECT * FROM c WHERE section = '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) = 1),
    b AS (SELECT 1 AS n, 'corpus#manifest' AS chunk_id, 'Corpus manifest' AS title, 'This collection contains ' || count(*) || ' documents (' || sum(n)::BIGINT || ' indexed passages in total). The documents and their sections are:' || chr(10) || chr(10) || string_agg('- ' || title || ' (' || n || ' passages) - sections: ' || sections, chr(10) ORDER BY title, doc_id) AS text FROM m
    UNION ALL SELECT row_number() OVER (ORDER BY title, idx) + 1, chunk_id, title, text FROM l)
    SELECT n, chunk_id, title, len(text) AS characters, md5(text) AS text_md5 FROM b""",
)
def overview_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = overview.overview_blocks(spark, _by_source(spark, sf_dir))
    return blocks.select(F.col("n").cast("bigint").alias("n"), "chunk_id", "title", F.length("text").cast("bigint").alias("characters"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
