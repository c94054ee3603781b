"""Registered queries of page extraction and headings: pages are written anew from the rows of `pages`, with every element
that extraction looks at, so that SQL can tell what must come out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisift.functions import text as T
from verisift.functions.common import spread
from verisift.operators import evidence
from verisift.plans.catalog import _LINES, query, table
from verisift.sources import html


def _page() -> Column:
    """A page for each row: metadata in several ways, boilerplate, and its text in one of five containers."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    when = lambda cond, *parts: F.when(cond, put(*parts)).otherwise("")
    head = put(
        F.when(k % 4 == 0, "<title> </title>").otherwise(put("<title>Title\n", n, " &amp; more</title>")),
        put('<meta property="og:title" content="OG ', n, '">'),
        when(k % 3 == 0, '<meta name="Description" content=" D  ', n, '">'),
        when(k % 3 == 1, '<meta name="og:description" content="OD ', n, '">'),
        when(k % 4 == 0, '<meta property="og:site_name" content="Site ', (k % 7).cast("string"), '">'),
        when(k % 4 == 1, '<meta name="application-name" content="App">'),
        when(k % 2 == 0, '<link rel="alternate Canonical" href="/c/', n, '?x=1#f">'),
        when(k % 5 == 0, '<script type="application/ld+json">{"@graph":[{"datePublished":"2024-03-05"}]}</script>'),
        when(k % 6 == 0, '<script type="application/ld+json">{broken</script>'),
        when(k % 5 == 1, '<meta property="article:published_time" content="2024-02-03T10:00:00Z">'),
        when(k % 5 == 2, '<meta name="date" content="soon">'),
        when(k % 3 == 0, '<meta property="article:modified_time" content="2024-04-01T00:30:00+01:00">'),
    )
    many = F.when(k % 9 == 0, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(120)), lambda i: F.concat(F.lit('<a href="/m/'), i.cast("string"), F.lit('"></a>'))), "")).otherwise("")
    body = put(
        "<nav><p>menu</p></nav><h2>Head <i>", n, "</i></h2><p>First \n para of ", n, '.<p hidden>no</p><aside><p>ad</p></aside><ul><li>one<li>two</ul><div aria-hidden="true"><p>no</p></div><p>Second <b>bold</b> ', n,
        '<a href="/l/', n, '">l</a> <a href="/l/', n, '#y">m</a><a href="mailto:x">n</a> <a href="https://o.example/', n, '">o</a>', many, "</p>",
    )
    boxed = F.when(k % 5 == 0, put("<main>", body, "</main>")).when(k % 5 == 1, put("<article>", body, "</article>")).when(k % 5 == 2, put('<section role="main">', body, "</section>")).when(k % 5 == 3, put("<div><p>x</p></div><div>", body, "</div>")).otherwise(body)
    before = put(when((k % 5).isin(2, 3), '<time datetime="2023-01-02">t</time>'), when(k % 5 <= 2, "<p>outside</p>"))
    return put('<!DOCTYPE html><html lang="', F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (k % 3 + 1).cast("int")), '"><head>', head, "</head><body><header><h1>Top</h1></header>", before, boxed, "<footer><p>foot</p></footer></body></html>")


@query("""WITH p AS (SELECT page_id AS k, regexp_extract(url, '^https?://[^/?#]+') AS origin, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages),
t AS (SELECT *, 'Head ' || k || chr(10) || 'First para of ' || k || '.' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || 'Second bold ' || k || 'l mn o' AS body FROM p)
SELECT k AS page_id, CASE WHEN k % 4 = 0 THEN 'OG ' || k ELSE 'Title ' || k || ' & more' END AS title, CASE k % 3 WHEN 0 THEN 'D ' || k WHEN 1 THEN 'OD ' || k END AS description,
 CASE WHEN k % 2 = 0 THEN origin || '/c/' || k || '?x=1' END AS canonical_url, ['en', 'de', 'fr'][k % 3 + 1] AS language,
 CASE k % 5 WHEN 0 THEN '2024-03-05 00:00:00' WHEN 1 THEN '2024-02-03 10:00:00' WHEN 2 THEN '2023-01-02 00:00:00' WHEN 3 THEN '2023-01-02 00:00:00' END AS published, CASE WHEN k % 3 = 0 THEN '2024-03-31 23:30:00' END AS modified,
 CASE k % 4 WHEN 0 THEN 'Site ' || k % 7 WHEN 1 THEN 'App' ELSE host END AS publisher, CAST(1 + (k % 3 = 1)::INTEGER + (k % 4 = 0)::INTEGER AS INTEGER) AS n_open_graph, CAST((k % 5 = 0)::INTEGER AS INTEGER) AS n_json_ld,
 'h2:Head ' || k AS headings, sha256(body) AS content_hash, CAST(13 AS INTEGER) AS word_count, CAST(CASE WHEN k % 9 = 0 THEN 100 ELSE 2 END AS INTEGER) AS n_links,
 origin || '/l/' || k || ' https://o.example/' || k AS first_links, CASE WHEN k % 9 = 0 THEN origin || '/m/98' ELSE 'https://o.example/' || k END AS last_link FROM t""")
def page_fields(spark, d):
    """All fields of extraction, container by container."""
    pages = spread(table(spark, d, "pages")).select("page_id", "url", _page().alias("html"))
    got = html.extract_documents(pages, ["page_id"])
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    heads = F.array_join(F.transform("headings", lambda h: F.concat(F.lit("h"), h["level"].cast("string"), F.lit(":"), h["text"])), "|")
    return got.select(
        "page_id", "title", "description", "canonical_url", "language", at("published_at").alias("published"), at("modified_at").alias("modified"), "publisher", F.size("open_graph").alias("n_open_graph"), F.size("json_ld").alias("n_json_ld"),
        heads.alias("headings"), "content_hash", "word_count", F.size("links").alias("n_links"), F.array_join(F.slice("links", 1, 2), " ").alias("first_links"), F.element_at("links", -1).alias("last_link"),
    )


@query(f"""WITH {_LINES.replace("segs AS (", "unheaded AS (")},
tops AS (SELECT doc_id, max(line) FILTER (paragraph = 1) AS first, max(line) FILTER (paragraph = 3) AS third FROM lines GROUP BY doc_id),
marked AS (SELECT l.doc_id, l.line, l.paragraph AS at_line, CASE WHEN line = first THEN 'h2:' || line WHEN line = third THEN 'h3:' || line END AS label FROM lines l JOIN tops USING (doc_id)),
placed AS (SELECT *, CAST(at_line - count(label) OVER w AS INTEGER) AS paragraph, last_value(label IGNORE NULLS) OVER w AS above FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY at_line)),
cut AS (SELECT doc_id, at_line, paragraph, above, label, CASE WHEN label IS NOT NULL THEN [line] ELSE list_filter(list_transform(string_split(regexp_replace(line, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') END AS s FROM placed),
flat AS (SELECT doc_id, at_line, paragraph, above, label, unnest(s) AS text, generate_subscripts(s, 1) AS nth FROM cut)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY at_line, nth) - 1 AS INTEGER) AS segment, paragraph, label IS NOT NULL AS is_heading,
 CASE WHEN label IS NOT NULL THEN label ELSE concat_ws(' > ', above, 'p[' || paragraph || ']') END AS context, text FROM flat""")
def segments_with_headings(spark, d):
    """Segments of documents whose first and third lines, wherever they occur, are headings."""
    docs = spread(table(spark, d, "documents")).select("doc_id", "text", T.normalize_lines(F.col("text")).alias("l"))
    head = lambda level, i: F.when(F.get("l", F.lit(i)).isNotNull(), F.struct(F.lit(level).alias("level"), F.get("l", F.lit(i)).alias("text")))
    docs = docs.withColumn("heads", F.array_compact(F.array(head(2, 0), head(3, 2))))
    s = docs.select("doc_id", F.posexplode_outer(evidence.build_segments(F.col("text"), F.col("heads"))).alias("segment", "s"))
    return s.filter("s IS NOT NULL").select("doc_id", "segment", "s.paragraph", "s.is_heading", "s.context", "s.text")
