"""Queries over raw pages and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..operators import elements, matching
from .registry import Tables, joined, query

_NAMED = [(k, v) for k, v in html.ENTITIES.items() if k != "amp"] + [("amp", "&")]


def _sql_decoded(x: str) -> str:
    for name, value in _NAMED:
        x = f"regexp_replace({x}, '(?i)&{name};', '{value.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


def _sql_stripped(x: str) -> str:
    return f"trim(regexp_replace({_sql_decoded(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))"


_PARAGRAPHS = f"""(SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda p: {_sql_stripped("p")}), lambda p: p <> '') AS ps FROM pages)"""


@query(
    f"""SELECT p.page_id, nullif({_sql_stripped("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")}, '') AS title, len(ps) AS n_paragraphs, md5(array_to_string(ps, '|')) AS paragraphs_md5
    FROM pages p JOIN {_PARAGRAPHS} q USING (page_id)"""
)
def html_title_paragraphs(t: Tables) -> DataFrame:
    """Title and paragraphs of every page."""
    rows = t.pages.select("page_id", html.heading(F.col("html")).alias("title"), html.paragraphs(F.col("html")).alias("ps"))
    return rows.select("page_id", "title", F.size("ps").cast("long").alias("n_paragraphs"), F.md5(joined(F.col("ps")).cast("binary")).alias("paragraphs_md5"))


@query(f"""SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '(?i)href="([^"]*)"', 1), lambda h: trim({_sql_decoded("h")})), lambda h: h <> '')) AS href FROM pages""")
def html_links(t: Tables) -> DataFrame:
    """Every link of every page."""
    return t.pages.select("page_id", F.explode(html.hrefs(F.col("html"))).alias("href"))


@query(f"""SELECT page_id, md5({_sql_stripped("html")}) AS text_md5 FROM pages""")
def html_text(t: Tables) -> DataFrame:
    """The text of every page without markup."""
    return t.pages.select("page_id", F.md5(html.stripped(F.col("html")).cast("binary")).alias("text_md5"))


@query("""SELECT lower(e) AS entity, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '&([a-zA-Z]+|#[0-9]+);', 1)) AS e FROM pages) GROUP BY 1""")
def html_entities(t: Tables) -> DataFrame:
    """Entities, how often and on how many pages they occur."""
    found = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("&([a-zA-Z]+|#[0-9]+);"), 1)).alias("e"))
    return found.groupBy(F.lower("e").alias("entity")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("""SELECT suffix(regexp_replace(html, '\\s+$', ''), '</html>') AS complete, count(*) AS n FROM pages GROUP BY 1""")
def html_completeness(t: Tables) -> DataFrame:
    """Pages that were fetched to their end."""
    return t.pages.groupBy(html.complete(F.col("html")).alias("complete")).agg(F.count("*").alias("n"))


@query(
    """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages)
    SELECT page_id, host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment, starts_with(lower(url), 'https://') AS secure FROM u"""
)
def url_parts_identity(t: Tables) -> DataFrame:
    """Host, query values and fragment of every page's url."""
    url = F.col("url")
    part = lambda key: F.try_parse_url(url, F.lit("QUERY"), F.lit(key))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return t.pages.select("page_id", host.alias("host"), part("page").alias("page"), part("utm_source").alias("utm"), F.try_parse_url(url, F.lit("REF")).alias("fragment"), F.lower(url).startswith("https://").alias("secure"))


@query("""SELECT page_id, substr(sha1(url), 1, 16) AS cache_key, length(html) AS n_chars FROM pages""")
def page_cache_keys(t: Tables) -> DataFrame:
    """Content addresses of fetched pages."""
    return t.pages.select("page_id", F.substring(F.sha1(F.col("url").cast("binary")), 1, 16).alias("cache_key"), F.length("html").cast("long").alias("n_chars"))


_TOKENS = """WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is).*?(?:<{tag}\\b|</{tag}\\s*>)') AS ps, html FROM {pages}), x AS (SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM p),
    t AS (SELECT page_id, pos, length(piece) AS size, CASE WHEN regexp_matches(piece, '(?is)</{tag}\\s*>$') THEN -1 ELSE 1 END AS turn FROM x),
    d AS (SELECT *, sum(size) OVER w AS stop, sum(turn) OVER w AS depth FROM t WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
    o AS (SELECT page_id, stop - length('<{tag}') AS start, coalesce((SELECT min(c.stop) FROM d c WHERE c.page_id = d.page_id AND c.pos > d.pos AND c.depth < d.depth), (SELECT length(html) FROM p WHERE p.page_id = d.page_id)) AS stop FROM d WHERE turn = 1)"""


@query(
    _TOKENS.format(tag="li", pages="pages")
    + """ SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY start) AS n, start::BIGINT AS start, md5(substr(html, start::BIGINT + 1, (stop - start)::BIGINT)) AS element FROM o JOIN p USING (page_id)"""
)
def html_balanced_items(t: Tables) -> DataFrame:
    """Every list item with what is nested in it."""
    found = elements.balanced(t.pages, "li", key="page_id")
    return found.select("page_id", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), F.md5(F.col("element").cast("binary")).alias("element"))


_NESTED = "(SELECT page_id, replace(replace(replace(html, '<li>', CASE page_id % 3 WHEN 0 THEN '<DIV class=\"a\">' WHEN 1 THEN '<div><div >' ELSE '<div' || ' x=1>' END), '</li>', CASE page_id % 5 WHEN 0 THEN '' ELSE '</div >' END), '</ul>', '</div></div>') AS html FROM pages)"


@query(
    _TOKENS.format(tag="div", pages=_NESTED)
    + """ SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY start) AS n, start::BIGINT AS start, md5(substr(html, start::BIGINT + 1, (stop - start)::BIGINT)) AS element FROM o JOIN p USING (page_id)"""
)
def html_broken_nesting(t: Tables) -> DataFrame:
    """The same over pages whose lists have become boxes that nest, that are never closed, or that are closed too often."""
    k, text = F.col("page_id"), F.col("html")
    opening = F.when(k % 3 == 0, '<DIV class="a">').when(k % 3 == 1, "<div><div >").otherwise("<div x=1>")
    boxed = F.replace(F.replace(F.replace(text, F.lit("<li>"), opening), F.lit("</li>"), F.when(k % 5 == 0, "").otherwise("</div >")), F.lit("</ul>"), F.lit("</div></div>"))
    found = elements.balanced(t.pages.select(k, boxed.alias("html")), "div", key="page_id")
    return found.select("page_id", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), F.md5(F.col("element").cast("binary")).alias("element"))


@query("""SELECT page_id, (length(html) - length(replace(html, '<nav', ''))) // 4 AS n, coalesce(length(nullif(regexp_extract(html, '(?s)<nav.*?</nav>'), '')), 0) AS first_chars FROM pages""")
def html_balanced_lists(t: Tables) -> DataFrame:
    """Whole nav elements, how many and how long the first is, through the Arrow function."""
    found = t.pages.select("page_id", html.balanced_elements("nav", "")(F.col("html")).alias("e"))
    return found.select("page_id", F.size("e").cast("long").alias("n"), F.coalesce(F.length(F.get("e", F.lit(0))), F.lit(0)).cast("long").alias("first_chars"))


_NUMERIC = "replace(replace(replace(replace(html, 'é', '&#233;'), 'the ', '&#x74;h&#X65; '), 'de ', '&#128512;&#x1F600;&#55296;&#x110000;&#99999999999; '), '&amp;', '&#38;lt;&amp;#65;')"
_SQL_HEX = "array_to_string(list_transform(regexp_extract_all({x}, '&#[xX][0-9a-fA-F]+;|[^&]+|&'), lambda t: CASE WHEN NOT regexp_full_match(t, '&#[xX][0-9a-fA-F]+;') THEN t ELSE coalesce(nullif(CASE WHEN ('0x' || t[4:-2])::BIGINT BETWEEN 55296 AND 57343 OR ('0x' || t[4:-2])::BIGINT > 1114111 THEN NULL ELSE chr(('0x' || t[4:-2])::INT) END, ''), '') END), '')"
_SQL_DECIMAL = "array_to_string(list_transform(regexp_extract_all({x}, '&#[0-9]+;|[^&]+|&'), lambda t: CASE WHEN NOT regexp_full_match(t, '&#[0-9]+;') THEN t WHEN t[3:-2]::BIGINT BETWEEN 55296 AND 57343 OR t[3:-2]::BIGINT > 1114111 THEN '' ELSE chr(t[3:-2]::INT) END), '')"


@query(f"""SELECT page_id, md5(trim(regexp_replace({_sql_decoded(_SQL_DECIMAL.format(x=_SQL_HEX.format(x="regexp_replace(h, '<[^>]*>', ' ', 'g')")))}, '\\s+', ' ', 'g'))) AS text_md5 FROM (SELECT page_id, {_NUMERIC} AS h FROM pages)""")
def html_numeric_entities(t: Tables) -> DataFrame:
    """The text of pages in which characters are written as numbers, some of them impossible, some to be decoded again by a later pass."""
    h = F.col("html")
    for old, new in (("é", "&#233;"), ("the ", "&#x74;h&#X65; "), ("de ", "&#128512;&#x1F600;&#55296;&#x110000;&#99999999999; "), ("&amp;", "&#38;lt;&amp;#65;")):
        h = F.replace(h, F.lit(old), F.lit(new))
    return t.pages.select("page_id", F.md5(html.stripped(h).cast("binary")).alias("text_md5"))


@query(
    """WITH d AS (SELECT doc_id, text FROM documents), e AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)([A-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Z0-9.-]+\\.[A-Z]{2,})', 1)) AS email FROM d)
    SELECT lower(regexp_extract(email, '@(.*)$', 1)) AS host, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e GROUP BY 1"""
)
def contact_emails(t: Tables) -> DataFrame:
    """Hosts of the e-mail addresses in texts."""
    found = t.documents.select("doc_id", F.explode(html.emails(F.col("text"))).alias("email"))
    return found.groupBy(F.lower(F.regexp_extract("email", "@(.*)$", 1)).alias("host")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://ieltsregistration.britishcouncil.org/x?location=' || page_id WHEN 1 THEN 'https://www.ieltsusa.org/book' WHEN 2 THEN 'https://example.com/' END AS url, CASE page_id % 6 WHEN 2 THEN 'idp-' || page_id ELSE 'venue-' || page_id END AS slug FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'British Council' WHEN 1 THEN 'IELTS USA' ELSE CASE WHEN slug LIKE 'idp-%' THEN 'IDP' ELSE 'unknown' END END AS operator,
        CASE WHEN page_id % 4 < 2 THEN 'booking_domain' WHEN slug LIKE 'idp-%' THEN 'slug' ELSE 'unknown' END AS source, CASE WHEN page_id % 4 = 0 THEN page_id::VARCHAR END AS external_id FROM u"""
)
def operator_detection(t: Tables) -> DataFrame:
    """Operators from booking links, slugs and names, and the id in one operator's links."""
    key, n = F.col("page_id"), F.col("page_id").cast("string")
    url = F.when(key % 4 == 0, F.concat(F.lit("https://ieltsregistration.britishcouncil.org/x?location="), n)).when(key % 4 == 1, "https://www.ieltsusa.org/book").when(key % 4 == 2, "https://example.com/")
    slug = F.when(key % 6 == 2, F.concat(F.lit("idp-"), n)).otherwise(F.concat(F.lit("venue-"), n))
    rows = t.pages.select("page_id", url.alias("url"), html.detected_operator(url, slug, F.lit("Some venue")).alias("d"))
    return rows.select("page_id", F.col("d.operator").alias("operator"), F.col("d.source").alias("source"), html.external_id(F.col("url")).alias("external_id"))


@query(
    """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, CASE WHEN CAST(props->>'k' AS BIGINT) % 2 = 0 THEN 'CDLA|ODbL' ELSE 'ODbL' END AS licences FROM events"""
)
def json_lineage(t: Tables) -> DataFrame:
    """A number out of JSON, and the distinct licences of a JSON list of sources, wrapped or not."""
    k = F.get_json_object("props", "$.k").cast("long")
    sources = F.when(k % 2 == 0, '[{"element":{"license":"ODbL"}},{"license":"CDLA"},{"license":"ODbL"}]').otherwise('[{"license":"ODbL"},{"dataset":"x"}]')
    return t.events.select("event_id", k.alias("k"), joined(matching.lineage(sources)).alias("licences"))
