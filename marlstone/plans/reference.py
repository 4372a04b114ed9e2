"""Queries of the listing pipeline's own operators, each over whole tables, with the SQL that states the same."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import dedupe, details, discovery, extraction, judging, page_flags, relational, search, tagging
from ..session import cut_lineage, ensure_checkpoint_dir, read_spread, read_table
from ..sources import csv_tables, sinks, storage
from ..sources.json_array import JsonArraySource
from ..sources.json_records import records_column

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Fragments of SQL that several queries share.
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^.*@', ''), ':\d*$', '')"
_PATH = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"
_TRIM = "trim({u}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
_SEGS = "list_filter(string_split({p}, '/'), lambda s: s <> '')"
_PAIRS = "list_filter(string_split({q}, '&'), lambda x: contains(x, '=') AND NOT starts_with(x, '=') AND NOT ends_with(regexp_extract(x, '^[^=]*=', 0) || chr(1) || substr(x, strpos(x, '=') + 1), chr(1)))"
_TERMS = r"""
terms AS (SELECT DISTINCT category, term,
  '(?i)(^|[^\p{L}\p{N}_])' || array_to_string(list_filter(regexp_split_to_array(term, '[\s\-]+'), lambda p: p <> ''), '[^\p{L}\p{N}_]*') || '([^\p{L}\p{N}_]|$)' AS pattern,
  lower(list_filter(regexp_split_to_array(term, '[\s\-]+'), lambda p: p <> '')[1]) AS head FROM term_dictionary)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "products_html")


# ---- dedupe and merge -------------------------------------------------------------------------------------------


@_query("""
SELECT row_id FROM (SELECT row_id, product_url, row_number() OVER (PARTITION BY product_url ORDER BY CASE WHEN isnan(r) THEN -1 ELSE r END DESC, session_file DESC, pos DESC) AS n
  FROM (SELECT *, coalesce(try_cast(fetched_at AS DOUBLE), -1) AS r FROM products_html))
WHERE n = 1 OR coalesce(product_url, '') = ''""")
def session_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, sf_dir).select("row_id", "product_url", "fetched_at", "session_file", "pos")
    return dedupe.latest_per_key(t, "product_url", "fetched_at", ["session_file", "pos"]).select("row_id")


@_query("""
SELECT listing_id FROM (SELECT listing_id, original_url, row_number() OVER (PARTITION BY original_url ORDER BY listing_id) AS n FROM parsed_merged)
WHERE n = 1 OR coalesce(original_url, '') = ''""")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_per_key(read_table(spark, sf_dir, "parsed_merged").select("listing_id", "original_url"), "original_url", ["listing_id"]).select("listing_id")


# ---- tagging ----------------------------------------------------------------------------------------------------


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tag(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), tagging.load_terms(read_table(spark, sf_dir, "term_dictionary")), "text")


@_query(f"""WITH {_TERMS}
SELECT doc_id, string_agg(DISTINCT term, '; ' ORDER BY term) AS matched_terms, string_agg(DISTINCT category, '; ' ORDER BY category) AS matched_categories
FROM (SELECT doc_id, text, category, term, pattern FROM documents JOIN terms ON contains(lower(text), head)) WHERE regexp_matches(text, pattern) GROUP BY doc_id""")
def keyword_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.array_join("matched_terms", "; ").alias("matched_terms"), F.array_join("matched_categories", "; ").alias("matched_categories"))


@_query(f"""WITH {_TERMS},
near AS MATERIALIZED (SELECT doc_id, text, category, pattern FROM documents JOIN terms ON contains(lower(text), head)),
hits AS (SELECT DISTINCT doc_id, category FROM near WHERE regexp_matches(text, pattern))
SELECT category, count(*) AS n_docs FROM hits GROUP BY category""")
def keyword_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select(F.explode("matched_categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"))


@_query(f"""WITH {_TERMS},
hay AS (SELECT listing_id, coalesce(listing_title, '') || ' \n ' || coalesce(description, '') || ' \n ' || coalesce(review, '') AS h FROM parsed_merged),
near AS MATERIALIZED (SELECT listing_id, h, term, category, pattern FROM hay JOIN terms ON contains(lower(h), head)),
hits AS (SELECT listing_id, term, category FROM near WHERE regexp_matches(h, pattern)),
agg AS (SELECT listing_id, string_agg(DISTINCT term, '; ' ORDER BY term) AS matched_terms, string_agg(DISTINCT category, '; ' ORDER BY category) AS matched_categories FROM hits GROUP BY listing_id),
ranked AS (SELECT a.*, original_url, row_number() OVER (PARTITION BY original_url ORDER BY listing_id) AS n FROM agg a JOIN parsed_merged USING (listing_id))
SELECT listing_id, matched_terms, matched_categories FROM ranked WHERE n = 1 OR coalesce(original_url, '') = ''""".replace("\\n", "' || chr(10) || '"))
def filtered_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a term in title, description or review, first of each address."""
    t = read_table(spark, sf_dir, "parsed_merged").select("listing_id", "original_url", "listing_title", "description", "review")
    t = tagging.tag(t, tagging.load_terms(read_table(spark, sf_dir, "term_dictionary")), "listing_title", "description", "review")
    t = dedupe.first_per_key(t.select("listing_id", "original_url", "matched_terms", "matched_categories"), "original_url", ["listing_id"])
    return t.select("listing_id", F.array_join("matched_terms", "; ").alias("matched_terms"), F.array_join("matched_categories", "; ").alias("matched_categories"))


@_query(f"""WITH {_TERMS},
d AS (SELECT source, text, CASE WHEN doc_kind = 'policy' THEN 'walled' WHEN text IS NULL THEN 'dead' ELSE 'ok' END AS status FROM documents WHERE source IS NOT NULL),
near AS MATERIALIZED (SELECT source, text, term, pattern FROM d JOIN terms ON contains(lower(text), head) WHERE status = 'ok'),
n AS (SELECT source, count(DISTINCT term) AS n FROM near WHERE regexp_matches(text, pattern) GROUP BY source),
s AS (SELECT source, min(CASE status WHEN 'ok' THEN 0 WHEN 'walled' THEN 1 ELSE 2 END) AS s FROM d GROUP BY source)
SELECT source, CASE s WHEN 0 THEN 'ok' WHEN 1 THEN 'walled' ELSE 'dead' END AS status, CASE WHEN s = 0 THEN coalesce(n, 0) ELSE -1 END AS score FROM s LEFT JOIN n USING (source)""")
def site_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "documents").filter("source is not null").select("source", "text", F.when(F.col("doc_kind") == "policy", "walled").when(F.col("text").isNull(), "dead").otherwise("ok").alias("status"))
    s = tagging.site_scores(t, "source", "status", tagging.load_terms(read_table(spark, sf_dir, "term_dictionary")), "text")
    return s.withColumn("score", F.coalesce("score", F.lit(-1)).cast("bigint"))


@_query("""SELECT term, category FROM (SELECT trim(term) AS term, category, row_number() OVER (PARTITION BY lower(trim(term)) ORDER BY category, trim(term)) AS n FROM term_dictionary WHERE trim(term) <> '') WHERE n = 1""")
def flat_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.flat_terms(read_table(spark, sf_dir, "term_dictionary"))


# ---- addresses --------------------------------------------------------------------------------------------------


@_query(f"""WITH t AS (SELECT row_id, {_TRIM.format(u="product_url")} AS u FROM products_html WHERE product_url IS NOT NULL)
SELECT row_id, lower(regexp_extract(u, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?', 1)) AS scheme, {_HOST.format(u="u")} AS host, {_PATH.format(u="u")} AS path,
  len({_SEGS.format(p=_PATH.format(u="u"))}) AS n_segments, {_QUERY.format(u="u")} AS query FROM t""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("product_url")
    t = _pages(spark, sf_dir).select("row_id", "product_url").filter(u.isNotNull())
    return t.select("row_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), F.size(U.segments(u)).cast("bigint").alias("n_segments"), U.query(u).alias("query"))


@_query(f"""WITH t AS (SELECT row_id, unnest(string_split({_QUERY.format(u=_TRIM.format(u="product_url"))}, '&')) AS p FROM products_html WHERE product_url IS NOT NULL)
SELECT row_id, url_decode(replace(string_split(p, '=')[1], '+', ' ')) AS k, url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' ')) AS v FROM t WHERE p LIKE '_%=_%'""")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, sf_dir).select("row_id", F.explode(U.param_pairs(F.col("product_url"))).alias("p"))
    return t.select("row_id", "p.k", "p.v")


@_query(f"""WITH t AS (SELECT row_id, product_url, {_TRIM.format(u="product_url")} AS u FROM products_html),
s AS (SELECT row_id, product_url, {_SEGS.format(p=_PATH.format(u="u"))} AS seg, {_PATH.format(u="u")} AS p, '&' || {_QUERY.format(u="u")} || '&' AS q FROM t)
SELECT row_id, CASE WHEN coalesce(product_url, '') = '' THEN false
  WHEN regexp_matches(q, '&add-to-cart=[^&]') THEN false
  WHEN regexp_matches(q, '&product=[^&]') AND NOT regexp_matches(q, '&product_cat=[^&]') THEN true
  WHEN list_position(seg, 'product') > 0 AND list_position(seg, 'product') < len(seg) THEN true
  WHEN list_contains(seg, 'listing') THEN true
  WHEN list_position(seg, 'item') > 0 AND list_position(seg, 'item') < len(seg) THEN true
  WHEN ends_with(p, 'products.php') AND len(regexp_extract_all(replace(q, '&', '&&'), '&action=[^&]+')) = 1 AND contains(q, '&action=view&') THEN true
  WHEN len(seg) > 1 AND seg[1] = 'shop' THEN true ELSE false END AS is_product FROM s""")
def product_url_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("row_id", U.is_product_url(F.col("product_url")).alias("is_product"))


@_query(f"""SELECT DISTINCT '/' || trim({_PATH.format(u="category_page")}, '/') AS path FROM products_html WHERE category_page IS NOT NULL""")
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).filter("category_page is not null").select(U.canonical_path(F.col("category_page")).alias("path")).distinct()


_TEMPLATE = r"CASE WHEN regexp_matches(u, '[?&]page=\d') THEN regexp_replace(u, '^(.*?[?&]page=)\d+(.*)$', '\1{{n}}\2') WHEN regexp_matches(u, '[?&]paged=\d') THEN regexp_replace(u, '^(.*?[?&]paged=)\d+(.*)$', '\1{{n}}\2') WHEN regexp_matches(u, '[?&]p=\d') THEN regexp_replace(u, '^(.*?[?&]p=)\d+(.*)$', '\1{{n}}\2') WHEN regexp_matches(u, '/page/\d') THEN regexp_replace(u, '^(.*?/page/)\d+(.*)$', '\1{{n}}\2') END".replace("{{n}}", "{n}")
_PAGE_NO = r"CAST(regexp_extract(u, CASE WHEN regexp_matches(u, '[?&]page=\d') THEN '[?&]page=(\d+)' WHEN regexp_matches(u, '[?&]paged=\d') THEN '[?&]paged=(\d+)' WHEN regexp_matches(u, '[?&]p=\d') THEN '[?&]p=(\d+)' ELSE '/page/(\d+)' END, 1) AS BIGINT)"


@_query(f"""WITH t AS (SELECT DISTINCT category_page AS u FROM products_html WHERE category_page IS NOT NULL)
SELECT u AS category_page, {_TEMPLATE} AS template, {_PAGE_NO} AS n FROM t WHERE {_TEMPLATE} IS NOT NULL""")
def pager_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, sf_dir).select("category_page").distinct().withColumn("p", U.page_template(F.col("category_page"))).filter("p is not null")
    return t.select("category_page", "p.template", "p.n")


@_query(r"""
WITH u AS (SELECT DISTINCT market AS g, category_page AS u FROM products_html WHERE category_page IS NOT NULL AND market IS NOT NULL),
v AS (SELECT g, u, regexp_extract(u, '^(.*?)(\d+)(\D*)$', 1) || '{n}' || regexp_extract(u, '^(.*?)(\d+)(\D*)$', 3) AS t, try_cast(nullif(regexp_extract(u, '^(.*?)(\d+)(\D*)$', 2), '') AS BIGINT) AS n FROM u),
c AS (SELECT g, t, count(DISTINCT n) AS c, min(n) AS lo, max(n) AS hi FROM v WHERE n IS NOT NULL GROUP BY g, t),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, t) AS r FROM c) WHERE r = 1 AND c >= 2)
SELECT g AS market, replace(t, '{n}', CAST(x AS VARCHAR)) AS url FROM (SELECT g, t, unnest(range(lo, least(hi, lo + 199) + 1)) AS x FROM b)
UNION ALL SELECT g, u FROM u WHERE g NOT IN (SELECT g FROM b)""")
def pager_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, sf_dir).filter("market is not null").select("market", F.col("category_page").alias("url"))
    return relational.expand_pages(t, "url", "market", cap=200)


@_query(f"""WITH t AS (SELECT {_TEMPLATE.replace('(u,', '(category_page,')} AS tpl, {_PAGE_NO.replace('(u,', '(category_page,')} AS page, product_url FROM products_html WHERE category_page IS NOT NULL AND product_url IS NOT NULL),
p AS (SELECT tpl, page, list_sort(list(DISTINCT product_url)) AS links FROM t WHERE tpl IS NOT NULL GROUP BY tpl, page),
s AS (SELECT *, CASE WHEN links IS NOT DISTINCT FROM lag(links) OVER w OR page > 1000 THEN 1 ELSE 0 END AS stop FROM p WINDOW w AS (PARTITION BY tpl ORDER BY page)),
r AS (SELECT tpl, page, len(links) AS n_links, sum(stop) OVER (PARTITION BY tpl ORDER BY page) AS stops FROM s)
SELECT tpl AS walk, page, CAST(n_links AS BIGINT) AS n_links FROM r WHERE stops = 0""")
def repeat_page_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, sf_dir).select(U.page_template(F.col("category_page")).alias("p"), "product_url").filter("p is not null and product_url is not null")
    pages = t.groupBy(F.col("p.template").alias("walk"), F.col("p.n").alias("page")).agg(F.collect_set("product_url").alias("links"))
    return dedupe.walk_until_repeat(pages, "walk", "page", "links").select("walk", "page", F.size("links").cast("bigint").alias("n_links"))


@_query("""SELECT doc_id, 'http://shop.example.org/?s=' || replace(replace(replace(url_encode(source), '+', '%20'), '%2F', '/'), '%7E', '~') || '&page=2' AS url FROM documents WHERE source IS NOT NULL""")
def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "documents").filter("source is not null")
    return t.select("doc_id", U.fill_page(F.concat(F.lit("http://shop.example.org/?s="), U.encode_term(F.col("source")), F.lit("&page={n}")), F.lit(2)).alias("url"))


# ---- pages ------------------------------------------------------------------------------------------------------


@_query("""SELECT row_id, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM products_html""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("row_id", page_flags.title(F.col("html")).alias("title"))


@_query(r"""SELECT row_id, len(h) AS n_links, len(list_distinct(h)) AS n_distinct, len(list_filter(h, lambda x: contains(x, '/item/'))) AS n_items
FROM (SELECT row_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS h FROM products_html WHERE html IS NOT NULL)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, sf_dir).filter("html is not null").select("row_id", F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)).alias("h"))
    n = lambda c: F.size(c).cast("bigint")
    return t.select("row_id", n("h").alias("n_links"), n(F.array_distinct("h")).alias("n_distinct"), n(F.filter("h", lambda x: F.contains(x, F.lit("/item/")))).alias("n_items"))


_H = "lower(coalesce(html, ''))"
_TEXT = r"""trim(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>|<!--.*?-->', '<x>', 'g'), '\s*(?:<[^>]*>\s*)+', ' ', 'g'))"""


@_query(rf"""WITH p AS (SELECT row_id, coalesce(html, '') AS h, {_H} AS low, lower({_TEXT}) AS txt, len(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?\bhref\s*=')) AS n_links FROM products_html),
w AS (SELECT *, length(h) < 4000 AND (low LIKE '%captcha%' OR low LIKE '%cloudflare%' OR low LIKE '%ddos%' OR low LIKE '%are you human%' OR low LIKE '%not a bot%' OR low LIKE '%i''m not a robot%') AS walled,
  low LIKE '%captcha%' OR low LIKE '%verify you are human%' OR low LIKE '%cloudflare%' OR low LIKE '%ddos-guard%' OR low LIKE '%are you human%' AS captcha FROM p)
SELECT row_id, walled, captcha, length(h) < 400 AND regexp_matches(h, '(?i)http-equiv=["'']?refresh["'']?[^>]*url=/?["'']?\s*/?\s*["'']?') AS bounce,
  low LIKE '%ddos protection%' OR low LIKE '%new tor identity%' OR low LIKE '%kill switch%' AS identity_block,
  walled OR (h <> '' AND n_links <= 2 AND (txt LIKE '%access queue%' OR txt LIKE '%you have been placed in a queue%' OR txt LIKE '%estimated wait%' OR txt LIKE '%please wait%' OR txt LIKE '%just a moment%' OR txt LIKE '%one moment%'
    OR txt LIKE '%redirected%' OR txt LIKE '%ddos%' OR txt LIKE '%captcha%' OR txt LIKE '%cloudflare%' OR txt LIKE '%enable javascript%')) AS gated,
  length(h) < 500 OR (low LIKE '%<title%' AND (string_split(low, '</title>')[1] LIKE '%captcha%' OR string_split(low, '</title>')[1] LIKE '%ddos%' OR string_split(low, '</title>')[1] LIKE '%just a moment%' OR string_split(low, '</title>')[1] LIKE '%checking your browser%')) AS forum_block,
  length(h) >= 1000 AND NOT captcha AS usable, length(h) >= 1000 AND NOT captcha AND low LIKE '%class=%' AS usable_with_marker FROM w""")
def page_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, status = F.col("html"), F.lit(200)
    f = page_flags
    return _pages(spark, sf_dir).select(
        "row_id", f.walled(status, h).alias("walled"), f.bounce(h).alias("bounce"), f.captcha(h).alias("captcha"), f.identity_block(h).alias("identity_block"), f.gated(status, h).alias("gated"), f.forum_block(h).alias("forum_block"),
        f.usable_results(h).alias("usable"), f.usable_results(h, F.lit("CLASS=")).alias("usable_with_marker"),
    )


@_query()
def parse_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.parse_listings(read_spread(spark, sf_dir, "products_html", "row_id", "product_url", "category_page", "html"))


@_query()
def parse_listing_second_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.parse_listings(read_spread(spark, sf_dir, "products_html", "row_id", "product_url", "category_page", "html"), profile=extraction.SECOND, only_products=False)


@_query()
def nested_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.details(read_spread(spark, sf_dir, "products_html", "row_id", "html"))


@_query()
def page_product_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_spread(spark, sf_dir, "products_html", "row_id", "product_url", "html").filter("html is not null")
    return t.select("row_id", extraction.product_links_column(F.col("html"), F.col("product_url")).alias("links"), extraction.pager_links_column(F.col("html"), F.col("product_url")).alias("pager"))


@_query()
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_spread(spark, sf_dir, "products_html", "row_id", "product_url", "html").filter("html is not null")
    return t.select("row_id", F.explode(extraction.links_column(F.col("html"), F.col("product_url"))).alias("l")).select("row_id", "l.href", "l.text")


@_query(r"""SELECT DISTINCT category_page FROM products_html WHERE regexp_matches(lower(category_page),
  'pharmacy|pharma|prescription|rx|health|pill|medicine|medication|drug|hormone|fertility|women|contracept|abortion|birth control|sexual|steroid')""")
def relevant_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).filter(page_flags.relevant(F.col("category_page"), F.lit(""))).filter("category_page is not null").select("category_page").distinct()


@_query(f"""SELECT row_id FROM products_html WHERE category_page IS NOT NULL AND product_url IS NOT NULL AND {_HOST.format(u=_TRIM.format(u="category_page"))} = {_HOST.format(u=_TRIM.format(u="product_url"))}""")
def same_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).filter(U.host(F.col("category_page")) == U.host(F.col("product_url"))).select("row_id")


# ---- text -------------------------------------------------------------------------------------------------------

_WS = "'[\\s\\x{00A0}\\x{200B}\\x{FEFF}]+'"
_COLLAPSED = f"trim(regexp_replace(coalesce(text, ''), {_WS}, ' ', 'g'))"


@_query("SELECT doc_id, trim(" + "replace(" * len(T.ENTITIES) + _COLLAPSED + "".join(f", '{e}', '" + c.replace("'", "''") + "')" for e, c in T.ENTITIES) + ") AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@_query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 500).alias("short"))


@_query(r"""WITH a AS (SELECT listing_id, list_distinct(regexp_extract_all(price, '\$\d[\d,]*(?:\.\d+)?')) AS f FROM parsed_merged WHERE price IS NOT NULL),
k AS (SELECT listing_id, CASE WHEN len(f) > 1 THEN list_filter(f, lambda x: x <> '$0') ELSE f END AS f FROM a)
SELECT listing_id, CASE WHEN len(f) = 1 THEN f[1] WHEN len(f) > 1 THEN list_min(f) || ' - ' || list_max(f) END AS price_range FROM k""")
def price_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "parsed_merged").filter("price is not null").select("listing_id", T.price_range(F.col("price")).alias("price_range"))


@_query("""SELECT listing_id, sha1('judge-1' || chr(10) || coalesce(listing_title, '') || chr(10) || coalesce(market_name, '') || chr(10) || substr(coalesce(description, ''), 1, 800)) AS cache_key FROM parsed_merged""")
def judge_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "parsed_merged")
    return t.select("listing_id", T.cache_key(F.lit("judge-1"), F.col("listing_title"), F.col("market_name"), F.col("description")).alias("cache_key"))


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(o_orderpriority, '') AS o_orderpriority, CAST(o_totalprice > 100000 AS VARCHAR) = 'true' AS big, CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END AS flag, '' AS missing FROM orders")
def sheet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "orders").withColumn("flag", F.col("o_totalprice") > 100000)
    s = relational.sheet(t, ["o_orderkey", "o_orderpriority", "flag", "missing"])
    return s.withColumn("big", F.col("flag") == "True")


@_query(r"""WITH t AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(?i)\b(of|all|found|fetched)\s+[\d,]+|[\d,]+\s+(results?|listings?)\b|single result'))
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bsingle result\b') THEN 1 ELSE coalesce(
  try_cast(replace(nullif(regexp_extract(text, '(?i)\bof\s+([\d,]+)', 1), ''), ',', '') AS BIGINT), try_cast(replace(nullif(regexp_extract(text, '(?i)\ball\s+([\d,]+)', 1), ''), ',', '') AS BIGINT),
  try_cast(replace(nullif(regexp_extract(text, '(?i)\b(?:found|fetched)\s+([\d,]+)', 1), ''), ',', '') AS BIGINT), try_cast(replace(nullif(regexp_extract(text, '(?i)([\d,]+)\s+(?:results?|listings?)\b', 1), ''), ',', '') AS BIGINT)) END AS n FROM t""")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"(?i)\b(of|all|found|fetched)\s+[\d,]+|[\d,]+\s+(results?|listings?)\b|single result"))
    return t.select("doc_id", T.result_count(F.col("text")).alias("n"))


@_query("""SELECT rec_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END IS NOT NULL AS readable,
  coalesce(json_extract_string(payload, '$.market'), json_extract_string(payload, '$.market_name')) AS market FROM (SELECT rec_id, payload FROM raw_records)""")
def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as a judge wraps them: each payload in a code fence."""
    t = read_table(spark, sf_dir, "raw_records").select("rec_id", T.json_lenient(F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))).alias("j"))
    return t.select("rec_id", F.col("j").isNotNull().alias("readable"), F.coalesce(F.get_json_object("j", "$.market"), F.get_json_object("j", "$.market_name")).alias("market"))


@_query("""SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN NULL WHEN event_type = 'click' THEN 'true' ELSE 'false' END AS relevant, CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'click' THEN 'abortion' ELSE 'none' END AS category,
  CASE WHEN event_type <> 'error' THEN round(value, 3) END AS confidence FROM events""")
def verdict_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of events: errors reply with a list, views without a usable flag, clicks with a category in capitals."""
    e = F.col("event_type")
    reply = F.when(e == "error", F.lit("[1]")).otherwise(F.to_json(F.struct(F.when(e == "view", F.lit("maybe")).otherwise((e == "click").cast("string")).alias("relevant"), F.when(e == "click", F.lit(" Abortion")).otherwise("other").alias("category"), F.col("value").alias("confidence"))))
    reply = F.regexp_replace(reply, '"(true|false)"', "$1")
    t = read_table(spark, sf_dir, "events").select("event_id", T.verdict(reply).alias("v"))
    return t.select("event_id", F.col("v.relevant").cast("string").alias("relevant"), "v.category", "v.confidence")


# ---- joins, sets and reports ------------------------------------------------------------------------------------


@_query("""WITH u AS (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM customer UNION ALL BY NAME SELECT CAST(COLUMNS(*) AS VARCHAR) FROM supplier)
SELECT coalesce(COLUMNS(*), '') FROM u""")
def union_by_name_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.union_by_name(read_table(spark, sf_dir, "customer").drop("c_acctbal"), read_table(spark, sf_dir, "supplier").drop("s_acctbal"))


ORACLE_SQL["union_by_name_fill"] = """WITH u AS (SELECT CAST(COLUMNS(* EXCLUDE (c_acctbal)) AS VARCHAR) FROM customer UNION ALL BY NAME SELECT CAST(COLUMNS(* EXCLUDE (s_acctbal)) AS VARCHAR) FROM supplier)
SELECT coalesce(COLUMNS(*), '') FROM u"""


@_query("""SELECT m.market, t.term FROM (SELECT DISTINCT market FROM products_html WHERE market IS NOT NULL) m, (SELECT DISTINCT term FROM term_dictionary) t
WHERE NOT EXISTS (SELECT 1 FROM products_html p WHERE p.market = m.market AND contains(lower(p.category_page), lower(t.term)))""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and terms without a landed category page that names the term."""
    pages, terms = _pages(spark, sf_dir).select("market", "category_page").filter("market is not null").distinct(), read_table(spark, sf_dir, "term_dictionary")
    words = sorted({w for _, w, _ in tagging.load_terms(terms)})
    named = F.filter(F.array(*[F.when(F.contains(F.lower("category_page"), F.lit(w.lower())), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    done = pages.select("market", F.explode(named).alias("term"))
    return relational.pending(relational.grid(pages.select("market").distinct(), terms, "term"), done, ["market", "term"], folded=["term"])


@_query("""SELECT d.doc_id, l.label, l.label IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT doc_id, min((annotator, label)) AS m, min_by(label, (annotator, label)) AS label FROM doc_labels GROUP BY doc_id) l USING (doc_id)""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return relational.with_cache(d, read_table(spark, sf_dir, "doc_labels").select("doc_id", "annotator", "label"), "doc_id").select("doc_id", "label", F.col("label").isNotNull().alias("hit"))


@_query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels)")
def cache_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.without_cache(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_labels"), "doc_id")


@_query("""SELECT count(DISTINCT u) AS n_distinct FROM (SELECT product_url AS u FROM products_html UNION ALL SELECT original_url FROM parsed_merged UNION ALL SELECT product_url FROM documents) WHERE coalesce(u, '') <> ''""")
def denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = [_pages(spark, sf_dir).select(F.col("product_url").alias("u")), read_table(spark, sf_dir, "parsed_merged").select(F.col("original_url").alias("u")), read_table(spark, sf_dir, "documents").select(F.col("product_url").alias("u"))]
    return relational.distinct_over(s, "u")


@_query("""SELECT annotator, count(*) FILTER (label = 'none') AS n_none, count(*) FILTER (label = 'abuse') AS n_abuse, count(*) FILTER (label = 'hate') AS n_hate, count(*) FILTER (label = 'sexual') AS n_sexual FROM doc_labels GROUP BY annotator""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.counts_by(read_table(spark, sf_dir, "doc_labels"), "annotator", "label", ["none", "abuse", "hate", "sexual"])


@_query("""WITH c AS (SELECT count(*) FILTER (category_page LIKE '%/abortion%') AS abortion, count(*) FILTER (category_page LIKE '%/contraception%') AS contraception, count(*) AS total FROM parsed_merged)
SELECT abortion, contraception, total, abortion + contraception AS combined, total - abortion - contraception AS other, round(100.0 * (abortion + contraception) / total, 4) AS share_pct FROM c""")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "parsed_merged").select("category_page")
    parts = t.select(F.contains("category_page", F.lit("/abortion")).cast("int").alias("abortion"), F.contains("category_page", F.lit("/contraception")).cast("int").alias("contraception"))
    return relational.share(parts, t.agg(F.count(F.lit(1)).alias("total")), ["abortion", "contraception"])


@_query("""SELECT market AS host, coalesce(min_by(market_name, listing_id) FILTER (coalesce(market_name, '') <> ''), '') AS name, string_agg(DISTINCT src, '; ' ORDER BY src) AS sources, CAST(count(DISTINCT src) FILTER (starts_with(src, 'search:')) AS BIGINT) AS search_hits
FROM (SELECT listing_id, market_name, regexp_extract(original_url, '//([^/?#]*)', 1) AS market, CASE WHEN rating IS NULL THEN 'listing' ELSE 'search:' || substr(rating, 1, 1) END AS src FROM parsed_merged) WHERE coalesce(market, '') <> '' GROUP BY market""")
def candidate_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "parsed_merged").select("listing_id", "market_name", F.regexp_extract("original_url", "//([^/?#]*)", 1).alias("host"), F.when(F.col("rating").isNull(), "listing").otherwise(F.concat(F.lit("search:"), F.substring("rating", 1, 1))).alias("src"))
    c = relational.candidates(t, "host", "src", "market_name", "listing_id")
    return c.select("host", "name", "sources", F.col("search_hits").cast("bigint").alias("search_hits"))


@_query("""SELECT source, posted_at, doc_id FROM (SELECT source, posted_at, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3""")
def first_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first three documents of each site."""
    return relational.first_per_group(read_table(spark, sf_dir, "documents").select("source", "posted_at", "doc_id"), "source", "doc_id", 3)


@_query("""WITH s AS (SELECT session_file, count(*) AS n_read, count(*) FILTER (coalesce(html, '') = '') AS n_failed FROM products_html GROUP BY session_file)
SELECT session_file, n_read, n_failed, CAST(sum(n_read) OVER (ORDER BY session_file) AS BIGINT) AS total_n_read FROM s""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _pages(spark, sf_dir).groupBy("session_file").agg(F.count(F.lit(1)).alias("n_read"), F.count_if(F.coalesce("html", F.lit("")) == "").alias("n_failed"))
    return relational.running_metrics(s, "session_file", ["n_read"], F.regexp_extract("session_file", r"(\d{8})", 1))


@_query("""WITH s AS (SELECT market AS host, count(*) AS hits, min(row_id) AS ord, CASE WHEN count(*) > 20 THEN CAST(count(DISTINCT category_page) AS INT) END AS score FROM products_html WHERE market IS NOT NULL GROUP BY market)
SELECT host, hits, row_number() OVER (ORDER BY coalesce(score, -1) DESC, hits DESC, ord) AS place FROM s""")
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = _pages(spark, sf_dir).filter("market is not null").groupBy(F.col("market").alias("host")).agg(F.count(F.lit(1)).alias("hits"), F.min("row_id").alias("ord"), F.when(F.count(F.lit(1)) > 20, F.countDistinct("category_page").cast("int")).alias("score"))
    # One row a site meets in the last task: a ranked report has one order.
    return s.select("host", "hits", F.row_number().over(Window.orderBy(F.coalesce(F.col("score"), F.lit(-1)).desc(), F.col("hits").desc(), "ord")).alias("place"))


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT category_page AS src, product_url AS dst FROM products_html WHERE category_page IS NOT NULL AND product_url IS NOT NULL),
s AS (SELECT DISTINCT category_page AS node FROM products_html WHERE contains(category_page, '/abortion'))
SELECT node, 0 AS hops FROM s UNION ALL SELECT DISTINCT dst, 1 FROM e JOIN s ON src = node WHERE dst NOT IN (SELECT node FROM s)""")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, sf_dir).select(F.col("category_page").alias("src"), F.col("product_url").alias("dst")).filter("src is not null and dst is not null").distinct()
    return relational.reachable(t, t.filter(F.contains("src", F.lit("/abortion"))).select(F.col("src").alias("node")), 2)


@_query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'retry' WHEN event_type = 'view' THEN 'retry' WHEN value < 5 THEN 'done' WHEN event_type = 'click' THEN 'more' ELSE 'more' END AS status FROM events""")
def attempt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts made of events: errors weren't fetched, views state no count, the value is the count."""
    e = F.col("event_type")
    t = read_table(spark, sf_dir, "events").select("event_id", (e != "error").alias("fetched"), F.when(e != "view", F.when(F.col("value") < 5, 0).otherwise(9)).alias("n_results"), F.lit(False).alias("countless"), F.lit(True).alias("usable"), F.lit(1).alias("page"), F.lit(3).alias("links"), F.lit(False).alias("repeated"), F.lit(False).alias("cap_hit"))
    return relational.attempt_status(t).select("event_id", "status")


@_query("""WITH r AS (SELECT term, count(*) AS n, list_sort(list(DISTINCT doc_id)) AS ids FROM documents JOIN (SELECT DISTINCT term FROM term_dictionary) ON contains(lower(text), lower(term)) GROUP BY term)
SELECT count(*) AS terms_searched, count(*) FILTER (n > 0) AS terms_with_results, CAST(sum(len(ids)) AS BIGINT) AS n_results FROM r""")
def forum_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a term search over all documents."""
    terms = [w for _, w, _ in tagging.load_terms(read_table(spark, sf_dir, "term_dictionary"))]
    low = F.lower("text")
    t = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in sorted(set(terms))]), lambda x: x.isNotNull())).alias("term"))
    r = t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"))
    return r.agg(F.count(F.lit(1)).alias("terms_searched"), F.count_if(F.col("n") > 0).alias("terms_with_results"), F.sum("ids").cast("bigint").alias("n_results"))


# ---- sources ----------------------------------------------------------------------------------------------------


@_query(r"""WITH o AS (SELECT file_id, regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}') AS l FROM landed_files WHERE content IS NOT NULL)
SELECT file_id, CAST(len(l) AS BIGINT) AS n_records FROM o""")
def salvaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete records of each landed file, whatever its layout."""
    t = read_table(spark, sf_dir, "landed_files").filter("content is not null")
    return t.select("file_id", F.size(records_column(F.col("content"), ["product_url"])).cast("bigint").alias("n_records"))


class _Folder:
    """A folder of its own in the shared folder, gone when the rows that are read back from it are kept elsewhere."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.path = spark, f"{spark.sparkContext.getCheckpointDir()}/export-{uuid.uuid4().hex}"

    def kept(self, df: DataFrame) -> DataFrame:
        try:
            return cut_lineage(df)
        finally:
            storage.delete(self.spark, self.path)


@_query("SELECT unit, quantity, CAST(factor AS VARCHAR) AS factor FROM unit_factors")
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as one JSON array and back."""
    f = _Folder(spark)
    sinks.write_json_array(read_table(spark, sf_dir, "unit_factors").withColumn("factor", F.col("factor").cast("string")), f"{f.path}/units.json")
    spark.dataSource.register(JsonArraySource)
    return f.kept(spark.read.format("json_array").schema("unit string, quantity string, factor string").load(f"{f.path}/units.json"))


@_query("""SELECT coalesce(market_name, '') AS market_name, coalesce(listing_title, '') AS listing_title, coalesce(price, '') AS price, CAST(listing_id AS VARCHAR) AS listing_id FROM parsed_merged""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, commas and line breaks as CSV and back; known columns first."""
    f = _Folder(spark)
    sinks.write_csv(read_table(spark, sf_dir, "parsed_merged").select("listing_id", "price", "listing_title", "market_name"), f"{f.path}/csv")
    t = f.kept(csv_tables.read_csv(spark, f"{f.path}/csv"))
    return t.select([F.coalesce(F.col(c), F.lit("")).alias(c) for c in t.columns])


@_query("SELECT DISTINCT category, term FROM term_dictionary")
def dictionary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary as a JSON object of lists and back."""
    f = _Folder(spark)
    rows = read_table(spark, sf_dir, "term_dictionary").groupBy("category").agg(F.sort_array(F.collect_set("term")).alias("terms")).collect()  # the dictionary is a small dimension
    storage.write_text(spark, f"{f.path}/terms.json", [json.dumps({r.category: list(r.terms) for r in rows})])
    return f.kept(csv_tables.read_terms(spark, f"{f.path}/terms.json"))


@_query("SELECT DISTINCT source AS site, lang AS term FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def progress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint of sites and what was done on them, written and read."""
    f = _Folder(spark)
    done = read_table(spark, sf_dir, "documents").filter("source is not null and lang is not null").select(F.col("source").alias("site"), F.col("lang").alias("term"))
    sinks.write_progress(done, f"{f.path}/progress.json")
    return f.kept(csv_tables.read_progress(spark, f"{f.path}/progress.json", "none"))


@_query("SELECT DISTINCT original_url AS url FROM parsed_merged WHERE original_url IS NOT NULL UNION SELECT DISTINCT product_url FROM documents WHERE product_url IS NOT NULL")
def append_only_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of two tables appended one after the other, each once."""
    f = _Folder(spark)
    for table, column in (("parsed_merged", "original_url"), ("documents", "product_url"), ("parsed_merged", "original_url")):
        sinks.append_new(read_table(spark, sf_dir, table).select(F.col(column).alias("url")).filter("url is not null"), f"{f.path}/urls", "url")
    return f.kept(csv_tables.read_existing(spark, f"{f.path}/urls", "url string"))


@_query("SELECT row_number() OVER (ORDER BY term, category) - 1 AS ord, term AS url FROM term_dictionary")
def seed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _Folder(spark)
    rows = read_table(spark, sf_dir, "term_dictionary").orderBy("term", "category").collect()  # a small dimension
    storage.write_text(spark, f"{f.path}/seeds.json", [json.dumps([r.term for r in rows])])
    return f.kept(discovery.read_seed_urls(spark, f"{f.path}/seeds.json"))


@_query("SELECT unit, quantity, NULL::VARCHAR AS category, NULL::VARCHAR AS term FROM unit_factors UNION ALL SELECT NULL, NULL, category, term FROM term_dictionary")
def union_of_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables and one that isn't there."""
    return relational.union_existing(spark, [f"{sf_dir}/{t}.parquet" for t in ("unit_factors", "missing", "term_dictionary")], "unit string, quantity string, category string, term string")


@_query("SELECT annotator, count(*) AS n FROM doc_labels WHERE label = 'none' GROUP BY annotator")
def approved_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "doc_labels").withColumn("ok", F.when(F.col("label") == "none", True).when(F.col("label") == "hate", False))
    return relational.approved(t, "ok").groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT market, count(*) AS n FROM products_html WHERE coalesce(html, '') <> '' GROUP BY market")
def pages_with_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).filter(F.coalesce("html", F.lit("")) != "").groupBy("market").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""SELECT row_id FROM products_html WHERE '/' || trim({_PATH.format(u="category_page")}, '/') IN (SELECT '/' || trim({_PATH.format(u="category_page")}, '/') FROM parsed_merged WHERE category_page IS NOT NULL)""")
def allowed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose category stands on a path that parsed listings name."""
    return discovery.on_allowed_paths(_pages(spark, sf_dir).select("row_id", "category_page"), "category_page", read_table(spark, sf_dir, "parsed_merged").select(F.col("category_page").alias("path")).filter("path is not null")).select("row_id")


@_query(r"""WITH s(key, first, later) AS (VALUES
  ('heading', 'http://heading.example.org/?search_terms={t}&search=simple', 'http://heading.example.org/?search_terms={t}&search=simple&page=2'), ('shop', 'http://shop.example.org/?s={t}&post_type=product', 'http://shop.example.org/page/2/?s={t}&post_type=product'),
  ('plain', 'http://plain.example.org/?s={t}', 'http://plain.example.org/page/2/?s={t}'), ('title', 'http://title.example.org/search?title={t}&source=&destination', 'http://title.example.org/search?title={t}&source=&destination&page=2'),
  ('query', 'http://query.example.org/search?query={t}', 'http://query.example.org/search?query={t}&page=2'), ('q', 'http://q.example.org/search?q={t}', 'http://q.example.org/search?q={t}&page=2'), ('results', 'http://results.example.org/results?q={t}', 'http://results.example.org/results?q={t}&page=2'),
  ('items', 'http://items.example.org/items.php?q={t}', 'http://items.example.org/items.php?q={t}&page=2'), ('forum', 'http://forum.example.org/search/?q={t}&sub=DNMSourcing', 'http://forum.example.org/search/?q={t}&sub=DNMSourcing&page=2'),
  ('advanced', 'http://advanced.example.org/search?adv=on&s_terms={t}&s_sellername=&s_order=0&s_tocountryid=0&s_countryid=0&s_category=All&s_lphysical=0&s_minprice=0.00&s_maxprice=99999.99&s_crypto=0&s_fulfill=2&s_multisig=0&s_bulk=2&s_stock=1&s_payment=0',
   'http://advanced.example.org/search?adv=on&s_terms={t}&s_sellername=&s_order=0&s_tocountryid=0&s_countryid=0&s_category=All&s_lphysical=0&s_minprice=0.00&s_maxprice=99999.99&s_crypto=0&s_fulfill=2&s_multisig=0&s_bulk=2&s_stock=1&s_payment=0&page=2')),
t AS (SELECT DISTINCT term, replace(replace(url_encode(term), '+', '%20'), '%2F', '/') AS e FROM term_dictionary)
SELECT key, term, p AS page, replace(CASE WHEN p = 1 THEN first ELSE later END, '{t}', e) AS url FROM s, t, (SELECT unnest([1, 2]) AS p)""")
def site_search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second results page of every term on every site of the registry."""
    sites = search.registry(spark)
    terms = relational.grid(sites.select("key"), read_table(spark, sf_dir, "term_dictionary"), "term").withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))
    return search.search_pages(sites, terms)


@_query("""WITH j AS (SELECT listing_id, lower('Listing to judge:' || chr(10) || 'title: ' || coalesce(listing_title, '') || chr(10) || 'market: ' || coalesce(market_name, '') || chr(10) || 'description: ' ||
    CASE WHEN length(coalesce(description, '')) > 800 THEN substr(description, 1, 800) || '...' ELSE coalesce(description, '') END) AS prompt FROM parsed_merged),
h AS (SELECT listing_id, min({'category': category, 'term': term}) AS m FROM j JOIN term_dictionary ON contains(prompt, lower(term)) GROUP BY listing_id)
SELECT listing_id, m IS NOT NULL AS relevant, CASE WHEN m.category IN ('abortion', 'contraception') THEN m.category ELSE 'none' END AS category, coalesce(m.term, '') AS product_type, CASE WHEN m IS NULL THEN 0.5 ELSE 0.9 END AS confidence FROM j LEFT JOIN h USING (listing_id)""")
def judged_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing judged through an empty cache by the rule judge, each wording once."""
    t = read_table(spark, sf_dir, "parsed_merged").select("listing_id", "listing_title", "market_name", "description")
    terms = [(r.category, r.term) for r in read_table(spark, sf_dir, "term_dictionary").distinct().orderBy("category", "term").collect()]  # a small dimension
    replies = cut_lineage(judging.judge_pending(t, spark.createDataFrame([], "cache_key string, reply string"), "rules", judging.rule_judge(terms)))
    return judging.judged(t, replies, "rules").select("listing_id", F.col("llm_relevant").alias("relevant"), F.col("llm_category").alias("category"), F.trim("llm_product_type").alias("product_type"), F.col("llm_confidence").alias("confidence"))


@_query("SELECT row_id FROM products_html WHERE EXISTS (SELECT 1 FROM term_dictionary WHERE contains(lower(html), lower(term)))")
def keyword_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose raw text holds a term of the dictionary."""
    terms = sorted({w for _, w, _ in tagging.load_terms(read_table(spark, sf_dir, "term_dictionary"))})
    return tagging.keyword_pages(_pages(spark, sf_dir).select("row_id", "html"), terms).select("row_id")


@_query("SELECT term, row_number() OVER (ORDER BY lower(term), term) AS place FROM (SELECT DISTINCT term FROM term_dictionary)")
def folded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's terms in order whatever their case; a small dimension."""
    from pyspark.sql import Window

    t = relational.sorted_folded(read_table(spark, sf_dir, "term_dictionary").select("term").distinct(), "term").withColumn("_at", F.monotonically_increasing_id())
    return t.select("term", F.row_number().over(Window.orderBy("_at")).alias("place"))
