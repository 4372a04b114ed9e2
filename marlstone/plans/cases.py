"""Queries over planted pages and rows: each extraction rule with a page that shows it, beside the rows that must come out.

What comes out of HTML can't be stated in SQL; the expected rows are written down by hand instead, so that the driver
compares them like any other result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import details, discovery, extraction, judging, page_flags, relational, search

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_BASE = "http://h.example.org/c/pills"


def _cases(columns: str, rows: str):
    """Registers a query with its expected rows, written as SQL values."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"SELECT * FROM (VALUES {rows.strip().rstrip(',')}) AS t({columns})"
        return f

    return add


def _pages(spark: SparkSession, pages: dict[str, str | None]) -> DataFrame:
    """(case_id, row_id, product_url, category_page, html) of planted pages."""
    return spark.createDataFrame([(k, n, "http://h.example.org/item/x", _BASE, h) for n, (k, h) in enumerate(pages.items())], "case_id string, row_id bigint, product_url string, category_page string, html string")


def _field(spark: SparkSession, pages: dict[str, str], *fields: str, profile: extraction.Profile = extraction.GENERAL) -> DataFrame:
    p = _pages(spark, pages)
    return extraction.parse_listings(p, profile=profile, only_products=False).join(p.select("row_id", "case_id"), "row_id").select("case_id", *fields)


def _t(title: str, body: str = "") -> str:
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


# ---- fields of a listing ----------------------------------------------------------------------------------------

MARKET_PAGES = {
    "wave": _t("Fine pill - THE X WAVE MARKET"), "osiris": _t("Osiris - Product - Fine pill"), "catharsis": _t("Fine pill - vendor - Catharsis"), "ops": _t("Product «Fine» - Black Ops"), "hub": _t("Drug Hub - Fine pill"),
    "dash": _t("Fine – pill –  River  Box "), "bar": _t("Fine | River Box"), "dash_first": _t("Fine | Bar – River"), "empty_end": _t("Fine –", '<meta property="og:site_name" content=" Meta  Shop ">'), "meta": _t("Fine", '<meta property="og:site_name" content="Meta &amp;amp; Shop">'),
    "heading": _t("Fine", '<div class="brand">' + "x" * 50 + '</div><div class="logo">Logo Shop</div>'), "class_part": _t("Fine", '<h1 class="my-site-head">Head Shop</h1>'), "none": _t("Fine pill - Other"), "no_title": "<p>x</p>",
}


@_cases("case_id, market_name", "('wave', 'THE X WAVE MARKET'), ('osiris', 'Osiris'), ('catharsis', 'Catharsis'), ('ops', 'Black Ops'), ('hub', 'Drug Hub'), ('dash', 'River Box'), ('bar', 'River Box'), ('dash_first', 'River'), ('empty_end', 'Meta Shop'), ('meta', 'Meta & Shop'), ('heading', 'Logo Shop'), ('class_part', 'Head Shop'), ('none', ''), ('no_title', '')")
def market_name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, MARKET_PAGES, "market_name")


TITLE_PAGES = {
    "hub": _t("Drug Hub - Pill 5 mg", "<h1>Shopping Cart</h1>"), "osiris": _t("Osiris - Product - Pill - strong", "<h1>x y z</h1>"), "abacus": _t("Pill - strong | Abacus Market", "<h1>About Vendor</h1>"), "ops": _t("x", '<div class="product_pg_r_title">Pill - strong</div><h1 class="product_title">Other</h1>'),
    "woo": _t("x", '<h1 class="entry-title">Entry</h1><h1 class="product_title">Pill | strong</h1>'), "woo_class": _t("x", '<h1 class="product-single title-big">Classy</h1>'), "center": _t("x", "<center><b><h5>Centred pill</h5></b></center><h1>Other</h1>"),
    "dash": _t("x", "<h1>Pill 5 mg - best price - now</h1>"), "bar": _t("x", "<h1>Pill 5 mg | shop</h1>"), "buy": _t("x", "<h1>Buy Pill buy 5 mg</h1>"), "short": _t("Long enough title", "<h1>abc</h1>"), "title": _t("Pill | shop"), "name": _t("x", '<p class="drug-name">Drug name</p>'), "entity": _t("x", '<h1 class="product_title">A &amp;amp; B</h1>'), "none": _t("x", "<h1>ab</h1>"), "inner": _t("x", '<h1 class="product_title">Pi<b>ll</b> 5</h1>'),
}


@_cases("case_id, listing_title", "('hub', 'Pill 5 mg'), ('osiris', 'Pill - strong'), ('abacus', 'Pill - strong'), ('ops', 'Pill - strong'), ('woo', 'Pill | strong'), ('woo_class', 'Classy'), ('center', 'Centred pill'), ('dash', 'Pill 5 mg'), ('bar', 'Pill 5 mg'), ('buy', 'Pill5 mg'), ('short', 'Long enough title'), ('title', 'Pill'), ('name', 'Drug name'), ('entity', 'A & B'), ('none', ''), ('inner', 'Pill 5')")
def listing_title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, TITLE_PAGES, "listing_title")


PRICE_PAGES = {
    "one": '<p class="price">$9.50</p>', "many": '<p class="price">$12 to $30</p>', "zero_and_other": '<p class="price">$0 <b>$5</b></p>', "zero": '<p class="price">$0</p>', "zero_cents": '<p class="price">$0.00 $5</p>', "text_order": '<p class="price">$9 and $10</p>',
    "summary_twice": '<div class="summary"><p class="x-Price">$5 now $5</p></div><p class="price">$7</p>', "summary_zero": '<div class="summary"><p class="price">$0</p></div><p class="price">$7</p>', "summary_empty": '<div class="summary"><p class="price">ask</p></div><p class="price">$7 $7</p>', "summary_other": '<div class="summary"><p>$3</p></div><p class="price">$7</p>',
    "thousands": '<p class="product-price">$1,200.50</p>', "class_part": '<span class="my-price-tag">$4</span>', "amount": '<b class="woocommerce-Price-amount">$8</b>', "no_dollar": '<p class="price">9 EUR</p>', "none": "<p>$9</p>", "point": '<p class="price">$9.</p>',
}


@_cases("case_id, price", "('one', '$9.50'), ('many', '$12 - $30'), ('zero_and_other', '$5'), ('zero', '$0'), ('zero_cents', '$0.00 - $5'), ('text_order', '$10 - $9'), ('summary_twice', '$5 - $5'), ('summary_zero', '$0'), ('summary_empty', '$7'), ('summary_other', '$7'), ('thousands', '$1,200.50'), ('class_part', '$4'), ('amount', '$8'), ('no_dollar', ''), ('none', ''), ('point', '$9.')")
def price_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, PRICE_PAGES, "price")


DOSAGE_PAGES = {
    "cells": "<table><tr><th>Dose</th><td>5 mg tablet</td></tr></table>", "one_cell": "<table><tr><td>5 mg tablet</td></tr></table>", "text": "<p>10ml or 2 grams, 5 great</p>", "selector": '<b class="strength">strong</b>', "four": "<p>1 mg 2 mg 3 mg 4 mg</p>", "twice": "<p>5 mg 5 mg 5  mg</p>", "case": "<p>5 MG</p>", "script": "<script>5 mg</script>", "none": "<p>five</p>",
}


@_cases("case_id, dosage", "('cells', '5 mg tablet | 5 mg'), ('one_cell', '5 mg'), ('text', '10ml | 2 grams | 5 g'), ('selector', 'strong'), ('four', '1 mg | 2 mg | 3 mg'), ('twice', '5 mg'), ('case', '5 MG'), ('script', ''), ('none', '')")
def dosage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, DOSAGE_PAGES, "dosage")


RATING_PAGES = {"five": '<b class="rating">4.5/5</b>', "stars": '<b class="stars">4 Stars by 7</b>', "next": '<b class="rating">good</b><b class="my-star">3 / 5</b>', "first_only": '<b class="rating">good</b><b class="rating">3/5</b>', "none": "<b>4/5</b>"}


@_cases("case_id, rating", "('five', '4.5'), ('stars', '4'), ('next', '3'), ('first_only', ''), ('none', '')")
def rating_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, RATING_PAGES, "rating")


_R20, _R21 = "r" * 20, "s" * 21
REVIEW_PAGES = {
    "edge": f'<div class="customer-reviews"><p>{_R20}</p><p>{_R21}</p></div>', "two": f'<section class="reviews"><p>{_R21}a</p><span>{_R21}b</span><p>{_R21}c</p></section>', "nested": f'<section class="reviews"><div><b>{_R21}</b></div><div>{_R21}<i>x</i></div></section>', "none": f"<p>{_R21}</p>",
}


@_cases("case_id, review", f"('edge', '{_R21} | {_R21}'), ('two', '{_R21}a | {_R21}b'), ('nested', '{_R21} | {_R21}'), ('none', '')")
def review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that two selectors find count twice: in 'edge' .customer-reviews and [class*=review], in 'nested' .reviews and [class*=review]."""
    return _field(spark, REVIEW_PAGES, "review")


DESCRIPTION_PAGES = {
    "short_own": '<div class="product_pg_r_text">' + "a" * 11 + "</div>", "too_short_own": '<div class="product_pg_r_text">' + "a" * 10 + "</div>", "fifty": '<div class="description">' + "b" * 50 + "</div>", "fifty_one": '<div class="description">' + "b" * 51 + "</div>", "full": '<div class="entry-content">' + "c" * 500 + "</div>",
    "cut": '<div class="entry-content">' + "c" * 501 + "</div>", "order": '<div class="my-description">' + "d" * 60 + '</div><div class="product-content">' + "e" * 60 + "</div>", "meta": '<meta name="description" content="' + "f" * 21 + '">', "meta_short": '<meta name="description" content="' + "f" * 20 + '">', "meta_long": '<meta name="description" content="' + "g" * 600 + '">',
}


@_cases("case_id, description", "('short_own', repeat('a', 11)), ('too_short_own', ''), ('fifty', ''), ('fifty_one', repeat('b', 51)), ('full', repeat('c', 500)), ('cut', repeat('c', 500) || '...'), ('order', repeat('e', 60)), ('meta', repeat('f', 21)), ('meta_short', ''), ('meta_long', repeat('g', 600))")
def description_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, DESCRIPTION_PAGES, "description")


STOCK_PAGES = {
    "in_stock": "<p>1,200 in stock</p>", "hyphen": "<p>7 in-stock</p>", "available": "<p>8 Available</p>", "label": "<p>Stock: 9</p>", "quantity": "<p>Quantity 10</p>", "priority": "<p>Stock: 9, 11 in stock</p>", "element": '<p class="stock">many (12) of stock left</p>', "element_other": '<p class="stock">many 12</p>',
    "attribute": '<p data-stock="x"></p><p data-stock="13"></p><p data-quantity="14"></p>', "second_attribute": '<p data-quantity="14"></p>', "none": "<p>sold out</p>",
}


@_cases("case_id, number_in_stocks", "('in_stock', '1200'), ('hyphen', '7'), ('available', '8'), ('label', '9'), ('quantity', '10'), ('priority', '11'), ('element', '12'), ('element_other', ''), ('attribute', '13'), ('second_attribute', '14'), ('none', '')")
def stock_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, STOCK_PAGES, "number_in_stocks")


SECOND_PAGES = {
    "full": '<title>Second site</title><center><font style="font-size:2em">Fine pill 5 mg</font><p>vendor (114) (4.89 ★)</p></center><p>USD 12.50 each</p><div id="description"> Good <b>pill</b></div><table><tr><td>Category</td><td>Pills and more</td><td>x</td></tr><tr><td>Category</td><td>Pills</td></tr><tr><td>Shipping</td><td>EU -&gt; World</td></tr></table>',
    "jammed": "<h1>short</h1><title>Long title here</title><table><tr><td>Product Rating4.5 of 5</td></tr><tr><td>CategoryPills Price 9</td></tr><tr><td>Shipping India -> World Wide</td></tr></table>", "only_from": "<table><tr><th>Shipping</th><td>- Norway -</td></tr></table>", "none": "<p>x</p>", "empty": "",
}


@_cases("case_id, market_name, listing_title, price, rating, description, category, ship_from, ship_to, dosage", """
('full', 'TorZon Market', 'Fine pill 5 mg', 'USD 12.50', '4.89', 'Good pill', 'Pills', 'EU', 'World', ''), ('jammed', 'TorZon Market', 'Long title here', '', '4.5', '', 'Pills ', '', '', ''),
('only_from', 'TorZon Market', '', '', '', '', '', 'Norway', '', ''), ('none', 'TorZon Market', '', '', '', '', '', '', '', ''), ('empty', 'TorZon Market', '', '', '', '', '', '', '', '')""")
def second_site_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'Shipping India' starts with the label and a blank, so its neighbour counts and there is none."""
    return _field(spark, SECOND_PAGES, "market_name", "listing_title", "price", "rating", "description", "category", "ship_from", "ship_to", "dosage", profile=extraction.SECOND)


# ---- links ------------------------------------------------------------------------------------------------------

LINK_PAGES = {
    "cards": '<ul class="products"><li class="product"><a class="woocommerce-LoopProduct-link" href="/product/a">A</a><h2><a href="/product/b">B</a></h2><a href="/product-category/z">Z</a></li><li><a href="/product/c">C</a></li></ul><a href="/item/9">9</a><a href="/c/pills/">self</a>',
    "marks": '<a href="/item/1#x">1</a><a href="/category/item/2">2</a><a href="/item/vintage-lamp">lamp</a><a href="/tag/item/3">3</a><a href="/shop/cart">cart</a><a href="/p/x">p</a><a href="/about">a</a><a href="/item/1#x">again</a>',
    "number": '<a href="/search/product/01234567-89ab-cdef-0123-456789abcdef">u</a><a href="/search/product/abc">n</a><a href="products.php?x=1&amp;action=view">v</a>', "none": "<p>x</p>",
}


@_cases("case_id, link", """('cards', '/product/a'), ('cards', '/product/b'), ('cards', '/product/c'), ('marks', '/item/1#x'), ('marks', '/item/vintage-lamp'), ('marks', '/p/x'),
('number', '/search/product/01234567-89ab-cdef-0123-456789abcdef'), ('number', '/c/products.php?x=1&action=view')""")
def product_link_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, LINK_PAGES).select("case_id", F.explode(extraction.product_links_column(F.col("html"), F.col("category_page"))).alias("u"))
    return t.select("case_id", F.replace("u", F.lit("http://h.example.org"), F.lit("")).alias("link"))


@_cases("case_id, looks_blocked", "('text', false), ('blocked', true), ('limit', true)")
def quarantine_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without product links, and whether they look blocked."""
    p = _pages(spark, {"text": "<p>nothing</p>", "blocked": "<p>Solve this CAPTCHA</p>", "limit": "Rate limit reached", "links": '<a href="/item/1">captcha</a>', "empty": ""})
    return extraction.empty_pages(p).join(p.select("row_id", "case_id"), "row_id").select("case_id", "looks_blocked")


PAGER_PAGES = {
    "next": '<a rel="next" href="?page=2">n</a><div class="pagination"><a href="?page=3">3</a></div>', "bar": '<div class="pagination"><a href="?page=3">3</a><a href="?page=2">2</a><a href="?page=3">3</a></div><nav><a href="http://other.example.org/">o</a><a href="/x">x</a></nav>', "none": "<a href='?page=2'>2</a>",
}


@_cases("case_id, pager, urls", """('next', '?page=2', '|?page=2|?page=3'), ('bar', '?page=3|?page=2|?page=3', '|/x|?page=2|?page=3'), ('none', '', '')""")
def pager_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the first pager, repeated ones too; and the union over all pagers on the host, with the page itself."""
    short = lambda c: F.transform(c, lambda u: F.replace(F.replace(u, F.lit(_BASE), F.lit("")), F.lit("http://h.example.org"), F.lit("")))
    t = _pages(spark, PAGER_PAGES).select("case_id", short(extraction.pager_links_column(F.col("html"), F.col("category_page"))).alias("p"), short(extraction.page_urls_column(F.col("html"), F.col("category_page"))).alias("u"))
    return t.select("case_id", F.array_join("p", "|").alias("pager"), F.array_join(F.array_sort("u"), "|").alias("urls"))


CATEGORY_PAGE = (
    '<a href="/pills">Pills  now</a><a href="/pills#top">again</a><a href="/a/b">Two</a><a href="/a/b/c">Three</a><a href="/shop/a/b">Hinted</a><a href="/Cart">Cart</a><a href="/a/2FA">2fa</a><a href="/">Home</a><a href="http://o.example.org/x">Other</a><a href="/item/5">Item</a><a href="/x?action=view">View</a>'
    '<a href="/rx/1">Rx</a><a href="http://[bad">bad</a><h2><a href="/t">Tiny</a></h2><li class="product"><h3>Card 1</h3><a href="/q">ab</a></li><div class="post-title">On: <a href="/post/1/#c-2">P</a><a href="/post/1/#c-3">P</a></div><p class="post-title"><a href="/post/9">no div</a></p>'
)


@_cases("kind, place, url, name", """('category', 0, '/pills', 'Pills now'), ('category', 1, '/a/b', 'Two'), ('category', 2, '/shop/a/b', 'Hinted'), ('category', 3, '/rx/1', 'Rx'), ('category', 4, '/t', 'Tiny'), ('category', 5, '/q', 'ab'),
('hinted', 0, '/shop/a/b', ''), ('hinted', 1, '/rx/1', ''), ('title', 0, '', 'Card 1'), ('title', 1, '', 'Tiny'), ('post', 0, '/post/1/', '')""")
def category_link_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of a home page, links that hint at one, sample titles and forum posts."""
    p = _pages(spark, {"home": CATEGORY_PAGE})
    h, u = F.col("html"), F.col("category_page")
    plain = lambda a, url, name: F.transform(a, lambda x: F.struct(F.replace(url(x), F.lit("http://h.example.org"), F.lit("")).alias("url"), name(x).alias("name")))
    blank = lambda x: F.lit("")
    same = lambda x: x
    kinds = {
        "category": plain(extraction.category_links_column(h, u), lambda x: x["href"], lambda x: x["text"]), "hinted": plain(extraction.hinted_links_column(10)(h, u), same, blank),
        "title": plain(extraction.sample_titles_column(h, u), blank, same), "post": plain(extraction.forum_links_column(h, u), same, blank),
    }
    out = None
    for k, c in kinds.items():
        t = p.select(F.lit(k).alias("kind"), F.posexplode(c).alias("place", "x")).select("kind", "place", "x.url", "x.name")
        out = t if out is None else out.unionByName(t)
    return out


@_cases("host, name", "('abc.example.org', 'Name'), ('xyz.example.net', '')")
def host_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, {"x": '<a href="http://ABC.example.org/a">Name</a> see xyz.example.net <a href="http://abc.example.org/b">Later</a>'})
    return p.select(F.explode(extraction.hosts_column(r"[a-z]+\.example\.(?:org|net)")(F.col("html"), F.col("product_url"))).alias("x")).select("x.host", "x.name").filter("host <> 'h.example.org'")


@_cases("href, resolved", "('/x', 'http://a.example.org/x'), ('x', 'http://a.example.org/b/x'), ('../x', 'http://a.example.org/x'), ('?q=1', 'http://a.example.org/b/c?q=1'), ('//o.example.org/y', 'http://o.example.org/y'), ('#f', 'http://a.example.org/b/c#f'), ('mailto:x', 'mailto:x'), ('', 'http://a.example.org/b/c')")
def resolve_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(h,) for h in ("/x", "x", "../x", "?q=1", "//o.example.org/y", "#f", "mailto:x", "")], "href string")
    return d.select("href", extraction.resolved_url(F.lit("http://a.example.org/b/c"), F.col("href")).alias("resolved"))


# ---- search -----------------------------------------------------------------------------------------------------

COUNT_PAGES = [
    ("heading", '<h1 class="h2 m-0 mb-1">A pill</h1><h1 class="h2 m-0 mb-1"><strong>1,616</strong> Listings</h1>'), ("heading", '<h1 class="h2 m-0 mb-1"><strong>12</strong> pills</h1>'), ("heading", '<h1 class="h2"><strong>12</strong> Listings</h1>'), ("heading", '<h1 class="h2 m-0 mb-1"><strong>no</strong> Listings</h1>'),
    ("fetched", "<p>Fetched 1,072 results in 4.8 seconds</p>"), ("fetched", "<p>Couldn’t find any results for that query</p>"), ("fetched", "<p>72 results</p>"), ("found", "Found <b>1616</b> results."), ("found", "Found none"), ("shop", '<p class="woocommerce-result-count">Showing all 10 results</p>'),
    ("shop", '<p class="woocommerce-result-count">Showing the single result</p>'), ("shop", '<p class="woocommerce-result-count">Showing 1–12 of 1,030 results</p>'), ("shop", '<p class="woocommerce-result-count">7 results</p>'), ("shop", '<p class="woocommerce-result-count">No products</p>'), ("shop", "<p>Showing all 10 results</p>"),
    ("forum", '<div class="searchamount"><div>Exactly <strong>5</strong> results</div></div>'), ("forum", '<div class="searchamount">No results</div>'), ("forum", '<div class="searchamount">something</div>'), ("forum", "5 results"), ("forum", '<div class="searchamount">0 results</div>'), ("other", "5 results"), ("shop", None), ("fetched", ""),
]


@_cases("n, rule, n_results", """(0, 'heading', 1616), (1, 'heading', NULL), (2, 'heading', NULL), (3, 'heading', NULL), (4, 'fetched', 1072), (5, 'fetched', 0), (6, 'fetched', NULL), (7, 'found', 1616), (8, 'found', NULL), (9, 'shop', 10), (10, 'shop', 1), (11, 'shop', 1030), (12, 'shop', 7),
(13, 'shop', NULL), (14, 'shop', NULL), (15, 'forum', 5), (16, 'forum', 0), (17, 'forum', NULL), (18, 'forum', NULL), (19, 'forum', 0), (20, 'other', NULL), (21, 'shop', NULL), (22, 'fetched', NULL)""")
def count_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is unknown, 0 is none."""
    d = spark.createDataFrame([(n, r, h) for n, (r, h) in enumerate(COUNT_PAGES)], "n int, rule string, html string")
    return d.select("n", "rule", search.result_count(F.col("rule"), F.col("html")).alias("n_results"))


# ---- nested records ---------------------------------------------------------------------------------------------

DETAIL_PAGES = {
    "full": '<div class="product"><h1 class="product_title"> Fine\n pill </h1><div class="summary"><p class="price">€1,5 now</p></div><p class="stock">7 left</p><div class="description"><p>Maker Name: Acme: Ltd</p><p>plain</p></div><span class="posted_in"><a>Shop</a><a>Pills</a><a>Pills</a></span><b class="sku">S-1</b>'
    '<div class="star-rating" style="width: 80%">Rated 4.5 out of 5</div><a class="woocommerce-review-link">(12 reviews)</a><div class="comment"><p class="comment-text">Good</p><b class="comment-author">Ann</b><i class="star-rating" style="width:100%"></i></div>'
    '<table class="variations"><tr><th>Size</th><td>10</td></tr><tr><td>x</td></tr></table><table class="price-list"><tr><td>10 pcs</td><td>$5.50</td></tr><tr><td>ask</td><td>us</td></tr></table><img class="wp-post-image" src="" data-src="/a.png"><img class="wp-post-image" src="/placeholder.png"></div>',
    "status": '<h1>Plain</h1><p class="stock">Out of stock</p><p class="price">ask</p><div class="star-rating" style="width:60%"></div>', "none": "<p>x</p>",
}
_NULLS = ", ".join(["NULL"] * 17)


@_cases("case_id, title, price, price_numeric, stock_raw, in_stock_count, stock_status, description, maker, categories, primary_category, sku, rating_percent, rating_stars, review_count, review, variations, tiers, images, main_image", f"""
('full', 'Fine pill', '€1,5 now', '15', '7 left', '7', NULL, 'Maker Name: Acme: Ltd plain', 'Acme: Ltd', 'Pills', 'Pills', 'S-1', '80', 4.5, 12, 'Good|Ann|5.0', 'Size=10', '10=5.50', '/a.png', '/a.png'),
('status', 'Plain', NULL, NULL, 'Out of stock', NULL, 'Out of stock', NULL, NULL, NULL, NULL, NULL, '60', 3.0, NULL, NULL, NULL, NULL, NULL, NULL), ('none', NULL, {_NULLS}, NULL)""")
def detail_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, DETAIL_PAGES)
    t = details.details(p).join(p.select("row_id", "case_id"), "row_id")
    r = lambda c, f: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, f), ";"))
    return t.select(
        "case_id", "title", "price", "price_numeric", "stock_raw", "in_stock_count", "stock_status", "description", F.col("desc_kv")["maker_name"].alias("maker"), F.array_join("categories", ";").alias("categories"), "primary_category", "sku", "rating_percent", "rating_stars", F.col("review_count").cast("bigint").alias("review_count"),
        r("reviews", lambda x: F.concat_ws("|", x["text"], x["author"], x["rating"].cast("string"))).alias("review"), r("variations", lambda x: F.concat(x["option"], F.lit("="), x["value"])).alias("variations"), r("price_tiers", lambda x: F.concat(x["quantity"], F.lit("="), x["price"])).alias("tiers"), F.array_join("images", ";").alias("images"), "main_image",
    )


CARD_PAGES = {
    "cards": '<li class="product"><h2>Pill <b>A</b></h2><span class="price">$ 5</span><a href="/a">x</a></li><li class="product"><h3>Pill B</h3><a href="/b">x</a></li><li class="product"><h3>No link</h3></li><div class="product-item"><h2>Late</h2><a href="/c">x</a></div><a href="?page=2">2</a>',
    "detail": '<h1 class="product_title">Lone pill</h1><p class="price">$9</p><div class="product-detail">Main <b>text</b></div><nav><a href="/n">n</a></nav>', "none": '<div class="content">c<p>d</p></div>',
}


@_cases("case_id, listing_url, title, price", "('cards', '/a', 'PillA', '$ 5'), ('cards', '/b', 'Pill B', 'N/A'), ('detail', '/c/pills', 'Lone pill', '$9')")
def card_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, CARD_PAGES).select("case_id", F.explode(details.legacy_products_column(F.col("html"), F.col("category_page"))).alias("c"))
    return t.filter("c.market = 'h.example.org'").select("case_id", F.replace("c.listing_url", F.lit("http://h.example.org"), F.lit("")).alias("listing_url"), "c.title", "c.price")


@_cases("case_id, content, next_pages", "('cards', '', '?page=2'), ('detail', 'Main text', '/n'), ('none', 'c d', '')")
def content_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = lambda c: F.transform(c, lambda u: F.replace(F.replace(u, F.lit(_BASE), F.lit("")), F.lit("http://h.example.org"), F.lit("")))
    h, u = F.col("html"), F.col("category_page")
    return _pages(spark, CARD_PAGES).select("case_id", details.content_text_column(h, u).alias("content"), F.array_join(short(details.next_pages_column(h, u)), "|").alias("next_pages"))


# ---- predicates, texts and decisions ----------------------------------------------------------------------------

_LONG = "x" * 1200
_LINKS = "<a href='1'>1</a><a href='2'>2</a><a href='3'>3</a>"
FLAG_PAGES = [
    (401, _LONG), (403, None), (200, "CloudFlare"), (200, "cloudflare" + "x" * 4000 + _LINKS), (200, "are you human?"), (200, "I'm not a robot"), (200, "<p>Please <b>wait</b></p>" + _LINKS), (200, "<p>Please <b>wait</b></p><a>no address</a>"), (200, "<script>please wait</script>" + _LONG), (200, "You have been placed in a QUEUE" + "x" * 5000), (200, "estimated wait"), (200, "Just a moment"),
    (200, "One moment"), (200, "you are being redirected"), (200, "enable JavaScript"), (200, "verify you are human" + _LONG), (200, "ddos-guard" + _LONG), (200, "DDoS protection" + "x" * 5000), (200, "get a new Tor identity"), (200, "Kill switch" + _LONG), (200, '<meta http-equiv="refresh" content="0; url=/">'), (200, "<title>Checking your browser</title>" + _LONG), (200, "<title>ok</title>checking your browser" + _LONG), (200, "checking your browser" + _LONG), (200, _LONG), (200, ""), (None, None),
]


@_cases("n, walled, gated, captcha, identity_block, bounce, forum_block, usable", """
(0, true, true, false, false, false, false, true), (1, true, true, false, false, false, true, false), (2, true, true, true, false, false, true, false), (3, false, false, true, false, false, false, false), (4, true, true, true, false, false, true, false), (5, true, true, false, false, false, true, false),
(6, false, false, false, false, false, true, false), (7, false, true, false, false, false, true, false), (8, false, false, false, false, false, false, true), (9, false, true, false, false, false, false, true), (10, false, true, false, false, false, true, false), (11, false, true, false, false, false, true, false),
(12, false, true, false, false, false, true, false), (13, false, true, false, false, false, true, false), (14, false, true, false, false, false, true, false), (15, false, false, true, false, false, false, false), (16, true, true, true, false, false, false, false), (17, false, true, false, true, false, false, true),
(18, false, false, false, true, false, true, false), (19, false, false, false, true, false, false, true), (20, false, false, false, false, true, true, false), (21, false, false, false, false, false, true, true), (22, false, false, false, false, false, false, true), (23, false, false, false, false, false, false, true),
(24, false, false, false, false, false, false, true), (25, false, false, false, false, false, true, false), (26, false, false, false, false, false, true, false)""")
def flag_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(n, s, h) for n, (s, h) in enumerate(FLAG_PAGES)], "n int, status int, html string")
    h, f = F.col("html"), page_flags
    return d.select("n", f.walled(F.col("status"), h).alias("walled"), f.gated(F.col("status"), h).alias("gated"), f.captcha(h).alias("captcha"), f.identity_block(h).alias("identity_block"), f.bounce(h).alias("bounce"), f.forum_block(h).alias("forum_block"), f.usable_results(h).alias("usable"))


ATTEMPTS = [
    ("not fetched", False, 5, False, True, 1, 3, False, False), ("unknown count", True, None, False, True, 1, 3, False, False), ("no results", True, 0, False, True, 1, 0, False, False), ("countless, empty", True, None, True, True, 1, 0, False, False), ("countless, unusable", True, None, True, False, 1, 0, False, False), ("counted, no links", True, 5, False, True, 1, 0, False, False),
    ("later page empty", True, 5, False, True, 2, 0, False, False), ("page repeats", True, 5, False, True, 2, 3, True, False), ("cap hit", True, 5, False, True, 2, 3, False, True), ("goes on", True, 5, False, True, 2, 3, False, False), ("countless goes on", True, None, True, True, 1, 4, False, False), ("nothing known", None, None, None, None, 1, 0, None, None),
]


@_cases("attempt, status", "('not fetched', 'retry'), ('unknown count', 'retry'), ('no results', 'done'), ('countless, empty', 'done'), ('countless, unusable', 'retry'), ('counted, no links', 'retry'), ('later page empty', 'done'), ('page repeats', 'done'), ('cap hit', 'retry'), ('goes on', 'more'), ('countless goes on', 'more'), ('nothing known', 'retry')")
def attempt_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(ATTEMPTS, "attempt string, fetched boolean, n_results int, countless boolean, usable boolean, page int, links int, repeated boolean, cap_hit boolean")
    return relational.attempt_status(d).select("attempt", "status")


_GOOD = '{"relevant": true, "category": " Abortion", "product_type": "x ", "confidence": 0.12349, "reason": "r"}'
REPLIES = [_GOOD, "```json\n" + _GOOD + "\n```", "Sure! " + _GOOD + " done", "[1]", "no", None, '{"relevant": 1, "category": "zzz", "confidence": "high"}', '{"relevant": "yes", "category": "CONTRACEPTION"}', '{"relevant": null, "confidence": 2}', '{"relevant": 0}']


@_cases("n, relevant, category, product_type, confidence, reason", """(0, true, 'abortion', 'x', 0.123, 'r'), (1, true, 'abortion', 'x', 0.123, 'r'), (2, true, 'abortion', 'x', 0.123, 'r'), (3, NULL, '', '', NULL, 'unreadable reply'), (4, NULL, '', '', NULL, 'unreadable reply'), (5, NULL, '', '', NULL, 'unreadable reply'),
(6, true, 'none', '', NULL, ''), (7, NULL, 'contraception', '', NULL, ''), (8, NULL, 'none', '', 2.0, ''), (9, false, 'none', '', NULL, '')""")
def verdict_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(list(enumerate(REPLIES)), "n int, reply string")
    return d.select("n", T.verdict(T.json_lenient(F.col("reply"))).alias("v")).select("n", "v.*")


@_cases("n, category, seconds, cell, line, url, pct", """(0, 'abortion', 5.0, 'True', 'a b', 'http://h.example.org/x', '61.33%'), (1, 'contraception', -1.0, 'False', 'a b', 'x', '0.00%'), (2, 'contraception', -1.0, '', '', '', '1,234.50%'), (3, NULL, -1.0, '', '', NULL, NULL)""")
def scalar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of verdict and match, recency, cells, single lines, addresses without fragment, percent."""
    rows = [(0, "none", "abortion; contraception", "5", True, "a\n b", "http://h.example.org/x#y#z", 0.6133), (1, "Contraception", "", "x", False, " a   b ", "x", 0.0), (2, None, "foo, contraception", "NaN", None, "", "", 12.345), (3, "", None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "n int, v string, m string, at string, flag boolean, t string, u string, f double")
    return d.select("n", T.resolved_category(F.col("v"), F.col("m")).alias("category"), T.recency(F.col("at")).alias("seconds"), T.cell(F.col("flag"), "boolean").alias("cell"), F.coalesce(T.single_line(F.col("t")), F.lit("")).alias("line"), U.strip_fragment(F.col("u")).alias("url"), discovery.percent(F.col("f")).alias("pct"))


@_cases("id, site, relevant, price", "(1, 'Second site', true, '5'), (2, 'Second site', NULL, NULL)")
def overlay_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict laid over records, in which the right side wins, and a site's name written over all rows."""
    d = spark.createDataFrame([(1, "a", False, "5", True), (2, "b", True, None, None)], "id int, site string, relevant boolean, price string, verdict boolean")
    return relational.overlay(d, {"relevant": F.col("verdict"), "site": F.lit("Second site")}).drop("verdict")


@_cases("round, what, n", "(1, 'asked', 2), (1, 'approved', 1), (2, 'asked', 1), (2, 'approved', 2)")
def verdict_cache_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is asked in two rounds: equal wordings once, what the cache holds not again; failures aren't cached."""
    schema = "listing_title string, market_name string, description string"
    one = spark.createDataFrame([("pill", "m", None), ("pill", "m", None), ("ring", "m", ""), ("fails", "m", "")], schema)
    two = one.unionByName(spark.createDataFrame([("new pill", "m", "")], schema))
    rules = judging.rule_judge([("abortion", "pill")])
    judge = lambda prompt: None if "fails" in prompt else rules(prompt)
    empty = spark.createDataFrame([], "cache_key string, reply string")
    first = judging.judge_pending(one, empty, "m1", judge)
    second = judging.judge_pending(two, first, "m1", judge)
    n = lambda r, what, df: df.agg(F.lit(r).alias("round"), F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    yes = lambda rows, cache: relational.approved(judging.judged(rows, cache, "m1"), "llm_relevant").select("listing_title").distinct()
    return n(1, "asked", first).unionByName(n(1, "approved", yes(one, first))).unionByName(n(2, "asked", second)).unionByName(n(2, "approved", yes(two, first.unionByName(second))))


@_cases("n, category", "(0, false), (1, false), (2, false), (3, false), (4, true), (5, true)")
def product_detail_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of products are no categories, whatever their depth."""
    urls = ["/product/a", "/Item/5", "/LISTING/x", "/a/01234567-89ab-cdef-0123-456789abcdef", "/a/01234567-89ab", "/items"]
    d = spark.createDataFrame([(n, f'<a href="{u}">x</a>') for n, u in enumerate(urls)], "n int, html string")
    return d.select("n", (F.size(extraction.category_links_column(F.col("html"), F.lit("http://h.example.org/"))) > 0).alias("category"))


# ---- reports ----------------------------------------------------------------------------------------------------

_SITES = [
    ("A", "a.example.org", "http://a.example.org/", ["search:x", "directory:d"], 1, "scored", 200, 3, ["c", "d"], ["T 1", "T 2"], ["http://a.example.org/c/1", "http://a.example.org/c/2"], 0),
    ("B", "b.example.org", "http://b.example.org/", ["directory:d"], 0, "dead", None, None, None, None, [], 1), ("", "c.example.org", "http://c.example.org/", ["search:y", "search:x"], 2, "wall/manual", 403, None, [], [], None, 2),
]
_SITE_SCHEMA = "name string, host string, onion_url string, sources array<string>, search_hits int, status string, http_status int, score int, matched_categories array<string>, sample_titles array<string>, candidate_category_urls array<string>, ord int"


@_cases("name, onion_url, sources, search_hits, status, http_status, score, matched_categories, sample_titles, candidate_category_urls", """
('A', 'http://a.example.org/', 'directory:d; search:x', 1, 'scored', '200', '3', 'c; d', 'T 1 | T 2', 'http://a.example.org/c/1 | http://a.example.org/c/2'), ('B', 'http://b.example.org/', 'directory:d', 0, 'dead', '', '', '', '', ''), ('', 'http://c.example.org/', 'search:x; search:y', 2, 'wall/manual', '403', '', '', '', '')""")
def candidate_report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.candidate_report(spark.createDataFrame(_SITES, _SITE_SCHEMA))


@_cases("host", "('a.example.org'), ('c.example.org')")
def seeded_order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of three candidates: those that a search found."""
    return discovery.seeded_first(spark.createDataFrame(_SITES, _SITE_SCHEMA), "search_hits", "ord", 2).select("host")


@_cases("url, known", "('http://a.example.org/c/1', true), ('http://old.example.org/', true), ('http://a.example.org/c/2', false), ('http://b.example.org/', false)")
def promotion_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are looked up whatever their writing; one without category addresses gives its own; unknown hosts give nothing."""
    hosts = spark.createDataFrame([("HTTP://A.example.org/",), ("b.example.org",), ("a.example.org",), ("z.example.org",)], "host string")
    old = spark.createDataFrame([("http://a.example.org/c/1",), ("http://old.example.org/",)], "url string")
    return discovery.promoted(hosts, spark.createDataFrame(_SITES, _SITE_SCHEMA), old)


@_cases("place, relevant, name, url, pages_detected, page_urls", "(1, true, 'r2', 'u2', 3, 'u2 | v | w'), (2, true, 'r1', 'u1', 1, 'u1'), (3, true, 'r3', 'u3', 1, ''), (4, false, 'n', 'u0', 9, 'u0')")
def category_report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = spark.createDataFrame([(0, False, "n", "u0", 9, ["u0"]), (1, True, "r1", "u1", 1, ["u1"]), (2, True, "r2", "u2", 3, ["u2", "v", "w"]), (3, True, "r3", "u3", 1, None)], "ord int, relevant boolean, name string, url string, pages_detected int, page_urls array<string>")
    t = discovery.category_report(d).withColumn("_o", F.monotonically_increasing_id())
    return t.select(F.row_number().over(Window.orderBy("_o")).alias("place"), *discovery.CATEGORY_COLUMNS)


@_cases("term, n, urls, category", "('Pill', 7, 'u1; u2', 'c'), ('ring', NULL, '', 'd'), ('x', 0, '', NULL)")
def term_report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.createDataFrame([("Pill", 7, "u2"), ("Pill", 7, "u1"), ("Pill", 7, "u2"), ("ring", None, None), ("x", 0, None)], "term string, count int, url string")
    r = search.term_report(hits, spark.createDataFrame([("c", "PILL"), ("d", "Ring")], "category string, term string"))
    return r.select("term", F.col("count").alias("n"), F.array_join("conversation_urls", "; ").alias("urls"), "category")


@_cases("segment, n, share, label", "('abortion', 20, 0.002726, 'Abortion' || chr(10) || '20 (0.27%)'), ('contraception', 25, 0.003407, 'Contraception' || chr(10) || '25 (0.34%)'), ('other', 7292, 0.993867, 'Other' || chr(10) || '7,292 (99.39%)')")
def share_segment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([(20, 25)], "abortion int, contraception int")
    return discovery.share_segments(relational.share(c, spark.createDataFrame([(7337,)], "n int"), ["abortion", "contraception"]), ["abortion", "contraception"])


@_cases("n, directories, engines, terms", "(0, 'd', 'e', 't'), (1, '', 'old', 'old term'), (2, '', '', ''), (3, '', '', '')")
def discovery_source_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(0, '{"directories": ["d"], "search_engines": ["e"], "ahmia_base": "old", "search_query_terms": ["t"], "ahmia_query_terms": ["old term"]}'), (1, '{"search_engines": [], "ahmia_base": "old", "ahmia_query_terms": ["old term"]}'), (2, "{}"), (3, None)], "n int, config string")
    j: Callable = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ";")
    s = discovery.discovery_sources(F.col("config"))
    return d.select("n", j(s["directories"]).alias("directories"), j(s["engines"]).alias("engines"), j(s["terms"]).alias("terms"))
