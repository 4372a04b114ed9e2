"""Keyword search over sites: the registry of their search pages, result counts, and the report of a forum's terms."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dom import parse
from ..functions.urls import encode_term

# Search addresses, with {base}, {term} and, for pages beyond the first, {n}: (first page, later pages).
SEARCH_TEMPLATES = {
    "search_terms": ("{base}/?search_terms={term}&search=simple", "{base}/?search_terms={term}&search=simple&page={n}"),
    "product_search": ("{base}/?s={term}&post_type=product", "{base}/page/{n}/?s={term}&post_type=product"),
    "plain_search": ("{base}/?s={term}", "{base}/page/{n}/?s={term}"),
    "title_search": ("{base}/search?title={term}&source=&destination", "{base}/search?title={term}&source=&destination&page={n}"),
    "q_search": ("{base}/search?q={term}", "{base}/search?q={term}&page={n}"),
    "query_search": ("{base}/search?query={term}", "{base}/search?query={term}&page={n}"),
    "results_search": ("{base}/results?q={term}", "{base}/results?q={term}&page={n}"),
    "items_search": ("{base}/items.php?q={term}", "{base}/items.php?q={term}&page={n}"),
    "forum_search": ("{base}/search/?q={term}&sub=DNMSourcing", "{base}/search/?q={term}&sub=DNMSourcing&page={n}"),
    "advanced_search": (
        "{base}/search?adv=on&s_terms={term}&s_sellername=&s_order=0&s_tocountryid=0&s_countryid=0&s_category=All&s_lphysical=0&s_minprice=0.00&s_maxprice=99999.99&s_crypto=0&s_fulfill=2&s_multisig=0&s_bulk=2&s_stock=1&s_payment=0",
        "{base}/search?adv=on&s_terms={term}&s_sellername=&s_order=0&s_tocountryid=0&s_countryid=0&s_category=All&s_lphysical=0&s_minprice=0.00&s_maxprice=99999.99&s_crypto=0&s_fulfill=2&s_multisig=0&s_bulk=2&s_stock=1&s_payment=0&page={n}",
    ),
}


def search_url(template: str, base: Column, term: Column, page: Column) -> Column:
    """The address of a page of a term's results on a site."""
    first, later = SEARCH_TEMPLATES[template]
    t = F.when(page > 1, F.lit(later)).otherwise(F.lit(first))
    return F.replace(F.replace(F.replace(t, F.lit("{base}"), base), F.lit("{n}"), page.cast("string")), F.lit("{term}"), encode_term(term))


def _number(text: str) -> int | None:
    digits = text.replace(",", "")
    return int(digits) if digits.isdigit() else None


def count_in_heading(html: str | None) -> int | None:
    """The number in a heading that speaks of listings."""
    for h in parse(html).select("h1.h2.m-0.mb-1"):
        strong = h.first("strong")
        if "listing" in h.raw_text().lower() and strong is not None and (n := _number(strong.raw_text().strip())) is not None:
            return n
    return None


def count_fetched(html: str | None) -> int | None:
    """'fetched N results', 0 if the page says that it couldn't find any."""
    low = (html or "").lower()
    if "find any results for that query" in low:
        return 0
    m = re.search(r"fetched\s+([\d,]+)\s+results", low)
    return _number(m.group(1)) if m else None


def count_found(html: str | None) -> int | None:
    """'found N results' in the page's text."""
    m = re.search(r"found\s+([\d,]+)\s+results", " ".join(" ".join(parse(html).strings()).split()), re.I)
    return _number(m.group(1)) if m else None


def count_of_shop(html: str | None) -> int | None:
    """A shop's count line: single result, 'of N', 'all N', 'N results'."""
    n = parse(html).first("p.woocommerce-result-count")
    if n is None:
        return None
    low = n.text().lower()
    if "single result" in low:
        return 1
    tried = (re.search(p, low) for p in (r"of\s+([\d,]+)\s+results?", r"all\s+([\d,]+)\s+results?", r"([\d,]+)\s+results?"))
    m = next(filter(None, tried), None)
    return _number(m.group(1)) if m else None


def count_of_forum(html: str | None) -> int | None:
    """A forum's count block: 'N results', 0 if it says there are none."""
    n = parse(html).first("div.searchamount")
    if n is None:
        return None
    low = " ".join(" ".join(n.strings()).split()).lower()
    if m := re.search(r"([\d,]+)\s+results?", low):
        return _number(m.group(1))
    return 0 if "no result" in low else None


COUNTS: dict[str, Callable[[str | None], int | None]] = {"heading": count_in_heading, "fetched": count_fetched, "found": count_found, "shop": count_of_shop, "forum": count_of_forum}


def result_count(rule: Column, html: Column) -> Column:
    """The number of results that a page states under the rule of its site: null if unknown, which isn't 0; null for a site without a rule."""

    @F.pandas_udf("bigint")
    def run(rules: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([COUNTS[r](h) if r in COUNTS and h else None for r, h in zip(rules, pages)], dtype="Int64")

    return run(rule, html)


class Site(NamedTuple):
    """A row of the registry: how a site's search works."""

    key: str
    name: str
    base: str
    template: str  # of SEARCH_TEMPLATES
    count_rule: str | None = None  # of COUNTS; None: the site states no count
    marker: str | None = None  # a text of every valid results page of a site without a count
    kind: str = "market"  # market or forum


# The registry's sites with addresses of examples; a deployment passes its own rows.
EXAMPLE_SITES = [
    Site("heading", "Heading Market", "http://heading.example.org", "search_terms", "heading"), Site("shop", "Shop Market", "http://shop.example.org", "product_search", "shop"), Site("plain", "Plain Store", "http://plain.example.org", "plain_search", None, "woocommerce"),
    Site("title", "Title Market", "http://title.example.org", "title_search"), Site("query", "Query Market", "http://query.example.org", "query_search", "fetched"), Site("q", "Q Market", "http://q.example.org", "q_search"),
    Site("results", "Results Market", "http://results.example.org", "results_search"), Site("items", "Items Market", "http://items.example.org", "items_search"), Site("advanced", "Advanced Market", "http://advanced.example.org", "advanced_search", "found"),
    Site("forum", "Example Forum", "http://forum.example.org", "forum_search", "forum", None, "forum"),
]
SITE_SCHEMA = "key string, name string, base string, template string, count_rule string, marker string, kind string"


def registry(spark: SparkSession, sites: Sequence[Site] = tuple(EXAMPLE_SITES)) -> DataFrame:
    return spark.createDataFrame([tuple(s) for s in sites], SITE_SCHEMA)


def selected(sites: DataFrame, selection: str, kind: str = "market") -> DataFrame:
    """The sites of a kind that a selection names: all, or keys with commas between; an unknown key is an error."""
    mine = sites.filter(F.col("kind") == kind)
    if selection == "all":
        return mine
    keys = [x.strip() for x in selection.split(",") if x.strip()]
    known = {r.key for r in mine.filter(F.col("key").isin(keys)).select("key").collect()}  # as many as were named
    if missing := [k for k in keys if k not in known]:
        raise ValueError(f"unknown {kind}s: {', '.join(missing)}")
    return mine.filter(F.col("key").isin(keys))


def search_pages(sites: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term, page, url) of each site and search: ``terms`` has key, term and page."""
    t = terms.join(sites.select("key", "base", "template"), "key")
    url = F.coalesce(*[F.when(F.col("template") == k, search_url(k, F.col("base"), F.col("term"), F.col("page"))) for k in SEARCH_TEMPLATES])
    return t.select("key", "term", "page", url.alias("url"))


def term_report(hits: DataFrame, categories: DataFrame) -> DataFrame:
    """(term, count, conversation_urls, category): a forum's terms with their conversations, sorted.

    ``hits`` has term, count (null if unknown) and url, null where a term has none; ``categories`` has term and category, joined
    whatever the case. Of several counts of a term the greatest stays.
    """
    g = hits.groupBy("term").agg(F.max("count").cast("bigint").alias("count"), F.array_sort(F.collect_set("url")).alias("conversation_urls"))
    c = categories.groupBy(F.lower("term").alias("_k")).agg(F.min("category").alias("category"))
    return g.join(c, F.lower(g["term"]) == c["_k"], "left").select("term", "count", "conversation_urls", "category")


def report_totals(report: DataFrame, forums: str) -> DataFrame:
    """One row (forums, terms_searched, terms_with_results) of a term report."""
    return report.agg(F.lit(forums).alias("forums"), F.count(F.lit(1)).alias("terms_searched"), F.count_if(F.coalesce(F.col("count"), F.lit(0)) > 0).alias("terms_with_results"))
