"""The nested record of a product page, product cards of a category page, and a page's main text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dom import Node, parse
from .extraction import _addresses, _column, _host, _joined

# Selectors by field, in order of preference.
TITLES = ["h1.product_title", "h1.entry-title", "h2.woocommerce-loop-product__title", '[class*="product"][class*="title"]', 'h1[itemprop="name"]', ".product-title", "h1"]
PRICES = [".summary .price", ".product .price", "p.price", "span.price", '[class*="price"]', '[itemprop="price"]']
STOCKS = [".stock", "p.stock", ".availability", '[class*="stock"]', ".in-stock", ".out-of-stock"]
STOCK_PATTERNS = [(r"(\d+)\s*in\s*stock", "in_stock_count"), (r"(\d+)\s*available", "in_stock_count"), (r"(\d+)\s*left", "in_stock_count"), (r"stock:\s*(\d+)", "in_stock_count"), (r"(in\s*stock)", "stock_status"), (r"(out\s*of\s*stock)", "stock_status"), (r"(available)", "stock_status"), (r"(unavailable)", "stock_status")]
DESCRIPTIONS = [".woocommerce-Tabs-panel--description", ".product-description", '[id*="description"]', ".entry-content", ".product-detail", ".description", '[itemprop="description"]']
CATEGORIES = [".posted_in a", ".product_cat a", '[class*="category"] a', ".breadcrumb a", '[rel="tag"]']
NO_CATEGORY_NAMES = ["home", "shop"]
SKUS = [".sku", '[class*="sku"]', '[itemprop="sku"]']
RATING = '.star-rating, [class*="rating"]'
REVIEW_COUNT = '.woocommerce-review-link, [class*="review"][class*="count"]'
REVIEWS = '.comment, .review, [class*="review-"]'
REVIEW_TEXT = '.comment-text, .review-text, [class*="description"]'
REVIEW_AUTHOR = '.comment-author, .reviewer, [class*="author"]'
VARIATIONS = '.variations, [class*="variation"][class*="table"], table.woocommerce-variation'
PRICE_TABLES = '.woocommerce-table, table[class*="price"]'
IMAGES = [".woocommerce-product-gallery__image img", ".product-image img", '[class*="product"][class*="gallery"] img', ".wp-post-image"]
IMAGE_ATTRIBUTES = ["src", "data-src", "data-lazy-src"]
CARDS = ["li.product", ".product-item", '[class*="product"][class*="item"]', ".woocommerce-product", "article.product", ".listing-item"]
CARD_TITLES = ["h2.woocommerce-loop-product__title", ".product-title", "h2", "h3", '[class*="title"]']
CARD_PRICES = [".price", '[class*="price"]', ".product-price", ".cost"]
LIST_PAGERS = ["div.pagination a", "ul.pagination a", 'a[rel="next"]', "a.next", "li.next a", "nav a", 'a[aria-label="Next"]']
REVIEWS_KEPT = 10  # the record's own limit

_AMOUNT = re.compile(r"[\$€£¥]?\s*(\d+[.,]?\d*)")
_WIDTH = re.compile(r"width:\s*(\d+)%")
_PAGE_HREF = re.compile(r"/page/|\?page=|page=\d+")
DETAIL_TYPE = (
    "title:string,price:string,price_numeric:string,stock_raw:string,in_stock_count:string,stock_status:string,description:string,desc_kv:map<string,string>,categories:array<string>,primary_category:string,sku:string,"
    "rating_percent:string,rating_stars:double,review_count:int,reviews:array<struct<text:string,author:string,rating:double>>,variations:array<struct<option:string,value:string>>,price_tiers:array<struct<quantity:string,price:string>>,images:array<string>,main_image:string"
)
DETAIL_FIELDS = ["title", "price", "price_numeric", "stock_raw", "in_stock_count", "stock_status", "description", "desc_kv", "categories", "primary_category", "sku", "rating_percent", "rating_stars", "review_count", "reviews", "variations", "price_tiers", "images", "main_image"]


def single_line(text: str) -> str:
    """Line breaks as blanks, runs of white space as one blank, trimmed; as ``functions.text.single_line`` does."""
    return re.sub(r"\s{2,}", " ", re.sub(r"[\r\n]", " ", text)).strip()


def _line(n: Node | None) -> str | None:
    return single_line(n.raw_text()) if n is not None else None


def _stars(n: Node | None) -> float | None:
    m = _WIDTH.search(n.get("style")) if n is not None else None
    return float(m.group(1)) / 20 if m else None


def _review(n: Node) -> dict:
    return {"text": _line(n.first(REVIEW_TEXT)), "author": _line(n.first(REVIEW_AUTHOR)), "rating": _stars(n.first(".star-rating"))}


def read_detail(html: str | None) -> dict:
    """The nested record of a product page; null for what it lacks. Keys of the description's 'key: value' lines are a map."""
    root = parse(html)
    out: dict = dict.fromkeys(DETAIL_FIELDS)
    out["title"] = _line(root.first(*TITLES))
    price = _line(root.first(*PRICES))
    if price is not None and (m := _AMOUNT.search(price)):
        out["price"], out["price_numeric"] = price, m.group(1).replace(",", "")
    out["stock_raw"] = _line(root.first(*STOCKS))
    hit = next(((m, k) for p, k in STOCK_PATTERNS if (m := re.search(p, out["stock_raw"] or "", re.I))), None)
    if hit:
        out[hit[1]] = hit[0].group(1)
    desc = root.first(*DESCRIPTIONS)
    if desc is not None:
        text = desc.spaced_text("\n")
        out["description"] = single_line(text)
        pairs = [x.strip().split(":", 1) for x in text.split("\n") if ":" in x]
        out["desc_kv"] = {k.strip().lower().replace(" ", "_"): v.strip() for k, v in pairs} or None
    names = [t for s in CATEGORIES for n in root.select(s) if (t := _line(n)) and t.lower() not in NO_CATEGORY_NAMES]
    if names:
        out["categories"], out["primary_category"] = list(dict.fromkeys(names)), names[-1]
    out["sku"] = _line(root.first(*SKUS))
    rating = root.first(RATING)
    if rating is not None:
        if m := _WIDTH.search(rating.get("style")):
            out["rating_percent"], out["rating_stars"] = m.group(1), float(m.group(1)) / 20
        if m := re.search(r"(\d+\.?\d*)\s*out\s*of\s*5", rating.raw_text()):
            out["rating_stars"] = float(m.group(1))
    count = root.first(REVIEW_COUNT)
    if count is not None and (m := re.search(r"\d+", count.raw_text())):
        out["review_count"] = int(m.group(0))
    out["reviews"] = [r for r in map(_review, root.select(REVIEWS)[:REVIEWS_KEPT]) if any(v is not None for v in r.values())] or None
    table = root.first(VARIATIONS)
    rows = [r.select("td, th") for r in table.select("tr")] if table is not None else []
    out["variations"] = [{"option": _line(c[0]), "value": _line(c[1])} for c in rows if len(c) >= 2] or None
    tiers = []
    for cells in (r.select("td") for t in root.select(PRICE_TABLES) for r in t.select("tr")):
        if len(cells) >= 2 and (q := re.search(r"\d+", _line(cells[0]))) and (p := _AMOUNT.search(_line(cells[1]))):
            tiers.append({"quantity": q.group(0), "price": p.group(1)})
    out["price_tiers"] = tiers or None
    sources = [next((n.get(a) for a in IMAGE_ATTRIBUTES if n.get(a)), "") for s in IMAGES for n in root.select(s)]
    images = [u for u in sources if u and "placeholder" not in u]
    if images:
        out["images"], out["main_image"] = list(dict.fromkeys(images)), images[0]
    return out


def details(pages: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, fields of the nested record): one row for each page that has html."""

    @F.pandas_udf(f"struct<{DETAIL_TYPE}>")
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_detail(h) for h in html], columns=DETAIL_FIELDS)

    return pages.filter(F.coalesce(F.col("html"), F.lit("")) != "").select(id_col, run("html").alias("_d")).select(id_col, "_d.*")


def cards(html: str | None, base: str) -> list[dict]:
    """Products of a category page: the cards of the first selector that finds any, of which those with a title and an address count."""
    root = parse(html)
    found = next((ns for s in CARDS if (ns := root.select(s))), [])
    out = []
    for n in found:
        title, link, price = n.first(*CARD_TITLES), n.first("a[href]"), n.first(*CARD_PRICES)
        if title is None or link is None or (u := _joined(base, link.get("href"))) is None:
            continue
        out.append({"listing_url": u, "title": title.spaced_text(""), "price": price.spaced_text("") if price is not None else "N/A"})
    return out


def legacy_products(html: str | None, base: str) -> list[dict]:
    """(market, category_page, listing_url, title, price) of a page's cards; of a page without cards, the product it shows."""
    found = cards(html, base)
    if not found and not any(parse(html).select(s) for s in CARDS):
        d = read_detail(html)
        found = [{"listing_url": base, "title": d["title"], "price": d["price"]}] if d["title"] else []
    return [{"market": _host(base), "category_page": base, **c} for c in found]


def next_pages(html: str | None, base: str) -> list[str]:
    """Addresses of the first pager selector that finds any, else of anchors whose address looks like a page's; distinct, in document order."""
    root = parse(html)
    urls = next((u for s in LIST_PAGERS if (u := _addresses(root.select(s), base))), None)
    if urls is None:
        urls = _addresses([a for a in root.select("a[href]") if _PAGE_HREF.search(a.get("href"))], base)
    return list(dict.fromkeys(urls))


def content_text(html: str | None) -> str:
    """The text of a page's main container, '' without one."""
    root = parse(html)
    n = root.first("div.product-detail", "div#content", "div.content", "main")
    return single_line(n.raw_text_lines()) if n is not None else ""


def post_text(html: str | None) -> str:
    """The text of a post, '' without one."""
    n = parse(html).first("div.postContent")
    return single_line(n.raw_text_lines()) if n is not None else ""


legacy_products_column = _column(legacy_products, "array<struct<market:string,category_page:string,listing_url:string,title:string,price:string>>")
next_pages_column = _column(next_pages, "array<string>")
content_text_column = _column(lambda h, _: content_text(h), "string")
post_text_column = _column(lambda h, _: post_text(h), "string")
