"""Listing records, links and forum threads out of landed pages.

Each page is parsed once, in an Arrow-batched map, by a profile: for each field an ordered list of selectors and a way to
read what they find. Filters on addresses and on empty pages go before the map, since Catalyst can't move them through it.

What comes from an unordered set elsewhere (dosages, product links) comes in document order here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dom import Node, parse
from ..functions.text import ENTITIES
from ..functions.urls import is_product_url
from .page_flags import looks_blocked

LISTING_FIELDS = ["market_name", "listing_title", "price", "dosage", "rating", "review", "description", "number_in_stocks", "category", "ship_from", "ship_to"]
DESCRIPTION_CUT = 500

# Marks of a site in a page's title, and the site's name.
TITLE_SITES = [("has", " - THE X WAVE MARKET", "THE X WAVE MARKET"), ("starts", "Osiris -", "Osiris"), ("ends", "- Catharsis", "Catharsis"), ("has", " - Catharsis", "Catharsis"), ("ends", "- Black Ops", "Black Ops"), ("has", " - Black Ops", "Black Ops"), ("starts", "Drug Hub - ", "Drug Hub")]
# Parts of a page's title beside which the listing's title stands.
TITLE_BEFORE = ["Drug Hub - ", "Osiris - Product - "]
TITLE_AFTER = [" | Abacus Market"]
SECOND_SITE_NAME = "TorZon Market"
# Selectors by field, in order of preference.
SITE_NAMES = [".site-title", ".site-name", ".brand", ".logo", 'h1[class*="site"]', 'h1[class*="brand"]']
OWN_TITLES = [".product_pg_r_title", "h1.product_title.entry-title", "h1.product-title.product_title.entry-title", "h1.product_title", "h1.product-title", "h1.entry-title.product-title", "h1.entry-title", 'h1[class*="product"][class*="title"]', "center h5"]
OTHER_TITLES = ['h1[class*="product"]', 'h1[class*="title"]', "h1", ".product-title", ".product-name", ".drug-name", "title"]
PRICES = [".price .woocommerce-Price-amount", ".price .amount", ".price", ".product-price", ".drug-price", '[class*="price"]', ".woocommerce-Price-amount"]
DOSAGES = [".dosage", ".strength", ".mg", '[class*="dosage"]', '[class*="strength"]']
RATINGS = [".rating", ".stars", ".review-rating", ".woocommerce-product-rating", '[class*="rating"]', '[class*="star"]']
REVIEWS = [".reviews", ".customer-reviews", ".product-reviews", ".woocommerce-reviews", '[class*="review"]']
SHORT_DESCRIPTION = ".product_pg_r_text"
DESCRIPTIONS = [".product-description", ".product-content", ".woocommerce-product-details__short-description", ".entry-content", ".product-summary", ".description", '[class*="description"]']
STOCKS = [".stock", ".in-stock", '[class*="stock"]', '[class*="quantity"]', ".product-stock", ".stock-status", "p.stock", ".woocommerce-stock"]
STOCK_PATTERNS = [r"(\d[\d,]*)\s+in\s+stock", r"(\d[\d,]*)\s+in-stock", r"(\d[\d,]*)\s+available", r"stock[:\s]+(\d[\d,]*)", r"quantity[:\s]+(\d[\d,]*)", r"available[:\s]+(\d[\d,]*)"]
STOCK_WORDS = ["stock", "available", "quantity"]
SECOND_TITLES = ['center font[style*="font-size"]', "center h1", "h1", "title"]
AFTER_JAMMED_LABEL = ["Price", "Shipping", "Payment", "Close", "All "]
# Selectors of product cards' links; marks of product addresses, and of addresses that are none.
CARDS = ["li.product a.woocommerce-LoopProduct-link", "li.product h2 a", "li.product a[href]", ".products li.product a", "ul.products li a"]
NO_CARD_MARKS = ["/product-category/", "/category/"]
PRODUCT_MARKS = ["/shop/", "/item/", "/listing/", "/p/", "/product/", "products.php?action=view"]
NO_PRODUCT_MARKS = ["cart", "checkout", "account", "login", "/product-category/", "/category/", "/tag/", "page/", "/page-", "author", "search", "filter"]
PAGERS = ['a[rel="next"]', "a.next", "li.next a", ".pagination a", "ul.pagination a", "nav a", 'a[aria-label="Next"]']
# Selectors of product titles on category pages.
CARD_TITLES = ["li.product h2", "li.product h3", ".woocommerce-loop-product__title", "a.woocommerce-LoopProduct-link", "li.product a", ".product-title", "h2 a"]
# Path segments that are no categories.
NO_CATEGORY = [
    "login", "register", "signup", "signin", "sign-in", "signout", "logout", "auth", "profile", "account", "myaccount", "dashboard", "settings", "setting", "seller", "sellers", "buyer", "buyers",
    "cart", "checkout", "basket", "order", "orders", "wishlist", "support", "help", "faq", "about", "about-us", "contact", "terms", "tos", "privacy", "rules", "forum", "forums", "wiki", "hiddenwiki", "thread", "post",
    "message", "messages", "inbox", "chat", "escrow", "dispute", "proof", "proof-reviews", "review", "reviews", "feedback", "freemoney", "free-money", "download", "downloads", "home", "index",
    "vendor", "vendors", "become-a-vendor", "ticket", "tickets", "news", "search", "filter", "tag", "tags", "captcha", "2fa", "pgp",
]
# Parts of addresses that hint at a category.
CATEGORY_HINTS = ["category", "categories", "shop", "products", "product-category", "drugs", "medicine", "medicines", "pharmacy", "listing", "listings", "prescription", "rx", "store"]

_AMOUNT = re.compile(r"\$[\d,]+\.?\d*")
_DOSE = re.compile(r"\d+\s*mg|\d+\s*ml|\d+\s*grams?|\d+\s*g", re.I)
_CELL_DOSE = re.compile(r"\d+\s*m[gl]", re.I)
_RATING = re.compile(r"(\d+\.?\d*)\s*/\s*5|(\d+\.?\d*)\s*stars?", re.I)
_STOCK = [re.compile(p, re.I) for p in STOCK_PATTERNS]
_DETAIL = re.compile(r"/(?:product|item|listing)/|action=view|[0-9a-f-]{36}", re.I)
_UUID_PRODUCT = re.compile(r"/product/[0-9a-f-]{36}", re.I)
_NO_CATEGORY = frozenset(NO_CATEGORY)


def cleaned(text: str | None) -> str:
    """Collapsed text with the common entities resolved in a fixed order, as ``functions.text.clean_text`` does."""
    t = re.sub(r"\s+", " ", (text or "").strip())
    if "&" in t:
        for entity, char in ENTITIES:
            t = t.replace(entity, char)
    return t.strip()


def _clean(n: Node | None) -> str:
    return cleaned(n.raw_text()) if n is not None else ""


def market_text(root: Node) -> str:
    """The site: by a mark in the title, after the title's last dash or bar, by a meta element, by a short heading."""
    t = _clean(root.first("title"))
    for kind, mark, name in TITLE_SITES:
        if t.startswith(mark) if kind == "starts" else t.endswith(mark) if kind == "ends" else mark in t:
            return name
    for mark in ("–", "|"):
        if mark in t and (last := cleaned(t.rsplit(mark, 1)[1])):
            return last
    m = root.first('meta[property="og:site_name"]')
    if m is not None and m.get("content"):
        return cleaned(m.get("content"))
    return next((t for s in SITE_NAMES if (t := _clean(root.first(s))) and len(t) < 50), "")


def title_text(root: Node) -> str:
    """The listing's title: beside a mark in the page's title, of its own element, else of a heading cut at its first dash, bar and word 'Buy'."""
    t = _clean(root.first("title"))
    for mark in TITLE_BEFORE:
        if t.startswith(mark) and (rest := cleaned(t[len(mark) :])):
            return rest
    for mark in TITLE_AFTER:
        if mark in t and (rest := cleaned(t.split(mark)[0])):
            return rest
    for s in OWN_TITLES:
        if own := _clean(root.first(s)):
            return own
    for s in OTHER_TITLES:
        other = _clean(root.first(s))
        if len(other) > 3:
            for cut in (r"\s*-\s*.*$", r"\s*\|.*$", r"(?i)\s*Buy\s*"):
                other = re.sub(cut, "", other)
            return cleaned(other)
    return ""


def _price_range(found: list[str]) -> str:
    """One amount as it is, several as lowest and highest in text order; '$0' only where there is nothing else."""
    some = [a for a in found if a != "$0"] or found[:1]
    return "" if not some else some[0] if len(some) == 1 else f"{min(some)} - {max(some)}"


def price_text(root: Node) -> str:
    """Dollar amounts of the summary's price element, repeated ones too; if it has none, the distinct ones of all price elements."""
    summary = root.first(".summary")
    if summary is not None:
        node = next((n for n in summary.select("[class]") if "price" in n.get("class").lower()), None)
        if found := _AMOUNT.findall(_clean(node)):
            return _price_range(found)
    return _price_range(list(dict.fromkeys(a for s in PRICES for n in root.select(s) for a in _AMOUNT.findall(_clean(n)))))


def dosage_text(root: Node) -> str:
    """Up to three distinct amounts in document order: of table cells with neighbours, of the text, of dosage elements."""
    found = []
    for row in root.select("table tr"):
        cells = row.select("td, th")
        if len(cells) >= 2:
            found += [t for t in map(_clean, cells) if _CELL_DOSE.search(t)]
    found += [cleaned(m) for m in _DOSE.findall(root.raw_text())]
    found += [t for s in DOSAGES for n in root.select(s) if (t := _clean(n))]
    return " | ".join(list(dict.fromkeys(found))[:3])


def rating_text(root: Node) -> str:
    for s in RATINGS:
        if m := _RATING.search(_clean(root.first(s))):
            return m.group(1) or m.group(2)
    return ""


def review_text(root: Node) -> str:
    """The first two texts of more than 20 characters in review elements; what several selectors find counts each time."""
    found: list[str] = []
    for s in REVIEWS:
        for n in root.select(s):
            found += [t for p in n.select("p, div, span") if p.holds_one_text() and len(t := _clean(p)) > 20]
            if len(found) >= 2:
                return " | ".join(found[:2])
    return " | ".join(found)


def _cut(text: str) -> str:
    return text[:DESCRIPTION_CUT] + "..." if len(text) > DESCRIPTION_CUT else text


def description_text(root: Node) -> str:
    t = _clean(root.first(SHORT_DESCRIPTION))
    if len(t) > 10:
        return _cut(t)
    for s in DESCRIPTIONS:
        t = _clean(root.first(s))
        if len(t) > 50:
            return _cut(t)
    m = root.first('meta[name="description"]')
    t = cleaned(m.get("content")) if m is not None else ""
    return t if len(t) > 20 else ""


def stock_text(root: Node) -> str:
    """A count of the page's text, else of a stock element, else of a stock attribute."""

    def stated(text: str) -> str:
        for p in _STOCK:
            m = p.search(text)
            if m and (n := m.group(1).replace(",", "")).isdigit():
                return n
        return ""

    if n := stated(root.raw_text()):
        return n
    for s in STOCKS:
        for node in root.select(s):
            t = _clean(node)
            if n := stated(t):
                return n
            if any(w in t.lower() for w in STOCK_WORDS) and (m := re.search(r"\d[\d,]*", t)):
                return m.group(0).replace(",", "")
    for attr in ("data-stock", "data-quantity"):
        for node in root.select(f"[{attr}]"):
            if node.get(attr).isdigit():
                return node.get(attr)
    return ""


def _spaced(n: Node) -> str:
    return re.sub(r"\s+", " ", n.spaced_text()).strip()


def table_value(root: Node, label: str) -> str:
    """The shortest text beside a cell whose text is, or starts with, the label; or behind the label in a cell that holds both."""
    low = label.lower()
    found = []
    for row in root.select("tr"):
        texts = [_spaced(c) for c in row.select("td, th")]
        for n, t in enumerate(texts):
            if t.lower() == low or t.lower().startswith(low + " "):
                found += [x for x in texts[n + 1 : n + 2] if x]
            elif t.lower().startswith(low) and len(t) <= len(label) + 30:
                rest = t[len(label) :].strip(" :")
                stop = next((w for w in AFTER_JAMMED_LABEL if w in rest), None)
                rest = rest.split(stop, 1)[0] if stop else rest
                found += [rest] if rest else []
    return min(found, key=len) if found else ""


def shipping(root: Node) -> tuple[str, str]:
    """(from, to) of the cell beside one that says 'shipping' and nothing else, else of any shipping value."""
    parts = lambda raw: [p for x in raw.split("->") if (p := x.strip(" -"))]
    for row in root.select("tr"):
        texts = [_spaced(c) for c in row.select("td, th")]
        for a, b in zip(texts, texts[1:]):
            if a.lower() == "shipping" and (p := parts(b)):
                return p[0], p[1] if len(p) > 1 else ""
    raw = table_value(root, "shipping")
    p = parts(raw)
    return (p[0] if p else raw), (p[1] if len(p) > 1 else "")


def _second_rating(root: Node) -> str:
    if m := re.search(r"\d+\.?\d*", table_value(root, "Product Rating")):
        return m.group(0)
    for n in root.select("center"):
        if m := re.search(r"\((\d+\.?\d*)\s*★", n.text()):
            return m.group(1)
    return ""


def _second_title(root: Node) -> str:
    return next((t for s in SECOND_TITLES for n in root.select(s) if len(t := n.text()) > 5), "")


def _second_price(root: Node) -> str:
    m = re.search(r"USD\s*([\d.,]+)", root.spaced_text(), re.I)
    return f"USD {m.group(1)}" if m else ""


Profile = dict[str, Callable[[Node], str]]
# How a site's pages are read: a reader for each field; fields without one are ''.
GENERAL: Profile = {"market_name": market_text, "listing_title": title_text, "price": price_text, "dosage": dosage_text, "rating": rating_text, "review": review_text, "description": description_text, "number_in_stocks": stock_text}
SECOND: Profile = {
    "market_name": lambda root: SECOND_SITE_NAME, "listing_title": _second_title, "price": _second_price, "rating": _second_rating, "description": lambda root: n.text() if (n := root.first("#description")) else "",
    "category": lambda root: table_value(root, "Category"), "ship_from": lambda root: shipping(root)[0], "ship_to": lambda root: shipping(root)[1],
}


def read_listing(html: str | None, profile: Profile = GENERAL) -> dict[str, str]:
    """The fields of one page, '' for what it lacks."""
    root = parse(html)
    return {f: profile[f](root) if f in profile else "" for f in LISTING_FIELDS}


def parse_listings(pages: DataFrame, id_col: str = "row_id", profile: Profile = GENERAL, only_products: bool = True) -> DataFrame:
    """(id, product_url, category_page, fields…, parse_error): one row for each page.

    With ``only_products`` pages without html and pages whose address isn't a product's are left out; without, all pages come.
    """
    p = pages.filter((F.coalesce(F.col("html"), F.lit("")) != "") & is_product_url(F.col("product_url"))) if only_products else pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for html in b["html"]:
                try:
                    rows.append(read_listing(html, profile) | {"parse_error": None})
                except (ValueError, RecursionError) as e:  # a page that can't be read is kept and marked
                    rows.append({f: "" for f in LISTING_FIELDS} | {"parse_error": type(e).__name__})
            yield pd.concat([b[[id_col, "product_url", "category_page"]].reset_index(drop=True), pd.DataFrame(rows, columns=[*LISTING_FIELDS, "parse_error"])], axis=1)

    schema = f"{id_col} bigint, product_url string, category_page string, " + ", ".join(f"{f} string" for f in [*LISTING_FIELDS, "parse_error"])
    return p.select(id_col, "product_url", "category_page", "html").mapInPandas(run, schema)


# ---- links ------------------------------------------------------------------------------------------------------


def _joined(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href or "") or None
    except ValueError:
        return None


def _host(url: str) -> str | None:
    try:
        return urlsplit(url).netloc
    except ValueError:
        return None


def _addresses(nodes: list[Node], base: str) -> list[str]:
    return [u for n in nodes if n.get("href") and (u := _joined(base, n.get("href")))]


def _links(root: Node, base: str) -> list[tuple[str, Node]]:
    """(absolute address, anchor) of a page's anchors with an address."""
    return [(u, a) for a in root.select("a[href]") if (u := _joined(base, a.get("href")))]


def page_links(html: str | None, base: str) -> list[tuple[str, str]]:
    """(absolute address without fragment, text) of a page's anchors, distinct, in document order."""
    out: dict[str, str] = {}
    for u, a in _links(parse(html), base):
        if key := u.split("#")[0]:
            out.setdefault(key, a.text())
    return list(out.items())


def product_links(html: str | None, base: str) -> list[str]:
    """Product addresses of a category page, distinct: of all product cards, else of all anchors that look like one.

    Cards come selector by selector. An address looks like a product's by its product number, its view or its marks; the page itself never counts as such.
    """
    root = parse(html)
    cards = [u for s in CARDS for u in _addresses(root.select(s), base) if not any(m in u for m in NO_CARD_MARKS) and u.rstrip("/") != base.rstrip("/")]
    if cards:
        return list(dict.fromkeys(cards))

    def good(u: str) -> bool:
        low = u.lower()
        if "/product/" in low and _UUID_PRODUCT.search(urlsplit(u).path) or "products.php" in low and "action=view" in low:
            return True
        return any(m in low for m in PRODUCT_MARKS) and not any(m in low for m in NO_PRODUCT_MARKS) and u.rstrip("/") != base.rstrip("/")

    return list(dict.fromkeys(u for u, _ in _links(root, base) if _host(u) is not None and good(u)))


def pager_links(html: str | None, base: str) -> list[str]:
    """Addresses of the first pager selector that finds any, repeated ones too."""
    root = parse(html)
    return next((urls for s in PAGERS if (urls := _addresses(root.select(s), base))), [])


def page_urls(html: str | None, base: str) -> list[str]:
    """The page's own address and those of all pager selectors on its host, distinct and sorted."""
    root = parse(html)
    return sorted({base} | {u for s in PAGERS for u in _addresses(root.select(s), base) if _host(u) == _host(base)})


def sample_titles(html: str | None, most: int = 5) -> list[str]:
    """The first distinct product titles of a category page, of 4 to 119 characters; a report of ``most``."""
    root = parse(html)
    return list(dict.fromkeys(t for s in CARD_TITLES for n in root.select(s) if 3 < len(t := n.text()) < 120))[:most]


def forum_links(html: str | None, base: str) -> list[str]:
    """Addresses of a forum page's posts, without fragment, distinct, in document order."""
    return list(dict.fromkeys(k for u in _addresses(parse(html).select("div.post-title a[href]"), base) if (k := u.split("#")[0])))


def hinted_links(html: str | None, base: str, most: int) -> list[str]:
    """The first ``most`` distinct addresses on the page's host that hint at a category, in document order."""
    found = dict.fromkeys(u for u, _ in _links(parse(html), base) if _host(u) == _host(base) and any(h in u.lower() for h in CATEGORY_HINTS))
    return list(found)[:most]


def category_links(html: str | None, base: str) -> list[tuple[str, str]]:
    """(address without fragment, text) of the links of a site's home that can be categories, distinct.

    On the same host, below the root, no product's detail, no segment that names something else; at most two segments deep
    unless the address hints at a category.
    """
    out: dict[str, str] = {}
    for u, a in _links(parse(html), base):
        if _host(u) != _host(base):
            continue
        path = urlsplit(u).path.strip("/")
        segs = path.split("/")
        if not path or _DETAIL.search(u) or any(s.lower() in _NO_CATEGORY for s in segs):
            continue
        if len(segs) <= 2 or any(h in u.lower() for h in CATEGORY_HINTS):
            out.setdefault(u.split("#")[0], a.text())
    return list(out.items())


def hosts_in(html: str | None, pattern: str) -> dict[str, str]:
    """Hosts that fit a pattern: of anchors with their text first, then of any mention, with an empty name; the first wins."""
    rx = re.compile(pattern, re.I)
    out: dict[str, str] = {}
    for a in parse(html).select("a[href]"):
        for h in rx.findall(a.get("href")):
            out.setdefault(h.lower(), a.text())
    for h in rx.findall(html or ""):
        out.setdefault(h.lower(), "")
    return out


def _column(fn: Callable, kind: str) -> Callable[..., Column]:
    def of(*cols: Column) -> Column:
        @F.pandas_udf(kind)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([fn(x, y or "") for x, y in zip(a, b)])

        return run(*cols)

    return of


_pair = lambda pairs: [{"href": a, "text": t} for a, t in pairs]
product_links_column = _column(product_links, "array<string>")
pager_links_column = _column(pager_links, "array<string>")
page_urls_column = _column(page_urls, "array<string>")
forum_links_column = _column(forum_links, "array<string>")
sample_titles_column = _column(lambda h, _: sample_titles(h), "array<string>")
links_column = _column(lambda h, u: _pair(page_links(h, u)), "array<struct<href:string,text:string>>")
category_links_column = _column(lambda h, u: _pair(category_links(h, u)), "array<struct<href:string,text:string>>")
resolved_url = _column(lambda base, href: _joined(base, href), "string")


def hinted_links_column(most: int) -> Callable[..., Column]:
    return _column(lambda h, u: hinted_links(h, u, most), "array<string>")


def hosts_column(pattern: str) -> Callable[..., Column]:
    return _column(lambda h, _: [{"host": k, "name": v} for k, v in hosts_in(h, pattern).items()], "array<struct<host:string,name:string>>")


def empty_pages(pages: DataFrame, id_col: str = "row_id", base: str = "category_page") -> DataFrame:
    """(id, html, looks_blocked): pages with html but without product links, set aside to see why."""
    p = pages.filter(F.coalesce(F.col("html"), F.lit("")) != "").select(id_col, "html", product_links_column(F.col("html"), F.col(base)).alias("_l"))
    return p.filter(F.size("_l") == 0).select(id_col, "html", looks_blocked(F.col("html")).alias("looks_blocked"))
