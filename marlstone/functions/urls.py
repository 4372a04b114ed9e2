"""URL functions as Spark columns; lenient, since landed addresses are often malformed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that tell the visit or its origin, not the page.
VISIT_PARAMS = ["phpsessid", "jsessionid", "aspsessionid", "sid", "sessionid", "session_id", "ref", "referrer", "referer", "gclid", "fbclid", "msclkid", "yclid", "mc_cid", "mc_eid", "_ga"]
VISIT_PREFIX = "utm_"

# RFC 3986, appendix B, with the scheme optional.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_EDGE = r"^[\s ​﻿]+|[\s ​﻿]+$"


def trimmed(url: Column) -> Column:
    return F.regexp_replace(url, _EDGE, "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(trimmed(url), _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(trimmed(url), _PARTS, 2)


def host(url: Column) -> Column:
    """Lower-case host without user part and port."""
    a = F.lower(F.regexp_replace(authority(url), r"^.*@", ""))
    return F.regexp_replace(a, r":\d*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(trimmed(url), _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(trimmed(url), _PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(trimmed(url), _PARTS, 5)


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def param_pairs(url: Column) -> Column:
    """Array of struct(k, v), percent-decoded with '+' as a blank; parameters without a value do not count; what can't be decoded stays as it is."""
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    kv = F.transform(F.split(query(url), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    return F.transform(F.filter(kv, lambda x: (x.k != "") & (x.v != "")), lambda x: F.struct(plain(x.k).alias("k"), plain(x.v).alias("v")))


def param_values(url: Column, name: str) -> Column:
    return F.transform(F.filter(param_pairs(url), lambda x: x.k == name), lambda x: x.v)


def canonical_path(url: Column) -> Column:
    """Path with one leading slash and none at the end; '/' for the root."""
    return F.concat(F.lit("/"), F.regexp_replace(path(url), r"^/+|/+$", ""))


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def page_key(url: Column) -> Column:
    """One text for all addresses of the same page, null for a null or blank address.

    Dropped: scheme, case of the host, the scheme's standard port, outer white space, closing slashes, fragment,
    order of parameters, and parameters that tell the visit.
    """
    t = trimmed(url)
    s = scheme(url)
    a = F.lower(authority(url))
    port = F.regexp_extract(a, r":(\d*)$", 1)
    std = (port == "") | ((port == "80") & ((s == "http") | (s == ""))) | ((port == "443") & ((s == "https") | (s == "")))
    a = F.when(std, F.regexp_replace(a, r":\d*$", "")).otherwise(a)
    kept = F.filter(
        F.split(query(url), "&"),
        lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(VISIT_PARAMS) & ~F.startswith(F.lower(p), F.lit(VISIT_PREFIX)),
    )
    key = F.concat_ws("?", F.concat(a, F.regexp_replace(path(url), r"/+$", "")), F.when(F.size(kept) > 0, F.array_join(F.array_sort(kept), "&")))
    return F.when(t != "", key)


def page_template(url: Column) -> Column:
    """struct(template, n) of the first paging mark in the order page=, paged=, p=, /page/; null without one."""
    def one(pattern: str) -> Column:
        n = F.regexp_extract(url, pattern, 2)
        return F.when(n != "", F.struct(F.regexp_replace(url, pattern + "(.*)$", "$1{n}$3").alias("template"), n.cast("bigint").alias("n")))
    head = r"^(.*?{mark})(\d+)"
    return F.coalesce(*[one(head.replace("{mark}", m)) for m in (r"[?&]page=", r"[?&]paged=", r"[?&]p=", r"/page/")])


def fill_page(template: Column, n: Column) -> Column:
    return F.replace(template, F.lit("{n}"), n.cast("string"))


def encode_term(term: Column) -> Column:
    """Percent-encoding with %20 for blanks; '/' and '~' are kept."""
    t = F.url_encode(term)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def is_product_url(url: Column) -> Column:
    """Whether an address has the shape of a product page; blank query values do not count; null gives false."""
    def has(name: str) -> Column:
        return F.size(param_values(url, name)) > 0
    seg = segments(url)
    n = F.size(seg)
    def followed(word: str) -> Column:
        at = F.array_position(seg, word)
        return (at > 0) & (at < n)
    p = path(url)
    rule = (
        F.when(has("add-to-cart"), False)
        .when(has("product") & ~has("product_cat"), True)
        .when(followed("product"), True)
        .when(F.array_contains(seg, "listing"), True)
        .when(followed("item"), True)
        .when(F.endswith(p, F.lit("products.php")) & (param_values(url, "action") == F.array(F.lit("view"))), True)
        .when((n > 1) & (F.get(seg, F.lit(0)) == "shop"), True)
        .otherwise(False)
    )
    return F.when(F.coalesce(url, F.lit("")) == "", False).otherwise(rule)
