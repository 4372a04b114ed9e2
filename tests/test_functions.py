from urllib.parse import urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import urls as U
from marlstone.functions.dom import parse
from marlstone.functions.moments import epoch_second


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i bigint, a {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("a"))).collect())]


def test_page_key_equates_only_visits(spark):
    same = ["HTTP://Ex.Org:80/a/b/?b=2&a=1&utm_source=3#f", "https://ex.org:443/a/b?a=1&b=2", " http://ex.org/a/b/?a=1&b=2&PHPSESSID=77\t", "http://ex.org/a/b?sid=1&b=2&a=1&ref=x"]
    other = ["http://ex.org/a/B?a=1&b=2", "http://ex.org:8080/a/b?a=1&b=2", "http://ex.org/a/b?a=1", "http://ex.org/a/b?a=1&b=2&lang=en", "http://ex.org/a"]
    keys = apply(spark, U.page_key, same + other)
    assert len(set(keys[:4])) == 1 and len(set(keys)) == 6
    assert apply(spark, U.page_key, [None, "", "  \t"]) == [None, None, None]
    assert apply(spark, U.page_key, ["http://ex.org", "http://ex.org/", "//ex.org/#x"]) == ["ex.org"] * 3


def test_moments(spark):
    texts = ["1767225600", " 1767225600.0 ", "1767225600000", "1767225600000000", "2026-01-01T00:00:00Z", "2026-01-01T02:00:00+02:00", "2026-01-01 00:00:00", "Thu, 01 Jan 2026 00:00:00 GMT"]
    assert apply(spark, epoch_second, texts) == [1767225600] * len(texts)
    assert apply(spark, epoch_second, ["never", "", None, "n/a", "12:30", "1e999", "9" * 60]) == [None] * 7


PRODUCT = [("http://h/?product=x", True), ("http://h/?product=", False), ("http://h/?product=x&product_cat=y", False), ("http://h/?add-to-cart=1&product=x", False), ("http://h/?add-to-cart=", False), ("http://h/product/", False), ("http://h/product/s", True), ("http://h/listing", True), ("http://h/item/", False), ("http://h/item/u", True), ("http://h/products.php?action=view", True), ("http://h/products.php?action=view&action=view", False), ("http://h/shop/", False), ("http://h/shop/s", True), ("http://h/a/shop/s", False), (None, False), ("", False)]


def test_product_url_shapes(spark):
    assert apply(spark, U.is_product_url, [u for u, _ in PRODUCT]) == [x for _, x in PRODUCT]


def test_parameters_are_decoded(spark):
    got = apply(spark, U.param_pairs, ["http://h/?a=x%20y&b=1+2&c=&=z&d=%C3%A9&e=50%&f%5B%5D=1", None])
    assert [(x.k, x.v) for x in got[0]] == [("a", "x y"), ("b", "1 2"), ("d", "é"), ("e", "50%"), ("f[]", "1")]
    from urllib.parse import quote

    terms = ["a b/c", "é~*.-_", "x&y=1?", "100%"]
    assert apply(spark, U.encode_term, terms) == [quote(t) for t in terms]


def test_paging(spark):
    got = apply(spark, U.page_template, ["http://h/x?page=2", "http://h/x?a=1&paged=3&z", "http://h/x?p=4", "http://h/page/5/", "http://h/page2", None])
    assert [tuple(g) if g else None for g in got] == [("http://h/x?page={n}", 2), ("http://h/x?a=1&paged={n}&z", 3), ("http://h/x?p={n}", 4), ("http://h/page/{n}/", 5), None, None]


def test_host_agrees_with_the_standard_library(spark):
    urls = ["http://a.b/c", "https://U:p@A.b:8/x?y", "a/b", "//q.r", "http://x.y?z=1", "mailto:x@y", "http://[bad"]
    want = [(urlsplit(u).hostname or "") if "[" not in u else "[bad" for u in urls]
    assert apply(spark, U.host, urls) == want


def test_clean_text(spark):
    assert apply(spark, T.clean_text, [None, " a \n b ", "&amp;lt;", "x&#8211;y&#8217;s &#8220;q&#8221;"]) == ["", "a b", "<", "x-y's \"q\""]
    assert apply(spark, lambda c: T.truncated(c, 3), ["abc", "abcd", "", None]) == ["abc", "abc...", "", None]


def test_term_pattern_is_unicode_safe(spark):
    p = "(?iu)" + T.term_pattern("day-after pill")
    hits = ["the Day  After-PILL.", "day_after pill", "xday after pill", "day after pills", "é day after pill é", "daé after pill"]
    assert apply(spark, lambda c: c.rlike(p), hits) == [True, False, False, False, True, False]
    assert not apply(spark, lambda c: c.rlike("(?iu)" + T.term_pattern("Yaz")), ["Yazé"])[0]
    assert T.term_pattern(" - ") is None


def test_counts_and_prices(spark):
    assert apply(spark, T.result_count, ["Showing the single result", "Showing 1–12 of 30 results", "Showing all 10 results", "found 1,200 results", "7 results", "no results", "hello", None]) == [1, 30, 10, 1200, 7, 0, None, None]
    assert apply(spark, T.price_range, ["$9", "$9 or $10", "$0 $5", "$0", "$0.00 $5", "none", None]) == ["$9", "$10 - $9", "$5", "$0", "$0.00 - $5", None, None]


def test_json_lenient_and_verdict(spark):
    good = '{"relevant": true, "category": " Abortion", "product_type": "x ", "confidence": 0.12349, "reason": "r"}'
    replies = [good, "```json\n" + good + "\n```", "Sure! " + good + " done", "[1]", "no", None, '{"relevant": 1, "category": "zzz", "confidence": "high"}', '{"relevant": "yes"}', '{"relevant": null}']
    got = apply(spark, lambda c: T.verdict(T.json_lenient(c)), replies)
    assert [tuple(g) for g in got[:3]] == [(True, "abortion", "x", 0.123, "r")] * 3
    assert [g.category for g in got[3:6]] == ["", "", ""] and all(g.relevant is None for g in got[3:6])
    assert (got[6].relevant, got[6].category, got[6].confidence) == (True, "none", None)
    assert got[7].relevant is None and got[8].relevant is None


def test_resolved_category(spark):
    df = spark.createDataFrame([("none", "abortion; x"), ("Contraception", ""), (None, "foo, contraception"), ("", None)], "a string, b string")
    assert [r[0] for r in df.select(T.resolved_category(F.col("a"), F.col("b"))).collect()] == ["abortion", "contraception", "contraception", None]


def test_dom_selectors():
    root = parse('<div class="a b" id=x><p>one<br>two</p><p class=c>three<ul><li><a href="/q?x=1">L</a></ul></div><script>no</script><p>last')
    assert [n.text() for n in root.select("div p")] == ["onetwo", "threeL"] and [n.spaced_text() for n in root.select("div p")] == ["one two", "three L"]
    assert [n.holds_one_text() for n in parse("<p><b>x</b></p><p>x<i>y</i></p><p></p>").select("p")] == [True, False, False]
    assert root.first("#x .c a[href*=x]").get("href") == "/q?x=1"
    assert [n.tag for n in root.select("li a, p.c")] == ["p", "a"]
    assert root.text().endswith("last") and "no" not in root.text().split()
    assert parse(None).select("p") == [] and parse("<" * 5000).text() != ""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/abp \"'=!-&;", max_size=80))
def test_dom_never_fails(html):
    parse(html).select("p .b, a[href]")


def plain_select(root, selector):
    """Every element against the selector's last steps, without the index."""
    from marlstone.functions import dom

    groups = dom._compile(selector)
    return [n for n in root.tree.nodes[1:] if any(dom._fits(n, g[-1]) and dom._inside(n, g) for g in groups)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a b'>", "</div>", "<a href=x>", "</a>", "<b class=ab>", "<br>", "<li id=i>", "t", "<p class=a>", "</b>"]), max_size=40))
def test_dom_index_agrees_with_plain_matching(parts):
    root = parse("".join(parts))
    for s in ("p", ".a", "div p", "div.a .b p", "[class*=a]", "[class=a]", "#i a[href]", "p, a", "div b[class]", "*"):
        assert [n.order for n in root.select(s)] == [n.order for n in plain_select(root, s)]
    for n in root.select("div"):
        assert [x.order for x in n.select("p")] == [x.order for x in plain_select(root, "p") if n.order < x.order <= n.last]


@pytest.mark.parametrize("depth", [20000])
def test_dom_deep_pages(depth):
    assert parse("<div>" * depth + "x").text() == "x"
