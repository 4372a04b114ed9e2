import random
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import page_labeller as M
from marlstone.llm import residue as R
from marlstone.llm import train_pages as TP
from marlstone.llm.pages import hidden_notes, leaves


class Reference(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("title", "script", "style", "noscript")

    def handle_endtag(self, tag):
        self.off -= tag in ("title", "script", "style", "noscript") and self.off > 0

    def handle_data(self, data):
        if not self.off and data.strip():
            self.out.append(data)


@pytest.fixture(scope="module")
def some(sf):
    import pyarrow.dataset as ds

    return [h for h in ds.dataset(f"{sf}/products_html.parquet").to_table(columns=["html"]).to_pydict()["html"] if h and h.strip()]


def test_leaves_equal_the_standard_parser(some):
    for h in some:
        p = Reference()
        p.feed(h)
        p.close()
        assert leaves(h)[0] == p.out


def test_leaf_rules():
    t, p = leaves("<title>no</title><p class='x y'>a &amp; b<br>c<!-- d -->e<p>f</p><script>g</script><NOSCRIPT>h</NOSCRIPT> <td>5 < 6</td>")
    assert t == ["a & b", "c", "e", "f", "5 < 6"] and p[0] == ("p.x.y",) and p[3] == ("p",)
    assert leaves(None) == leaves("") == leaves(" <p> </p>&nbsp;") == ([], [])
    assert hidden_notes("<p>x<noscript>turn <b>on</b></noscript>") == "turn  on" and hidden_notes(None) == ""
    assert leaves("<div>" * 30000 + "x")[0] == ["x"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abp \"'=!-&;", max_size=60))
def test_leaves_never_fail(html):
    leaves(html)


def test_gradients():
    """The hand-made backward pass against differences."""
    net = M.Labeller.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    pages = [(["Menu", "A title", "12 USD"], [("nav", "a"), ("h1",), ("p",)]), (["x y z"], [("div",)])]
    roles = np.array([0, 1, 2, 4])

    def loss():
        z, _ = net.logits(pages)
        z = z - z.max(1, keepdims=True)
        return float(-(z[np.arange(4), roles] - np.log(np.exp(z).sum(1))).mean())

    before = {k: v.copy() for k, v in net.p.items()}
    grads = {}

    class Catch(dict):
        def __setitem__(self, k, v):
            grads[k] = v / 0.1
            super().__setitem__(k, v)

    m = Catch({k: np.zeros_like(v) for k, v in net.p.items()})
    TP.step(net, pages, roles, m, {k: np.zeros_like(v) for k, v in net.p.items()}, 1, 0.0)
    net.p = before
    r = random.Random(1)
    for name in ("wf", "ub", "cf", "out", "path", "word"):
        flat = grads[name].reshape(-1)
        for at in [int(np.abs(flat).argmax()), r.randrange(flat.size)]:
            x = net.p[name].reshape(-1)
            x[at] += 1e-3
            up = loss()
            x[at] -= 2e-3
            down = loss()
            x[at] += 1e-3
            assert abs((up - down) / 2e-3 - flat[at]) < 2e-3


def test_labeller_on_held_out_pages(some):
    """Pages of another table than the one that it was trained on."""
    pages = [leaves(h) for h in some]
    pages = [p for p in pages if p[0]]
    known = TP.notices(pages)
    roles = [np.array(TP.weak_roles(*p, known)) for p in pages]
    precision, recall, _, _ = TP.evaluate(M.Labeller.load(), pages, roles)
    assert precision > 0.99 and recall > 0.99


def test_batches_change_nothing(some):
    net = M.Labeller.load()
    pages = [leaves(h) for h in some[:40]] + [([], [])]
    together = net.roles(pages)
    assert all((a == net.roles([p])[0]).all() for a, p in zip(together, pages))


def shop(title="Fine pill 5 mg", price="$9.50", text="The parcel carries lot 5; the vendor replaced the seal before noon.", extra=""):
    return f'<html><head><title>x</title><script>var t="{{{{ title }}}}"</script></head><body><header><nav class="menu"><ul><li>Cart</li><li>Home</li></ul></nav></header><main><h1 class="product_title entry-title">{title}</h1><div class="summary"><p class="price">{price}</p></div><div class="woocommerce-product-details__short-description"><p>{text}</p></div>{extra}</main><footer><p>All rights reserved.</p><small>© 2020</small></footer></body></html>'


CASES = [
    (shop(), False), (shop(title="{{ product.title }}"), True), (shop(price="%%PRICE%%"), True), (shop(text="Lorem ipsum dolor sit amet consectetur adipiscing elit."), True), (shop(title="Untitled"), True), (shop(text="INSERT TEXT HERE"), True),
    (shop(price="N/A"), False), (shop(price="Sold out"), False), (shop(text="My browser showed an error at checkout, the vendor fixed it. The batch was tested last week; number 5 is printed on the box."), False),
    (shop(extra='<div class="reviews"><p>Please enable JavaScript, they said.</p></div>'), False), ("<html><body><p>Please enable JavaScript to view this shop.</p></body></html>", True), ("<html><head><title>404 Not Found</title></head><body><h1>404</h1><p>The page you asked for is not here any more.</p></body></html>", True),
    ('<html><body><div id="app"></div><noscript>You need to allow scripts to run this app.</noscript></body></html>', True), ("<html><body></body></html>", False),
]


def test_residue_cases(spark):
    df = spark.createDataFrame([(n, h, "z") for n, (h, _) in enumerate(CASES)] + [(90, None, "z"), (91, "", "z"), (92, "  ", "z")], "row_id bigint, html string, n string")
    assert sorted(r.row_id for r in R.find_residue(df).collect()) == [n for n, (_, c) in enumerate(CASES) if c]
    kept = R.without_residue(df)
    assert kept.columns == df.columns and kept.count() == df.count() - sum(c for _, c in CASES)
    assert R.find_residue(df.limit(0)).count() == 0 and R.main_body(df.limit(0)).count() == 0


def test_main_body(spark):
    df = spark.createDataFrame([(1, shop(extra='<button>Buy now</button><section class="c52e"><h3>Also viewed</h3><a href="/item/1">Other 5 mg</a><span>$5</span></section>')), (2, CASES[1][0]), (3, None)], "row_id bigint, html string")
    got = sorted((r.row_id, r.node_no) for r in R.main_body(df).collect())
    assert got == [(1, 3), (1, 4), (1, 5)]
    texts = {r.row_id: r.text for r in R.main_text(df).collect()}
    assert texts[1].split("\n")[:2] == ["Fine pill 5 mg", "$9.50"] and texts[2] == "" and texts[3] == ""


def test_very_long_page(spark):
    long = shop(text="A plain sentence about the parcel that arrived on Monday. " * 20000)
    df = spark.createDataFrame([(1, long), (2, "<p>" + "word </b>" * 20000)], "row_id bigint, html string")
    assert R.main_body(df).filter("row_id = 1").count() == 3


def test_ratios_localise():
    r = R.Ratios.fit(["xxxx yyyy xxxx"] * 5, ["error 404 not found"] * 5, ["the parcel came on monday and was fine"] * 5)
    c = r.cover(["xxxx yyyy", "the parcel came", "error 404 not found", "", "the parcel came on monday xxxx yyyy xxxx"])
    assert c[0, 0] > 0.9 and c[1, 2] == 0 and c[2, 1] > 0.9 and c[3, 2] == 0 and 0.2 < c[4, 0] < 0.6
