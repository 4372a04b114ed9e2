import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import details, discovery, extraction, judging, relational, search, tagging
from marlstone.sources import csv_tables, sinks, storage
from marlstone.sources.json_records import complete_objects, streamed_objects
from marlstone.sources.json_array import JsonArraySource
from marlstone.streaming import latest

from .conftest import rows


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, None)], "x int, y string"), spark.createDataFrame([("q", 2)], "z string, x int")
    u = relational.union_by_name(a, b)
    assert u.columns == ["x", "y", "z"] and rows(u) == [("1", "", ""), ("2", "", "q")]


def test_pending_folds_case(spark):
    a = spark.createDataFrame([("s", "Pill"), ("s", "ring"), ("t", "pill")], "site string, term string")
    d = spark.createDataFrame([("s", "PILL"), ("s", "PILL")], "site string, term string")
    assert rows(relational.pending(a, d, ["site", "term"], ["term"])) == [("s", "ring"), ("t", "pill")]


def test_share_is_the_published_row_and_guards(spark):
    c = spark.createDataFrame([(20, 25)], "abortion int, contraception int")
    r = relational.share(c, spark.createDataFrame([(7337,)], "n int"), ["abortion", "contraception"]).first()
    assert (r.combined, r.other, r.share_pct) == (45, 7292, 0.6133)
    for total in (0, 44):
        with pytest.raises(Exception, match="total"):
            relational.share(c, spark.createDataFrame([(total,)], "n int"), ["abortion", "contraception"]).collect()


def test_expand_pages(spark):
    u = [("g", f"http://h/p/{n}") for n in (2, 3, 7)] + [("g", "http://h/q/9"), ("one", "http://h/x/4"), ("none", "http://h/x"), ("none", None)]
    df = spark.createDataFrame(u, "g string, url string")
    assert rows(relational.expand_pages(df, "url", "g", cap=4)) == [("g", f"http://h/p/{n}") for n in (2, 3, 4, 5)] + [("none", "http://h/x"), ("one", "http://h/x/4")]


def test_rank_and_candidates(spark):
    df = spark.createDataFrame([("a", 1, 5, 1), ("b", None, 9, 2), ("c", 1, 7, 3), ("d", 1, 7, 4)], "h string, score int, hits int, o int")
    assert [r.h for r in relational.ranked(df, "score", "hits", "o").collect()] == ["c", "d", "a", "b"]
    m = spark.createDataFrame([("h", "search:x", "", 1), ("h", "dir", "Name", 2), ("h", "search:x", "Late", 3), ("", "dir", "z", 4), (None, "dir", "z", 5)], "host string, src string, name string, o int")
    assert rows(relational.candidates(m, "host", "src", "name", "o")) == [("h", "Name", "dir; search:x", 1)]


def test_first_per_group(spark):
    df = spark.createDataFrame([("a", i, str(i)) for i in range(50)] + [("b", 1, None)], "g string, o int, v string")
    assert rows(relational.first_per_group(df, "g", "o", 2)) == [("a", 0, "0"), ("a", 1, "1"), ("b", 1, None)]


def test_reachable(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    assert rows(relational.reachable(e, s, 3)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


@pytest.mark.parametrize(("given", "want"), [
    ((False, 5, False, True, 1, 3, False, False), "retry"), ((True, None, False, True, 1, 3, False, False), "retry"), ((True, 0, False, True, 1, 0, False, False), "done"), ((True, None, True, True, 1, 0, False, False), "done"),
    ((True, None, True, False, 1, 0, False, False), "retry"), ((True, 5, False, True, 2, 0, False, False), "done"), ((True, 5, False, True, 2, 3, True, False), "done"), ((True, 5, False, True, 2, 3, False, True), "retry"), ((True, 5, False, True, 2, 3, False, False), "more"),
])
def test_attempt_status(spark, given, want):
    df = spark.createDataFrame([given], "fetched boolean, n_results int, countless boolean, usable boolean, page int, links int, repeated boolean, cap_hit boolean")
    assert relational.attempt_status(df).first().status == want


def test_tagging(spark):
    d = spark.createDataFrame([("c", "mini-pill"), ("c", "Yaz"), ("a", "day after pill"), ("a", " ")], "category string, term string")
    t = tagging.load_terms(d)
    df = spark.createDataFrame([(1, "a MINI pill and Yaz", None), (2, "Yazé", ""), (3, None, "the day-after  pill"), (4, None, None), (5, "mini_pill", "")], "i int, t string, d string")
    assert [(r.i, r.matched_terms, r.matched_categories) for r in tagging.tag(df, t, "t", "d").orderBy("i").collect()] == [(1, ["Yaz", "mini-pill"], ["c"]), (3, ["day after pill"], ["a"])]
    assert tagging.tag(df, [], "t").count() == 0


@pytest.mark.parametrize("term", ["mini-pill", "Yaz", "day after pill", "plan b", "Ru 486", "a.b", "c+ d", "ÉTÉ 1"])
def test_matcher_agrees_with_patterns(spark, term):
    texts = ["a MINI pill", "mini_pill", "minipill", "mini--  pill.", "xmini pill", "Yazé", "yaz", "_yaz", "yaz_", "the DAY-after... pill!", "day after pills", "plan B", "planb", "plan (b)", "ru-486", "RU486", "a.b", "A.B x", "a b", "c+ d", "c + d", "été-1", "Été  1", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = sorted(r.i for r in df.filter(F.coalesce("t", F.lit("")).rlike("(?iu)" + T.term_pattern(term))).collect())
    assert sorted(r.i for r in tagging.tag(df, [("c", term, T.term_pattern(term))], "t").collect()) == want


LISTING = """<html><head><title>Fine pill – River Box</title></head><body><h1 class="product_title">Fine pill 5 mg</h1><div class="summary"><p class="price">$9.50 <b>$10</b> $0</p></div>
<table><tr><td>Dosage</td><td>5 mg</td></tr><tr><td>Shipping</td><td>EU -> US</td></tr><tr><td>Stock</td><td>1,200 in stock</td></tr></table><div class="rating">4/5 by many</div>
<div class="woocommerce-product-details__short-description"><p>A description of more than fifty characters, so that it counts as one.</p></div><div class="reviews"><p>A review of more than twenty characters.</p><p>short</p></div></body></html>"""


def test_read_listing():
    r = extraction.read_listing(LISTING)
    assert (r["market_name"], r["listing_title"], r["price"], r["rating"], r["number_in_stocks"], r["ship_from"]) == ("River Box", "Fine pill 5 mg", "$10 - $9.50", "4", "1200", "")
    assert r["dosage"] == "5 mg" and r["review"] == "A review of more than twenty characters. | A review of more than twenty characters." and r["description"].startswith("A description")
    assert all(v == "" for v in extraction.read_listing("").values()) and all(v == "" for v in extraction.read_listing(None).values())
    second = extraction.read_listing(LISTING, extraction.SECOND)
    assert (second["dosage"], second["ship_from"], second["ship_to"]) == ("", "EU", "US")
    assert extraction.read_listing("<p class=description>" + "x" * 501)["description"] == "x" * 500 + "..."


def test_links():
    html = '<ul class="products"><li class="product"><a href="/product/a">A</a></li></ul><a href="/cart">c</a><nav><a href="?page=2">2</a><a href="http://other/">o</a></nav>'
    assert extraction.product_links(html, "http://h/c/") == ["http://h/product/a"]
    assert extraction.pager_links(html, "http://h/c/") == ["http://h/c/?page=2", "http://other/"] and extraction.page_urls(html, "http://h/c/") == ["http://h/c/", "http://h/c/?page=2"]
    assert extraction.page_links("<a href='http://[bad'>x</a>", "http://h") == []
    assert extraction.category_links(None, "http://h/") == [] and extraction.forum_links("", "") == [] and extraction.hinted_links(None, "", 3) == []
    assert details.next_pages('<a href="/page/2">2</a><a href="/x">x</a>', "http://h/") == ["http://h/page/2"] and details.content_text(None) == ""


def test_every_category_word_and_hint():
    for w in extraction.NO_CATEGORY:
        assert extraction.category_links(f'<a href="/a/{w.upper()}">x</a>', "http://h/") == []
    for h in extraction.CATEGORY_HINTS:
        assert extraction.hinted_links(f'<a href="/{h}/1">x</a>', "http://h/", 5) == [f"http://h/{h}/1"]
    for m in extraction.NO_PRODUCT_MARKS:
        assert extraction.product_links(f'<a href="/item/1/x{m}">x</a>', "http://h/") == []
    assert len(set(extraction.NO_CATEGORY)) == len(extraction.NO_CATEGORY)


def test_site_selection(spark):
    sites = search.registry(spark)
    assert search.selected(sites, "all").count() == 9 and [r.key for r in search.selected(sites, "forum", "forum").collect()] == ["forum"]
    assert sorted(r.key for r in search.selected(sites, " shop, q ").collect()) == ["q", "shop"]
    with pytest.raises(ValueError, match="zzz"):
        search.selected(sites, "shop, zzz")


def test_promotion_names_unknown_hosts(spark):
    hosts = spark.createDataFrame([("http://A.org/",), ("b.org",)], "host string")
    assert [r.host for r in discovery.unknown_hosts(hosts, spark.createDataFrame([("a.org",)], "host string")).collect()] == ["b.org"]
    assert discovery.run_folder("/x/out/", "20260101_000000") == "/x/out_20260101_000000"


def test_site_scores(spark):
    df = spark.createDataFrame([("a", "ok", "pill and ring"), ("a", "ok", "PILL"), ("a", "dead", None), ("b", "walled", "pill"), ("b", "dead", ""), ("c", "dead", "pill"), ("d", "ok", None)], "site string, st string, t string")
    terms = [("c", "pill", T.term_pattern("pill")), ("c", "ring", T.term_pattern("ring"))]
    assert rows(tagging.site_scores(df, "site", "st", terms, "t")) == [("a", "ok", 2), ("b", "walled", None), ("c", "dead", None), ("d", "ok", 0)]


def test_parse_listings_frame(spark):
    df = spark.createDataFrame([(1, "http://h/item/x", "c", LISTING, "z"), (2, "http://h/item/y", "c", "", "z"), (3, "http://h/about", "c", LISTING, "z"), (4, None, None, None, None)], "row_id bigint, product_url string, category_page string, html string, price string")
    assert [(r.row_id, r.listing_title) for r in extraction.parse_listings(df).collect()] == [(1, "Fine pill 5 mg")]
    assert details.details(df).count() == 2 and extraction.parse_listings(df.limit(0)).count() == 0


def test_json_array_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"product_url": "u1", "fetched_at": 5}, 7, null, {"product_url": "u2", "fetched_at": "x"}]')
    (tmp_path / "b.json").write_text('[{"product_url": "u3"}, {"product_url": "u')
    (tmp_path / "c.json").write_text('[{"product_url": "old"}]')
    spark.dataSource.register(JsonArraySource)
    s = "product_url string, fetched_at bigint, file_ord bigint, pos bigint"
    got = rows(spark.read.format("json_array").schema(s).option("legacy", str(tmp_path / "c.json")).load(str(tmp_path)))
    assert got == [("old", None, 2, 0), ("u1", 5, 0, 0), ("u2", None, 0, 1), ("u3", None, 1, 0)]
    assert spark.read.format("json_array").schema(s).option("salvage", "lenient").load(str(tmp_path / "none*.json")).count() == 0
    for salvage, ok in (("false", False), ("true", True)):
        t = spark.read.format("json_array").schema(s).option("salvage", salvage).load(str(tmp_path / "b.json"))
        if ok:
            assert t.count() == 1
        else:
            with pytest.raises(Exception):
                t.count()
    with pytest.raises(Exception, match="no file"):
        spark.read.format("json_array").schema(s).load(str(tmp_path / "none*.json")).count()


def test_streamed_objects_agree_with_whole_texts():
    texts = [
        '[{"a": 1}, 7, null, {"b": "x]{"}, [{"c": 2}], "s"]', '{"a": 1}\n{"b": 2}\n', '[{"a": 1}, {"b": ', '[{"a": 1}, {"b" 2}\n{"c": 3}\n[{"d": 4}]', "", "  ", "[]", '{"a": {"b": [1, 2]}}', "12", '[[{"x": 1}], {"y": "é"}]', 'garbage\n{"z": 1}', '[1.5, {"q": 1}',
    ]
    for t in texts:
        for size in (1, 2, 3, 7, 1000):
            assert list(streamed_objects(t[k : k + size] for k in range(0, len(t), size))) == list(complete_objects(t)), (t, size)


def test_storage(spark, tmp_path):
    p = str(tmp_path / "deep" / "x.json")
    storage.write_text(spark, p, ["a", "é"])
    storage.write_text(spark, p, ["b"])
    assert storage.exists(spark, p) and storage.read_text(spark, p) == "b" and not storage.exists(spark, p + "x")
    assert storage.listed(str(tmp_path / "deep")) == [p] == storage.listed(str(tmp_path / "deep" / "*.json")) and storage.listed(str(tmp_path / "no")) == []
    (tmp_path / "b.txt").write_bytes("\ufeffaé".encode() * 3 + b"\xff")
    assert "".join(storage.chunks(str(tmp_path / "b.txt"), 2)).startswith("aé")


def test_csv_and_sinks(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b,b,b\n1,2,3,4\n5\n"q, ""r""",2,3,4,9\n')
    t = csv_tables.read_csv(spark, str(p))
    assert t.columns == ["a", "b", "b__2", "b__3"] and rows(t)[0][0] in ("1", 'q, "r"') and t.count() == 3
    (tmp_path / "e.csv").write_text("")
    assert csv_tables.read_csv(spark, str(tmp_path / "e.csv")).columns == []
    assert sinks.column_order(["zz", "price", "matched_terms", "market_name"]) == ["market_name", "price", "zz", "matched_terms"]
    df = spark.createDataFrame([(True, None, [1, 2])], "f boolean, s string, l array<int>")
    assert sinks.write_json_array(df, str(tmp_path / "o.json")) == 1 and json.loads((tmp_path / "o.json").read_text())[0]["l"] == [1, 2]
    sinks.write_csv(df, str(tmp_path / "o"))
    assert rows(spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "o"))) == [("True", "[1,2]", None)]
    assert sinks.append_new(spark.createDataFrame([("u",), ("u",), ("v",)], "k string"), str(tmp_path / "cfg"), "k") == 2
    assert sinks.append_new(spark.createDataFrame([("v",), ("w",)], "k string"), str(tmp_path / "cfg"), "k") == 1


def test_config_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": ["x", "y"], "b": []}')
    assert rows(csv_tables.read_terms(spark, str(tmp_path / "t.json"))) == [("a", "x"), ("a", "y")]
    (tmp_path / "p.json").write_text('{"completed_terms": ["x"]}')
    assert rows(csv_tables.read_progress(spark, str(tmp_path / "p.json"), "s")) == [("s", "x")]
    assert csv_tables.read_progress(spark, str(tmp_path / "none"), "s").count() == 0
    sinks.write_progress(spark.createDataFrame([("s", "b"), ("s", "A")], "site string, term string"), str(tmp_path / "q.json"))
    assert json.loads((tmp_path / "q.json").read_text()) == {"markets": {"s": ["A", "b"]}}
    assert rows(csv_tables.read_progress(spark, str(tmp_path / "q.json"), "s")) == [("s", "A"), ("s", "b")]


def test_judging(spark):
    df = spark.createDataFrame([("t", "m", "d"), ("t", "m", "d"), ("u", None, None)], "listing_title string, market_name string, description string")
    empty = spark.createDataFrame([], "cache_key string, reply string")
    new = judging.judge_pending(df, empty, "m1", lambda p: '{"relevant": true, "category": "abortion", "confidence": 1}' if "title: t" in p else None)
    assert new.count() == 1
    out = judging.judged(df, new, "m1")
    assert sorted((r.listing_title, r.llm_relevant, r.llm_category) for r in out.collect() if r.listing_title == "t") == [("t", True, "abortion")] * 2
    assert relational.approved(out, "llm_relevant").count() == 2


def test_stream_keeps_latest(spark, tmp_path):
    make = lambda *r: spark.createDataFrame([(i, "s", i, "m", "c", u, at, "h") for i, u, at in r], latest.PAGE_SCHEMA)
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    make((1, "a", "5"), (2, "b", "5")).coalesce(1).write.mode("append").parquet(src)
    latest.follow(spark, src, table, str(tmp_path / "c")).awaitTermination()
    make((3, "a", "9"), (4, "b", "1"), (5, None, "1")).coalesce(1).write.mode("append").parquet(src)
    latest.follow(spark, src, table, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.row_id for r in latest.current(spark, table).collect()) == [2, 3, 5]
    # A repeated batch changes nothing, and versions that no longer count are gone.
    again = make((3, "a", "9"), (4, "b", "1"), (5, None, "1"))
    latest.upsert(again, table, "product_url", "fetched_at", ["session_file", "pos"])
    assert sorted(r.row_id for r in latest.current(spark, table).collect()) == [2, 3, 5]
    assert sum(1 for _ in (tmp_path / "t").glob("v*/_bucket=*")) == len(latest._manifest(spark, table))
