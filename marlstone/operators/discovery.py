"""Candidate sites and categories: seeds, reports, promotion into the list of addresses, and what a report's chart shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical_path

# Columns of the two reports, in order.
CANDIDATE_COLUMNS = ["name", "onion_url", "sources", "search_hits", "status", "http_status", "score", "matched_categories", "sample_titles", "candidate_category_urls"]
CATEGORY_COLUMNS = ["relevant", "name", "url", "pages_detected", "page_urls"]
SOURCE_SCHEMA = "directories array<string>, search_engines array<string>, ahmia_base string, search_query_terms array<string>, ahmia_query_terms array<string>"


def read_seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """(ord, url) of a JSON array of addresses; anything else has no rows."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("u"))
    return t.select(F.posexplode(F.coalesce("u", F.array().cast("array<string>"))).alias("ord", "url")).filter("url is not null")


def discovery_sources(config: Column) -> Column:
    """struct(directories, engines, terms) of a configuration's JSON text; older keys count where the newer are missing or empty."""
    c = F.from_json(config, SOURCE_SCHEMA)
    none = F.array().cast("array<string>")
    filled = lambda a: F.when(F.size(a) > 0, a)
    engines = F.coalesce(filled(c["search_engines"]), F.when(F.coalesce(c["ahmia_base"], F.lit("")) != "", F.array(c["ahmia_base"])), none)
    return F.struct(F.coalesce(c["directories"], none).alias("directories"), engines.alias("engines"), F.coalesce(filled(c["search_query_terms"]), c["ahmia_query_terms"], none).alias("terms"))


def seeded_first(candidates: DataFrame, hits: str, order: str, most: int) -> DataFrame:
    """A report of ``most`` candidates: those that a search found first, each part in the input's order."""
    return candidates.orderBy((F.col(hits) > 0).desc(), F.col(order)).limit(most)


def _joined(c: str, sep: str) -> Column:
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), sep)


def candidate_report(candidates: DataFrame) -> DataFrame:
    """The report's columns as text: sources sorted, lists joined, a null score ''; columns that are missing are ''."""
    t = candidates
    for c in CANDIDATE_COLUMNS:
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast("array<string>" if c in ("sources", "matched_categories", "sample_titles", "candidate_category_urls") else "string"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return t.select(
        text("name").alias("name"), text("onion_url").alias("onion_url"), F.array_join(F.array_sort(F.coalesce("sources", F.array().cast("array<string>"))), "; ").alias("sources"), F.coalesce(F.col("search_hits").cast("bigint"), F.lit(0).cast("bigint")).alias("search_hits"),
        text("status").alias("status"), text("http_status").alias("http_status"), text("score").alias("score"), _joined("matched_categories", "; ").alias("matched_categories"), _joined("sample_titles", " | ").alias("sample_titles"), _joined("candidate_category_urls", " | ").alias("candidate_category_urls"),
    )


def category_report(categories: DataFrame) -> DataFrame:
    """The report of categories, relevant ones first, then by detected pages, then in the input's order (``ord``)."""
    t = categories.orderBy(F.col("relevant").desc(), F.col("pages_detected").desc(), F.col("ord"))
    return t.select("relevant", "name", "url", F.col("pages_detected").cast("bigint").alias("pages_detected"), _joined("page_urls", " | ").alias("page_urls"))


def host_key(host: Column) -> Column:
    """A host as it is looked up: lower case, without scheme and outer slashes."""
    return F.regexp_replace(F.replace(F.replace(F.lower(host), F.lit("http://"), F.lit("")), F.lit("https://"), F.lit("")), "^/+|/+$", "")


def promoted(hosts: DataFrame, candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(url, known): the list of addresses after promotion of hosts: what was there, and each new address of a named candidate once.

    A candidate without category addresses gives its own. Hosts that are no candidates give nothing; see ``unknown_hosts``.
    """
    c = candidates.select(host_key(F.col("host")).alias("_k"), F.when(F.size("candidate_category_urls") > 0, F.col("candidate_category_urls")).otherwise(F.array("onion_url")).alias("_u"))
    new = hosts.select(host_key(F.col("host")).alias("_k")).distinct().join(c, "_k").select(F.explode("_u").alias("url")).distinct()
    return existing.select("url", F.lit(True).alias("known")).unionByName(new.join(existing.select("url"), "url", "left_anti").select("url", F.lit(False).alias("known")))


def unknown_hosts(hosts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The hosts that are no candidates."""
    c = candidates.select(host_key(F.col("host")).alias("_k"))
    return hosts.withColumn("_k", host_key(F.col("host"))).join(c, "_k", "left_anti").select("host")


def on_allowed_paths(links: DataFrame, url: str, allowed: DataFrame) -> DataFrame:
    """The links whose canonical path is one of the allowed addresses' or paths' (column ``path``)."""
    a = allowed.select(canonical_path(F.col("path")).alias("_p")).distinct()
    return links.withColumn("_p", canonical_path(F.col(url))).join(a, "_p", "left_semi").drop("_p")


def share_segments(share: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(segment, n, share, label) of a share's one row: its parts and the rest, as a chart shows them; the share is a fraction."""
    rows = F.array(*[F.struct(F.lit(p).alias("segment"), F.col(p).cast("bigint").alias("n")) for p in [*parts, "other"]])
    t = share.select("total", F.explode(rows).alias("_s")).select("total", "_s.segment", "_s.n")
    return t.select("segment", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.concat(F.initcap("segment"), F.lit("\n"), F.format_number("n", 0), F.lit(" ("), percent(F.col("n") / F.col("total")), F.lit(")")).alias("label"))


def percent(fraction: Column) -> Column:
    """A fraction as percent with two places."""
    return F.concat(F.format_number(fraction * 100, 2), F.lit("%"))


def run_folder(base: str, moment: str) -> str:
    """The folder of a run's own output: ``base`` with the run's moment (yyyyMMdd_HHmmss)."""
    return f"{base.rstrip('/')}_{moment}"
