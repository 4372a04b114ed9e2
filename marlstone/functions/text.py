"""Text, JSON and number functions as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x{00A0}\x{200B}\x{FEFF}]"
# Entities that listings' text carries unresolved, in the order in which they are replaced.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#8211;", "-"), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"')]
VERDICT_CATEGORIES = ["abortion", "contraception", "none"]
SHARE_CATEGORIES = ["abortion", "contraception"]


def collapse(text: Column) -> Column:
    """White space runs to one blank, trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def clean_text(text: Column) -> Column:
    """Collapsed text with the common entities resolved, each once and in a fixed order; null gives ''."""
    t = collapse(F.coalesce(text, F.lit("")))
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(t)


def single_line(text: Column) -> Column:
    """Line breaks to blanks, runs of two or more white spaces to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\r\n]", " "), r"\s{2,}", " "))


def cell(c: Column, kind: str) -> Column:
    """A value as a sheet's cell: null is '', booleans are True and False, nested values JSON."""
    if kind == "boolean":
        t = F.initcap(c.cast("string"))
    elif kind.startswith(("array", "map", "struct")):
        t = F.to_json(c)
    else:
        t = c.cast("string")
    return F.coalesce(t, F.lit(""))


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters and '...' if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def term_pattern(term: str) -> str | None:
    """A pattern that finds a term as whole words, whatever stands between its parts; for Java, RE2 and PCRE alike. None for a term without words."""
    parts = [re.escape(p) for p in re.split(r"[\s\-]+", term) if p]
    if not parts:
        return None
    return r"(^|[^\p{L}\p{N}_])" + r"[^\p{L}\p{N}_]*".join(parts) + r"([^\p{L}\p{N}_]|$)"


def cache_key(model: Column, title: Column, market: Column, description: Column, most: int = 800) -> Column:
    """SHA-1 of model, title, market and the description's head, a line each; nulls count as ''."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.sha1(F.concat_ws("\n", e(model), e(title), e(market), F.substring(e(description), 1, most)))


def judge_prompt(title: Column, market: Column, description: Column, most: int = 800) -> Column:
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("\n", F.lit("Listing to judge:"), F.concat(F.lit("title: "), e(title)), F.concat(F.lit("market: "), e(market)), F.concat(F.lit("description: "), truncated(e(description), most)))


def json_lenient(reply: Column) -> Column:
    """The JSON text of a reply: the whole reply without a code fence, else what lies between its first '{' and last '}'; null if neither parses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(ok(bare), ok(F.nullif(inner, F.lit(""))))


def verdict(reply_json: Column) -> Column:
    """struct(relevant, category, product_type, confidence, reason) of a reply's JSON text.

    No object gives nulls and ''. A category out of the list is 'none'; relevant takes booleans and numbers; confidence is
    rounded to three places, null if it is no number.
    """
    v = F.try_parse_json(reply_json)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    raw = F.get_json_object(reply_json, "$.relevant")
    relevant = F.when(raw.isin("true", "false"), raw == "true").when(raw.try_cast("double").isNotNull() & (get("relevant", "variant").isNotNull()), raw.try_cast("double") != 0)
    category = F.lower(F.trim(F.coalesce(get("category", "string"), F.lit(""))))
    return F.when(
        is_object,
        F.struct(
            relevant.alias("relevant"),
            F.when(category.isin(VERDICT_CATEGORIES), category).otherwise("none").alias("category"),
            F.trim(F.coalesce(get("product_type", "string"), F.lit(""))).alias("product_type"),
            F.round(F.get_json_object(reply_json, "$.confidence").try_cast("double"), 3).alias("confidence"),
            F.trim(F.coalesce(get("reason", "string"), F.lit(""))).alias("reason"),
        ),
    ).otherwise(F.struct(F.lit(None).cast("boolean").alias("relevant"), F.lit("").alias("category"), F.lit("").alias("product_type"), F.lit(None).cast("double").alias("confidence"), F.lit("unreadable reply").alias("reason")))


def resolved_category(verdict_category: Column, matched: Column) -> Column:
    """The first known category named by the verdict, else by the matched text (';' or ',' apart); null if neither does."""
    def first(c: Column) -> Column:
        parts = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(";")), ";"), lambda p: F.lower(F.trim(p)))
        return F.get(F.filter(parts, lambda p: p.isin(SHARE_CATEGORIES)), F.lit(0))
    return F.coalesce(first(verdict_category), first(matched))


def recency(value: Column) -> Column:
    """A number to order by: -1 for what is none, NaN included."""
    d = F.coalesce(value.try_cast("double"), F.lit(-1.0))
    return F.when(F.isnan(d), -1.0).otherwise(d)


def whole_number(text: Column) -> Column:
    """A count with thousands commas; null if it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def result_count(text: Column) -> Column:
    """The number of results that a page's phrase states: null if unknown, 0 if it says none.

    Rules in order: single result, 'of N', 'all N', 'found N' or 'fetched N', 'N result(s)', none found.
    """
    n = lambda p: whole_number(F.nullif(F.regexp_extract(text, p, 1), F.lit("")))
    return F.coalesce(
        F.when(text.rlike(r"(?i)\bsingle result\b"), F.lit(1).cast("bigint")),
        n(r"(?i)\bof\s+([\d,]+)"), n(r"(?i)\ball\s+([\d,]+)"), n(r"(?i)\b(?:found|fetched)\s+([\d,]+)"), n(r"(?i)([\d,]+)\s+(?:results?|listings?)\b"),
        F.when(text.rlike(r"(?i)\bno\s+results?\b|\bany results\b|\bno products were found\b"), F.lit(0).cast("bigint")),
    )


def price_range(text: Column) -> Column:
    """Dollar amounts of a text: one as it is, several as lowest - highest in text order; '$0' is dropped beside others; null without one."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\d[\d,]*(?:\.\d+)?"), F.lit(0)))
    kept = F.when(F.size(found) > 1, F.filter(found, lambda x: x != "$0")).otherwise(found)
    return F.when(F.size(kept) == 1, F.get(kept, F.lit(0))).when(F.size(kept) > 1, F.concat(F.array_min(kept), F.lit(" - "), F.array_max(kept)))
