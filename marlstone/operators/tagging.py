"""Tagging texts with a dictionary of terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_pattern

_WORDS = re.compile(r"\w+")
_PLAIN = re.compile(r"[\s\-]*[^\W_]+(?:[\s\-]+[^\W_]+){0,7}[\s\-]*")  # up to eight parts
MAX_SCREENED = 200  # terms up to which texts are screened for substrings first
MAX_TERMS = 100_000  # a dictionary is a dimension; beyond this it is refused


def load_terms(dictionary: DataFrame) -> list[tuple[str, str, str]]:
    """(category, term, pattern) of a dictionary table, sorted; terms without words are left out. More than MAX_TERMS rows are refused,
    so that nothing large is ever collected."""
    rows = dictionary.select("category", "term").distinct().orderBy("category", "term").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return [(r.category, r.term, p) for r in rows if r.term and (p := term_pattern(r.term))]


def haystack(*columns: str) -> Column:
    """The texts that are searched, apart by line breaks; nulls count as ''."""
    return F.concat_ws(" \n ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def _spellings(parts: list[str]) -> list[list[str]]:
    """The ways to write a term's parts as words: each two neighbours apart or joined."""
    out = [parts[:1]]
    for p in parts[1:]:
        out = [x for o in out for x in ([*o, p], [*o[:-1], o[-1] + p])]
    return out


class Matcher:
    """All terms of a dictionary in one pass over a text: words by hash, then the few terms that begin with a word that occurs."""

    def __init__(self, terms: list[tuple[str, str, str]]):
        self.by_head: dict[str, list[tuple[str, str, list[str]]]] = {}
        for category, term, _ in terms:
            for parts in _spellings(_WORDS.findall(term.lower())):
                self.by_head.setdefault(parts[0], []).append((category, term, parts))

    def hits(self, text: str) -> list[tuple[str, str]]:
        """(category, term) of the terms in a text, distinct. A term is there if its parts stand one after another as whole words, with
        nothing but signs, or nothing, between them."""
        tokens = _WORDS.findall(text.lower())
        heads = self.by_head.keys() & set(tokens)
        if not heads:
            return []
        out = set()
        for n, t in enumerate(tokens):
            if t in heads:
                out.update((c, w) for c, w, parts in self.by_head[t] if tokens[n : n + len(parts)] == parts)
        return sorted(out)


def tag(df: DataFrame, terms: list[tuple[str, str, str]], *columns: str) -> DataFrame:
    """The rows that hold a term, with ``matched_terms`` and ``matched_categories`` as sorted distinct arrays.

    A term is found as whole words, whatever the case and whatever signs stand between its parts. Terms of letters, digits, blanks and hyphens
    are matched by words, all in one pass, in Arrow batches; a screen of plain substrings goes before in the JVM. A term that holds other
    signs is matched by its pattern.
    """
    empty = F.array().cast("array<struct<category:string,term:string>>")
    words = [t for t in terms if _PLAIN.fullmatch(t[1])]
    rest = [t for t in terms if not _PLAIN.fullmatch(t[1])]
    matcher = Matcher(words)

    @F.pandas_udf("array<struct<category:string,term:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"category": c, "term": w} for c, w in matcher.hits(t)])

    hay = haystack(*columns)
    t = df.withColumn("_hay", hay)
    found = find("_hay") if words else empty
    if rest:
        found = F.concat(found, F.filter(F.array(*[F.when(F.col("_hay").rlike("(?iu)" + p), F.struct(F.lit(c).alias("category"), F.lit(w).alias("term"))) for c, w, p in rest]), lambda x: x.isNotNull()))
    if len(terms) <= MAX_SCREENED:
        low = F.lower("_hay")
        screen = F.lit(False)
        for head in sorted({re.split(r"[\s\-]+", w.lower().strip(" -"))[0] for _, w, _ in terms}):
            screen = screen | F.contains(low, F.lit(head))
        t = t.filter(screen)
    t = t.withColumn("_hits", found).filter(F.size("_hits") > 0)
    names = lambda f: F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x[f])))
    return t.withColumn("matched_terms", names("term")).withColumn("matched_categories", names("category")).drop("_hay", "_hits")


def keyword_pages(pages: DataFrame, keywords: list[str], html: str = "html") -> DataFrame:
    """The pages whose raw text holds a keyword as it stands, whatever the case; no keyword, no page."""
    low = F.lower(F.coalesce(F.col(html), F.lit("")))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(low, F.lit(k.lower()))
    return pages.filter(hit)


def flat_terms(dictionary: DataFrame) -> DataFrame:
    """(term, category): distinct terms whatever their case; the first spelling by category and term stays, with its category."""
    t = dictionary.withColumn("term", F.trim("term")).filter("term <> ''")
    return t.groupBy(F.lower("term").alias("_k")).agg(F.min(F.struct("category", "term")).alias("m")).select("m.term", "m.category")


def site_scores(pages: DataFrame, site: str, status: str, terms: list[tuple[str, str, str]], *columns: str) -> DataFrame:
    """(site, status, score): how many distinct terms a site's pages name; null for a site none of whose pages is 'ok'.

    Terms are tagged page by page and counted after a partial aggregate, so no site's texts are ever put together.
    """
    state = pages.groupBy(site).agg(F.min(F.when(F.col(status) == "ok", 0).when(F.col(status) == "walled", 1).otherwise(2)).alias("_s"))
    hits = tag(pages.filter(F.col(status) == "ok"), terms, *columns).select(site, F.explode("matched_terms").alias("_t"))
    n = hits.groupBy(site).agg(F.countDistinct("_t").alias("_n"))
    names = F.when(F.col("_s") == 0, "ok").when(F.col("_s") == 1, "walled").otherwise("dead")
    return state.join(n, site, "left").select(site, names.alias("status"), F.when(F.col("_s") == 0, F.coalesce("_n", F.lit(0))).alias("score"))
