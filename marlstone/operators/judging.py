"""The second-stage judge: pluggable, cached by key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, json_lenient, judge_prompt, verdict

Judge = Callable[[str], "str | None"]  # prompt to reply; None is a failure and isn't cached


def judge_pending(listings: DataFrame, cache: DataFrame, model: str, judge: Judge) -> DataFrame:
    """(cache_key, reply): replies for the keys that the cache lacks, each key asked once."""
    k = listings.withColumn("cache_key", cache_key(F.lit(model), F.col("listing_title"), F.col("market_name"), F.col("description")))
    prompt = k.select("cache_key", judge_prompt(F.col("listing_title"), F.col("market_name"), F.col("description")).alias("prompt"))
    ask = prompt.groupBy("cache_key").agg(F.min("prompt").alias("prompt")).join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cache_key": b["cache_key"], "reply": [judge(p) for p in b["prompt"]]})

    return ask.mapInPandas(run, "cache_key string, reply string").filter("reply is not null")


def judged(listings: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Each listing with llm_relevant, llm_category, llm_product_type, llm_confidence and llm_reason of its cached reply, null without one."""
    k = listings.withColumn("cache_key", cache_key(F.lit(model), F.col("listing_title"), F.col("market_name"), F.col("description")))
    c = cache.groupBy("cache_key").agg(F.min("reply").alias("reply"))
    t = k.join(c, "cache_key", "left").withColumn("_v", F.when(F.col("reply").isNotNull(), verdict(json_lenient(F.col("reply")))))
    return t.select(*listings.columns, "cache_key", *[F.col(f"_v.{f}").alias(f"llm_{f}") for f in ("relevant", "category", "product_type", "confidence", "reason")])


def rule_judge(terms: Sequence[tuple[str, str]]) -> Judge:
    """A judge without a network, for tests and dry runs: (category, term) pairs in order of preference, looked for in the prompt whatever the case.

    The first that occurs makes the listing relevant under its category; without one it isn't.
    """

    def judge(prompt: str) -> str:
        low = prompt.lower()
        hit = next(((c, t) for c, t in terms if t.lower() in low), None)
        found = {"relevant": True, "category": hit[0], "product_type": hit[1], "confidence": 0.9, "reason": "names a term"} if hit else {"relevant": False, "category": "none", "product_type": "", "confidence": 0.5, "reason": "names no term"}
        return json.dumps(found)

    return judge
