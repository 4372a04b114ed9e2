"""Queries of the training-text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_spread
from . import abuse, leakage, products, residue, tokenizer


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(read_spread(spark, sf_dir, "products_html", "row_id", "html"))


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, market) of the pages that stay."""
    return residue.without_residue(_read(spark, sf_dir, "products_html").select("row_id", "market", "html")).select("row_id", "market")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.main_body(read_spread(spark, sf_dir, "products_html", "row_id", "html"))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.main_text(read_spread(spark, sf_dir, "products_html", "row_id", "html"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.groups(read_spread(spark, sf_dir, "parsed_merged", "listing_id", "market_name", "listing_title", "description", "dosage"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.pairs(_products(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(listing_id, product): one row for each listing with its product's id."""
    return _products(spark, sf_dir)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_documents(read_spread(spark, sf_dir, "documents", "doc_id", "text"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, same): whether decoding gives each text back."""
    d = _read(spark, sf_dir, "documents")
    t = tokenizer.encode_documents(d).withColumn("back", tokenizer.decoded(F.col("ids"))).join(d.select("doc_id", "text"), "doc_id")
    return t.select("doc_id", F.size("ids").alias("n_ids"), (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(read_spread(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "source", "text")
    return abuse.score(docs, abuse.fit(docs, _read(spark, sf_dir, "doc_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(_scores(spark, sf_dir))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", *[F.round(k, 6).alias(k) for k in abuse.LABELS])


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_scores(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p3_found, p3_kept, p4_found, p4_text, p5_found, p5_groups, p8_ids, p8_roundtrip, p9_found, p10_found, p10_scores, p10_rates)}
ORACLE_SQL: dict = {}
