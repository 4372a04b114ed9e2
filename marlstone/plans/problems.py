"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, dedupe, drift, units
from ..session import cut_lineage, read_table
from ..sources import storage



def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(read_table(spark, sf_dir, "raw_records"))


def _consistent(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    """The consistent table with its lists as text, a line for each entry."""
    t = drift.consistent(read_table(spark, sf_dir, "raw_records"), feed)
    lines = F.array_join(F.transform("extras", lambda x: F.concat(x["field"], F.lit("="), x["value"])), "\n")
    return t.withColumn("extras", lines).withColumn("cast_failures", F.array_join("cast_failures", ";"))


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consistent(spark, sf_dir, "products_html")


def p1_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consistent(spark, sf_dir, "parsed_merged")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.surplus_deliveries(read_table(spark, sf_dir, "products_html"))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each fetch, the first by the time of its delivery."""
    t = read_table(spark, sf_dir, "products_html").select("row_id", "market", "product_url", "fetched_at", "session_file")
    return dedupe.keep_one_delivery(t, delivered=dedupe.delivery_time(F.col("session_file"))).drop("session_file")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = read_table(spark, sf_dir, "parsed_merged").select("listing_id", "listing_title", "description", "price", "dosage")
    return units.listing_quantities(listings, read_table(spark, sf_dir, "unit_factors"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.consolidated(read_table(spark, sf_dir, "landed_files"))


SMALL_TARGET = 64 * 1024


def p7_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_no, planned_records, written_records) of a rewrite into groups of 64 kB, so that there are many."""
    files = read_table(spark, sf_dir, "landed_files")
    folder = compaction.own_folder(spark)
    try:
        return cut_lineage(compaction.rewrite(files, folder, SMALL_TARGET))
    finally:
        storage.delete(spark, folder)


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.group_report(read_table(spark, sf_dir, "landed_files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pages, p1_listings, p2_found, p2_kept, p6_found, p7_found, p7_groups, p7_reconciled)}

_PAGE_KEY = r"""
  SELECT row_id, market, product_url, fetched_at, session_file, u, lower(regexp_extract(u, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//', 1)) AS s,
    lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)) AS a,
    regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') AS p,
    list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN
      ('phpsessid','jsessionid','aspsessionid','sid','sessionid','session_id','ref','referrer','referer','gclid','fbclid','msclkid','yclid','mc_cid','mc_eid','_ga'))) AS q,
    try_cast(trim(fetched_at) AS DECIMAL(28,3)) AS v
  FROM (SELECT *, trim(product_url, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS u FROM products_html)"""
_SURPLUS = f"""
WITH parts AS ({_PAGE_KEY}),
keyed AS (
  SELECT *, CASE WHEN u <> '' THEN
      (CASE WHEN (s = 'http' AND a LIKE '%:80') OR (s = 'https' AND a LIKE '%:443') OR a LIKE '%:' THEN regexp_replace(a, ':\\d*$', '') ELSE a END)
      || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS k,
    CASE WHEN v >= 1e14 THEN floor(v / 1000000) WHEN v >= 1e11 THEN floor(v / 1000) ELSE floor(v) END AS m
  FROM parts),
ranked AS (
  SELECT *, CASE WHEN k IS NOT NULL AND m IS NOT NULL THEN row_number() OVER (PARTITION BY k, m ORDER BY row_id) END AS n FROM keyed)
"""
_LAYOUT_OBJECTS = r"""
WITH obj AS (
  SELECT file_id, unnest(regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}')) AS o,
    generate_subscripts(regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'), 1) AS rec_no
  FROM landed_files),
rec AS (SELECT file_id, rec_no, json_extract_string(o, '$.product_url') AS url, json_extract_string(o, '$.fetched_at') AS fetched FROM obj),
ranked AS (SELECT *, row_number() OVER (PARTITION BY url, fetched ORDER BY file_id, rec_no) AS n FROM rec)
"""
_PLACED = r"""
WITH RECURSIVE obj AS (
  SELECT file_id, content, unnest(regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}')) AS o, generate_subscripts(regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'), 1) AS rec_no FROM landed_files),
places AS (
  SELECT file_id, 1 AS rec_no, CAST(strpos(content, o) - 1 AS BIGINT) AS pos, CAST(strpos(content, o) - 1 + length(o) AS BIGINT) AS done FROM obj WHERE rec_no = 1
  UNION ALL SELECT o.file_id, o.rec_no, p.done + strpos(substr(content, p.done + 1), o.o) - 1, p.done + strpos(substr(content, p.done + 1), o.o) - 1 + length(o.o) FROM places p JOIN obj o ON o.file_id = p.file_id AND o.rec_no = p.rec_no + 1),
rec AS (SELECT file_id, rec_no, pos, json_extract_string(o, '$.product_url') AS url, json_extract_string(o, '$.fetched_at') AS fetched FROM obj JOIN places USING (file_id, rec_no)),
kept AS (SELECT file_id, rec_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY url, fetched ORDER BY file_id, rec_no) AS n FROM rec) WHERE n = 1 OR coalesce(url, '') = '')
"""


def _consistent_sql(feed: str, columns: dict[str, str]) -> str:
    """The consistent table in SQL; ``columns`` are the names of each column in lower case without signs, with commas between."""
    names = "CASE " + " ".join(f"WHEN n IN ({', '.join(repr(a) for a in names.split(','))}) THEN '{c}'" for c, names in columns.items()) + " END"
    value = {"fetched_at": "CASE WHEN try_cast(main AS DECIMAL(28,3)) IS NOT NULL THEN CAST(floor(try_cast(main AS DECIMAL(28,3))) AS BIGINT) ELSE CAST(epoch(try_cast(main AS TIMESTAMP)) AS BIGINT) END", "number_in_stocks": "try_cast(main AS BIGINT)"}
    cols = ", ".join(f"{'max(' + value[c] + ')' if c in value else 'max(main)'} FILTER (c = '{c}' AND first) AS {c}" for c in columns)
    typed = [c for c in columns if c in value]
    bad = " OR ".join(f"(c = '{c}' AND main IS NOT NULL AND ({value[c]}) IS NULL)" for c in typed)
    return rf"""
WITH r AS (SELECT * FROM raw_records WHERE feed = '{feed}'),
j AS (SELECT rec_id, payload, unnest(json_keys(payload)) AS field, generate_subscripts(json_keys(payload), 1) AS place FROM r WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
v AS (SELECT rec_id, field, place, json_extract(payload, '$."' || field || '"') AS x FROM j),
e AS (SELECT *, json_type(x) AS t, CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE CAST(x AS VARCHAR) END AS raw, regexp_replace(lower(field), '[^\p{{L}}\p{{N}}]', '', 'g') AS n FROM v WHERE json_type(x) <> 'NULL'),
m AS (SELECT *, {names} AS c, nullif(CASE t WHEN 'ARRAY' THEN json_extract_string(x, '$[0]') WHEN 'OBJECT' THEN coalesce(json_extract_string(x, '$.href'), nullif(concat_ws(' ', json_extract_string(x, '$.amount'), json_extract_string(x, '$.unit')), '')) ELSE raw END, '') AS main,
  t NOT IN ('ARRAY', 'OBJECT') OR (t = 'ARRAY' AND json_array_length(x) = 1 AND json_type(x, '$[0]') NOT IN ('ARRAY', 'OBJECT')) AS whole FROM e WHERE raw <> ''),
o AS (SELECT *, c IS NOT NULL AND row_number() OVER (PARTITION BY rec_id, c ORDER BY field, place) = 1 AS first FROM m),
k AS (SELECT *, first AND ({bad}) AS failed FROM o),
g AS (SELECT rec_id, {cols}, coalesce(string_agg(field || '=' || raw, chr(10) ORDER BY field, place) FILTER (NOT (coalesce(first, false) AND whole AND main IS NOT NULL AND NOT coalesce(failed, false))), '') AS extras,
  coalesce(string_agg(c, ';' ORDER BY c) FILTER (failed), '') AS cast_failures FROM k GROUP BY rec_id)
SELECT r.rec_id, collector, session_file, pos, {', '.join(columns)}, CASE WHEN ok THEN coalesce(extras, '') END AS extras, CASE WHEN ok THEN coalesce(cast_failures, '') END AS cast_failures, ok AS readable
FROM (SELECT *, coalesce(json_valid(payload) AND json_type(payload) = 'OBJECT', false) AS ok FROM r) r LEFT JOIN g USING (rec_id)"""


ORACLE_SQL = {
    "p1_pages": _consistent_sql("products_html", {
        "market": "market,host,markethost,marketname,site", "category_page": "categorypage,listingpage,sourcepage,catpage,categoryurl,categorylink", "product_url": "producturl,url,itemurl,productlink,pageurl,link,href",
        "fetched_at": "fetchedat,fetched,timestamp,scrapedat,crawledat", "html": "html,rawhtml,body,pagehtml,content",
    }),
    "p1_listings": _consistent_sql("parsed_merged", {
        "market_name": "marketname,shop,market,shopname", "listing_title": "listingtitle,title,name,productname", "price": "price,cost,pricetext", "dosage": "dosage,strength,dose", "rating": "rating,stars,score", "review": "review,reviews", "description": "description,desc,details",
        "number_in_stocks": "numberinstocks,instock,stock,stockcount", "original_url": "originalurl,sourceurl,listingurl,productlink,href,producturl,url,link", "category_page": "categorypage,listingpage,categoryurl", "fetched_at": "fetchedat,fetched,timestamp,scrapedat,crawledat",
    }),
    "p2_found": _SURPLUS + "SELECT row_id FROM ranked WHERE n > 1",
    "p2_kept": _SURPLUS.replace("ORDER BY row_id", "ORDER BY regexp_extract(session_file, '(\\d{8}_\\d{6})', 1), row_id") + "SELECT row_id, market, product_url, fetched_at FROM ranked WHERE n IS NULL OR n = 1",
    "p7_reconciled": _PLACED + f""",
starts AS (SELECT file_id, coalesce(sum(size_bytes) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM landed_files),
g AS (SELECT CAST(floor((start + pos) / {SMALL_TARGET}) AS BIGINT) AS group_no, count(*) AS n FROM kept JOIN starts USING (file_id) GROUP BY 1)
SELECT group_no, n AS planned_records, n AS written_records FROM g""",
    "p7_found": _LAYOUT_OBJECTS + "SELECT file_id, rec_no FROM ranked WHERE n = 1 OR coalesce(url, '') = ''",
    "p7_groups": _LAYOUT_OBJECTS + f""",
kept AS (SELECT file_id, count(*) AS n FROM ranked WHERE n = 1 OR coalesce(url, '') = '' GROUP BY file_id),
plan AS (SELECT file_id, size_bytes, CAST(floor(coalesce(sum(size_bytes) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {compaction.TARGET_BYTES}) AS BIGINT) AS group_no FROM landed_files)
SELECT group_no, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_records FROM plan LEFT JOIN kept USING (file_id) GROUP BY group_no""",
}
