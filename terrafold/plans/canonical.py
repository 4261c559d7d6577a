"""Canonical tables over the test tables: places, prices, admissions, links, posts, policies, history, sources.

The definitions are SQL that Spark and other engines read alike; the operators on top are DataFrame code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _spot(key: str, step: int, span: int, start: float, gap: int) -> str:
    return f"CASE WHEN {key} % {gap} = 0 THEN NULL ELSE CAST({start} AS DOUBLE) + CAST(({key} * {step}) % {span} AS DOUBLE) / 1000 END"


TABLES = {
    "places": f"""
SELECT 'home:' || CAST(c_custkey AS STRING) AS id, 'residential' AS kind, c_name AS name, r_name AS district, {_spot("c_custkey", 37, 1500, 29.5, 7)} AS lat, {_spot("c_custkey", 53, 2100, 118.9, 7)} AS lng,
       CAST(NULL AS BOOLEAN) AS primary_school, c_mktsegment AS address, c_custkey % 5 = 0 AS has_candidate, CASE WHEN c_custkey % 5 = 0 THEN CAST((c_custkey * 31) % 1000 AS INT) END AS pool_rank,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN CAST(1980 + (c_custkey * 7) % 45 AS INT) END AS built_year, CAST((c_custkey * 13) % 9 AS BIGINT) AS post_count, CAST(NULL AS BIGINT) AS group_member_count
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'school:' || CAST(s_suppkey AS STRING), 'school', s_name, r_name, {_spot("s_suppkey", 37, 1500, 29.5, 9)}, {_spot("s_suppkey", 53, 2100, 118.9, 9)},
       s_acctbal > 0, CAST(NULL AS STRING), false, CAST(NULL AS INT), CAST(NULL AS INT), CAST((s_suppkey * 11) % 7 AS BIGINT), CAST(NULL AS BIGINT)
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'group:' || CAST(n_nationkey AS STRING), 'school_group', n_name, r_name, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN), CAST(NULL AS STRING), false, CAST(NULL AS INT), CAST(NULL AS INT), CAST(0 AS BIGINT), CAST(n_nationkey % 4 AS BIGINT)
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "prices": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, 'home:' || CAST(o_custkey AS STRING) AS entity_id, CASE l_returnflag WHEN 'A' THEN 'deal' WHEN 'N' THEN 'listing' ELSE 'reference' END AS kind,
       CASE WHEN l_linenumber % 2 = 0 THEN 'incremental-price:' || CAST(l_orderkey AS STRING) ELSE 'base' END AS source_id, CAST(o_orderdate AS DATE) AS event_date, CAST(l_shipdate AS DATE) AS observed_at,
       CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) END AS price_as_of, CAST(o_orderdate AS DATE) AS source_as_of, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS total_wan, l_quantity AS area_sqm,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_yuan_sqm, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS possible_duplicate,
       l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no, o_custkey AS cust_no
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0""",
    "admissions": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id, 'school:' || CAST(l_suppkey AS STRING) AS school_id, 'home:' || CAST(o_custkey AS STRING) AS home_id,
       CAST(year(l_shipdate) AS STRING) AS year, l_returnflag AS admission_type, l_linestatus = 'O' AS active
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "links": """
SELECT 'school:' || CAST(s_suppkey AS STRING) AS campus_id, 'school:' || CAST(s_suppkey + 1 AS STRING) AS official_school_id, CAST(1995 + s_suppkey % 7 AS STRING) AS year,
       CASE WHEN s_suppkey % 3 = 0 THEN 'documented_campus_affiliation' ELSE 'portal_coordinate_match' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST((s_suppkey * 17) % 200 AS DOUBLE) END AS distance_m
FROM supplier WHERE s_acctbal >= 3000
UNION ALL
SELECT 'school:' || CAST(s_suppkey AS STRING), 'school:' || CAST(s_suppkey + 2 AS STRING), '1998', CASE WHEN s_suppkey % 4 = 0 THEN 'documented_campus_affiliation' ELSE 'portal_coordinate_match' END, CAST((s_suppkey * 29) % 150 AS DOUBLE)
FROM supplier WHERE s_acctbal < 5000""",
    "posts": "SELECT CAST(doc_id AS STRING) AS id, substr(text, 1, 40) AS title, text AS description, lang AS district, 19000 + doc_id % 700 AS posted, doc_id % 4 = 0 AS deep_read FROM documents",
    "post_places": """
SELECT CAST(doc_id AS STRING) AS post_id, 'school:' || CAST(doc_id % 97 AS STRING) AS entity_id FROM labels
UNION ALL SELECT CAST(doc_id AS STRING), 'home:' || CAST((doc_id * 7) % 1400 AS STRING) FROM documents WHERE lang <> 'fr'
UNION ALL SELECT CAST(doc_id AS STRING), 'home:' || CAST((doc_id * 3) % 200 AS STRING) FROM labels WHERE quality = 1""",
    "policies": """
SELECT CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 13 = 0 THEN 'unknown' ELSE CAST(1995 + doc_id % 7 AS STRING) END AS year, CASE WHEN doc_id % 3 = 0 THEN 'local_policy_archive' ELSE 'service_area_text' END AS kind,
       'school:' || CAST(doc_id % 50 AS STRING) AS first_school, 'school:' || CAST(doc_id % 77 AS STRING) AS second_school
FROM documents""",
    "history": "SELECT event_id, 'home:' || CAST(user_id AS STRING) AS entity_id, CAST(ts AS DATE) AS snapshot_date, value AS price, props FROM events",
    "projects": """
SELECT CAST(p_partkey AS STRING) AS source_id, 'home:' || CAST((p_partkey * 7) % 1400 AS STRING) AS entity_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS developer, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS property_type,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS STRING) END AS units_raw, CASE WHEN p_partkey % 6 = 0 THEN '2001-' || CAST(10 + p_partkey % 3 AS STRING) END AS delivery_date_raw, CASE WHEN p_partkey % 8 = 0 THEN '2000-05' END AS opening_date_raw,
       CASE WHEN p_partkey % 2 = 0 THEN '在售' ELSE '售罄' END AS sales_status, CAST(1990 + p_partkey % 20 AS STRING) AS observed_at, p_name AS parking, CASE WHEN p_partkey % 9 = 0 THEN p_retailprice END AS amount
FROM part""",
    "snapshots": "SELECT CAST(event_id AS STRING) AS source_id, 'home:' || CAST(user_id * 3 AS STRING) AS entity_id, value AS reference_unit_yuan_sqm, CAST(CAST(ts AS DATE) AS STRING) AS source_as_of, CAST(NULL AS STRING) AS observed_at FROM events WHERE event_type = 'purchase'",
}


def sql(body: str) -> str:
    """body with the canonical tables that it names (and those that they name) put in front."""
    need, text = [], body
    while True:
        more = [t for t in TABLES if t not in need and re.search(rf"\b{t}\b", text)]
        if not more:
            break
        need += more
        text = " ".join(TABLES[t] for t in more)
    ctes = ", ".join(f"{t} AS ({TABLES[t]})" for t in TABLES if t in need)
    body = body.strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


class Tables:
    """The base and canonical tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name not in TABLES:
            raise AttributeError(name)
        text = TABLES[name]
        used = {t: self.base(t) for t in BASE if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
        text = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}", text)
        return self.spark.sql(text, **used)

    @property
    def entities(self) -> DataFrame:
        """places with the nested columns that queries over places use."""
        none = F.array().cast("array<string>")
        candidate = F.when(F.col("has_candidate"), F.struct(F.col("pool_rank").alias("rank"), "built_year", F.lit(None).cast("string").alias("plate"), F.lit(None).cast("string").alias("name")))
        return self.places.withColumns({"candidate": candidate, "aliases": none, "project_names": none}).drop("has_candidate", "pool_rank", "built_year")
