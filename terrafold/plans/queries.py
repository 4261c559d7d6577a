"""Registered queries of the place engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scope
from ..functions import article, geo, text, values
from ..operators import detail, importers, market, mentions, predicates, profile, relations, resolve, reviews, search, spatial, upsert
from ..operators.state import QueryState
from ..sources import publish, readers
from ..streaming import bundles
from .canonical import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ASIA = QueryState(district="ASIA", kind="residential", year="1998", primary_only=True, today="1998-08-02")


def query(oracle: str | None = None):
    """Register f(tables) under its name."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle)
        return f

    return put


# --- scans, filters, predicates ---


@query("SELECT id, name FROM places WHERE lat IS NOT NULL AND lng IS NOT NULL")
def q_scan_project(t):
    return t.places.where(geo.located(F.col("lat"), F.col("lng"))).select("id", "name")


@query("SELECT id, district FROM places WHERE district = 'ASIA' AND kind = 'residential'")
def q_district_filter(t):
    return t.places.where(predicates.district_is(ASIA, F.col("district")) & (F.col("kind") == "residential")).select("id", "district")


@query("SELECT DISTINCT entity_id FROM prices WHERE kind = 'deal' AND total_wan <= 20000 AND area_sqm >= 20 AND event_date >= DATE '1996-01-01' AND event_date <= DATE '1998-12-31'")
def q_price_same_row(t):
    s = ASIA.but(max_budget=20000.0, min_area=20.0, deal_from="1996-01-01", deal_to="1998-12-31")
    return t.prices.where(predicates.price_matches(s)).select("entity_id").distinct()


@query("""
WITH p AS (SELECT entity_id, bool_or(coalesce(total_wan <= 15000, true)) AS hit FROM prices WHERE kind = 'deal' GROUP BY entity_id)
SELECT id FROM places LEFT JOIN p ON id = entity_id WHERE kind = 'residential' AND coalesce(hit, true)""")
def q_unknown_retained(t):
    s = ASIA.but(max_budget=15000.0, include_unknown=True)
    return market.matching_homes(t.entities.where("kind = 'residential'"), t.prices, s)


@query("SELECT id, entity_id, line_no FROM prices WHERE CASE WHEN kind = 'deal' THEN event_date WHEN kind = 'reference' OR source_id LIKE 'incremental-price:%' THEN coalesce(price_as_of, source_as_of) ELSE observed_at END BETWEEN DATE '1998-07-03' AND DATE '1998-08-02'")
def q_fresh_30d(t):
    return t.prices.where(predicates.is_fresh(predicates.quote_date(), "1998-08-02")).select("id", "entity_id", "line_no")


@query("SELECT id FROM places WHERE lng BETWEEN 119.2 AND 119.9 AND lat BETWEEN 29.8 AND 30.4")
def q_bbox(t):
    return t.places.where(geo.inside(F.col("lat"), F.col("lng"), geo.rectangle((119.9, 29.8), (119.2, 30.4)))).select("id")


@query("SELECT kind, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM places WHERE kind <> 'school_group' GROUP BY kind")
def q_bounds(t):
    return t.places.where("kind <> 'school_group'").groupBy("kind").agg(*geo.bounds(F.col("lat"), F.col("lng")))


@query("SELECT id FROM places WHERE kind = 'residential' AND has_candidate AND built_year >= 2000")
def q_candidate_built(t):
    return market.matching_homes(t.entities.where("kind = 'residential'"), t.prices, ASIA.but(candidate_only=True, built_after=2000))


@query("SELECT school_id, home_id, count(*) AS n FROM admissions WHERE active AND year = '1998' AND admission_type = 'A' GROUP BY school_id, home_id")
def q_relation_matches(t):
    return t.admissions.where(predicates.relation_matches(ASIA.but(admission="A"))).groupBy("school_id", "home_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT CASE WHEN total_wan IS NULL THEN 'missing_price' WHEN possible_duplicate THEN 'possible_duplicate' WHEN area_sqm < 5 THEN 'too_small' WHEN event_date > observed_at THEN 'observed_before_event' END AS reason FROM prices)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def q_reject_reasons(t):
    reason = predicates.first_reason((F.col("total_wan").isNull(), "missing_price"), (F.col("possible_duplicate"), "possible_duplicate"), (F.col("area_sqm") < 5, "too_small"), (F.col("event_date") > F.col("observed_at"), "observed_before_event"))
    return importers.reason_counts(importers.split(t.prices, reason)[1])


@query("""
WITH r AS (SELECT kind, CASE WHEN supp_no = 7 THEN 'district_conflict_2011155836' WHEN possible_duplicate THEN 'possible_duplicate_unresolved' END AS reason FROM prices)
SELECT kind, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY kind, coalesce(reason, 'accepted')""")
def q_quarantine_split(t):
    community = F.when(F.col("supp_no") == 7, scope.CONFLICTING_PROJECT).otherwise(F.col("supp_no").cast("string"))
    key = values.project_key(F.lit(f"https://{scope.PROJECT_HOST}{scope.PROJECT_PATH}"), community, F.lit("x"))
    reason = predicates.quarantine_reason(key, F.when(F.col("possible_duplicate"), "group"))
    return t.prices.groupBy("kind", F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_id, amount FROM projects WHERE amount > 0")
def q_project_price_acceptance(t):
    price = F.struct(F.col("amount"), F.lit(False).alias("font_encoded"), F.lit(None).cast("double").alias("amount_high"), F.lit(scope.UNIT_PRICES[0]).alias("unit"), F.lit("sale").alias("price_type"))
    return t.projects.withColumn("price", price).where(predicates.accepted_project_price()).select("source_id", "amount")


@query("""
SELECT CASE WHEN year = '1998' THEN 'current' ELSE 'other' END AS policy_group, count(*) AS n FROM policies
WHERE year = '1998' OR (kind = 'local_policy_archive' AND year <> 'unknown' AND year <> '1998') GROUP BY 1""")
def q_policy_groups(t):
    return search.policy_groups(t.policies, "1998").groupBy(F.col("group").alias("policy_group")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM places WHERE kind = 'residential' AND lat IS NOT NULL AND trim(name) <> '' AND id NOT IN (SELECT entity_id FROM post_places)")
def q_context_homes(t):
    return search.context_homes(t.entities, t.post_places.select(F.col("entity_id").alias("id")), ASIA).select("id")


# --- joins ---


@query("""
WITH m AS (SELECT c.cat, p.name, count(DISTINCT p.id) AS n FROM (SELECT 'supplier' AS cat, name FROM places WHERE kind = 'school' UNION ALL SELECT 'none', 'Nobody ' || name FROM places WHERE kind = 'school') c LEFT JOIN places p ON p.kind = 'school' AND p.name = c.name GROUP BY c.cat, c.name, p.name)
SELECT cat AS source, CASE WHEN n = 1 THEN 'matched' ELSE 'unmatched' END AS outcome, count(*) AS n FROM m GROUP BY 1, 2""")
def q_resolve_status(t):
    schools = t.entities.where("kind = 'school'")
    none = F.array().cast("array<string>")
    known = schools.select(F.lit("supplier").alias("source"), F.col("id").alias("record"), "name", "kind", "district", none.alias("aliases"))
    odd = schools.select(F.lit("none").alias("source"), F.col("id").alias("record"), F.concat(F.lit("Nobody "), "name").alias("name"), "kind", "district", none.alias("aliases"))
    r = resolve.resolve(known.unionByName(odd), schools)
    outcome = F.when(F.col("status").isin("name_match_review_required", "same_name_unlocated"), "matched").otherwise(F.col("status"))
    return r.groupBy("source", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH k AS (SELECT p_name AS name, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_name)
SELECT CASE WHEN n = 1 THEN 'one' ELSE 'ambiguous' END AS outcome, count(*) AS records FROM k GROUP BY 1""")
def q_resolve_ambiguous(t):
    none = F.array().cast("array<string>")
    cat = t.part.select(F.concat(F.lit("osm:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("residential").alias("kind"), F.col("p_name").alias("name"), F.lit("x").alias("district"), F.lit(30.0).alias("lat"), none.alias("aliases"))
    records = t.part.select(F.lit("s").alias("source"), F.col("p_name").alias("record"), F.col("p_name").alias("name"), F.lit("residential").alias("kind"), F.lit(None).cast("string").alias("district"), none.alias("aliases")).distinct()
    r = resolve.resolve(records, cat)
    return r.groupBy(F.when(F.col("status") == "ambiguous", "ambiguous").otherwise("one").alias("outcome")).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT post_id, entity_id FROM post_places WHERE entity_id IN (SELECT id FROM places) AND post_id IN (SELECT id FROM posts WHERE deep_read)")
def q_semi_mentions(t):
    return detail.known_mentions(t.post_places, t.places, t.posts.where("deep_read"))


@query("""
SELECT id FROM places s WHERE kind = 'school' AND (lat IS NOT NULL OR NOT EXISTS (
  SELECT 1 FROM links l JOIN places c ON c.id = l.campus_id AND c.lat IS NOT NULL WHERE l.official_school_id = s.id AND l.year = '1998' AND l.kind = 'portal_coordinate_match'))""")
def q_anti_shadow(t):
    return relations.shadowed(t.entities.where("kind = 'school'"), t.links, "1998").select("id")


_HAVERSINE = "2.0 * 6371000 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lng) - radians({a}.lng)) / 2), 2))))"
_DIST = "CAST(round_even(" + _HAVERSINE + ", 0) AS BIGINT)"


@query(f"""
WITH d AS (SELECT a.id, b.id AS entity_id, {_DIST.format(a="a", b="b")} AS distance FROM places a JOIN places b ON abs(a.lat - b.lat) <= 0.019 AND abs(a.lng - b.lng) <= 0.023
  WHERE (a.kind = 'residential' AND b.kind = 'school' AND b.primary_school) OR (a.kind = 'school' AND b.kind = 'residential'))
SELECT id, entity_id, distance FROM d WHERE distance <= 2000""")
def q_nearby2000(t):
    return spatial.nearby(t.places)


@query(f"""
WITH h AS (SELECT id, district, lat + 0.0005 AS lat, lng - 0.0006 AS lng FROM places WHERE kind = 'school'),
d AS (SELECT h.id, s.id AS school_id, {_DIST.format(a="h", b="s")} AS distance FROM h JOIN places s ON s.kind = 'school' AND s.district = h.district)
SELECT id, school_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, school_id) AS rn FROM d WHERE distance <= 180) x WHERE rn = 1""")
def q_nearest180(t):
    schools = t.places.where("kind = 'school'")
    points = schools.withColumns({"lat": F.col("lat") + 0.0005, "lng": F.col("lng") - 0.0006})
    return spatial.nearest_school(points, schools)


@query("SELECT DISTINCT campus_id AS id, official_school_id AS canonical_id FROM links WHERE year = '1998' UNION SELECT id, id FROM places WHERE kind = 'school'")
def q_campus_year(t):
    return relations.canonical_ids(t.links, t.places.where("kind = 'school'").select("id"), "1998")


@query("SELECT DISTINCT official_school_id AS id, campus_id FROM links WHERE year = '1998'")
def q_campus_ids(t):
    return relations.campus_ids(t.links, t.links.select(F.col("official_school_id").alias("id")).distinct(), "1998")


@query("""
WITH own AS (SELECT DISTINCT school_id AS id FROM admissions WHERE active AND year = '1998' AND admission_type = 'R')
SELECT id FROM own UNION SELECT campus_id FROM links WHERE year = '1998' AND kind <> 'documented_campus_affiliation' AND official_school_id IN (SELECT id FROM own)""")
def q_admission_schools(t):
    return relations.admission_school_ids(t.admissions, t.links, ASIA.but(admission="R"))


@query("""
WITH own AS (SELECT DISTINCT school_id AS id FROM admissions WHERE active AND year = '1998'),
k AS (SELECT campus_id AS id, bool_or(kind = 'documented_campus_affiliation') AS aff, bool_or(kind <> 'documented_campus_affiliation') AS other FROM links WHERE year = '1998' GROUP BY campus_id)
SELECT s.id FROM places s LEFT JOIN own ON own.id = s.id LEFT JOIN k ON k.id = s.id WHERE s.kind = 'school' AND (own.id IS NOT NULL OR s.primary_school) AND (own.id IS NOT NULL OR NOT coalesce(aff, false) OR coalesce(other, false))""")
def q_direct_schools(t):
    years = t.places.where("kind = 'school' and primary_school").select("id", F.lit("1998").alias("year"))
    return relations.direct_school_ids(t.places.where("kind = 'school'"), years, t.admissions, t.links, "1998")


@query("""
WITH homes AS (SELECT DISTINCT entity_id FROM prices WHERE kind = 'deal' AND total_wan <= 12000),
own AS (SELECT DISTINCT school_id AS id FROM admissions WHERE active AND year = '1998' AND home_id IN (SELECT entity_id FROM homes))
SELECT id FROM own UNION SELECT campus_id FROM links WHERE year = '1998' AND kind <> 'documented_campus_affiliation' AND official_school_id IN (SELECT id FROM own)""")
def q_school_propagate(t):
    s = ASIA.but(max_budget=12000.0)
    homes = market.matching_homes(t.entities.where("kind = 'residential'"), t.prices, s)
    admitted = t.admissions.join(homes.withColumnRenamed("id", "home_id"), "home_id", "left_semi")
    return relations.admission_school_ids(admitted, t.links, s)


@query("""
WITH c AS (SELECT l.official_school_id, l.campus_id, row_number() OVER (PARTITION BY l.official_school_id ORDER BY l.distance_m NULLS LAST, l.campus_id) AS rn
  FROM links l JOIN places p ON p.id = l.campus_id WHERE p.lat IS NOT NULL AND l.kind = 'portal_coordinate_match' AND l.year = '1998')
SELECT official_school_id, campus_id FROM c WHERE rn = 1""")
def q_physical_campus(t):
    return relations.physical_campus(t.links, t.places, "1998")


@query("""
WITH a AS (SELECT DISTINCT * FROM admissions WHERE active AND year = '1998'),
canon AS (SELECT 'school:30' AS id, 'school:30' AS cid UNION SELECT campus_id, official_school_id FROM links WHERE campus_id = 'school:30' AND year = '1998' UNION SELECT 'home:44', 'home:44')
SELECT canon.id AS place, a.id AS admission, school_id, home_id FROM a JOIN canon ON cid = school_id UNION SELECT canon.id, a.id, school_id, home_id FROM a JOIN canon ON canon.id = home_id""")
def q_related_admissions(t):
    ids = t.places.where(F.col("id").isin("school:30", "home:44")).select("id")
    a = t.admissions.withColumnRenamed("id", "admission").dropDuplicates()
    r = relations.related_admissions(a, t.links, ids, ASIA)
    return r.select(F.col("id").alias("place"), "admission", "school_id", "home_id").distinct()


@query("""
WITH pc AS (SELECT entity_id, count(*) AS post_count FROM post_places GROUP BY entity_id),
pr AS (SELECT entity_id, count(*) FILTER (WHERE kind = 'deal') AS deals, count(*) FILTER (WHERE kind = 'listing') AS listings, count(*) FILTER (WHERE kind = 'reference') AS refs FROM prices GROUP BY entity_id),
pj AS (SELECT entity_id, count(*) AS project_count FROM projects GROUP BY entity_id)
SELECT id, coalesce(pc.post_count, 0) AS post_count, coalesce(deals, 0) AS deals, coalesce(listings, 0) AS listings, coalesce(refs, 0) AS refs, coalesce(project_count, 0) AS project_count
FROM places LEFT JOIN pc ON id = pc.entity_id LEFT JOIN pr ON id = pr.entity_id LEFT JOIN pj ON id = pj.entity_id WHERE kind = 'residential'""")
def q_left_agg_bootstrap(t):
    kinds = {"deals": ("prices", "deal"), "listings": ("prices", "listing"), "refs": ("prices", "reference")}
    return detail.place_counts(t.places.where("kind = 'residential'"), {"post_count": t.post_places, "prices": t.prices, "project_count": t.projects}, kinds)


@query("""
WITH d AS (SELECT id, max(entity_id) AS entity_id, max(event_date) AS event_date, max(area_sqm) AS area, max(total_wan) AS total, count(*) AS copies FROM prices WHERE kind = 'deal' GROUP BY id),
k AS (SELECT *, count(*) OVER (PARTITION BY entity_id, event_date, area) AS peers FROM d)
SELECT CASE WHEN peers > 1 THEN 'ambiguous_loaded_business_key' WHEN total IS NOT NULL THEN 'price_already_complete' ELSE 'accepted' END AS reason, count(*) AS n FROM k GROUP BY 1""")
def q_enrichment_match(t):
    d = t.prices.where("kind = 'deal'").groupBy("id").agg(F.max("entity_id").alias("community_source_id"), F.max("event_date").alias("event_date"), F.max("area_sqm").alias("area_sqm"), F.max("total_wan").alias("total_wan"))
    fixed = {c: F.lit("x") for c in ("district", "community", "layout", "orientation")}
    deals = d.withColumns(fixed | {"unit_yuan_sqm": F.col("total_wan"), "possible_duplicate": F.lit(False), "used_record_id": F.lit(None).cast("string")})
    cand = d.withColumns(fixed | {"unit_yuan_sqm": F.col("total_wan"), "target_id": F.col("id"), "source_record_id": F.col("id")}).drop("id")
    got = importers.match_enrichments(cand, deals)
    return got.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS ids, sha256(CAST(to_json(list_sort(list(o_orderkey::VARCHAR))) AS VARCHAR)) AS digest FROM orders WHERE o_custkey = 44")
def q_id_set_lock(t):
    return t.orders.where("o_custkey = 44").agg(values.id_set_lock(F.col("o_orderkey").cast("string")).alias("l")).select(F.col("l.count").alias("ids"), F.col("l.sha256").alias("digest"))


@query("""
SELECT campus_id, official_school_id, year FROM links l WHERE EXISTS (SELECT 1 FROM places p WHERE p.id = l.official_school_id AND p.lat IS NOT NULL)
UNION SELECT l.campus_id, l.official_school_id, l.year FROM links l JOIN links k ON k.official_school_id = l.official_school_id AND k.year = l.year JOIN places p ON p.id = k.campus_id AND p.lat IS NOT NULL""")
def q_exists_or(t):
    records = t.links.select("campus_id", F.col("official_school_id").alias("official_id"), "year")
    return relations.exists_directly_or_by_campus(records, t.links, t.places).select("campus_id", F.col("official_id").alias("official_school_id"), "year")


@query("SELECT DISTINCT p.id AS policy_id, s.id FROM policies p JOIN places s ON s.id IN (p.first_school, p.second_school) WHERE s.kind = 'school' AND s.primary_school")
def q_policy_array(t):
    policies = t.policies.select("id", F.array("first_school", "second_school").alias("school_ids"))
    return search.policies_for(policies, t.places.where("kind = 'school' and primary_school")).select("policy_id", "id")


@query("SELECT id, CASE WHEN id = 'home:5' THEN 'home:6' WHEN id = 'home:10' THEN 'home:11' ELSE id END AS target FROM places WHERE kind = 'residential'")
def q_repoint(t):
    homes = t.places.where("kind = 'residential'").select("id", F.col("id").alias("target"))
    moves = t.places.where(F.col("id").isin("home:5", "home:10")).select("id", F.when(F.col("id") == "home:5", "home:6").otherwise("home:11").alias("target"))
    return upsert.repoint(homes, moves, "id", "target")


@query("""
SELECT id, pool_rank, CASE WHEN built_year = 2001 THEN 1 ELSE 0 END AS n_applied, CASE WHEN built_year = 2001 THEN -1 ELSE built_year END AS built_year FROM places WHERE has_candidate""")
def q_compare_and_set(t):
    target = t.places.where("has_candidate").select("id", "pool_rank", "built_year")
    changes = target.where("built_year = 2001").withColumn("new_built_year", F.lit(-1))
    return upsert.compare_and_set(target, changes, ("id", "pool_rank", "built_year"), ("built_year",))


@query("SELECT s.id AS school, h.id AS home, CASE WHEN h.name = 'Customer#000000010' THEN true ELSE false END AS exact_name FROM places s JOIN places h ON h.kind = 'residential' AND s.kind = 'school' AND s.post_count = 6 AND h.id IN ('home:10', 'home:11') AND s.id IN ('school:5', 'school:12')")
def q_identity_basis(t):
    s = t.places.where("kind = 'school' and post_count = 6").where(F.col("id").isin("school:5", "school:12")).select(F.col("id").alias("school"))
    h = t.places.where(F.col("id").isin("home:10", "home:11")).select(F.col("id").alias("home"), "name")
    ok = resolve.identity_basis(F.lit("exact"), F.col("name"), F.lit("Ｃustomer# 000000010"), F.array(F.lit("x")), F.lit(""))
    return s.crossJoin(h).select("school", "home", ok.alias("exact_name"))


# --- aggregations, windows, sorting ---

_DEALS = "SELECT entity_id AS id, count(*) AS deal_count, count(unit_yuan_sqm) AS priced_count, CAST(floor(median(unit_yuan_sqm) + 0.5) AS BIGINT) AS median_unit, CAST(round(sum(CAST(total_wan AS DECIMAL(18,2))), 1) AS DOUBLE) AS total_wan, CAST(max(event_date) AS STRING) AS latest_date, CAST(min(event_date) AS STRING) AS earliest_date FROM prices WHERE kind = 'deal' AND NOT possible_duplicate AND event_date >= DATE '1995-01-01' AND event_date <= DATE '1999-12-31' GROUP BY entity_id"
_RANKED = "WITH d AS (" + _DEALS + "), r AS (SELECT p.name, d.* FROM places p JOIN d ON d.id = p.id WHERE p.district = 'ASIA' AND p.kind = 'residential') SELECT id, deal_count, priced_count, median_unit, total_wan, latest_date, earliest_date, row_number() OVER (ORDER BY {order}, name, id) AS rank FROM r"


def _ranking(t: Tables, metric: str) -> DataFrame:
    s = ASIA.but(deal_from="1995-01-01", deal_to="1999-12-31")
    homes = search.matching_entities(t.entities, t.admissions, t.links, t.prices, s.but(deal_from=None, deal_to=None))
    r = market.ranking(homes, t.prices, s, metric)
    # The median is compared as a whole number: an odd count's middle value is not rounded, see the unit tests.
    return r.select("id", "deal_count", "priced_count", F.floor(F.col("median_unit") + 0.5).alias("median_unit"), "total_wan", F.col("latest_date").cast("string").alias("latest_date"), F.col("earliest_date").cast("string").alias("earliest_date"), "rank")


@query(_RANKED.format(order="deal_count DESC, deal_count DESC, latest_date DESC NULLS LAST"))
def q_ranking_count(t):
    return _ranking(t, "count")


@query(_RANKED.format(order="latest_date DESC NULLS LAST, deal_count DESC"))
def q_ranking_latest(t):
    return _ranking(t, "latest")


@query(_RANKED.format(order="coalesce(nullif(total_wan, 0), -1) DESC, deal_count DESC, latest_date DESC NULLS LAST"))
def q_ranking_total(t):
    return _ranking(t, "total")


@query("SELECT id, deal_count, priced_count, median_unit FROM (" + _DEALS + ") d WHERE id IN (SELECT id FROM places WHERE district = 'ASIA')")
def q_ranking_unit(t):
    return _ranking(t, "unit").select("id", "deal_count", "priced_count", "median_unit")


@query("""
SELECT entity_id, count(*) AS deals, count(unit_yuan_sqm) AS priced, count(*) - count(unit_yuan_sqm) AS missing, count(*) FILTER (WHERE possible_duplicate) AS duplicates,
       round(min(unit_yuan_sqm) FILTER (WHERE NOT possible_duplicate), 4) AS low, round(max(unit_yuan_sqm) FILTER (WHERE NOT possible_duplicate), 4) AS high, CAST(max(event_date) AS STRING) AS latest
FROM prices WHERE kind = 'deal' AND event_date >= DATE '1997-01-01' AND event_date <= DATE '1998-12-31' GROUP BY entity_id""")
def q_market_summary(t):
    r = market.market_summary(t.prices, ASIA.but(deal_from="1997-01-01", deal_to="1998-12-31"), ["entity_id"])
    return r.withColumns({"low": F.round("low", 4), "high": F.round("high", 4), "latest": F.col("latest").cast("string")})


@query("SELECT school_id, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE NOT active) AS historical, count(DISTINCT year) AS years, count(DISTINCT home_id) AS homes FROM admissions GROUP BY school_id")
def q_group_active_hist(t):
    return detail.active_members(t.admissions, "school_id", "home_id").withColumnRenamed("members", "homes")


@query("""
SELECT kind, count(*) FILTER (WHERE total_wan > 0 AND unit_yuan_sqm > 0) AS fully_priced, count(*) FILTER (WHERE NOT coalesce(total_wan > 0 AND unit_yuan_sqm > 0, false)) AS incomplete,
       CAST(max(event_date) FILTER (WHERE total_wan > 0 AND unit_yuan_sqm > 0) AS STRING) AS latest_full FROM prices GROUP BY kind""")
def q_completeness(t):
    return detail.completeness(t.prices).withColumn("latest_full", F.col("latest_full").cast("string"))


@query("SELECT kind, possible_duplicate AS dup, count(*) AS n, count(DISTINCT entity_id) AS places FROM prices GROUP BY kind, possible_duplicate")
def q_group_counts(t):
    return detail.group_counts(t.prices.withColumnRenamed("possible_duplicate", "dup"), ["kind", "dup"], "entity_id", "places")


@query("SELECT entity_id, CAST(floor(median(area_sqm) + 0.5) AS BIGINT) AS median_area FROM prices GROUP BY entity_id")
def q_median_even_rounded(t):
    return t.prices.groupBy("entity_id").agg(F.floor(values.median(F.col("area_sqm")) + 0.5).alias("median_area"))


@query("SELECT entity_id, CAST(floor(avg(area_sqm) + 0.5) AS BIGINT) AS average, min(area_sqm) AS low, max(area_sqm) AS high, count(*) AS n FROM prices WHERE area_sqm > 0 GROUP BY entity_id")
def q_sample_price(t):
    return t.prices.groupBy("entity_id").agg(*market.sample_price(F.col("area_sqm")))


@query("SELECT a.id AS id, order_no, line_no, part_no, supp_no FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part_no, supp_no, area_sqm, total_wan NULLS FIRST) AS rn FROM prices) a WHERE rn = 1")
def q_upsert_first(t):
    return upsert.first_wins(t.prices, ["id"], [F.col(c) for c in ("part_no", "supp_no", "area_sqm", "total_wan")]).select("id", "order_no", "line_no", "part_no", "supp_no")


@query("SELECT a.id AS id, part_no, supp_no FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part_no DESC, supp_no DESC, area_sqm DESC, total_wan DESC NULLS LAST) AS rn FROM prices) a WHERE rn = 1")
def q_upsert_last(t):
    return upsert.last_wins(t.prices, ["id"], [F.col(c) for c in ("part_no", "supp_no", "area_sqm", "total_wan")]).select("id", "part_no", "supp_no")


@query("SELECT count(*) AS added FROM (SELECT DISTINCT id FROM prices WHERE kind = 'deal' EXCEPT SELECT id FROM prices WHERE kind = 'listing') x")
def q_insert_or_ignore_count(t):
    p = t.prices
    return upsert.inserted(p.where("kind = 'listing'"), p.where("kind = 'deal'"), ["id"], [F.col("part_no"), F.col("supp_no")]).agg(F.count(F.lit(1)).alias("added"))


@query("SELECT entity_id, CAST(snapshot_date AS STRING) AS snapshot_date, event_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, snapshot_date ORDER BY event_id DESC) AS rn FROM history) x WHERE rn = 1")
def q_latest_per_day(t):
    r = market.latest_per_day(t.history, ["entity_id", "snapshot_date"], [F.desc("event_id")])
    return r.select("entity_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), "event_id")


@query("SELECT entity_id, count(*) AS points, min(price) AS low, max(price) AS high, CAST(min(snapshot_date) AS STRING) AS first_day, CAST(max(snapshot_date) AS STRING) AS last_day FROM history WHERE price > 0 AND snapshot_date <= DATE '2024-01-20' GROUP BY entity_id HAVING count(*) >= 8")
def q_history_trend(t):
    r = market.history_trend(t.history, "2024-01-20")
    return r.select("entity_id", "points", "low", "high", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


@query("""
WITH own AS (SELECT DISTINCT school_id AS id FROM admissions WHERE active AND year = '1998'),
off AS (SELECT id FROM own UNION SELECT campus_id FROM links WHERE year = '1998' AND kind <> 'documented_campus_affiliation' AND official_school_id IN (SELECT id FROM own)),
m AS (SELECT * FROM places WHERE district = 'EUROPE'),
k AS (SELECT * FROM m WHERE lat IS NOT NULL OR id NOT IN (SELECT official_school_id FROM links WHERE year = '1998' AND kind = 'portal_coordinate_match' AND campus_id IN (SELECT id FROM m WHERE lat IS NOT NULL)))
SELECT id, row_number() OVER (ORDER BY CASE WHEN kind = 'school_group' THEN 0 ELSE 1 END, coalesce(group_member_count, 0) DESC, CASE WHEN id IN (SELECT id FROM off) THEN 0 ELSE 1 END, CASE WHEN has_candidate THEN 0 ELSE 1 END, coalesce(pool_rank, 9999), coalesce(post_count, 0) DESC, name, id) AS ord
FROM k""")
def q_priority_sort_topk(t):
    return search.query_entities(t.entities, t.admissions, t.links, t.prices, ASIA.but(district="EUROPE", kind="all", primary_only=False)).select("id", "ord")


@query("""
WITH h AS (SELECT id, posted, deep_read FROM posts WHERE contains(lower(description), 'the ') OR contains(lower(title), 'the ')),
n AS (SELECT count(*) AS total FROM h)
SELECT id, total FROM (SELECT h.id, n.total, row_number() OVER (ORDER BY deep_read DESC, posted DESC, h.id) AS rn FROM h, n) x WHERE rn <= 5000""")
def q_post_search_total(t):
    return search.search_posts(t.posts, "THE ").select("id", "total")


@query("SELECT id, row_number() OVER (ORDER BY id) AS row FROM places WHERE contains(lower(name), 'customer#0000001') QUALIFY row BETWEEN 41 AND 80")
def q_paging(t):
    s = t.places.select("id", F.col("name").alias("label"), F.lit("").alias("notes"), F.lit("").alias("url"), F.lit("").alias("source_as_of"), F.lit("").alias("observed_at"), F.lit("").alias("kind"))
    return search.source_page(s, "Customer#0000001", 2).select("id", "row")


@query("""
WITH o AS (SELECT DISTINCT home_id AS id FROM admissions WHERE active AND year = '1998'),
p AS (SELECT s.id AS selected_id, e.id, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN e.lat IS NOT NULL THEN 0 ELSE 1 END, e.post_count DESC NULLS LAST, e.name, e.id) AS rank
  FROM places s JOIN places e ON e.district = s.district AND e.kind = 'residential' AND e.id IN (SELECT id FROM o) WHERE s.kind = 'school')
SELECT selected_id, rank, id FROM p WHERE rank <= 8""")
def q_district_fallback(t):
    homes = t.admissions.where(predicates.relation_matches(ASIA)).select(F.col("home_id").alias("id")).distinct().join(t.places.where("kind = 'residential'").select("id"), "id", "left_semi")
    return relations.district_fallback(t.places, homes, t.places.where("kind = 'school'").select("id")).select("selected_id", "rank", "id")


# --- composite ---

_TIERS = """
WITH sel AS (SELECT id FROM places WHERE kind = 'school'), a AS (SELECT DISTINCT * FROM admissions WHERE active AND year = '1998' AND admission_type = 'A'),
canon AS (SELECT id AS selected_id, id AS school_id FROM sel UNION SELECT campus_id, official_school_id FROM links WHERE year = '1998'),
via AS (SELECT campus_id AS selected_id, official_school_id AS school_id, bool_and(kind = 'documented_campus_affiliation') AS only_aff FROM links WHERE year = '1998' GROUP BY 1, 2),
adm AS (SELECT c.selected_id, CASE WHEN c.school_id <> c.selected_id AND coalesce(v.only_aff, false) THEN 'affiliation' ELSE 'official' END AS tier, a.home_id AS id, a.id AS k
  FROM canon c JOIN sel ON sel.id = c.selected_id JOIN a ON a.school_id = c.school_id LEFT JOIN via v ON v.selected_id = c.selected_id AND v.school_id = c.school_id),
co AS (SELECT s.entity_id AS selected_id, 'co' AS tier, h.entity_id AS id, s.post_id AS k FROM post_places s JOIN post_places h ON h.post_id = s.post_id WHERE s.entity_id LIKE 'school:%' AND h.entity_id LIKE 'home:%'),
nr AS (SELECT a.id AS selected_id, 'nearby' AS tier, b.id AS id, '' AS k FROM places a JOIN places b ON abs(a.lat - b.lat) <= 0.019 AND abs(a.lng - b.lng) <= 0.023 WHERE a.kind = 'school' AND b.kind = 'residential' AND """ + _DIST.format(a="a", b="b") + """ <= 2000),
i AS (SELECT u.selected_id, u.tier, u.id, count(DISTINCT u.k) AS rows FROM (SELECT * FROM adm UNION ALL SELECT * FROM co UNION ALL SELECT * FROM nr) u JOIN places p ON p.id = u.id AND p.kind = 'residential' WHERE u.selected_id IN (SELECT id FROM sel) GROUP BY 1, 2, 3)
"""


_NEAR = """near AS (SELECT a.id, b.id AS entity_id, """ + _DIST.format(a="a", b="b") + """ AS distance FROM places a JOIN places b ON abs(a.lat - b.lat) <= 0.019 AND abs(a.lng - b.lng) <= 0.023
  WHERE ((a.kind = 'residential' AND b.kind = 'school' AND b.primary_school) OR (a.kind = 'school' AND b.kind = 'residential')) AND """ + _DIST.format(a="a", b="b") + " <= 2000), "


def _items(t: Tables) -> tuple[DataFrame, DataFrame]:
    selected = t.places.where("kind = 'school'").select("id")
    s = ASIA.but(admission="A")
    places = t.post_places
    co = places.where("entity_id like 'school:%'").select("post_id", F.col("entity_id").alias("a")).join(places.where("entity_id like 'home:%'").select("post_id", F.col("entity_id").alias("b")), "post_id")
    return relations.relation_items(t.places, t.admissions, t.links, co, spatial.nearby(t.places), selected, s), selected


@query(_TIERS + "SELECT selected_id, tier, id, rows FROM i")
def q_relation_items(t):
    return _items(t)[0].select("selected_id", "tier", "id", "rows")


@query(_TIERS + """, b AS (SELECT selected_id, min(CASE tier WHEN 'official' THEN 1 WHEN 'affiliation' THEN 2 WHEN 'co' THEN 3 ELSE 4 END) AS o FROM i GROUP BY 1)
SELECT sel.id AS selected_id, CASE b.o WHEN 1 THEN 'official' WHEN 2 THEN 'affiliation' WHEN 3 THEN 'co' WHEN 4 THEN 'nearby' ELSE 'none' END AS tier, count(i.id) AS items, coalesce(b.o, 0) <> 1 AS fallback
FROM sel LEFT JOIN b ON b.selected_id = sel.id LEFT JOIN i ON i.selected_id = sel.id AND CASE i.tier WHEN 'official' THEN 1 WHEN 'affiliation' THEN 2 WHEN 'co' THEN 3 ELSE 4 END = b.o GROUP BY 1, 2, 4""")
def q_relation_tiers(t):
    items, selected = _items(t)
    return relations.relation_plan(items, t.places, selected).select("selected_id", "tier", F.col("items").cast("long").alias("items"), "fallback")


_WATERFALL = """
WITH s AS (SELECT entity_id, arg_max(reference_unit_yuan_sqm, (coalesce(source_as_of, ''), reference_unit_yuan_sqm)) AS v FROM snapshots WHERE reference_unit_yuan_sqm > 0 GROUP BY 1),
j AS (SELECT entity_id, arg_max(amount, (observed_at, amount)) AS v FROM projects WHERE amount > 0 GROUP BY 1),
c AS (SELECT entity_id, kind, floor(avg(unit_yuan_sqm) + 0.5) AS v, count(*) AS n FROM prices WHERE kind IN ('listing', 'deal') AND NOT possible_duplicate AND unit_yuan_sqm > 0 GROUP BY 1, 2),
w AS (SELECT p.id, CASE WHEN s.v IS NOT NULL THEN 'snapshot' WHEN j.v IS NOT NULL THEN 'project' WHEN l.v IS NOT NULL THEN 'listing' WHEN d.v IS NOT NULL THEN 'deal' END AS basis, CAST(coalesce(s.v, j.v, l.v, d.v) AS DOUBLE) AS value,
  CASE WHEN s.v IS NOT NULL OR j.v IS NOT NULL THEN 1 WHEN l.v IS NOT NULL THEN l.n ELSE d.n END AS n
  FROM places p LEFT JOIN s ON s.entity_id = p.id LEFT JOIN j ON j.entity_id = p.id LEFT JOIN c l ON l.entity_id = p.id AND l.kind = 'listing' LEFT JOIN c d ON d.entity_id = p.id AND d.kind = 'deal' WHERE p.kind = 'residential')
"""


def _waterfall(t: Tables) -> DataFrame:
    project = t.projects.where("amount > 0").select("entity_id", "amount", F.lit(None).cast("string").alias("price_as_of"), "observed_at")
    return profile.price_waterfall(t.places.where("kind = 'residential'"), t.snapshots, project, t.prices)


@query(_WATERFALL + "SELECT id, basis, value, n FROM w")
def q_profile_waterfall(t):
    return _waterfall(t).select("id", "basis", "value", "n")


@query(_WATERFALL + """, pj AS (SELECT *, (CASE WHEN developer IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN property_type IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN units_raw IS NOT NULL THEN 1 ELSE 0 END)
  + (CASE WHEN delivery_date_raw IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN opening_date_raw IS NOT NULL THEN 1 ELSE 0 END) + 1 AS score FROM projects),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, observed_at DESC, source_id DESC) AS rn FROM pj) x WHERE rn = 1),
agreed AS (SELECT entity_id, CASE WHEN count(DISTINCT developer) = 1 THEN max(developer) END AS developer, CASE WHEN count(DISTINCT property_type) = 1 THEN max(property_type) END AS property_type, CASE WHEN count(DISTINCT units_raw) = 1 THEN max(units_raw) END AS units_raw,
  CASE WHEN count(DISTINCT delivery_date_raw) = 1 THEN max(delivery_date_raw) END AS delivery, CASE WHEN count(DISTINCT opening_date_raw) = 1 THEN max(opening_date_raw) END AS opening FROM projects GROUP BY entity_id),
f AS (SELECT p.id, p.address, CAST(p.built_year AS STRING) AS built_year, coalesce(b.developer, a.developer) AS developer, coalesce(b.property_type, a.property_type) AS property_type, coalesce(b.units_raw, a.units_raw) AS units, coalesce(b.delivery_date_raw, a.delivery) AS delivery,
  coalesce(b.opening_date_raw, a.opening) AS opening, b.parking, coalesce(b.sales_status = '在售', false) AS selling FROM places p LEFT JOIN best b ON b.entity_id = p.id LEFT JOIN agreed a ON a.entity_id = p.id WHERE p.kind = 'residential'),
g AS (SELECT f.*, CASE WHEN selling AND opening IS NOT NULL THEN opening ELSE coalesce(delivery, opening) END AS timing, w.value FROM f JOIN w ON w.id = f.id),
k AS (SELECT *, (address IS NOT NULL)::INT + (built_year IS NOT NULL)::INT + (developer IS NOT NULL)::INT + (property_type IS NOT NULL)::INT + (units IS NOT NULL)::INT + (parking IS NOT NULL)::INT + (timing IS NOT NULL)::INT + coalesce((value > 0)::INT, 0) AS known FROM g)
SELECT id, developer, timing, known, 18 - known AS missing, CAST(floor((18 - known) / 18.0 * 100 + 0.5) AS INT) AS missing_percent FROM k""")
def q_community_profile(t):
    projects = t.projects.withColumn("field_values", F.create_map(F.lit("车位"), F.col("parking")))
    r = profile.community_profile(t.entities.where("kind = 'residential'"), projects, _waterfall(t))
    return r.select("id", "developer", "timing", "known", "missing", "missing_percent")


@query("""
WITH own AS (SELECT DISTINCT school_id AS id FROM admissions WHERE active AND year = '1998'),
off AS (SELECT id FROM own UNION SELECT campus_id FROM links WHERE year = '1998' AND kind <> 'documented_campus_affiliation' AND official_school_id IN (SELECT id FROM own)),
m AS (SELECT * FROM places WHERE kind = 'school' AND primary_school AND district = 'ASIA' AND id IN (SELECT id FROM off)),
sh AS (SELECT official_school_id AS id FROM links WHERE year = '1998' AND kind = 'portal_coordinate_match' AND campus_id IN (SELECT id FROM m WHERE lat IS NOT NULL))
SELECT id, row_number() OVER (ORDER BY post_count DESC, name, id) AS ord FROM m WHERE lat IS NOT NULL OR id NOT IN (SELECT id FROM sh)""")
def q_query_entities_official(t):
    return search.query_entities(t.entities, t.admissions, t.links, t.prices, ASIA.but(kind="school", official_only=True)).select("id", "ord")


@query("""
SELECT DISTINCT p.id FROM places p JOIN admissions a ON a.home_id = p.id WHERE a.active AND a.year = '1998' AND a.school_id IN ('school:30', (SELECT official_school_id FROM links WHERE campus_id = 'school:30' AND year = '1998' AND official_school_id = 'school:32'))""")
def q_query_entities_school(t):
    return search.query_entities(t.entities, t.admissions, t.links, t.prices, ASIA.but(district=None, school_id="school:30")).select("id")


@query("SELECT id FROM places WHERE kind = 'residential' AND district = 'ASIA' AND contains(lower(name), '00012')")
def q_query_entities_search(t):
    return search.query_entities(t.entities, t.admissions, t.links, t.prices, ASIA.but(query=" 000 12")).select("id")


@query("""
WITH p AS (SELECT DISTINCT entity_id FROM prices WHERE kind = 'deal' AND total_wan >= 5000 AND total_wan <= 9000 AND area_sqm >= 8)
SELECT id FROM places WHERE kind = 'residential' AND district = 'ASIA' AND id IN (SELECT entity_id FROM p) AND lat IS NOT NULL""")
def q_query_entities_housing(t):
    return search.query_entities(t.entities, t.admissions, t.links, t.prices, ASIA.but(min_budget=5000.0, max_budget=9000.0, min_area=8.0, located="yes")).select("id")


@query("""
SELECT id FROM posts WHERE id IN (SELECT post_id FROM post_places WHERE entity_id IN (SELECT id FROM places WHERE district = 'ASIA')) OR (id NOT IN (SELECT post_id FROM post_places) AND contains(lower(district), 'fr'))""")
def q_filter_posts(t):
    scope_ids = t.places.where("district = 'ASIA'").select("id")
    return search.filter_posts(t.posts, t.post_places, scope_ids, QueryState(kind="all", district="fr", primary_only=False)).select("id")


@query("""
WITH s AS (SELECT post_id, entity_id FROM post_places WHERE entity_id LIKE 'school:%'), h AS (SELECT post_id, entity_id FROM post_places WHERE entity_id LIKE 'home:%')
SELECT least(s.entity_id, h.entity_id) AS a, greatest(s.entity_id, h.entity_id) AS b, count(DISTINCT s.post_id) AS posts FROM s JOIN h ON h.post_id = s.post_id JOIN places x ON x.id = s.entity_id JOIN places y ON y.id = h.entity_id GROUP BY 1, 2""")
def q_comention(t):
    pairs = mentions.co_mentions(t.post_places, t.places)
    return mentions.merged_evidence(pairs.limit(0), pairs).select("a", "b", F.size("post_ids").cast("long").alias("posts"))


# --- sets ---


@query("SELECT entity_id AS id FROM post_places UNION SELECT home_id FROM admissions WHERE year = '1998'")
def q_set_union(t):
    return t.post_places.select(F.col("entity_id").alias("id")).union(t.admissions.where("year = '1998'").select("home_id")).distinct()


@query("SELECT entity_id AS id FROM post_places INTERSECT SELECT home_id FROM admissions WHERE year = '1998'")
def q_set_intersect(t):
    return t.post_places.select(F.col("entity_id").alias("id")).intersect(t.admissions.where("year = '1998'").select("home_id"))


@query("SELECT entity_id AS id FROM post_places EXCEPT SELECT home_id FROM admissions WHERE year = '1998'")
def q_set_except(t):
    return t.post_places.select(F.col("entity_id").alias("id")).subtract(t.admissions.where("year = '1998'").select("home_id"))


# --- scalars ---


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+[^?#]*)', 1) AS safe FROM pages")
def q_safe_url(t):
    return t.pages.select("page_id", values.safe_url(F.col("url")).alias("safe"))


@query()
def q_letters_hash(t):
    return t.documents.select("doc_id", text.body_hash(F.col("text")).alias("body"))


@query(r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#[^#\n]+?\[话题\]#', ' ', 'g'), '(^|\s)#[^\s#]+', ' ', 'g'), '\[[^\]\n]{1,20}R\]', '', 'g'), '[^\p{L}\p{N}]', '', 'g') AS kept FROM documents)
SELECT doc_id, CAST(length(kept) + length(regexp_replace(kept, '[\x{0}-\x{FFFF}]', '', 'g')) AS BIGINT) AS n FROM c""")
def q_meaningful_len(t):
    return t.documents.select("doc_id", text.meaningful_characters(F.col("text")).alias("n"))


@query()
def q_norm_nfkc(t):
    return t.documents.select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("norm"))


@query()
def q_html_article(t):
    html = F.regexp_replace("html", "<article>", '<article class="article-content">')
    return t.pages.select("page_id", article.article(html).alias("a")).select("page_id", "a.title", "a.text")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY sha256(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, CASE WHEN rn > 1 THEN 'duplicate_body' END AS reason FROM r""")
def q_dedupe_body(t):
    d = t.documents.select("doc_id", F.col("doc_id").alias("id"), values.digest(F.lower(text.letter_numbers(F.col("text")))).alias("body_sha256"))
    return importers.first_bodies(d, F.col("doc_id")).select("doc_id", "reason")


@query("SELECT id, lpad(CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(id, ''), lambda x: ascii(x)::HUGEINT)), lambda h, x: (xor(h, x) * 16777619::HUGEINT) % 4294967296::HUGEINT) % 128 AS VARCHAR), 3, '0') AS shard FROM places")
def q_fnv_shard(t):
    return t.places.select("id", values.shard(F.col("id")).alias("shard"))


@query(f"SELECT a.id, {_DIST.format(a='a', b='b')} AS metres FROM places a JOIN places b ON b.id = 'school:1' WHERE a.lat IS NOT NULL")
def q_haversine(t):
    b = t.places.where("id = 'school:1'").select(F.col("lat").alias("y"), F.col("lng").alias("x"))
    return t.places.where("lat is not null").crossJoin(F.broadcast(b)).select("id", geo.distance_m(F.col("lat"), F.col("lng"), F.col("y"), F.col("x")).alias("metres"))


_PI = "3.141592653589793"


@query(f"""
WITH p AS (SELECT id, lng - 105 AS x, lat - 35 AS y, lat, lng FROM places WHERE lat IS NOT NULL),
t AS (SELECT *, -100 + 2*x + 3*y + .2*y*y + .1*x*y + .2*sqrt(abs(x)) + (20*sin(6*x*{_PI}) + 20*sin(2*x*{_PI}))*2/3 + (20*sin(y*{_PI}) + 40*sin(y/3*{_PI}))*2/3 + (160*sin(y/12*{_PI}) + 320*sin(y*{_PI}/30))*2/3 AS dy,
  300 + x + 2*y + .1*x*x + .1*x*y + .1*sqrt(abs(x)) + (20*sin(6*x*{_PI}) + 20*sin(2*x*{_PI}))*2/3 + (20*sin(x*{_PI}) + 40*sin(x/3*{_PI}))*2/3 + (150*sin(x/12*{_PI}) + 300*sin(x/30*{_PI}))*2/3 AS dx, 1 - 0.00669342162296594323 * pow(sin(lat/180*{_PI}), 2) AS m FROM p)
SELECT id, round(lng - dx*180/(6378245.0/sqrt(m)*cos(lat/180*{_PI})*{_PI}), 6) AS wgs_lng, round(lat - dy*180/(6378245.0*(1-0.00669342162296594323)/(m*sqrt(m))*{_PI}), 6) AS wgs_lat FROM t""")
def q_gcj(t):
    p = t.places.where("lat is not null").select("id", geo.shifted_to_wgs84(F.col("lng"), F.col("lat")).alias("p"))
    return p.select("id", F.round("p.lng", 6).alias("wgs_lng"), F.round("p.lat", 6).alias("wgs_lat"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS amount FROM customer")
def q_number(t):
    return t.customer.select("c_custkey", values.number(F.concat(F.lit(" "), F.format_string("%,.2f", "c_acctbal"))).alias("amount"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders")
def q_day(t):
    odd = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "y-M-d"))
    return t.orders.select("o_orderkey", values.day(odd).cast("string").alias("d"))


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'new' WHEN o_orderkey % 9 IN (1, 2, 4, 5) THEN 'resale' WHEN o_orderkey % 9 = 7 THEN 'new' ELSE 'unknown' END AS market FROM orders""")
def q_price_market(t):
    k = F.col("o_orderkey") % 9
    pick = lambda other, **at: F.coalesce(*[F.when(k == int(n[1:]), F.lit(v)) for n, v in at.items()], F.lit(other))
    # 0 a project's reference, 1 an imported deal, 2 the deals' own source, 3 a project's deal, 4 and 5 a channel, 6 a channel of another site, 7 a worded reference, 8 none
    source = pick("base", k0="new-project:1", k1="incremental-price:1", k2="deals", k3="new-project:2")
    kind = pick("listing", k0="reference", k1="deal", k3="deal", k7="reference")
    url = pick("https://x.test/a", k4="https://x.test/ershoufang/1", k5="https://hz.fang.com/esf/2", k6="https://hz.other.com/esf/2")
    note = pick("", k7="历史／新房楼盘口径", k8="历史／新房楼盘口径")
    return t.orders.select(F.col("o_orderkey").alias("k"), values.price_market(source, kind, url, [note]).alias("market"))


@query("SELECT c_custkey, c_acctbal - 100 AS net_sale, c_acctbal - 100 + 50 AS available, 900 + 20 - (c_acctbal - 100 + 50) AS gap FROM customer WHERE c_acctbal >= 0")
def q_funding_gap(t):
    g = values.funding_gap(F.lit("900"), F.col("c_acctbal"), F.lit("50"), F.lit("20"), F.lit("100"))
    return t.customer.withColumn("g", g).where("g is not null").select("c_custkey", "g.net_sale", "g.available", "g.gap")


@query("SELECT source_id, CASE WHEN 2001 >= CAST(observed_at AS INT) THEN 2001 - CAST(observed_at AS INT) END AS age FROM projects")
def q_building_age(t):
    return t.projects.select("source_id", values.building_age(F.concat(F.lit("built "), "observed_at"), F.lit("2001-05-06")).alias("age"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"note\":null}') AS entry FROM documents")
def q_entry_hash(t):
    return t.documents.select("doc_id", values.entry_hash(note=F.lit(None).cast("string"), lang=F.col("lang"), doc_id=F.col("doc_id")).alias("entry"))


# --- mentions, exports, streams ---


@query()
def q_span_longest(t):
    items = t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.lit("residential").alias("kind"), F.col("text").alias("name"), F.array(F.substring("text", 1, 24)).alias("aliases"))
    sure, _ = mentions.matched(t.documents.select(F.col("doc_id").alias("id"), "text"), mentions.mention_names(items))
    return sure


@query("SELECT kind, count(*) AS orphans FROM links WHERE official_school_id NOT IN (SELECT id FROM places) GROUP BY kind")
def q_foreign_key_orphans(t):
    return publish.orphans(t.links, "official_school_id", t.places, "id").groupBy("kind").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT '/' || CAST(CAST(snapshot_date AS STRING) AS STRING) AS path, count(*) >= 100 AS valid FROM history GROUP BY 1")
def q_snapshot_files(t):
    rows = t.history.select(F.concat(F.lit("/"), F.col("snapshot_date").cast("string")).alias("path"), F.col("entity_id").alias("name"))
    return readers.snapshot_files(rows).select("path", "valid")


@query("SELECT CAST(date_trunc('hour', ts) AS STRING) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_tumbling_counts(t):
    return bundles.tumbling_counts(t.events).select(F.col("start").cast("string").alias("start"), "event_type", "n")


@query("""
WITH u AS (SELECT CAST(doc_id AS STRING) AS id, 'first' AS entry_type, 0 AS entry_index, first_school AS entry FROM (SELECT *, id AS doc_id FROM policies) UNION ALL SELECT id, 'second', 0, second_school FROM policies)
SELECT id, entry_type, entry_index, entry FROM u""")
def q_unpivot_lists(t):
    p = t.policies.select("id", F.array("first_school").alias("a"), F.array("second_school").alias("b"))
    return upsert.unpivot_lists(p, {"a": "first", "b": "second"}, ["id"])


# --- dossiers, panels, metrics ---


def _records(t: Tables) -> DataFrame:
    """Annual school records: a school of positive balance has one for each year in which it admits."""
    schools = t.places.where("kind = 'school' and primary_school").select(F.col("id").alias("school_id"))
    return t.admissions.join(schools, "school_id", "left_semi").select(F.col("school_id").alias("entity_id"), F.col("school_id").alias("official_id"), "year").distinct()


_RECORDS = "rec AS (SELECT DISTINCT school_id AS entity_id, year FROM admissions WHERE school_id IN (SELECT id FROM places WHERE kind = 'school' AND primary_school))"
_LINKED = _RECORDS + ", linked AS (SELECT DISTINCT l.campus_id AS id, l.official_school_id AS school_id, l.year FROM links l JOIN rec ON rec.entity_id = l.official_school_id AND rec.year = l.year WHERE l.campus_id IN (SELECT id FROM places))"


@query("WITH " + _LINKED + " SELECT id, school_id, year FROM linked")
def q_linked_records(t):
    return detail.linked_records(t.places.select("id"), t.links, _records(t))


@query("WITH " + _LINKED + """, a AS (SELECT DISTINCT * FROM admissions),
u AS (SELECT a.school_id AS place, a.* FROM a WHERE a.school_id IN (SELECT id FROM places) UNION SELECT k.id, a.* FROM a JOIN linked k ON k.school_id = a.school_id AND k.year = a.year)
SELECT place AS id, year, count(*) AS n FROM u GROUP BY place, year""")
def q_detail_admissions(t):
    ids = t.places.where("kind = 'school'").select("id")
    rows = t.admissions.withColumnRenamed("id", "admission_id").distinct()
    found = detail.year_guarded(ids, rows, "school_id", detail.linked_records(ids, t.links, _records(t)))
    return found.groupBy("id", "year").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _RECORDS + """, pc AS (SELECT entity_id, count(*) AS n FROM post_places GROUP BY 1), pr AS (SELECT entity_id, count(*) AS n FROM prices GROUP BY 1), pj AS (SELECT entity_id, count(*) AS n FROM projects GROUP BY 1),
oy AS (SELECT id, count(DISTINCT year) AS n, count(DISTINCT official) AS o FROM (SELECT campus_id AS id, year, official_school_id AS official FROM links UNION ALL SELECT entity_id, year, entity_id FROM rec) x GROUP BY 1),
mem AS (SELECT 'group:' || CAST(s_nationkey AS STRING) AS group_id, 'school:' || CAST(s_suppkey AS STRING) AS school_id, s_acctbal > 0 AS active FROM supplier),
gm AS (SELECT group_id AS id, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE NOT active) AS past FROM mem GROUP BY 1),
gr AS (SELECT id, count(DISTINCT CASE WHEN active THEN group_id END) AS n FROM (SELECT school_id AS id, group_id, active FROM mem UNION ALL SELECT campus_id, group_id, active FROM mem JOIN links ON official_school_id = school_id) y GROUP BY 1)
SELECT p.id, coalesce(pc.n, 0) AS posts, coalesce(pr.n, 0) AS prices, coalesce(pj.n, 0) AS projects, coalesce(oy.n, 0) AS official_years, coalesce(oy.o, 0) AS official_ids, coalesce(gm.active, 0) AS members, coalesce(gm.past, 0) AS past_members, coalesce(gr.n, 0) AS groups
FROM places p LEFT JOIN pc ON pc.entity_id = p.id LEFT JOIN pr ON pr.entity_id = p.id LEFT JOIN pj ON pj.entity_id = p.id LEFT JOIN oy ON oy.id = p.id LEFT JOIN gm ON gm.id = p.id LEFT JOIN gr ON gr.id = p.id""")
def q_bootstrap(t):
    e = t.entities
    group, school = F.concat(F.lit("group:"), F.col("s_nationkey").cast("string")), F.concat(F.lit("school:"), F.col("s_suppkey").cast("string"))
    members = t.supplier.select(group.alias("group_id"), school.alias("school_id"), school.alias("official_id"), (F.col("s_acctbal") > 0).alias("active"))
    r = detail.bootstrap(
        e.drop("candidate"), e.where("candidate is not null").select(F.col("id").alias("entity_id"), "candidate"), t.post_places, t.prices, t.projects.select("entity_id", F.col("parking").alias("name")),
        _records(t), t.links, members,
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return r.select(
        "id", zero("post_count").alias("posts"), zero(F.size("price_filter")).alias("prices"), zero("project_count").alias("projects"), zero(F.size("official_years")).alias("official_years"), zero(F.size("official_ids")).alias("official_ids"),
        zero("group_member_count").alias("members"), zero("historical_member_count").alias("past_members"), zero(F.size("school_group_ids")).alias("groups"),
    )


@query("""
WITH l AS (SELECT campus_id AS id, count(*) AS n FROM links WHERE year = '1998' GROUP BY 1),
p AS (SELECT first_school AS id, year, kind FROM policies UNION ALL SELECT second_school, year, kind FROM policies),
c AS (SELECT id, count(*) FILTER (WHERE year = '1998') AS cur, count(*) FILTER (WHERE kind = 'local_policy_archive' AND year <> 'unknown' AND year <> '1998') AS oth FROM p GROUP BY 1)
SELECT s.id, coalesce(l.n, 0) AS year_links, coalesce(cur, 0) AS current_policies, coalesce(oth, 0) AS other_archives FROM places s LEFT JOIN l ON l.id = s.id LEFT JOIN c ON c.id = s.id WHERE s.kind = 'school'""")
def q_evidence_panel(t):
    policies = t.policies.select("year", "kind", F.array("first_school", "second_school").alias("school_ids"))
    return detail.evidence_panel(t.places.where("kind = 'school'").select("id"), t.links, policies, "1998")


@query("SELECT p.entity_id AS id, count(DISTINCT p.post_id) AS posts FROM post_places p JOIN posts q ON q.id = p.post_id WHERE q.deep_read AND p.entity_id IN (SELECT id FROM places) GROUP BY 1")
def q_posts_to_places(t):
    return detail.post_places_of(t.posts.where("deep_read"), t.post_places, t.places)


@query("SELECT DISTINCT a.entity_id AS selected_id, b.entity_id FROM post_places a JOIN post_places b ON a.post_id = b.post_id AND a.entity_id <> b.entity_id WHERE a.entity_id LIKE 'school:%' AND a.entity_id IN (SELECT id FROM places) AND b.entity_id IN (SELECT id FROM places)")
def q_other_places(t):
    return detail.other_places(t.post_places, t.places.where("kind = 'school'").select("id"), t.places)


@query("SELECT home_id, count(*) AS rows, array_to_string(list_sort(list(DISTINCT admission_type)), ' / ') AS types, count(DISTINCT school_id) AS schools FROM (SELECT DISTINCT ON (id) * FROM admissions WHERE active AND year = '1998') a GROUP BY home_id")
def q_relation_groups(t):
    return detail.active_relations(t.admissions, ASIA).select("home_id", "rows", "types", "schools")


@query("SELECT entity_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) AS rn FROM history WHERE snapshot_date = DATE '2024-01-05') x WHERE rn = 1")
def q_snapshot(t):
    return detail.snapshot(t.history, "2024-01-05").select("entity_id", "event_id")


@query("""
SELECT 'rows:places' AS metric, count(*) AS value FROM places UNION ALL SELECT 'rows:links', count(*) FROM links UNION ALL SELECT 'prices:' || kind, count(*) FROM prices GROUP BY kind
UNION ALL SELECT 'admissions:' || admission_type, count(*) FROM admissions GROUP BY admission_type UNION ALL SELECT 'prices:fully_priced', count(*) FROM prices WHERE total_wan > 0 AND unit_yuan_sqm > 0""")
def q_metrics(t):
    return detail.metrics({"places": t.places, "links": t.links}, t.prices, t.admissions)


@query("""
SELECT 'links' AS check, count(*) AS bad_rows, count(*) = 0 AS ok FROM links WHERE official_school_id NOT IN (SELECT id FROM places)
UNION ALL SELECT 'admissions', count(*), count(*) = 0 FROM admissions WHERE home_id NOT IN (SELECT id FROM places)""")
def q_verification(t):
    return detail.verification({"links": publish.orphans(t.links, "official_school_id", t.places, "id"), "admissions": publish.orphans(t.admissions, "home_id", t.places, "id")})


@query("SELECT kind, CASE WHEN kind = 'reference' THEN CASE WHEN unit_yuan_sqm > 0 THEN 'unit' ELSE 'undisclosed' END WHEN total_wan > 0 THEN 'total' WHEN unit_yuan_sqm > 0 THEN 'unit' ELSE 'undisclosed' END AS headline, 'day' AS precision, count(*) AS n FROM prices GROUP BY 1, 2")
def q_price_headlines(t):
    return detail.headlines(t.prices).groupBy("kind", "headline", "precision").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH m AS (SELECT DISTINCT 'group:' || CAST(s_nationkey AS STRING) AS group_id, 'school:' || CAST(s_suppkey AS STRING) AS official_id, s_acctbal > 0 AS active FROM supplier),
d AS (SELECT m.*, l.campus_id, row_number() OVER (PARTITION BY m.group_id, m.official_id ORDER BY (l.year = '1998') DESC NULLS LAST, (l.kind = 'portal_coordinate_match') DESC NULLS LAST, (c.lat IS NOT NULL) DESC NULLS LAST, l.distance_m NULLS LAST, l.campus_id NULLS LAST) AS rn
  FROM m LEFT JOIN links l ON l.official_school_id = m.official_id LEFT JOIN places c ON c.id = l.campus_id)
SELECT d.group_id, p.id, d.active, p.lat IS NOT NULL AS located FROM d JOIN places p ON p.id = coalesce(d.campus_id, d.official_id) WHERE rn = 1""")
def q_group_plan(t):
    m = t.supplier.select(F.concat(F.lit("group:"), F.col("s_nationkey").cast("string")).alias("group_id"), F.concat(F.lit("school:"), F.col("s_suppkey").cast("string")).alias("official_id"), F.lit("1998").alias("year"), (F.col("s_acctbal") > 0).alias("active"))
    return detail.group_plan(m, t.links, t.places)


@query("SELECT official_id, year FROM (SELECT school_id AS official_id, max(year) AS year FROM admissions GROUP BY school_id) x")
def q_latest_record(t):
    records = t.admissions.select(F.col("school_id").alias("official_id"), "year", F.col("school_id").alias("entity_id")).distinct()
    return reviews.latest_record(records).select("official_id", "year")


@query("SELECT s.id AS selected_id, h.id, 'official' AS tier FROM places s JOIN (SELECT DISTINCT school_id, home_id FROM admissions WHERE active AND year = '1998') a ON a.school_id = s.id JOIN places h ON h.id = a.home_id WHERE s.lat IS NOT NULL AND h.lat IS NOT NULL")
def q_relation_lines(t):
    items = t.admissions.where(predicates.relation_matches(ASIA)).select(F.col("school_id").alias("selected_id"), F.col("home_id").alias("id"), F.lit("official").alias("tier")).distinct()
    return detail.relation_lines(t.places.where("kind = 'school'"), items, t.places).select("selected_id", "id", "tier")


# --- gates ---


@query(r"""
WITH c AS (SELECT doc_id, lang, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#[^#\n]+?\[话题\]#', ' ', 'g'), '(^|\s)#[^\s#]+', ' ', 'g'), '\[[^\]\n]{1,20}R\]', '', 'g'), '[^\p{L}\p{N}]', '', 'g')) AS n FROM documents),
r AS (SELECT c.doc_id, CASE WHEN n = 0 THEN 'no_prose' WHEN n < 40 THEN 'short_or_low_content' WHEN l.doc_id IS NULL THEN 'not_accepted' WHEN l.quality = 0 THEN 'low_quality' WHEN l.toxic = 1 THEN 'out_of_scope' WHEN lang = 'fr' THEN 'invalid_observation_time' END AS reason
  FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1""")
def q_social_gate(t):
    note = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 24)
    d = t.documents.join(t.labels, "doc_id", "left")
    record = F.struct(note.alias("id"), F.lit("t").alias("title"), F.col("text").alias("desc"), F.lit("prose_or_caption").alias("description_kind"), F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("valid"), F.array().cast("array<string>").alias("exclusion_reasons"))
    rows = d.select(
        note.alias("id"), F.concat(F.lit("https://site.test/explore/"), note).alias("source_url"), F.when(F.col("lang") == "fr", "2026-01-01T00:00:00").otherwise("2026-01-01T00:00:00+08:00").alias("observed_at"), text.body_hash(F.col("text")).alias("body_sha256"),
        text.meaningful_characters(F.col("text")).alias("meaningful_characters"), (F.col("quality") == 1).alias("accepted"), F.when(F.col("quality") == 0, "low_quality").alias("exclusion_reason"), F.lit(False).alias("baseline_index"), record.alias("record"),
    )
    none = rows.limit(0)
    got = importers.social_reason(rows, none.select("id"), none.select("id"), none.select("body_sha256"), ("site.test",))
    return got.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT CASE WHEN total_wan IS NULL THEN 'invalid_or_missing_price_or_area' WHEN year(event_date) <> 1998 OR observed_at < event_date THEN 'invalid_2026_event_or_observation_time' WHEN possible_duplicate THEN 'possible_duplicate_unresolved' WHEN line_no = 3 THEN 'not_visible_tls_verified_evidence' END AS reason FROM prices)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1""")
def q_enrichment_shape(t):
    sid = F.concat(F.lit("EX_"), F.col("order_no").cast("string"))
    url = F.concat(F.lit("https://m.fang.com/chengjiao/hz/"), sid, F.lit(".html"))
    fixed = {k: F.lit("x") for k in ("community", "layout", "orientation")}
    rows = t.prices.withColumns(fixed | {
        "id": F.concat(F.lit("fang:deal:"), sid), "record_kind": F.lit("deal_price_enrichment_candidate"), "baseline_status": F.lit("existing_841_price_enrichment_candidate"), "source_record_id": sid, "source_url": url, "evidence_url": url,
        "comparison_prior_record_ids": F.array(F.concat(F.lit("fang:deal:"), F.sha2("id", 256))), "community_source_id": F.col("supp_no").cast("string"), "district": F.lit(scope.MAIN_DISTRICTS[0]), "event_date": F.col("event_date").cast("string"),
        "observed_at": F.concat(F.col("observed_at").cast("string"), F.lit("T12:00:00+08:00")), "possible_duplicate_group": F.when(F.col("possible_duplicate"), "g"), "price_disclosure": F.lit("visible"), "tls_verification_enabled": F.col("line_no") != 3, "evidence_sha256": F.sha2("source_id", 256),
    })
    reason = importers.enrichment_shape(year=1998)
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT 'home:' || CAST(c_custkey AS STRING) AS source_entity_id, c_mktsegment AS district FROM customer),
n AS (SELECT home_id, count(DISTINCT id) AS n FROM admissions GROUP BY 1)
SELECT district, count(*) AS bridges, CAST(sum(coalesce(n, 0)) AS BIGINT) AS rows FROM b LEFT JOIN n ON home_id = source_entity_id GROUP BY district""")
def q_bridge_totals(t):
    b = t.customer.select(F.concat(F.lit("home:"), F.col("c_custkey").cast("string")).alias("source_entity_id"), F.col("c_mktsegment").alias("district"))
    return detail.bridge_totals(b, t.admissions.select(F.col("home_id").alias("source_entity_id"), "id").distinct())


@query("""
WITH live AS (SELECT home_id, count(DISTINCT id) AS n FROM admissions GROUP BY 1),
b AS (SELECT 'home:' || CAST(o_custkey AS STRING) AS source_entity_id, count(*) AS orders FROM orders GROUP BY 1)
SELECT source_entity_id, false AS lock FROM b LEFT JOIN live ON home_id = source_entity_id WHERE coalesce(n, 0) <> orders OR n IS NULL""")
def q_bridge_lock_broken(t):
    rows = t.admissions.select(F.col("home_id").alias("source_entity_id"), "id").distinct()
    live = rows.groupBy("source_entity_id").agg(values.id_set_lock(F.col("id")).alias("l"))
    want = t.orders.groupBy(F.concat(F.lit("home:"), F.col("o_custkey").cast("string")).alias("source_entity_id")).agg(F.count(F.lit(1)).alias("count"))
    bridges = want.join(live, "source_entity_id", "left").select("source_entity_id", "count", F.col("l.sha256").alias("sha256"))
    return resolve.locked_bridge(rows, bridges).where(~F.col("lock")).select("source_entity_id", "lock")


@query("""
WITH r AS (SELECT n_regionkey AS cid, count(DISTINCT n_name) AS names, count(DISTINCT r_name) AS dirs FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT CAST(cid AS STRING) AS community_id, CASE WHEN names + dirs <= 1 THEN 'no_alias_change' WHEN dirs <> 1 THEN 'directory_identity_unresolved' ELSE 'source_project_marketing_alias_bridge' END AS status FROM r""")
def q_market_identities(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("fang").alias("source"), F.col("n_regionkey").cast("string").alias("community_id"), F.lit("ASIA").alias("district"), F.col("n_name").alias("community"), F.col("r_name").alias("directory_name"), F.lit("deal").alias("record_kind"))
    return resolve.market_identities(rows, t.entities).select("community_id", "status")


@query("SELECT id, link_status, archive_available FROM (SELECT CAST(page_id AS STRING) AS id, CAST(NULL AS STRING) AS link_status, CAST(NULL AS BOOLEAN) AS archive_available FROM pages UNION ALL SELECT 'policy:service_area', 'ok', true) x")
def q_source_status(t):
    s = t.pages.select(F.col("page_id").cast("string").alias("id"), F.lit("page").alias("kind"))
    one = t.region.where("r_regionkey = 0").select(F.lit("policy:service_area").alias("id"), F.lit("official").alias("kind"))
    checks = one.select("id", F.lit("ok").alias("status"), F.lit(True).alias("archived"))
    return detail.source_status(s.unionByName(one), checks).select("id", "link_status", "archive_available")


# --- panels, lists, exports ---


@query("""
WITH r AS (SELECT DISTINCT id, kind, event_date, observed_at FROM prices WHERE kind IN ('deal', 'listing') AND (kind <> 'deal' OR (event_date >= DATE '1996-01-01' AND event_date <= DATE '1997-12-31')) AND order_no % 2 = 1)
SELECT id, kind, row_number() OVER (ORDER BY coalesce(event_date, observed_at) DESC, id, kind, observed_at) AS ord FROM r""")
def q_price_list(t):
    rows = t.prices.withColumn("market", F.when(F.col("order_no") % 2 == 1, "resale").otherwise("new")).select("id", "kind", "event_date", "observed_at", "market").distinct()
    return market.price_list(rows, "resale", ("deal", "listing"), ASIA.but(deal_from="1996-01-01", deal_to="1997-12-31")).select("id", "kind", F.col("ord").cast("long").alias("ord"))


@query("""
WITH rec AS (SELECT 'home:' || CAST(o_custkey AS STRING) AS id, year(o_orderdate) AS y FROM orders)
SELECT id, coalesce(array_to_string(list_sort(list(DISTINCT y) FILTER (WHERE y IS NOT NULL)), ','), '') AS years, coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)), ','), '') AS kinds FROM (SELECT id, y, NULL AS kind FROM rec UNION ALL SELECT entity_id, NULL, kind FROM prices) x GROUP BY id""")
def q_distinct_lists(t):
    years = t.orders.select(F.concat(F.lit("home:"), F.col("o_custkey").cast("string")).alias("id"), F.year("o_orderdate").alias("y"), F.lit(None).cast("string").alias("kind"))
    both = years.unionByName(t.prices.select(F.col("entity_id").alias("id"), F.lit(None).cast("int").alias("y"), "kind"))
    return both.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("y")), ",").alias("years"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query("SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def q_hot_median(t):
    return values.exact_median(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("""
WITH n AS (SELECT entity_id, count(*) AS n FROM prices GROUP BY entity_id), c AS (SELECT * FROM (VALUES ('home:7', 1), ('home:3', 2), ('school:2', 3)) v(id, position))
SELECT p.id, name, n.n AS prices, position FROM places p JOIN c ON c.id = p.id LEFT JOIN n ON n.entity_id = p.id""")
def q_compare(t):
    stats = t.prices.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("prices"))
    return detail.compare(t.places, stats, ["home:7", "home:3", "school:2"]).select("id", "name", "prices", "position")


@query("""
WITH i AS (SELECT DISTINCT school_id AS selected_id, home_id AS id, admission_type AS note FROM admissions WHERE year = '1998')
SELECT selected_id, i.id, note FROM i JOIN places p ON p.id = i.id WHERE (contains(lower(name), '#00000001') OR contains(lower(note), '#00000001')) AND lat IS NOT NULL""")
def q_relation_list(t):
    items = t.admissions.where("year = '1998'").select(F.col("school_id").alias("selected_id"), F.col("home_id").alias("id"), F.col("admission_type").alias("note")).distinct()
    places = t.places.select("id", "name")
    at = items.join(t.places.select("id", geo.located(F.col("lat"), F.col("lng")).alias("located")), "id")
    return detail.relation_list(at, places, " #00000001 ", located_only=True).select("selected_id", "id", "note")


@query("SELECT id, post_count > 0 OR coalesce(pool_rank <= 20, false) OR id IN ('home:1', 'school:2') AS labelled FROM places WHERE lat IS NOT NULL")
def q_markers(t):
    ranked = t.places.where("has_candidate").select("id", F.col("pool_rank").alias("rank"))
    return detail.markers(t.places, ranked, ("home:1", "school:2"), ASIA)


@query("SELECT district, count(*) AS groups, sum(coalesce(group_member_count, 0)) AS members, count(*) FILTER (WHERE group_member_count > 0) AS with_members, count(*) FILTER (WHERE lat IS NOT NULL) AS located FROM places WHERE kind IN ('school_group', 'school') GROUP BY district")
def q_member_totals(t):
    return detail.member_totals(t.places.where("kind in ('school_group', 'school')"))


@query("SELECT id, CAST(DATE '1970-01-01' + CAST(floor((posted * 86400000 + (CAST(id AS BIGINT) % 24) * 3600000 + 28800000) / 86400000) AS INT) AS STRING) AS posted_day FROM posts")
def q_posted_day(t):
    ms = F.col("posted") * 86_400_000 + F.col("id").cast("long") % 24 * 3_600_000
    return t.posts.select("id", values.epoch_day(ms).cast("string").alias("posted_day"))


@query("""
SELECT source_id, CASE WHEN amount > 0 AND CAST(source_id AS BIGINT) % 2 = 0 THEN CAST(CAST(floor(amount) AS INTEGER) AS STRING) || ' yuan' WHEN developer IS NOT NULL THEN developer ELSE 'undisclosed' END AS label,
       coalesce(delivery_date_raw, '') <> '' AS dated, substr(delivery_date_raw, 1, 10) AS day FROM projects""")
def q_project_price_label(t):
    label = values.project_price_label(F.col("amount").cast("int"), F.col("source_id").cast("long") % 2 == 1, F.lit("yuan"), F.col("developer"))
    return t.projects.select("source_id", label.alias("label"), values.present(F.col("delivery_date_raw")).alias("dated"), values.profile_date(F.col("delivery_date_raw")).alias("day"))


@query("""SELECT id, CAST(to_json({'id': id, 'kind': kind, 'built_year': built_year, 'post_count': post_count}) AS STRING) AS body FROM places""")
def q_api_rows(t):
    return t.places.select("id", publish.api_rows(t.places.select("id", "kind", "built_year", "post_count")).alias("body"))


@query("SELECT id, name, kind FROM places")
def q_public_keys(t):
    return publish.public(t.places, ("id", "name", "kind", "receipt"))


@query("""
SELECT id, concat_ws(',', CASE WHEN CAST(substr(second_school, 8) AS INT) < 40 THEN second_school END, CASE WHEN first_school <> second_school AND CAST(substr(first_school, 8) AS INT) < 40 THEN first_school END) AS saved FROM policies""")
def q_saved_ids(t):
    valid = F.array(*[F.lit(f"school:{k}") for k in range(40)])
    return t.policies.select("id", F.concat_ws(",", search.saved_ids(F.array("second_school", "first_school", "second_school"), valid)).alias("saved"))


@query("SELECT source_id, 'file-' || CAST(amount AS STRING) AS path FROM projects WHERE amount IS NOT NULL AND CAST(source_id AS BIGINT) % 10 = 0")
def q_changed_files(t):
    files = t.projects.where("amount is not null").select("source_id", F.concat(F.lit("file-"), F.col("amount").cast("string")).alias("path"))
    now = F.when(F.col("source_id").cast("long") % 10 == 0, "other").otherwise("same")
    gone = publish.changed(files.select("path", F.concat("source_id", F.lit("same")).alias("sha256")), files.select("path", F.concat("source_id", now).alias("sha256")))
    return gone.select(F.regexp_extract("sha256", "^([0-9]+)", 1).alias("source_id"), "path")


@query("""
SELECT event_id, purchase AND big AS snapshot, purchase AS project FROM (SELECT event_id, event_type = 'purchase' AS purchase, value > 0 AS big FROM events) x""")
def q_import_gates(t):
    bought = F.col("event_type") == "purchase"
    rows = t.events.select("event_id", F.when(bought, "community_reference").otherwise("deal").alias("record_kind"), F.lit("c").alias("community"), F.lit("d").alias("district"), F.lit("https://x.org/a").alias("source_url"), F.col("value").alias("reference_unit_yuan_sqm"),
                           F.when(bought, "ok").otherwise("failed").alias("detail_fetch_status"), F.lit(True).alias("district_consistent"), F.lit(True).alias("is_residential"), F.lit("n").alias("name"))
    return rows.select("event_id", importers.accepted_snapshot().alias("snapshot"), importers.accepted_project().alias("project"))


@query("""
WITH pj AS (SELECT *, (CASE WHEN developer IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN property_type IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN units_raw IS NOT NULL THEN 1 ELSE 0 END)
  + (CASE WHEN delivery_date_raw IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN opening_date_raw IS NOT NULL THEN 1 ELSE 0 END) AS score FROM projects),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, observed_at DESC, source_id DESC) AS rn FROM pj) x WHERE rn = 1),
agreed AS (SELECT entity_id, max(observed_at) AS seen, CASE WHEN count(DISTINCT developer) = 1 THEN max(developer) END AS facade, CASE WHEN count(DISTINCT property_type) = 1 THEN max(property_type) END AS transit,
  CASE WHEN count(DISTINCT delivery_date_raw) = 1 THEN max(delivery_date_raw) END AS delivery, CASE WHEN count(DISTINCT opening_date_raw) = 1 THEN max(opening_date_raw) END AS opening, CASE WHEN count(DISTINCT parking) = 1 THEN max(parking) END AS name FROM projects GROUP BY entity_id),
f AS (SELECT p.id, coalesce(b.parking, a.name) AS record_name, coalesce(b.opening_date_raw, a.opening) AS opening, coalesce(b.delivery_date_raw, a.delivery) AS delivery, coalesce(b.developer, a.facade) AS facade, coalesce(b.property_type, a.transit) AS transit,
  CASE WHEN CAST(substr(a.seen, 1, 4) AS INT) >= p.built_year THEN CAST(CAST(substr(a.seen, 1, 4) AS INT) - p.built_year AS STRING) END AS age
  FROM places p LEFT JOIN best b ON b.entity_id = p.id LEFT JOIN agreed a ON a.entity_id = p.id WHERE p.kind = 'residential'),
k AS (SELECT *, (record_name IS NOT NULL)::INT + (opening IS NOT NULL)::INT + (delivery IS NOT NULL)::INT + (facade IS NOT NULL)::INT + (age IS NOT NULL)::INT AS known FROM f)
SELECT id, record_name, opening, delivery, age, facade, known AS extended_known, 14 - known AS extended_missing, CAST(floor((14 - known) / 14.0 * 100 + 0.5) AS INT) AS extended_missing_percent, coalesce('交通=' || transit, '') AS surrounding FROM k""")
def q_extended_profile(t):
    projects = t.projects.withColumn("name", F.col("parking")).withColumn("field_values", F.create_map(F.lit("外立面"), F.col("developer"), F.lit("交通情况"), F.col("property_type")))
    r = profile.extended_profile(t.entities.where("kind = 'residential'"), projects)
    around = F.concat_ws(";", F.transform("surrounding", lambda x: F.concat_ws("=", x["label"], x["value"])))
    return r.select("id", "record_name", "opening", "delivery", "age", "facade", "extended_known", "extended_missing", "extended_missing_percent", around.alias("surrounding"))


@query("WITH " + _LINKED + """, sel AS (SELECT id FROM places WHERE district = 'ASIA' AND kind IN ('residential', 'school')), a AS (SELECT DISTINCT * FROM admissions), sec AS (
SELECT 'entity' AS section, id FROM sel
UNION ALL SELECT 'admissions', place FROM (SELECT school_id AS place, a.* FROM a UNION SELECT k.id, a.* FROM a JOIN linked k ON k.school_id = a.school_id AND k.year = a.year UNION SELECT home_id, a.* FROM a) x
UNION ALL SELECT 'posts', entity_id FROM (SELECT DISTINCT entity_id, post_id FROM post_places WHERE post_id IN (SELECT id FROM posts)) x
UNION ALL SELECT 'prices', entity_id FROM prices UNION ALL SELECT 'projects', entity_id FROM projects UNION ALL SELECT 'market_snapshots', entity_id FROM snapshots UNION ALL SELECT 'history', entity_id FROM history
UNION ALL SELECT 'mappings', entity_id FROM projects WHERE CAST(source_id AS BIGINT) % 3 <> 0
UNION ALL SELECT 'co_mentions', id FROM (SELECT DISTINCT x.entity_id AS id, y.entity_id AS other FROM post_places x JOIN post_places y ON x.post_id = y.post_id AND (x.entity_id LIKE 'school:%') <> (y.entity_id LIKE 'school:%')) z
UNION ALL SELECT 'school_records', id FROM (SELECT entity_id AS id, entity_id, year FROM rec UNION SELECT k.id, rec.entity_id, rec.year FROM rec JOIN linked k ON k.school_id = rec.entity_id AND k.year = rec.year) x
UNION ALL SELECT 'school_links', id FROM (SELECT campus_id AS id, * FROM links UNION SELECT official_school_id, * FROM links) x
UNION ALL SELECT 'policies', id FROM (SELECT first_school AS id, id AS p FROM policies UNION SELECT second_school, id FROM policies
  UNION SELECT k.id, p.id FROM linked k JOIN (SELECT id, year, first_school AS s FROM policies UNION SELECT id, year, second_school FROM policies) p ON p.s = k.school_id AND p.year = k.year) x)
SELECT section, sec.id, count(*) AS n FROM sec JOIN sel ON sel.id = sec.id GROUP BY section, sec.id""".replace("UNION ALL SELECT 'policies', id FROM", "UNION ALL SELECT 'nearby', id FROM near UNION ALL SELECT 'policies', id FROM").replace("sec AS (", _NEAR + "sec AS (", 1))
def q_dossier(t):
    sel = t.places.where("district = 'ASIA' and kind in ('residential', 'school')").select("id")
    school = F.col("entity_id").startswith("school:")
    a, b = t.post_places.where(school).withColumnRenamed("entity_id", "a"), t.post_places.where(~school).withColumnRenamed("entity_id", "b")
    together = a.join(b, "post_id").groupBy("a", "b").agg(F.collect_set("post_id").alias("post_ids"))
    prefix = F.when(F.col("source_id").cast("long") % 3 == 0, "candidate-history:").otherwise("map:")
    policies = t.policies.select(F.col("id").alias("policy_id"), "year", F.array("first_school", "second_school").alias("school_ids"))
    members = t.supplier.select(F.concat(F.lit("group:"), F.col("s_nationkey").cast("string")).alias("group_id"), F.concat(F.lit("school:"), F.col("s_suppkey").cast("string")).alias("school_id"), F.lit("1998").alias("year"), (F.col("s_acctbal") > 0).alias("active"))
    found = detail.dossier(
        sel, t.entities, t.admissions.withColumnRenamed("id", "admission_id").distinct(), t.links, _records(t), t.posts, t.post_places, t.prices, t.projects, t.snapshots, together, policies, t.history,
        t.projects.select(F.concat(prefix, "source_id").alias("source_id"), "entity_id"), members, spatial.nearby(t.places, sel),
    )
    return detail.section_counts({k: v for k, v in found.items() if k != "group_memberships"})  # no group is selected: q_dossier_rows has them


@query(f"""
WITH {{near}}m AS (SELECT 'group:' || CAST(s_nationkey AS STRING) AS id, 'school:' || CAST(s_suppkey AS STRING) AS school FROM supplier)
SELECT 'nearby' AS section, id, entity_id, CAST(distance AS BIGINT) AS distance FROM near WHERE id IN (SELECT id FROM places WHERE district = 'ASIA')
UNION ALL SELECT 'group_memberships', id, school, NULL FROM m WHERE id IN (SELECT id FROM places WHERE district = 'ASIA')""".replace("{near}", _NEAR))
def q_dossier_rows(t):
    sel = t.places.where("district = 'ASIA'").select("id")
    members = t.supplier.select(F.concat(F.lit("group:"), F.col("s_nationkey").cast("string")).alias("group_id"), F.concat(F.lit("school:"), F.col("s_suppkey").cast("string")).alias("school_id"), F.lit("1998").alias("year"), (F.col("s_acctbal") > 0).alias("active"))
    none = lambda *names: t.links.limit(0).select(*[F.lit("").alias(n) for n in names])
    found = detail.dossier(
        sel, t.entities, t.admissions.withColumnRenamed("id", "admission_id").distinct(), t.links, _records(t), t.posts, t.post_places, t.prices, t.projects, t.snapshots,
        none("a", "b", "post_ids"), none("policy_id", "year").withColumn("school_ids", F.array().cast("array<string>")), t.history, none("source_id", "entity_id"), members, spatial.nearby(t.places, sel),
    )
    near = found["nearby"].select(F.lit("nearby").alias("section"), "id", "entity_id", F.col("distance").cast("long").alias("distance"))
    return near.unionByName(found["group_memberships"].select(F.lit("group_memberships").alias("section"), "id", F.col("official_id").alias("entity_id"), F.lit(None).cast("long").alias("distance")))


@query("SELECT id, CAST(to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [lng, lat]}, 'properties': {'id': id, 'name': name}}) AS STRING) AS feature FROM places WHERE lat IS NOT NULL")
def q_geojson(t):
    feature = geo.feature(F.col("lat"), F.col("lng"), id=F.col("id"), name=F.col("name"))
    return t.places.select("id", feature.alias("feature")).where("feature is not null")


@query("SELECT id FROM places WHERE contains(lower(replace(name || id || district, ' ', '')), '001home:')")
def q_matching_options(t):
    options = t.places.select("id", F.col("name").alias("label"), F.col("id").alias("value"), F.col("district").alias("group"))
    return text.matching_options(options, "001 ＨＯＭＥ:").select("id")
