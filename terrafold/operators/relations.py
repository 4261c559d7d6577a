"""Typed relations between places, and graded evidence for one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scope
from ..functions.geo import located
from ..functions.text import in_name_order
from .predicates import relation_matches
from .state import QueryState


def year_links(links: DataFrame, year: str | None) -> DataFrame:
    return links if year is None else links.where(F.col("year").cast("string") == year)


def canonical_ids(links: DataFrame, ids: DataFrame, year: str | None) -> DataFrame:
    """(id, canonical_id): a place itself and the official schools that its campus links name."""
    via = year_links(links, year).join(ids, F.col("campus_id") == F.col("id"), "left_semi").select(F.col("campus_id").alias("id"), F.col("official_school_id").alias("canonical_id"))
    return ids.select("id", F.col("id").alias("canonical_id")).unionByName(via).distinct()


def campus_ids(links: DataFrame, ids: DataFrame, year: str | None) -> DataFrame:
    """(id, campus_id): the campuses linked to official schools."""
    found = year_links(links, year).withColumnRenamed("official_school_id", "id").join(ids.select("id"), "id", "left_semi")
    return found.select("id", "campus_id").distinct()


def related_admissions(admissions: DataFrame, links: DataFrame, ids: DataFrame, s: QueryState) -> DataFrame:
    """(id, admission columns): matching admissions of a school's canonical ids or of a home. Two equi-joins, no OR join."""
    ok = admissions.where(relation_matches(s))
    canon = canonical_ids(links, ids, s.year)
    as_school = ok.join(canon.withColumnRenamed("canonical_id", "school_id"), "school_id")
    as_home = ok.join(ids.select("id", F.col("id").alias("home_id")), "home_id")
    return as_school.unionByName(as_home).dropDuplicates(["id", *admissions.columns])


def admission_school_ids(admissions: DataFrame, links: DataFrame, s: QueryState) -> DataFrame:
    """(id): schools with a matching admission, and campuses linked to them other than by affiliation."""
    own = admissions.where(relation_matches(s)).select(F.col("school_id").alias("id")).distinct()
    linked = year_links(links, s.year).where(F.col("kind") != scope.AFFILIATION).join(own.withColumnRenamed("id", "official_school_id"), "official_school_id", "left_semi")
    return own.unionByName(linked.select(F.col("campus_id").alias("id"))).distinct()


def direct_school_ids(schools: DataFrame, school_years: DataFrame, admissions: DataFrame, links: DataFrame, year: str) -> DataFrame:
    """(id): schools with an official record or admission rows of the year; mere affiliations do not count."""
    own = admissions.where(F.col("active") & (F.col("year").cast("string") == year)).select(F.col("school_id").alias("id")).distinct().withColumn("own", F.lit(True))
    listed = school_years.where(F.col("year").cast("string") == year).select("id").distinct().withColumn("listed", F.lit(True))
    kinds = year_links(links, year).groupBy(F.col("campus_id").alias("id")).agg(F.bool_or(F.col("kind") == scope.AFFILIATION).alias("affiliated"), F.bool_or(F.col("kind") != scope.AFFILIATION).alias("other"))
    j = schools.select("id").join(own, "id", "left").join(listed, "id", "left").join(kinds, "id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.where((no("own") | no("listed")) & (no("own") | ~no("affiliated") | no("other"))).select("id")


def physical_campus(links: DataFrame, entities: DataFrame, year: str | None) -> DataFrame:
    """(official_school_id, campus_id): the nearest located campus of a portal match, unknown distances last."""
    spots = entities.where(located(F.col("lat"), F.col("lng"))).select(F.col("id").alias("campus_id"))
    near = year_links(links, year).where(F.col("kind") == scope.PORTAL_MATCH).join(spots, "campus_id", "left_semi")
    order = F.struct(F.col("distance_m").isNull(), "distance_m", "campus_id")
    return near.groupBy("official_school_id").agg(F.min(order).alias("o")).select("official_school_id", F.col("o.campus_id").alias("campus_id"))


def display_campus(memberships: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Each membership's campus to show: year match, portal match, located, then the smallest distance and id."""
    e = entities.select(F.col("id").alias("campus_id"), located(F.col("lat"), F.col("lng")).alias("__located"))
    j = memberships.join(links.select("campus_id", F.col("official_school_id").alias("official_id"), F.col("year").alias("__y"), F.col("kind").alias("__k"), "distance_m"), "official_id", "left").join(e, "campus_id", "left")
    order = [(F.col("__y") == F.col("year")).desc_nulls_last(), (F.col("__k") == scope.PORTAL_MATCH).desc_nulls_last(), F.col("__located").desc_nulls_last(), F.col("distance_m").asc_nulls_last(), F.col("campus_id").asc_nulls_last()]
    return j.withColumn("__rn", F.row_number().over(W.partitionBy("group_id", "official_id").orderBy(*order))).where("__rn = 1").select(*memberships.columns, "campus_id")


def shadowed(matches: DataFrame, links: DataFrame, year: str | None, favorites: tuple[str, ...] = ()) -> DataFrame:
    """matches without the unlocated official schools of which a located, portal-matched campus matches too."""
    spots = matches.where(located(F.col("lat"), F.col("lng"))).select(F.col("id").alias("campus_id"))
    shadows = year_links(links, year).where(F.col("kind") == scope.PORTAL_MATCH).join(spots, "campus_id", "left_semi").select(F.col("official_school_id").alias("id")).distinct().withColumn("__shadow", F.lit(True))
    keep = located(F.col("lat"), F.col("lng")) | F.col("__shadow").isNull() | F.col("id").isin(*favorites)
    return matches.join(shadows, "id", "left").where(keep).drop("__shadow").select(*matches.columns)


def exists_directly_or_by_campus(records: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Records whose school is located, or has a located campus of the same year."""
    spots = entities.where(located(F.col("lat"), F.col("lng"))).select("id")
    direct = records.join(spots.withColumnRenamed("id", "official_id"), "official_id", "left_semi")
    by = links.join(spots.withColumnRenamed("id", "campus_id"), "campus_id", "left_semi").select(F.col("official_school_id").alias("official_id"), "year").distinct()
    return direct.unionByName(records.join(by, ["official_id", "year"], "left_semi")).distinct()


TIERS = {"official": ("official", "affiliation", "co", "nearby"), "co": ("co", "nearby"), "nearby": ("nearby", "co")}


def relation_items(entities: DataFrame, admissions: DataFrame, links: DataFrame, co_mentions: DataFrame, nearby: DataFrame, selected: DataFrame, s: QueryState) -> DataFrame:
    """All evidence items: rows (selected_id, tier, id, rows, note, distance, located), for any number of selected places.

    selected: (id). co_mentions: (a, b, post_id). nearby: (id, entity_id, distance). Identical admission rows count once.
    A school reached only over affiliations gives the tier affiliation. Partners are of the opposite kind, and schools
    must be primary if the state says so.
    """
    who = entities.join(selected.select("id"), "id", "left_semi").select(F.col("id").alias("selected_id"), (F.col("kind") == "school").alias("is_school"))
    campus = physical_campus(links, entities, s.year)
    ok = admissions.where(relation_matches(s)).dropDuplicates(["id"])
    canon = canonical_ids(links, selected, s.year).withColumnsRenamed({"id": "selected_id", "canonical_id": "school_id"})
    via = year_links(links, s.year).groupBy(F.col("campus_id").alias("selected_id"), F.col("official_school_id").alias("school_id")).agg(F.every(F.col("kind") == scope.AFFILIATION).alias("only_affiliated"))
    schools = ok.join(canon, "school_id").join(who.where("is_school"), "selected_id", "left_semi").join(via, ["selected_id", "school_id"], "left")
    tier = F.when((F.col("school_id") != F.col("selected_id")) & F.coalesce("only_affiliated", F.lit(False)), "affiliation").otherwise("official")
    from_school = schools.select("selected_id", tier.alias("tier"), F.col("home_id").alias("id"), "admission_type", F.lit(None).cast("string").alias("post_id"), F.lit(None).cast("double").alias("distance"))
    homes = ok.join(who.where("not is_school").select(F.col("selected_id").alias("home_id")), "home_id", "left_semi")
    homes = homes.join(campus.withColumnRenamed("official_school_id", "school_id"), "school_id", "left")
    from_home = homes.select(F.col("home_id").alias("selected_id"), F.lit("official").alias("tier"), F.coalesce("campus_id", "school_id").alias("id"), "admission_type", F.lit(None).cast("string").alias("post_id"), F.lit(None).cast("double").alias("distance"))
    both = co_mentions.select(F.col("a").alias("selected_id"), F.col("b").alias("id"), "post_id").unionByName(co_mentions.select(F.col("b").alias("selected_id"), F.col("a").alias("id"), "post_id"))
    co = both.where("post_id is not null").join(who, "selected_id", "left_semi").select("selected_id", F.lit("co").alias("tier"), "id", F.lit(None).cast("string").alias("admission_type"), "post_id", F.lit(None).cast("double").alias("distance"))
    near = nearby.where(F.col("distance").between(0, scope.NEARBY_RADIUS_M)).join(who.withColumnRenamed("selected_id", "id"), "id", "left_semi")
    near = near.select(F.col("id").alias("selected_id"), F.lit("nearby").alias("tier"), F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("admission_type"), F.lit(None).cast("string").alias("post_id"), F.col("distance").cast("double").alias("distance"))
    items = from_school.unionByName(from_home).unionByName(co).unionByName(near)
    partner = entities.select("id", (F.col("kind") == "school").alias("p_school"), F.col("kind").alias("p_kind"), "primary_school", located(F.col("lat"), F.col("lng")).alias("located"))
    items = items.where("id <> selected_id").join(partner, "id").join(who, "selected_id")
    opposite = F.when(F.col("is_school"), F.col("p_kind") == "residential").otherwise(F.col("p_school"))
    items = items.where(opposite & (~F.col("p_school") | F.coalesce("primary_school", F.lit(False)) if s.primary_only else opposite))
    rows = F.when(F.col("tier") == "co", F.countDistinct("post_id")).when(F.col("tier") == "nearby", F.lit(1)).otherwise(F.count(F.lit(1)))
    note = F.array_join(F.sort_array(F.collect_set("admission_type")), " / ")
    return items.groupBy("selected_id", "tier", "id").agg(rows.cast("long").alias("rows"), note.alias("note"), F.min("distance").alias("distance"), F.bool_or("located").alias("located"))


def relation_plan(items: DataFrame, entities: DataFrame, selected: DataFrame, requested: str = "official") -> DataFrame:
    """One row per selected place: the first tier in the requested order that has items, and its counts."""
    order = TIERS[requested]
    n = items.withColumn("__o", F.array_position(F.array(*map(F.lit, order)), F.col("tier"))).where("__o > 0")
    agg = n.groupBy("selected_id", "tier", "__o").agg(F.count(F.lit(1)).alias("items"), F.count_if("located").alias("located_count"))
    best = agg.groupBy("selected_id").agg(F.min_by(F.struct("tier", "items", "located_count"), "__o").alias("b"))
    who = entities.join(selected.select("id"), "id", "left_semi").select(F.col("id").alias("selected_id"), (F.col("kind") == "school").alias("is_school"), located(F.col("lat"), F.col("lng")).alias("selected_located"))
    j = who.join(best, "selected_id", "left")
    tier, count = F.coalesce("b.tier", F.lit("none")), F.coalesce("b.items", F.lit(0))
    here = F.coalesce("b.located_count", F.lit(0))
    return j.select("selected_id", tier.alias("tier"), count.alias("items"), here.alias("located_count"), (count - here).alias("unlocated_count"), F.when(F.col("selected_located"), here).otherwise(0).alias("drawable_count"), (tier != requested).alias("fallback"), (F.col("is_school") & (tier == "official") & (count > 0)).alias("can_scope"))


def district_fallback(entities: DataFrame, candidates: DataFrame, selected: DataFrame, limit: int = scope.DISTRICT_FALLBACK) -> DataFrame:
    """Up to eight official places of the selected place's district: located first, then by posts, name and id.

    The order doesn't depend on the selected place, and which places stand against it depends on its kind and id only. So
    the first places of each district and kind, one more than the limit for the selected place itself, are all that it can
    get: they are cut in every task before they meet, and no selected place meets all places of its district."""
    who = entities.join(selected.select("id"), "id", "left_semi").select(F.col("id").alias("selected_id"), "district", F.col("kind").alias("s_kind"))
    pool = entities.join(candidates.select("id"), "id", "left_semi").withColumn("located", located(F.col("lat"), F.col("lng")))
    order = [F.desc("located"), F.col("post_count").desc_nulls_last(), in_name_order(F.col("name")), "id"]
    best = pool.withColumn("rank", F.row_number().over(W.partitionBy("district", "kind").orderBy(*order))).where(F.col("rank") <= limit + 1).drop("rank")
    j = who.join(best, "district").where((F.col("kind") != F.col("s_kind")) & (F.col("id") != F.col("selected_id")))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("selected_id").orderBy(*order))).where(F.col("rank") <= limit).select("selected_id", "rank", "id", "located")
