"""Queries over places, posts, sources and policies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scope
from ..functions import geo, text
from . import market, relations
from .predicates import district_is, relation_matches
from .ranks import global_rank
from .state import QueryState


def with_portal_names(entities: DataFrame, links: DataFrame, year: str) -> DataFrame:
    """entities plus portal_names: names and aliases of the official schools that a portal match ties to a campus."""
    official = entities.select(F.col("id").alias("official_school_id"), F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("n"))
    via = relations.year_links(links, year).where(F.col("kind") == scope.PORTAL_MATCH).join(official, "official_school_id")
    names = via.groupBy(F.col("campus_id").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("n")))).alias("portal_names"))
    return entities.join(names, "id", "left")


def _search(entities: DataFrame, links: DataFrame, s: QueryState) -> DataFrame:
    none = F.array().cast("array<string>")
    e = with_portal_names(entities, links, s.year)
    values = F.concat(F.array("name", "address", "candidate.plate", "candidate.name"), F.coalesce("aliases", none), F.coalesce("project_names", none), F.coalesce("portal_names", none))
    # Forms of all values in one text, so that the normal form is one Arrow pass; a control character parts them.
    sep = "\x1f"
    joined = text.normalize(F.array_join(F.filter(values, lambda v: v.isNotNull()), sep))
    forms = F.split(joined, sep)
    both = F.concat(forms, F.transform(forms, lambda v: F.regexp_replace(v, f"^{scope.CITY_PREFIX}", "")))
    return e.withColumns({"__forms": both, "__query": text.search_forms(F.lit(s.query))}).where(text.matches(F.col("__forms"), F.col("__query"))).select(*entities.columns)


def matching_entities(entities: DataFrame, admissions: DataFrame, links: DataFrame, prices: DataFrame, s: QueryState) -> DataFrame:
    """The places that pass the state, in no order.

    entities: id, kind, name, district, lat, lng, primary_school, address, aliases, project_names, candidate (rank,
    built_year, plate, name), post_count, group_member_count. Every set of ids is a semi-join; schools pass housing
    filters through the homes admitted to them.
    """
    ok = admissions.where(relation_matches(s))
    official = relations.admission_school_ids(admissions, links, s)
    is_group = F.col("kind") == "school_group"
    found = entities.where(district_is(s, F.col("district")))
    if s.kind != "all":
        found = found.where(F.col("kind") == s.kind)
    if s.primary_only:
        found = found.where((F.col("kind") != "school") | F.coalesce("primary_school", F.lit(False)))
    here = geo.located(F.col("lat"), F.col("lng"))
    free = is_group if s.kind == "school_group" else F.lit(False)
    if s.located != "all":
        found = found.where(free | (here if s.located == "yes" else ~here))
    for box in (s.bounds, s.rectangle):
        if box:
            found = found.where(free | F.coalesce(geo.inside(F.col("lat"), F.col("lng"), box), F.lit(False)))
    if s.favorite_only:
        found = found.where(F.col("id").isin(*s.favorites))
    if s.query.strip():
        found = _search(found, links, s)
    if s.school_id:
        chosen = entities.where(F.col("id") == s.school_id).select("id")
        canon = relations.canonical_ids(links, chosen, s.year).select(F.col("canonical_id").alias("school_id"))
        found = found.where(~is_group).join(ok.join(canon, "school_id", "left_semi").select(F.col("home_id").alias("id")), "id", "left_semi")
    if s.official_only:
        allowed = official.unionByName(ok.select(F.col("home_id").alias("id"))).distinct().withColumn("__ok", F.lit(True))
        found = found.join(allowed, "id", "left").where(is_group | F.col("__ok")).drop("__ok")
    if s.housing_active:
        homes = market.matching_homes(entities.where(F.col("kind") == "residential"), prices, s)
        admitted = admissions.join(homes.withColumnRenamed("id", "home_id"), "home_id", "left_semi")
        schools = relations.admission_school_ids(admitted, links, s)
        found = found.where(~is_group).join(homes.unionByName(schools).distinct(), "id", "left_semi")
    return relations.shadowed(found, links, s.year, s.favorites)


def query_entities(entities: DataFrame, admissions: DataFrame, links: DataFrame, prices: DataFrame, s: QueryState) -> DataFrame:
    """The places that pass the state, with ord: their position in the result.

    Groups come first, by members; then places with an official admission, candidates by rank, and by posts and name."""
    found = matching_entities(entities, admissions, links, prices, s)
    official = relations.admission_school_ids(admissions, links, s).withColumn("__official", F.lit(True))
    ranked = found.join(official, "id", "left")
    rank = F.coalesce("candidate.rank", F.lit(scope.UNRANKED))
    coarse = [(F.col("kind") == "school_group").cast("int"), F.coalesce("group_member_count", F.lit(0)), F.coalesce("__official", F.lit(False)).cast("int"), F.col("candidate").isNotNull().cast("int"), -rank, F.coalesce("post_count", F.lit(0))]
    return global_rank(ranked, coarse, [text.in_name_order(F.col("name")).asc_nulls_last(), F.col("id")], "ord").select(*entities.columns, "ord")


def search_posts(posts: DataFrame, query: str, limit: int = scope.POST_LIMIT) -> DataFrame:
    """Posts that contain the query literally: those read in depth first, then the newest; total counts all of them."""
    hits = posts.where(text.literal_search(query, F.col("title"), F.col("description")))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    top = hits.orderBy(F.coalesce("deep_read", F.lit(False)).desc(), F.col("posted").desc_nulls_last(), "id").limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row


def filter_posts(posts: DataFrame, post_places: DataFrame, scope_ids: DataFrame, s: QueryState) -> DataFrame:
    """Posts that mention a place in scope; posts without places by district, if nothing asks for a place."""
    named = posts.join(post_places.join(scope_ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(F.col("post_id").alias("id")), "id", "left_semi")
    price = s.price_active or s.built_after is not None
    free = s.kind == "all" and not (s.school_id or s.bounds or s.rectangle or s.official_only or s.candidate_only or s.favorite_only or price) and s.located == "all"
    if not free:
        return named
    rest = posts.join(post_places.select(F.col("post_id").alias("id")), "id", "left_anti")
    if s.district:
        names = scope.MAIN_DISTRICTS if s.district == "main" else (s.district,)
        ok = F.lit(False)
        for d in names:
            ok = ok | F.coalesce(F.contains(F.lower(F.col("district")), F.lit(d.removesuffix(scope.DISTRICT_SUFFIX).lower())), F.lit(False))
        rest = rest.where(ok)
    return named.unionByName(rest)


def source_page(sources: DataFrame, query: str = "", page: float = 1, focus: str = "", size: int = scope.SOURCE_PAGE) -> DataFrame:
    """One page of the sources whose fields contain every term; a focus shows its exact id and never another."""
    hits = sources
    if focus:
        hits = sources.where(F.col("id") == focus)
    elif query.strip():
        fields = text.normalize(F.concat_ws("\x1f", "label", "id", "notes", "url", "source_as_of", "observed_at", "kind"))
        hits = sources.withColumn("__f", fields)
        for term in query.split():
            hits = hits.where(F.contains(F.col("__f"), text.normalize(F.lit(term))))
        hits = hits.drop("__f")
    matched = hits.count()
    pages = max(1, -(-matched // size))
    asked = 1 if focus or not math.isfinite(page) else math.floor(page)
    current = min(pages, max(1, asked))
    before = (current - 1) * size
    # Only the page's own rows are numbered: the sort below keeps the first of each partition.
    shown = hits.orderBy("id").offset(before).limit(size)
    facts = {"row": F.row_number().over(W.orderBy("id")) + F.lit(before), "matched": F.lit(matched).cast("long"), "page": F.lit(current).cast("long"), "page_count": F.lit(pages).cast("long")}
    return shown.withColumns(facts)


def policy_groups(policies: DataFrame, year: str) -> DataFrame:
    """Policies of the year (current), and local archives of other stated years (other)."""
    other = (F.col("kind") == scope.LOCAL_ARCHIVE) & F.col("year").rlike("^[0-9]{4}$") & (F.col("year") != year)
    return policies.withColumn("group", F.when(F.col("year") == year, "current").when(other, "other")).where("group is not null")


def policies_for(policies: DataFrame, schools: DataFrame) -> DataFrame:
    """(id, policy_id): policies that list a school, exploded on both sides of an equi-join."""
    listed = policies.select(F.col("id").alias("policy_id"), F.explode("school_ids").alias("id"))
    return listed.join(schools.select("id"), "id", "left_semi").distinct()


def context_homes(entities: DataFrame, drawn: DataFrame, s: QueryState) -> DataFrame:
    """Named, located homes that are not drawn yet; none in a focus mode."""
    if not s.context_homes or s.markers in ("selected", "relations") or s.labels in ("selected", "off"):
        return entities.limit(0)
    ok = (F.col("kind") == "residential") & geo.located(F.col("lat"), F.col("lng")) & (F.trim(F.coalesce("name", F.lit(""))) != "")
    return entities.where(ok).join(drawn.select("id"), "id", "left_anti").dropDuplicates(["id"])


def shown(results: DataFrame, pages: int = 1, size: int = scope.SOURCE_PAGE) -> DataFrame:
    """Ranked results (ord from 1) as far as they are unrolled: each page adds so many."""
    return results.where(F.col("ord") <= pages * size)


def toggle_compare(ids: list[str], one: str, most: int = 4) -> list[str]:
    """The compare set with one place put in or taken out; a full set takes no more."""
    return [x for x in ids if x != one] if one in ids else ids if len(ids) >= most else [*ids, one]


def saved_ids(ids: Column, valid: Column) -> Column:
    """Distinct known ids, in their order."""
    return F.array_intersect(F.array_distinct(ids), valid)
