"""Composite answers: enriched places, dossiers, archives, panels, metrics. All are set-based: any number of places at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scope
from ..functions import geo
from ..functions.values import positive, price_headline
from . import market, relations
from .predicates import relation_matches
from .state import QueryState

#: Sources whose local copy can be shown as an article.
ARCHIVE_KEYS = ("service_area", "admission_plan", "city_policy_notice", "new_schools_boundary_result")
ARCHIVE_KIND = "official_local_policy_archive"


def _strings() -> Column:
    return F.array().cast("array<string>")


def bootstrap(entities: DataFrame, candidates: DataFrame, post_places: DataFrame, prices: DataFrame, projects: DataFrame, school_records: DataFrame, links: DataFrame, memberships: DataFrame) -> DataFrame:
    """entities with what queries need: candidate, counts, price rows, project names, official years and ids, groups.

    Each side is aggregated by place before it is joined, so no join multiplies rows. Lists are distinct and sorted.
    candidates: (entity_id, candidate); projects: (entity_id, name); school_records: (entity_id, official_id, year);
    memberships: (group_id, school_id, official_id, active).
    """
    by = lambda df, *aggs, key="entity_id": df.groupBy(F.col(key).alias("id")).agg(*aggs)
    row = F.struct("source_id", "kind", "observed_at", "event_date", "total_wan", "unit_yuan_sqm", "area_sqm", "price_as_of", "source_as_of", "possible_duplicate")
    kinds = prices.groupBy("entity_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    years = school_records.select("entity_id", "official_id", "year", F.lit(None).cast("string").alias("link_kind"))
    years = years.unionByName(links.select(F.col("campus_id").alias("entity_id"), F.col("official_school_id").alias("official_id"), "year", F.col("kind").alias("link_kind")))
    member = memberships.select(F.col("school_id").alias("entity_id"), "group_id", "active")
    by_campus = memberships.join(links.select(F.col("official_school_id").alias("school_id"), "campus_id"), "school_id").select(F.col("campus_id").alias("entity_id"), "group_id", "active")
    groups = member.unionByName(by_campus)
    sides = [
        by(candidates, F.first("candidate", True).alias("candidate")),
        by(post_places, F.count(F.lit(1)).alias("post_count")),
        by(kinds, F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("price_counts")),
        by(prices, F.sort_array(F.collect_list(row)).alias("price_filter")),
        by(projects, F.count(F.lit(1)).alias("project_count"), F.sort_array(F.collect_set("name")).alias("project_names")),
        by(years, F.sort_array(F.collect_set("year")).alias("official_years"), F.sort_array(F.collect_set("official_id")).alias("official_ids"), F.sort_array(F.collect_set("link_kind")).alias("official_link_kinds")),
        by(memberships, F.count_if("active").alias("group_member_count"), F.count_if(~F.col("active")).alias("historical_member_count"), key="group_id"),
        by(groups, F.sort_array(F.collect_set(F.when(F.col("active"), F.col("group_id")))).alias("school_group_ids"), F.sort_array(F.collect_set(F.when(~F.col("active"), F.col("group_id")))).alias("historical_school_group_ids")),
    ]
    made = {c for s in sides for c in s.columns} - {"id"}
    out = entities.drop(*made)
    for side in sides:
        out = out.join(side, "id", "left")
    return out


def linked_records(selected: DataFrame, links: DataFrame, school_records: DataFrame) -> DataFrame:
    """(id, school_id, year): the official schools that a campus stands for, each only for its recorded year."""
    via = links.join(selected.select("id"), F.col("campus_id") == F.col("id")).select("id", F.col("official_school_id").alias("school_id"), "year")
    return via.join(school_records.select(F.col("entity_id").alias("school_id"), "year"), ["school_id", "year"], "left_semi").distinct()


def year_guarded(selected: DataFrame, rows: DataFrame, owner: str, linked: DataFrame) -> DataFrame:
    """(id, row columns): a place's own rows of all years, and bridged schools' rows of the linked years only."""
    own = rows.join(selected.select("id", F.col("id").alias(owner)), owner)
    bridged = rows.join(linked.withColumnRenamed("school_id", owner), [owner, "year"])
    cols = ["id", *rows.columns] if "id" not in rows.columns else None
    if cols is None:
        raise ValueError("rename the rows' id first")
    return own.select(*cols).unionByName(bridged.select(*cols)).distinct()


def dossier(selected: DataFrame, entities: DataFrame, admissions: DataFrame, links: DataFrame, school_records: DataFrame, posts: DataFrame, post_places: DataFrame, prices: DataFrame, projects: DataFrame, snapshots: DataFrame, co_mentions: DataFrame, policies: DataFrame, history: DataFrame, mappings: DataFrame, memberships: DataFrame, nearby: DataFrame) -> dict[str, DataFrame]:
    """All sections for the selected places (id): each a table that starts with id; readers order them as they need.

    admissions: (admission_id, school_id, home_id, year, …); mappings: (source_id, entity_id, …); nearby: (id, entity_id,
    distance), see spatial.nearby.
    """
    ids = selected.select("id")
    linked = linked_records(ids, links, school_records)
    of = lambda df, key: df.join(ids.withColumnRenamed("id", key), key).withColumnRenamed(key, "id")
    as_school = year_guarded(ids, admissions, "school_id", linked)
    as_home = admissions.join(ids.select("id", F.col("id").alias("home_id")), "home_id").select("id", *admissions.columns)
    members = memberships.join(ids.withColumnRenamed("id", "group_id"), "group_id", "left_semi")
    shown = relations.display_campus(members.select("group_id", F.col("school_id").alias("official_id"), "year", "active"), links, entities)
    active = shown.where("active").select(F.col("group_id").alias("id"), F.explode(F.array("official_id", "campus_id")).alias("entity_id")).where("entity_id is not null")
    post_ids = ids.select("id", F.col("id").alias("entity_id")).unionByName(active).distinct().join(post_places, "entity_id").select("id", "post_id").distinct()
    policy = policies.select("policy_id", "year", F.explode("school_ids").alias("school_id"))
    by_id = policy.join(ids.select("id", F.col("id").alias("school_id")), "school_id").select("id", "policy_id")
    by_year = policy.join(linked, ["school_id", "year"]).select("id", "policy_id")
    pair = lambda a, b: co_mentions.join(ids.withColumnRenamed("id", a), a).select(F.col(a).alias("id"), F.col(b).alias("entity_id"), "post_ids")
    records = year_guarded(ids, school_records.withColumnRenamed("entity_id", "school_id"), "school_id", linked)
    return {
        "entity": entities.join(ids, "id", "left_semi"),
        "school_records": records,
        "admissions": as_school.unionByName(as_home).distinct(),
        "posts": post_ids.join(posts.withColumnRenamed("id", "post_id"), "post_id"),
        "prices": of(prices.withColumnRenamed("id", "price_id"), "entity_id"),
        "projects": of(projects, "entity_id"),
        "market_snapshots": of(snapshots, "entity_id"),
        "co_mentions": pair("a", "b").unionByName(pair("b", "a")),
        "group_memberships": shown.withColumnRenamed("group_id", "id"),
        "school_links": links.join(ids.select("id", F.col("id").alias("campus_id")), "campus_id").unionByName(links.join(ids.select("id", F.col("id").alias("official_school_id")), "official_school_id")).distinct(),
        "nearby": nearby.join(ids, "id", "left_semi"),
        "policies": by_id.unionByName(by_year).distinct(),
        "mappings": of(mappings.where(~F.col("source_id").startswith("candidate-history:")), "entity_id"),
        "history": of(history, "entity_id"),
    }


def source_status(sources: DataFrame, checks: DataFrame) -> DataFrame:
    """sources with link_status and archive_available. Local archives are never verified; of the rest only a few keyed
    sources have a state: that of their check (id, status), else unverified."""
    key = F.regexp_extract("id", "^policy:(.*)$", 1)
    listed = key.isin(*ARCHIVE_KEYS)
    local = F.col("kind") == ARCHIVE_KIND
    j = sources.join(checks.select("id", F.col("status").alias("__s"), F.col("archived").alias("__a")), "id", "left")
    status = F.when(local, "unverified").when(listed, F.coalesce("__s", F.lit("unverified")))
    return j.withColumns({"link_status": status, "archive_available": F.when(local, True).when(listed, F.coalesce("__a", F.lit(False)))}).drop("__s", "__a")


def source_archives(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """(id, title, year, text, sha256) of local archives that have exactly one policy text."""
    texts = policies.where(F.col("kind") == scope.LOCAL_ARCHIVE).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("year").alias("year"), F.first("body").alias("body"))
    one = texts.where((F.col("n") == 1) & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    s = sources.where(F.col("kind") == ARCHIVE_KIND).select("id", F.col("label").alias("source_label"))
    return s.join(one, "id").select("id", F.coalesce("label", "source_label").alias("title"), "year", F.col("body").alias("text"), F.sha2("body", 256).alias("sha256"))


def snapshot(history: DataFrame, date: str) -> DataFrame:
    """The pool as it was observed on exactly this day: one row per place, the last by event."""
    return market.latest_per_day(history.where(F.col("snapshot_date") == F.lit(date).cast("date")), ["entity_id"], [F.desc("event_id")])


def compare(entities: DataFrame, stats: DataFrame, chosen: list[str]) -> DataFrame:
    """Two to four places side by side, in the order chosen."""
    if not 2 <= len(chosen) <= 4:
        raise ValueError("compare two to four places")
    at = F.array_position(F.array(*map(F.lit, chosen)), F.col("id"))
    return entities.where(F.col("id").isin(*chosen)).join(stats, "id", "left").withColumn("position", at).orderBy("position")


def evidence_panel(selected: DataFrame, links: DataFrame, policies: DataFrame, year: str) -> DataFrame:
    """Per place: links of the year, policies of the year, archives of other years."""
    l = relations.year_links(links, year).join(selected.select(F.col("id").alias("campus_id")), "campus_id", "left_semi").groupBy(F.col("campus_id").alias("id")).agg(F.count(F.lit(1)).alias("year_links"))  # noqa: E741
    p = policies.select("year", "kind", F.explode("school_ids").alias("id"))
    now = F.count_if(F.col("year") == year).alias("current_policies")
    other = F.count_if((F.col("kind") == scope.LOCAL_ARCHIVE) & F.col("year").rlike("^[0-9]{4}$") & (F.col("year") != year)).alias("other_archives")
    p = p.groupBy("id").agg(now, other)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return selected.select("id").join(l, "id", "left").join(p, "id", "left").select("id", zero("year_links"), zero("current_policies"), zero("other_archives"))


def post_places_of(visible: DataFrame, post_places: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, posts): known places that the visible posts mention, and in how many."""
    e = post_places.join(visible.select(F.col("id").alias("post_id")), "post_id", "left_semi").join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return e.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("post_id").alias("posts"))


def other_places(mentions: DataFrame, selected: DataFrame, entities: DataFrame) -> DataFrame:
    """(selected_id, entity_id): the other known places of the documents that mention a selected one."""
    mine = mentions.join(selected.select(F.col("id").alias("entity_id")), "entity_id").select(F.col("entity_id").alias("selected_id"), "post_id")
    return mine.join(mentions, "post_id").where("entity_id <> selected_id").join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("selected_id", "entity_id").distinct()


def relation_list(items: DataFrame, entities: DataFrame, query: str, located_only: bool = False) -> DataFrame:
    """Evidence items whose partner's name or note contains the query, optionally located ones only."""
    j = items.join(entities.select("id", "name"), "id")
    q = query.strip().lower()
    if q:
        j = j.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower(F.coalesce("note", F.lit(""))), F.lit(q)))
    return j.where("located") if located_only else j


def markers(entities: DataFrame, ranked: DataFrame, selected: tuple[str, ...], s: QueryState) -> DataFrame:
    """(id, labelled): located places to draw by mode, and those with a label: selected, in evidence, or highly ranked."""
    e = entities.where(geo.located(F.col("lat"), F.col("lng"))).join(ranked.select("id", "rank"), "id", "left")
    if s.markers == "selected":
        e = e.where(F.col("id").isin(*selected))
    label = F.col("id").isin(*selected) | (F.coalesce("post_count", F.lit(0)) > 0) | F.coalesce(F.col("rank") <= scope.RANK_LABELS, F.lit(False))
    return e.select("id", (label if s.labels != "off" else F.lit(False)).alias("labelled"))


def relation_lines(selected: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """Lines from located selected places to their located partners, with the tier that styles them."""
    at = entities.where(geo.located(F.col("lat"), F.col("lng"))).select("id", "lat", "lng")
    a = selected.select("id").join(at, "id").select(F.col("id").alias("selected_id"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    return items.join(a, "selected_id").join(at, "id").select("selected_id", "id", "tier", "lat1", "lng1", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))


def headlines(prices: DataFrame) -> DataFrame:
    """Price rows with the figure that stands for them and how precise their date is."""
    date = F.coalesce(F.col("event_date").cast("string"), F.col("observed_at").cast("string"))
    precision = F.when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "day").when(date.rlike("^[0-9]{4}-[0-9]{2}$"), "month").otherwise("unknown")
    return prices.withColumns({"headline": price_headline(F.col("kind"), F.col("total_wan"), F.col("unit_yuan_sqm")), "precision": precision})


def metrics(tables: dict[str, DataFrame], prices: DataFrame, admissions: DataFrame) -> DataFrame:
    """(metric, value): rows per table, rows per kind and type, and how many prices are complete."""
    spark = prices.sparkSession
    full = positive(F.col("total_wan")).isNotNull() & positive(F.col("unit_yuan_sqm")).isNotNull()
    out = None
    parts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"rows:{name}").alias("metric"), "value") for name, df in tables.items()]
    parts.append(prices.groupBy(F.concat(F.lit("prices:"), "kind").alias("metric")).agg(F.count(F.lit(1)).alias("value")))
    parts.append(admissions.groupBy(F.concat(F.lit("admissions:"), "admission_type").alias("metric")).agg(F.count(F.lit(1)).alias("value")))
    parts.append(prices.agg(F.count_if(full).alias("value")).select(F.lit("prices:fully_priced").alias("metric"), "value"))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out if out is not None else spark.createDataFrame([], "metric string, value long")


def verification(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, bad_rows, ok) of named tables that must be empty."""
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count(F.lit(1)).alias("bad_rows")).select(F.lit(name).alias("check"), "bad_rows", (F.col("bad_rows") == 0).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def group_plan(memberships: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, id, active, located): a group's members as relations, each at its display campus if it has one."""
    shown = relations.display_campus(memberships, links, entities).withColumn("id", F.coalesce("campus_id", "official_id"))
    return shown.join(entities.select("id", geo.located(F.col("lat"), F.col("lng")).alias("located")), "id").select("group_id", "id", "active", "located")


def bridge_totals(bridges: DataFrame, rows: DataFrame) -> DataFrame:
    """By district: bridges and the rows that they carry. rows: (source_entity_id, …)."""
    n = rows.groupBy("source_entity_id").agg(F.count(F.lit(1)).alias("n"))
    return bridges.join(n, "source_entity_id", "left").groupBy("district").agg(F.count(F.lit(1)).alias("bridges"), F.sum(F.coalesce("n", F.lit(0))).alias("rows"))


def active_relations(admissions: DataFrame, s: QueryState) -> DataFrame:
    """Object by object: matching rows, their types and schools; identical rows count once."""
    ok = admissions.where(relation_matches(s)).dropDuplicates(["id"])
    return ok.groupBy("home_id").agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.sort_array(F.collect_set("admission_type")), " / ").alias("types"), F.countDistinct("school_id").alias("schools"))


def group_counts(rows: DataFrame, by: list[str], distinct: str, name: str) -> DataFrame:
    """Rows per group, and how many different values of a column they have."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(distinct).alias(name))


def completeness(prices: DataFrame) -> DataFrame:
    """By kind: prices with both figures, those without, and the newest date of a complete one."""
    full = F.coalesce(positive(F.col("total_wan")).isNotNull() & positive(F.col("unit_yuan_sqm")).isNotNull(), F.lit(False))
    return prices.groupBy("kind").agg(F.count_if(full).alias("fully_priced"), F.count_if(~full).alias("incomplete"), F.max(F.when(full, F.col("event_date"))).alias("latest_full"))


def active_members(rows: DataFrame, group: str, member: str) -> DataFrame:
    """By group: active and historical rows, and how many years and members they name."""
    return rows.groupBy(group).agg(F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("historical"), F.countDistinct("year").alias("years"), F.countDistinct(member).alias("members"))


def member_totals(groups: DataFrame, by: str = "district") -> DataFrame:
    """Groups, their members in all, and how many groups have any and are located."""
    n = F.coalesce("group_member_count", F.lit(0))
    return groups.groupBy(by).agg(F.count(F.lit(1)).alias("groups"), F.sum(n).alias("members"), F.count_if(n > 0).alias("with_members"), F.count_if(geo.located(F.col("lat"), F.col("lng"))).alias("located"))


def known_mentions(post_places: DataFrame, entities: DataFrame, posts: DataFrame) -> DataFrame:
    """Mentions whose place and post both exist."""
    known = post_places.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return known.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi").select("post_id", "entity_id")


def place_counts(entities: DataFrame, sides: dict[str, DataFrame], kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """Each place with its rows in every side table (entity_id, ...), zero where it has none; kinds: name to (side, kind)."""
    out = entities.select(F.col("id").alias("entity_id"))
    names = []
    for side, rows in sides.items():
        of = {name: F.count_if(F.col("kind") == kind) for name, (at, kind) in kinds.items() if at == side} or {side: F.count(F.lit(1))}
        out = out.join(rows.groupBy("entity_id").agg(*[c.alias(n) for n, c in of.items()]), "entity_id", "left")
        names += of
    return out.select(F.col("entity_id").alias("id"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def section_counts(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, id, n): how many rows each section of a dossier has for a place."""
    out = None
    for name, rows in sections.items():
        part = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "id", "n")
        out = part if out is None else out.unionByName(part)
    return out


def section_order(section: str) -> list[Column]:
    """How a dossier's section reads: newest first for prices, projects and admissions, oldest first for history, nearest
    first for neighbours; the rows' own ids tell ties apart."""
    return {
        "prices": [F.coalesce("event_date", "observed_at").desc_nulls_last(), F.col("price_id")],
        "projects": [F.col("observed_at").desc_nulls_last(), F.col("source_id")],
        "admissions": [F.col("year").desc_nulls_last(), F.col("admission_type"), F.col("admission_id")],
        "history": [F.col("snapshot_date").asc_nulls_last(), F.col("event_id")],
        "nearby": [F.col("distance").asc_nulls_last(), F.col("entity_id")],
    }[section]


def ordered(section: str, rows: DataFrame) -> DataFrame:
    """A section's rows with ord, their position within their place (id)."""
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("id").orderBy(*section_order(section))))
