"""Entity resolution: records to catalogue places, market identities, reviewed bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scope
from ..functions.text import norm
from ..functions.values import digest, district_name, id_set_lock
from .predicates import first_reason, must


def lookup(entities: DataFrame) -> DataFrame:
    """(district, kind, key, id): a catalogue place under its name and aliases."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    flat = entities.select("district", "kind", "id", F.explode(names).alias("n"))
    keyed = flat.select(district_name(F.col("district")).alias("district"), "kind", norm(F.col("n"), F.col("kind") == "school").alias("key"), "id")
    return keyed.where("key <> ''").distinct()


def minted_id(source: Column, record: Column, kind: Column, district: Column, key: Column) -> Column:
    """The deterministic id of a record that matches no single place."""
    home_code = F.regexp_extract(record, "^home:([0-9]+)$", 1)
    return (
        F.when((source == "admissions") & (kind == "school"), F.concat(F.lit("official:school:"), record))
        .when((source == "admissions") & (home_code != ""), F.concat(F.lit("official:residential:"), home_code))
        .when(source == "candidates", F.concat(F.lit("candidate:residential:"), F.substring(digest(record), 1, 20)))
        .otherwise(F.concat(F.lit("local:"), kind, F.lit(":"), F.substring(digest(F.concat(district, F.lit("|"), key)), 1, 20)))
    )


def resolve(records: DataFrame, entities: DataFrame, spatial_prefix: str = "osm:", order: str = "record") -> DataFrame:
    """(source, record, entity_id, status, options) for records (source, record, name, kind, district, aliases).

    One stage of resolution: every record sees the same catalogue; run stage after stage, with minted() in between, for
    sources that come in order. Exactly one match is taken (spatial ids win over others), several are ambiguous, none is
    unmatched; the latter two get a minted id. Of unmatched records that share source, district and name the first by
    order mints it, and the others match it.
    A null or empty district looks into all districts.
    """
    r = records.withColumns({"district": F.coalesce(district_name(F.col("district")), F.lit("")), "__names": F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))})
    keyed = r.select("source", "record", "kind", "district", F.explode("__names").alias("n")).select("source", "record", "kind", "district", norm(F.col("n"), F.col("kind") == "school").alias("key")).where("key <> ''").distinct()
    table = lookup(entities)
    local = keyed.where("district <> ''").join(table, ["district", "kind", "key"]).select("source", "record", "id")
    anywhere = keyed.where("district = ''").join(table.drop("district"), ["kind", "key"]).select("source", "record", "id")
    found = local.unionByName(anywhere).distinct().join(entities.select("id", F.col("lat").isNotNull().alias("placed")), "id")
    spatial = F.col("id").startswith(spatial_prefix)
    sets = found.groupBy("source", "record").agg(F.sort_array(F.collect_set(F.when(spatial, F.col("id")))).alias("s"), F.sort_array(F.collect_set("id")).alias("a"), F.bool_or(spatial & F.col("placed")).alias("sp"), F.bool_or("placed").alias("ap"))
    sets = sets.select("source", "record", F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("a")).alias("options"), F.when(F.size("s") > 0, F.col("sp")).otherwise(F.col("ap")).alias("placed"))
    j = r.join(sets, ["source", "record"], "left").withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
    key = norm(F.col("name"), F.col("kind") == "school")
    one = F.size("options") == 1
    status = F.when(one & F.col("placed"), "name_match_review_required").when(one, "same_name_unlocated").when(F.size("options") > 1, "ambiguous").otherwise("unmatched")
    j = j.withColumns({"__key": key, "status": status}).withColumn("__id", F.when(one, F.element_at("options", 1)).otherwise(minted_id(F.col("source"), F.col("record"), F.col("kind"), F.col("district"), F.col("__key"))))
    # The first unmatched record of a name mints the place; the others of the stage then match that one.
    same = W.partitionBy("source", "district", "kind", "__key", "status").orderBy(order, "record")
    j = j.withColumns({"__first": F.first("__id").over(same), "__rn": F.row_number().over(same)})
    later = (F.col("status") == "unmatched") & (F.col("__rn") > 1) & (F.col("__key") != "")
    return j.select(
        "source", "record", F.when(later, F.col("__first")).otherwise(F.col("__id")).alias("entity_id"), F.when(later, "same_name_unlocated").otherwise(F.col("status")).alias("status"),
        F.when(later, F.array("__first")).otherwise(F.col("options")).alias("options"), "name", "kind", "district",
    )


def minted(resolved: DataFrame) -> DataFrame:
    """New, unlocated entities of a stage: one per minted id, under its name only; the first record by id names it."""
    new = resolved.where(F.col("status").isin("ambiguous", "unmatched"))
    first = new.withColumn("__rn", F.row_number().over(W.partitionBy("entity_id").orderBy("record"))).where("__rn = 1")
    return first.select(F.col("entity_id").alias("id"), "kind", "name", "district", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.array().cast("array<string>").alias("aliases"))


def resolve_stages(stages: list[DataFrame], entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources in their fixed order: each stage also sees the places that earlier ones minted.

    Returns (resolved, entities with the new ones). A minted id of an earlier stage is not minted again."""
    out, columns = None, [c for c in ("id", "kind", "name", "district", "lat", "lng", "aliases") if c in entities.columns]
    known = entities.select(*columns)
    for records in stages:
        found = resolve(records, known)
        new = minted(found).select(*columns).join(known.select("id"), "id", "left_anti")
        known = known.unionByName(new)
        out = found if out is None else out.unionByName(found)
    return out, known


def market_identities(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per (source, community, district): how its names hang together, and the place they bridge to.

    rows: source, community_id, district, community, directory_name, record_kind, already without quarantined rows.
    """
    name = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    formal = F.when(F.col("record_kind").isin("listing", "community_reference"), name("community"))
    g = rows.groupBy("source", "community_id", "district").agg(F.collect_set(name("community")).alias("n"), F.collect_set(name("directory_name")).alias("d"), F.collect_set(formal).alias("f"))
    g = g.select("source", "community_id", "district", F.array_sort(F.array_union("n", "d")).alias("names"), F.array_sort(F.array_union("d", "f")).alias("canonical_names"), F.size("d").alias("nd"))
    keys = g.select("source", "community_id", "district", F.explode("names").alias("n")).withColumn("key", norm(F.col("n")))
    hits = keys.join(lookup(entities.where("kind = 'residential'")).drop("kind"), ["district", "key"]).where(F.col("id").startswith("osm:"))
    spatial = hits.groupBy("source", "community_id", "district").agg(F.sort_array(F.collect_set("id")).alias("spatial"))
    j = g.join(spatial, ["source", "community_id", "district"], "left").withColumn("spatial", F.coalesce("spatial", F.array().cast("array<string>")))
    status = F.coalesce(first_reason(
        (F.size("names") <= 1, "no_alias_change"),
        (F.exists("names", lambda n: n.rlike(scope.PHASE)), "phase_names_preserved"),
        ((F.col("nd") == 0) | (F.size("canonical_names") != 1), "directory_identity_unresolved"),
        (F.size("spatial") > 1, "ambiguous_catalogue_matches"),
    ), F.lit("source_project_marketing_alias_bridge"))
    bridge = F.col("status") == "source_project_marketing_alias_bridge"
    return j.withColumn("status", status).select("source", "community_id", "district", "names", "canonical_names", "status", F.when(bridge, F.try_element_at("spatial", F.lit(1))).alias("target_id"))


def locked_bridge(rows: DataFrame, bridges: DataFrame, id_col: str = "id") -> DataFrame:
    """Bridges with lock: whether the live rows of their source are exactly the reviewed set (count and digest).

    rows: (source_entity_id, id). bridges: (source_entity_id, target_entity_id, count, sha256). Moves apply only as a
    whole: use repoint() with the rows of bridges whose lock holds."""
    live = rows.groupBy("source_entity_id").agg(id_set_lock(F.col(id_col)).alias("__live"))
    ok = F.coalesce((F.col("__live.count") == F.col("count")) & (F.col("__live.sha256") == F.col("sha256")), F.lit(False))
    return bridges.join(live, "source_entity_id", "left").withColumn("lock", ok).drop("__live")



def identity_basis(basis: Column, source_name: Column, target_name: Column, project_names: Column, argument: Column) -> Column:
    """Whether the stated basis holds: exact names, a suffix or prefix taken off, or the project's text names both."""
    a, b = norm(source_name), norm(target_name)
    return F.coalesce(
        F.when(basis == "exact", a == b)
        .when(basis.isin("project_suffix", "official_suffix"), (a == F.concat(b, norm(argument))) | (b == F.concat(a, norm(argument))))
        .when(basis == "brand_prefix", (a == F.concat(norm(argument), b)) | (b == F.concat(norm(argument), a)))
        .when(basis == "project_text", F.array_contains(project_names, source_name) & F.array_contains(project_names, target_name)),
        F.lit(False),
    )


def history_places(rows: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """rows plus entity_id: the candidate of the same name (the last by ord, if several), else the place that the name or
    the matched name resolves to in any district.

    rows: source, name, matched_name. candidates: name, entity_id, ord."""
    known = candidates.groupBy(norm(F.col("name")).alias("__key")).agg(F.max_by("entity_id", "ord").alias("__known"))
    j = rows.withColumn("__key", norm(F.col("name"))).join(known, "__key", "left")
    matched = F.filter(F.array("matched_name"), lambda x: x.isNotNull())
    open_ = j.where("__known is null").groupBy("source", "name").agg(F.array_distinct(F.flatten(F.collect_list(matched))).alias("aliases"))
    records = open_.select("source", F.col("name").alias("record"), "name", F.lit("residential").alias("kind"), F.lit(None).cast("string").alias("district"), "aliases")
    found = resolve(records, entities).select("source", F.col("record").alias("name"), F.col("entity_id").alias("__found"))
    return j.join(found, ["source", "name"], "left").select(*[j[c] for c in rows.columns], F.coalesce("__known", "__found").alias("entity_id"))


def crosswalk(links: DataFrame, records: DataFrame, entities: DataFrame) -> DataFrame:
    """links plus entity_id, the school that holds the official id in that year. A link whose record or whose campus is
    missing stops the query. links: campus_id, official_id, year. records: official_id, year, entity_id."""
    own = records.groupBy("official_id", "year").agg(F.min("entity_id").alias("entity_id"))
    there = entities.select(F.col("id").alias("campus_id"), F.lit(True).alias("__there")).distinct()
    j = links.join(own, ["official_id", "year"], "left").join(there, "campus_id", "left")
    ok = F.col("entity_id").isNotNull() & F.col("__there")
    return j.select(*links.columns, must(ok, "a campus link's target is missing", F.col("entity_id")).alias("entity_id"))


def project_merges(claims: DataFrame, projects: DataFrame, entities: DataFrame, spatial_prefix: str = "osm:") -> DataFrame:
    """(id, source_id, from_entity_id, target, evidence_id): projects that a reviewed claim moves to its own place.

    claims: evidence_id, entity_id (what it resolved to), target_entity_id, district, merge_ids. projects: id, source_id,
    entity_id. A claim that did not resolve to its spatial target, or names a project that is missing or lies in another
    district, stops the query. Use upsert.repoint with the moves on projects, prices and mappings."""
    c = claims.where(F.col("target_entity_id").isNotNull() | (F.size("merge_ids") > 0))
    resolved = (F.col("target_entity_id") == F.col("entity_id")) & F.col("entity_id").startswith(spatial_prefix)
    c = c.select("evidence_id", must(resolved, "a project bridge did not resolve to its declared place", F.col("entity_id")).alias("target"), "district", F.explode_outer("merge_ids").alias("id"))
    prior = projects.select("id", "source_id", F.col("entity_id").alias("from_entity_id")).join(entities.select(F.col("id").alias("from_entity_id"), F.col("district").alias("__district")), "from_entity_id")
    j = c.join(prior, "id", "left").where(F.col("id").isNotNull() | ~F.col("target").startswith(spatial_prefix))
    same = must(F.col("__district") == F.col("district"), "a project bridge's project is missing or in another district", F.col("from_entity_id"))
    return j.select("id", "source_id", same.alias("from_entity_id"), "target", "evidence_id").where(F.col("from_entity_id") != F.col("target"))
