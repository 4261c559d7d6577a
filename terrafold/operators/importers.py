"""Gated imports: every row is accepted or gets the first reason in a fixed order why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scope
from ..functions.text import body_hash, meaningful_characters, rental_only
from ..functions.values import day, positive, present, safe_url
from .predicates import first_reason

# The identities that reviewed records carry.
NOTE_ID = "^[0-9a-f]{24}$"
SHA256 = "^[0-9a-f]{64}$"
DETAIL_ID = "^[A-Za-z0-9_]{1,64}$"
ANONYMOUS_ID = "^fang:deal:[0-9a-f]{64}$"
OBSERVED = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$"


def observed_ok(c: Column) -> Column:
    """An ISO time with an offset that is a real time."""
    return F.coalesce(c.rlike(OBSERVED) & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def accepted_project() -> Column:
    return F.coalesce((F.col("detail_fetch_status") == "ok") & F.col("district_consistent") & F.col("is_residential") & present(F.col("name")) & (safe_url(F.col("source_url")) != ""), F.lit(False))


def accepted_price(kinds: tuple[str, ...] = ("deal", "listing")) -> Column:
    return F.coalesce(F.col("record_kind").isin(*kinds) & present(F.col("community")) & present(F.col("district")) & (safe_url(F.col("source_url")) != ""), F.lit(False))


def accepted_snapshot() -> Column:
    return F.coalesce(accepted_price(("community_reference",)) & positive(F.col("reference_unit_yuan_sqm")).isNotNull(), F.lit(False))


def split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows carry their reason; no row is lost."""
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def reason_counts(*rejected: DataFrame) -> DataFrame:
    """Rejections by reason over bundles."""
    out = rejected[0].select("reason")
    for r in rejected[1:]:
        out = out.unionByName(r.select("reason"))
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def social_reason(rows: DataFrame, baseline_ids: DataFrame, body_ids: DataFrame, baseline_hashes: DataFrame, hosts: tuple[str, ...], path: str = "/explore/") -> DataFrame:
    """rows plus reason: why a post is not accepted, by the fixed order of its own checks and those against a baseline.

    rows: id, source_url, observed_at, body_sha256, meaningful_characters, accepted, exclusion_reason, baseline_index,
    record (id, title, desc, description_kind, valid, exclusion_reasons).
    """
    known = lambda df, key, flag: df.select(F.col(df.columns[0]).alias(key)).distinct().withColumn(flag, F.lit(True))
    j = rows.join(known(baseline_ids, "id", "__valid"), "id", "left").join(known(body_ids, "id", "__body"), "id", "left").join(known(baseline_hashes, "body_sha256", "__hash"), "body_sha256", "left")
    rec = lambda k: F.col(f"record.{k}")
    no = lambda c: F.coalesce(c, F.lit(False))
    n = meaningful_characters(rec("desc"))
    url = safe_url(F.col("source_url"))
    exact = F.lower(F.try_parse_url(F.nullif(url, F.lit("")), F.lit("HOST"))).isin(*hosts) & (F.try_parse_url(F.nullif(url, F.lit("")), F.lit("PATH")) == F.concat(F.lit(path), F.col("id")))
    reason = first_reason(
        (rec("id").isNull() & rec("desc").isNull() & F.col("record").isNull(), "invalid_record_shape"),
        (~no(F.col("id").rlike(NOTE_ID) & (rec("id") == F.col("id"))), "exact_note_id_mismatch"),
        (~no(exact), "exact_source_url_mismatch"),
        (~present(rec("desc")) | (n == 0), "no_prose"),
        (n < scope.MIN_MEANINGFUL, "short_or_low_content"),
    )
    later = first_reason(
        (~no(rec("valid")) | (F.size(F.coalesce(rec("exclusion_reasons"), F.array().cast("array<string>"))) > 0), "out_of_scope"),
        (~no(rec("description_kind") == "prose_or_caption"), "not_prose_or_caption"),
        (rental_only(rec("title"), rec("desc")), "rental_only"),
        (~no(F.col("body_sha256") == body_hash(rec("desc"))), "body_hash_mismatch"),
        (~no(F.col("meaningful_characters") == n), "meaningful_character_count_mismatch"),
        (F.col("baseline_index").isNotNull() & (F.col("baseline_index") != no(F.col("__valid"))), "baseline_index_mismatch"),
        (no(F.col("__body")), "baseline_existing_body"),
        (no(F.col("__hash")), "duplicate_body_baseline"),
        (~observed_ok(F.col("observed_at")), "invalid_observation_time"),
    )
    own = F.when(~no(F.col("accepted")), F.coalesce(F.when(present(F.col("exclusion_reason")), F.col("exclusion_reason")), F.lit("not_accepted")))
    return j.withColumn("reason", F.coalesce(reason, own, later)).select(*rows.columns, "reason")


def reviewed(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """rows plus review_reason: a row needs exactly one review decision, for its own body, that accepts it."""
    r = reviews.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.first("decision").alias("__d"), F.first("body_sha256").alias("__b"))
    reason = first_reason((F.col("__n").isNull(), "review_missing"), (F.col("__n") > 1, "review_ambiguous"), (~F.col("__b").eqNullSafe(F.col("body_sha256")), "review_body_mismatch"), (~F.col("__d").eqNullSafe(F.lit("accept")), "review_not_accepted"))
    return rows.join(r, "id", "left").withColumn("review_reason", reason).select(*rows.columns, "review_reason")


def first_bodies(rows: DataFrame, order: Column, known_ids: DataFrame | None = None, known_bodies: DataFrame | None = None) -> DataFrame:
    """rows plus reason: a repeated id, then a repeated body among the rows that are left; rejected rows keep no body.

    order must not be null and must tell the rows of an id, and of a body, apart. known_ids (id) and known_bodies
    (body_sha256), each value once, are those of earlier batches. First places are partial minima that the rows meet
    again by key, so that an id or a body of very many rows, nulls included, is no window in one task."""

    def first(found: DataFrame, among: DataFrame, c: str, known: DataFrame | None) -> DataFrame:
        least = among.groupBy(F.col(c).alias("__key")).agg(F.min("__o").alias("__least"))
        found = found.join(least, F.col(c).eqNullSafe(F.col("__key")), "left").withColumn("__later", F.col("__o") > F.col("__least")).drop("__key", "__least")
        if known is not None:
            old = known.select(F.col(c).alias("__key"), F.lit(True).alias("__old"))
            found = found.join(old, F.col(c) == F.col("__key"), "left").withColumn("__later", F.col("__later") | F.col("__old").isNotNull()).drop("__key", "__old")
        return found

    judged = rows.withColumn("__o", order)
    judged = first(judged, judged, "id", known_ids).withColumnRenamed("__later", "__again")
    judged = first(judged, judged.where("not __again"), "body_sha256", known_bodies)
    reason = F.when(F.col("__again"), "duplicate_id").when(F.col("__later"), "duplicate_body")
    return judged.withColumn("reason", reason).select(*[c for c in rows.columns if c != "reason"], "reason")


def enrichment_shape(row_url: str = "https://m.fang.com/chengjiao/hz/", focus: tuple[str, ...] = scope.MAIN_DISTRICTS, year: int = 2026) -> Column:
    """Why a price candidate can't be reviewed at all: fourteen reasons, the first that holds."""
    url = F.concat(F.lit(row_url), F.col("source_record_id"), F.lit(".html"))
    event = F.try_to_date("event_date", "yyyy-MM-dd")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    prior = F.col("comparison_prior_record_ids")
    return first_reason(
        (F.col("id").isNull() & F.col("record_kind").isNull(), "invalid_record_shape"),
        (no((F.col("record_kind") == "deal_price_enrichment_candidate") & (F.col("baseline_status") == "existing_841_price_enrichment_candidate")), "not_reviewable_enrichment_candidate"),
        (no(F.col("source_record_id").rlike(DETAIL_ID) & (F.col("id") == F.concat(F.lit("fang:deal:"), F.col("source_record_id")))), "invalid_detail_identity"),
        (no((F.col("source_url") == url) & (F.col("evidence_url") == url)), "detail_url_identity_mismatch"),
        (no((F.size(prior) == 1) & F.try_element_at(prior, F.lit(1)).rlike(ANONYMOUS_ID)), "not_one_exact_anonymous_target"),
        (no(F.col("community_source_id").rlike("^[0-9]{1,20}$")), "invalid_source_community_id"),
        (F.col("community_source_id") == scope.CONFLICTING_PROJECT, f"district_conflict_{scope.CONFLICTING_PROJECT}"),
        (no(F.col("district").isin(*focus)), "district_out_of_scope"),
        (~(present(F.col("community")) & present(F.col("layout")) & present(F.col("orientation"))), "missing_immutable_fields"),
        (positive(F.col("area_sqm")).isNull() | positive(F.col("total_wan")).isNull() | positive(F.col("unit_yuan_sqm")).isNull(), "invalid_or_missing_price_or_area"),
        (no((F.year(event) == year) & observed_ok(F.col("observed_at")) & (F.to_date(F.substring("observed_at", 1, 10)) >= event)), "invalid_2026_event_or_observation_time"),
        (present(F.col("possible_duplicate_group")), "possible_duplicate_unresolved"),
        (no((F.col("price_disclosure") == "visible") & F.col("tls_verification_enabled")), "not_visible_tls_verified_evidence"),
        (no(F.col("evidence_sha256").rlike(SHA256)), "invalid_evidence_hash"),
    )


IMMUTABLE = ("district", "community_source_id", "community", "event_date", "area_sqm", "layout", "orientation")
BUSINESS_KEY = ("district", "community_source_id", "event_date", "area_sqm")


def match_enrichments(candidates: DataFrame, deals: DataFrame) -> DataFrame:
    """candidates plus reason, and the missing price fields that each would fill.

    A candidate names one loaded deal (target_id); its immutable fields must agree, the deal's business key must be its
    alone, its evidence must not serve another deal, and only null prices are filled. deals: id, deal columns and
    used_record_id. Uniqueness is a window count over the key; nothing is compared pair by pair.
    """
    key = W.partitionBy(*BUSINESS_KEY)
    peers = deals.withColumn("__peers", F.count(F.lit(1)).over(key))
    loaded = peers.select(F.col("id").alias("target_id"), *[F.col(c).alias(f"o_{c}") for c in (*IMMUTABLE, "total_wan", "unit_yuan_sqm", "possible_duplicate")], "__peers")
    once = loaded.withColumn("__copies", F.count(F.lit(1)).over(W.partitionBy("target_id"))).dropDuplicates(["target_id"])
    used = deals.where("used_record_id is not null").groupBy(F.col("used_record_id").alias("source_record_id")).agg(F.min("id").alias("__u1"), F.max("id").alias("__u2"))
    j = candidates.withColumn("__claims", F.count(F.lit(1)).over(W.partitionBy("target_id"))).join(once, "target_id", "left").join(used, "source_record_id", "left")
    same = F.lit(True)
    for c in IMMUTABLE:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    conflict = F.lit(False)
    for c in ("total_wan", "unit_yuan_sqm"):
        conflict = conflict | (F.col(f"o_{c}").isNotNull() & (positive(F.col(f"o_{c}")).isNull() | ~F.col(f"o_{c}").eqNullSafe(F.col(c))))
    reason = first_reason(
        (F.col("__claims") > 1, "duplicate_target_in_bundle"),
        (F.col("__copies").isNull() | (F.col("__copies") > 1), "target_not_loaded"),
        (F.col("o_possible_duplicate"), "target_possible_duplicate_unresolved"),
        (~F.col("district").eqNullSafe(F.col("o_district")), "target_entity_district_conflict"),
        (~same, "immutable_fields_mismatch"),
        (F.col("__peers") > 1, "ambiguous_loaded_business_key"),
        (F.col("__u1").isNotNull() & ((F.col("__u1") != F.col("target_id")) | (F.col("__u2") != F.col("target_id"))), "detail_identity_already_used_by_another_deal"),
        (conflict, "existing_price_conflict"),
        (F.col("o_total_wan").isNotNull() & F.col("o_unit_yuan_sqm").isNotNull(), "price_already_complete"),
    )
    fills = F.filter(F.array(F.when(F.col("o_total_wan").isNull(), F.lit("total_wan")), F.when(F.col("o_unit_yuan_sqm").isNull(), F.lit("unit_yuan_sqm"))), lambda x: x.isNotNull())
    return j.withColumn("reason", reason).withColumn("fills", F.when(F.col("reason").isNull(), fills)).select(*candidates.columns, "reason", "fills")


def source_rows(records: DataFrame) -> DataFrame:
    """One source per record of a bundle: it is dated by the record's event, and observed when its detail page was, else
    when the record was. records: id, label, kind, detail_observed_at, observed_at, event_date, source_url. Records that
    share an id are one source; its values are then the least of theirs."""
    values = {"label": F.col("label"), "kind": F.col("kind"), "observed_at": F.coalesce("detail_observed_at", "observed_at"), "source_as_of": day(F.col("event_date")), "url": safe_url(F.coalesce("source_url", F.lit("")))}
    one = F.min(F.struct(*[c.alias(k) for k, c in values.items()])).alias("v")
    return records.groupBy("id").agg(one).select("id", "v.*")


def observation_body(parts: dict[str, Column]) -> Column:
    """A text of labelled lines, one per known part, in the given order."""
    return F.concat_ws("\n", *[F.when(present(c), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in parts.items()])
