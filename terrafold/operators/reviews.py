"""Reviewed evidence: frozen baselines, semantic reviews, group and policy catalogues. A broken gate stops the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapsed, nfkc, norm
from ..functions.values import contained, day, present, safe_url
from .importers import NOTE_ID, SHA256, observation_body
from .predicates import first_reason, must


def frozen_baseline(ids: DataFrame, bodies: DataFrame, hashes: DataFrame, loaded: DataFrame, counts: dict[str, int]) -> dict[str, DataFrame]:
    """Checks, each a table that must be empty: repeated or odd ids, bodies outside, ids not loaded, other counts."""
    one = lambda df: df.select(F.col(df.columns[0]).alias("x"))
    twice = lambda df: one(df).groupBy("x").count().where("count > 1").select("x")
    number = lambda df, n: one(df).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != n).select(F.col("n").cast("string").alias("x"))
    return {
        "repeated": twice(ids).unionByName(twice(bodies)).unionByName(twice(hashes)),
        "odd_ids": one(ids).where(~F.coalesce(F.col("x").rlike(NOTE_ID), F.lit(False))),
        "odd_hashes": one(hashes).where(~F.coalesce(F.col("x").rlike(SHA256), F.lit(False))),
        "bodies_outside": one(bodies).join(one(ids), "x", "left_anti"),
        "not_loaded": one(ids).join(one(loaded), "x", "left_anti"),
        "counts": number(ids, counts["valid_count"]).unionByName(number(bodies, counts["body_count"])),
    }


def semantic_review_reason(rows: DataFrame, files: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows plus reason: why a row's review claim does not hold, the first in a fixed order.

    rows: id, body_sha256, claim (decision, body_sha256, review_sha256, review_source). files: path, sha256, registered,
    readable, is_document, reviewed, status. decisions: path, id, decision, body_sha256, body_read_complete, counted.
    A file with one malformed or repeated decision is not believed at all.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    d = decisions.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("path", "id")))
    odd = no(F.col("id").rlike(NOTE_ID) & F.col("decision").isin("accept", "exclude", "review") & F.col("body_sha256").rlike(SHA256))
    per_file = d.groupBy("path").agg(F.bool_or(odd).alias("__odd"), F.bool_or(F.col("__n") > 1).alias("__twice"))
    f = files.join(per_file, "path", "left").withColumnsRenamed({"path": "__path", "sha256": "__sha", "status": "__status"})
    mine = d.where("__n = 1").select(F.col("path").alias("__dp"), F.col("id").alias("__di"), F.col("decision").alias("__dd"), F.col("body_sha256").alias("__db"), "body_read_complete", "counted")
    j = rows.join(f, F.col("claim.review_source") == F.col("__path"), "left")
    j = j.join(mine, (F.col("claim.review_source") == F.col("__dp")) & (F.col("id") == F.col("__di")), "left")
    reason = first_reason(
        (no(F.col("claim.decision") == "accept"), "semantic_review_acceptance_required"),
        (~F.col("claim.body_sha256").eqNullSafe(F.col("body_sha256")), "semantic_review_claim_body_hash_mismatch"),
        (no(F.col("claim.review_sha256").rlike(SHA256)), "semantic_review_file_hash_required"),
        (~present(F.col("claim.review_source")), "semantic_review_source_required"),
        (F.col("__path").isNull(), "semantic_review_source_missing_or_outside"),
        (no((F.col("__sha") == F.col("claim.review_sha256")) & F.col("registered")), "semantic_review_file_changed_or_hash_mismatch"),
        (no(F.col("readable")), "semantic_review_unreadable_document"),
        (no(F.col("is_document")), "semantic_review_invalid_document"),
        ((F.col("reviewed") == F.lit(False)) | F.col("__status").isin("draft", "unreviewed", "pending"), "semantic_review_file_unreviewed"),
        (F.col("__odd"), "semantic_review_invalid_decision"),
        (F.col("__twice"), "semantic_review_duplicate_decision"),
        (F.col("__di").isNull(), "semantic_review_note_not_found"),
        ((F.col("__dd") != "accept") | (F.col("body_read_complete") == F.lit(False)) | (F.col("counted") == F.lit(False)), "semantic_review_source_does_not_accept"),
        (F.col("__db") != F.col("body_sha256"), "semantic_review_source_body_hash_mismatch"),
    )
    return j.withColumn("reason", reason).select(*rows.columns, "reason")


def latest_record(records: DataFrame) -> DataFrame:
    """One record per official id: that of the greatest year."""
    order = W.partitionBy("official_id").orderBy(F.col("year").try_cast("int").desc_nulls_last(), "entity_id")
    return records.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def evidence_text(c: Column) -> Column:
    return collapsed(nfkc(F.coalesce(c, F.lit(""))))


def group_evidence(claims: DataFrame, records: DataFrame, districts: tuple[str, ...]) -> DataFrame:
    """claims plus reason: a membership needs a valid group, a member of its district, its evidence in the latest record
    of the named school, and must be said once. claims: group_id, district, official_id, current, evidence_official_id,
    evidence_contains. records: official_id, year, entity_id, district, detail."""
    last = latest_record(records)
    ev = last.select(F.col("official_id").alias("evidence_official_id"), evidence_text(F.col("detail")).alias("__text"))
    me = last.select("official_id", F.col("district").alias("__district"), F.lit(True).alias("__known"))
    j = claims.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("group_id", "official_id", "current")))
    j = j.join(ev, "evidence_official_id", "left").join(me, "official_id", "left")
    reason = first_reason(
        (~F.coalesce(F.col("group_id").rlike("^group:[a-z0-9-]+:[a-z0-9-]+$") & F.col("district").isin(*districts), F.lit(False)), "invalid_group"),
        (F.col("__text").isNull() | F.col("__known").isNull(), "school_missing"),
        (~F.contains(F.col("__text"), evidence_text(F.col("evidence_contains"))), "evidence_changed"),
        (present(F.col("__district")) & (F.col("__district") != F.col("district")), "cross_district_membership"),
        (F.col("__n") > 1, "duplicate_membership"),
    )
    return j.withColumn("reason", reason).select(*claims.columns, "reason")


def observations(rows: DataFrame, records: DataFrame, entities: DataFrame) -> DataFrame:
    """Accepted construction reports as policy rows (id, entity_id, year, body): never a relation, exactly one school."""
    ok = (F.col("evidence_type") == "construction_progress") & (F.col("creates_official_admission_relation") == F.lit(False)) & ~present(F.col("residential_names")) & ~present(F.col("admission_year")) & day(F.col("published_at")).isNotNull() & (safe_url(F.col("source_url")) != "")
    schools = records.select("official_id", "year", "entity_id").join(entities.select(F.col("id").alias("entity_id"), "name", "district"), "entity_id").distinct()
    j = rows.where(F.coalesce(ok, F.lit(False))).join(schools, ["official_id", "year", "district"])
    n = F.count(F.lit(1)).over(W.partitionBy("id"))
    j = j.withColumn("__n", n).where((F.col("__n") == 1) & (norm(F.col("name"), True) == norm(F.col("canonical_school_name"), True)))
    body = observation_body({"published": F.col("published_at"), "observed": F.col("observed_at"), "quote": F.col("source_quote"), "notes": F.col("notes"), "response sha256": F.col("response_sha256")})
    return j.select("id", "entity_id", F.substring("published_at", 1, 4).alias("year"), body.alias("body"))


def attached_entities(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity_id): each policy document's named place, or an error unless exactly one is there."""
    e = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), "kind", "district")
    j = documents.join(e, ["entity_id", "entity_name", "kind", "district"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = documents.select("id", "entity_id").join(j, "id", "left")
    return both.select(must(F.col("n") == 1, "a policy document must match exactly one place", F.col("id")).alias("id"), "entity_id")


def policy_requirements(sources: DataFrame) -> DataFrame:
    """(id, failed): requirements that an archived policy breaks; one failure rejects its whole bundle.

    sources: id, bundle, sha256, want_sha256, bytes, want_bytes, article, visible, text_sha256, observed_at, title,
    original_title, publication_date, original_publication_date, tls_verified."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    compact = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    offset = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
    rules = {
        "hash": no(F.col("sha256") == F.col("want_sha256")),
        "bytes": no(F.col("bytes") == F.col("want_bytes")),
        "article_too_short": no(F.length(F.trim("article")) >= 100),
        "article_not_in_page": ~F.contains(compact(F.col("visible")), compact(F.col("article"))),
        "text_hash": no((F.col("text_sha256") == F.sha2("article", 256)) | (F.col("text_sha256") == F.sha2("visible", 256))),
        "observation_time": F.col("observed_at").isNotNull() & no(F.col("observed_at").rlike(offset) & F.try_to_timestamp("observed_at").isNotNull()),
        "title": no(F.col("title") == F.col("original_title")),
        "publication_date": no(day(F.col("original_publication_date")) == day(F.col("publication_date"))),
        "tls_claim": F.coalesce(F.col("tls_verified"), F.lit(False)),
    }
    failed = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return sources.select("id", "bundle", failed.alias("failed"))


def archive_requirements(records: DataFrame, hosts: dict[str, str], tree: str = "data/incremental/") -> DataFrame:
    """(id, bundle, failed): what else an archived policy must prove of its record, its capture and its form.

    records has one row per policy. Its record: id, bundle, source_id, creates_official_admission_relation,
    source_bundle_path, sealed_matches (equal sources in the sealed bundle), district, url, this_run_network_fetch,
    tls_verified, tls_note, source_year, publication_date, title. Its capture: path, absolute_path (null: not stated),
    preserved_copy, copy_sha256, want_sha256, article, visible, exact_observed_at. Its form: of a .body page, page_text,
    page_title, page_date, metadata_matches, metadata_tls, snapshot_run_at, metadata_run_at, response_date,
    metadata_date, headers_sha256, want_headers_sha256; of a .json text, json_title, json_url, json_text,
    json_observed_at. Missing values prove nothing, so they fail.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    compact = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    page, text = F.coalesce(F.col("path").endswith(".body"), F.lit(False)), F.coalesce(F.col("path").endswith(".json"), F.lit(False))
    host = F.try_element_at(F.create_map(*[F.lit(x) for pair in hosts.items() for x in pair]), F.col("district"))
    twice = F.count(F.lit(1)).over(W.partitionBy("bundle", "id")) > 1
    rules = {
        "creates_admissions": no(~F.col("creates_official_admission_relation")),
        "identity": no(F.col("id").rlike("^[a-z0-9:._-]{1,160}$")),
        "repeated_identity": twice,
        "source_identity": no(F.col("source_id") == F.col("id")),
        "bundle_outside_tree": ~contained(F.col("source_bundle_path"), tree),
        "not_as_sealed": no(F.col("sealed_matches") == 1),
        "unknown_district": host.isNull(),
        "url_not_canonical": no(safe_url(F.col("url")) == F.col("url")),
        "url_of_another_authority": no(F.regexp_extract("url", "^https?://([^/:?#]+)", 1) == host),
        "claims_a_fetch": no(~F.col("this_run_network_fetch")),
        "claims_verified_tls": F.coalesce(F.col("tls_verified"), F.lit(False)),
        "tls_note_missing": no(present(F.col("tls_note"))),
        "year": no(F.col("source_year").rlike("^20[0-9]{2}$")),
        "publication_date": no(day(F.col("publication_date")).cast("string") == F.col("publication_date")),
        "publication_of_another_year": no(F.col("publication_date").startswith(F.col("source_year"))),
        "path_missing": F.col("path").isNull(),
        "paths_conflict": F.col("absolute_path").isNotNull() & no(F.col("absolute_path").endswith(F.col("path"))),
        "copy_outside_bundle": ~contained(F.col("preserved_copy"), F.col("source_bundle_path")),
        "copy_differs": no(F.col("copy_sha256") == F.col("want_sha256")),
        "school_year_not_named": no(F.contains(compact(F.col("article")), F.concat(F.col("source_year"), F.lit("学年")))),
        "form": ~page & ~text,
        "page_is_not_the_article": page & no(compact(F.col("page_text")) == compact(F.col("article"))),
        "page_title": page & no(F.col("page_title") == F.col("title")),
        "page_date": page & no(day(F.col("page_date")).cast("string") == F.col("publication_date")),
        "metadata_ambiguous": page & no(F.col("metadata_matches") == 1),
        "page_tls": page & no(~F.col("tls_verified") & ~F.col("metadata_tls")),
        "server_time_as_client_time": page & F.col("exact_observed_at").isNotNull(),
        "capture_run": page & no(F.col("snapshot_run_at") == F.col("metadata_run_at")),
        "response_date": page & no(F.col("response_date") == F.col("metadata_date")),
        "headers": page & no(F.col("headers_sha256") == F.col("want_headers_sha256")),
        "text_tls": text & F.col("tls_verified").isNotNull(),
        "text_title": text & no(F.col("json_title") == F.col("title")),
        "text_url": text & no(F.col("json_url") == F.col("url")),
        "text_differs": text & no(F.col("json_text") == F.col("visible")),
        "text_observation": text & no(F.col("json_observed_at") == F.col("exact_observed_at")),
        "text_without_date": text & no(F.contains("visible", "publication_date")),
    }
    failed = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return records.select("id", "bundle", failed.alias("failed"))


def whole_bundles(sources: DataFrame, *further: DataFrame) -> DataFrame:
    """(bundle, accepted): a bundle counts only if none of its sources breaks a requirement, of further tables too."""
    judged = policy_requirements(sources)
    for more in further:
        judged = judged.unionByName(more)
    return judged.groupBy("bundle").agg(F.every(F.size("failed") == 0).alias("accepted"))


def captured(rows: DataFrame, files: DataFrame, root: str = "data/incremental/") -> DataFrame:
    """rows plus captured: whether the named body file lies under the root, whatever .. it has, and has the stated digest."""
    f = files.select(F.col("path").alias("evidence_raw_path"), F.col("sha256").alias("evidence_sha256")).distinct().withColumn("__ok", F.lit(True))
    inside = contained(F.col("evidence_raw_path"), root) & F.col("evidence_raw_path").endswith(".body")
    return rows.join(f, ["evidence_raw_path", "evidence_sha256"], "left").withColumn("captured", F.coalesce(inside & F.col("__ok"), F.lit(False))).select(*rows.columns, "captured")


def reconciled(admissions: DataFrame, directory: DataFrame) -> DataFrame:
    """(school_id, n): schools whose stored admissions are as many as the directory's fresh count; any other is an error."""
    have = admissions.groupBy("school_id").agg(F.count(F.lit(1)).alias("have"))
    j = directory.select("school_id", "n").join(have, "school_id", "left")
    return j.select(must(F.coalesce("have", F.lit(0)) == F.col("n"), "admissions differ from the directory", F.col("school_id")).alias("school_id"), "n")
