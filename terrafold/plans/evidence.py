"""Registered queries of reviewed evidence: files, publishing, gates, bridges and orderings, each with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scope
from ..functions import geo, text, values
from ..operators import detail, importers, mentions, predicates, resolve, reviews, search, textindex, upsert
from ..sources import paged, publish, readers, versions
from ..streaming import bundles
from .queries import _RECORDS, ASIA, _records, query

#: A note's id from a number, in both languages.
_NOTE = "substr(md5(CAST({0} AS STRING)), 1, 24)"


def _note(c):
    return F.substring(F.md5(c.cast("string")), 1, 24)


def _every(c, n: int):
    return F.col(c).cast("long") % n == 0


# --- files ---


@query("SELECT n_regionkey AS region, octet_length(encode(body)) AS length, sha256(body) AS sha256 FROM (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS body FROM nation GROUP BY n_regionkey) x")
def q_file_hashes(t):
    folder = publish.workspace(t.spark, "files")
    t.nation.repartition(8, "n_regionkey").sortWithinPartitions("n_regionkey", "n_name").select(F.col("n_name").alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(folder)
    found = readers.file_hashes(t.spark, f"{folder}/*/part-*")
    return found.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("region"), "length", "sha256")


@query("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INT) AS ord FROM nation")
def q_json_documents(t):
    folder = publish.workspace(t.spark, "documents")
    lists = t.nation.groupBy("n_regionkey").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda x: x)).alias("rows"))
    wrapped = F.when(_every("n_regionkey", 2), F.col("rows")).otherwise(F.concat(F.lit('{"items":'), "rows", F.lit("}")))
    lists.select(wrapped.alias("value"), "n_regionkey").repartition(8, "n_regionkey").write.partitionBy("n_regionkey").text(folder)
    row = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    return readers.json_documents(t.spark, f"{folder}/*/part-*", row).select("n_nationkey", "n_name", "ord")


@query("SELECT CAST(c_custkey AS STRING) AS c_custkey, c_name, c_mktsegment FROM customer")
def q_csv_rows(t):
    folder = publish.workspace(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_mktsegment").write.option("header", "true").csv(folder)
    return readers.csv_rows(t.spark, folder, ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT id FROM places WHERE lat IS NOT NULL AND kind <> 'school_group'")
def q_catalogue(t):
    located = t.places.where("lat is not null and kind <> 'school_group'")
    return readers.catalogue(located.select("id", "lat", "lng", F.lit("WGS84").alias("crs")), least=1).select("id")


_BUNDLES = [(f"bundle-{k}.json", hashlib.sha256(f"bundle-{k}.json".encode()).hexdigest()) for k in range(5)]


@query("SELECT 'data/bundle-' || CAST(n_regionkey AS STRING) || '.json' AS path, 'nations' AS kind FROM nation GROUP BY n_regionkey")
def q_reviewed_bundles(t):
    name = F.concat(F.lit("bundle-"), F.col("n_regionkey").cast("string"), F.lit(".json"))
    path = F.concat(F.lit("data/"), name)
    counts = t.nation.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("records"))
    hashes = t.nation.select(path.alias("path"), values.digest(name).alias("sha256")).distinct()
    manifest = {"schema_version": 1, "reviewed": True, "bundles": [{"path": p, "kind": "nations", "sha256": h, "records": 5} for p, h in _BUNDLES]}
    return readers.reviewed_bundles(manifest, hashes, counts)


@query("SELECT CAST(s_nationkey AS STRING) AS query, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord, s_suppkey AS id FROM supplier")
def q_paged_receipts(t):
    s = t.supplier.groupBy(F.col("s_nationkey").cast("string").alias("query")).agg(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("id")))).alias("all"))
    starts = F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(3))).alias("start")
    pages = s.select("query", "all", F.size("all").alias("total"), starts).select("query", "start", "total", F.slice("all", F.col("start") + 1, F.lit(3)).alias("items"))
    again = pages.where("start = 0")
    return readers.paged_receipts(pages.unionByName(again), "id").select("query", F.col("ord").cast("long").alias("ord"), "id")


@query("SELECT CAST(s_nationkey AS STRING) AS query, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord, s_suppkey AS id, CASE WHEN (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3 < 1 + s_nationkey % 2 THEN 1 ELSE 2 END AS run FROM supplier")
def q_paged_stream(t):
    paged.register(t.spark)
    folder = publish.workspace(t.spark, "pages")
    s = t.supplier.groupBy(F.col("s_nationkey").alias("query")).agg(F.sort_array(F.collect_list(F.col("s_suppkey"))).alias("all"))
    pages = s.select("query", "all", F.size("all").alias("total"), F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(3))).alias("start"))
    body = F.to_json(F.struct("start", "total", F.transform(F.slice("all", F.col("start") + 1, F.lit(3)), lambda x: F.struct(x.alias("id"))).alias("items")))
    pages = pages.select("query", (F.col("start") / 3).cast("int").alias("page"), body.alias("value"))
    here = F.col("page") < 1 + F.col("query") % 2
    for part in (pages.where(here), pages.where(~here)):  # fetching stops after a page or two, and goes on later
        part.repartition("query", "page").write.mode("append").partitionBy("query", "page").text(f"{folder}/in")
        stream = t.spark.readStream.format("paged_receipts").load(f"{folder}/in")
        kept = lambda batch, k: batch.withColumn("run", F.lit(k + 1)).write.mode("overwrite").parquet(f"{folder}/out/batch={k}")
        stream.writeStream.foreachBatch(kept).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = t.spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")
    return found.select("query", "ord", F.get_json_object("item", "$.id").cast("long").alias("id"), "run")


# --- publishing ---


@query("SELECT district, count(*) AS n, count(DISTINCT id) AS ids FROM places GROUP BY district")
def q_published(t):
    root = publish.workspace(t.spark, "published")
    nation = t.nation.select("n_nationkey", "n_regionkey")
    checks = {"nations without a region": publish.orphans(nation, "n_regionkey", t.region, "r_regionkey")}
    publish.publish({"places": t.places, "nation": nation}, root, checks)
    return publish.table(t.spark, root, "places").groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("""
WITH s AS (SELECT lpad(CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(id, ''), lambda x: ascii(x)::HUGEINT)), lambda h, x: (xor(h, x) * 16777619::HUGEINT) % 4294967296::HUGEINT) % 128 AS VARCHAR), 3, '0') AS shard,
  octet_length(encode('{"id":"' || id || '","kind":"' || kind || '"}')) + 1 AS bytes FROM places)
SELECT shard, CAST(1 AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, true AS hashed FROM s GROUP BY shard""")
def q_export_manifest(t):
    folder = publish.workspace(t.spark, "export")
    publish.export_shards(t.places.select("id", "kind"), folder)
    listed = F.from_json(F.lit(publish.manifest(t.spark, folder)), "files array<struct<path string, bytes bigint, sha256 string>>")["files"]
    files = t.spark.range(1).select(F.inline(listed)).where(F.contains(F.col("path"), F.lit("shard=")))
    hashed = F.every(F.col("sha256").rlike(importers.SHA256))
    return files.groupBy(F.regexp_extract("path", "shard=([0-9]+)/", 1).alias("shard")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), hashed.alias("hashed"))


@query("SELECT o_orderkey AS id, o_custkey AS customer FROM orders")
def q_plain_insert(t):
    return upsert.unique_or_fail(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")), ["id"])


@query("""
WITH p AS (SELECT source_id, CASE WHEN line_no % 3 = 0 THEN 'detail' ELSE 'list' END AS seen, event_date FROM prices),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seen, event_date) AS rn FROM p)
SELECT source_id AS id, 'Price ' || source_id AS label, seen AS observed_at, CAST(event_date AS STRING) AS source_as_of, 'https://x.test/' || source_id AS url FROM r WHERE rn = 1""")
def q_source_rows(t):
    seen = F.when(_every("line_no", 3), F.lit("detail"))
    url = F.concat(F.lit("https://x.test/"), "source_id", F.lit("?x=1#top"))
    rows = t.prices.select(F.col("source_id").alias("id"), F.concat(F.lit("Price "), "source_id").alias("label"), F.lit("price").alias("kind"), seen.alias("detail_observed_at"), F.lit("list").alias("observed_at"), F.col("event_date").cast("string").alias("event_date"), url.alias("source_url"))
    return importers.source_rows(rows).select("id", "label", "observed_at", F.col("source_as_of").cast("string").alias("source_as_of"), "url")


@query("""
SELECT lpad(CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(id, ''), lambda x: ascii(x)::HUGEINT)), lambda h, x: (xor(h, x) * 16777619::HUGEINT) % 4294967296::HUGEINT) % 128 AS VARCHAR), 3, '0') AS shard,
       '{"id":"' || id || '","kind":"' || CASE WHEN id IN (SELECT min(id) FROM places) THEN 'changed' ELSE kind END || '"}' AS value, CAST(1 AS BIGINT) AS written, id IN (SELECT min(id) FROM places) AS changed FROM places""")
def q_incremental_export(t):
    root = publish.workspace(t.spark, "changed")
    rows = t.places.select("id", "kind")
    publish.export_changed(rows, root)
    least = F.col("id") == rows.agg(F.min("id")).head()[0]
    entry = publish.export_changed(rows.withColumn("kind", F.when(least, "changed").otherwise(F.col("kind"))), root)
    now, before = publish.exported(t.spark, root), publish.exported(t.spark, root, "LISTING.previous")
    old = before.select("value", F.lit(False).alias("changed"))
    return now.join(old, "value", "left").select("shard", "value", F.lit(len(entry["written"])).cast("long").alias("written"), F.col("changed").isNull().alias("changed"))


@query("""
SELECT r_name, n.n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) n ON n_regionkey = r_regionkey
UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'largest region key', max(n_regionkey) FROM nation UNION ALL SELECT 'unchanged tables', 2 UNION ALL SELECT 'revisions after a failed gate', 1""")
def q_publish_receipt(t):
    root = publish.workspace(t.spark, "receipt")
    tables = {"nation": t.nation, "region": t.region}
    counted = {"nation": {"largest": F.max("n_regionkey"), **{f"region {r.r_regionkey}": F.count_if(F.col("n_regionkey") == r.r_regionkey) for r in t.region.collect()}}}
    revision = publish.publish(tables, root, metrics=counted, gates={"all regions": lambda m: m["region"]["rows"] == m["nation"]["largest"] + 1})
    try:
        publish.publish(tables, root, metrics=counted, gates={"more nations than regions": lambda m: m["nation"]["rows"] <= m["region"]["rows"]})
    except ValueError:
        pass
    found = publish.receipt(t.spark, root)
    same = sum(now["digest"] == found[name]["digest"] and now["rows"] == found[name]["rows"] for name, now in publish.recounted(t.spark, root).items())
    facts = {"nations": found["nation"]["rows"], "largest region key": found["nation"]["largest"], "unchanged tables": same, "revisions after a failed gate": int(publish.current(t.spark, root) == revision)}
    rows = t.spark.createDataFrame(list(facts.items()), "r_name string, n long")
    of = t.spark.createDataFrame([(int(k[7:]), v) for k, v in found["nation"].items() if k.startswith("region ")], "k int, n long")
    return rows.unionByName(of.join(t.region, F.col("k") == F.col("r_regionkey")).select("r_name", "n"))


@query("""
WITH q AS (SELECT * FROM (VALUES ('anea'), ('THE '), ('e'), ('100%'), ('ea. Eri'), ('_')) v(term))
SELECT term, id, posted FROM posts JOIN q ON contains(lower(coalesce(title, '')), lower(term)) OR contains(lower(coalesce(description, '')), lower(term))""")
def q_indexed_search(t):
    index = textindex.PostIndex(versions.Versions(t.spark, publish.workspace(t.spark, "index")))
    posts = t.posts.select("id", "title", "description", "posted")
    late = F.col("id").cast("long") % 3 == 0
    index.build(posts.where(~late), parts=16, buckets=4)
    index.add(posts.where(late | (F.col("id").cast("long") % 3 == 1)))
    found = [index.find(term).select(F.lit(term).alias("term"), "id", "posted") for term in ("anea", "THE ", "e", "100%", "ea. Eri", "_")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# --- versioned tables ---


@query("""
SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 97 = 0 THEN 2 * o_totalprice ELSE o_totalprice END AS price, CAST(3 AS BIGINT) AS version
FROM orders""")
def q_transactions(t):
    log = versions.Versions(t.spark, publish.workspace(t.spark, "transactions"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    log.apply(lambda tx: tx.put("orders", rows, ["id"]))

    def doubled(tx):
        tx.compare_and_set("orders", tx.table("orders").where("id % 97 = 0").withColumn("new_price", F.col("price") * 2), ("id", "customer", "price"), ("price",))

    runs = []

    def marked(tx):
        if not runs:  # another writer comes first: this run meets a conflict and is run again on what that one left
            runs.append(log.apply(doubled))
        tx.compare_and_set("orders", tx.table("orders").where("id % 89 = 0").withColumn("new_status", F.lit("X")), ("id", "status", "price"), ("status",))

    log.apply(marked)

    def stale(tx):
        tx.repoint("orders", rows.where("id % 5 = 0").select("id", F.lit(0).cast("bigint").alias("target")), "customer")
        tx.compare_and_set("orders", rows.where("id % 97 = 0").withColumn("new_price", F.lit(0.0)), ("id", "price"), ("price",))

    try:
        log.apply(stale)  # the prices that it expects are gone: nothing of it is done
    except versions.Unapplied:
        return log.table("orders").withColumn("version", F.lit(log.latest()).cast("long"))
    raise AssertionError("a stale change was applied")


@query("""
SELECT id, name, CASE WHEN CAST(substr(id, 6) AS BIGINT) % 10 = 3 THEN 'moved' ELSE district END AS district FROM places WHERE kind = 'residential' AND CAST(substr(id, 6) AS BIGINT) % 4 <> 1
UNION ALL SELECT id, upper(name), CASE WHEN CAST(substr(id, 6) AS BIGINT) % 10 = 3 THEN 'moved' ELSE 'late' END FROM places WHERE kind = 'residential' AND CAST(substr(id, 6) AS BIGINT) % 4 = 1
UNION ALL SELECT id, name, 'last' FROM places WHERE kind = 'school'""")
def q_versioned_merge(t):
    log = versions.Versions(t.spark, publish.workspace(t.spark, "merge"))
    places = t.places.select("id", "name", "district", "kind", F.substring("id", 6, 20).try_cast("long").alias("n"))
    homes, row = places.where("kind = 'residential'"), ("id", "name", "district")
    log.apply(lambda tx: tx.put("places", homes.where("n % 4 <> 1").select(*row), ["id"]))

    def bundle(tx):
        late = homes.select("id", F.upper("name").alias("name"), F.lit("late").alias("district"))
        tx.insert_first("places", late.unionByName(homes.where("n % 4 = 1").select("id", "name", F.lit("later").alias("district"))), [F.col("district")])
        schools = places.where("kind = 'school'").select(*row)
        tx.insert_last("places", schools.unionByName(schools.withColumn("district", F.lit("last"))), [F.col("district") == "last"])

    log.apply(bundle)
    log.apply(lambda tx: tx.repoint("places", homes.where("n % 10 = 3").select("id", F.lit("moved").alias("target")), "district"))
    return log.table("places")


@query("""
WITH d AS (SELECT doc_id AS ord, CAST(doc_id % (SELECT CAST(count(*) * 9 / 10 AS BIGINT) FROM documents) AS STRING) AS id, sha256(text) AS body FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS again FROM d),
b AS (SELECT *, sum(CASE WHEN again = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY body ORDER BY ord ROWS UNBOUNDED PRECEDING) AS place FROM i)
SELECT ord, id, CASE WHEN again > 1 THEN 'duplicate_id' WHEN place > 1 THEN 'duplicate_body' END AS reason FROM b""")
def q_first_across_bundles(t):
    folder = publish.workspace(t.spark, "bundles")
    n = t.documents.count()
    # Nine tenths to the nearest whole, halves to even, as the SQL's cast has it. A null is one value over all bundles: it travels as an empty text, its order as the last.
    ord, id = F.coalesce("doc_id", F.lit(2**63 - 1)), F.coalesce((F.col("doc_id") % round(n * 9 / 10)).cast("string"), F.lit(""))
    rows = t.documents.select(ord.alias("ord"), id.alias("id"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("body_sha256"))
    log = versions.Versions(t.spark, f"{folder}/log")
    for k in range(3):  # three bundles, each met by a stream that starts again from its checkpoint
        part = rows.where((F.lit(k == 0) | (F.col("ord") >= k * n // 3)) & (F.lit(k == 2) | (F.col("ord") < (k + 1) * n // 3)))
        part.write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        bundles.first_accepted(stream, "ord", log, f"{folder}/checkpoint", parts=4, buckets=4)
    good, bad = log.table("rows"), log.table("rows_rejected")
    found = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return found.select(F.when(F.col("id") != "", F.col("ord")).alias("ord"), F.nullif("id", F.lit("")).alias("id"), "reason")


# --- joins on identities ---


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'known:' || CAST(c_custkey AS STRING) WHEN c_custkey % 3 = 1 THEN 'home:' || CAST(c_custkey AS STRING) ELSE 'local:residential:' || substr(sha256('|Nobody' || c_name), 1, 20) END AS entity_id FROM customer""")
def q_history_places(t):
    c = t.customer.withColumn("name", F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("Nobody "), "c_name")).otherwise(F.col("c_name")))
    candidates = t.customer.where("c_custkey % 3 = 0")
    old = candidates.select(F.col("c_name").alias("name"), F.lit("old").alias("entity_id"), F.lit(0).alias("ord"))
    new = candidates.select(F.concat(F.lit(" "), "c_name").alias("name"), F.concat(F.lit("known:"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit(1).alias("ord"))
    rows = c.select(F.col("c_custkey").alias("k"), F.lit("day").alias("source"), "name", F.lit(None).cast("string").alias("matched_name"))
    return resolve.history_places(rows, old.unionByName(new), t.entities).select("k", "entity_id")


@query("WITH " + _RECORDS + " SELECT campus_id, official_school_id AS official_id, year, entity_id, kind FROM (SELECT DISTINCT l.campus_id, l.official_school_id, l.year, rec.entity_id, l.kind FROM links l JOIN rec ON rec.entity_id = l.official_school_id AND rec.year = l.year WHERE l.campus_id IN (SELECT id FROM places)) x")
def q_crosswalk(t):
    records = _records(t)
    known = t.links.select("campus_id", F.col("official_school_id").alias("official_id"), "year", "kind").distinct()
    known = known.join(records.select("official_id", "year"), ["official_id", "year"], "left_semi")
    return resolve.crosswalk(known, records, t.places).select("campus_id", "official_id", "year", "entity_id", "kind")


_MERGES = """c AS (SELECT a.source_id AS evidence_id, a.entity_id AS target, CAST(CAST(a.source_id AS BIGINT) + 1 AS STRING) AS prior FROM projects a WHERE CAST(a.source_id AS BIGINT) % 10 = 0),
m AS (SELECT prior, b.entity_id AS from_entity_id, target, evidence_id FROM c JOIN projects b ON b.source_id = prior JOIN places y ON y.id = b.entity_id WHERE b.entity_id <> target)"""


def _merges(t):
    p = t.projects.select("source_id", "entity_id")
    at = p.join(t.places.select(F.col("id").alias("entity_id"), "district"), "entity_id").select(F.col("source_id").alias("prior"), "district")
    c = p.where(_every("source_id", 10)).withColumn("prior", (F.col("source_id").cast("long") + 1).cast("string")).join(at, "prior")
    claims = c.select(F.col("source_id").alias("evidence_id"), "entity_id", F.col("entity_id").alias("target_entity_id"), "district", F.array("prior").alias("merge_ids"))
    return resolve.project_merges(claims, p.select(F.col("source_id").alias("id"), "source_id", "entity_id"), t.places, "home:")


@query("WITH " + _MERGES + " SELECT prior AS id, from_entity_id, target, evidence_id FROM m")
def q_project_merges(t):
    return _merges(t).select("id", "from_entity_id", "target", "evidence_id")


@query("WITH " + _MERGES + " SELECT p.source_id, coalesce(m.target, p.entity_id) AS entity_id, p.amount FROM projects p LEFT JOIN m ON m.prior = p.source_id WHERE p.amount IS NOT NULL")
def q_merged_prices(t):
    moves = _merges(t).select(F.col("source_id").alias("id"), "target")
    return upsert.repoint(t.projects.where("amount is not null").select("source_id", "entity_id", "amount"), moves, "source_id", "entity_id")


@query("SELECT p.id, p.first_school AS entity_id FROM policies p JOIN places s ON s.id = p.first_school")
def q_attached_entities(t):
    named = t.places.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), "kind", "district")
    documents = t.policies.select("id", F.col("first_school").alias("entity_id")).join(named, "entity_id")
    return reviews.attached_entities(documents, t.places)


@query("""
SELECT 'o' || CAST(s_suppkey AS STRING) AS id, 'school:' || CAST(s_suppkey AS STRING) AS entity_id, '2024' AS year, 'published: 2024-05-01' || chr(10) || 'observed: 2024-05-02' || chr(10) || 'quote: ' || s_name AS body
FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 6 <> 0 AND s_suppkey % 9 <> 0 AND s_suppkey % 11 <> 0""")
def q_observations(t):
    k = lambda n, a, b: F.when(_every("s_suppkey", n), a).otherwise(b)
    school = F.concat(F.lit("school:"), F.col("s_suppkey").cast("string"))
    home = t.places.where("kind = 'school'").select(F.col("id").alias("__id"), "district")
    rows = t.supplier.join(home, school == F.col("__id")).select(
        F.concat(F.lit("o"), F.col("s_suppkey").cast("string")).alias("id"), k(4, F.lit("rumour"), F.lit("construction_progress")).alias("evidence_type"), F.lit(False).alias("creates_official_admission_relation"),
        F.lit("").alias("residential_names"), F.lit(None).cast("string").alias("admission_year"), k(6, F.lit("2024-13-01"), F.lit("2024-05-01")).alias("published_at"), F.lit("2024-05-02").alias("observed_at"),
        k(11, F.lit("javascript:x"), F.lit("https://x.test/a")).alias("source_url"), school.alias("official_id"), F.lit("1998").alias("year"), "district", k(9, F.lit("Other"), F.concat(F.lit(" "), "s_name")).alias("canonical_school_name"),
        F.col("s_name").alias("source_quote"), F.lit(" ").alias("notes"), F.lit(None).cast("string").alias("response_sha256"),
    )
    records = t.supplier.select(school.alias("official_id"), F.lit("1998").alias("year"), school.alias("entity_id"))
    return reviews.observations(rows, records, t.places)


# --- gates ---


@query("""
WITH c AS (SELECT s_suppkey AS k, lower(r_name) AS region, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT k, CASE WHEN region LIKE '% %' OR region = 'africa' THEN 'invalid_group' WHEN k % 11 = 0 THEN 'school_missing' WHEN k % 7 = 0 OR k % 3 = 0 THEN 'evidence_changed' WHEN k % 5 = 0 THEN 'cross_district_membership' WHEN k % 13 = 0 THEN 'duplicate_membership' END AS reason FROM c)
SELECT coalesce(reason, 'accepted') AS reason, CAST(sum(CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM r GROUP BY 1""")
def q_group_evidence(t):
    k = F.col("s_suppkey").cast("string")
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("official_id", F.concat(F.lit("school:"), k))
    wanted = F.when(_every("s_suppkey", 7), F.lit("absent")).otherwise(F.concat(F.lit("Ｎamed "), "s_name"))
    claims = s.select(F.concat(F.lit("group:"), F.lower("r_name"), F.lit(":"), k).alias("group_id"), F.col("r_name").alias("district"), "official_id", F.lit(True).alias("current"), F.col("official_id").alias("evidence_official_id"), wanted.alias("evidence_contains"), "s_suppkey")
    claims = claims.unionByName(claims.where(_every("s_suppkey", 13)))
    district = F.when(_every("s_suppkey", 5), F.lit("ELSEWHERE")).otherwise(F.col("r_name"))
    record = lambda year, said: s.select("official_id", F.lit(year).alias("year"), F.col("official_id").alias("entity_id"), district.alias("district"), said.alias("detail"), "s_suppkey")
    records = record("1998", F.concat(F.lit("once Na med\u3000"), "s_name")).unionByName(record("1999", F.lit("moved")).where(_every("s_suppkey", 3))).where(~_every("s_suppkey", 11)).drop("s_suppkey")
    got = reviews.group_evidence(claims, records, ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    return got.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: What row k of the archive breaks (its number modulo 40), and what a page and a text then fail.
_BROKEN = {
    1: ({"creates_official_admission_relation": "CAST(NULL AS BOOLEAN)"}, "creates_admissions", "creates_admissions"),
    2: ({"id": "'P ' || k", "source_id": "'P ' || k"}, "identity", "identity"),
    3: ({"source_id": "'z'"}, "source_identity", "source_identity"),
    4: ({"source_bundle_path": "'data/other/'", "preserved_copy": "'data/other/c'"}, "bundle_outside_tree", "bundle_outside_tree"),
    5: ({"sealed_matches": "2"}, "not_as_sealed", "not_as_sealed"),
    6: ({"district": "'none'"}, "unknown_district,url_of_another_authority", "unknown_district,url_of_another_authority"),
    7: ({"url": "'https://a1.gov.cn/n/1#z'", "json_url": "'https://a1.gov.cn/n/1#z'", "district": "'D1'"}, "url_not_canonical", "url_not_canonical"),
    8: ({"url": "'https://b.gov.cn/n/1'", "json_url": "'https://b.gov.cn/n/1'"}, "url_of_another_authority", "url_of_another_authority"),
    9: ({"this_run_network_fetch": "true"}, "claims_a_fetch", "claims_a_fetch"),
    10: ({"tls_verified": "true"}, "claims_verified_tls,page_tls", "claims_verified_tls,text_tls"),
    11: ({"tls_note": "' '"}, "tls_note_missing", "tls_note_missing"),
    12: ({"source_year": "'26'"}, "year,publication_of_another_year", "year,publication_of_another_year"),
    13: ({"publication_date": "'2026-3-1'"}, "publication_date,page_date", "publication_date,text_without_date"),
    14: ({"path": "CAST(NULL AS STRING)"}, "path_missing,form", "path_missing,form"),
    15: ({"absolute_path": "'/else/x'"}, "paths_conflict", "paths_conflict"),
    16: ({"preserved_copy": "'data/incremental/b/../../../c'"}, "copy_outside_bundle", "copy_outside_bundle"),
    17: ({"copy_sha256": "'z'"}, "copy_differs", "copy_differs"),
    18: ({"article": "'x'", "page_text": "'x'"}, "school_year_not_named", "school_year_not_named"),
    19: ({"path": "'data/incremental/b/o.pdf'"}, "form", "form"),
    20: ({"page_text": "'z'"}, "page_is_not_the_article", ""),
    21: ({"page_title": "'z'"}, "page_title", ""),
    22: ({"page_date": "CAST(NULL AS STRING)"}, "page_date", ""),
    23: ({"metadata_matches": "0"}, "metadata_ambiguous", ""),
    24: ({"metadata_tls": "true"}, "page_tls", ""),
    25: ({"exact_observed_at": "'o'"}, "server_time_as_client_time", ""),
    26: ({"metadata_run_at": "'z'"}, "capture_run", ""),
    27: ({"metadata_date": "'z'"}, "response_date", ""),
    28: ({"want_headers_sha256": "CAST(NULL AS STRING)"}, "headers", ""),
    29: ({"json_title": "'z'"}, "", "text_title"),
    30: ({"json_url": "'z'"}, "", "text_url"),
    31: ({"json_text": "'z'"}, "", "text_differs"),
    32: ({"json_observed_at": "CAST(NULL AS STRING)"}, "", "text_observation"),
    33: ({"tls_verified": "false"}, "", "text_tls"),
    34: ({}, "repeated_identity", "repeated_identity"),
    35: ({"source_bundle_path": "'data/incremental/x/../b/'"}, "", ""),
}
_SOUND = {
    "id": "'p:' || k", "bundle": "'b'", "source_id": "'p:' || k", "creates_official_admission_relation": "false", "source_bundle_path": "'data/incremental/b/'", "sealed_matches": "1", "district": "'D' || (k % 3)", "url": "'https://a' || (k % 3) || '.gov.cn/n/' || k",
    "this_run_network_fetch": "false", "tls_verified": "CASE WHEN page THEN false END", "tls_note": "'noted'", "source_year": "'2026'", "publication_date": "'2026-03-01'", "title": "'T' || k", "path": "CASE WHEN page THEN 'data/incremental/b/o.body' ELSE 'data/incremental/b/o.json' END",
    "absolute_path": "CAST(NULL AS STRING)", "preserved_copy": "'data/incremental/b/./c'", "copy_sha256": "'h'", "want_sha256": "'h'", "article": "'2026 学年 ' || k", "visible": "'2026 学年 ' || k || ' of 2026-03-01'", "exact_observed_at": "CASE WHEN NOT page THEN 'o' END",
    "page_text": "'2026学年' || k", "page_title": "'T' || k", "page_date": "'20260301'", "metadata_matches": "1", "metadata_tls": "false", "snapshot_run_at": "'r'", "metadata_run_at": "'r'", "response_date": "'d'", "metadata_date": "'d'", "headers_sha256": "'x'", "want_headers_sha256": "'x'",
    "json_title": "'T' || k", "json_url": "'https://a' || (k % 3) || '.gov.cn/n/' || k", "json_text": "'2026 学年 ' || k || ' of 2026-03-01'", "json_observed_at": "'o'",
}


@query(f"""
WITH c AS (SELECT c_custkey AS k, c_custkey % 40 AS r, (c_custkey // 40) % 2 = 0 AS page FROM customer UNION ALL SELECT c_custkey, c_custkey % 40, (c_custkey // 40) % 2 = 0 FROM customer WHERE c_custkey % 40 = 34)
SELECT CASE WHEN r = 2 THEN 'P ' ELSE 'p:' END || k AS id, CASE r {' '.join(f"WHEN {r} THEN CASE WHEN page THEN '{p}' ELSE '{x}' END" for r, (_, p, x) in _BROKEN.items())} ELSE '' END AS failed FROM c""")
def q_archive_requirements(t):
    k = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 40).alias("r"), (F.floor(F.col("c_custkey") / 40) % 2 == 0).alias("page"))
    rows = k.unionByName(k.where("r = 34"))
    changed = lambda name, sound: f"CASE r {' '.join(f'WHEN {r} THEN {change[name]}' for r, (change, _, _) in _BROKEN.items() if name in change)} ELSE {sound} END" if any(name in c for c, _, _ in _BROKEN.values()) else sound
    records = rows.select(*[F.expr(changed(name, sound)).alias(name) for name, sound in _SOUND.items()])
    hosts = {f"D{n}": f"a{n}.gov.cn" for n in range(3)}
    return reviews.archive_requirements(records, hosts).select("id", F.array_join("failed", ",").alias("failed"))


@query("""
WITH r AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'semantic_review_acceptance_required' WHEN doc_id % 13 = 0 THEN 'semantic_review_claim_body_hash_mismatch' WHEN doc_id % 17 = 0 THEN 'semantic_review_file_hash_required' WHEN doc_id % 19 = 0 THEN 'semantic_review_source_missing_or_outside'
  WHEN lang = 'es' THEN 'semantic_review_file_changed_or_hash_mismatch' WHEN lang = 'fr' THEN 'semantic_review_file_unreviewed' WHEN doc_id % 23 = 0 THEN 'semantic_review_note_not_found' WHEN doc_id % 29 = 0 THEN 'semantic_review_source_does_not_accept' WHEN doc_id % 31 = 0 THEN 'semantic_review_source_body_hash_mismatch' END AS reason FROM documents)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1""")
def q_semantic_review(t):
    k = lambda n, a, b: F.when(_every("doc_id", n), F.lit(a) if isinstance(a, str) else a).otherwise(b)
    body, path = values.digest(F.coalesce("text", F.lit(""))), F.coalesce("lang", F.lit("und"))
    claim = F.struct(k(11, "exclude", F.lit("accept")).alias("decision"), k(13, F.sha2(F.lit("x"), 256), body).alias("body_sha256"), k(17, "?", values.digest(path)).alias("review_sha256"), k(19, "elsewhere", path).alias("review_source"))
    rows = t.documents.select(_note(F.col("doc_id")).alias("id"), body.alias("body_sha256"), claim.alias("claim"))
    files = t.documents.select(path.alias("path")).distinct()
    files = files.select("path", values.digest(F.when(F.col("path") == "es", F.lit("?")).otherwise(F.col("path"))).alias("sha256"), *[F.lit(True).alias(c) for c in ("registered", "readable", "is_document", "reviewed")], F.when(F.col("path") == "fr", "draft").otherwise("final").alias("status"))
    said = t.documents.where(~_every("doc_id", 23)).select(path.alias("path"), _note(F.col("doc_id")).alias("id"), k(29, "exclude", F.lit("accept")).alias("decision"), k(31, F.sha2(F.lit("y"), 256), body).alias("body_sha256"), F.lit(True).alias("body_read_complete"), F.lit(True).alias("counted"))
    got = reviews.semantic_review_reason(rows, files, said)
    return got.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT doc_id, """ + _NOTE.format("doc_id") + """ AS id FROM documents)
SELECT 'repeated' AS gate, count(*) AS n FROM d WHERE doc_id % 9 = 0 UNION ALL SELECT 'odd_ids', count(*) FROM d WHERE doc_id % 10 = 0 UNION ALL SELECT 'odd_hashes', count(*) FROM d WHERE doc_id % 8 = 0
UNION ALL SELECT 'bodies_outside', count(*) FROM d WHERE doc_id % 7 = 0 UNION ALL SELECT 'not_loaded', count(*) FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT 'counts', CAST(1 AS BIGINT)""")
def q_frozen_baseline(t):
    d = t.documents.select("doc_id", F.when(_every("doc_id", 10), F.concat(F.lit("odd "), F.col("doc_id").cast("string"))).otherwise(_note(F.col("doc_id"))).alias("id"))
    bodies = d.select(F.when(_every("doc_id", 7), F.concat(F.lit("outside "), F.col("doc_id").cast("string"))).otherwise(F.col("id")).alias("id"))
    bodies_n, ids_n = bodies.count(), d.count()
    hashes = d.select(F.when(_every("doc_id", 8), F.concat(F.lit("odd "), F.col("doc_id").cast("string"))).otherwise(F.sha2("id", 256)).alias("h"))
    repeats = d.where(_every("doc_id", 9)).select(F.sha2(F.concat(F.lit("twice"), "id"), 256).alias("h"))
    checks = reviews.frozen_baseline(d.select("id"), bodies, hashes.unionByName(repeats).unionByName(repeats), d.where(~_every("doc_id", 5)).select("id"), {"valid_count": ids_n, "body_count": bodies_n + 1})
    return detail.section_counts({k: v.select(F.col("x").alias("id")) for k, v in checks.items()}).groupBy(F.col("section").alias("gate")).agg(F.sum("n").alias("n"))


@query("SELECT page_id, page_id % 4 <> 0 AND page_id % 6 <> 0 AND page_id % 5 <> 0 AS captured FROM pages")
def q_captured(t):
    name = F.col("page_id").cast("string")
    path = F.concat(F.lit("data/incremental/"), F.when(_every("page_id", 6), F.lit("../")).otherwise(F.lit("")), name, F.when(_every("page_id", 4), F.lit(".html")).otherwise(F.lit(".body")))
    rows = t.pages.select("page_id", path.alias("evidence_raw_path"), F.sha2(name, 256).alias("evidence_sha256"))
    files = t.pages.select(path.alias("path"), F.when(_every("page_id", 5), F.sha2(F.lit("changed"), 256)).otherwise(F.sha2(name, 256)).alias("sha256"))
    return reviews.captured(rows, files).select("page_id", "captured")


@query("SELECT 'school:' || CAST(l_suppkey AS STRING) AS school_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey")
def q_reconciled(t):
    directory = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy(F.concat(F.lit("school:"), F.col("l_suppkey").cast("string")).alias("school_id")).agg(F.count(F.lit(1)).alias("n"))
    return reviews.reconciled(t.admissions, directory)


@query("""
WITH p AS (SELECT page_id, concat_ws(',', CASE WHEN page_id % 7 = 0 THEN 'hash' END, CASE WHEN page_id % 11 = 0 THEN 'article_too_short' END, CASE WHEN page_id % 5 = 0 THEN 'article_not_in_page' END, CASE WHEN page_id % 4 = 0 THEN 'observation_time' END,
  CASE WHEN page_id % 13 = 0 THEN 'publication_date' END, CASE WHEN page_id % 17 = 0 THEN 'tls_claim' END) AS failed FROM pages)
SELECT page_id, failed FROM p""")
def q_policy_requirements(t):
    k = lambda n, a, b: F.when(_every("page_id", n), a).otherwise(b)
    name = F.col("page_id").cast("string")
    article = k(11, F.lit("short"), F.rpad(F.concat(F.lit("policy "), name, F.lit(" ")), 120, "text "))
    visible = k(5, F.lit("another page"), F.concat(F.lit("menu  "), article, F.lit("\n footer")))
    rows = t.pages.select("page_id", F.col("page_id").alias("id"), F.lit("b").alias("bundle"), F.sha2(name, 256).alias("sha256"), k(7, F.lit("?"), F.sha2(name, 256)).alias("want_sha256"), F.lit(1).alias("bytes"), F.lit(1).alias("want_bytes"), article.alias("article"), visible.alias("visible"),
                          k(4, F.lit("2024-01-01T00:00:00"), F.lit("2024-01-01T00:00:00+08:00")).alias("observed_at"), name.alias("title"), name.alias("original_title"), k(13, F.lit("2024-01-02"), F.lit("2024-01-01")).alias("publication_date"),
                          F.lit("2024-01-01").alias("original_publication_date"), _every("page_id", 17).alias("tls_verified"))
    rows = rows.withColumn("text_sha256", F.sha2("article", 256))
    return reviews.policy_requirements(rows).select(F.col("id").alias("page_id"), F.concat_ws(",", "failed").alias("failed"))


@query("SELECT entity_id, id FROM prices WHERE false")
def q_empty_range(t):
    return t.prices.where(predicates.price_matches(ASIA.but(min_budget=5.0, max_budget=1.0))).select("entity_id", "id")


# --- evidence, orders, values ---


@query("""
WITH p AS (SELECT a.post_id, least(a.entity_id, b.entity_id) AS a, greatest(a.entity_id, b.entity_id) AS b FROM post_places a JOIN post_places b ON a.post_id = b.post_id AND a.entity_id LIKE 'school:%' AND b.entity_id LIKE 'home:%')
SELECT a, b, array_to_string(list_sort(list(DISTINCT post_id)), ',') AS posts FROM p GROUP BY a, b""")
def q_merged_evidence(t):
    school = F.col("entity_id").startswith("school:")
    a, b = t.post_places.where(school).withColumnRenamed("entity_id", "s"), t.post_places.where(F.col("entity_id").startswith("home:")).withColumnRenamed("entity_id", "h")
    pairs = a.join(b, "post_id").select(F.least("s", "h").alias("a"), F.greatest("s", "h").alias("b"), "post_id")
    old = pairs.where(~_every("post_id", 3))
    got = mentions.merged_evidence(old, pairs.where(~_every("post_id", 2) | _every("post_id", 6)).unionByName(old.where(_every("post_id", 5))))
    return got.select("a", "b", F.concat_ws(",", "post_ids").alias("posts"))


@query("SELECT id AS price_id, entity_id AS id, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(event_date, observed_at) DESC, id) AS ord FROM prices WHERE kind = 'deal' AND NOT possible_duplicate")
def q_ordered_prices(t):
    rows = t.prices.where("kind = 'deal' and not possible_duplicate").select(F.col("entity_id").alias("id"), F.col("id").alias("price_id"), "event_date", "observed_at")
    return detail.ordered("prices", rows).select("price_id", "id", F.col("ord").cast("long").alias("ord"))


@query("SELECT entity_id AS id, event_id, row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_date, event_id) AS ord FROM history")
def q_ordered_history(t):
    rows = t.history.withColumnRenamed("entity_id", "id")
    return detail.ordered("history", rows).select("id", "event_id", F.col("ord").cast("long").alias("ord"))


@query("SELECT entity_id AS id, source_id, row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC, source_id) AS ord FROM projects")
def q_ordered_projects(t):
    rows = t.projects.withColumnRenamed("entity_id", "id")
    return detail.ordered("projects", rows).select("id", "source_id", F.col("ord").cast("long").alias("ord"))


@query("SELECT DISTINCT school_id AS id, id AS admission_id, dense_rank() OVER (PARTITION BY school_id ORDER BY year DESC, admission_type, id) AS ord FROM (SELECT DISTINCT id, school_id, year, admission_type FROM admissions) x")
def q_ordered_admissions(t):
    rows = t.admissions.select(F.col("school_id").alias("id"), F.col("id").alias("admission_id"), "year", "admission_type").distinct()
    return detail.ordered("admissions", rows).select("id", "admission_id", F.col("ord").cast("long").alias("ord"))


@query("SELECT id, ord FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN has_candidate THEN 0 ELSE 1 END, coalesce(pool_rank, 9999), post_count DESC, name, id) AS ord FROM places WHERE kind = 'residential' AND district = 'ASIA') x WHERE ord <= 80")
def q_result_paging(t):
    return search.shown(search.query_entities(t.entities, t.admissions, t.links, t.prices, ASIA), pages=2).select("id", F.col("ord").cast("long").alias("ord"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '滨江区' WHEN 1 THEN '钱塘区' WHEN 2 THEN 'X' ELSE '西湖区' END AS district FROM documents")
def q_district_names(t):
    short = F.element_at(F.array(*map(F.lit, ("滨江", "钱塘", "X", "西湖区"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", values.district_name(short).alias("district"))


@query("SELECT c_custkey, c_custkey % 4 = 0 AND c_custkey % 3 <> 1 AS known FROM customer")
def q_portal_point(t):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs) + 1).cast("int"))
    point = geo.portal_point(pick("120.1", "", "abc", " "), pick("30.2", "none", "30"))
    return t.customer.select("c_custkey", point.isNotNull().alias("known"))


@query("SELECT DISTINCT order_no, line_no, (order_no % 5 = 0) OR (order_no % 7 = 3) AS hidden, (order_no % 2 = 0) OR (line_no = 2) AS flagged FROM prices")
def q_possible_duplicate(t):
    group = F.when(_every("order_no", 5), F.lit("g")).otherwise(F.lit(" "))
    matches = F.when(F.col("order_no") % 7 == 3, F.lit(2)).when(F.col("order_no") % 7 == 4, F.lit(0))
    hidden = values.possible_duplicate(group, matches)
    flagged = values.flagged_duplicate(F.when(_every("order_no", 2), F.lit(True)), F.col("line_no") == 2)
    return t.prices.select("order_no", "line_no", hidden.alias("hidden"), flagged.alias("flagged")).distinct()


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.5 WHEN 4 THEN nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) END AS amount FROM events")
def q_json_positive(t):
    fixed = F.array(*map(F.lit, ('{"k": 1.5}', '{"k": "1.5"}', '{"k": true}', '{"k": -2}')), F.col("props"))
    doc = F.element_at(fixed, (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", values.json_positive(F.try_variant_get(F.parse_json(doc), "$.k", "variant")).alias("amount"))


@query("SELECT s_suppkey, 'A1' || replace(s_name, ' ', '') AS evidence FROM supplier")
def q_evidence_text(t):
    said = F.concat(F.lit("Ａ１ "), "s_name", F.lit("\u3000"))
    return t.supplier.select("s_suppkey", reviews.evidence_text(said).alias("evidence"))


# Texts that tell rent from sale, and districts: dealt to documents by their number.
_TITLES = ("西湖区 租房", "买了一套学区房", "滨江区 房子", "日常", "钱塘区和西湖区")
_BODIES = ("整租 押一付三", "出租回报率很高", "诚售 租金2000元/月", "周末散步", "转租 #急售#", "投资出租 需求", "上城区 月租")
_HINTS = (("西湖",), (), ("滨江区", "外地"), ("临平",))


def _dealt(number: str, texts: tuple[str, ...]) -> str:
    """The text of a row by its number, in SQL that both engines read."""
    whens = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(texts))
    return f"CASE doc_id % {number} {whens} END"


_TEXTS = f"SELECT doc_id, {_dealt('5', _TITLES)} AS title, {_dealt('7', _BODIES)} AS body, CASE doc_id % 4 {' '.join(f'WHEN {k} THEN {list(h)}' for k, h in enumerate(_HINTS) if h)} ELSE [] END AS hints FROM documents"
_BARE = r"regexp_replace(body, '(^|\s)#[^\s#]+', ' ', 'g')"


def _texts(t):
    hints = F.expr("CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN array({', '.join(repr(x) for x in h)})" for k, h in enumerate(_HINTS) if h) + " ELSE cast(array() AS array<string>) END")
    return t.documents.select("doc_id", F.expr(_dealt("5", _TITLES)).alias("title"), F.expr(_dealt("7", _BODIES)).alias("body"), hints.alias("hints"))


@query(f"""
WITH d AS ({_TEXTS})
SELECT doc_id, regexp_matches(regexp_replace(title || ' ' || body, '{scope.INVESTMENT}', '', 'g'), '{scope.RENTAL}') AND NOT regexp_matches(title || ' ' || {_BARE}, '{scope.SALE}') AND NOT regexp_matches(title, '{scope.PURCHASE}') AS rental FROM d""")
def q_rental_only(t):
    return _texts(t).select("doc_id", text.rental_only(F.col("title"), F.col("body")).alias("rental"))


@query(f"""
WITH d AS ({_TEXTS}),
f AS (SELECT doc_id, list_filter({list(scope.CORE_DISTRICTS)}, lambda x: contains(title || chr(10) || {_BARE}, x)) AS named, list_transform(hints, lambda h: CASE WHEN h LIKE '%区' THEN h ELSE h || '区' END) AS hinted FROM d)
SELECT doc_id, CASE WHEN len(named) > 1 THEN '' WHEN len(named) = 1 THEN CASE WHEN len(list_filter(hinted, lambda h: h <> named[1])) = 0 THEN named[1] ELSE '' END
  WHEN len(list_filter({list(scope.CORE_DISTRICTS)}, lambda x: list_contains(hinted, x))) = 1 THEN list_filter({list(scope.CORE_DISTRICTS)}, lambda x: list_contains(hinted, x))[1] ELSE '' END AS district FROM f""")
def q_post_district(t):
    return _texts(t).select("doc_id", text.post_district(F.col("title"), F.col("body"), F.col("hints")).alias("district"))
