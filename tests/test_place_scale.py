"""What is done without one large task: names in texts, medians, exports of what changed, paths and pages that are refused."""

import json
import random
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from terrafold.functions import values
from terrafold.operators import mentions, spatial, textindex
from terrafold.sources import paged, publish, readers
from terrafold.sources.versions import Versions


@pytest.mark.parametrize("block", [1 << 20, 13])
def test_spans_against_every_place(spark, monkeypatch, block):
    monkeypatch.setattr(mentions, "BLOCK", block)
    rng = random.Random(2)
    letters = "abcdeé中文\U0001f600 "
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(300)} | {"a" * 30, "ab"}
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))) for k in range(60)] + [(98, "a" * 70), (99, None), (100, ""), (100, "ab")]
    plain = [(i, unicodedata.normalize("NFKC", t or "")) for i, t in texts]
    want = sorted((i, w, p, p + len(w)) for i, t in plain for w in names for p in range(len(t)) if t.startswith(w, p))
    found = mentions.spans(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in [*names, *names, ""]], "name string"))
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 500
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # texts and names are read once each
    assert mentions.spans(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "name string")).count() == 0


def test_median_of_groups_of_any_size(spark):
    rng = random.Random(3)
    groups = {"hot": [rng.gauss(0, 100) for _ in range(60_000)], "even": [1.0, 2.0, 4.0, 9.0], "odd": [3.0, 1.0, 2.0], "same": [5.0] * 40_001, "two": [0.0] * 20_000 + [1.0] * 20_000, "one": [7.5], None: [2.0, 8.0], "ints": [float(rng.randrange(7)) for _ in range(9000)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), ("even", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    want = {g: (statistics.median(xs), len(xs)) for g, xs in groups.items()}
    for accuracy in (10_000, 100):
        assert {r.g: (r["median"], r.n) for r in values.exact_median(df, ["g"], "x", accuracy).collect()} == want
    assert values.exact_median(df.limit(0), ["g"], "x").count() == 0


def test_paths_are_judged_once_they_are_resolved(spark, tmp_path):
    cases = {"a/b/c": "a/b/c", "a/./b//c/": "a/b/c", "a/b/../c": "a/c", "../a": None, "a/../../b": None, "/a/b": None, "": "", "a/..": "", "..a/b": "..a/b"}
    df = spark.createDataFrame([(p,) for p in cases] + [(None,)], "p string")
    assert {r.p: r.n for r in df.select("p", values.normal_path(F.col("p")).alias("n")).collect()} == cases | {None: None}
    inside = {"data/in/a": True, "data/in/../in/a": True, "data/in/../a": False, "data/inside/a": False, "data/in": False, "x/../data/in/a": True, "../data/in/a": False}
    df = spark.createDataFrame([(p,) for p in inside], "p string")
    assert {r.p: r.ok for r in df.select("p", values.contained(F.col("p"), "data/in/").alias("ok")).collect()} == inside
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    root = str(tmp_path / "root")
    assert [r.length for r in readers.file_hashes(spark, f"{root}/a.txt", root).collect()] == [3]
    assert readers.file_hashes(spark, f"{root}/x/../a.txt", root).count() == 1
    for outside in (f"{root}/../b.txt", f"{tmp_path}/b.txt", "../b.txt", f"{root}more/a.txt"):
        with pytest.raises(ValueError, match="outside"):
            readers.file_hashes(spark, outside, root)


def test_only_changed_shards_are_written(spark, tmp_path):
    root = str(tmp_path / "export")
    rows = [(f"p{k}", f"name {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "id string, name string")
    first = publish.export_changed(df, root, shards=16, note="first")
    assert len(first["written"]) == 16 and first["note"] == "first" and publish.exported(spark, root).count() == 400
    assert publish.export_changed(df.repartition(5), root, shards=16)["written"] == []  # the order of rows does not matter
    changed = spark.createDataFrame([(i, "other" if i == "p7" else n) for i, n in rows if i != "p8"], "id string, name string")
    entry = publish.export_changed(changed, root, shards=16)
    assert 1 <= len(entry["written"]) <= 2
    same = [s for s in entry["shards"] if s not in entry["written"]]
    assert all(entry["shards"][s]["folder"] == first["shards"][s]["folder"] for s in same)
    got = {r.value for r in publish.exported(spark, root).collect()}
    assert len(got) == 399 and '{"id":"p7","name":"other"}' in got
    assert '{"id":"p7","name":"name 7"}' in {r.value for r in publish.exported(spark, root, "LISTING.previous").collect()}
    broken = changed.withColumn("name", F.when(F.col("id") == "p9", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        publish.export_changed(broken, root, shards=16)
    assert {r.value for r in publish.exported(spark, root).collect()} == got


def test_ambiguous_templates_are_refused():
    swap = {"<i>local</i>": "<i>public</i>"}
    assert publish.static_page("<html><head></head><i>local</i></html>", "<meta m>", "<meta csp>", swap) == "<html><head><meta m><meta csp></head><i>public</i></html>"
    for bad in ("<html><i>local</i></html>", "<head><head><i>local</i>", "<head></head>", "<head></head><i>local</i><i>local</i>", "<head><meta m></head><i>local</i>"):
        with pytest.raises(ValueError):
            publish.static_page(bad, "<meta m>", "", swap)


def test_a_city_with_a_third_of_all_places(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 50)
    rng = random.Random(6)
    spots = [(f"c{k}", 30.2501 + rng.random() * 0.015, 120.1501 + rng.random() * 0.018) for k in range(300)] + [(f"o{k}", 29.5 + rng.random(), 119.5 + rng.random()) for k in range(600)]
    spots += [spots[0]] * 3 + [("none", None, None)]
    left = spark.createDataFrame(spots, "id string, lat double, lng double")
    got = spatial.within(left, left, 700, (0.023, 0.019))
    rows = [(r.id, r.r_id, r.distance) for r in got.collect()]
    every = left.alias("a").crossJoin(left.select(*[F.col(c).alias(f"r_{c}") for c in left.columns])).withColumn("distance", spatial.distance_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))).where("distance <= 700")
    assert sorted(rows) == sorted((r.id, r.r_id, r.distance) for r in every.collect()) and len(rows) > 5000
    # No key of the join has more than about a block of either side.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__p" in plan and "__q" in plan


def test_search_by_index_reads_little_and_finds_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "LEAST_COMMON", 50)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    rows = [(k, f"Title {word()}", " ".join(word() for _ in range(12))) for k in range(2000)]
    rows += [(3000, "100% \\_ off", None), (3001, None, "The Unique-Needle's here"), (3002, "x", ""), (3003, "中文字符测试", "emoji \U0001f600\U0001f600 end")]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    index = textindex.PostIndex(Versions(spark, str(tmp_path / "log")))
    index.build(df.where("id < 1500"), buckets=2)
    index.add(df.where("id >= 1400"))
    index.add(df.where("id = 1"))
    for query in ("unique-needle", "NEEDLE'S", "title a", "100%", "\\_", "_", "%", "文字符", "\U0001f600\U0001f600", "abc", "abcd", "ab", "zzzz", "le", "", rows[17][2][5:20]):
        low = lambda x: "".join(c.lower() if c.isascii() else c for c in x or "")
        want = {i for i, a, b in rows if not query.strip() or low(query) in low(a) or low(query) in low(b)}
        found = index.find(query)
        assert {r.id for r in found.collect()} == want, query
    needle = index.find("unique-needle")
    read = spark.read.parquet(*[f for f in needle.inputFiles() if "/posts/" in f]).count()
    assert 0 < read < 0.05 * len(rows)
    # A gram that most posts have is no list.
    common = {r.gram for r in index.log.table("posts_common").collect()}
    title = {r.g for r in spark.range(1).select(F.explode(textindex.grams(F.lit("title"))).alias("g")).collect()}
    assert title <= common and index.log.table("posts_grams").where(F.col("gram").isin(*title)).isEmpty()


def test_publishing_gathers_while_it_writes(spark, tmp_path):
    root, df = str(tmp_path / "pub"), spark.range(100).withColumn("x", F.col("id") % 7)
    first = publish.publish({"t": df}, root, metrics={"t": {"top": F.max("x")}}, gates={"some": lambda m: m["t"]["rows"] == 100 and m["t"]["top"] == 6})
    found = publish.receipt(spark, root)
    assert found["t"]["rows"] == 100 and found["t"]["top"] == 6
    assert publish.recounted(spark, root) == {"t": {k: found["t"][k] for k in ("rows", "digest")}}
    assert {k: v for k, v in publish.recounted(spark, root)["t"].items()} == publish._shown(df.repartition(7).agg(*publish.digest_of(df.columns)).head().asDict())
    with pytest.raises(ValueError, match="gate failed: none"):
        publish.publish({"t": df.limit(5)}, root, gates={"none": lambda m: m["t"]["rows"] > 5})
    assert publish.current(spark, root) == first
    df.limit(99).write.mode("overwrite").parquet(f"{root}/revisions/{first}/t")
    assert publish.recounted(spark, root)["t"]["digest"] != found["t"]["digest"]


def test_pages_are_resumed_where_they_stopped(spark, tmp_path):
    paged.register(spark)
    root = tmp_path / "in"

    def fetched(query, page, items, total, again=""):
        folder = root / f"query={query}" / f"page={page}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"r{again}.json").write_text(json.dumps({"start": 2 * page, "total": total, "items": [{"id": i} for i in items]}))

    def run():
        stream = spark.readStream.format("paged_receipts").load(str(root))
        kept = lambda batch, k: batch.write.mode("overwrite").json(str(tmp_path / "out" / f"batch={k}"))
        stream.writeStream.foreachBatch(kept).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.query, r.page, r.ord, json.loads(r.item)["id"], r.batch) for r in spark.read.json(str(tmp_path / "out")).collect())

    fetched("a", 0, [1, 2], 5)
    fetched("a%20b", 0, [7], 1)
    fetched("a", 2, [5], 5)  # page 1 is missing: this one has to wait
    first = run()
    assert first == [("a", 0, 0, 1, 0), ("a", 0, 1, 2, 0), ("a b", 0, 0, 7, 0)]
    fetched("a", 1, [3, 4], 5)
    fetched("a", 0, [1, 2], 5, again="2")  # fetched twice
    fetched("c", 0, [], 0)
    assert run() == first[:2] + [("a", 1, 2, 3, 1), ("a", 1, 3, 4, 1), ("a", 2, 4, 5, 1)] + first[2:]
    batch = spark.read.format("paged_receipts").load(str(root))
    assert sorted((r.query, r.ord) for r in batch.collect()) == [("a", k) for k in range(5)] + [("a b", 0)]
    assert spark.read.format("paged_receipts").load(str(tmp_path / "none")).count() == 0
