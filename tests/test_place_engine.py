"""Small graphs with known answers: queries, rankings, relations, profiles, resolution, imports, texts."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from terrafold.functions import article, geo, text, values
from terrafold.operators import importers, market, mentions, predicates, profile, relations, resolve, search, spatial, upsert
from terrafold.operators.state import QueryState
from terrafold.sources import publish, readers
from terrafold.streaming import bundles

D = datetime.date
ENTITY = "id string, name string, kind string, district string, lat double, lng double, primary_school boolean, address string, aliases array<string>, project_names array<string>, candidate struct<rank:int,built_year:int,plate:string,name:string>, post_count long, group_member_count long"
PRICE = "entity_id string, kind string, source_id string, event_date date, observed_at date, price_as_of date, source_as_of date, total_wan double, area_sqm double, unit_yuan_sqm double, possible_duplicate boolean"
STATE = QueryState(year="2026", today="2026-09-08")


def entity(id, name, kind, district, lat, lng, primary=None, candidate=None, members=None):
    return (id, name, kind, district, lat, lng, primary, None, [], [], candidate, 0, members)


@pytest.fixture(scope="module")
def graph(spark):
    e = [
        entity("s", "闻涛小学", "school", "滨江区", 30.2, 120.2, True),
        entity("c", "闻涛旧名校区", "school", "滨江区", 30.2, 120.19, False),
        entity("h", "闻涛花园", "residential", "滨江区", 30.201, 120.201, None, (1, 2008, None, None)),
        entity("u", "待定小区", "residential", "滨江区", None, None),
        entity("g", "拱墅小学", "school", "拱墅区", 30.3, 120.1, True),
        entity("x", "教育集团", "school_group", "滨江区", None, None, members=3),
    ]
    a = [("1", "s", "h", "2026", "户籍生", True), ("2", "s", "u", "2026", "新杭州人", True), ("3", "s", "u", "2024", "户籍生", True)]
    p = [("h", "listing", "base", None, D(2026, 8, 18), None, None, 300.0, 89.0, None, False), ("h", "deal", "base", D(2026, 6, 23), D(2026, 6, 30), None, None, 200.0, 70.0, None, False)]
    return {
        "entities": spark.createDataFrame(e, ENTITY),
        "admissions": spark.createDataFrame(a, "id string, school_id string, home_id string, year string, admission_type string, active boolean"),
        "links": spark.createDataFrame([("c", "s", "2026", "other", 5.0)], "campus_id string, official_school_id string, year string, kind string, distance_m double"),
        "prices": spark.createDataFrame(p, PRICE),
    }


def ids(graph, s):
    return [r.id for r in search.query_entities(graph["entities"], graph["admissions"], graph["links"], graph["prices"], s).orderBy("ord").collect()]


HOMES = STATE.but(kind="residential", primary_only=False)


@pytest.mark.parametrize(("state", "want"), [
    (STATE.but(district="滨江区"), ["s"]),
    (STATE.but(kind="all", query="闻 涛", primary_only=True), ["s", "h"]),
    (STATE.but(official_only=True, year="2029"), []),
    (HOMES.but(school_id="s", admission="户籍生"), ["h"]),
    (HOMES.but(school_id="s", year="2024"), ["u"]),
    (HOMES.but(school_id="c", admission="户籍生"), ["h"]),
    (HOMES.but(located="no"), ["u"]),
    (STATE.but(kind="all", rectangle=(120.199, 30.199, 120.202, 30.202)), ["s", "h"]),
    (HOMES.but(price_kind="listing", max_budget=250.0, min_area=80.0), []),
    (HOMES.but(price_kind="listing", max_budget=310.0, min_area=80.0), ["h"]),
    (HOMES.but(price_kind="listing", max_budget=250.0), []),
    (HOMES.but(price_kind="listing", max_budget=250.0, include_unknown=True), ["u"]),
    (HOMES.but(deal_from="2026-07-01"), []),
    (HOMES.but(deal_to="2026-06-30"), ["h"]),
    (STATE.but(price_kind="listing", max_budget=310.0, min_area=80.0), ["s"]),
    (STATE.but(kind="school_group", located="yes"), ["x"]),
    (STATE.but(kind="all", district="main", query="杭州市拱墅"), ["g"]),
    (HOMES.but(candidate_only=True, built_after=2009), []),
    (HOMES.but(price_kind="listing", fresh_only=True), ["h"]),
    (HOMES.but(fresh_only=True), []),
])
def test_query_entities(graph, state, want):
    got = ids(graph, state)
    assert sorted(got) == sorted(want) and (state.kind != "all" or got == want or len(got) < 2)


def test_empty_range_warns():
    with pytest.warns(UserWarning):
        STATE.but(min_budget=5.0, max_budget=1.0)


def test_shadowed_school(spark):
    e = spark.createDataFrame([("s", None, None), ("c", 30.0, 120.0)], "id string, lat double, lng double")
    links = spark.createDataFrame([("c", "s", "2026", "portal_coordinate_match")], "campus_id string, official_school_id string, year string, kind string")
    assert [r.id for r in relations.shadowed(e, links, "2026").collect()] == ["c"]
    assert {r.id for r in relations.shadowed(e, links, "2026", ("s",)).collect()} == {"s", "c"}


def test_ranking(spark):
    homes = spark.createDataFrame([("r1", "甲小区", "滨江区"), ("r2", "乙小区", "滨江区")], "id string, name string, district string")
    rows = [("r1", D(2026, 2, 1), 42000.0, 420.0, False), ("r1", D(2026, 8, 3), 46000.0, 460.0, False), ("r1", D(2026, 9, 1), 99000.0, 990.0, True), ("r2", D(2026, 6, 1), 50000.0, 300.0, False), ("r3", D(2026, 7, 1), 60000.0, 600.0, False)]
    prices = spark.createDataFrame([(e, "deal", "base", d, None, None, None, t, None, u, dup) for e, d, u, t, dup in rows], PRICE)
    s = HOMES.but(deal_from="2026-01-01", deal_to="2026-08-31")
    r = market.ranking(homes, prices, s).orderBy("rank").collect()
    assert [(x.id, x.deal_count, x.priced_count) for x in r] == [("r1", 2, 2), ("r2", 1, 1)]
    assert (r[0].median_unit, r[0].total_wan, r[0].latest_date) == (44000.0, 880.0, D(2026, 8, 3))
    assert [x.id for x in market.ranking(homes, prices, s, "unit").orderBy("rank").collect()] == ["r2", "r1"]


@pytest.mark.parametrize(("xs", "want"), [([1.0, 2.0, 4.5], 2.0), ([1.25], 1.25), ([1.0, 2.0], 2.0), ([1.0, 2.0, 3.0, 4.0], 3.0), ([None], None)])
def test_median(spark, xs, want):
    assert spark.createDataFrame([(x,) for x in xs], "x double").agg(values.median(F.col("x")).alias("m")).head().m == want


def test_relation_tiers(graph, spark):
    co = spark.createDataFrame([("s", "h", "p1"), ("s", "h", "p2"), ("s", "h", "p2"), ("s", "c", "p4")], "a string, b string, post_id string")
    near = spark.createDataFrame([("s", "u", 100.0), ("g", "u", 2500.0), ("g", "h", 50.0)], "id string, entity_id string, distance double")
    sel = graph["entities"].where("kind = 'school'").select("id")
    args = (graph["entities"], graph["admissions"], graph["links"], co, near, sel)
    items = relations.relation_items(*args, STATE)
    plan = {r.selected_id: r for r in relations.relation_plan(items, graph["entities"], sel).collect()}
    assert (plan["s"].tier, plan["s"].items, plan["s"].located_count, plan["s"].fallback, plan["s"].can_scope) == ("official", 2, 1, False, True)
    assert (plan["g"].tier, plan["g"].items, plan["g"].fallback) == ("nearby", 1, True)
    later = relations.relation_plan(relations.relation_items(*args, STATE.but(year="2030")), graph["entities"], sel)
    assert later.where("selected_id = 's'").head().tier == "co"
    rows = items.where("selected_id = 's' and tier = 'co'").collect()
    assert [(r.id, r["rows"]) for r in rows] == [("h", 2)]


def test_affiliation_is_its_own_tier(graph, spark):
    links = spark.createDataFrame([("c", "s", "2026", "documented_campus_affiliation", None)], graph["links"].schema)
    none = spark.createDataFrame([], "a string, b string, post_id string")
    near = spark.createDataFrame([], "id string, entity_id string, distance double")
    sel = graph["entities"].where("id = 'c'").select("id")
    items = relations.relation_items(graph["entities"], graph["admissions"], links, none, near, sel, STATE)
    assert relations.relation_plan(items, graph["entities"], sel).head().tier == "affiliation"


PROJECT = "entity_id string, source_id string, observed_at string, developer string, property_type string, sales_status string, delivery_date_raw string, opening_date_raw string, field_values map<string,string>"


def test_profile_completeness_and_conflict(spark):
    e = spark.createDataFrame([entity("h", "a", "residential", "d", None, None, None, (1, 2008, None, None)), entity("k", "b", "residential", "d", None, None)], ENTITY)
    full = {k: "x" for k in ("物业类型", "建筑类型", "产权年限", "建筑面积", "占地面积", "规划户数", "容积率", "绿化率", "物业公司", "物业费", "车位", "车位配比", "人车分流")}
    rows = [("h", "1", "2026", "dev", "home", "在售", "2020", "2019", full), ("k", "2", "2026", None, None, None, None, None, {"建成年代": "2011"}), ("k", "3", "2025", None, None, None, None, None, {"建成年代": "2012", "车位": "9"})]
    water = spark.createDataFrame([("h", "snapshot", 5.0)], "id string, basis string, value double")
    got = {r.id: r for r in profile.community_profile(e.withColumn("address", F.when(F.col("id") == "h", "here")), spark.createDataFrame(rows, PROJECT), water).collect()}
    assert (got["h"].known, got["h"].missing_percent, got["h"].passes, got["h"].timing) == (18, 0, True, "2019")
    assert got["k"].parking == "9" and got["k"].known == 2 and not got["k"].passes


def test_waterfall(spark):
    e = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    snap = spark.createDataFrame([("a", 10.0, "2026-01-01", None), ("a", 12.0, "2026-02-01", None), ("b", 0.0, "2026-01-01", None)], "entity_id string, reference_unit_yuan_sqm double, source_as_of string, observed_at string")
    proj = spark.createDataFrame([("b", 7.0, None, "2026")], "entity_id string, amount double, price_as_of string, observed_at string")
    rows = [("c", "listing", 3.0, False), ("c", "listing", 4.0, False), ("c", "deal", 9.0, False), ("d", "deal", 9.0, False), ("d", "listing", 5.0, True)]
    prices = spark.createDataFrame([(i, k, "b", None, None, None, None, None, None, u, dup) for i, k, u, dup in rows], PRICE)
    got = {r.id: (r.basis, r.value, r.n) for r in profile.price_waterfall(e, snap, proj, prices).collect()}
    assert got == {"a": ("snapshot", 12.0, 1), "b": ("project", 7.0, 1), "c": ("listing", 4.0, 2), "d": ("deal", 9.0, 1), "e": (None, None, None)}


# --- scalars ---


def one(spark, column, *row, schema="x string"):
    return spark.createDataFrame([row or (None,)], schema).select(column.alias("y")).head().y


@pytest.mark.parametrize(("x", "want"), [("1,234.5", 1234.5), (" 0 ", 0.0), ("-1", None), ("", None), (None, None), ("NaN", None), ("inf", None), ("1d", None), ("true", None), ("1e3", 1000.0)])
def test_number(spark, x, want):
    assert one(spark, values.number(F.col("x")), x) == want


@pytest.mark.parametrize(("x", "want"), [("20260908", D(2026, 9, 8)), ("2026-9-8", D(2026, 9, 8)), ("2026-09-08T10:00", D(2026, 9, 8)), ("2026-02-30", None), ("2026-05", None), ("", None), (None, None)])
def test_day(spark, x, want):
    assert one(spark, values.day(F.col("x")), x) == want


@pytest.mark.parametrize(("x", "want"), [
    ("https://a.b/c?q=1#f", "https://a.b/c"), ("http://u@a.b/", ""), ("ftp://a.b/", ""), ("nonsense", ""), (None, ""),
    ("https://m.fang.com/chengjiao/hz/?projcode=123&x=1", "https://m.fang.com/chengjiao/hz/?projcode=123"), ("https://m.fang.com/chengjiao/hz/?projcode=1&projcode=2", "https://m.fang.com/chengjiao/hz/"),
])
def test_safe_url(spark, x, want):
    assert one(spark, values.safe_url(F.col("x")), x) == want


@pytest.mark.parametrize(("x", "want"), [("osm:way:430812030", "104"), ("official:school:2133001518001", "043")])
def test_shard_vectors(spark, x, want):
    assert one(spark, values.shard(F.col("x")), x) == want


def test_shard_needs_ascii(spark):
    with pytest.raises(Exception, match="ASCII"):
        one(spark, values.shard(F.col("x")), "é")


def test_price_market(spark):
    rows = [("new-project:1", "reference", None, None, "new"), ("incremental-price:1", "deal", None, None, "resale"), ("incremental-price:1", "reference", None, None, "unknown"), ("deals", "deal", None, None, "resale"), ("x", "listing", "https://hz.x.cn/ershoufang/1", None, "resale"), ("x", "listing", "https://hz.anjuke.com/esf/1", None, "resale"), ("x", "listing", "https://hz.anjuke.com.cn/esf/1", None, "unknown"), ("x", "reference", "bad url", "历史/新房楼盘口径", "new"), ("x", "deal", None, "历史/新房楼盘口径", "unknown")]
    df = spark.createDataFrame(rows, "s string, k string, u string, n string, want string")
    got = df.select(values.price_market(F.col("s"), F.col("k"), F.col("u"), [F.col("n")]).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_json_and_locks(spark):
    assert one(spark, values.dump(F.struct(F.lit("é").alias("b"), F.lit(None).cast("int").alias("a")))) == '{"b":"é","a":null}'
    import hashlib

    lock = spark.createDataFrame([("b",), ("a",), ("b",)], "id string").agg(values.id_set_lock(F.col("id")).alias("l")).head().l
    assert (lock["count"], lock.sha256) == (2, hashlib.sha256(b'["a","b"]').hexdigest())
    assert one(spark, values.json_positive(F.parse_json("x")), "1.5") == 1.5
    for x in ('"1.5"', "true", "-1", "null"):
        assert one(spark, values.json_positive(F.parse_json("x")), x) is None


def test_funding_gap(spark):
    col = lambda b: values.funding_gap(F.lit(b), F.lit("300"), F.lit("50"), F.lit("20"), F.lit("100"))
    got = one(spark, col("400"))
    assert (got.net_sale, got.available, got.gap) == (200.0, 250.0, 170.0)
    assert one(spark, col("")) is None


def test_distance_and_datum(spark):
    assert one(spark, geo.distance_m(F.lit(30.2), F.lit(120.2), F.lit(30.201), F.lit(120.201))) == 147
    p = one(spark, geo.shifted_to_wgs84(F.lit(120.2), F.lit(30.2)))
    assert abs(p.lng - 120.1953) < 0.002 and abs(p.lat - 30.2023) < 0.004
    assert one(spark, geo.portal_point(F.lit(""), F.lit("30"))) is None


def test_nearby_finds_what_all_pairs_find(spark):
    import random

    rng = random.Random(1)
    rows = [(f"p{k}", rng.choice(["school", "residential"]), True, 30 + rng.random() / 20, 120 + rng.random() / 20) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, kind string, primary_school boolean, lat double, lng double")
    got = {(r.id, r.entity_id) for r in spatial.nearby(df).collect()}
    a, b = df.alias("a"), df.alias("b")
    d = geo.distance_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    near = (F.abs(F.col("a.lat") - F.col("b.lat")) <= 0.019) & (F.abs(F.col("a.lng") - F.col("b.lng")) <= 0.023)
    want = {(r[0], r[1]) for r in a.join(b, (F.col("a.kind") != F.col("b.kind")) & near & (d <= 2000)).select("a.id", "b.id").collect()}
    assert got == want and len(got) > 20


# --- texts ---


def test_norm(spark):
    assert one(spark, text.norm(F.col("x"), True), "浙江省杭州市 ＡＢ·小学　") == "AB小学"
    assert one(spark, text.normalize(F.col("x")), "ＡＢ • c") == "abc"


def test_body_identity(spark):
    a = one(spark, text.body_hash(F.col("x")), "你好，World #tag[话题]# ！[笑哭R]")
    assert a == one(spark, text.body_hash(F.col("x")), "你好world #other")
    assert one(spark, text.meaningful_characters(F.col("x")), "a1，。𝒜 #t") == 4


@pytest.mark.parametrize(("title", "body", "hints", "want"), [("滨江区", "x", None, "滨江区"), ("滨江区", "西湖区", None, ""), ("滨江区", "x", ["西湖"], ""), ("t", "x", ["滨江"], "滨江区"), ("t", "x", ["滨江", "西湖"], ""), ("t", "x", ["余杭"], "")])
def test_post_district(spark, title, body, hints, want):
    assert one(spark, text.post_district(F.col("t"), F.col("b"), F.col("h")), title, body, hints, schema="t string, b string, h array<string>") == want


@pytest.mark.parametrize(("title", "body", "want"), [("整租两居", "月租三千", True), ("投资出租回报率", "x", False), ("整租", "也可出售", False), ("买了学区房", "出租中", False)])
def test_rental_only(spark, title, body, want):
    assert one(spark, text.rental_only(F.col("t"), F.col("b")), title, body, schema="t string, b string") is want


@pytest.mark.parametrize(("name", "want"), [("闻涛花园", True), ("小 区", False), ("江南大道", False), ("12号楼", False)])
def test_named_home(spark, name, want):
    assert one(spark, text.named_home(F.col("x")), name) is want


@pytest.mark.parametrize(("query", "want"), [("%", [2]), ("_", [2]), (" ", [1, 2, 3]), ("滨江", [1]), ("ABC", [3])])
def test_literal_search(spark, query, want):
    posts = spark.createDataFrame([(1, "滨江学区", "正文", True, 1), (2, "拱墅二手房", "含 100% 与下划线_字符", None, 2), (3, "其他abc", None, None, 3)], "id int, title string, description string, deep_read boolean, posted int")
    got = search.search_posts(posts, query, 5).collect()
    assert sorted(r.id for r in got) == want and all(r.total == len(want) for r in got)


def test_article_text():
    page = '<meta name="ArticleTitle" content="T"><nav>x</nav><div class="a article-content"><p>One<br>two&nbsp; three</p><script>z</script><table><tr><td>a</td><td>b</td></tr></table></div><div class="article-content">no</div>'
    assert article.article_text(page) == {"title": "T", "text": "One\ntwo three\na b"}
    assert article.article_text(None) == {"title": None, "text": ""}


def test_longest_spans(spark):
    e = spark.createDataFrame([("1", "residential", "闻涛花园", ["闻涛花园南区"]), ("2", "school", "花园南", []), ("3", "school", "南区小学", []), ("4", "school", "重名小学", []), ("5", "school", "重名小学", []), ("6", "school", "短名", [])], "id string, kind string, name string, aliases array<string>")
    posts = spark.createDataFrame([("a", "住在闻涛花园南区小学旁"), ("b", "闻涛花园和重名小学，短名"), ("c", None)], "id string, text string")
    sure, unsure = mentions.matched(posts, mentions.mention_names(e))
    assert {tuple(r) for r in sure.collect()} == {("a", "1"), ("a", "3"), ("b", "1")}
    assert {tuple(r) for r in unsure.collect()} == {("b", "重名小学")}


def test_source_pages(spark):
    s = spark.createDataFrame([(f"{k:04d}", f"label {k}", "", "", "", "", "") for k in range(1090)], "id string, label string, notes string, url string, source_as_of string, observed_at string, kind string")
    first = search.source_page(s).collect()
    assert len(first) == 40 and first[0].page_count == 28
    assert len(search.source_page(s, page=99).collect()) == 10
    assert [r.id for r in search.source_page(s, focus="0007").collect()] == ["0007"]
    assert search.source_page(s, focus="7").count() == 0
    assert search.source_page(s, query="LABEL 1089").count() == 1


# --- resolution, imports, writing ---


def test_resolution(spark):
    cat = spark.createDataFrame([("osm:1", "residential", "甲小区", "滨江区", 30.0, []), ("local:9", "residential", "甲小区", "滨江区", None, []), ("osm:2", "residential", "乙", "滨江区", 30.0, ["丙"]), ("osm:3", "residential", "丙", "滨江区", 30.0, []), ("x", "school", "杭州市丁小学", "滨江区", None, [])], "id string, kind string, name string, district string, lat double, aliases array<string>")
    rec = spark.createDataFrame([("s", "1", "甲 小区", "residential", "滨江", []), ("s", "2", "丙", "residential", "滨江区", []), ("s", "3", "戊", "residential", "滨江区", []), ("admissions", "4", "丁小学", "school", None, []), ("admissions", "home:5", "己", "residential", "滨江区", [])], "source string, record string, name string, kind string, district string, aliases array<string>")
    got = {r.record: (r.entity_id, r.status) for r in resolve.resolve(rec, cat).collect()}
    assert got["1"] == ("osm:1", "name_match_review_required") and got["4"] == ("x", "same_name_unlocated") and got["home:5"] == ("official:residential:5", "unmatched")
    assert got["2"][1] == "ambiguous" and got["3"][1] == "unmatched" and got["3"][0].startswith("local:residential:")
    assert resolve.minted(resolve.resolve(rec, cat)).count() == 3


def test_stages_see_what_earlier_ones_minted(spark):
    schema = "source string, record string, name string, kind string, district string, aliases array<string>"
    cat = spark.createDataFrame([], "id string, kind string, name string, district string, lat double, lng double, aliases array<string>")
    one = spark.createDataFrame([("candidates", "7", "甲小区", "residential", "滨江区", []), ("candidates", "8", "甲 小区", "residential", "滨江区", ["别名"])], schema)
    two = spark.createDataFrame([("deals", "1", "乙小区", "residential", "滨江区", []), ("deals", "2", "别名", "residential", "滨江区", [])], schema)
    three = spark.createDataFrame([("leads", "1", "乙小区", "residential", "滨江区", [])], schema)
    out, known = resolve.resolve_stages([one, two, three], cat)
    got = {(r.source, r.record): (r.entity_id, r.status) for r in out.collect()}
    assert got["leads", "1"] == (got["deals", "1"][0], "same_name_unlocated") and got["deals", "2"][1] == "unmatched"
    assert got["candidates", "8"] == (got["candidates", "7"][0], "same_name_unlocated")
    assert known.count() == known.select("id").distinct().count() == 3


def test_names_sort_by_pinyin(spark):
    names = spark.createDataFrame([("张",), ("李",), ("阿",), ("王",)], "name string")
    assert [r.name for r in names.orderBy(text.in_name_order(F.col("name"))).collect()] == ["阿", "李", "王", "张"]


def test_market_identities(spark):
    rows = [("fang", "1", "d", "甲", "甲苑", "deal"), ("fang", "1", "d", "甲苑", None, "listing"), ("fang", "2", "d", "乙一期", "乙二期", "deal"), ("fang", "3", "d", "丙", None, "deal"), ("fang", "3", "d", "丁", None, "deal"), ("fang", "4", "d", "戊", "戊", "deal")]
    df = spark.createDataFrame(rows, "source string, community_id string, district string, community string, directory_name string, record_kind string")
    cat = spark.createDataFrame([("osm:1", "residential", "甲", "d", 1.0, [])], "id string, kind string, name string, district string, lat double, aliases array<string>")
    got = {r.community_id: (r.status, r.target_id) for r in resolve.market_identities(df, cat).collect()}
    assert got == {"1": ("source_project_marketing_alias_bridge", "osm:1"), "2": ("phase_names_preserved", None), "3": ("directory_identity_unresolved", None), "4": ("no_alias_change", None)}


def test_bridge_lock(spark):
    import hashlib

    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "source_entity_id string, id string")
    sha = lambda x: hashlib.sha256(json.dumps(x, separators=(",", ":")).encode()).hexdigest()
    b = spark.createDataFrame([("a", "t", 2, sha(["1", "2"])), ("b", "t", 1, sha(["4"]))], "source_entity_id string, target_entity_id string, count long, sha256 string")
    assert {r.source_entity_id: r.lock for r in resolve.locked_bridge(rows, b).collect()} == {"a": True, "b": False}


CANDIDATE = "id string, record_kind string, baseline_status string, source_record_id string, source_url string, evidence_url string, comparison_prior_record_ids array<string>, community_source_id string, district string, community string, layout string, orientation string, area_sqm double, total_wan double, unit_yuan_sqm double, event_date string, observed_at string, possible_duplicate_group string, price_disclosure string, tls_verification_enabled boolean, evidence_sha256 string"
GOOD = {"id": "fang:deal:EX_1", "record_kind": "deal_price_enrichment_candidate", "baseline_status": "existing_841_price_enrichment_candidate", "source_record_id": "EX_1", "source_url": "https://m.fang.com/chengjiao/hz/EX_1.html", "evidence_url": "https://m.fang.com/chengjiao/hz/EX_1.html", "comparison_prior_record_ids": ["fang:deal:" + "a" * 64], "community_source_id": "12", "district": "滨江区", "community": "x", "layout": "x", "orientation": "x", "area_sqm": 100.0, "total_wan": 300.0, "unit_yuan_sqm": 30.0, "event_date": "2026-05-01", "observed_at": "2026-05-02T00:00:00+08:00", "possible_duplicate_group": None, "price_disclosure": "visible", "tls_verification_enabled": True, "evidence_sha256": "b" * 64}


@pytest.mark.parametrize(("field", "value", "want"), [
    ("id", "fang:deal:EX_1", None), ("record_kind", "deal", "not_reviewable_enrichment_candidate"), ("source_record_id", "a b", "invalid_detail_identity"), ("evidence_url", "x", "detail_url_identity_mismatch"),
    ("comparison_prior_record_ids", [], "not_one_exact_anonymous_target"), ("community_source_id", "x", "invalid_source_community_id"), ("community_source_id", "2011155836", "district_conflict_2011155836"), ("district", "余杭区", "district_out_of_scope"),
    ("layout", " ", "missing_immutable_fields"), ("total_wan", None, "invalid_or_missing_price_or_area"), ("event_date", "2025-05-01", "invalid_2026_event_or_observation_time"), ("observed_at", "2026-05-02T00:00:00", "invalid_2026_event_or_observation_time"),
    ("possible_duplicate_group", "g", "possible_duplicate_unresolved"), ("tls_verification_enabled", None, "not_visible_tls_verified_evidence"), ("evidence_sha256", "x", "invalid_evidence_hash"),
])
def test_enrichment_shape(spark, field, value, want):
    row = GOOD | {field: value}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in CANDIDATE.split(", "))], CANDIDATE)
    assert df.select(importers.enrichment_shape().alias("r")).head().r == want


SOCIAL = "id string, source_url string, observed_at string, body_sha256 string, meaningful_characters long, accepted boolean, exclusion_reason string, baseline_index boolean, record struct<id:string,title:string,desc:string,description_kind:string,valid:boolean,exclusion_reasons:array<string>>"


@pytest.mark.parametrize(("change", "want"), [
    ({}, None), ({"id": "x"}, "exact_note_id_mismatch"), ({"source_url": "https://site.test/explore/other"}, "exact_source_url_mismatch"), ({"record": {"desc": "，"}}, "no_prose"), ({"record": {"desc": "短"}}, "short_or_low_content"),
    ({"accepted": False}, "not_accepted"), ({"accepted": None, "exclusion_reason": "mine"}, "mine"), ({"record": {"valid": False}}, "out_of_scope"), ({"record": {"description_kind": "x"}}, "not_prose_or_caption"),
    ({"body_sha256": "0" * 64}, "body_hash_mismatch"), ({"meaningful_characters": 1}, "meaningful_character_count_mismatch"), ({"baseline_index": True}, "baseline_index_mismatch"), ({"observed_at": "2026-01-01"}, "invalid_observation_time"),
])
def test_social_reasons(spark, change, want):
    body = "这是一段足够长的正文" * 6
    note = "a" * 24
    record = {"id": note, "title": "t", "desc": body, "description_kind": "prose_or_caption", "valid": True, "exclusion_reasons": []} | change.get("record", {})
    row = {"id": note, "source_url": f"https://site.test/explore/{note}", "observed_at": "2026-01-01T00:00:00Z", "body_sha256": one(spark, text.body_hash(F.col("x")), record["desc"]), "meaningful_characters": one(spark, text.meaningful_characters(F.col("x")), record["desc"]), "accepted": True, "exclusion_reason": None, "baseline_index": False}
    row |= {k: v for k, v in change.items() if k != "record"}
    df = spark.createDataFrame([(*row.values(), tuple(record.values()))], SOCIAL)
    none = lambda c: spark.createDataFrame([], f"{c} string")
    assert importers.social_reason(df, none("id"), none("id"), none("h"), ("site.test",)).head().reason == want


def test_first_bodies(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "x")], "ord int, id string, body_sha256 string")
    got = {r.ord: r.reason for r in importers.first_bodies(rows, F.col("ord")).collect()}
    assert got == {1: None, 2: "duplicate_id", 3: None, 4: "duplicate_body"}


def test_write_semantics(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert {tuple(r) for r in upsert.first_wins(df, ["k"], [F.col("v")]).collect()} == {("a", 1), ("b", 3)}
    assert {tuple(r) for r in upsert.last_wins(df, ["k"], [F.col("v")]).collect()} == {("a", 2), ("b", 3)}
    with pytest.raises(Exception, match="repeated key"):
        upsert.unique_or_fail(df, ["k"]).collect()
    t = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    c = spark.createDataFrame([("a", None, 5), ("b", 2, 6)], "k string, v int, new_v int")
    assert {tuple(r) for r in upsert.compare_and_set(t, c, ("k", "v"), ("v",)).collect()} == {("a", 5, 1), ("b", 1, 0)}


def test_publish_keeps_the_last_good_version(spark, tmp_path):
    root, df = f"file://{tmp_path}/db", spark.range(3)
    first = publish.publish({"t": df}, root, {"none": df.limit(0)})
    with pytest.raises(ValueError, match="bad rows"):
        publish.publish({"t": df}, root, {"bad rows": df})
    assert publish.current(spark, root) == first and publish.table(spark, root, "t").count() == 3
    second = publish.publish({"t": df.limit(1)}, root)
    assert publish.current(spark, root) == second != first
    publish.export_shards(spark.createDataFrame([("osm:way:430812030", 1)], "id string, v int"), f"{root}/out")
    listed = json.loads(publish.manifest(spark, f"{root}/out", entities=1))
    assert listed["entities"] == 1 and any("shard=104" in f["path"] for f in listed["files"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"name": "x"}]}')
    (tmp_path / "b.json").write_text('[{"name": "y"}, {"name": null}]')
    (tmp_path / "c.csv").write_text("﻿name,v\nz,1\n")
    from pyspark.sql import types as T

    rows = readers.json_documents(spark, f"file://{tmp_path}/*.json", T.StructType([T.StructField("name", T.StringType())]))
    assert sorted(str(r.name) for r in rows.collect()) == ["None", "x", "y"]
    assert [r.name for r in readers.csv_rows(spark, f"file://{tmp_path}/c.csv", ["name", "v"]).collect()] == ["z"]
    assert readers.file_hashes(spark, f"file://{tmp_path}/a.json").count() == 1
    snap = spark.createDataFrame([("/p/2026-01-02.json", "a"), ("/p/2026-01-02.json", ""), ("/q/2026-01-03.json", "a"), ("/r/2026-01-03.json", "b")], "path string, name string")
    assert {(r.path[1], r.valid) for r in readers.snapshot_files(snap, 1).collect()} == {("p", False), ("q", True), ("r", True)}
    assert [r.name for r in readers.complete_snapshots(snap, 1).collect()] == ["b"]
    cat = spark.createDataFrame([("a", 30.0, 120.0, "WGS84")], "id string, lat double, lng double, crs string")
    assert readers.catalogue(cat, 1).count() == 1
    with pytest.raises(Exception, match="coverage"):
        readers.catalogue(cat, 2).collect()
    with pytest.raises(ValueError, match="reviewed"):
        readers.reviewed_bundles({"schema_version": 1}, None, None)


def test_paged_receipts(spark):
    schema = "query string, start int, total int, items array<struct<id:string>>"
    full = [("q", 0, 3, [("a",), ("b",)]), ("q", 2, 3, [("c",)]), ("q", 2, 3, [("c",)])]
    assert [r.id for r in readers.paged_receipts(spark.createDataFrame(full, schema), "id").orderBy("ord").collect()] == ["a", "b", "c"]
    for bad in (full[:1], [full[0], ("q", 2, 3, [("a",)])]):
        with pytest.raises(Exception, match="incomplete"):
            readers.paged_receipts(spark.createDataFrame(bad, schema), "id").collect()


def test_bundle_stream(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "in").mkdir()
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
    run = lambda: bundles.ingest(spark, f"file://{tmp_path}/in", schema, predicates.first_reason((F.col("v") < 0, "negative")), f"file://{tmp_path}/ok", f"file://{tmp_path}/bad", f"file://{tmp_path}/cp")
    (tmp_path / "in/1.json").write_text('{"id":"a","v":1}\n{"id":"b","v":-1}\n')
    run()
    (tmp_path / "in/2.json").write_text('{"id":"c","v":2}\n')
    run()
    run()
    assert spark.read.parquet(f"file://{tmp_path}/ok").count() == 2
    assert [r.reason for r in spark.read.parquet(f"file://{tmp_path}/bad").collect()] == ["negative"]


# --- reviewed evidence, dossiers ---


def test_semantic_review_reasons(spark):
    from pyspark.sql import types as T

    from terrafold.operators import reviews

    note, sha, body = "a" * 24, "b" * 64, "c" * 64
    claim = T.StructType([T.StructField(c, T.StringType()) for c in ("decision", "body_sha256", "review_sha256", "review_source")])
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("body_sha256", T.StringType()), T.StructField("claim", claim)])
    cases = [
        (note, ("accept", body, sha, "f"), None), (note, ("exclude", body, sha, "f"), "semantic_review_acceptance_required"), (note, ("accept", "x", sha, "f"), "semantic_review_claim_body_hash_mismatch"),
        (note, ("accept", body, None, "f"), "semantic_review_file_hash_required"), (note, ("accept", body, sha, " "), "semantic_review_source_required"), (note, ("accept", body, sha, "none"), "semantic_review_source_missing_or_outside"),
        (note, ("accept", body, "d" * 64, "f"), "semantic_review_file_changed_or_hash_mismatch"), (note, ("accept", body, sha, "draft"), "semantic_review_file_unreviewed"), (note, ("accept", body, sha, "odd"), "semantic_review_invalid_decision"),
        (note, ("accept", body, sha, "twice"), "semantic_review_duplicate_decision"), ("e" * 24, ("accept", body, sha, "f"), "semantic_review_note_not_found"), (note, ("accept", body, sha, "no"), "semantic_review_source_does_not_accept"), (note, ("accept", body, sha, "other"), "semantic_review_source_body_hash_mismatch"),
    ]
    rows = spark.createDataFrame([(i, body, c) for i, c, _ in cases], schema)
    files = spark.createDataFrame([(p, sha, True, True, True, True, "draft" if p == "draft" else None) for p in ("f", "draft", "odd", "twice", "no", "other")], "path string, sha256 string, registered boolean, readable boolean, is_document boolean, reviewed boolean, status string")
    d = [("f", note, "accept", body), ("draft", note, "accept", body), ("odd", note, "accept", body), ("odd", "x", "accept", body), ("twice", note, "accept", body), ("twice", note, "accept", body), ("no", note, "exclude", body), ("other", note, "accept", "f" * 64)]
    decisions = spark.createDataFrame([(*x, None, None) for x in d], "path string, id string, decision string, body_sha256 string, body_read_complete boolean, counted boolean")
    got = {(r.id, tuple(r.claim)): r.reason for r in reviews.semantic_review_reason(rows, files, decisions).collect()}
    assert got == {(i, c): want for i, c, want in cases}


def test_group_evidence(spark):
    from terrafold.operators import reviews

    records = spark.createDataFrame([("1", "2024", "s1", "滨江区", "旧文"), ("1", "2025", "s1", "滨江区", "本校　是集团 成员"), ("2", "2025", "s2", "拱墅区", "集团成员")], "official_id string, year string, entity_id string, district string, detail string")
    rows = [("group:b:x", "滨江区", "1", True, "1", "集团成员", None), ("group:b:x", "滨江区", "1", False, "1", "旧文", "evidence_changed"), ("Group", "滨江区", "1", True, "1", "集团", "invalid_group"), ("group:b:y", "滨江区", "9", True, "1", "集团", "school_missing"), ("group:b:z", "滨江区", "2", True, "2", "集团", "cross_district_membership"), ("group:b:w", "滨江区", "1", True, "1", "集团", "duplicate_membership")]
    df = spark.createDataFrame([r[:6] for r in [*rows, rows[-1]]], "group_id string, district string, official_id string, current boolean, evidence_official_id string, evidence_contains string")
    got = {(r.group_id, r.current): r.reason for r in reviews.group_evidence(df, records, ("滨江区", "拱墅区")).collect()}
    assert got == {(r[0], r[3]): r[6] for r in rows}


def test_policy_bundles_fail_whole(spark):
    import hashlib

    from terrafold.operators import reviews

    art = "正文" * 60
    good = ("1", "b", "h", "h", 5, 5, art, f"页眉 {art}", hashlib.sha256(art.encode()).hexdigest(), "2026-01-01T00:00:00+08:00", "t", "t", "2026-01-01", "20260101", None)
    names = "id string, bundle string, sha256 string, want_sha256 string, bytes long, want_bytes long, article string, visible string, text_sha256 string, observed_at string, title string, original_title string, publication_date string, original_publication_date string, tls_verified boolean"
    bad = ("2", "c", "h", "x", 5, 6, art, "other", "no", "2026-01-01", "t", "u", "2026-01-01", "2026", True)
    df = spark.createDataFrame([good, bad, ("3", "c", *good[2:])], names)
    failed = {r.id: r.failed for r in reviews.policy_requirements(df).collect()}
    assert failed["1"] == [] and failed["3"] == [] and failed["2"] == ["hash", "bytes", "article_not_in_page", "text_hash", "observation_time", "title", "publication_date", "tls_claim"]
    assert {r.bundle: r.accepted for r in reviews.whole_bundles(df).collect()} == {"b": True, "c": False}


def test_baseline_and_observations(spark):
    from terrafold.operators import reviews

    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x string")
    a, b = "a" * 24, "b" * 24
    ok = reviews.frozen_baseline(one(a, b), one(a), one("c" * 64), one(a, b, "z"), {"valid_count": 2, "body_count": 1})
    assert all(df.isEmpty() for df in ok.values())
    bad = reviews.frozen_baseline(one(a, a), one(b), one("c"), one(b), {"valid_count": 1, "body_count": 1})
    assert not any(bad[k].isEmpty() for k in ("repeated", "odd_hashes", "bodies_outside", "not_loaded", "counts"))
    rows = [("o", "construction_progress", False, None, None, "2026-05-01", "https://a.b/c", "1", "2026", "滨江区", "杭州市甲小学", "r", "q", "n", "h")]
    df = spark.createDataFrame(rows, "id string, evidence_type string, creates_official_admission_relation boolean, residential_names string, admission_year string, published_at string, source_url string, official_id string, year string, district string, canonical_school_name string, observed_at string, source_quote string, notes string, response_sha256 string")
    records = spark.createDataFrame([("1", "2026", "s")], "official_id string, year string, entity_id string")
    places = spark.createDataFrame([("s", "甲小学", "滨江区")], "id string, name string, district string")
    got = reviews.observations(df, records, places).head()
    assert (got.id, got.entity_id, got.year) == ("o", "s", "2026") and "quote: q" in got.body
    with pytest.raises(Exception, match="exactly one place"):
        reviews.attached_entities(spark.createDataFrame([("d", "s", "other", "school", "x")], "id string, entity_id string, entity_name string, kind string, district string"), places.withColumn("kind", F.lit("school"))).collect()
    with pytest.raises(Exception, match="directory"):
        reviews.reconciled(spark.createDataFrame([("s",)], "school_id string"), spark.createDataFrame([("s", 2)], "school_id string, n long")).collect()
    files = spark.createDataFrame([("data/incremental/a.body", "h")], "path string, sha256 string")
    caps = spark.createDataFrame([("data/incremental/a.body", "h"), ("data/incremental/../a.body", "h"), ("data/incremental/a.body", "x")], "evidence_raw_path string, evidence_sha256 string")
    assert sorted(r.captured for r in reviews.captured(caps, files).collect()) == [False, False, True]


def test_dossier_is_year_guarded(spark, graph):
    from terrafold.operators import detail

    links = spark.createDataFrame([("c", "s", "2026", "portal_coordinate_match", 3.0)], graph["links"].schema)
    records = spark.createDataFrame([("s", "s", "2024"), ("s", "s", "2026"), ("c", "c", "2023")], "entity_id string, official_id string, year string")
    empty = lambda schema: spark.createDataFrame([], schema)
    sel = spark.createDataFrame([("c",)], "id string")
    out = detail.dossier(
        sel, graph["entities"], graph["admissions"].withColumnRenamed("id", "admission_id"), links, records, empty("id string, title string"), empty("post_id string, entity_id string"), graph["prices"].withColumn("id", F.lit("p")),
        empty("source_id string, entity_id string"), empty("source_id string, entity_id string"), empty("a string, b string, post_ids array<string>"), spark.createDataFrame([("p1", "2026", ["s"]), ("p2", "2024", ["s"]), ("p3", "2020", ["c"])], "policy_id string, year string, school_ids array<string>"),
        empty("entity_id string, snapshot_date date"), empty("source_id string, entity_id string"), empty("group_id string, school_id string, year string, active boolean"), empty("id string, entity_id string, distance long"),
    )
    assert {r.admission_id for r in out["admissions"].collect()} == {"1", "2"}
    assert {(r.school_id, r.year) for r in out["school_records"].collect()} == {("c", "2023"), ("s", "2026")}
    assert {r.policy_id for r in out["policies"].collect()} == {"p1", "p3"}
    for df in out.values():
        assert df.columns[0] == "id" or "id" in df.columns
        df.collect()


def test_archives_and_status(spark):
    from terrafold.operators import detail

    s = spark.createDataFrame([("policy:service_area", "official", "a"), ("policy:other", "official", "b"), ("l", detail.ARCHIVE_KIND, "c")], "id string, kind string, label string")
    checks = spark.createDataFrame([("policy:service_area", "ok", True)], "id string, status string, archived boolean")
    got = {r.id: (r.link_status, r.archive_available) for r in detail.source_status(s, checks).collect()}
    assert got == {"policy:service_area": ("ok", True), "policy:other": (None, None), "l": ("unverified", True)}
    p = spark.createDataFrame([("l", "local_policy_archive", None, "2026", "body")], "source_id string, kind string, label string, year string, body string")
    assert [(r.title, r.text) for r in detail.source_archives(s, p).collect()] == [("c", "body")]
    assert detail.source_archives(s, p.union(p)).count() == 0
