"""Queries without SQL against plain Python, and small rules that have no query of their own."""

import hashlib
import json
import os
import random
import re
import subprocess
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from terrafold.functions import article, geo
from terrafold.operators import importers, resolve, search, upsert
from terrafold.plans import queries
from terrafold.sources import publish, readers

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
regex = pytest.importorskip("regex")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@tables
def test_search_keys(spark):
    key = lambda t: regex.sub(r"[\s·•]", "", unicodedata.normalize("NFKC", t or "")).lower()
    got = {r.doc_id: r.norm for r in queries.QUERIES["q_norm_nfkc"](spark, SF).collect()}
    assert got == {i: hashlib.sha256(key(t).encode()).hexdigest() for i, t in documents(spark)}


@tables
def test_body_identities(spark):
    def body(t):
        t = regex.sub(r"(^|\s)#[^\s#]+", " ", regex.sub(r"#[^#\n]+?\[话题\]#", " ", t or ""))
        t = regex.sub(r"\[[^\]\n]{1,20}R\]", "", unicodedata.normalize("NFKC", t))
        return hashlib.sha256(regex.sub(r"[^\p{L}\p{N}]", "", t).lower().encode()).hexdigest()

    rows = queries.QUERIES["q_letters_hash"](spark, SF)
    column = next(c for c in rows.columns if c != "doc_id")
    assert {r.doc_id: r[column] for r in rows.collect()} == {i: body(t) for i, t in documents(spark)}


@tables
def test_longest_names(spark):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keys = {}
    for i, t in items:
        for name in {t, t[:24]}:
            keys.setdefault(unicodedata.normalize("NFKC", name).strip(), set()).add(i)
    want = set()
    for doc, t in documents(spark):
        t = unicodedata.normalize("NFKC", t or "")
        spans = {(at, at + len(k), k) for k in keys for at in range(len(t)) if len(k) > 1 and t.startswith(k, at)}
        kept = {s for s in spans if not any((o[0] <= s[0] and s[1] <= o[1]) and o[:2] != s[:2] for o in spans)}
        want |= {(doc, next(iter(keys[k]))) for _, _, k in kept if len(keys[k]) == 1}
    got = {(r.id, r.entity_id) for r in queries.QUERIES["q_span_longest"](spark, SF).collect()}
    assert got == want and want


@tables
def test_archived_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["q_html_article"](spark, SF).collect():
        import html

        inner = pages[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0]
        plain = html.unescape(regex.sub(r"<[^>]*>", "", regex.sub(r"</?(?:p|div|h1|li|ul|br|section)\b[^>]*>", "\n", inner)))
        lines = [regex.sub("[\t  ]+", " ", x).strip() for x in plain.splitlines()]
        assert r.title is None and r.text == "\n".join(x for x in lines if x)


def test_article_shapes():
    text = lambda page: article.article_text(page)["text"]
    assert text('<p class="article-content">a<p>b</p>c</p>d') == "a\nb\nc"
    assert text('<div class="x article-content"><div>a</div><iframe><p>no</p></iframe><td>b<td>c</div>d<div class="article-content">e</div>') == "a\nb c"
    assert text('<div class="article-content">open') == "open"
    # A marked element without content of its own is open all the same: only a closing tag of its name would end it.
    assert text('<br class="article-content">kept') == "kept" and text("") == ""
    assert text('<section class="article-content"><script>1</script>a<br/>b<hr>c</section>') == "a\nb\nc"


def test_compare_set_and_saved_ids():
    assert search.toggle_compare(["a"], "b") == ["a", "b"] and search.toggle_compare(["a", "b"], "a") == ["b"]
    assert search.toggle_compare(list("abcd"), "e") == list("abcd")


def test_probes_must_be_complete():
    good = {"valid": True, "errors": [], "success": 3, "rows": 3}
    assert readers.complete_probe(good) == good
    for bad in ({"valid": False}, {"errors": ["x"]}, {"success": 2}):
        with pytest.raises(ValueError, match="complete"):
            readers.complete_probe(good | bad)


def test_two_changes_do_not_repeat_a_row(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "id int, name string, v int")
    changes = spark.createDataFrame([(1, "a", 9), (1, "a", 8), (2, None, 7), (1, "b", 6)], "id int, name string, new_v int")
    got = sorted((r.id, r.v, r.n_applied) for r in upsert.compare_and_set(target, changes, ("id", "name"), ("v",)).collect())
    assert got == [(1, 8, 2), (2, 7, 1)]


def test_only_public_keys_and_numbers_leave(spark):
    rows = spark.createDataFrame([("a", 1.5, "secret"), ("b", float("nan"), "x")], "id string, v double, note string")
    assert publish.public(rows, ("id", "v", "missing")).columns == ["id", "v"]
    body = rows.where("id = 'a'").select(publish.api_rows(rows).alias("j")).head().j
    assert json.loads(body) == {"id": "a", "v": 1.5, "note": "secret"}
    with pytest.raises(Exception, match="not a JSON number"):
        rows.select(publish.api_rows(rows)).collect()


def test_source_pages_clamp(spark):
    sources = spark.range(95).select(F.format_string("s%03d", "id").alias("id"), *[F.lit("x").alias(c) for c in ("label", "notes", "url", "source_as_of", "observed_at", "kind")])
    for asked, page, first, n in ((1, 1, "s000", 40), (2.9, 2, "s040", 40), (99, 3, "s080", 15), (-4, 1, "s000", 40), (float("inf"), 1, "s000", 40)):
        got = search.source_page(sources, page=asked).orderBy("row").collect()
        assert (got[0].page, got[0].id, len(got), got[0].matched, got[0].page_count) == (page, first, n, 95, 3)
        assert [r.row for r in got] == list(range((page - 1) * 40 + 1, (page - 1) * 40 + n + 1))
    assert search.source_page(sources, query="nothing").count() == 0
    assert [r.id for r in search.source_page(sources, focus="s007", page=3).collect()] == ["s007"]


def test_text_sizes_have_a_floor():
    assert geo.least_text_size(None) == 12 and geo.least_text_size(9) == 12 and geo.least_text_size(14) == 14
    assert geo.least_text_size(["interpolate", ["linear"], ["zoom"], 5, 8, 9, 16]) == ["interpolate", ["linear"], ["zoom"], 5, 12, 9, 16]
    assert geo.least_text_size(["step", ["zoom"], 8, 6, ["get", "s"]]) == ["step", ["zoom"], 12, 6, ["max", 12, ["get", "s"]]]


def test_archived_policies_prove_their_record_capture_and_form(spark):
    from terrafold.operators import reviews

    art = "2026学年 " + "正文" * 60
    record = dict(id="p:1", bundle="b", source_id="p:1", creates_official_admission_relation=False, source_bundle_path="data/incremental/x/", sealed_matches=1, district="甲", url="https://a.gov.cn/n/1", this_run_network_fetch=False,
                  tls_note="none", source_year="2026", publication_date="2026-03-01", title="t", absolute_path=None, preserved_copy="data/incremental/x/c.body", copy_sha256="h", want_sha256="h", article=art)
    page = dict(record, path="x/o.body", tls_verified=False, page_text=art.replace(" ", "\n"), page_title="t", page_date="20260301", metadata_matches=1, metadata_tls=False, snapshot_run_at="r", metadata_run_at="r", response_date="d", metadata_date="d", headers_sha256="k", want_headers_sha256="k")
    visible = f"2026-03-01 {art}"
    text = dict(record, id="p:2", source_id="p:2", path="x/o.json", tls_verified=None, visible=visible, exact_observed_at="o", json_title="t", json_url=record["url"], json_text=visible, json_observed_at="o")
    flags = {"creates_official_admission_relation", "this_run_network_fetch", "tls_verified", "metadata_tls"}
    names = [*{**page, **text}]
    schema = ", ".join(f"{n} {'boolean' if n in flags else 'int' if n.endswith('_matches') else 'string'}" for n in names)
    judge = lambda *rows: {r.id: set(r.failed) for r in reviews.archive_requirements(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema), {"甲": "a.gov.cn"}).collect()}
    assert judge(page, text) == {"p:1": set(), "p:2": set()}
    wrong = {
        "creates_admissions": dict(creates_official_admission_relation=None), "identity": dict(id="P 1", source_id="P 1"), "source_identity": dict(source_id="p:9"), "bundle_outside_tree": dict(source_bundle_path="data/incremental/../x/", preserved_copy="data/incremental/../x/c"),
        "not_as_sealed": dict(sealed_matches=2), "url_not_canonical": dict(url="https://a.gov.cn/n/1#z"), "url_of_another_authority": dict(url="https://b.gov.cn/n/1"), "claims_a_fetch": dict(this_run_network_fetch=True), "claims_verified_tls": dict(tls_verified=True), "tls_note_missing": dict(tls_note=" "),
        "publication_of_another_year": dict(publication_date="2025-03-01", page_date="20250301"), "paths_conflict": dict(absolute_path="/else/o.html"), "copy_outside_bundle": dict(preserved_copy="data/other/c.body"), "copy_differs": dict(copy_sha256="z"), "form": dict(path="x/o.pdf"), "page_is_not_the_article": dict(page_text="z"),
        "page_title": dict(page_title="z"), "page_date": dict(page_date=None), "metadata_ambiguous": dict(metadata_matches=0), "page_tls": dict(metadata_tls=True), "server_time_as_client_time": dict(exact_observed_at="o"), "capture_run": dict(metadata_run_at="z"), "response_date": dict(metadata_date="z"), "headers": dict(headers_sha256=None),
    }
    for k, (name, change) in enumerate(wrong.items()):
        wrong[name] = dict(page, id=f"q:{k}", source_id=f"q:{k}") | change
    got = judge(*wrong.values())
    assert all(name in got[row["id"]] for name, row in wrong.items())
    twice = judge(page, dict(page), dict(text, json_text="z", json_title="z", json_url="z", json_observed_at=None, tls_verified=False, publication_date="2026-04-01", source_year="2026"))
    assert twice["p:1"] == {"repeated_identity"} and twice["p:2"] >= {"text_tls", "text_title", "text_url", "text_differs", "text_observation", "text_without_date"}
    assert judge(dict(page, district="乙"))["p:1"] == {"unknown_district", "url_of_another_authority"} and "school_year_not_named" in judge(dict(page, article="x", page_text="x"))["p:1"]
    assert "year" in judge(dict(page, source_year="26"))["p:1"] and "path_missing" in judge(dict(page, path=None))["p:1"] and "publication_date" in judge(dict(page, publication_date="2026-3-1"))["p:1"]


def test_crosswalk_is_strict(spark):
    records = spark.createDataFrame([("o1", "2026", "s1"), ("o1", "2025", "s0")], "official_id string, year string, entity_id string")
    places = spark.createDataFrame([("c1",), ("s1",)], "id string")
    link = lambda *rows: spark.createDataFrame(list(rows), "campus_id string, official_id string, year string")
    assert [r.entity_id for r in resolve.crosswalk(link(("c1", "o1", "2026")), records, places).collect()] == ["s1"]
    for bad in (("c2", "o1", "2026"), ("c1", "o1", "2024"), ("c1", "o2", "2026"), (None, "o1", "2026"), ("c1", None, "2026")):
        with pytest.raises(Exception, match="target is missing"):
            resolve.crosswalk(link(("c1", "o1", "2026"), bad), records, places).collect()
    assert resolve.crosswalk(link(), records, places).count() == 0


def test_project_merges(spark):
    projects = spark.createDataFrame([("p1", "s1", "local:a"), ("p2", "s2", "osm:1"), ("p3", "s3", "local:b")], "id string, source_id string, entity_id string")
    places = spark.createDataFrame([("osm:1", "X"), ("local:a", "X"), ("local:b", "Y")], "id string, district string")
    claim = lambda *rows: spark.createDataFrame(list(rows), "evidence_id string, entity_id string, target_entity_id string, district string, merge_ids array<string>")
    moves = lambda *rows: resolve.project_merges(claim(*rows), projects, places).collect()
    assert [tuple(r) for r in moves(("e", "osm:1", "osm:1", "X", ["p1", "p2"]), ("f", "osm:1", None, "X", None))] == [("p1", "s1", "local:a", "osm:1", "e")]
    assert moves(("e", "osm:1", "osm:1", "X", [])) == [] and moves() == []
    for bad in (("e", "osm:1", "osm:2", "X", ["p1"]), ("e", "local:a", "local:a", "X", ["p1"]), ("e", "osm:1", None, "X", ["p1"]), ("e", "osm:1", "osm:2", "X", [])):
        with pytest.raises(Exception, match="did not resolve"):
            moves(bad)
    for bad in (["p3"], ["p9"]):
        with pytest.raises(Exception, match="missing or in another district"):
            moves(("e", "osm:1", "osm:1", "X", bad))


def test_sources_of_records(spark):
    schema = "id string, label string, kind string, detail_observed_at string, observed_at string, event_date string, source_url string"
    rows = [("a", "A", "k", None, "2026-01-02", "20260101", "https://u:p@x.test/a"), ("b", "B", "k", "2026-01-03", "2026-01-02", "soon", "https://x.test/b?c=1#d"), ("b", "B", "k", "2026-01-04", None, None, None)]
    got = {r.id: (r.observed_at, str(r.source_as_of), r.url) for r in importers.source_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("2026-01-02", "2026-01-01", ""), "b": ("2026-01-03", "None", "https://x.test/b")}


def test_history_falls_back_to_the_catalogue(spark):
    places = spark.createDataFrame([("osm:1", "residential", "甲 苑", "X", 30.0, [])], "id string, kind string, name string, district string, lat double, aliases array<string>")
    candidates = spark.createDataFrame([("乙", "old", 0), ("乙", "new", 1)], "name string, entity_id string, ord int")
    rows = spark.createDataFrame([("d", "乙·", None), ("d", "丙", "甲苑"), ("d", "丁", None), ("e", "丁", None)], "source string, name string, matched_name string")
    got = {(r.source, r.name): r.entity_id for r in resolve.history_places(rows, candidates, places).collect()}
    assert got[("d", "乙·")] == "new" and got[("d", "丙")] == "osm:1"
    assert got[("d", "丁")] == got[("e", "丁")] and got[("d", "丁")].startswith("local:residential:")


def test_failed_checks_publish_nothing(spark, tmp_path):
    root, good = f"file://{tmp_path}", spark.range(3)
    first = publish.publish({"t": good}, root, {"none": good.limit(0)})
    with pytest.raises(ValueError, match="rows"):
        publish.publish({"t": good.limit(1)}, root, {"rows": good})
    assert publish.current(spark, root) == first and publish.table(spark, root, "t").count() == 3


def test_articles_where_workers_lack_the_package(tmp_path):
    code = (
        "import sys; from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); "
        f"sys.path.insert(0, {ROOT!r}); from terrafold.functions import article, text; "
        "r = s.createDataFrame([('<p class=article-content>ａ b</p>',)], 'h string').select(article.article('h').text.alias('t')); "
        "assert r.select(text.nfkc('t').alias('t')).head().t == 'a b'"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-2000:]


def plain_article(events, marker="article-content"):
    """The article's text by looking at all earlier events again for each event: what is open then, and whether it speaks."""

    def open_after(n):
        names, begun, done = [], False, False
        for kind, value, attrs in events[:n]:
            if kind == "open" and not begun and marker in attrs.get("class", "").split():
                names, begun = [value], True
            elif kind == "open" and names and value not in article.VOID:
                names = [*names, value]
            elif kind == "close" and value in names:
                names = names[: max(k for k, x in enumerate(names) if x == value)]
                done = done or not names
            if done:
                return None
        return names

    said = []
    for k, (kind, value, _) in enumerate(events):
        names = open_after(k)
        if names is None:
            break
        if not names or set(names) & article.SILENT:
            continue
        if kind == "text":
            said.append(value)
        elif value in article.BREAKS and (kind == "open" or value in names):
            said.append("\n")
        elif kind == "open" and value in article.CELLS:
            said.append("\t")
    lines = (re.sub("[\t \u00a0]+", " ", x).strip() for x in "".join(said).splitlines())
    return "\n".join(x for x in lines if x)


def test_misnested_articles():
    of = lambda html: article.article_text(html)["text"]
    assert of('<div class="article-content"><p><object>x</p><p>kept</p></div>') == "kept"
    assert of('<div class="article-content"><section><div>a</section>b</div>tail</div>') == "a\nb"
    assert of('<div class="article-content">' + "<div>" * 30_000 + "deep</b></i>" + "</div>" * 30_001 + "out") == "deep"
    rng = random.Random(12)
    names = ["div", "p", "section", "span", "object", "script", "br", "td", "b", "iframe", "li"]
    for k in range(1500):
        html = ["<i>before</i>"]
        for n in range(rng.randint(1, 25)):
            name = rng.choice(names)
            mark = ' class="x article-content"' if rng.random() < 0.15 else ""
            html.append(rng.choice([f"<{name}{mark}>", f"<{name}{mark}>", f"</{name}>", f"</{name}>", f"<{name}/>", f"t{n} \u00a0", f"</{rng.choice(names)}>", "&amp;<!-- c -->"]))
        html = "".join(html)
        assert of(html) == plain_article(article._Events(html).found), html
