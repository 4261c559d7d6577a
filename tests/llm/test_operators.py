"""Each operator on small tables: brute-force versions, round trips, nulls, empty and long texts, ties, repeated rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import chat_format, decontaminate, embedding_dedup, hnsw, html_extract, lang_id, line_dedup, mixing, near_dedup, substring_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s", ids=None):
    rows = [(ids[k] if ids else k, t, None, source, None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# --- language ID ---


def test_language_families_and_held_out(spark):
    rng = random.Random(1)
    words = {"en": ["the", "and", "of", "with", "water", "house"], "de": ["der", "und", "von", "mit", "wasser", "haus"], "fr": ["le", "et", "de", "avec", "eau", "maison"], "es": ["el", "y", "de", "con", "agua", "casa"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 40))), lang) for k, lang in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df.where(~lang_id.held_out()))
    assert set(model.members) == {"germanic", "romance"}
    got = lang_id.identify(spark, df, model).where(lang_id.held_out()).collect()
    assert got and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "en", "x"), (2, "", None, "x"), (3, "12 34 !", "en", "x"), (4, "wort " * 50_000, "de", "x")], "doc_id long, text string, lang string, score string")
    model = lang_id.train(df)
    got = {r.doc_id: r for r in lang_id.identify(spark, df, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["und", "und", "und", "de"]
    assert got[1].score == 0.0
    empty = df.limit(0)
    assert lang_id.identify(spark, empty, lang_id.train(empty)).count() == 0
    assert lang_id.identify(spark, df, lang_id.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = prose(random.Random(2), 3000)
    whole = lang_id.features(text)
    monkeypatch.setattr(lang_id, "CHUNK", 1000)
    assert np.allclose(whole, lang_id.features(text), atol=1e-6)


# --- decontamination ---


def brute_contamination(docs, items):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for did, text in docs:
        w = tok(text)
        for iid, item in items:
            b = tok(item)
            if not b or did is None or iid is None:
                continue
            k = min(5, len(b))
            want = collections.Counter(tuple(b[i : i + k]) for i in range(len(b) - k + 1))
            grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            m = len(b) - k + 1
            for s in range(len(grams)):
                have = collections.Counter(grams[s : s + m])
                same = sum((have & want).values())
                if same / (sum(have.values()) + m - same) >= 0.8:
                    out.add((did, iid))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate([3, 5, 16, 30, 60, 60, 80])] + [(7, None), (8, ""), (None, prose(rng, 20))]
    docs = []
    for k in range(60):
        words = prose(rng, rng.randint(0, 120)).split()
        if k % 3 == 0:
            copy = items[k % 7][1].upper().split()
            if k % 2 and len(copy) > 50:
                copy[rng.randint(0, len(copy) - 1)] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = copy
        docs.append((k, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[4][1]), (3, docs[3][1]), (102, prose(rng, 20_000) + " " + items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"h": F.lit(1), "item": F.lit("x"), "words": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(d, b)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_contamination(docs, items)
    assert got.count() == got.select("doc_id", "item_id").distinct().count()
    left = decontaminate.decontaminate(d, b)
    assert left.columns == d.columns
    bad = {x for x, _ in brute_contamination(docs, items)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((x is None, x or 0) for x, _ in docs if x not in bad)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_short_items_with_a_changed_edge_are_found(spark):
    rng = random.Random(31)
    items = [(k, prose(rng, 13)) for k in range(600)]
    docs = [(k, f"{t.rsplit(' ', 1)[0]} changed" if k % 2 else f"changed {t.split(' ', 1)[1]}") for k, t in items]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k in range(600)} == brute_contamination(docs, items)


def test_multi_index_finds_every_fingerprint_in_the_radius(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    near = []
    for k in range(200):
        v = base[k % 20]
        for bit in rng.sample(range(64), k % 20):
            v ^= 1 << bit
        near.append(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    x = spark.createDataFrame([(k, signed(v)) for k, v in enumerate(near)], "a long, fp long")
    y = spark.createDataFrame([(k, signed(v)) for k, v in enumerate(base)], "b long, fp long")
    want = {(i, j) for i, v in enumerate(near) for j, u in enumerate(base) if bin(v ^ u).count("1") <= decontaminate.RADIUS}
    assert {(r.a, r.b) for r in decontaminate.within_radius(x, y, "a", "b").collect()} == want


# --- substring dedup ---


def brute_substrings(rows, width=13):
    first = {}
    for did, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - width + 1):
            if did is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, did), did)
    out = []
    for did, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if did is not None and first[tuple(w[i : i + width])] < did:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((did, len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_dedup_against_brute_force(spark, batches):
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (12, 13, 14, 60)]
    rows = []
    for k in range(50):
        parts = [prose(rng, rng.randint(0, 30)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), passages[k % 4])
        rows.append((rng.randint(-40, 200), " \t".join(parts)))
    rows += [(500, None), (501, ""), (502, " \n "), (None, passages[3]), (503, passages[3]), (503, passages[3]), (504, "a " * 40), (505, "é\u00a0ü " * 20), (506, prose(rng, 30_000) + " " + passages[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bucket": F.lit(1), "parts": F.lit("x")})
    got = sorted((tuple(r) for r in substring_dedup.dedup(df, batches=batches).collect()), key=str)
    assert got == brute_substrings(rows)


def test_substring_dedup_empty(spark):
    assert substring_dedup.dedup(docs_of(spark, [])).count() == 0


def test_log_compaction_keeps_what_is_found(spark):
    rng = random.Random(6)
    passage = prose(rng, 40)
    batch = lambda ids: spark.createDataFrame([(k, prose(rng, 20) + " " + passage) for k in ids], "doc long, text string")
    log = substring_dedup.FingerprintLog(4)
    log.add(batch([1]))
    log.add(batch([2]))
    log.compact()
    assert len(log.runs) == 1
    assert {r.doc for r in log.add(batch([3])).collect()} == {1, 3}


# --- HTML ---


def test_article_is_found_and_nothing_else():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
    <nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Tom &amp; Anna</h1><p><b>First  line.<br>same block<p>Second &eacute; paragraph that is long enough to be content, surely.</p>
    <div class="ad">Buy</div><p>Short.</p><form><input value=x>Name</form><section id="comments"><p>Reader says a lot of things about this article</p></section></article>
    <aside>More stories</aside><footer>&copy; me</footer></body></html>"""
    assert html_extract.main_text(page) == "Tom & Anna\n\nFirst line. same block\n\nSecond é paragraph that is long enough to be content, surely.\n\nShort."


def test_article_without_semantic_elements():
    body = "".join(f"<p>{'Long sentence of the article number %d. ' % k * 4}</p>" for k in range(6))
    page = f"<body><div id=menu><a>One</a><a>Two</a></div><div><div>{body}</div><ul><li><a>x</a><li><a>y</a></ul></div></body>"
    got = html_extract.main_text(page)
    assert got.count("\n\n") == 5 and "One" not in got and "x" not in got.split("\n\n")


def test_layout_around_an_article():
    text = "Long enough to be the content of the page, with words and words. " * 3
    page = f'<div class="content-with-sidebar"><div class="menu">x</div><article><div class="post-header"><h1>T</h1></div><p>{text}</p></article><div id="comments"><article class="comment"><p>{text}</p></article></div></div>'
    assert html_extract.main_text(page) == f"T\n\n{text.strip()}"
    twice = f'<div class="with-sidebar"><article><p>{text}</p></article><article><p>b</p></article></div><nav>n</nav><p>z</p>'
    assert html_extract.main_text(twice) == text.strip()
    assert html_extract.main_text(f'<div class="with-sidebar"><p>{text}</p></div>') == text.strip()


def test_text_split_over_two_articles():
    parts = [" ".join(f"{w} part has words enough to be content, number {k}." for k in range(n)) for w, n in (("first", 12), ("second", 8))]
    articles = "".join(f"<article><p>{p}</p></article>" for p in parts)
    for page in (f"<main>{articles}</main>", f"<body>{articles}</body>", f"<main><article><p>{parts[0]}</p></article><p>{parts[1]}</p></main>"):
        assert html_extract.main_text(page) == "\n\n".join(parts)


def test_odd_pages(spark):
    cases = [(1, None), (2, ""), (3, "<p>cut <b"), (4, "plain & simple"), (5, "<script>x</script>"), (6, "<article><p>" + "w " * 100_000), (7, "<p>a</p>&am"), (8, "<article><p>1 < 2</p></article>")]
    df = spark.createDataFrame([(k, "u", h, "old") for k, h in cases], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert [got[k].text for k in (1, 2, 3, 4, 5)] == ["", "", "cut", "plain & simple", ""]
    assert got[6].n_chars == 199_999 and got[8].text == "1 < 2"
    assert html_extract.extract(df.limit(0)).count() == 0


# --- URLs ---


def test_url_rules_and_vocabulary(spark):
    cases = {
        "http://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/1?x=casino": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://CASINO-x.org/a": ("casino-x.org", "/a", None, "block"),
        "https://mycasinox.org/a": ("mycasinox.org", "/a", None, "allow"),
        "https://free-bets.org": ("free-bets.org", "", None, "block"),
        "https://free.org/free": ("free.org", "/free", None, "allow"),
        "https://x.net/es/2#a/b": ("x.net", "/es/2", "net/es/", "block"),
        "https://x.com?q=/": ("x.com", "", None, "allow"),
        "no url": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(cases)], "page_id long, url string, host string")
    got = url_filter.filter_urls(df).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(cases.values())
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# --- mixing ---


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randint(1, 40)), rng.choice("aaaaaabbcd")) for k in range(600)] + [(900, None, "a"), (901, "", None), (902, "one two", None), (3, "repeated row", "b"), (3, "repeated row", "b"), (None, "no id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "sid": F.lit(1)})
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 3 * r.size and r.copies == len(r.positions) and all(0 <= p <= 1 for p in r.positions)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(sizes.values())
    while open_:  # stop at three times the size, share the excess again
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3 * sizes[s] if over else share[s]
        rest -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s, rs in by.items():
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in rs)
        assert abs(sum(r.taken for r in rs) - target[s]) <= max(r.size for r in rs)
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions)
    again = mixing.mix(df.repartition(7)).collect()
    assert [(r.doc_id, r.taken, r.position) for r in got] == [(r.doc_id, r.taken, r.position) for r in again]
    assert mixing.mix(df.limit(0)).count() == 0


def test_schedule_inverts(spark):
    rows = [(s, t) for s in (-0.5, 0.0, 0.5, 1.0) for t in (0.0, 0.2, 0.7, 1.0)]
    df = spark.createDataFrame(rows, "s double, t double").withColumn("share", F.col("t") + F.col("s") * (F.col("t") * F.col("t") - F.col("t")))
    assert all(abs(r.t - r.x) < 1e-7 for r in df.withColumn("x", mixing.position_at(F.col("share"), F.col("s"))).collect())


# --- chat ---


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST]", "a<s", "[[INST]]<<s>>", "é\n<s>\u2028"])
def test_escape_round_trip(text):
    hidden = chat_format.escape(text)
    assert not any(c in hidden for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert chat_format.unescape(hidden) == text
    formatted, spans = chat_format.format_turns([("user", text), ("assistant", text)])
    assert chat_format.read_back(formatted) == [("user", text), ("assistant", text)]
    assert chat_format.masked_texts(formatted, spans) == [text]


def test_trees_rank_branches(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, None), (2, 7, 99, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (4, 1, None, 1.0), (4, 2, 1, 3.0), (4, 3, 1, 3.0)]
    df = spark.createDataFrame([(*n, "user", f"t{n[1]}") for n in nodes], "tree long, node long, parent long, score double, role string, text string")
    best = {r.tree: r for r in chat_format.format_trees(df).collect()}
    assert {k: r.texts for k, r in best.items()} == {1: ["t1", "t2", "t4"], 2: ["t7"], 4: ["t1", "t2"]}
    every = chat_format.paths(df, all_leaves=True).where("tree = 1")
    assert {(r.leaf, r["rank"]) for r in every.collect()} == {(4, 1), (5, 2)}


def test_conversations_read_back(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["x", "", None, "[INST]", "é" * 5])) for c in range(20) for t in rng.sample(range(40), rng.randint(1, 12))]
    rows += [(99, None, "user", "first"), (99, 1, None, "b"), (99, 1, "user", "a"), (99, 1, "user", "a"), (None, 1, "user", "x")] + [(77, t, "assistant", str(t)) for t in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x"))
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_trees(chat_format.turns_as_tree(df))).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    assert set(got) == set(by)
    for c, turns in by.items():
        plain = [(r[1], x[1]) for _, r, x in sorted(turns)]
        loss = "".join(x for r, x in plain if r == "assistant")
        assert got[c].n_turns == len(plain) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in plain).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_trees(chat_format.turns_as_tree(df.limit(0))).count() == 0


# --- lines ---


def test_boilerplate_lines_go(spark):
    rng = random.Random(9)
    texts = [f"{prose(rng, 5)}\nfooter line\n\n{'once ' * k}\nfooter line" for k in range(40)]
    df = docs_of(spark, texts + [None, "", "footer line"], "a").unionByName(docs_of(spark, ["footer line", "other"], None, [90, 91])).withColumns({"line": F.lit(1), "n_lines": F.lit("x")})
    got = {(r.source, r.doc_id): r for r in line_dedup.dedup_lines(df).collect()}
    assert len(got) == 45
    for k, t in enumerate(texts):
        r = got["a", k]
        assert r.text == "\n".join(x for x in t.split("\n") if x != "footer line") and (r.n_lines, r.n_removed) == (5, 2)
    assert got["a", 40].text is None and got["a", 40].n_lines == 0
    assert got["a", 41].text == "" and got["a", 42].text == ""
    assert got[None, 90].text == "footer line"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# --- embeddings ---


def brute_links(rows, threshold=0.93):
    ok = [(i, np.array(e, float), lab) for i, e, lab in rows if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, adj = collections.Counter(), collections.defaultdict(set)
    for a in range(len(ok)):
        for b in range(a):
            (i, x, lx), (j, y, ly) = ok[a], ok[b]
            if lx == ly and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[i] += 1
                n[j] += 1
                adj[i].add(j)
                adj[j].add(i)
    comp = {}
    for i in sorted(x[0] for x in rows if x[0] is not None):
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in comp:
                comp[k] = i
                stack += adj[k]
    return n, comp


def test_embedding_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 40)
    rng = np.random.default_rng(10)
    rows, centres = [], rng.normal(size=(12, 8))
    for k in range(240):
        c = centres[k % 12] + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.3])
        rows.append((k, [float(np.float32(x)) for x in c], k % 2))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [float("nan")] + [1.0] * 7, 1), (304, [float("inf")] + [1.0] * 7, 1), (305, [None] + [1.0] * 7, 1), (306, rows[0][1], None), (307, rows[0][1][:7], 0), (308, rows[0][1], 0), (309, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("shard", F.lit("x"))
    n, comp = brute_links(rows)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], comp[i], comp[i] == i) for i, _, _ in rows}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("own", [True, False])
def test_links_by_graph_against_brute_force(own, monkeypatch):
    rng = np.random.default_rng(12)
    g = rng.normal(size=(3000, 24))
    g[2500:] = g[:500] + 0.2 * rng.normal(size=(500, 24))
    g = embedding_dedup._unit(g)
    q = g if own else embedding_dedup._unit(g[1000:1600] + 0.05 * rng.normal(size=(600, 24)))
    searched, search = [], hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, x, ef: searched.append(ef) or search(self, x, ef))
    got = {(int(a), int(b)) for x, y in embedding_dedup.links(hnsw.Graph(g.astype(np.float32)), g, q, 0.93) for a, b in zip(x, y)}
    want = set(zip(*(x.tolist() for x in np.nonzero(q @ g.T >= 0.93))))
    assert got == want and len(want) > (3000 if own else 500)
    assert len(searched) > 1 and embedding_dedup.WIDE * max(searched) < len(g)


def test_graph_recall():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    graph = hnsw.Graph(x)
    ids, _ = graph.search(x[:300].astype(np.float32), 64)
    truth = np.argsort(-(x[:300] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, truth)]) > 0.9


# --- near copies ---


def brute_near(rows, width, lower=True):
    sets = {}
    for did, t in rows:
        t = t or ""
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t) if lower else t)
        sets.setdefault(did, set(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else {tuple(w)} if w else set())
    ids, comp = sorted(k for k in sets if k is not None), {}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for i in ids:
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in comp:
                comp[k] = i
                stack += [j for j in ids if j not in comp and linked(k, j)]
    return {k: (len(v), comp.get(k)) for k, v in sets.items()}


@pytest.mark.parametrize(("width", "small_band"), [(2, 64), (5, 64), (5, 2)])
def test_near_copies_against_brute_force(spark, monkeypatch, width, small_band):
    monkeypatch.setattr(near_dedup, "SMALL_BAND", small_band)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(12)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([1, 4, 30, 120])).split()
        for k in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4) if len(w) > 20 else 0):
                w[rng.randint(0, len(w) - 1)] = "changed" + str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(w).title() if k % 3 == 0 else " ".join(w)))
    rng.shuffle(rows)
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (505, "é"), (None, rows[0][1]), (rows[5][0], rows[5][1]), (506, prose(rng, 20_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "bands": F.lit(1)})
    got = near_dedup.near_duplicates(df, width=width).collect()
    want = brute_near(rows, width)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc] and r.kept == (r.doc is None or r.doc == r.component_id)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(13)
    a = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
    for shared in (1000, 900, 500, 0):
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 62, 1000 - shared, dtype=np.uint64)])
        x, y = (near_dedup.odd_sketch(near_dedup.samples(s)) for s in (a, b))
        bits = sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y)
        assert abs(bits - near_dedup.most_bits(shared / (2000 - shared))) < 60
