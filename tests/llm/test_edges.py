"""Edge cases, adversarial inputs and what must hold at scale, operator by operator."""

import collections
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import chat_format, common, decontaminate, embedding_dedup, hashing, hnsw, html_extract, lang_id, line_dedup, mixing, near_dedup, queries, substring_dedup, url_filter

from .test_operators import brute_contamination, brute_near, brute_substrings, docs_of, prose

SF = "/root/testdata/sf0.01"


def complementary_words(n=10):
    """A Thue-Morse word of 2**n letters and its complement: powers modulo 2^64 do not tell them apart."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


# --- shared pieces ---


def test_small_counts_bytes(spark, monkeypatch):
    rows = spark.range(10).withColumn("text", F.repeat(F.lit("x"), 1000))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.small(rows)) and hinted(common.small(rows.limit(0)))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 5000)
    assert not hinted(common.small(rows))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 9)
    assert not hinted(common.small(rows))


def test_only_saved_tables_are_dropped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/mine")
    mine, kept = spark.read.parquet(f"{tmp_path}/mine"), common.saved(spark.range(4), "some")
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    common.drop_saved(mine.unionByName(kept))
    assert spark.read.parquet(f"{tmp_path}/mine").count() == 3
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(folder).count()


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session)


def test_word_hashes_hold_against_patterns():
    words = [w for n in range(1, 14) for w in complementary_words(n)] + ["q" * 70_000, "q" * 70_001, "p" * 70_000]
    import pyarrow as pa

    seen = [int(hashing.words(data, offsets)[3][0]) for w in words for _, data, offsets in hashing.text_chunks(pa.array([w]))]
    assert len(set(seen)) == len(words)


# --- language ID ---


def test_no_language_is_left_out_and_the_sample_is_bounded(spark, monkeypatch):
    rows = [(None, f"x{lang} y{lang} " * 5 + str(k) * (k % 2), f"l{lang:03d}") for lang in range(260) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(lang_id, "train_svm", lambda x, y: (np.zeros(x.shape[1], np.float32), 0.0))
    taught = []
    monkeypatch.setattr(lang_id, "fit", lambda x, lang: taught.append(lang) or lang_id.Model())
    lang_id.train(df, rows_in_all=260)
    lang_id.train(df.unionByName(df), rows_per_lang=10)
    assert len(set(taught[0])) == 260 and len(taught[0]) < 450  # about one row of each
    assert collections.Counter(taught[1]) == collections.Counter(r[2] for r in set(rows))  # repeated rows teach once


def test_free_text_is_no_language(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MAX_LABELS", 20)
    df = spark.createDataFrame([(k, f"words of {k}", f"label {k}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 20 labels"):
        lang_id.train(df)
    assert lang_id.train(df.limit(20)).families


def test_equal_votes_and_repeated_rows_agree(spark):
    rows = [(k, "same words here", lang) for k, lang in enumerate(["en", "de"] * 10)] + [(3, "same words here", "de")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.lang_pred, r.score) for r in lang_id.identify(spark, df, lang_id.train(df)).collect()}
    assert len(got) == 1 and got == {(r.lang_pred, r.score) for r in lang_id.identify(spark, df.repartition(5), lang_id.train(df.repartition(3))).collect()}


# --- decontamination ---


def test_contamination_in_segments_and_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 3)
    rng = random.Random(21)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 2, 4, 5, 6, 17, 17, 40])]
    docs = [(k, " ".join([prose(rng, rng.randint(0, 9)), items[k % 8][1], prose(rng, 3), items[(3 * k) % 8][1], items[7][1].rsplit(" ", 4)[0]])) for k in range(25)]
    docs += [docs[0], (0, "another text of this id " + items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "pos": F.lit(1), "similarity": F.lit(2.0), "sh": F.lit(0)})
    got = decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string").withColumn("n_windows", F.lit("y"))).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_contamination(docs, items) and len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_ties_between_items_are_all_reported(spark):
    text = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, text), (2, text), (2, text), (3, text.upper())], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame([(5, "so " + text)], "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got) == [(5, 1, 1.0), (5, 2, 1.0), (5, 3, 1.0)]


def test_index_is_selective_within_one_item_size(spark):
    rng = random.Random(22)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    side = lambda name, n: spark.createDataFrame([(k, signed(rng.getrandbits(64)), 20, 5) for k in range(n)], f"{name} long, fp long, n int, width int")
    x, y = side("a", 1500), side("b", 100)
    found = decontaminate.within_radius(x, y, "a", "b", ("n", "width"))
    prints = [{r[0]: r.fp for r in df.collect()} for df in (x, y)]
    want = {(a, b) for a, p in prints[0].items() for b, q in prints[1].items() if ((p ^ q) & (1 << 64) - 1).bit_count() <= decontaminate.RADIUS}
    # Every pair within the radius, and no other, becomes a row, of whatever size the items are.
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) < 0.005 * 1500 * 100


@pytest.mark.parametrize("m", [6, 9, 14, 20, 45, 120])
def test_index_finds_similar_windows_of_every_size(spark, m):
    rng, pairs, rows = random.Random(m), 400, {"a": [], "b": []}
    mixes = [(same, own) for own in range(m // 4 + 1) for same in range(m + 1 - own) if same >= 0.8 * (m + own) and same + own]
    for k in range(pairs):  # what a window keeps of an item, and what it has of its own: similarities from 0.8 on
        same, own = sorted(mixes, key=lambda x: x[0] / (m + x[1]))[k % min(len(mixes), 4)]
        grams = [rng.getrandbits(63) for _ in range(m)]
        rows["b"] += [(k, h) for h in grams]
        rows["a"] += [(k, h) for h in rng.sample(grams, same) + [rng.getrandbits(63) for _ in range(own)]]
    a, b = (spark.createDataFrame(r, f"{name} long, h long") for name, r in rows.items())
    got = decontaminate.within_radius(decontaminate.fingerprints(a, "a"), decontaminate.fingerprints(b, "b"), "a", "b").where("a = b").count()
    assert got >= 0.99 * pairs


def test_the_index_makes_the_result(spark, monkeypatch):
    rng = random.Random(31)
    items = [(k, prose(rng, n)) for k, n in enumerate([6, 8, 12, 30, 30, 30])]
    docs = [(k, f"{prose(rng, 5)} {items[k % 6][1]} {prose(rng, 5)}") for k in range(12)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(*frames).collect()}
    assert pairs() == brute_contamination(docs, items)
    monkeypatch.setattr(decontaminate, "within_radius", lambda x, y, a, b, on=(): x.limit(0).select(a).join(y.limit(0).select(b)))
    assert {i for _, i in pairs()} == {0, 1}  # only items of FEW shingles do without it


def test_fingerprints_count_many_shingles(spark):
    rows = spark.range(1_200_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.lit(5)).cast("long").alias("h"))
    assert [r.fp for r in decontaminate.fingerprints(rows, "k").collect()] == [5]


# --- substring dedup ---


def test_words_that_only_a_weak_hash_confuses_stay(spark):
    rng = random.Random(23)
    one, other = complementary_words()
    rest = prose(rng, 12)
    rows = [(1, f"{rest} {one}"), (2, f"{rest} {other}"), (3, f"{rest} {one}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring_dedup.dedup(df).collect()), key=str) == brute_substrings(rows)
    pair = spark.createDataFrame([(1, f"p {one} q {one}"), (2, f"p {other} q {other}")], "doc_id long, text string")
    assert {(r.doc, r.component_id) for r in near_dedup.near_duplicates(pair, width=2).collect()} == {(1, 1), (2, 2)}


def test_a_whole_table_compacts_its_runs(spark, monkeypatch):
    before, left, write, forget = [], [], substring_dedup.FingerprintLog._written, substring_dedup.FingerprintLog._forget
    monkeypatch.setattr(substring_dedup.FingerprintLog, "_written", lambda self, rows: before.append(len(self.runs)) or write(self, rows))
    monkeypatch.setattr(substring_dedup.FingerprintLog, "_forget", lambda self, spark, n: left.append(len(self.runs) - n) or forget(self, spark, n))
    rng = random.Random(24)
    passage = prose(rng, 30)
    rows = [(k, f"{prose(rng, 20)} {passage} {prose(rng, 5)}") for k in range(30)]
    got = sorted((tuple(r) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_substrings(rows)
    assert before == [0, 1, 2] and left == [1, 0]  # three runs, the third of which takes the others in


def test_old_runs_are_not_dealt_again(spark, monkeypatch):
    plans, write = [], substring_dedup.FingerprintLog._written
    monkeypatch.setattr(substring_dedup.FingerprintLog, "_written", lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, rows))
    rng = random.Random(32)
    log = substring_dedup.FingerprintLog(8)
    for k in range(3):
        log.add(spark.createDataFrame([(10 * k + j, prose(rng, 40)) for j in range(5)], "doc long, text string"))
    assert len(log.runs) == 1
    log.close(spark)
    for k, plan in enumerate(plans):  # one exchange, of the batch; each older run is read in its buckets
        assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == k, plan


def test_a_log_in_a_folder_serves_later_batches(spark, tmp_path):
    rng = random.Random(25)
    passage = prose(rng, 40)
    batch = lambda ids, tail=passage: spark.createDataFrame([(k, prose(rng, 20) + " " + tail) for k in ids], "doc long, text string")
    log = substring_dedup.FingerprintLog(4, folder=str(tmp_path))
    log.add(batch([1, 2]))
    log.add(batch([3], prose(rng, 20)))
    for ids, runs in (([4], 1), ([5], 2), ([6], 1)):  # a new session opens the log each time; every third batch compacts
        log = substring_dedup.FingerprintLog.open(spark, str(tmp_path))
        assert {r.doc for r in log.add(batch(ids)).collect()} >= {1, *ids}
        assert len(substring_dedup.FingerprintLog.open(spark, str(tmp_path)).runs) == runs


# --- HTML ---


def article_page(rng):
    """A page of one of many layouts, and its article's text."""
    sentence = lambda n: " ".join(rng.choice("water house old bridge river stone winter garden letter morning".split()) for _ in range(n)).capitalize() + "."
    blocks = [sentence(5)] + [" ".join(sentence(rng.randint(8, 16)) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 9))] + [sentence(3)]
    ad = lambda: f'<div class="{rng.choice(["ad", "ad-slot-top", "sponsored-content", "adsBox", "newsletter-signup", "cookie-notice", "promo", "related-posts", "social-links"])}">{sentence(rng.randint(4, 20))}</div>'
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p{rng.choice(['', ' class=lead', ' class=notice-period', ' class=intro'])}>{b}</p>" + (ad() if rng.random() < 0.2 else "") for b in blocks[1:])
    wrap = rng.choice(["<article>{}</article>", '<article class="post comments-open has-sidebar">{}</article>', "<main><div>{}</div></main>", '<div class="content no-sidebar">{}</div>', '<div class="story share-enabled">{}</div>', '<form id="page"><div id="text">{}</div></form>', "<div><div><div>{}</div></div></div>"])
    comments = rng.choice(["", '<div id="comments"><p>{0}</p><p>{0}</p></div>', '<section class="comment-list"><div>{0}</div></section>', "<section><h2>3 Comments</h2><p>{0}</p></section>", '<ul class="reader-comments"><li>{0}</ul>']).format(sentence(12))
    menu = "".join(f"<li><a href=/{k}>{sentence(1)}</a></li>" for k in range(rng.randint(3, 9)))
    menu = rng.choice(["<nav><ul>{}</ul></nav>", '<div class="main-menu"><ul>{}</ul></div>', '<ul id="x">{}</ul>']).format(menu)
    page = f"<html><head><title>{sentence(4)}</title><style>p{{}}</style></head><body class='with-sidebar'><header><p>{sentence(4)}</p></header>{menu}{ad()}{wrap.format(body)}{comments}<aside>{sentence(9)}</aside><footer>{sentence(6)}</footer><script>x='<p>'</script></body></html>"
    return page, "\n\n".join(blocks)


def named_page(rng):
    """Like article_page, with names and comments that no list of the operator was made from."""
    page, text = article_page(rng)
    say = lambda n: " ".join(rng.choice("water house old bridge river stone winter garden letter morning".split()) for _ in range(n)) + "."
    menu = "<div class='x1'><ul>" + "".join(f"<li><a href=/{k}>{say(1)}</a></li>" for k in range(5)) + "</ul></div>"
    talk = "".join(f"<div class='u{k}'><span>{say(2)}</span><time>May {k}</time><p>{say(9)}</p><a href=#r>{rng.choice(['Reply', 'Antworten', 'Responder'])}</a></div>" for k in range(rng.randint(2, 5)))
    blocks = "".join(f"<p class='{rng.choice(['lede', 'k7', 'share-price', 'job-search', 'notice-of-death'])}'>{b}</p>" for b in text.split("\n\n"))
    wrap = rng.choice(["<main>{}</main>", "<article class=a9>{}</article>", "<main><article>{}</article></main>"])
    parts = [f"<div hidden><p>{say(30)}</p></div>", menu, wrap.format(blocks + rng.choice(["", f"<div>{talk}</div>"])), f"<div class=z2>{talk}</div>", f"<footer>{say(8)}</footer>"]
    return f"<html><body><div id=q>{say(rng.randint(5, 25))}<a>OK</a></div>{''.join(parts)}</body></html>", text


def test_articles_with_unknown_names():
    rng = random.Random(27)
    for _ in range(400):
        page, text = named_page(rng)
        assert html_extract.main_text(page) == text, page


def test_articles_of_many_layouts():
    rng = random.Random(26)
    words = lambda t: collections.Counter(t.split())
    exact, found, wanted, right = 0, 0, 0, 0
    for _ in range(400):
        page, text = article_page(rng)
        got = html_extract.main_text(page)
        exact += got == text
        found, wanted, right = found + sum(words(got).values()), wanted + sum(words(text).values()), right + sum((words(got) & words(text)).values())
    assert right / found > 0.99 and right / wanted > 0.99 and exact >= 380


@pytest.mark.parametrize("part", ["<div>x", "<div class=menu>x", "<span>", "<li>x", "<table><tr><td>x", "<b><p>x</p>", "<article>x", "<!--", "<a<", "<h2>Comments</h2><div>", "&lt;", '<a b="'])
def test_hostile_pages_take_linear_time(part):
    began = time.perf_counter()
    html_extract.main_text(part * 100_000)
    assert time.perf_counter() - began < 20


def test_names_that_do_not_mark_boilerplate():
    text = "Long enough to be the content of the page, with words and words. " * 3
    for page in (
        f'<article class="post comments-open"><p>{text}</p></article><p>Copyright</p>',
        f'<div class="content no-sidebar"><p>{text}</p></div><div>Copyright</div>',
        f'<article><div class="content share-enabled"><p>{text}</p></div></article>',
        f'<article><div class="widget"><p>{text}</p></div></article>',
        f"<script>a='<!--'</script><article><p>{text}</p></article><!-- cut",
    ):
        assert html_extract.main_text(page) == text.strip()
    assert html_extract.main_text(f'<article><p>{text}</p><p class="notice-period">One.</p><p class="social">Two.</p></article>') == f"{text.strip()}\n\nOne.\n\nTwo."


def test_pages_that_were_read_wrongly():
    text = "Long enough to be the content of the page, with words and words. " * 3
    of, whole = html_extract.main_text, text.strip()
    assert of(f"<div>We use cookies and others do too, as you know well. <a>Accept</a></div><main><p>{whole[:180]}</p></main>") == whole[:180].strip()
    assert of(f'<article><p>{text}</p><div class="market-share"><p>{text}</p></div></article>') == f"{whole}\n\n{whole}"
    for name in ("newsletter-signup-v2", "popular-now", "share-buttons", "social-share", "discussion"):
        assert of(f'<article><p>{text}</p><div class="{name}"><p>Some words of it.</p></div></article>') == whole, name
    for head in ("Articles", "Posts", "Stories", "Artikel"):
        assert of(f"<article><p>{text}</p><section><h2>{head}</h2><p>{text}</p></section></article>") == f"{whole}\n\n{head}\n\n{whole}"
        assert of(f"<div><div><p>{text}</p></div><section><h2>{head}</h2><p>One other.</p></section></div>") == whole
    assert of(f"<article><p>{text}</p><div><h3>Meinungen der Leser</h3><p>Ganz falsch.</p></div></article>") == whole
    comment = "<div><b>{}</b> <i>3 May</i><p>I do not think so at all, {}.</p><a href=#>{}</a></div>"
    for word in ("Reply", "Antworten", "Répondre", "Responder"):
        listed = "".join(comment.format(x, x, word) for x in ("Ann", "Bob", "Cem"))
        assert of(f"<article><p>{text}</p><div>{listed}</div></article>") == whole
    assert of(f"<article><p>{text}</p><p hidden>no</p><div style='color:red; display : none'><p>{text}</p></div></article>") == whole
    assert of("<article><p>One <button>Buy</button>line <script>x</script>of text.</p></article>") == "One line of text."
    assert of(f"<article><p>{text}</p><p><a href=#>Reply</a> is a word.</p></article>") == f"{whole}\n\nReply is a word."


def test_page_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "<p>abc</p>", "old", "x"), (1, "<p>abc</p>", None, "x")], "page_id long, text string, n_chars string, __x string")
    got = html_extract.extract(df, html="text").collect()
    assert [(r.text, r.n_chars) for r in got] == [("abc", 3), ("abc", 3)]


# --- URLs ---


def test_the_whole_url_is_judged_by_weight(spark):
    cases = {
        "http://x.example.org/go?to=casino": "block",
        "casino.example.org/porn": "block",
        "http://x.org/a#viagra": "block",
        "http://x.org/%63%20casino%2F": "block",
        "http://x.org/%63asino": "block",
        "http://x.org/c%61sin%6F%2Fx": "block",
        "http://x.org/%2563asino": "allow",
        "http://x.org/casino%C3%A9": "block",
        "http://x.de/sportwetten/gratis": "block",
        "http://x.es/apuestas/dinero": "block",
        "http://x.fr/gratuit/cadeau": "allow",
        "http://x.org/free-bet": "block",
        "http://x.org/pills/poker": "block",
        "http://x.org/poker/pokers": "allow",
        "http://x.org/free/win": "allow",
        "http://x.org/free/win/cheap": "block",
        "http://essex.org/button-classics/casinova": "allow",
        "http://x.org/" + "a" * 500_000 + "/casinos": "block",
        "http://CASINO.com/": "allow",
        "": "allow",
        None: "allow",
    }
    rows = [(k, u, v) for k, (u, v) in enumerate(cases.items())]
    df = spark.createDataFrame(rows + rows, "page_id long, url string, verdict string")
    want = {k: v for k, _, v in rows}
    got = url_filter.filter_urls(df).collect()
    assert len(got) == 2 * len(rows) and all(r.verdict == want[r.page_id] for r in got)


def test_a_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("Foo", 100), ("bar", 30), ("bar", 60), ("baz", 60), (None, 9), ("", 9), ("qux", None)], "term string, weight int")
    words = url_filter.vocabulary_of(table)
    assert words == {"foo": 100, "bar": 60, "baz": 60}
    df = spark.createDataFrame([("http://x/FOO",), ("http://x/bar",), ("http://x/bar/baz",), ("http://x/casino",)], "url string")
    assert [r.verdict for r in url_filter.filter_urls(df, vocabulary=words).collect()] == ["block", "allow", "block", "allow"]
    assert {r.verdict for r in url_filter.filter_urls(df, vocabulary={}).collect()} == {"allow"}


# --- mixing ---


def test_every_copy_has_its_place_in_the_training_order(spark):
    rng = random.Random(27)
    rows = [(k, prose(rng, rng.randint(5, 40)), rng.choice("aaaaaaabbcd")) for k in range(900)] + [(None, "no id", "a"), (3, "again", "b"), (3, "again", "b"), (901, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("x"))
    whole = mixing.mix(df).collect()
    got = mixing.mix(df, by_copy=True).collect()
    taken = [r for r in got if r.position is not None]
    assert [r.position for r in taken] == sorted(r.position for r in taken) and got[: len(taken)] == taken
    assert collections.Counter((r.doc_id, r.position) for r in taken) == collections.Counter((r.doc_id, p) for r in whole for p in r.positions)
    assert len(got) == sum(max(1, r.copies) for r in whole)
    total, before = sum(r.size for r in taken), 0
    for r in taken:  # a position is the share of all words before it
        assert abs(before / total - r.position) < 0.03
        before += r.size
    early = collections.Counter(r.source for r in taken[: len(taken) // 3])
    late = collections.Counter(r.source for r in taken[-(len(taken) // 3) :])
    assert early["a"] < late["a"] and early["c"] > late["c"]  # slopes of 0.5 and -0.5


# --- chat ---


def test_trees_with_repeated_rows_and_cycles(spark):
    rows = [(1, 1, None, 1.0, "user", None), (1, 2, 1, float("nan"), "assistant", "x" * 100_000), (2, 1, 2, 1.0, "user", "a"), (2, 2, 1, 1.0, "user", "b"), (None, 1, None, 1.0, "user", "z")]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string").withColumn("leaf", F.lit("x"))
    got = chat_format.format_trees(df).collect()
    assert [(r.tree, r.texts) for r in got] == [(1, ["", "x" * 100_000])]


# --- lines ---


def test_lines_go_by_their_share_of_the_pages(spark):
    at = lambda source, n, k: docs_of(spark, [f"page {source} {i}\n" + ("shared line" if i < k else f"own {i}") for i in range(n)], source)
    sites = {"one": (1, 1), "two": (2, 2), "three": (3, 3), "ten": (10, 2), "ten-three": (10, 3), "many": (200, 10), "many-more": (200, 11)}
    df = None
    for name, (n, k) in sites.items():
        df = at(name, n, k) if df is None else df.unionByName(at(name, n, k))
    got = {r.source: r.n for r in line_dedup.dedup_lines(df).groupBy("source").agg(F.sum("n_removed").alias("n")).collect()}
    gone = {name: sum(i < k for i in range(n)) for name, (n, k) in sites.items() if 1 < k > line_dedup.RATIO * n}
    assert {k for k, v in got.items() if v} == set(gone) == {"two", "three", "ten", "ten-three", "many-more"}


def test_lines_by_url_host_and_repeated_rows(spark):
    rows = [(k, f"http://h{k % 2}.example.org/{k}", f"own {k}\nmenu {k % 2}\nboth") for k in range(20)]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, text string")
    got = line_dedup.dedup_lines(df, site=url_filter.host_of(F.col("url"))).collect()
    assert len(got) == 23 and all(r.text == f"own {r.page_id}" for r in got)


def test_mixing_of_rows_without_a_key(spark):
    rows = [(None if k % 3 else k, f"{'word ' * (k % 17)}{k}", "a") for k in range(900)] + [(7, f"other text {k}", "a") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted((str(r.doc_id), r.text, r.position) for r in mixing.mix(d).collect()) for d in (df, df.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == 1200
    # Neither null nor repeated keys stand together: in the order of positions they are spread over the whole range.
    for key in ("None", "7"):
        at = sorted(p for k, _, p in got[0] if k == key and p is not None)
        assert at[0] < 0.1 and at[-1] > 0.9 and max(y - x for x, y in zip(at, at[1:])) < 0.1


# --- embeddings ---


def test_graphs_are_searched_at_the_size_of_the_tables(monkeypatch):
    pq = pytest.importorskip("pyarrow.parquet")
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    searched, search = [], hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, x, ef, *also: searched.append(len(x)) or search(self, x, ef, *also))
    for _, rows in table.groupby("label"):
        x = embedding_dedup._unit(np.unique(np.stack(rows["embedding"].to_list()).astype(float), axis=0))
        before = len(searched)
        got = {(int(a), int(b)) for p, q in embedding_dedup.links(hnsw.Graph(x.astype(np.float32)), x, x, 0.93, True) for a, b in zip(p, q)}
        assert got == set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.93))))
        assert sum(searched[before:]) >= len(x)  # every vector


@pytest.mark.parametrize("shard", [8192, 1500])
def test_links_of_large_labels(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    rng = np.random.default_rng(28)
    base = rng.normal(size=(4200, 16))
    near = np.concatenate([base[:900] + 0.08 * rng.normal(size=(900, 16)), base[:1] + 0.05 * rng.normal(size=(400, 16))])
    x = np.concatenate([base, near, base[:50]]).astype(np.float32)
    rows = [(k, [float(v) for v in e], 1) for k, e in enumerate(x)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    unit = embedding_dedup._unit(x)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    links = {r.id: r.n_links for r in got}
    assert len(got) == len(rows) and all(links[k] <= want[k] for k in links)
    assert sum(links.values()) >= 0.999 * want.sum() > 100_000
    same = sum(links[k] == want[k] for k in links)
    assert same >= 0.999 * len(rows)


def test_vectors_with_null_ids_and_many_dimensions(spark):
    rng = np.random.default_rng(29)
    long_ = [float(v) for v in rng.normal(size=5000)]
    rows = [(1, long_, 1), (2, long_, 1), (None, long_, 1), (None, None, None), (2, long_, 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r.id), r.n_links, str(r.component_id), r.kept) for r in got) == [("1", 2, "1", True), ("2", 2, "1", False), ("2", 2, "1", False), ("None", 0, "None", True), ("None", 0, "None", True)]


# --- near copies ---


def test_rows_that_share_an_id_but_not_a_text(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 64)
    monkeypatch.setattr(near_dedup, "SMALL_BAND", 2)
    rng = random.Random(30)
    one, other = prose(rng, 60), prose(rng, 60)
    rows = [(1, one), (1, other), (2, one), (3, other), (4, one + " end"), (5, other + " end"), (1, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted((r.doc, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()) for d in (df, df.repartition(7), df.orderBy(F.desc("text")))]
    assert runs[0] == runs[1] == runs[2]
    assert all(c == 1 for doc, _, c, _ in runs[0] if doc == 1)
    assert brute_near([(2, one), (4, one + " end")], 5)[4][1] == 2


def test_queries_are_registered_once_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
