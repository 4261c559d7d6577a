"""What near-dedup and language ID ask of the driver: each query there costs buffers, threads and plans."""

import pytest

from terrafold.llm import components as comp
from terrafold.llm import lang_id, near_dedup


@pytest.fixture
def tables(monkeypatch):
    names = []
    for module in (comp, near_dedup):
        kept = module.saved
        monkeypatch.setattr(module, "saved", lambda df, name, kept=kept: (names.append(name), kept(df, name))[1])
    return names


def test_no_edges_take_no_round(spark, tables):
    assert comp.components(spark.createDataFrame([(1, 1), (2, None)], "a long, b long")).count() == 0
    assert tables == ["edges"]


def test_stars_take_one_round(spark, tables):
    got = comp.components(spark.createDataFrame([(2, 1), (1, 3), (9, 7), (9, 7)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert tables == ["edges", "least", "edges"]


def test_chains_still_take_all_rounds(spark, tables):
    got = comp.components(spark.createDataFrame([(k + 1, k) for k in range(40)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(41)}
    assert tables.count("least") > 2


def test_unlike_texts_need_no_sets(spark, tables):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(6)], "doc_id long, text string")
    assert {(r.doc, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()} == {(k, k, True) for k in range(6)}
    assert not {"needed", "sets", "links", "clusters", "least"} & set(tables)


def test_ids_beyond_the_broadcast_are_joined(spark, tables, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"end{k}"])) for k in range(9)], "doc_id long, text string")
    plain = sorted(near_dedup.near_duplicates(docs).collect())
    assert "needed" not in tables and {r.component_id for r in plain} == {0}
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 3)
    assert sorted(near_dedup.near_duplicates(docs).collect()) == plain and "needed" in tables


def test_the_sample_comes_in_the_old_order(spark, monkeypatch):
    """By language, null keys before all others, then key and features; as Arrow, since rows of bytes are held twice by the driver's JVM."""
    rows = [("b", "le chat dort", "fr"), ("", "der hund", "de"), (None, "die katze", "de"), ("é", "un chien", "fr"), ("z", "une vache", "fr"), (None, "ein vogel", "de")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    seen = {}
    monkeypatch.setattr(lang_id, "fit", lambda x, langs: seen.update(x=x, langs=langs))
    arrow, calls = type(df).toArrow, []
    monkeypatch.setattr(type(df), "toArrow", lambda self: (calls.append(1), arrow(self))[1])
    lang_id.train(df)
    code = lambda text: (lang_id.features(text) * 255).round().astype("uint8").tobytes()
    want = sorted(rows, key=lambda r: (r[2], r[0] is not None, r[0] or "", code(r[1])))
    assert calls and seen["langs"] == [r[2] for r in want]
    assert [seen["x"].codes[k].tobytes() for k in range(6)] == [code(r[1]) for r in want]
