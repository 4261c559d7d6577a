"""Media columns, the audit of filter orders and importance resampling: brute force, hostile and edge inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.llm import filter_audit, hashing, media_columns, resampling
from terrafold.llm.media_columns import BadMedia, box, tracks_of

from .test_operators import prose

TEXTS = [None, "", " ", "é" * 100, "x" * 191, "x" * 192, "x" * 193, "long text " * 40_000, "x" * 192, "tail\n\t  ", "\U0001f600 emoji"]


# --- media columns ---


def movie(stbl, entry=box("mp4v", bytes(78)), kind=b"vide", extra=b"", timescale=600, units=0, wide=False):
    mdhd = box("mdhd", struct.pack(">IQQIQ4x", 1 << 24, 0, 0, timescale, units) if wide else struct.pack(">5I4x", 0, 0, 0, timescale, units))
    tkhd = box("tkhd", struct.pack(">6I8x8x", 7, 0, 0, 1, 0, 0), media_columns.MATRIX, struct.pack(">II", 640 << 16, 360 << 16))
    mdia = box("mdia", mdhd, box("hdlr", struct.pack(">II4s12x", 0, 0, kind), b"\0"), box("minf", box("stbl", box("stsd", struct.pack(">II", 0, 1), entry), *stbl)))
    return box("moov", box("trak", tkhd, mdia), extra)


def table(kind, *rows):
    return box(kind, struct.pack(">II", 0, len(rows)), b"".join(struct.pack(f">{len(r)}I", *r) for r in rows))


def test_sample_tables_in_all_forms():
    avc = box("avc1", bytes(78), box("avcC", bytes([1, 0x64, 0, 0x28, 0xFF])))
    sizes = [5, 9, 1, 7, 3]
    four_bit = box("stz2", struct.pack(">IxxxBI", 0, 4, 5), bytes([0x59, 0x17, 0x30]))
    eight_bit = box("stz2", struct.pack(">IxxxBI", 0, 8, 5), bytes(sizes))
    plain = box("stsz", struct.pack(">III5I", 0, 0, 5, *sizes))
    for stsz, wide, offsets64 in itertools.product((four_bit, eight_bit, plain), (False, True), (False, True)):
        at = (100, 300)  # two chunks of three and two samples, somewhere in the file
        stco = table("stco", *[(x,) for x in at]) if not offsets64 else box("co64", struct.pack(">II2Q", 0, 2, *at))
        moov = movie([table("stts", (2, 300), (3, 600)), table("stsc", (1, 3, 1), (2, 2, 1)), stsz, stco, table("stss", (1,), (4,))], avc, units=2400, wide=wide)
        head = media_columns.FTYP + box("free", bytes(3)) + struct.pack(">I4sQ", 1, b"mdat", 16 + 400) + bytes(400)  # a box with a 64-bit size
        data = head + moov
        (t,) = tracks_of(data)
        assert (t.id, t.kind, t.codec, t.timescale, t.width, t.height, media_columns.seconds(t), media_columns.n_samples(t)) == (1, "vide", "avc1.640028", 600, 640, 360, 4.0, 5)
        start, end, time = media_columns.keyframes(t)
        assert (start.tolist(), end.tolist(), time.tolist()) == ([100, 300], [105, 307], [0.0, 2.0])


def test_fragments():
    trex = box("mvex", box("trex", struct.pack(">6I", 0, 1, 1, 100, 10, media_columns.NOT_SYNC)))
    moov = movie([table("stts"), table("stsc"), box("stsz", struct.pack(">III", 0, 0, 0)), table("stco")], extra=trex, timescale=1000)

    def fragment(sizes, flags=None):
        def moof(offset):
            rows = struct.pack(f">{len(sizes)}I", *sizes)
            trun = box("trun", struct.pack(">IIiI", media_columns.TRUN_OFFSET | media_columns.TRUN_FIRST | media_columns.TRUN_SIZE, len(sizes), offset, 0), rows)
            return box("moof", box("mfhd", bytes(8)), box("traf", box("tfhd", struct.pack(">II", media_columns.TFHD_MOOF_BASE, 1)), trun))

        return moof(len(moof(0)) + 8) + box("mdat", bytes(sum(sizes)))

    one, two = fragment([20, 5, 5]), fragment([30, 1])
    data = media_columns.FTYP + moov + one + two
    (t,) = tracks_of(data)
    start, end, time = media_columns.keyframes(t)
    first = len(media_columns.FTYP + moov + one) - 30
    second = len(data) - 31
    assert (start.tolist(), end.tolist(), time.tolist()) == ([first, second], [first + 20, second + 30], [0.0, 0.3])
    assert media_columns.n_samples(t) == 5 and media_columns.seconds(t) == 0.5


def test_containers_that_lie_are_errors_not_allocations():
    good = media_columns.encode(b"abc " * 48 * 70)
    cut = 0
    for n in range(1, len(good), 97):
        try:
            tracks_of(good[:n])
        except BadMedia:
            cut += 1
    assert cut > 130
    for kind, at, value in ((b"stsz", 8, 1 << 31), (b"stsz", 12, 0xFFFFFFFF), (b"stco", 8, 0xFFFFFFFF), (b"stts", 12, 0xFFFFFFFF), (b"stsc", 12, 2), (b"stss", 12, 0), (b"stss", 12, 9999)):
        where = good.index(kind) + at
        with pytest.raises(BadMedia):
            tracks_of(good[:where] + struct.pack(">I", value) + good[where + 4 :])
    rng = random.Random(3)
    for _ in range(400):  # whatever is broken, nothing but BadMedia comes out
        broken = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            broken[rng.randrange(700)] = rng.choice((0, 1, 255, rng.randrange(256)))
        try:
            for t in tracks_of(bytes(broken)):
                media_columns.keyframes(t), media_columns.seconds(t)
        except BadMedia:
            pass
    nested = b""
    for _ in range(40):
        nested = box("moov", nested)
    with pytest.raises(BadMedia):
        tracks_of(nested)


def test_media_rows(spark):
    good = media_columns.encode(b"x" * 192 * 65)
    silent = media_columns.FTYP + box("moov")
    rows = [(1, good, "k"), (1, good, "k"), (2, None, "k"), (3, b"", "k"), (4, b"no container at all", "k"), (5, silent, None), (None, good[:-5], "k")]
    files = spark.createDataFrame(rows, "id long, content binary, codec string").withColumn("name", F.lit("n"))
    got = media_columns.media_columns(files).orderBy("id").collect()
    assert [(r.id, r.codec, r.n_samples, r.error is None, r.name) for r in got if r.id not in (None,)] == [(1, "raw", 65, True, "n")] * 2 + [(2, None, None, False, "n"), (3, None, None, False, "n"), (4, None, None, False, "n"), (5, None, None, True, "n")]
    assert next(r for r in got if r.id is None).error and len(next(r for r in got if r.id == 1).keyframes) == 2
    assert media_columns.media_columns(files.limit(0)).count() == 0


def test_texts_come_back_from_their_containers(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"media": F.lit(1), "n_bytes": F.lit("x"), "feature": F.lit(2)})
    got = media_columns.text_as_media(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc: r for r in got}
    for k, t in rows:
        raw = (t or "").encode()
        held = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        r = by_id[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]))
        media = media_columns.encode(held)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        first = int(re.search(r"keyframes=(\d+)-", r.feature)[1])
        assert media[first : first + 192] == held[:192]
    assert by_id[5][1:] == by_id[8][1:] and by_id[0][1:] == by_id[1][1:]
    assert media_columns.text_as_media(docs.limit(0)).count() == 0


# --- filter audit ---


def brute_audit(rows, labels):
    first, marks = {}, collections.defaultdict(lambda: [0, 0])
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x in labels:
        marks[d] = [max(marks[d][0], int(q == 1)), max(marks[d][1], int(x == 1))]
    fails = collections.defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        fails[lang or ""].append(({k for k, v in bad.items() if v}, marks[d] if d is not None else [0, 0]))
    out = {}
    for part, docs in fails.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(docs)
            for s, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, order, s + 1] = [len(left), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs), sum(x[1][0] for x in gone), sum(x[1][1] for x in gone)]
        for (p, order, s), row in out.items():
            if p == part:
                row.append(shapley[order[s - 1]])
    return out


def audit_rows():
    rng = random.Random(5)
    texts = [prose(rng, 250), prose(rng, 230) + " 5 % off", "again " * 250, "THIS IS LOUD " * 80, "", None, "short", "é$ " + prose(rng, 210), "à" * 900 + " ABC " + prose(rng, 220)]
    rows = [(k, texts[rng.randrange(len(texts))], rng.choice(("en", "de", "", None))) for k in range(120)]
    rows += [(7, rows[7][1], "fr"), rows[11], rows[11], (None, texts[0], "en"), (None, texts[0], "en"), (None, None, None)]
    return rows, [(k, k % 2, int(k % 3 == 0)) for k in range(0, 90, 2)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (9999, 1, 1)]


def audited(spark, rows, labels, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": F.lit("x"), "n_words": F.lit(1), "good": F.lit(2), "part": F.lit("p")})
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options).collect()
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in got}, len(got)


def test_audit_against_all_orders(spark):
    rows, labels = audit_rows()
    got, n = audited(spark, rows, labels)
    assert got == brute_audit(rows, labels) and n == 600 * 4
    assert audited(spark, [], labels) == ({}, 0)
    assert audited(spark, rows, [])[1] == n


def test_distinct_words_are_verified(spark):
    rng = random.Random(6)
    texts = [prose(rng, 40), "a b a b c", "", None, "w" * 70_000 + " " + "w" * 70_000 + " " + "w" * 69_999 + "v", "é è é"]
    for _, data, offsets in hashing.text_chunks(pa.array(texts)):
        starts, ends, row, hashed = hashing.words(data, offsets)
        want = [len(set((t or "").split())) for t in texts]
        assert filter_audit.distinct_words(data, starts, ends, row, hashed, len(texts)).tolist() == want
        # Even if all words met in one hash, the count would be right.
        assert filter_audit.distinct_words(data, starts, ends, row, np.zeros_like(hashed), len(texts)).tolist() == want


def test_other_filters_and_one_text_on_a_third_of_all_rows(spark):
    rows = [(k, "the same text" if k % 3 == 0 else f"text {k}", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    masks = filter_audit.failures(docs, filters={"R": "repeated", "S": "n_chars < 8"})
    got = {(r.filter_order, r.step): r for r in filter_audit.every_order(masks, "RS").collect()}
    assert got["RS", 1].removed == 99 and got["SR", 2].removed == 99 and got["SR", 1].kept == 300 - sum(len(t) < 8 for _, t, _ in rows)
    assert got["RS", 1].shapley == 2 * 99


# --- importance resampling ---


def brute_resample(rows, target, percent=5):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    of = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = collections.Counter(), collections.Counter()
    for total, texts in ((s, [x[1] for x in rows]), (t, target)):
        for text in texts:
            total.update(map(of, runs(words(text))))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out, may = [], []
    for d, text in rows:
        f = runs(words(text))
        weight = sum(gain(of(x)) for x in f)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words(text)) >= 20:
                may.append((-score, d))
        out.append([d, len(f), weight, score, None])
    rank = {d: k + 1 for k, (_, d) in enumerate(sorted(may)[: percent * len(may) // 100])}
    for r in out:
        r[4] = rank.get(r[0])
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 19, 7])
def test_resampling_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randint(0, 60)) + rng.choice(["", " ÉÑ 12a-b", "\x00x\x7fy", " A A A A"])) for k in range(400)]
    rows += [(500, None), (501, ""), (502, "..."), (None, prose(rng, 40)), (503, "w" * 3000 + " v " + "W" * 3000), (504, "same words " * 3000), (-5, prose(rng, 30)), (505, " ".join(["19 words"] * 9 + ["one"])), (506, "20 " * 20)]
    target = [rows[k][1] for k in range(0, 60, 3)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("x"), "score": F.lit(1), "n_words": F.lit(2), "doc": F.lit("d"), "bucket": F.lit(0)})
    got = resampling.resample(docs.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(([r.doc, r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()), key=str) == brute_resample(rows, target)


def test_resampling_of_ties_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    rows = [(k, "the very same words " * 6) for k in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(docs, none, percent=10).collect()
    ranks = sorted((r["rank"], r.score, r.doc) for r in got if r["rank"])
    assert [r[0] for r in ranks] == list(range(1, 9)) and [r[1] for r in ranks] == sorted((r[1] for r in ranks), reverse=True)
    assert {r.weight for r in got} == {0} or len({r.weight for r in got}) == 1
    assert resampling.resample(none, docs).count() == 0


def test_crc_states_of_long_words():
    rng = random.Random(9)
    for n in (1, 2, 63, 64, 1000, 70_001):
        a, b = bytes(rng.randrange(256) for _ in range(50)), bytes(rng.randrange(256) for _ in range(n))
        moved = resampling.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert moved == zlib.crc32(a + b)
