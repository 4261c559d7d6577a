"""DuckDB SQL of the media, audit and resampling queries, built from rules."""

from __future__ import annotations

from itertools import permutations

from . import filter_audit, media_columns, resampling

#: CRC-32 of one byte, by the byte.
_CRC = []
for _k in range(256):
    for _ in range(8):
        _k = _k >> 1 ^ (resampling.POLYNOMIAL if _k & 1 else 0)
    _CRC.append(_k)


def crc32(hexed: str) -> str:
    """SQL: the CRC-32 of bytes given in hexadecimal; CRCS must be joined."""
    byte = f"16 * (instr('0123456789ABCDEF', substr({hexed}, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr({hexed}, 2 * i + 2, 1)) - 1"
    listed = f"list_transform(range(length({hexed}) // 2), lambda i: CAST({byte} AS BIGINT))"
    return f"xor(4294967295, list_reduce({listed}, lambda c, x: xor(c >> 8, crc_of[1 + (xor(c, x) & 255)]), CAST(4294967295 AS BIGINT)))"


CRCS = f"crcs AS (SELECT CAST({_CRC} AS BIGINT[]) AS crc_of)"


def _u32(*values: object) -> str:
    return " || ".join(f"format('{{:08x}}', CAST({v} AS BIGINT))" for v in values)


def _box(kind: str, size: object, *parts: str) -> str:
    return " || ".join([_u32(size), f"'{kind.encode().hex()}'", *parts])


def _media() -> str:
    """The container's bytes in hexadecimal, from n (samples), c (chunks), e (entries of stsc), and the payload's."""
    fixed = lambda b: f"'{b.hex()}'"
    zeros = lambda n: f"'{'00' * n}'"
    per = media_columns.CHUNK_SAMPLES
    stbl, full = "(152 + 8 * c + 12 * e)", f"least(n, {per})"
    size = {"stbl": stbl, "minf": f"(60 + {stbl})", "mdia": f"(133 + {stbl})", "trak": f"(233 + {stbl})", "moov": f"(349 + {stbl})"}
    rows = lambda form: f"array_to_string(list_transform(range(c), lambda k: format('{{:08x}}', CAST({form} AS BIGINT))), '')"
    entry = _box("raw ", 36, "'0000000000000001'", zeros(8), "'00010008'", zeros(4), _u32(media_columns.RATE << 16))
    stsc = f"{_u32(1, full, 1)} || CASE WHEN e = 2 THEN {_u32('c', f'n - {per} * (c - 1)', 1)} ELSE '' END"
    table = _box("stbl", size["stbl"], _box("stsd", 52, _u32(0, 1), entry), _box("stts", 24, _u32(0, 1, "n", media_columns.SAMPLE)), _box("stss", "16 + 4 * c", _u32(0, "c"), rows(f"1 + {per} * k")),
                 _box("stsc", "16 + 12 * e", _u32(0, "e"), stsc), _box("stsz", 20, _u32(0, media_columns.SAMPLE, "n")), _box("stco", "16 + 4 * c", _u32(0, "c"), rows(f"base + {per * media_columns.SAMPLE} * k")))
    minf = _box("minf", size["minf"], _box("smhd", 16, zeros(8)), _box("dinf", 36, _box("dref", 28, _u32(0, 1), _box("url ", 12, _u32(1)))), table)
    mdhd = _box("mdhd", 32, _u32(0, 0, 0, media_columns.RATE, f"n * {media_columns.SAMPLE}"), "'55c40000'")
    mdia = _box("mdia", size["mdia"], mdhd, _box("hdlr", 33, _u32(0, 0), "'736f756e'", zeros(13)), minf)
    tkhd = _box("tkhd", 92, _u32(7, 0, 0, 1, 0, f"n * {media_columns.SAMPLE}"), zeros(8), "'0000000001000000'", fixed(media_columns.MATRIX), zeros(8))
    mvhd = _box("mvhd", 108, _u32(0, 0, 0, media_columns.RATE, f"n * {media_columns.SAMPLE}", 65536), "'0100'", zeros(10), fixed(media_columns.MATRIX), zeros(24), _u32(2))
    moov = _box("moov", size["moov"], mvhd, _box("trak", size["trak"], tkhd, mdia))
    return " || ".join([fixed(media_columns.FTYP), moov, _box("mdat", f"8 + {media_columns.SAMPLE} * n", "held")])


_S, _PER = media_columns.SAMPLE, media_columns.CHUNK_SAMPLES
MEDIA = f"""
WITH {CRCS}, a AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, greatest(1, (length(h) // 2 + {_S - 1}) // {_S}) AS n, h FROM a
), d AS (
  SELECT doc_id, n_bytes, n, (n + {_PER - 1}) // {_PER} AS c, CASE WHEN n > {_PER} AND n % {_PER} > 0 THEN 2 ELSE 1 END AS e, h || repeat('20', {_S} * n - n_bytes) AS held FROM b
), f AS (SELECT *, 533 + 8 * c + 12 * e AS base FROM d),
m AS (SELECT *, unhex({_media()}) AS media, substr(held, -32) AS tail FROM f)
SELECT doc_id, n_bytes, CAST({_S} * n AS BIGINT) AS payload_bytes, sha256(unhex(held)) AS payload_sha256, CAST({crc32("tail")} AS BIGINT) AS tail_crc32, CAST(octet_length(media) AS BIGINT) AS media_bytes,
       sha256(media) AS media_sha256,
       'codec=raw;ms=' || CAST(24 * n AS BIGINT) || ';samples=' || n || ';keyframes=' || array_to_string(list_transform(range(c), lambda k: (base + {_PER * _S} * k) || '-' || (base + {_PER * _S} * k + {_S})), ',') AS feature
FROM m, crcs"""

_LETTERS = "".join(filter_audit.FILTERS)
_STEPS = ", ".join(f"('{o}', {s + 1}, {1 << _LETTERS.index(x)}, {sum(1 << _LETTERS.index(y) for y in o[:s])})" for o in map("".join, permutations(_LETTERS)) for s, x in enumerate(o))
AUDIT = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT text, min(doc_id) AS first FROM w GROUP BY text
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < w.doc_id THEN 16 ELSE 0 END AS mask
  FROM w JOIN s ON s.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
o AS (SELECT * FROM (VALUES {_STEPS}) t(filter_order, step, own, before)),
r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, o GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""

_B = resampling.BUCKETS
RESAMPLING = rf"""
WITH {CRCS}, w AS (
  SELECT 0 AS src, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), v AS (
  SELECT src, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM w
), g AS (
  SELECT src, doc_id, unnest(list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) AS f FROM v
), c AS (SELECT src, doc_id, f, count(*) AS n FROM g GROUP BY src, doc_id, f),
x AS (SELECT f, CAST({crc32("h")} AS BIGINT) % {_B} AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM c)), crcs),
k AS (SELECT src, doc_id, b, sum(n) AS n FROM c JOIN x USING (f) GROUP BY src, doc_id, b),
t AS (SELECT b, CAST(sum(CASE WHEN src = 0 THEN n ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN src = 1 THEN n ELSE 0 END) AS DOUBLE) AS t FROM k GROUP BY b),
z AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {_B}) / ((s + 1) * (sum(t) OVER () + {_B})))) AS BIGINT) AS gain FROM t),
y AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM k JOIN z USING (b) WHERE src = 0 GROUP BY doc_id),
e AS (
  SELECT v.doc_id, len(ws) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('{resampling.SEED}:' || v.doc_id), 1, 8) AS BIGINT) AS h
  FROM v LEFT JOIN y ON y.doc_id = v.doc_id WHERE src = 0
), p AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY words >= {resampling.MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= {resampling.MIN_WORDS}) OVER () AS may FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {resampling.MIN_WORDS} AND place <= {resampling.PERCENT} * may // 100 THEN place END AS rank FROM q"""
