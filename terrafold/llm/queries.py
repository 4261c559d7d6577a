"""Registered queries of the training-data operators, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, filter_audit, html_extract, lang_id, line_dedup, media_columns, mixing, near_dedup, resampling, substring_dedup, url_filter
from .oracles import AUDIT, MEDIA, RESAMPLING


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(~lang_id.held_out()))
    return lang_id.identify(spark, docs.select("doc_id", "text"), model).select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    places = [F.round(F.try_element_at("positions", F.lit(k)), 9).alias(f"position_{k}") for k in (1, 2, 3)]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", *places)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], turns.schema)
    return chat_format.digest(chat_format.format_trees(chat_format.turns_as_tree(turns.unionByName(extra))))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2).withColumnRenamed("doc", "doc_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept").withColumnRenamed("doc", "doc_id")


def op11_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.text_as_media(_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_language_id, op4_html_extraction, op5_url_filter, op6_source_mixing, op7_chat_formatting, op8_line_dedup, op10_minhash_near_dedup, op2_benchmark_decontamination, op9_embedding_near_dedup, op3_substring_dedup, op11_media_columns, op12_filter_audit, op13_importance_resampling)}

_TERM = r"(^|[^\p{L}\p{N}])%ss?($|[^\p{L}\p{N}])"
#: A URL's escapes of printable ASCII as characters, others as spaces.
_UNESCAPED = "lower(coalesce(url, ''))"
for _c in (*range(0x20, 0x25), *range(0x26, 0x7F)):
    _UNESCAPED = f"replace({_UNESCAPED}, '%{_c:02x}', '{chr(_c).lower().replace(chr(39), 2 * chr(39))}')"
_UNESCAPED = f"replace(regexp_replace({_UNESCAPED}, '%([013-9a-f][0-9a-f]|2[0-46-9a-f])', ' ', 'g'), '%25', '%')"
_HIT = {t: f"CASE WHEN regexp_matches(u, '{_TERM % t}') THEN 1 ELSE 0 END" for t in url_filter.VOCABULARY}
_STRICT, _SOFT = (" + ".join(h for t, h in _HIT.items() if (url_filter.VOCABULARY[t] >= url_filter.LIMIT) == strict) for strict in (True, False))
_WEIGHT = " + ".join(f"{url_filter.VOCABULARY[t]} * {h}" for t, h in _HIT.items())

ORACLE_SQL = {
    "op11_media_columns": MEDIA,
    "op12_filter_audit": AUDIT,
    "op13_importance_resampling": RESAMPLING,
    "op5_url_filter": f"""
WITH a AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), b AS (
  SELECT *, {_UNESCAPED} AS u,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM a
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN weight >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft, CAST(weight AS BIGINT) AS weight
FROM (SELECT *, {_STRICT} AS n_strict, {_SOFT} AS n_soft, {_WEIGHT} AS weight FROM b) x""",
    "op6_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM d GROUP BY source
), r AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, cap / w AS rate, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r
), f AS (
  SELECT rate, sid, level FROM l WHERE level * w <= cap ORDER BY rate, sid LIMIT 1
), t AS (
  SELECT l.source, l.sid, l.source_size, CASE WHEN f.sid IS NULL OR (l.rate, l.sid) < (f.rate, f.sid) THEN CAST(l.cap AS DOUBLE) ELSE f.level * l.w END AS target
  FROM l LEFT JOIN f ON true
), c AS (
  SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, (sid - 1) % 3 AS k, sum(target * slope) OVER () / sum(target) OVER () AS drift FROM (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN 0 ELSE -0.5 END AS slope FROM t) x
), q AS (
  SELECT c.doc_id, c.size, c.source_size, c.target, e.slope, e.drift, p.pass,
         CASE WHEN 2 * (p.pass * c.source_size + c.start) + c.size <= 2 * c.target THEN CASE WHEN c.target > 0 THEN least(1.0, (p.pass * c.source_size + c.start + c.size / 2) / c.target) ELSE 0 END END AS share
  FROM c JOIN e ON e.source IS NOT DISTINCT FROM c.source, (VALUES (0), (1), (2)) p(pass)
), z AS (
  SELECT *, CASE WHEN share IS NULL THEN NULL WHEN slope = 0 THEN share ELSE (sqrt(greatest(0, (1 - slope) * (1 - slope) + 4 * slope * share)) - (1 - slope)) / (2 * slope) END AS t FROM q
), y AS (SELECT *, round(t + drift * (t * t - t), 9) AS position FROM z)
SELECT doc_id, min(size) AS size, min(source_size) AS source_size, min(target) AS target, CAST(min(size) * count(share) AS BIGINT) AS taken, CAST(count(share) AS INTEGER) AS copies,
       max(position) FILTER (WHERE pass = 0) AS position_1, max(position) FILTER (WHERE pass = 1) AS position_2, max(position) FILTER (WHERE pass = 2) AS position_3
FROM y GROUP BY doc_id""",
    "op8_line_dedup": f"""
WITH t AS (SELECT DISTINCT source, text FROM documents),
p AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM t),
f AS (
  SELECT source, line FROM (SELECT source, line, count(*) AS pages FROM p WHERE trim(line) <> '' GROUP BY source, line) x
  JOIN (SELECT source AS s, count(*) AS total FROM t GROUP BY source) y ON x.source IS NOT DISTINCT FROM y.s
  WHERE pages > 1 AND pages > CAST({line_dedup.RATIO} AS DOUBLE) * total
), b AS (SELECT source AS s, list(line) AS lines FROM f GROUP BY source),
k AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts, list_filter(string_split(text, chr(10)), lambda x: lines IS NULL OR NOT list_contains(lines, x)) AS kept
  FROM documents LEFT JOIN b ON documents.source IS NOT DISTINCT FROM b.s
)
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(parts) - len(kept), 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text
FROM k""",
    "op9_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}
), r AS (
  SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT p.x, r.c FROM r JOIN p ON p.y = r.x
), k AS (SELECT x, min(c) AS c FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, k.c AS component_id, k.c = v.vec_id AS kept FROM v JOIN k ON k.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id""",
    "op3_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13
), k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM g),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
h AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM k JOIN f USING (k) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
s AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept, count(*) AS n FROM u LEFT JOIN h ON h.doc_id = u.doc_id AND h.i = u.i WHERE h.i IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON s.doc_id = w.doc_id""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), u AS (SELECT doc_id, unnest(sh) AS g, len(sh) AS n FROM s),
q AS (SELECT g, count(*) AS df FROM u GROUP BY g),
o AS (SELECT u.doc_id, u.g, u.n, row_number() OVER (PARTITION BY u.doc_id ORDER BY df, u.g) AS place FROM u JOIN q ON q.g = u.g),
x AS (SELECT doc_id, g, n FROM o WHERE place <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT c.a, c.b FROM c JOIN s y ON y.doc_id = c.a JOIN s z ON z.doc_id = c.b WHERE 100 * len(list_intersect(y.sh, z.sh)) >= 80 * (len(y.sh) + len(z.sh) - len(list_intersect(y.sh, z.sh)))),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.x),
k AS (SELECT x, min(c) AS c FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, k.c AS component_id, k.c = s.doc_id AS kept FROM s JOIN k ON k.x = s.doc_id""",
    "op2_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
i AS (SELECT item_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g, least(5, len(ws)) AS w, len(ws) - least(5, len(ws)) + 1 AS m FROM (SELECT *, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0) t),
c AS (SELECT item_id, g, w, m, count(*) AS n FROM i GROUP BY item_id, g, w, m),
x AS (SELECT doc_id, i, w, len(ws) - w + 1 AS total, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM i) k WHERE len(ws) >= w) t),
h AS (SELECT x.doc_id, c.item_id, x.i, x.w, x.total, c.m, c.g, c.n FROM x JOIN c ON c.g = x.g AND c.w = x.w),
z AS (SELECT a.doc_id, a.item_id, a.i, a.m, least(a.m, a.total - a.i + 1) AS t, o.g, least(count(*), max(o.n)) AS same FROM h a JOIN h o ON o.doc_id = a.doc_id AND o.item_id = a.item_id AND o.i BETWEEN a.i AND a.i + a.m - 1 GROUP BY 1, 2, 3, 4, 5, 6),
v AS (SELECT doc_id, item_id, i, sum(same) / (max(t) + max(m) - sum(same)) AS similarity FROM z GROUP BY 1, 2, 3)
SELECT doc_id, item_id, max(similarity) AS similarity, count(*) AS n_windows FROM v WHERE similarity >= 0.8 GROUP BY doc_id, item_id""",
    "op7_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, 10 + 9 + 4 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
