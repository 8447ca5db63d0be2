"""The queries of the numbered text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, filter_audit, language_crf, lattice_lm, line_filters, minhash_dedup, mixing, ngram_model, suffix_dedup, target_draw, url_filter
from tessera.llm.common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify_languages(read(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents")).drop("copies")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), keep_ids=False)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_components(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.hosts_named(pages))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_text_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_filters.line_dedup(read(spark, sf_dir, "documents"))


def op13_target_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_draw.draw(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_source_mix, op4_byte_bpe, op5_minhash_dedup, op6_url_filter, op7_importance_resampling, op8_quality_rules, op9_exact_dedup, op10_lattice_lm, op11_filter_audit, op12_line_dedup, op13_target_draw, pipeline)}


_RULES = "\n".join(
    f"  WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(url_filter.RULES), key=lambda r: -len(r[1][1] + r[1][2]))
)
_RULE_CASE = "CASE\n" + _RULES.format(*(h + p for _, h, p in url_filter.RULES)) + "\nEND"
_VERDICT_CASE = "CASE\n" + _RULES.format(*(v for v, _, _ in url_filter.RULES)) + "\nEND"

ORACLES = {
    "op3_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM s
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level FROM w
), r AS (
  SELECT *, level <= (everything * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS capped
  FROM c WINDOW before AS (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN capped THEN cap ELSE (everything * 1.5::DOUBLE - sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER ()) / sum(CASE WHEN NOT capped THEN weight END) OVER () * weight END AS target FROM r
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM t
)
SELECT doc_id, size, source_size, target, CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
""",
    "op6_url_filter": rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path, {_RULE_CASE} AS rule,
  coalesce({_VERDICT_CASE}, CASE WHEN regexp_matches(host, '(^|\.)({"|".join(url_filter.BLOCKED_NAMES)})\.[^.]') THEN 'block' ELSE 'allow' END) AS verdict
FROM u
""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
    row_number() OVER (PARTITION BY text_sha256, doc_id) AS again
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND again = 1 AS kept, text_sha256 FROM g
""",
    "op11_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b
), p AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM p, range(1, 6) r(step)
), c AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN (mask & (before | own)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN (mask & before) = 0 AND (mask & own) <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & before) <> 0 AND (mask & own) <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & before) = 0 AND (mask & own) <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN (mask & before) = 0 AND (mask & own) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c
""",
    "op12_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op13_target_draw": r"""
WITH RECURSIVE byte AS (
  SELECT k, list_reduce(list_prepend(CAST(k AS BIGINT), CAST(range(0, 8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(0, 256) b(k)
), w AS (
  SELECT doc_id AS id, true AS raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT item_id, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), r AS (
  SELECT id, raw, n, words, unnest(range(1, len(words) - n + 2)) AS place FROM w, range(1, 4) t(n) WHERE len(words) >= n
), g AS MATERIALIZED (
  SELECT id, raw, array_to_string(words[place:place + n - 1], ' ') AS gram FROM r
), v AS MATERIALIZED (
  SELECT gram, encode(gram) AS code, octet_length(encode(gram)) AS size, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM g GROUP BY gram
), crc AS ( -- what a byte, and the first state as number 256, come to when so many bytes follow
  SELECT k, 0 AS after, c FROM byte
  UNION ALL SELECT 256, 0, 4294967295
  UNION ALL SELECT crc.k, after + 1, xor(crc.c >> 8, byte.c) FROM crc JOIN byte ON byte.k = crc.c & 255 WHERE after < (SELECT max(size) FROM v)
), y AS (
  SELECT gram, size, unnest(range(0, size)) AS place, code FROM v
), x AS (
  SELECT gram, bit_xor(c) AS c FROM (SELECT gram, CAST('0x' || hex(code[place + 1:place + 1]) AS BIGINT) AS k, size - 1 - place AS after FROM y UNION ALL SELECT gram, 256, size FROM v) JOIN crc USING (k, after) GROUP BY gram
), h AS MATERIALIZED (
  SELECT gram, s, t, CAST(xor(c, 4294967295) AS BIGINT) % 10000 AS bucket FROM x JOIN v USING (gram)
), b AS MATERIALIZED (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM h GROUP BY bucket
), a AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((CAST(t AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM b) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM b) + 10000)))) AS BIGINT) AS gain FROM b
), q AS (
  SELECT id, count(*) AS n_features, sum(gain) AS weight FROM g JOIN h USING (gram) JOIN a USING (bucket) WHERE raw GROUP BY id
), z AS (
  SELECT id AS doc_id, len(words) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN q USING (id) WHERE w.raw
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM z WHERE n_words >= 20) AS able FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN CAST(place AS BIGINT) END AS rank FROM o
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
