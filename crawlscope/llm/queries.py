"""Queries of the training-data operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .common import table
from .exact_dedup import exact_dedup
from .langid import identify
from .licenses import scan_licenses
from .line_dedup import judge_lines
from .merkle import manifest
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack_texts
from .secrets import scan_secrets
from .toxicity import score_toxicity
from .url_filter import judge_pages
from .whitening import whiten


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


#: The rules of the contract.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), URL_RULES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_lines(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


#: Most documents' pieces in a sequence: it binds where short texts come together.
MAX_SEGMENTS = 64


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_segments=MAX_SEGMENTS, with_ids=False).drop("n_loss")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_url_filter, op3_language_id, op4_license_scan, op5_line_dedup, op6_nearest_neighbours, op7_exact_dedup, op8_secret_scan,
        op9_packing, op10_mixing, op11_toxicity, op12_merkle_manifest, op13_embedding_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
""",
    # Links stated in the HTML are left to the tests: no table has one.
    "op2_url_filter": r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages),
rules(rule, rule_host, rule_path, action) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
u AS (
  SELECT *, regexp_replace(host, '^(?:(?:www|m)[.])+([^.]+[.])', '\1') AS uhost, CASE WHEN regexp_matches(upath, '(/|[.][A-Za-z0-9]+)$') THEN upath ELSE upath || '/' END AS ufolder,
    regexp_replace(CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_filter(string_split(substr(query, 2), '&'),
      lambda x: NOT regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid)(=|$)')), '&') END, '[?&]+$', '') AS uquery
  FROM (SELECT *, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/(index[.]html|index[.]htm|index[.]php)$', '/') AS upath FROM p)),
seen AS (
  SELECT page_id, host, path, uhost || ufolder || uquery AS alias, host AS h, path AS q FROM u WHERE host <> ''
  UNION ALL SELECT NULL, NULL, NULL, uhost || ufolder || uquery, uhost, ufolder FROM u WHERE host <> ''),
fit AS (
  SELECT s.*, (SELECT max_by({'rule': rule, 'action': action}, length(rule)) FROM rules r
    WHERE (s.h = rule_host OR ends_with(s.h, '.' || rule_host)) AND starts_with(s.q, rule_path)) AS hit FROM seen s),
told AS (SELECT alias, bool_or(hit.action = 'allow') AS allowed, bool_or(hit.action = 'block') AS blocked FROM fit GROUP BY alias)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.action, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM fit JOIN told USING (alias) WHERE page_id IS NOT NULL
UNION ALL SELECT page_id, host, path, NULL, 'allow' FROM p WHERE host = ''
""",
    "op7_exact_dedup": r"""
WITH h AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""",
    # crc32 is folded bit by bit: an id's character codes, each followed by eight shifts.
    "op12_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
  FROM d),
lv AS (
  SELECT source, 0 AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS digest, doc_id FROM leaves
  UNION ALL
  SELECT source, h + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)), NULL FROM lv WHERE n > 1 GROUP BY source, h, pos // 16, n),
tv AS (
  SELECT 0 AS h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest, source FROM lv WHERE n = 1
  UNION ALL
  SELECT h + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)), NULL FROM tv WHERE n > 1 GROUP BY h, pos // 16, n),
runs AS (
  SELECT source, h, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM lv WHERE n > 1 GROUP BY source, h, pos // 16),
tops AS (SELECT h, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM tv WHERE n > 1 GROUP BY h, pos // 16),
up AS (
  SELECT doc_id, source, h, pos, '' AS proof, coalesce(l.altered, l.leaf) AS folded FROM lv JOIN leaves l USING (doc_id, source) WHERE h = 0
  UNION ALL
  SELECT u.doc_id, u.source, u.h + 1, u.pos // 16, proof || array_to_string(ds[:pos % 16], '') || array_to_string(ds[pos % 16 + 2:], ''),
    sha256(array_to_string(ds[:pos % 16], '') || folded || array_to_string(ds[pos % 16 + 2:], ''))
  FROM up u JOIN runs r ON r.source IS NOT DISTINCT FROM u.source AND r.h = u.h AND r.run = u.pos // 16),
over AS (
  SELECT u.doc_id, u.source, 0 AS h, t.pos, u.proof, u.folded, t.digest AS subroot
  FROM (SELECT * FROM up QUALIFY h = max(h) OVER (PARTITION BY doc_id)) u JOIN tv t ON t.h = 0 AND t.source IS NOT DISTINCT FROM u.source
  UNION ALL
  SELECT doc_id, source, o.h + 1, pos // 16, proof || array_to_string(ds[:pos % 16], '') || array_to_string(ds[pos % 16 + 2:], ''),
    sha256(array_to_string(ds[:pos % 16], '') || folded || array_to_string(ds[pos % 16 + 2:], '')), subroot
  FROM over o JOIN tops r ON r.h = o.h AND r.run = o.pos // 16)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT * FROM over QUALIFY h = max(h) OVER (PARTITION BY doc_id)) JOIN leaves USING (doc_id) CROSS JOIN (SELECT digest AS root FROM tv WHERE n = 1)
""",
}
