"""The registered queries of the training-data operators, and the SQL for those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import new_path, small_batches
from .alignment import alignment
from .bpe_codec import bpe_digests
from .decontaminate import contamination
from .language_id import fit, held_out, identify
from .line_dedup import line_dedup_report
from .minhash import near_duplicates
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .sharding import shard_documents
from .token_counts import token_counts
from .token_files import TokenFiles
from .url_filters import url_filter
from .variants import spelling_variants


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_read(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(_read(spark, sf_dir, "documents")).select(columns)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as reread from the newest version: size, digest, and whether its shard is one
    that the manifest names."""
    shards = shard_documents(_read(spark, sf_dir, "documents"), new_path(spark, "shards"))
    shards.vacuum(0)
    named = spark.createDataFrame([(s["path"], True) for s in shards.manifest()["shards"]], "shard string, named boolean")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = shards.read(shard_col="shard").select("doc_id", "shard", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))
    return rows.join(named, "shard", "left").select("doc_id", "n_bytes", "text_sha256", F.coalesce("named", F.lit(False)).alias("sharded"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = TokenFiles(spark, new_path(spark, "tokens"))
    files.write(_read(spark, sf_dir, "documents"))
    return files.checksums()


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_language_id, op4_bpe_codec, op5_line_dedup, op6_url_filter, op7_minhash, op8_quality_rules, op9_sharding, op10_decontaminate, op11_alignment, op12_spelling_variants, op13_token_files)}

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _sql_spans(kind: int, pattern: str, group: int, least: int, more: str = "true") -> str:
    """Matches with their places: what lies between them comes from splitting by the pattern."""
    pattern = pattern.replace("'", "''")
    return f"""
    SELECT row, doc_id, source, repo, {kind} AS kind, hit, value,
           gaps + coalesce(sum(length(hit)) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (
      SELECT row, doc_id, source, repo, k, hits[k] AS hit, vals[k] AS value,
             list_sum(list_transform(between_[1:k], lambda x: length(x))) AS gaps
      FROM (
        SELECT row, doc_id, source, md5(text) AS repo, regexp_extract_all(text, '{pattern}', 0) AS hits,
               regexp_extract_all(text, '{pattern}', {group}) AS vals,
               string_split_regex(text, '{pattern}') AS between_
        FROM docs
      ), unnest(range(1, len(hits) + 1)) AS t(k)
    ) WHERE true
    QUALIFY length(value) >= {least} AND {more}"""


_SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(f"(SELECT row, doc_id, source, repo, kind, value, start::BIGINT AS start, (start + length(hit))::BIGINT AS stop FROM ({x}))" for x in (
    _sql_spans(0, _ASSIGN, 2, 6),
    _sql_spans(1, "AKIA[A-Z0-9]+", 0, 20),
    _sql_spans(2, "[0-9a-f]{24,}", 0, 24),
    _sql_spans(3, "[A-Za-z0-9_-]{32,}", 0, 32, "regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')"),
))}),
owners AS (SELECT value AS v, count(DISTINCT coalesce(source, chr(0))) <= 3 AND count(DISTINCT repo) <= 100 AS live FROM spans GROUP BY 1),
judged AS (
  SELECT row, kind, start, live, ['assign', 'access', 'hex', 'key'][kind + 1] || ':' || start || ':' || stop AS said
  FROM spans JOIN owners ON value = v WHERE kind < 3 OR live
),
by_row AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(said, ',' ORDER BY start, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN by_row USING (row)
"""

_PAGES = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ruled AS (
  SELECT p.page_id, p.host, p.path, p.rest,
         arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM parsed p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN host = '' OR regexp_matches(rest, '^[^/?#]*/(robots\.txt|sitemap\.xml|humans\.txt)$') THEN 'allow'
         WHEN regexp_matches(host, '(^|[^a-z0-9])(spam|pills|casino|poker|porn|xxx|viagra|warez|torrent|malware)($|[^a-z0-9])')
           OR regexp_matches(rest, '^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}($|[:/?#])')
           OR regexp_matches(rest, '^([a-z0-9]+\.)?([a-z0-9]+-){4,}[a-z0-9]+\.')
           OR regexp_matches(rest, '/(wp-admin|wp-login\.php|xmlrpc\.php|cgi-bin)($|[/?#])')
           OR regexp_matches(rest, '/(login|signin|signup|register|logout|cart|checkout)($|[/?#.])')
           OR regexp_matches(rest, '/tag/[^/?#]+/page/[0-9]+')
           OR regexp_matches(rest, '\.(exe|apk|msi|dmg|iso|zip|rar)($|[?#])')
           OR regexp_matches(rest, '[?&](sessionid|phpsessid|jsessionid|sid)=') THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""

_QUALITY = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
words AS (SELECT row, k, ws[k] AS w FROM listed, unnest(range(1, len(ws) + 1)) AS t(k)),
grams AS (
  SELECT row, k, w,
         CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o) END AS g3,
         CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g5,
         CASE WHEN lead(w, 9) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o, lead(w, 8) OVER o, lead(w, 9) OVER o) END AS g10
  FROM words WINDOW o AS (PARTITION BY row ORDER BY k)
),
marked AS (
  SELECT row, k, w,
         g3 IS NOT NULL AND count(*) OVER (PARTITION BY row, g3) > 1 AS r3,
         g5 IS NOT NULL AND row_number() OVER (PARTITION BY row, g5 ORDER BY k) > 1 AS r5,
         g10 IS NOT NULL AND row_number() OVER (PARTITION BY row, g10 ORDER BY k) > 1 AS r10
  FROM grams
),
hit AS (
  SELECT row, length(w) AS n,
         bool_or(r3) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
         bool_or(r5) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
         bool_or(r10) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10
  FROM marked
),
by_word AS (
  SELECT row, count(*) AS n_words, sum(n) AS word_chars, count(*) FILTER (c3) AS n_repeat_words,
         coalesce(sum(n) FILTER (c5), 0) AS chars5, coalesce(sum(n) FILTER (c10), 0) AS chars10
  FROM hit GROUP BY 1
),
lines AS (SELECT row, k, parts[k] AS l FROM (SELECT row, string_split(text, chr(10)) AS parts FROM docs), unnest(range(1, len(parts) + 1)) AS t(k)),
again AS (SELECT row, l, row_number() OVER (PARTITION BY row, l ORDER BY k) > 1 AS dup FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
by_line AS (SELECT row, count(*) AS n_dup_lines, sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS line_chars FROM again WHERE dup GROUP BY 1),
counts AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(line_chars, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1)::DOUBLE AS s_line,
         coalesce(chars5, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1)::DOUBLE AS s5, coalesce(chars10, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1)::DOUBLE AS s10
  FROM docs LEFT JOIN by_word USING (row) LEFT JOIN by_line USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR s_line > 0.3 OR s5 > 0.2 OR s10 > 0.15) AS kept
FROM counts
"""

_LEAKS = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
wins AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS g
  FROM item_words, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(k) WHERE len(ws) > 0
),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
doc_wins AS (
  SELECT row, n, k, array_to_string(ws[k : k + n - 1], ' ') AS g
  FROM docs, (SELECT DISTINCT n FROM wins) AS lengths, unnest(range(1, len(ws) - n + 2)) AS t(k)
),
hits AS (SELECT row, k, n, item_id FROM doc_wins JOIN wins USING (n, g)),
places AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT row, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (row) LEFT JOIN items USING (row)
"""

_LINES = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT row, k, len(regexp_extract_all(parts[k], '[^\x20\x09-\x0D]+')) AS w FROM docs, unnest(range(1, len(parts) + 1)) AS t(k)),
sums AS (SELECT row, k, sum(w) OVER (PARTITION BY row ORDER BY k)::BIGINT AS c, (sum(w) OVER (PARTITION BY row ORDER BY k))::BIGINT - w AS before FROM lines),
runs AS (
  SELECT a.row, a.k AS first, min(b.k) AS last FROM sums a JOIN sums b ON a.row = b.row AND b.k >= a.k AND b.c - a.before >= 50 GROUP BY ALL
  UNION
  SELECT b.row, max(a.k) AS first, b.k AS last FROM sums a JOIN sums b ON a.row = b.row AND b.k >= a.k AND b.c - a.before >= 50 GROUP BY b.row, b.k
),
said AS (SELECT row, doc_id, first, last, last - first AS n, array_to_string(parts[first:last], chr(10)) AS said FROM runs JOIN docs USING (row)),
marked AS (SELECT row, first, last, row_number() OVER (PARTITION BY said, n ORDER BY doc_id, row, first) > 1 AS again FROM said),
gone AS (SELECT DISTINCT row, unnest(range(first, last + 1)) AS k FROM marked WHERE again),
places AS (SELECT row, k, k - row_number() OVER (PARTITION BY row ORDER BY k) AS island FROM gone),
islands AS (SELECT row, island, min(k) - 1 AS a, max(k) - 1 AS b FROM places GROUP BY ALL),
by_row AS (SELECT row, sum(b - a + 1)::BIGINT AS n_deleted, string_agg(a || '-' || b, ',' ORDER BY a) AS deleted FROM islands GROUP BY 1),
kept AS (SELECT row, string_agg(parts[l.k], chr(10) ORDER BY l.k) AS left_ FROM lines l JOIN docs USING (row) LEFT JOIN gone g ON g.row = l.row AND g.k = l.k WHERE g.k IS NULL GROUP BY 1)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(deleted, '') AS deleted, sha256(coalesce(left_, '')) AS left_sha256
FROM docs LEFT JOIN by_row USING (row) LEFT JOIN kept USING (row)
"""

_SHARDED = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, true AS sharded FROM documents"

ORACLE_SQL: dict[str, str] = {
    "op9_sharding": _SHARDED,
    "op5_line_dedup": _LINES,
    "op2_secret_scan": _SECRETS,
    "op6_url_filter": _PAGES,
    "op8_quality_rules": _QUALITY,
    "op10_decontaminate": _LEAKS,
}
