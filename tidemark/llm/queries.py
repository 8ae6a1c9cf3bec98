"""The corpus operators as queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, licenses, mixing, packing, quality, secrets, simhash, token_files, warc
from .common import prepare, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
    return quality.verdicts(table(spark, sf_dir, "documents")).select(*columns)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_token_files(table(spark, sf_dir, "documents")).digests()


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


OPERATORS = (op1_licenses, op2_quality, op3_secrets, op4_exact_dedup, op5_warc, op6_token_files, op7_language, op8_mixing, op9_packing, op10_simhash)


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _prepared(f) for f in OPERATORS}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))


def _rule_sql(r: quality.Rule) -> str:
    ratio = f"{r.numerator}::DOUBLE / nullif({r.denominator}, 0)::DOUBLE"
    tests = [f"{ratio} >= {r.least}"] * (r.least is not None) + [f"{ratio} <= {r.most}"] * (r.most is not None)
    other = f" OR lang IS DISTINCT FROM '{r.lang}'" if r.lang is not None else ""
    return f"({r.denominator} < {max(1, r.floor)}{other} OR ({' AND '.join(tests)}))"


OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
grams AS (SELECT doc_id, p, array_to_string(words[p:p + 4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) t(p)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT q) AS n FROM twice, unnest(range(p, p + 5)) u(q) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, w.lang, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines
  FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(map(_rule_sql, quality.RULES))} AS kept,
       concat_ws(',', {', '.join(f"CASE WHEN NOT {_rule_sql(r)} THEN '{r.name}' END" for r in quality.RULES)}) AS failed_rules
FROM b
"""

OP4_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h)::BIGINT AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
dealt AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % greatest(1, ((SELECT count(*) FROM sized) + {mixing.SHARD_ROWS - 1}) // {mixing.SHARD_ROWS}) AS shard FROM sized),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{', '.join(map(str, mixing.WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source),
roomy AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         2 * {mixing.CAP} * source_size * sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= ({mixing.SHARE_HALVES} * sum(source_size) OVER () - 2 * {mixing.CAP} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM named),
wanted AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN ({mixing.CAP} * source_size)::DOUBLE
              ELSE (weight * ({mixing.SHARE_HALVES} * total - 2 * {mixing.CAP} * coalesce(sum(source_size) FILTER (is_full) OVER (), 0)))::DOUBLE / (2 * sum(weight) FILTER (NOT is_full) OVER ())::DOUBLE END AS target
  FROM roomy),
cells AS (
  SELECT c.source, shard, words, source_size, target,
         CASE WHEN source_size > 0 THEN target * words::DOUBLE / source_size::DOUBLE ELSE 0 END AS t
  FROM (SELECT source, shard, sum(size)::BIGINT AS words FROM dealt GROUP BY source, shard) c
  JOIN wanted w ON c.source IS NOT DISTINCT FROM w.source),
totals AS (SELECT *, sum(t) OVER (PARTITION BY shard) AS sum_t, count(*) OVER (PARTITION BY shard) AS n, floor(sum(t) OVER (PARTITION BY shard) / {mixing.BLOCK_WORDS} + 0.5)::BIGINT AS blocks FROM cells),
bounds AS (
  SELECT *, greatest(0, floor(t / sum_t * (blocks - n / 2)) - 1)::BIGINT AS sure, (ceil(t / sum_t * (blocks + n / 2)) + 1)::BIGINT AS most
  FROM totals WHERE sum_t > 0),
ranked AS (
  SELECT b.source, b.shard, t, k
  FROM bounds b, unnest(range(b.sure, b.most + 1)) u(k)),
open_seats AS (SELECT shard, any_value(blocks) - sum(sure) AS open_ FROM bounds GROUP BY shard),
seats AS (
  SELECT r.source, r.shard, row_number() OVER (PARTITION BY r.shard ORDER BY r.t / (2 * r.k + 1) DESC, r.source NULLS LAST, r.k) AS rank, r.t, o.open_
  FROM ranked r JOIN open_seats o ON r.shard = o.shard),
won AS (SELECT source, shard, count(*) AS won FROM seats WHERE rank <= open_ AND t > 0 GROUP BY source, shard),
blocked AS (
  SELECT c.source, c.shard, c.words, c.source_size, c.target,
         least((coalesce(b.sure, 0) + coalesce(w.won, 0)) * {mixing.BLOCK_WORDS}, {mixing.CAP} * c.words)::BIGINT AS demand
  FROM cells c LEFT JOIN bounds b ON c.shard = b.shard AND c.source IS NOT DISTINCT FROM b.source
  LEFT JOIN won w ON c.shard = w.shard AND c.source IS NOT DISTINCT FROM w.source),
residues AS (
  SELECT *, floor(target + 0.5)::BIGINT - sum(demand) OVER (PARTITION BY source) AS left_, {mixing.CAP} * words - demand AS room,
         coalesce(sum({mixing.CAP} * words - demand) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room_before,
         coalesce(sum(demand) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before
  FROM blocked),
quota AS (
  SELECT source, shard, words, source_size, target,
         (demand + greatest(0, least(room, left_ - room_before)) - greatest(0, least(demand, -left_ - held_before)))::BIGINT AS demand
  FROM residues),
placed AS (
  SELECT d.*, q.words, q.demand, q.source_size, q.target, CASE WHEN q.words > 0 THEN q.demand // q.words ELSE 0 END AS times,
         coalesce(sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
  FROM dealt d JOIN quota q ON d.shard = q.shard AND d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (times * size + greatest(0, least(start_ + size, demand - times * words) - start_))::BIGINT AS taken
FROM placed
"""

ORACLES = {"op2_quality": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op8_mixing": OP8_SQL}
