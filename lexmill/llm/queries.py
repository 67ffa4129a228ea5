"""The registered queries of this subpackage: each operator over its whole table, with production settings."""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, filter_audit, fingerprints, jaccard_join, mixing, pii, quality_rules, suffix_dedup, token_counts, token_store, toxicity, url_filter
from .common import table

#: The setting that holds the key of pseudonyms, and what stands in for it where a session has none, as in tests.
PII_KEY, NO_KEY = "spark.lexmill.pii.key", "no key is set"


def pii_key(spark: SparkSession) -> str:
    """The key of the session. Without one, anybody who knows this source can undo pseudonyms; a warning says so."""
    key = spark.conf.get(PII_KEY, None)
    if not key:
        warnings.warn(f"{PII_KEY} is not set: pseudonyms are not secret", stacklevel=2)
    return key or NO_KEY


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.rank_file_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.PieceAutomaton(*pieces, marker=b" "))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, url_filter.RULES))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(labels, table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    where = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.encoded(docs, *where, decode_too=True))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return new.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_values")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read(spark, manifest, token_store.crc, "ids_crc32", "long")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(quality_rules.ledger(table(spark, sf_dir, "documents")))
    failed = F.col("failed").bitwiseAND(F.lit(quality_rules.mask(quality_rules.POLICIES["base"]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op10's policy does: documents that fail it, fail it alone, are kept without it, are kept."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_token_counts, op2_url_filter, op3_toxicity, op4_fingerprints, op5_bpe, op6_pii, op7_token_store, op8_jaccard_join, op9_mixing, op10_quality_rules, op11_filter_audit, op12_suffix_dedup, op13_fill_in_middle, quality_ablations)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": URL_SQL, "op10_quality_rules": QUALITY_SQL, "quality_ablations": ABLATIONS_SQL,
        "op11_filter_audit": AUDIT_SQL, "op13_fill_in_middle": MIDDLE_SQL,
    }


URL_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
best AS (
  SELECT u.host, u.path, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS b
  FROM (SELECT DISTINCT host, path FROM u) u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY 1, 2)
SELECT u.page_id, u.host, u.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""

MEASURED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT r, i, words[i:i+2] AS gram FROM w, unnest(range(1, greatest(len(words) - 1, 1)::BIGINT)) AS t(i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, unnest([0, 1, 2]) AS t(k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d JOIN w USING (r) LEFT JOIN p USING (r)),
"""
QUALITY_SQL = MEASURED_SQL + r"""
f AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 5 * len(lines)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (10 * n_upper > 7 * n_letters AND n_letters > 0)) AS kept
FROM f
"""

ABLATIONS_SQL = MEASURED_SQL + r"""
b AS (SELECT (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * (len(lines) - len(list_distinct(lines))) > 5 * len(lines))::INT
  + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT + 32 * (10 * n_upper > 7 * n_letters AND n_letters > 0)::INT AS failed FROM m),
r AS (SELECT * FROM (VALUES ('too_few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('upper_case', 32)) AS t(rule, bit))
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_alone, count(*) FILTER (failed & (63 - bit) = 0) AS n_kept_without,
  count(*) FILTER (failed = 0) AS n_kept FROM b, r GROUP BY rule
"""

AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, md5(coalesce(text, '')) AS digest, string_split_regex(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS cut FROM documents),
w AS (SELECT *, CASE WHEN cut = [''] THEN [] ELSE cut END AS words FROM d),
firsts AS (SELECT digest, min(doc_id) AS least FROM d GROUP BY 1),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(w_toxic, false) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < w.doc_id, false)::INT AS fails
  FROM w JOIN firsts USING (digest) LEFT JOIN (SELECT doc_id, good, toxic AS w_toxic FROM known) k ON k.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY 1, 2),
bits AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(name, bit)),
sets AS (SELECT range AS applied FROM range(32)),
edges AS (
  SELECT part, name, bit, applied, sum(n) FILTER (fails & applied = 0) AS before, coalesce(sum(n) FILTER (fails & applied = 0 AND fails & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails & bit <> 0), 0) AS failing, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails & applied = 0 AND fails & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & applied = 0 AND fails & bit <> 0), 0) AS toxic_lost
  FROM c, bits, sets WHERE applied & bit = 0 GROUP BY 1, 2, 3, 4),
shares AS (SELECT part, name, sum(removed * factorial(bit_count(applied)::INT) * factorial(4 - bit_count(applied)::INT)) AS shapley FROM edges GROUP BY 1, 2),
perms AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bit_order
  FROM bits a, bits b, bits c, bits d, bits e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, bit_order[step] AS bit, coalesce(list_sum(bit_order[1:step - 1]), 0)::INT AS applied FROM perms, range(1, 6) AS t(step))
SELECT part, filter_order, step, (coalesce(before, 0) - removed)::BIGINT AS kept, removed::BIGINT AS removed, (failing - removed)::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM steps JOIN edges USING (bit, applied) JOIN shares USING (part, name)
"""

MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT for i in range(4)] AS draws FROM d),
p AS (
  SELECT *, len(units) AS n, least(draws[1] % (len(units) + 1), draws[2] % (len(units) + 1)) AS low, greatest(draws[1] % (len(units) + 1), draws[2] % (len(units) + 1)) AS high,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 90 AS plain
  FROM u),
s AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1:high], ''), '') AS middle, coalesce(array_to_string(units[high + 1:], ''), '') AS suffix FROM p)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN draws[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN draws[4] % 100 < 20 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""
