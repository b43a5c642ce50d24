"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, conversations, decontam, fingerprint, html_extract, langid, line_dedup, near_dedup, pii, quality, suffix_dedup, toxicity, vector_codes
from factloom.llm.common import crc_bucket, read_table

RANKS = "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_bucket("doc_id", 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(quality.ledger(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_bucket("doc_id", 3) == 1)
    labels = read_table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 3) != 1)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digests(suffix_dedup.remove_repeats(docs))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digests(line_dedup.drop_recurring_lines(docs))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op10_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digests(decontam.find_matches(docs, read_table(spark, sf_dir, "benchmark")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversations.digests(conversations.repair(rows, "copies"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(rows)
    return vector_codes.digests(vector_codes.encode(rows, books), books)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digests(fingerprint.with_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_personal_data, op3_quality_rules, op4_toxicity, op5_repeated_strings, op6_main_text, op7_recurring_lines, op8_near_duplicates, op9_byte_bpe, op10_benchmark_matches, op11_conversation_repair, op12_vector_codes, op13_fingerprints]
    return {f.__name__: f for f in found}


#: Rules and policies are written out again, so that a slip in quality.RULES shows: bits 0 and 1 are the base's, bits 0 to 7 those of policy v1.
QUALITY_SQL = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
runs AS (SELECT doc_id, i, word, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM runs WHERE w4 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, w1, w2, w3, w4) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS r(k) GROUP BY doc_id),
each AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (word = w1) AS n_adjacent,
  count(*) FILTER (regexp_full_match(trim(word, '.,;:!?"''()'), '\\p{L}[\\p{L}\\p{M}\\x{200c}\\x{200d}]*') OR regexp_matches(word, '[\\x{e00}-\\x{eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{3ffff}]')) AS n_letter_words FROM runs GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
per_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, coalesce(n_letter_words, 0) AS n_letter_words, coalesce(n_adjacent, 0) AS n_adjacent,
  CAST(length(text) - length(regexp_replace(text, '[\\x{e00}-\\x{eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{3ffff}]', '', 'g')) AS BIGINT) AS n_unspaced
  FROM w LEFT JOIN each USING (doc_id) LEFT JOIN per_line USING (doc_id) LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END + CASE WHEN word_chars - n_unspaced > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN n_lines > 3 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
  + CASE WHEN 10 * n_letter_words < 4 * n_words THEN 64 ELSE 0 END + CASE WHEN 10 * n_adjacent > 3 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 255) = 0 AS kept, failed FROM f
"""


FINGERPRINT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text)),
e AS (SELECT doc_id, text, next_text, CAST(length(text) AS BIGINT) AS n_chars, left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3) AS edited FROM n),
w AS (SELECT *, list_transform([text, edited, next_text], lambda t: regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS ws FROM e),
h AS (SELECT *, list_transform(ws, lambda x: list_sort(list_distinct(list_filter(list_transform(range(1, greatest(len(x) - 4, 1) + 1), lambda i: left(md5(array_to_string(x[i:i + 4], ' ')), 16)), lambda y: y < '2')))) AS kept FROM w),
s AS (SELECT *, list_transform(range(1, 4), lambda k: CASE WHEN len(ws[k]) = 0 THEN [] WHEN len(kept[k]) > 0 THEN kept[k] ELSE ['0' || substring(md5(array_to_string(ws[k], ' ')), 2, 15)] END) AS f FROM h),
c AS (SELECT *, len(list_intersect(f[1], f[2])) AS with_edited, len(list_intersect(f[1], f[3])) AS with_next FROM s)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(f[1], '') AS fingerprint, array_to_string(f[2], '') AS edited_fingerprint,
  CASE WHEN len(f[1]) + len(f[2]) = 0 THEN 1.0 ELSE CAST(with_edited AS DOUBLE) / (len(f[1]) + len(f[2]) - with_edited) END AS near_edited,
  CASE WHEN len(f[1]) + len(f[3]) = 0 THEN 1.0 ELSE CAST(with_next AS DOUBLE) / (len(f[1]) + len(f[3]) - with_next) END AS near_next,
  CASE WHEN len(f[1]) = 0 THEN 1.0 ELSE CAST(with_edited AS DOUBLE) / len(f[1]) END AS in_edited,
  CASE WHEN len(f[1]) = 0 THEN 1.0 ELSE CAST(with_next AS DOUBLE) / len(f[1]) END AS in_next
FROM c
"""


#: crc32 bit by bit; then a row of the chart for each state, by recursion over a conversation's rows. moves: from a state by edits to a state,
#: with the initial of the last edit's role ('' for a deletion) and what is inserted before.
CONVERSATION_SQL = """
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keyed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i:i]) AS BIGINT))),
  lambda crc, byte: xor(crc >> 8, list_reduce([xor(crc, byte) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))), 4294967295) % 20 AS fault FROM given),
damaged AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM keyed, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS r(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || left(role, 1) AS pair,
  regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS written, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM damaged),
judged AS MATERIALIZED (SELECT *, written = '' AS blank, written <> '' AND again AS duplicate, written <> '' AND NOT again AND right(written, 1) NOT IN ('.', '!', '?') AS truncated FROM placed),
expects(before, role, state) AS (VALUES ('0', 's', 'S'), ('0', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
inserted(before, edits, lines, state) AS (SELECT s, '', '', s FROM (VALUES ('0'), ('S'), ('U'), ('A')) AS v(s)
  UNION ALL SELECT i.before, i.edits || 'I', i.lines || CASE e.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10), e.state FROM inserted i JOIN expects e ON e.before = i.state AND e.role <> 's' WHERE length(i.edits) < 2),
moves AS MATERIALIZED (SELECT i.before, i.edits, i.lines, e.role, e.state FROM inserted i JOIN expects e ON e.before = i.state UNION ALL SELECT DISTINCT before, '', '', '', before FROM inserted),
chart AS (SELECT conv_id, 0 AS i, '0' AS state, {'cost': 0, 'audit': '', 'lines': ''} AS item FROM (SELECT DISTINCT conv_id FROM given)
  UNION ALL SELECT * FROM (SELECT c.conv_id, c.i + 1, m.state, min({'cost': item.cost + 3 * length(edits) + CASE WHEN m.role = '' THEN 4 ELSE CASE WHEN m.role = initial THEN 0 ELSE 3 END + CASE WHEN truncated THEN 3 ELSE 0 END END,
    'audit': item.audit || edits || CASE m.role WHEN '' THEN 'D' WHEN initial THEN 'K' ELSE 'R' END,
    'lines': item.lines || m.lines || CASE WHEN m.role = '' THEN '' ELSE CASE WHEN m.role = initial THEN j.role WHEN m.role = 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) END})
    FROM chart c JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.i = c.i + 1 JOIN moves m ON m.before = c.state
    WHERE m.role = '' OR NOT (blank OR duplicate) AND (m.role = initial OR m.role <> 's') GROUP BY c.conv_id, c.i, m.state)),
ends AS (SELECT conv_id, min({'cost': item.cost + CASE state WHEN 'U' THEN 3 WHEN 'S' THEN 6 ELSE 0 END, 'audit': item.audit || CASE state WHEN 'U' THEN 'I' WHEN 'S' THEN 'II' ELSE '' END,
  'lines': item.lines || CASE state WHEN 'U' THEN 'assistant:' || chr(10) WHEN 'S' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE '' END}) AS item
  FROM chart c WHERE i = (SELECT count(*) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM c.conv_id) GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(item.cost AS BIGINT) AS cost, item.audit AS audit, sha256(left(item.lines, greatest(0, length(item.lines) - 1))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def vector_codes_sql() -> str:
    """Codebooks b0 to b6, each from the assignments before it. Squared distances are lists' sums; ties go to the lower entry."""
    nearest = """a{k} AS MATERIALIZED (SELECT vec_id, part, x, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM (
  SELECT vec_id, part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN b{k} USING (part)) GROUP BY vec_id, part, x),"""
    moved = """m{k} AS (SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS c FROM (
  SELECT part, entry, place, sum(x[place + 1]) AS total, count(*) AS n FROM a{k}, range(8) AS r(place) GROUP BY part, entry, place) GROUP BY part, entry),
b{next} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry)),"""
    rounds = "\n".join(nearest.format(k=k) + ("\n" + moved.format(k=k, next=k + 1) if k < 6 else "") for k in range(7))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * 8 + 1:part * 8 + 8] AS x FROM kept, range(8) AS r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts QUALIFY entry < 16),
{rounds}
codes AS (SELECT vec_id, string_agg('0' || lower(to_hex(entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM codes JOIN kept USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b6) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id) JOIN sums ON sums.label IS NOT DISTINCT FROM kept.label
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": CONVERSATION_SQL, "op12_vector_codes": vector_codes_sql(), "op3_quality_rules": QUALITY_SQL, "op13_fingerprints": FINGERPRINT_SQL}
