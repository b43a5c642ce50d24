"""Queries over agreements on secrecy and enriched worlds, and their DuckDB SQL."""

from __future__ import annotations

from factloom.operators import counterfactual, domains, enrichment, extraction, packs
from factloom.plans.causal_oracles import WHOLE, secrets, unknowns
from factloom.plans.oracles import LANGUAGE_WORDS, RULES
from factloom.sources import records
from factloom.sources.shared import stored
from pyspark.sql import functions as F


def secrecy_clauses(s, d):
    """Clauses by the rules of the language that an agreement's own words vote for."""
    docs = domains.with_language(records.secrecy_agreements(s, d))
    return domains.clause_texts(docs.select("doc_id", "text", F.col("language").alias("lang")))


def enrichment_faults(s, d):
    return enrichment.faults(records.enrichments(records.whole_events(s, d)))


def enriched_world(s, d):
    events = stored(records.whole_events(s, d), "events")
    enriched, conflicts = enrichment.enriched(events, records.enrichments(events))
    return counterfactual.computed(stored(enriched, "enriched"), records.whole_entities(events)), conflicts


def enriched_events(s, d):
    join = lambda c: F.array_join(c, ",").alias(c)
    return enriched_world(s, d)[0].events.select("case_id", "event_id", "kind", "value", join("actors"), join("objects"))


def enrichment_conflicts(s, d):
    return enriched_world(s, d)[1]


def enriched_unknowns(s, d):
    return enriched_world(s, d)[0].unknowns


def enriched_relations(s, d):
    return enriched_world(s, d)[0].relations


def enriched_conflicts(s, d):
    return enriched_world(s, d)[0].conflicts.select("case_id", "entity_id", F.array_join("states", ",").alias("states"), "n_events")


def story_characters(s, d):
    return extraction.characters(extraction.character_mentions(records.stories(s, d)))


def story_references(s, d):
    docs = stored(records.stories(s, d), "stories")
    pronouns = extraction.in_sentences(docs, {"pronoun": extraction.PRONOUN})
    return extraction.agreeing_references(pronouns, extraction.character_mentions(docs, find=extraction.in_sentences))


def packed(s, d):
    return stored(packs.normalized(records.packed_documents(s, d)), "packed")


def pack_documents(s, d):
    return packs.documents(packed(s, d))


def pack_chunks(s, d):
    return packs.chunks(packed(s, d)).drop("text")


def pack_hashes(s, d):
    return packs.hashes(packed(s, d), "documents")


ALL = [pack_documents, pack_chunks, pack_hashes, story_characters, story_references, secrecy_clauses, enrichment_faults, enriched_events, enrichment_conflicts, enriched_unknowns, enriched_relations, enriched_conflicts]

_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_lists = ", ".join("[" + ", ".join(map(_quoted, x)) + "]" for x in records.SECRECY.values())
_rules = ", ".join(f"('{lang}', '{name}', '{first}', '{second}')" for lang, rules in RULES.items() for name, first, second in rules)
_hits = ", ".join(f"len(list_filter(words, lambda x: list_contains([{', '.join(repr(w) for w in words)}], x))) AS n_{lang}" for lang, words in LANGUAGE_WORDS.items())
CLAUSES = f"""WITH chosen AS (SELECT o_orderkey AS doc_id, list_filter(list_transform(list_extract([{_lists}], CAST(o_orderkey % 4 AS BIGINT) + 1), lambda x, i: CASE WHEN (o_orderkey * 37 >> (i - 1)) % 2 = 1 OR i = 8 THEN x END), lambda x: x IS NOT NULL) AS x FROM orders),
texts AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN array_to_string(x, chr(10) || chr(10)) ELSE array_to_string(x, ' ') END AS text FROM chosen),
votes AS (SELECT doc_id, text, {_hits} FROM (SELECT doc_id, text, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS words FROM texts)),
spoken AS (SELECT doc_id, text, CASE WHEN greatest(n_fr, n_de, n_es, n_en) = 0 THEN 'en' WHEN n_fr = greatest(n_fr, n_de, n_es, n_en) THEN 'fr' WHEN n_de = greatest(n_fr, n_de, n_es, n_en) THEN 'de' WHEN n_es = greatest(n_fr, n_de, n_es, n_en) THEN 'es' ELSE 'en' END AS lang FROM votes),
sentences AS (SELECT doc_id, lang, unnest(range(len(x))) + 1 AS k, trim(unnest(x)) AS sentence FROM (SELECT doc_id, lang, string_split_regex(regexp_replace(regexp_replace(text, '\\n\\n+', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM spoken)),
rules(lang, clause, p1, p2) AS (VALUES {_rules})
SELECT doc_id, lang, clause, min(k) AS sentence, arg_min(sentence, k) AS text FROM sentences JOIN rules USING (lang) WHERE regexp_matches(lower(sentence), p1) AND (p2 = '' OR regexp_matches(lower(sentence), p2)) GROUP BY doc_id, lang, clause"""
ENRICHED = f"""{WHOLE}, more AS (SELECT case_id, event_id, CASE WHEN event_id % 8 = 0 THEN ['entity:auditor'] WHEN event_id % 401 = 0 THEN [] END AS actors, CASE WHEN event_id % 6 = 0 THEN ['entity:OBJ_1', 'entity:OBJ_9'] END AS objects,
  CASE WHEN event_id % 397 = 0 THEN 'instant' WHEN event_id % 10 < 7 THEN list_extract(['date', 'datetime', 'relative', 'unknown'], CAST(event_id % 4 AS BIGINT) + 1) END AS told FROM w WHERE event_id % 2 = 0 OR event_id % 401 = 0),
faults AS (SELECT case_id, event_id, 'duplicate event' AS fault FROM more WHERE event_id % 398 = 0 UNION ALL SELECT case_id, event_id, 'empty actors' FROM more WHERE len(actors) = 0 UNION ALL SELECT case_id, event_id, 'unsupported time kind' FROM more WHERE told = 'instant'
  UNION ALL SELECT case_id, event_id, 'time without value' FROM more WHERE told IN ('date', 'datetime') AND event_id % 4 > 1),
en AS (SELECT w.* REPLACE (CASE WHEN m.actors IS NULL THEN w.actors ELSE list_sort(list_distinct(list_concat(w.actors, m.actors))) END AS actors, CASE WHEN m.objects IS NULL THEN w.objects ELSE list_sort(list_distinct(list_concat(w.objects, m.objects))) END AS objects,
  CASE WHEN kind = 'unknown' AND told = 'date' THEN 'date' WHEN kind = 'unknown' AND told = 'datetime' THEN 'instant' ELSE kind END AS kind, CASE WHEN kind = 'unknown' AND told = 'date' THEN '2024-02-01' WHEN kind = 'unknown' AND told = 'datetime' THEN '2024-02-01T00:00:00Z' ELSE value END AS value),
  kind AS old_kind, value AS old_value, CASE told WHEN 'date' THEN 'date' WHEN 'datetime' THEN 'instant' WHEN 'relative' THEN 'unknown' WHEN 'unknown' THEN 'unknown' END AS told_kind, CASE told WHEN 'date' THEN '2024-02-01' WHEN 'datetime' THEN '2024-02-01T00:00:00Z' END AS told_value
  FROM w LEFT JOIN (SELECT * FROM more WHERE case_id NOT IN (SELECT case_id FROM faults)) m ON m.case_id = w.case_id AND m.event_id = w.event_id)"""


_story = ", ".join(map(_quoted, records.STORY))
#: Texts are cut into names, pronouns and single characters, whose summed lengths are their places.
STORIES = f"""stories AS (SELECT o_orderkey AS doc_id, array_to_string(list_transform(list_filter(range(12), lambda i: (o_orderkey * 31 + i * i) % 3 <> 0), lambda i: list_extract([{_story}], CAST((i * 5 + o_orderkey) % 12 AS BIGINT) + 1)), ' ') AS text FROM orders),
pieces AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '(?is)\\b(?:woman of Samaria|Samaritan woman|Jesus|John|disciples|he|she|they|him|her|them|his|their|its?)\\b|.') AS x FROM stories)),
placed AS MATERIALIZED (SELECT doc_id, piece, CAST(coalesce(sum(length(piece)) OVER w, 0) AS BIGINT) AS start, coalesce(count(*) FILTER (piece IN ('.', '!', '?')) OVER w, 0) AS sentence FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
who(piece, label, gender, plural) AS (VALUES ('woman of Samaria', 'woman_of_Samaria', 'F', false), ('Samaritan woman', 'woman_of_Samaria', 'F', false), ('Jesus', 'Jesus', 'M', false), ('John', 'John', 'M', false), ('disciples', 'disciples', 'P', true)),
named AS MATERIALIZED (SELECT doc_id, start, sentence, label, gender, plural FROM placed JOIN who USING (piece)),
asked AS (SELECT doc_id, start, sentence, piece AS surface, CASE WHEN lower(piece) IN ('he', 'him', 'his') THEN 'M' WHEN lower(piece) IN ('she', 'her') THEN 'F' WHEN lower(piece) IN ('they', 'them', 'their') THEN 'P' ELSE 'N' END AS kind FROM placed WHERE length(piece) > 1 AND piece NOT IN (SELECT piece FROM who)),
met AS (SELECT a.doc_id, a.start, arg_min(label, (a.sentence - n.sentence) * 1000000 - n.start) AS label FROM asked a JOIN named n ON n.doc_id = a.doc_id AND a.sentence - n.sentence BETWEEN 0 AND 2 AND (kind = 'N' OR (kind = 'P' AND plural) OR kind = gender) GROUP BY 1, 2)"""


PACKS = """docs AS (SELECT doc_id // 10 AS pack_id, 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS relpath, CASE WHEN doc_id % 3 = 0 THEN replace(t, chr(10), chr(13) || chr(10)) WHEN doc_id % 7 = 0 THEN replace(t, chr(10), chr(13)) ELSE t END
  || CASE WHEN doc_id % 4 = 0 THEN chr(13) || chr(10) || 'cafe' || chr(769) || ' "x" ' || chr(92) || ' ' || chr(9) ELSE '' END AS raw FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
normal AS MATERIALIZED (SELECT pack_id, relpath, replace(replace(nfc_normalize(raw), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM docs),
pieces AS (SELECT pack_id, relpath, 'doc:' || sha256(text) AS doc_id, i AS "index", i * 1080 AS offset_start, least(i * 1080 + 1200, length(text)) AS offset_end, substr(text, i * 1080 + 1, 1200) AS text FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(length(text) - 1200, 0) / 1080) AS BIGINT) + 1)) AS i FROM normal)),
dj AS (SELECT pack_id, count(*) AS n_documents, string_agg('{"bytes":' || strlen(text) || ',"doc_id":"doc:' || sha256(text) || '","relpath":"' || relpath || '","sha256":"' || sha256(text) || '"}', ',' ORDER BY relpath) AS j FROM normal GROUP BY 1),
cj AS (SELECT pack_id, count(*) AS n_chunks, string_agg('{"chunk_id":"chunk:' || sha256(text) || '","doc_id":"' || doc_id || '","index":' || "index" || ',"offset_end":' || offset_end || ',"offset_start":' || offset_start || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"text_sha256":"' || sha256(text) || '"}', ',' ORDER BY relpath, "index") AS j FROM pieces GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "pack_documents": f"WITH {PACKS} SELECT pack_id, 'doc:' || sha256(text) AS doc_id, relpath, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM normal",
        "pack_chunks": f'WITH {PACKS} SELECT pack_id, relpath, doc_id, \'chunk:\' || sha256(text) AS chunk_id, "index", offset_start, offset_end, sha256(text) AS text_sha256 FROM pieces',
        "pack_hashes": f"""WITH {PACKS} SELECT pack_id, sha256('{{"chunks":[' || cj.j || '],"documents":[' || dj.j || '],"pack_sha256":"","pack_version":"1.0","root_hint":"documents"}}') AS pack_sha256, n_documents, n_chunks FROM dj JOIN cj USING (pack_id)""",
        "story_characters": f"WITH {STORIES} SELECT doc_id, 'char_' || lower(label) AS char_id, label, count(*) AS n_mentions, min(start) AS first_start, row_number() OVER (PARTITION BY doc_id ORDER BY min(start), label) - 1 AS position FROM named GROUP BY doc_id, label",
        "story_references": f"WITH {STORIES} SELECT a.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.start) - 1 AS position, a.start, surface, coalesce(label, 'unknown_' || kind || '_' || (count(*) FILTER (label IS NULL) OVER (PARTITION BY a.doc_id, kind ORDER BY a.start))) AS refers_to, CASE WHEN label IS NULL THEN 'lookback_limit' ELSE 'recency' END AS rule FROM asked a LEFT JOIN met m ON m.doc_id = a.doc_id AND m.start = a.start",
        "secrecy_clauses": CLAUSES,
        "enrichment_faults": f"WITH {ENRICHED} SELECT * FROM faults",
        "enriched_events": f"WITH {ENRICHED} SELECT case_id, event_id, kind, value, array_to_string(actors, ',') AS actors, array_to_string(objects, ',') AS objects FROM en",
        "enrichment_conflicts": f"WITH {ENRICHED} SELECT case_id, event_id, old_kind AS kind, old_value AS value, told_kind, told_value FROM en WHERE old_kind <> 'unknown' AND told_kind IS NOT NULL AND (old_kind <> told_kind OR old_value IS DISTINCT FROM told_value)",
        "enriched_unknowns": f"WITH {ENRICHED} {unknowns('en')}",
        "enriched_relations": f"WITH {ENRICHED} SELECT case_id, event_id AS from_id, to_id, CASE WHEN value = to_value THEN 'same_time' ELSE 'before' END AS relation FROM (SELECT case_id, event_id, value, lead(event_id) OVER o AS to_id, lead(value) OVER o AS to_value FROM en WHERE kind <> 'unknown' WINDOW o AS (PARTITION BY case_id ORDER BY value, event_id)) WHERE to_id IS NOT NULL",
        "enriched_conflicts": f"WITH {ENRICHED}, {secrets('en', 's')} SELECT case_id, entity_id, array_to_string(states, ',') AS states, n_events FROM s_torn",
    }
