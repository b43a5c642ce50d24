"""DuckDB SQL with the same results as the queries for spans of text. Texts are cut into pieces that leave nothing out, so a piece's place is the summed
length of those before it; words are whole runs of letters, digits and underscores, as word boundaries of Python's patterns are."""

from __future__ import annotations

from factloom.plans.oracles import DOCS

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_in = lambda words: "list_contains([" + ", ".join(f"'{w}'" for w in words.split()) + "], lower(piece))"


def placed(name: str, pattern: str) -> str:
    """name: (doc_id, k, piece, start) of the pieces of a pattern that covers every text."""
    return f"""{name}_cut AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS x FROM docs)),
{name} AS MATERIALIZED (SELECT doc_id, k, piece, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {name}_cut)"""


def within(points: str, spans: str, columns: str) -> str:
    """The points of a document with the span that each lies in."""
    return f"SELECT p.*, {columns} FROM {points} p ASOF JOIN {spans} s ON p.doc_id = s.doc_id AND p.start >= s.start WHERE p.start < s.stop"


WORDS = f"""{DOCS}, {placed('words', r'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')},
pronouns AS (SELECT doc_id, start, piece AS surface FROM words WHERE {_in('he she they him her them his their it its')}),
mentions AS (SELECT doc_id, start, piece AS surface FROM words WHERE regexp_full_match(piece, '[A-Z][a-z]{{3,}}')),
verbs AS (SELECT doc_id, start, piece AS surface FROM words WHERE regexp_full_match(piece, '[a-z]+(ed|ing)|is|are|was|were|be|has|have|had|said'))"""
SENTENCES = f"""{placed('lines', r'[^.!?\n]*[.!?\n]|[^.!?\n]+')},
bounds AS (SELECT doc_id, start + CASE WHEN k > 0 THEN length(regexp_extract(piece, '^[{SPACE}]+')) ELSE 0 END AS start, start + length(piece) - CASE WHEN right(piece, 1) = chr(10) THEN 1 ELSE 0 END AS stop FROM lines),
sentences AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS sentence, start, stop FROM bounds WHERE stop > start)"""
CLAUSES = f"""{placed('marks', '[;:—–]|[^;:—–]+')}, {placed('joints', ' and | but | yet |[^ ]+| ')},
cuts AS (SELECT doc_id, start + 1 AS start FROM marks WHERE regexp_full_match(piece, '[;:—–]') UNION SELECT doc_id, start FROM joints WHERE piece IN (' and ', ' but ', ' yet ')),
begins AS (SELECT doc_id, sentence, start, stop FROM sentences UNION {within('cuts', 'sentences', 's.sentence, s.stop').replace('p.*, s.sentence, s.stop', 'p.doc_id, s.sentence, p.start, s.stop')}),
clauses AS MATERIALIZED (SELECT doc_id, sentence, row_number() OVER w - 1 AS clause, start, CAST(coalesce(lead(start) OVER w, stop) AS BIGINT) AS stop FROM begins WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY start))"""
_near = f"""asked AS ({within('pronouns', 'sentences', 's.sentence')}), named AS ({within('mentions', 'sentences', 's.sentence')}),
last_named AS (SELECT doc_id, sentence, arg_max(surface, start) AS mention FROM named GROUP BY 1, 2),
met AS (SELECT a.doc_id, a.start, arg_min(mention, a.sentence - n.sentence) AS mention FROM asked a JOIN last_named n ON n.doc_id = a.doc_id AND a.sentence - n.sentence BETWEEN 0 AND 2 GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "text_sentences": f"WITH {DOCS}, {SENTENCES} SELECT doc_id, sentence, start, stop AS \"end\" FROM sentences",
        "text_clauses": f"WITH {DOCS}, {SENTENCES}, {CLAUSES} SELECT doc_id, sentence, clause, start, stop AS \"end\" FROM clauses WHERE stop > start",
        "text_time_markers": f"WITH {WORDS} SELECT doc_id, 'time' AS label, start, CAST(start + length(piece) AS BIGINT) AS \"end\", piece AS surface FROM words WHERE {_in('before after then when while until today yesterday tomorrow')}",
        "text_references": f"WITH {WORDS}, {SENTENCES}, {_near} SELECT a.doc_id, a.start, surface, coalesce(mention, 'unknown_' || count(*) FILTER (mention IS NULL) OVER (PARTITION BY a.doc_id ORDER BY a.start)) AS refers_to FROM asked a LEFT JOIN met m ON m.doc_id = a.doc_id AND m.start = a.start",
        "text_frames": f"""WITH {WORDS}, {SENTENCES}, {CLAUSES}, v AS ({within('verbs', 'clauses', 's.sentence, s.clause')}), m AS ({within('mentions', 'clauses', 's.sentence, s.clause')})
SELECT v.doc_id, v.sentence, v.clause, v.start, v.surface AS verb, arg_max(m.surface, m.start) FILTER (m.start < v.start) AS actor, arg_min(m.surface, m.start) FILTER (m.start > v.start) AS object
FROM v LEFT JOIN m ON m.doc_id = v.doc_id AND m.sentence = v.sentence AND m.clause = v.clause GROUP BY ALL""",
        "text_utterances": f"""WITH {DOCS}, q_cut AS (SELECT doc_id, text, unnest(range(len(x))) AS k, unnest(x) AS piece, len(x) AS n FROM (SELECT doc_id, text, string_split(text, '"') AS x FROM docs)),
q AS (SELECT *, CAST(coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM q_cut)
SELECT doc_id, start, CAST(start + length(piece) AS BIGINT) AS "end", trim(piece) AS quote, coalesce(list_extract(list_filter(regexp_extract_all(substr(text, greatest(start - 120, 1), least(start, 120)), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{3,}}')), -1), 'unknown') AS speaker, ends_with(trim(piece), '?') AS asks FROM q WHERE k > 0 AND k < n - 1 AND piece <> ''""",
    }
