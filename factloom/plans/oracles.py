"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from factloom.sources.records import ACTIONS, STATES

#: Fixed values of the rules, written out again so that a slip in the operators shows.
SECURITY_WORDS = ["access", "secret", "key", "token", "credential"]
POLICY_PHRASES = ["must never appear in source", "must never be in source", "must never in source", "must never appear in repo", "must never be in repo", "must be never in source", "never in source"]
SOURCE_WORDS = ["source", "repo", "repository", "commit", "committed"]
FORWARD, INVERSE = ["before", "prior to"], ["after", "following"]
TYPE_TERMS = {"Access": ["access", "login"], "Config": ["config", "configuration", "environment"], "Deployment": ["deployment", "deploy"], "Leak": ["leak", "breach", "exposed"], "PolicyChange": ["policy", "policy change"], "Rotation": ["rotation", "rotate", "rotated"]}
LANGUAGE_WORDS = {"fr": ["accord", "confidentielle", "juridiction", "loi", "partie"], "de": ["vereinbarung", "vertraulich", "gerichtsstand", "recht", "partei"], "es": ["acuerdo", "confidencial", "jurisdiccion", "ley", "parte"], "en": ["agreement", "confidential", "jurisdiction", "law", "party"]}
MAX_CHARS, OVERLAP = 1200, 120
STEP = MAX_CHARS - OVERLAP
FIELDS = ["type", "kind", "value", "object", "actor", "action", "state"]
KEYWORDS, TOPK, CUTOFF = ["the", "and"], 50, "2024-01-15 00:00:00"
FOCUS_TOKENS, FOCUS_TYPES = ["deployment", "obj_1"], ["Deployment"]
#: What a sentence must hold, by language and clause, written out again.
RULES = {
    "en": [("confidentiality_obligations", "confidential", "shall|must|agree"), ("term_duration", "term|duration", ""), ("exceptions", "exception", ""), ("return_or_destruction", "return|destroy", ""), ("governing_law", "governed by", ""), ("jurisdiction", "jurisdiction", ""), ("definition_of_confidential_information", "confidential information", "means|includes")],
    "fr": [("confidentialite", "confidenti", "doit|s''engage|obligation"), ("duree", "dur[ée]e|terme", ""), ("exceptions", "exception", ""), ("restitution", "restituer|d[ée]truire|retourner", ""), ("loi_applicable", "loi applicable|r[ée]gie par", ""), ("juridiction", "juridiction|tribunaux comp[ée]tents", ""), ("definition_information_confidentielle", "information confidentielle", "d[ée]signe|s''entend|signifie")],
    "de": [("vertraulichkeitspflichten", "vertraulich", "muss|verpflichtet|pflicht"), ("laufzeit", "laufzeit|dauer", ""), ("ausnahmen", "ausnahmen?", ""), ("rueckgabe", "zur[üu]ckgeben|vernichten", ""), ("anwendbares_recht", "gilt .* recht|geltet .* recht|anwendbares recht", ""), ("gerichtsstand", "gerichtsstand|zust[äa]ndige gerichte", ""), ("definition_vertrauliche_informationen", "vertrauliche informationen", "bedeutet|umfasst|sind")],
    "es": [("obligaciones_confidencialidad", "confidencial", "deber[aá]|obligaci[oó]n|se compromete"), ("vigencia", "vigencia|duraci[oó]n", ""), ("excepciones", "excepciones?", ""), ("devolucion", "devolver|destruir", ""), ("ley_aplicable", "ley aplicable|regir[aá]", ""), ("jurisdiccion", "jurisdicci[oó]n|tribunales competentes", ""), ("definicion_informacion_confidencial", "informaci[oó]n confidencial", "significa|incluye|se entiende")],
}


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


DOCS = """docs AS (SELECT doc_id, coalesce(text, '') AS text, 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS relpath FROM documents)"""
CHUNKS = f"""{DOCS}, chunks AS (
  SELECT doc_id, relpath, CAST(i AS INTEGER) AS "index", CAST(i * {STEP} AS INTEGER) AS offset_start, CAST(least(i * {STEP} + {MAX_CHARS}, length(text)) AS INTEGER) AS offset_end,
         substr(text, i * {STEP} + 1, {MAX_CHARS}) AS text
  FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(length(text) - {MAX_CHARS}, 0) / {STEP}) AS BIGINT) + 1)) AS i FROM docs)),
named AS (SELECT *, 'chunk:' || sha256(text) AS chunk_id FROM chunks)"""
_prop = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
CLAIMS = f"""lines AS (SELECT doc_id, source, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS object FROM documents),
claims AS (
  SELECT l.doc_id, line_no, source AS subject, 'states' AS predicate, object, CASE WHEN toxic = 1 THEN 'deny' ELSE 'affirm' END AS polarity, 'assert' AS modality
  FROM lines l LEFT JOIN labels USING (doc_id) WHERE trim(object) <> ''),
keyed AS (
  SELECT *, 'claim:' || sha256(concat_ws('|', subject, predicate, object, polarity, modality)) AS claim_id,
         sha256(concat_ws('|', {_prop('subject')}, {_prop('predicate')}, {_prop('object')})) AS proposition FROM claims),
prints AS (SELECT *, sha256(concat_ws('|', proposition, polarity, modality)) AS fingerprint FROM keyed)"""


def event_type(a: str) -> str:
    low = f"lower({a})"
    secret = f"({any_of(a, ['API_', 'KEY', 'TOKEN', 'SECRET'])} OR {any_of(low, ['key', 'secret', 'token', 'credential'])})"
    rules = [
        (any_of(low, ["never in source", "do not commit"]), "PolicyChange"),
        (f"{secret} AND {any_of(low, ['leak', 'exposed', 'breach'])}", "Leak"),
        (secret, "Config"),
        (any_of(low, ["rotate", "rotation"]), "Rotation"),
        (any_of(low, ["deploy", "released", "rollout"]), "Deployment"),
        (any_of(low, ["access", "login", "logged in"]), "Access"),
        (any_of(low, ["leak", "exposed", "breach", "committed", "source control"]), "Leak"),
        (any_of(low, ["policy"]), "PolicyChange"),
        (any_of(low, ["config", "environment", "env-only"]), "Config"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in rules) + " ELSE 'Other' END"


_actions = ", ".join("replace('" + a + "', '{}', object)" for a in ACTIONS)
_states = ", ".join(f"'{x}'" for x in STATES)
EVENTS = f"""raw AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
named_raw AS (SELECT *, 'OBJ_' || (k % 8) AS object, CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN 'date' ELSE 'instant' END AS kind FROM raw),
acted AS (SELECT *, list_extract([{_actions}], CAST(event_id % 8 AS BIGINT) + 1) AS action FROM named_raw),
world AS (
  SELECT user_id AS case_id, event_id, {event_type('action')} AS type, kind,
         CASE kind WHEN 'date' THEN strftime(ts, '%Y-%m-%d') WHEN 'instant' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS value,
         object, CASE WHEN event_id % 7 <> 0 THEN 'user_' || user_id END AS actor, action, list_extract([{_states}], CAST((event_id + k) % 4 AS BIGINT) + 1) AS state FROM acted)"""
NOTES = f"""{EVENTS}, notes AS (
  SELECT case_id, event_id % 3 AS source_id, event_id * 2 + 1 AS line_no, '- ' || coalesce(value || ' ', '') || CASE WHEN event_id % 2 = 0 THEN replace(action, object, '`' || object || '`') ELSE action END AS line FROM world
  UNION ALL SELECT case_id, event_id % 3, event_id * 2, CASE WHEN event_id % 25 = 0 THEN '## Access Policy ' || (event_id % 4) ELSE '# Log ' || object END FROM world WHERE event_id % 5 = 0),
found AS (SELECT case_id, source_id * 1000000000000 + line_no AS spot, 'heading' AS k, regexp_extract(line, '^#+ (.*)$', 1) AS name FROM notes WHERE line[1] = '#'
  UNION ALL SELECT case_id, source_id * 1000000000000 + line_no, 'secret', unnest(regexp_extract_all(line, '`([^`]+)`', 1)) FROM notes
  UNION ALL SELECT case_id, source_id * 1000000000000 + line_no, 'caps', unnest(regexp_extract_all(line, '\\b[A-Z][A-Z0-9_]{{2,}}\\b')) FROM notes),
firsts AS (SELECT case_id, name, min(spot) FILTER (k = 'heading') AS heading, min(spot) FILTER (k = 'secret') AS secret, min(spot) FILTER (k = 'caps') AS caps FROM found GROUP BY ALL),
typed AS (SELECT case_id, name, CASE WHEN contains(lower(name), 'policy') THEN 'Policy' ELSE 'Concept' END AS type FROM firsts WHERE heading IS NOT NULL
  UNION SELECT case_id, name, 'Secret' FROM firsts WHERE secret IS NOT NULL UNION SELECT case_id, name, 'Concept' FROM firsts WHERE caps IS NOT NULL AND (secret IS NULL OR caps < secret)),
ents AS (SELECT case_id, 'entity:' || sha256(type || '|' || name || '|') AS entity_id, type, name FROM typed),
acts AS (SELECT case_id, line[3:] AS action, count(DISTINCT source_id) AS n_evidence FROM notes WHERE line[1] = '-' GROUP BY ALL),
objs AS (SELECT a.case_id, action, list_sort(list(DISTINCT entity_id)) AS objects, list_sort(list(DISTINCT name) FILTER (type = 'Secret')) AS secrets FROM acts a JOIN ents e ON a.case_id = e.case_id AND contains(lower(action), lower(name)) GROUP BY ALL),
said AS (SELECT a.case_id, a.action, n_evidence, {event_type('a.action')} AS type, coalesce(objects, []) AS objects, secrets, regexp_extract(a.action, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}Z') AS instant, regexp_extract(a.action, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS day,
    CASE WHEN {any_of('lower(a.action)', ['never in source', 'never in repo'])} THEN 'never-in-repo' WHEN {any_of('lower(a.action)', ['environment only', 'env-only'])} THEN 'env-only' END AS says
  FROM acts a LEFT JOIN objs o ON a.case_id = o.case_id AND a.action = o.action),
proposed AS (SELECT *, CASE WHEN instant <> '' THEN 'instant' WHEN day <> '' THEN 'date' ELSE 'unknown' END AS kind, nullif(CASE WHEN instant <> '' THEN instant ELSE day END, '') AS value,
    CASE WHEN len(secrets) > 0 AND says IS NOT NULL THEN '{{' || array_to_string(list_transform(secrets, lambda x: '"' || x || '":"' || says || '"'), ',') || '}}' END AS state FROM said)"""
NEWER = f"""{EVENTS}, newer AS (
  SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN action || ' again' ELSE action END AS action) FROM world WHERE event_id % 11 <> 0
  UNION ALL SELECT * REPLACE (event_id + 1000000000 AS event_id) FROM world WHERE event_id % 17 = 0)"""
_torn = "(bool_or(state = 'active') AND bool_or(state = 'destroyed')) OR (bool_or(state = 'enabled') AND bool_or(state = 'disabled'))"
_score = " + ".join(f"CASE WHEN list_contains(string_split_regex(lower(action), '[^a-z0-9_]+'), '{t}') THEN 3 ELSE 0 END" for t in FOCUS_TOKENS)
_types = ", ".join(f"'{t}'" for t in FOCUS_TYPES)


def focus(source: str, name: str) -> str:
    return f"""{name}_torn AS (SELECT case_id, object, value FROM {source} WHERE kind <> 'unknown' GROUP BY ALL HAVING {_torn}),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, value ASC NULLS LAST, event_id) AS rank
  FROM (SELECT *, {_score} + CASE WHEN type IN ({_types}) THEN 2 ELSE 0 END AS score FROM {source})),
{name} AS (SELECT r.*, (t.object IS NOT NULL AND r.kind <> 'unknown') AS forced FROM {name}_ranked r LEFT JOIN {name}_torn t ON r.case_id = t.case_id AND r.object = t.object AND r.value = t.value
  WHERE rank <= 30 OR (t.object IS NOT NULL AND r.kind <> 'unknown'))"""


def named_in(text: str, type_col: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"({type_col} = '{t}' AND {any_of(text, [f'{p} {x}' for p in phrases for x in terms])})" for t, terms in TYPE_TERMS.items()) + ")"


_first = "(coalesce(a.value, '~') < coalesce(b.value, '~') OR (coalesce(a.value, '~') = coalesce(b.value, '~') AND a.event_id < b.event_id))"
_known = "a.kind <> 'unknown' AND b.kind <> 'unknown'"
_phrase = f"({named_in('lower(a.action)', 'b.type', FORWARD)} OR ({named_in('lower(b.action)', 'a.type', INVERSE)} AND NOT {named_in('lower(b.action)', 'a.type', FORWARD)}))"


def edges(source: str, name: str) -> str:
    pair = f"FROM {source} a JOIN {source} b ON a.case_id = b.case_id AND a.object = b.object AND a.event_id <> b.event_id"
    return f"""{name} AS (
  SELECT a.case_id, a.event_id AS a, b.event_id AS b, 'enables' AS type, 'RULE_SECRET_HANDLING_CAUSAL' AS reason {pair}
    WHERE {any_of('lower(a.action)', ['never in source', 'never in repo'])} AND {any_of('lower(b.action)', ['environment only', 'env-only'])}
  UNION ALL
  SELECT a.case_id, a.event_id, b.event_id, 'before', CASE WHEN a.type = 'PolicyChange' AND b.type = 'Config' AND {_known} AND {_first} THEN 'RULE_POLICY_PRECEDES_CONFIG' ELSE 'RULE_TIME_PHRASE_BEFORE' END {pair}
    WHERE (a.type = 'PolicyChange' AND b.type = 'Config' AND {_known} AND {_first}) OR {_phrase})"""


def violations(source: str, edge: str, name: str) -> str:
    torn = lambda x, y: f"SELECT case_id, 'STATE_CONFLICT' AS type, least(min(event_id) FILTER (state = '{x}'), min(event_id) FILTER (state = '{y}')) AS a, greatest(min(event_id) FILTER (state = '{x}'), min(event_id) FILTER (state = '{y}')) AS b FROM {source} WHERE kind <> 'unknown' GROUP BY case_id, object, value HAVING bool_or(state = '{x}') AND bool_or(state = '{y}')"
    return f"""{name} AS (
  SELECT a.case_id, 'POLICY_CONFLICT' AS type, a.event_id AS a, b.event_id AS b FROM {source} a JOIN {source} b ON a.case_id = b.case_id AND a.object = b.object AND a.event_id <> b.event_id
    WHERE a.type = 'PolicyChange' AND {any_of('lower(a.action)', POLICY_PHRASES)} AND {any_of('lower(b.action)', SOURCE_WORDS)}
  UNION ALL SELECT e.case_id, 'TEMPORAL_CONFLICT', e.a, e.b FROM {edge} e JOIN {source} x ON x.case_id = e.case_id AND x.event_id = e.a JOIN {source} y ON y.case_id = e.case_id AND y.event_id = e.b
    WHERE e.type = 'before' AND x.kind <> 'unknown' AND y.kind <> 'unknown' AND y.value < x.value
  UNION ALL {torn('active', 'destroyed')} UNION ALL {torn('enabled', 'disabled')})"""


WORLD = f"{EVENTS}, {focus('world', 'f')}, {edges('f', 'e')}, {violations('f', 'e', 'v')}"
CYCLES = """steps AS (SELECT case_id, a, b FROM e WHERE type = 'before'
  UNION SELECT a.case_id, a.event_id, b.event_id FROM f a JOIN f b ON a.case_id = b.case_id AND a.kind <> 'unknown' AND b.kind <> 'unknown' AND a.value < b.value WHERE a.case_id IN (SELECT case_id FROM e WHERE type = 'before')),
reach(case_id, a, b) AS (SELECT case_id, a, b FROM steps UNION SELECT r.case_id, r.a, s.b FROM reach r JOIN steps s ON r.case_id = s.case_id AND r.b = s.a)"""
HIERARCHY = """up AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation UNION ALL SELECT DISTINCT 'R' || n_regionkey, 'W0' FROM nation),
edges AS (SELECT 'C' || c_custkey AS a, 'N' || c_nationkey AS b, 'supports' AS type FROM customer UNION SELECT a, b, 'supports' FROM up
  UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'implies' FROM supplier UNION SELECT a, b, 'implies' FROM up)"""
APPLICANTS = """orders_of AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS late FROM orders GROUP BY 1),
applicants AS (SELECT c_custkey AS applicant_id, CASE WHEN c_custkey % 9 <> 0 THEN CAST(abs(floor(c_acctbal)) + 1 AS BIGINT) END AS income, coalesce(n, 0) * 97 AS debt, c_custkey * 37 % 400 + 450 AS score,
  coalesce(late, 0) AS delinquencies, c_custkey % 60 AS employment_months FROM customer LEFT JOIN orders_of ON c_custkey = o_custkey),
ratios AS (SELECT *, CAST(CASE WHEN coalesce(income, 0) = 0 THEN '0' ELSE replace(printf('%.2f', CAST(debt AS DOUBLE) / income), '.', '') END AS BIGINT) AS dti_percent FROM applicants),
credit AS (SELECT applicant_id, dti_percent, CASE WHEN dti_percent <= 55 THEN 'pass' ELSE 'fail' END AS dti_status, CASE WHEN delinquencies > 0 THEN 'caution' ELSE 'pass' END AS delinquency_status,
  CASE WHEN score < 640 THEN 'caution' ELSE 'pass' END AS score_status, CASE WHEN employment_months >= 24 THEN 'pass' ELSE 'caution' END AS employment_status,
  CASE WHEN score < 640 THEN 'subprime_tier3' ELSE 'prime_tier1' END AS risk_tier, CASE WHEN dti_percent <= 55 THEN 'approved_conditional' ELSE 'denied' END AS decision,
  CASE WHEN score < 640 THEN '0.089' ELSE '0.049' END AS rate FROM ratios)"""
PATIENTS = """patients AS (SELECT o_orderkey AS patient_id, CASE WHEN o_orderkey % 21 <> 0 THEN CAST(o_orderdate AS DATE) END AS encounter, o_orderkey % 80 + 100 AS systolic, o_orderkey * 7 % 50 + 60 AS diastolic,
  o_custkey % 70 + 20 AS age, o_custkey % 3 = 0 AS family_history,
  CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE 'headache, dizziness' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' for ' || (o_orderkey % 9 + 1) || ' days' END END AS complaint FROM orders)"""
CONTRACTS = """contracts AS (SELECT o_orderkey AS contract_id, strftime(o_orderdate, '%Y-%m-%d') AS day, n_name, o_orderkey % 5 <> 0 AS has_law, o_orderkey % 3 = 0 AS has_end,
  'Supplier ' || (o_orderkey % 100) || ' Ltd' AS licensor, 'Customer ' || o_custkey || ' Inc' AS licensee FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SEALS = f"""{DOCS}, sealed AS (SELECT doc_id, text, sha256('{{"doc_id":' || doc_id || ',"relpath":"' || relpath || '","sha256":"' || sha256(text) || '"}}') AS bundle_sha256, sha256(text) AS output_sha256 FROM docs)"""
_key = "case_id, event_id"
_changed = ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in FIELDS)
_unknowns = lambda source, obj: f"""SELECT case_id, event_id, 'missing_time' AS unknown FROM {source} WHERE kind = 'unknown'
  UNION ALL SELECT case_id, event_id, 'missing_actor' FROM {source} WHERE actor IS NULL AND (type <> 'Other' OR {any_of('lower(action)', SECURITY_WORDS)})
  UNION ALL SELECT case_id, event_id, 'missing_object' FROM {source} WHERE {obj} IS NULL"""  # noqa: E731
_entities = lambda source: f"SELECT case_id, 'System' AS type, object AS name, count(*) AS n_events, min(event_id) AS first_event FROM {source} WHERE object IS NOT NULL GROUP BY ALL UNION ALL SELECT case_id, 'Person', actor, count(*), min(event_id) FROM {source} WHERE actor IS NOT NULL GROUP BY ALL"
_fan = """SELECT case_id, event_id, (SELECT count(*) FROM world b WHERE b.case_id = a.case_id AND b.kind <> 'unknown' AND b.value > a.value) AS fan_out FROM world a WHERE kind <> 'unknown'"""
_both = lambda columns, old, new: f"o AS (SELECT {columns} FROM ({old})), n AS (SELECT {columns} FROM ({new})) SELECT *, 'removed' AS status FROM (FROM o EXCEPT FROM n) UNION ALL SELECT *, 'added' FROM (FROM n EXCEPT FROM o)"
_conflicts = lambda source: f"SELECT case_id, object, value, array_to_string(list_sort(list(DISTINCT state)), ',') AS states FROM {source} WHERE kind <> 'unknown' AND state IS NOT NULL GROUP BY case_id, object, value HAVING {_torn}"
_relations = lambda source: f"SELECT case_id, from_id, to_id, CASE WHEN value = to_value THEN 'same_time' ELSE 'before' END AS relation FROM (SELECT case_id, event_id AS from_id, value, lead(event_id) OVER w AS to_id, lead(value) OVER w AS to_value FROM {source} WHERE kind <> 'unknown' WINDOW w AS (PARTITION BY case_id ORDER BY value, event_id)) WHERE to_id IS NOT NULL"
_votes = ", ".join(f"len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: list_contains([{', '.join(repr(w) for w in words)}], x))) AS n_{k}" for k, words in LANGUAGE_WORDS.items())
_best = "greatest(" + ", ".join(f"n_{k}" for k in LANGUAGE_WORDS) + ")"
_pick = " ".join(f"WHEN n_{k} = {_best} THEN '{k}'" for k in LANGUAGE_WORDS)
_clauses = " UNION ALL ".join(
    f"SELECT doc_id, lang, '{name}' AS clause, min(position) AS sentence FROM sentences WHERE lang = '{lang}' AND regexp_matches(sentence, '{first}') AND regexp_matches(sentence, '{second}') GROUP BY doc_id, lang" for lang, rules in RULES.items() for name, first, second in rules
)

_verdicts = f"""{CYCLES}, secure AS (SELECT DISTINCT case_id FROM f WHERE (kind = 'unknown' OR actor IS NULL) AND {any_of('lower(action)', SECURITY_WORDS)}),
  reasons AS (SELECT DISTINCT case_id, 'RULE_CONSTRAINT_VIOLATION' AS reason FROM v UNION SELECT case_id, 'RULE_CAUSAL_TEMPORAL_CYCLE' FROM reach WHERE a = b UNION SELECT case_id, 'RULE_WORLD_UNKNOWNS_SECURITY' FROM secure),
  by_case AS (SELECT case_id, array_to_string(list_sort(list(reason)), ',') AS reasons, bool_or(reason <> 'RULE_WORLD_UNKNOWNS_SECURITY') AS failed FROM reasons GROUP BY 1),
  verdicts AS (SELECT c.case_id, CASE WHEN failed THEN 'FAIL' WHEN reasons IS NOT NULL THEN 'NEEDS_INFO' ELSE 'OK' END AS status, coalesce(reasons, '') AS reasons FROM (SELECT DISTINCT case_id FROM f) c LEFT JOIN by_case b ON b.case_id = c.case_id)"""
_n = lambda source, name: f"{name} AS (SELECT case_id, count(*) AS n FROM ({source}) GROUP BY 1)"

SQL = {
    "constraint_narrative": f"""WITH {WORLD}, ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY type, a, b) AS rank FROM v),
      made AS (SELECT case_id, count(*) AS n, count(*) FILTER (type = 'POLICY_CONFLICT') AS p, count(*) FILTER (type = 'TEMPORAL_CONFLICT') AS t, count(*) FILTER (type = 'STATE_CONFLICT') AS s,
        string_agg('- ' || type || ': ' || a || ', ' || b, chr(10) ORDER BY rank) FILTER (rank <= 4) AS lines FROM ranked GROUP BY 1)
      SELECT case_id, 'Constraint Summary' || chr(10) || 'Violations: ' || n || chr(10) || 'Policy: ' || p || chr(10) || 'Temporal: ' || t || chr(10) || 'Causal: 0' || chr(10) || 'State: ' || s || chr(10) || chr(10) || 'Violations' || chr(10) || lines AS text FROM made""",
    "casefile_summary": f"""WITH RECURSIVE {WORLD}, {_verdicts}, {_n(_entities('f'), 'n1')}, {_n('SELECT case_id FROM f', 'n2')}, {_n(_unknowns('f', 'object'), 'n3')}, {_n("SELECT case_id FROM f GROUP BY case_id, object HAVING count(DISTINCT state) > 1", 'n4')}, {_n('SELECT case_id FROM v', 'n5')}, {_n('SELECT case_id FROM e', 'n6')},
      c AS (SELECT d.case_id, status, coalesce(n1.n, 0) AS n_entities, coalesce(n2.n, 0) AS n_events, coalesce(n3.n, 0) AS n_unknowns, coalesce(n4.n, 0) AS n_conflicts, coalesce(n5.n, 0) AS n_violations, coalesce(n6.n, 0) AS n_edges
        FROM verdicts d LEFT JOIN n1 ON n1.case_id = d.case_id LEFT JOIN n2 ON n2.case_id = d.case_id LEFT JOIN n3 ON n3.case_id = d.case_id LEFT JOIN n4 ON n4.case_id = d.case_id LEFT JOIN n5 ON n5.case_id = d.case_id LEFT JOIN n6 ON n6.case_id = d.case_id)
      SELECT *, sha256(concat_ws('|', status, n_entities, n_events, n_unknowns, n_conflicts, n_violations, n_edges)) AS casefile_sha256 FROM c""",
    "repair_actions": f"""WITH RECURSIVE {WORLD}, {_verdicts} SELECT case_id, 'ADD_WORLD_ENRICHMENT' AS kind, 'low' AS risk, CAST(10 AS BIGINT) AS priority FROM verdicts WHERE status = 'NEEDS_INFO'
      UNION ALL SELECT case_id, 'APPLY_WORLD_PATCH', 'high', 20 FROM verdicts WHERE status = 'FAIL' AND contains(reasons, 'RULE_CONSTRAINT_VIOLATION')
      UNION ALL SELECT case_id, 'APPLY_WORLD_PATCH', 'high', 25 FROM verdicts WHERE status = 'FAIL' AND contains(reasons, 'RULE_CAUSAL_TEMPORAL_CYCLE')""",
    "doc_inventory": f"WITH {DOCS} SELECT relpath, 'doc:' || sha256(text) AS doc_key, CAST(strlen(text) AS BIGINT) AS bytes FROM docs",
    "chunk_documents": f'WITH {CHUNKS} SELECT doc_id, "index", offset_start, offset_end, chunk_id FROM named',
    "chunks_keyword": f'WITH {CHUNKS} SELECT doc_id, "index", chunk_id FROM named WHERE ' + " AND ".join(f"contains(lower(text), '{t}')" for t in KEYWORDS),
    "evidence_topk_chunks": f"""WITH {CHUNKS}, scored AS (SELECT *, CAST({' + '.join(f"(length(text) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in KEYWORDS)} AS BIGINT) AS score FROM named)
      SELECT doc_id, relpath, "index", offset_start, offset_end, chunk_id, score FROM scored WHERE score > 0 ORDER BY score DESC, relpath, doc_id, "index", chunk_id LIMIT {TOPK}""",
    "claim_fingerprints": f"WITH {CLAIMS} SELECT doc_id, line_no, claim_id, fingerprint FROM prints",
    "claim_duplicates": f"WITH {CLAIMS}, ranked AS (SELECT doc_id, line_no, first_value(doc_id) OVER w AS first_doc, first_value(line_no) OVER w AS first_line, row_number() OVER w AS r FROM prints WINDOW w AS (PARTITION BY fingerprint ORDER BY doc_id, line_no)) SELECT doc_id, line_no, first_doc, first_line FROM ranked WHERE r > 1",
    "claim_duplicate_groups": f"WITH {CLAIMS} SELECT fingerprint, count(*) AS n_claims, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM prints GROUP BY 1 HAVING count(*) > 1",
    "claim_contradictions": f"WITH {CLAIMS} SELECT proposition, count(*) FILTER (polarity = 'affirm') AS n_affirm, count(*) FILTER (polarity = 'deny') AS n_deny, min(claim_id) FILTER (polarity = 'affirm') AS affirm_id, min(claim_id) FILTER (polarity = 'deny') AS deny_id, count(*) FILTER (polarity = 'affirm') * count(*) FILTER (polarity = 'deny') AS n_pairs FROM keyed GROUP BY 1 HAVING count(*) FILTER (polarity = 'affirm') > 0 AND count(*) FILTER (polarity = 'deny') > 0",
    "claim_support_edges": f"WITH {CLAIMS}, chain AS (SELECT doc_id, claim_id AS from_id, lead(claim_id) OVER w AS to_id, CAST(row_number() OVER w AS INTEGER) AS seq FROM keyed WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) SELECT * FROM chain WHERE to_id IS NOT NULL AND seq <= 50",
    "bullet_claims": f"""WITH {EVENTS}, lines AS (SELECT case_id, event_id * 2 AS line_no, 'Log ' || event_id AS heading, NULL AS object FROM world WHERE event_id % 5 = 0 UNION ALL SELECT case_id, event_id * 2 + 1, NULL, action FROM world),
      carried AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'Document') AS subject FROM lines)
      SELECT case_id, subject, object, CAST(row_number() OVER (PARTITION BY case_id ORDER BY line_no) - 1 AS INTEGER) AS line_order FROM carried WHERE object IS NOT NULL""",
    "claim_closure": f"""WITH RECURSIVE {HIERARCHY}, paths AS (SELECT type, a, b, [a, b] AS path FROM edges UNION ALL SELECT p.type, p.a, e.b, list_append(path, e.b) FROM paths p JOIN edges e ON p.type = e.type AND p.b = e.a WHERE len(path) < 6),
      best AS (SELECT type, a, b, min(struct_pack(n := len(path), p := path)) AS s FROM paths WHERE a <> b GROUP BY ALL) SELECT type, a, b, CAST(s.n - 1 AS BIGINT) AS n_edges, array_to_string(s.p, '>') AS via FROM best WHERE s.n > 2""",
    "support_tree": f"WITH RECURSIVE {HIERARCHY}, steps AS (SELECT DISTINCT a, b FROM edges), found(node, depth) AS (SELECT 'R1', CAST(0 AS BIGINT) UNION SELECT a, depth + 1 FROM found JOIN steps ON b = node WHERE depth < 6) SELECT node, min(depth) AS depth FROM found WHERE depth > 0 GROUP BY 1",
    "event_types": f"WITH {EVENTS} SELECT type, kind, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM world GROUP BY ALL",
    "world_entities": f"WITH {EVENTS} {_entities('world')}",
    "world_relations": f"WITH {EVENTS}, nxt AS (SELECT case_id, event_id AS from_id, value, lead(event_id) OVER w AS to_id, lead(value) OVER w AS to_value FROM world WHERE kind <> 'unknown' WINDOW w AS (PARTITION BY case_id ORDER BY value, event_id)) SELECT case_id, from_id, to_id, CASE WHEN value = to_value THEN 'same_time' ELSE 'before' END AS relation FROM nxt WHERE to_id IS NOT NULL",
    "world_unknowns": f"WITH {EVENTS} {_unknowns('world', 'object')}",
    "world_state_conflicts": f"WITH {EVENTS} SELECT case_id, object, value, array_to_string(list_sort(list(DISTINCT state)), ',') AS states, count(*) AS n_events FROM world WHERE kind <> 'unknown' GROUP BY case_id, object, value HAVING {_torn}",
    "world_value_conflicts": f"WITH {EVENTS} SELECT case_id, object, count(DISTINCT state) AS n_states, count(*) AS n_events FROM world GROUP BY ALL HAVING count(DISTINCT state) > 1",
    "event_focus_topk": f"WITH {EVENTS}, {focus('world', 'f')} SELECT case_id, event_id, CAST(score AS BIGINT) AS score, rank, forced FROM f",
    "causal_before_edges": f"WITH {EVENTS}, {focus('world', 'f')} SELECT a.case_id, a.event_id AS a, b.event_id AS b FROM f a JOIN f b ON a.case_id = b.case_id AND a.kind <> 'unknown' AND b.kind <> 'unknown' AND a.value < b.value",
    "causal_fan_out": f"WITH {EVENTS} {_fan}",
    "critical_events": f"WITH {EVENTS}, fan AS ({_fan}), ranked AS (SELECT case_id, event_id, fan_out * 11 AS score, row_number() OVER (PARTITION BY case_id ORDER BY fan_out DESC, event_id) AS rank FROM fan) SELECT * FROM ranked WHERE rank <= 5",
    "causal_typed_edges": f"WITH {WORLD} SELECT * FROM e",
    "causal_cycle_nodes": f"WITH RECURSIVE {WORLD}, {CYCLES} SELECT case_id, a AS node FROM reach WHERE a = b",
    "constraint_violations": f"WITH {WORLD} SELECT * FROM v",
    "constraint_counts": f"WITH {WORLD} SELECT case_id, count(*) AS n, count(*) FILTER (type = 'POLICY_CONFLICT') AS policy_conflict, count(*) FILTER (type = 'TEMPORAL_CONFLICT') AS temporal_conflict, count(*) FILTER (type = 'CAUSAL_CONFLICT') AS causal_conflict, count(*) FILTER (type = 'STATE_CONFLICT') AS state_conflict FROM v GROUP BY 1",
    "repair_hints": f"""WITH {WORLD}, t AS (SELECT v.*, x.type AS a_type, y.type AS b_type FROM v JOIN f x ON x.case_id = v.case_id AND x.event_id = v.a JOIN f y ON y.case_id = v.case_id AND y.event_id = v.b)
      SELECT case_id, type, a, b, CASE type WHEN 'POLICY_CONFLICT' THEN 'DROP_EVENT' WHEN 'TEMPORAL_CONFLICT' THEN 'DROP_EDGE' ELSE 'SPLIT_ENTITY' END AS action, 'medium' AS risk,
        CASE WHEN type = 'POLICY_CONFLICT' THEN CASE WHEN a_type <> 'PolicyChange' AND b_type <> 'PolicyChange' THEN least(a, b) WHEN a_type <> 'PolicyChange' THEN a WHEN b_type <> 'PolicyChange' THEN b ELSE least(a, b) END ELSE least(a, b) END AS target FROM t
      UNION ALL SELECT case_id, type, a, b, CASE type WHEN 'POLICY_CONFLICT' THEN 'NARROW_SCOPE' ELSE 'MARK_TIME_UNKNOWN' END, 'low', CASE WHEN type = 'TEMPORAL_CONFLICT' THEN b ELSE least(a, b) END FROM t""",
    "verify_cases": f"""WITH RECURSIVE {WORLD}, {CYCLES}, secure AS (SELECT DISTINCT case_id FROM f WHERE (kind = 'unknown' OR actor IS NULL) AND {any_of('lower(action)', SECURITY_WORDS)}),
      reasons AS (SELECT DISTINCT case_id, 'RULE_CONSTRAINT_VIOLATION' AS reason FROM v UNION SELECT case_id, 'RULE_CAUSAL_TEMPORAL_CYCLE' FROM reach WHERE a = b UNION SELECT case_id, 'RULE_WORLD_UNKNOWNS_SECURITY' FROM secure),
      by_case AS (SELECT case_id, array_to_string(list_sort(list(reason)), ',') AS reasons, bool_or(reason <> 'RULE_WORLD_UNKNOWNS_SECURITY') AS failed FROM reasons GROUP BY 1)
      SELECT c.case_id, CASE WHEN failed THEN 'FAIL' WHEN reasons IS NOT NULL THEN 'NEEDS_INFO' ELSE 'OK' END AS status, coalesce(reasons, '') AS reasons FROM (SELECT DISTINCT case_id FROM f) c LEFT JOIN by_case b ON b.case_id = c.case_id""",
    "world_diff_events": f"""WITH {NEWER}, d AS (SELECT coalesce(o.case_id, n.case_id) AS case_id, coalesce(o.event_id, n.event_id) AS event_id, CASE WHEN o.event_id IS NULL THEN 'added' WHEN n.event_id IS NULL THEN 'removed' ELSE 'changed' END AS status,
        CASE WHEN o.event_id IS NOT NULL AND n.event_id IS NOT NULL THEN array_to_string(list_filter([{_changed}], lambda x: x IS NOT NULL), ',') ELSE '' END AS fields FROM world o FULL JOIN newer n ON o.case_id = n.case_id AND o.event_id = n.event_id)
      SELECT * FROM d WHERE status <> 'changed' OR fields <> ''""",
    "world_diff_entities": f"WITH {NEWER}, bare AS (SELECT * REPLACE (nullif(object, 'OBJ_1') AS object) FROM newer), {_both('case_id, type, name', _entities('world'), _entities('bare'))}",
    "world_diff_unknowns": f"WITH {NEWER}, {_both('case_id, event_id, unknown', _unknowns('world', 'object'), _unknowns('newer', 'object'))}",
    "world_diff_conflicts": f"WITH {NEWER}, {_both('case_id, object, value, states', _conflicts('world'), _conflicts('newer'))}",
    "world_diff_relations": f"WITH {NEWER}, {_both('case_id, from_id, to_id, relation', _relations('world'), _relations('newer'))}",
    "constraint_diff": f"""WITH {NEWER}, {focus('world', 'f')}, {edges('f', 'e')}, {violations('f', 'e', 'v')}, {focus('newer', 'g')}, {edges('g', 'e2')}, {violations('g', 'e2', 'w')}
      SELECT *, 'removed' AS status FROM (SELECT DISTINCT * FROM v EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'added' FROM (SELECT DISTINCT * FROM w EXCEPT SELECT * FROM v)""",
    "counterfactual_unknowns": f"WITH {EVENTS} {_unknowns('world', '''nullif(object, 'OBJ_1')''')}",
    "world_patch": f"""WITH {EVENTS} SELECT case_id, event_id, type, CASE WHEN event_id % 23 = 0 THEN 'patched' ELSE action END AS action FROM world WHERE event_id % 19 <> 0
      UNION ALL SELECT case_id, event_id + 2000000000, type, action FROM world WHERE event_id % 29 = 0""",
    "world_proposed_entities": f"WITH {NOTES} SELECT * FROM ents",
    "world_proposed_events": f"""WITH {NOTES} SELECT case_id, 'event:' || sha256(concat_ws('|', type, kind, coalesce(value, ''), action, '', array_to_string(objects, '|'), coalesce(state, '{{}}'))) AS event_id, type, kind, value, action, CAST(len(objects) AS INTEGER) AS n_objects, state, n_evidence FROM proposed""",
    "world_mentions": f"WITH {NOTES} SELECT a.case_id, action, entity_id FROM acts a JOIN ents e ON a.case_id = e.case_id AND contains(lower(action), lower(name))",
    "world_enrich": f"""WITH {EVENTS} SELECT case_id, event_id, CASE WHEN kind = 'unknown' AND event_id % 4 = 0 THEN 'date' ELSE kind END AS kind, CASE WHEN kind = 'unknown' AND event_id % 4 = 0 THEN '2024-02-01' ELSE value END AS value,
      coalesce(actor, CASE WHEN event_id % 4 = 0 THEN 'auditor' END) AS actor, kind <> 'unknown' AND event_id % 4 = 0 AND value <> '2024-02-01' AS ordering_conflict FROM world""",
    "credit_decisions": f"WITH {APPLICANTS} SELECT * FROM credit",
    "clinical_screen": f"""WITH {PATIENTS} SELECT patient_id, CASE WHEN systolic >= 140 THEN 'elevated' ELSE 'normal' END AS systolic_status, CASE WHEN diastolic >= 90 THEN 'elevated' ELSE 'normal' END AS diastolic_status,
      CASE WHEN age >= 50 THEN 'moderate_risk' ELSE 'low_risk' END AS age_risk, CASE WHEN family_history THEN 'high_risk' ELSE 'low_risk' END AS family_risk, CASE WHEN systolic >= 140 OR diastolic >= 90 THEN 'positive_screen_hypertension' ELSE 'negative_screen' END AS assessment,
      coalesce(strftime(encounter + 30, '%Y-%m-%d'), '{{missing:next_assessment_date}}') AS next_assessment, 'BP ' || systolic || '/' || diastolic || ' mmHg' AS bp_text FROM patients""",
    "clinical_symptoms": f"""WITH {PATIENTS}, parts AS (SELECT patient_id, complaint, unnest(string_split(complaint, ',')) AS part, unnest(range(len(string_split(complaint, ',')))) AS position FROM patients WHERE complaint <> '')
      SELECT patient_id, position, trim(string_split(trim(part), ' for ')[1]) AS symptom, TRY_CAST(nullif(regexp_extract(complaint, '([0-9]+)\\s*days', 1), '') AS BIGINT) AS duration_days FROM parts""",
    "language_votes": f"WITH {DOCS}, n AS (SELECT doc_id, {_votes} FROM docs) SELECT *, CASE WHEN {_best} = 0 THEN 'en' {_pick} END AS language FROM n",
    "nda_clauses": f"""WITH marked AS (SELECT doc_id, lang, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n\\n+') AS s FROM documents),
      kept AS (SELECT doc_id, lang, list_filter(s, lambda x: trim(x) <> '') AS s FROM marked),
      sentences AS (SELECT doc_id, lang, lower(unnest(s)) AS sentence, unnest(range(1, len(s) + 1)) AS position FROM kept) {_clauses}""",
    "contract_fields": f"""WITH {CONTRACTS} SELECT contract_id, day AS effective_date, CASE WHEN has_law THEN n_name END AS jurisdiction, CASE WHEN has_end THEN 'Either party may terminate this Agreement on notice.' END AS termination, CAST(1 AS BIGINT) AS n_terms,
      concat_ws(',', CASE WHEN NOT has_law THEN 'governing_law_not_found' END, CASE WHEN NOT has_end THEN 'termination_conditions_not_found' END) AS warnings FROM contracts""",
    "contract_obligations": f"""WITH {CONTRACTS} SELECT contract_id, CAST(1 AS BIGINT) AS position, licensor AS party, 'Licensor shall deliver the goods.' AS sentence FROM contracts
      UNION ALL SELECT contract_id, 2, licensee, 'Licensee must pay within thirty days.' FROM contracts""",
    "fact_validation": f"""WITH {APPLICANTS} SELECT applicant_id AS id, 'decision' AS key, CASE WHEN applicant_id % 6 = 0 THEN 'denied' ELSE upper(decision) END AS claimed, CASE WHEN applicant_id % 6 = 0 AND decision <> 'denied' THEN 'mismatch' ELSE 'ok' END AS verdict FROM credit
      UNION ALL SELECT applicant_id, 'risk_tier', risk_tier, 'ok' FROM credit UNION ALL SELECT applicant_id, 'colour', 'blue', 'unknown' FROM credit WHERE applicant_id % 4 = 0
      UNION ALL SELECT applicant_id, 'dti', (dti_percent + CASE WHEN applicant_id % 7 = 0 THEN 1 ELSE 0 END) || '.0', CASE WHEN applicant_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END FROM credit""",
    "answer_faults": r"""WITH a AS (SELECT doc_id AS id, 'Evidence: s' || (doc_id % 5) || CASE WHEN doc_id % 3 = 0 THEN ' cite #s1' ELSE '' END || '. ' || coalesce(text, '') AS answer FROM documents),
      must AS (SELECT doc_id AS id, 's' || (doc_id % 4) AS item FROM documents UNION SELECT doc_id, 's1' FROM documents),
      cited AS (SELECT DISTINCT id, unnest(regexp_extract_all(answer, '(?i)(?:evidence|cite)\s*[:#]\s*([A-Za-z0-9_-]+)', 1)) AS item FROM a)
      SELECT id, 'missing_citation' AS fault, item FROM (FROM must EXCEPT FROM cited) UNION ALL SELECT id, 'extra_citation', item FROM (FROM cited EXCEPT FROM must)
      UNION ALL SELECT id, 'forbidden_topic', 'Password' FROM a WHERE contains(lower(answer), 'password') UNION ALL SELECT id, 'forbidden_topic', 'THE' FROM a WHERE contains(lower(answer), 'the')""",
    "placeholder_render": f"WITH {APPLICANTS} SELECT applicant_id, 'Applicant ' || applicant_id || ': ' || decision || ', collateral ' || CASE WHEN applicant_id % 2 = 0 THEN 'house' ELSE '{{missing:collateral_type}}' END || '.' AS text FROM credit",
    "seal_cases": f"WITH {SEALS} SELECT doc_id, bundle_sha256, output_sha256, sha256(bundle_sha256 || '|' || output_sha256) AS attestation_sha256 FROM sealed",
    "replay_verify": "SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'tampered' ELSE 'ok' END AS status FROM documents",
    "audit_page": "SELECT event_id, event_type AS endpoint FROM events WHERE user_id = 1 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5",
    "retention_purge": f"SELECT user_id AS tenant_id, count(*) FILTER (ts < TIMESTAMP '{CUTOFF}') AS purged, count(*) FILTER (NOT ts < TIMESTAMP '{CUTOFF}') AS kept FROM events GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    from factloom.plans import causal_oracles, contract_queries, domain_queries, text_oracles  # they build on the parts above

    return dict(SQL) | causal_oracles.oracle_sql() | contract_queries.oracle_sql() | domain_queries.oracle_sql() | text_oracles.oracle_sql()
