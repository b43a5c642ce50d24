"""DuckDB SQL with the same results as the queries over whole events. Pairs are all pairs of a case here, not those of an index; worlds without some
parts are computed anew. Words of the rules are written out again."""

from __future__ import annotations

from factloom.plans.oracles import HIERARCHY, TYPE_TERMS, any_of, event_type

SAYINGS = ["{} must be never in source", "{} environment only", "rotated {} before deployment", "deployment of {} service", "{} committed to source repo", "access login for {}", "policy review of {}", "config change after rotation of {}", "{} reviewed, then access", "closed {} when deployment ended", "`{}` exposed prior to rotation", "environment set following policy change of {}"]
POLICY = ["must never appear in source", "must never be in source", "must never in source", "must never appear in repo", "must never be in repo", "must be never in source", "never in source"]
SECURITY = ["access", "secret", "key", "token", "credential"]
STATE = "list_extract(['active', 'destroyed', 'enabled', 'disabled'], CAST({} % 4 AS BIGINT) + 1)"

_sayings = ", ".join("replace('" + x + "', '{}', about)" for x in SAYINGS)
_ref = lambda at: f"{{'source_id': 'src:' || (event_id % 5), 'chunk_id': 'chunk:' || (event_id // 3), 'offset_start': {at}, 'offset_end': {at} + 40, 'text_sha256': sha256(action)}}"
WHOLE = f"""raw AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
named_raw AS (SELECT *, 'OBJ_' || (k % 8) AS name, 'OBJ_' || ((k * 3 + event_id) % 8) AS other, CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN 'date' ELSE 'instant' END AS kind FROM raw),
acted AS (SELECT *, list_extract([{_sayings}], CAST(event_id % 12 AS BIGINT) + 1) AS action FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'it' ELSE name END AS about FROM named_raw)),
w AS MATERIALIZED (SELECT user_id AS case_id, event_id, {event_type('action')} AS type, kind, CASE kind WHEN 'date' THEN strftime(date_trunc('month', ts), '%Y-%m-%d') WHEN 'instant' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS value,
  CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 35 = 1 THEN ['entity:auditor', 'entity:user_' || user_id] ELSE ['entity:user_' || user_id] END AS actors,
  CASE WHEN event_id % 9 = 0 THEN [] WHEN event_id % 4 = 1 THEN list_sort(list_distinct(['entity:' || name, 'entity:' || other])) ELSE ['entity:' || name] END AS objects, action,
  CASE WHEN event_id % 15 = 0 THEN [{{'k': name, 'v': {STATE.format('(event_id + k)')}}}, {{'k': 'mode', 'v': {STATE.format('event_id')}}}] WHEN event_id % 4 <> 0 THEN [{{'k': name, 'v': {STATE.format('(event_id + k)')}}}] END AS state,
  CASE WHEN event_id % 50 = 0 THEN [] WHEN event_id % 6 = 0 THEN [{_ref('event_id % 400')}, {_ref('event_id % 400 + 500')}] ELSE [{_ref('event_id % 400')}] END AS evidence FROM acted)"""
NEWER = """nw AS MATERIALIZED (SELECT * REPLACE (CASE WHEN case_id % 3 = 0 THEN list_transform(state, lambda s: {'k': s.k, 'v': CASE s.v WHEN 'active' THEN 'enabled' WHEN 'destroyed' THEN 'disabled' ELSE s.v END}) ELSE state END AS state,
  CASE WHEN event_id % 17 = 0 THEN '2024-01-02' ELSE value END AS value, CASE WHEN event_id % 17 = 0 THEN 'date' ELSE kind END AS kind) FROM w WHERE event_id % 11 <> 0)"""
_terms = " ".join(f"WHEN '{t}' THEN [{', '.join(repr(x) for x in terms)}]" for t, terms in TYPE_TERMS.items())
REFS = "array_to_string(list_transform({}, lambda r: concat_ws('|', r.source_id, r.chunk_id, r.offset_start, r.offset_end)), ';')"


def secrets(w: str, name: str) -> str:
    """What events say of secrets, and the conflicts of that."""
    return f"""{name}_told AS (SELECT case_id, event_id, unnest(objects) AS entity_id, state FROM {w}),
{name}_said AS (SELECT case_id, entity_id, event_id, s.k AS key, s.v AS state FROM (SELECT case_id, event_id, entity_id, unnest(state) AS s FROM {name}_told) WHERE entity_id = 'entity:' || s.k AND regexp_matches(s.k, '^OBJ_[0-3]$')),
{name}_torn AS (SELECT case_id, entity_id, key, list_sort(list(DISTINCT state)) AS states, count(DISTINCT event_id) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event FROM {name}_said GROUP BY ALL HAVING count(DISTINCT state) > 1)"""


def edges(w: str, name: str) -> str:
    """Edges of the events w by a look at all pairs."""
    has = lambda phrase: f"len(list_filter(t.terms, lambda x: contains(s.text, '{phrase} ' || x))) > 0"
    least = lambda before, after: f"list_min(list_filter(t.terms, lambda x: contains(s.text, '{before} ' || x || '{after}')))"
    return f"""{name}_text AS (SELECT *, action || coalesce(' {{' || array_to_string(list_transform(state, lambda s: '"' || s.k || '":"' || s.v || '"'), ',') || '}}', '') AS said FROM {w}),
{name}_tokens AS (SELECT *, lower(said) AS text, list_sort(list_distinct(list_concat(objects, list_transform(regexp_extract_all(said, '`([^`]+)`', 1), lambda x: upper(trim(x))), regexp_extract_all(said, '\\b[A-Z][A-Z0-9_]{{2,}}\\b')))) AS tokens FROM {name}_text),
{name}_x AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_concat(CASE type {_terms} ELSE [] END, regexp_extract_all(text, '[a-z0-9]{{4,}}'), list_transform(list_filter(tokens, lambda x: NOT starts_with(x, 'entity:')), lambda x: lower(x))))) AS terms,
  {any_of('text', ['never in source', 'never in repo'])} AS never, {any_of('text', ['environment only', 'env-only'])} AS env, len(objects) = 0 AS lacks, (coalesce(value, '~'), event_id) AS spot FROM {name}_tokens),
{secrets(w, name)},
{name}_phrase AS (SELECT s.case_id, s.event_id AS x, t.event_id AS y, CASE WHEN {has('before')} OR {has('prior to')} THEN true WHEN {has('after')} OR {has('following')} THEN false
    WHEN {least('then', '')} IS NOT NULL OR {least('when', ' ended')} IS NOT NULL THEN coalesce({least('then', '')} <= {least('when', ' ended')}, {least('then', '')} IS NOT NULL) END AS forward
  FROM {name}_x s JOIN {name}_x t ON s.case_id = t.case_id AND s.event_id <> t.event_id AND list_has_any(s.tokens, t.tokens)),
{name}_all AS (SELECT case_id, CASE WHEN forward THEN x ELSE y END AS a, CASE WHEN forward THEN y ELSE x END AS b, 'before' AS type, 3 AS k FROM {name}_phrase WHERE forward IS NOT NULL
  UNION SELECT a.case_id, a.event_id, b.event_id, 'before', 2 FROM {name}_x a JOIN {name}_x b ON a.case_id = b.case_id AND list_has_any(a.tokens, b.tokens) AND a.type = 'PolicyChange' AND b.type = 'Config' AND a.spot < b.spot
  UNION SELECT a.case_id, a.event_id, b.event_id, 'enables', 1 FROM {name}_x a JOIN {name}_x b ON a.case_id = b.case_id AND a.event_id <> b.event_id AND list_has_any(a.tokens, b.tokens) AND a.never AND b.env AND NOT a.lacks AND NOT b.lacks AND NOT (a.env AND b.never AND b.spot < a.spot)
  UNION SELECT a.case_id, a.event_id, b.event_id, 'contradicts', 0 FROM {name}_said a JOIN {name}_said b ON a.case_id = b.case_id AND a.entity_id = b.entity_id AND a.key = b.key AND a.event_id < b.event_id JOIN {name}_torn t ON t.case_id = a.case_id AND t.entity_id = a.entity_id AND t.key = a.key),
{name} AS MATERIALIZED (SELECT e.case_id, e.a, e.b, e.type, list_extract(['RULE_CONFLICT_IMPLIED', 'RULE_SECRET_HANDLING_CAUSAL', 'RULE_POLICY_PRECEDES_CONFIG', 'RULE_TIME_PHRASE_BEFORE'], k + 1) AS reason, CASE WHEN k = 3 THEN 'medium' ELSE 'high' END AS confidence, list_sort(list_distinct(list_concat(x.evidence, y.evidence))) AS evidence
  FROM (SELECT case_id, a, b, type, min(k) AS k FROM {name}_all GROUP BY ALL) e JOIN {w} x ON x.case_id = e.case_id AND x.event_id = e.a JOIN {w} y ON y.case_id = e.case_id AND y.event_id = e.b)"""


def violations(w: str, e: str, name: str) -> str:
    both = "list_sort(list_distinct(list_concat(x.evidence, y.evidence)))"
    return f"""{name}_states AS (SELECT case_id, value, event_id, evidence, entity, unnest(state) AS s FROM (SELECT case_id, value, event_id, evidence, state, unnest(objects) AS entity FROM {w} WHERE kind <> 'unknown')),
{name} AS MATERIALIZED (SELECT x.case_id, 'POLICY_CONFLICT' AS type, list_sort([x.event_id, y.event_id]) AS events, list_sort(list_intersect(x.objects, y.objects)) AS entities, 'policy forbids source exposure for the same object referenced in a source-context event' AS reason, {both} AS evidence
    FROM {w} x JOIN {w} y ON x.case_id = y.case_id AND x.event_id <> y.event_id AND list_has_any(x.objects, y.objects) WHERE x.type = 'PolicyChange' AND {any_of('lower(x.action)', POLICY)} AND {any_of('lower(y.action)', ['source', 'repo', 'repository', 'commit', 'committed'])}
  UNION ALL SELECT e.case_id, 'TEMPORAL_CONFLICT', list_sort([a, b]), list_sort(list_intersect(x.objects, y.objects)), 'causal before edge conflicts with explicit timeline ordering', e.evidence
    FROM {e} e JOIN {w} x ON x.case_id = e.case_id AND x.event_id = a JOIN {w} y ON y.case_id = e.case_id AND y.event_id = b WHERE e.type = 'before' AND x.kind <> 'unknown' AND y.kind <> 'unknown' AND y.value < x.value
  UNION ALL SELECT case_id, 'STATE_CONFLICT', list_sort(list(DISTINCT event_id)), [entity], 'entity has contradictory state values for ' || s.k || ' at ' || value || ': ' || string_agg(DISTINCT s.v, ', ' ORDER BY s.v), list_sort(list_distinct(flatten(list(evidence))))
    FROM {name}_states GROUP BY case_id, entity, value, s.k HAVING (bool_or(s.v = 'active') AND bool_or(s.v = 'destroyed')) OR (bool_or(s.v = 'enabled') AND bool_or(s.v = 'disabled')))"""


def blocked(x: str) -> str:
    return f"""apart AS (SELECT a.case_id, 'RULE_POLICY_PRECEDES_CONFIG' AS reason, least(a.event_id, b.event_id) AS a, greatest(a.event_id, b.event_id) AS b FROM {x} a JOIN {x} b ON a.case_id = b.case_id
    WHERE a.type = 'PolicyChange' AND b.type = 'Config' AND a.spot < b.spot AND NOT list_has_any(a.tokens, b.tokens) AND (a.lacks OR b.lacks)
  UNION ALL SELECT a.case_id, 'RULE_SECRET_HANDLING_CAUSAL', a.event_id, b.event_id FROM {x} a JOIN {x} b ON a.case_id = b.case_id AND a.event_id < b.event_id WHERE (a.lacks OR b.lacks) AND (a.never OR a.env OR b.never OR b.env)),
blocks AS (SELECT *, 'missing_object' AS missing FROM apart),
needed AS (SELECT DISTINCT case_id, event_id, w.type, missing FROM (SELECT case_id, unnest([a, b]) AS event_id, missing FROM blocks) JOIN w USING (case_id, event_id))"""


def unknowns(w: str) -> str:
    return f"""SELECT case_id, event_id, unnest(list_filter([CASE WHEN kind = 'unknown' THEN 'missing_time' END, CASE WHEN len(actors) = 0 AND (type <> 'Other' OR {any_of('lower(action)', SECURITY)}) THEN 'missing_actor' END, CASE WHEN len(objects) = 0 THEN 'missing_object' END], lambda u: u IS NOT NULL)) AS unknown FROM {w}"""


PLAIN = f"case_id, type, array_to_string(events, ',') AS events, array_to_string(entities, ',') AS entities, reason, {REFS.format('evidence')} AS evidence"
CLAIM_REFS = f"""{HIERARCHY}, refs AS (SELECT DISTINCT claim_id, 'src:' || (n % 20) AS source_id, 'chunk:' || (n % 200) AS chunk_id, n % 7 * 100 AS offset_start, n % 7 * 100 + 40 AS offset_end
  FROM (SELECT 'C' || o_custkey AS claim_id, o_orderkey AS n FROM orders UNION ALL SELECT 'S' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 2 = 1)),
up_to(claim_id, source_id, chunk_id, offset_start, offset_end) AS (SELECT * FROM refs UNION SELECT e.b, u.source_id, u.chunk_id, u.offset_start, u.offset_end FROM up_to u JOIN edges e ON e.a = u.claim_id),
held AS (SELECT claim_id, concat_ws('|', source_id, chunk_id, offset_start, offset_end) AS ref, CAST(substr(chunk_id, 7) AS BIGINT) % 17 = 0 AS outside FROM up_to)"""
RULESETS = """rulesets(ruleset_id, ruleset_sha256, contradictions, min_evidence, words, kinds, cycles, types, scope) AS (VALUES
  ('core.v1', sha256('{"rules":[{"enabled":true,"params":{},"rule_id":"RULE_CONTRADICTION"},{"enabled":true,"params":{"min_evidence_count":1},"rule_id":"RULE_MIN_EVIDENCE"},{"enabled":true,"params":{"security_keywords":["key","secret","token","credential","access"],"unknown_kinds_for_security":["missing_time","missing_actor"]},"rule_id":"RULE_WORLD_UNKNOWNS_SECURITY"},{"enabled":true,"params":{},"rule_id":"RULE_CAUSAL_TEMPORAL_CYCLE"},{"enabled":true,"params":{"security_event_types":["Access","Config","Deployment","Leak","PolicyChange"]},"rule_id":"RULE_CAUSAL_NEEDS_INFO"},{"enabled":true,"params":{"fail_on_scope_mismatch":true},"rule_id":"RULE_SCOPE"}],"ruleset_id":"core.v1"}'),
   true, 1, ['key', 'secret', 'token', 'credential', 'access'], ['missing_time', 'missing_actor'], true, ['Access', 'Config', 'Deployment', 'Leak', 'PolicyChange'], true),
  ('lenient.v1', sha256('{"rules":[{"enabled":false,"params":{},"rule_id":"RULE_CONTRADICTION"},{"enabled":true,"params":{"min_evidence_count":12},"rule_id":"RULE_MIN_EVIDENCE"},{"enabled":true,"params":{"security_keywords":["login"],"unknown_kinds_for_security":["missing_actor","missing_object"]},"rule_id":"RULE_WORLD_UNKNOWNS_SECURITY"},{"enabled":false,"params":{},"rule_id":"RULE_CAUSAL_TEMPORAL_CYCLE"},{"enabled":true,"params":{"security_event_types":["Leak"]},"rule_id":"RULE_CAUSAL_NEEDS_INFO"},{"enabled":true,"params":{"fail_on_scope_mismatch":false},"rule_id":"RULE_SCOPE"}],"ruleset_id":"lenient.v1"}'),
   false, 12, ['login'], ['missing_actor', 'missing_object'], false, ['Leak'], false))"""
VERDICTS = """SELECT r.ruleset_id, r.ruleset_sha256, t.target, CASE WHEN codes IS NULL THEN 'VERIFIED_OK' WHEN list_has_any(codes, ['RULE_CONTRADICTION', 'RULE_SCOPE', 'RULE_CAUSAL_TEMPORAL_CYCLE', 'RULE_CONSTRAINT_VIOLATION']) THEN 'VERIFIED_FAIL' ELSE 'VERIFIED_NEEDS_INFO' END AS status,
  coalesce(array_to_string(codes, ','), '') AS codes, coalesce(n_reasons, 0) AS n_reasons FROM targets t CROSS JOIN rulesets r LEFT JOIN (SELECT ruleset_id, target, list_sort(list(DISTINCT code)) AS codes, count(*) AS n_reasons FROM reasons GROUP BY ALL) x ON x.ruleset_id = r.ruleset_id AND x.target = t.target"""
CLAIM_REASONS = f"""{CLAIM_REFS}, {RULESETS}, targets AS (SELECT a AS target FROM edges UNION SELECT b FROM edges),
torn AS (SELECT 'C' || c_custkey AS a, 'C' || (c_custkey - 1) AS b FROM customer WHERE c_custkey % 50 = 0),
few AS (SELECT target, count(claim_id) AS n FROM targets LEFT JOIN held ON claim_id = target GROUP BY 1),
reasons AS (SELECT ruleset_id, unnest([a, b]) AS target, 'RULE_CONTRADICTION' AS code, a || '|' || b AS ref FROM torn, rulesets WHERE contradictions
  UNION ALL SELECT ruleset_id, target, 'RULE_MIN_EVIDENCE', target FROM few, rulesets WHERE n < min_evidence
  UNION ALL SELECT ruleset_id, claim_id, 'RULE_SCOPE', ref FROM held, rulesets WHERE scope AND outside)"""
#: Cycles of a case's before-edges and times: gates between neighbouring times stand for the edges by time, as negative nodes.
CASE_REASONS = f"""{WHOLE}, {edges('w', 'e')}, {violations('w', 'e', 'v')}, {blocked('e_x')}, {RULESETS}, targets AS (SELECT DISTINCT CAST(case_id AS VARCHAR) AS target FROM w),
unk AS ({unknowns('w')}),
gates AS (SELECT case_id, value, -row_number() OVER (ORDER BY case_id, value) AS gate, lag(1) OVER (PARTITION BY case_id ORDER BY value) IS NULL AS is_first FROM (SELECT DISTINCT case_id, value FROM w WHERE kind <> 'unknown')),
steps AS MATERIALIZED (SELECT case_id, a, b FROM e WHERE type = 'before' UNION SELECT w.case_id, event_id, gate FROM w JOIN gates g ON g.case_id = w.case_id AND g.value = w.value WHERE kind <> 'unknown'
  UNION SELECT w.case_id, gate + 1, event_id FROM w JOIN gates g ON g.case_id = w.case_id AND g.value = w.value WHERE kind <> 'unknown' AND NOT is_first UNION SELECT case_id, gate + 1, gate FROM gates WHERE NOT is_first),
reach(case_id, a, b) AS (SELECT case_id, a, b FROM steps WHERE a >= 0 UNION SELECT r.case_id, r.a, s.b FROM reach r JOIN steps s ON s.case_id = r.case_id AND s.a = r.b),
loops AS (SELECT case_id, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS ref FROM reach WHERE a = b GROUP BY 1),
found AS (SELECT ruleset_id, case_id, 'RULE_WORLD_UNKNOWNS_SECURITY' AS code, unknown AS kind, 'event:' || event_id AS ref FROM unk JOIN w USING (case_id, event_id), rulesets WHERE list_contains(kinds, unknown) AND len(list_filter(words, lambda x: contains(lower(action), x))) > 0
  UNION SELECT ruleset_id, case_id, 'RULE_CAUSAL_TEMPORAL_CYCLE', NULL, ref FROM loops, rulesets WHERE cycles
  UNION SELECT ruleset_id, case_id, 'RULE_CAUSAL_NEEDS_INFO', missing, 'event:' || event_id FROM needed, rulesets WHERE list_contains(types, needed.type)
  UNION SELECT ruleset_id, case_id, 'RULE_SCOPE', NULL, concat_ws('|', r.source_id, r.chunk_id, r.offset_start, r.offset_end) FROM (SELECT case_id, unnest(evidence) AS r FROM w), rulesets WHERE scope AND CAST(substr(r.chunk_id, 7) AS BIGINT) % 7 = 0
  UNION SELECT ruleset_id, case_id, 'RULE_CONSTRAINT_VIOLATION', NULL, concat_ws('|', type, array_to_string(events, ','), array_to_string(entities, ',')) FROM v, rulesets),
reasons AS (SELECT ruleset_id, CAST(case_id AS VARCHAR) AS target, code, kind, ref FROM found)"""
REMOVED = f"""{WHOLE}, ents AS (SELECT DISTINCT case_id, unnest(list_concat(objects, actors)) AS entity_id FROM w),
ops AS (SELECT DISTINCT case_id, 'REMOVE_ENTITY' AS op, 'entity:OBJ_1' AS target FROM w WHERE case_id % 4 = 0
  UNION SELECT case_id, 'REMOVE_EVENT', CAST(event_id AS VARCHAR) FROM w WHERE event_id % 37 = 0 OR (list_contains(objects, 'entity:OBJ_3') AND case_id % 5 = 0) OR (case_id % 6 = 1 AND event_id % 2 = 0)
  UNION SELECT case_id, 'REMOVE_EVENT', CAST(event_id + 1000000000 AS VARCHAR) FROM w WHERE event_id % 41 = 0 UNION SELECT case_id, 'REMOVE_ENTITY', 'entity:' || event_id FROM w WHERE event_id % 43 = 0),
bad AS (SELECT * FROM ops o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.case_id = o.case_id AND op = 'REMOVE_EVENT' AND CAST(event_id AS VARCHAR) = target) AND NOT EXISTS (SELECT 1 FROM ents e WHERE e.case_id = o.case_id AND op = 'REMOVE_ENTITY' AND entity_id = target)),
lost AS (SELECT case_id, list(target) AS ids FROM ops WHERE op = 'REMOVE_ENTITY' GROUP BY 1),
rest AS MATERIALIZED (SELECT w.* REPLACE (list_filter(actors, lambda x: NOT list_contains(coalesce(ids, []), x)) AS actors, list_filter(objects, lambda x: NOT list_contains(coalesce(ids, []), x)) AS objects)
  FROM w LEFT JOIN lost USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.case_id = w.case_id AND op = 'REMOVE_EVENT' AND target = CAST(event_id AS VARCHAR)))"""


_list = lambda x: f"CASE WHEN len({x}) = 0 THEN '[]' ELSE '[\"' || array_to_string({x}, '\",\"') || '\"]' END"
_text = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
_refs = """'[' || array_to_string(list_transform(evidence, lambda r: '{"chunk_id":"' || r.chunk_id || '","offset_end":' || r.offset_end || ',"offset_start":' || r.offset_start || ',"source_id":"' || r.source_id || '","text_sha256":"' || r.text_sha256 || '"}'), ',') || ']'"""
_state = """coalesce('{' || array_to_string(list_transform(state, lambda s: '"' || s.k || '":"' || s.v || '"'), ',') || '}', 'null')"""
_event = f"""'{{"action":"' || action || '","actors":' || {_list('actors')} || ',"event_id":' || event_id || ',"evidence":' || {_refs} || ',"kind":"' || kind || '","objects":' || {_list('objects')} || ',"state":' || {_state} || ',"type":"' || type || '","value":' || {_text('value')} || '}}'"""
WORLDS = f"""WITH {WHOLE}, worlds AS (SELECT case_id, '{{"events":[' || string_agg({_event}, ',' ORDER BY coalesce(value, '~'), event_id) || '],"world_sha256":"","world_version":"1.0"}}' AS json FROM w GROUP BY 1)
SELECT case_id, sha256(json) AS world_sha256, CAST(length(json) AS BIGINT) AS n_chars FROM worlds"""
LEDGER = """SELECT DISTINCT sha256('{"doc_id":' || doc_id || ',"relpath":"d' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt","sha256":"' || sha256(coalesce(text, '')) || '"}') AS bundle_sha256, true AS ok, '' AS errors FROM documents"""


_asked = "['1', 'access', 'before', 'came', 'obj', 'of', 'rotation', 'secret', 'the', 'which']"
FOCUS = f"""WITH RECURSIVE {CASE_REASONS}, scored AS (SELECT case_id, event_id, value,
  5 * len(list_intersect({_asked}, list_transform(objects, lambda x: lower(x)))) + 3 * len(list_intersect({_asked}, list_distinct(list_concat(list_transform(objects, lambda x: lower(x)), list_transform(tokens, lambda x: lower(x)), regexp_extract_all(text, '[a-z0-9]+'))))) + CASE WHEN type IN ('Access', 'PolicyChange', 'Config', 'Leak', 'Rotation') THEN 2 ELSE 0 END AS score FROM e_x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, value ASC NULLS LAST, event_id) AS rank FROM scored),
odd AS (SELECT case_id, event_id FROM e_said JOIN e_torn USING (case_id, entity_id, key) UNION SELECT case_id, unnest(events) FROM v UNION SELECT case_id, a FROM reach WHERE a = b)
SELECT r.case_id, r.event_id, score, rank, o.event_id IS NOT NULL AS forced FROM ranked r LEFT JOIN odd o ON o.case_id = r.case_id AND o.event_id = r.event_id WHERE rank <= 10 OR o.event_id IS NOT NULL"""
ORDERS = """facts AS (SELECT o_orderkey AS id, '{"key":' || o_orderkey || ',"customer":' || CASE WHEN o_orderkey % 5 <> 0 THEN '{"key":' || o_custkey || ',"name":"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'c ' || o_custkey END || '"}' ELSE 'null' END || ',"items":[' ||
  coalesce(array_to_string(list_transform(range(1, CAST(o_orderkey % 4 AS BIGINT) + 1), lambda i: '{"id":"item_' || i || '","count":' || CASE WHEN i % 2 = 0 THEN CAST(i * o_orderkey AS VARCHAR) ELSE 'null' END || ',"flags":[' || CASE WHEN i > 2 THEN 'true' ELSE 'false' END || ']}'), ','), '') || '],"status":' || CASE WHEN o_orderkey % 7 = 0 THEN '"' || o_orderstatus || '"' ELSE 'null' END || '}' AS json FROM orders),
tree AS (SELECT f.id, substr(t.fullkey, 3) AS path, CASE t.type WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN upper(left(t.atom, 1)) || substr(t.atom, 2) WHEN 'VARCHAR' THEN json_extract_string(t.atom, '$') ELSE CAST(t.atom AS VARCHAR) END AS value FROM facts f, json_tree(f.json) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"""


def oracle_sql() -> dict[str, str]:
    return {
        "event_focus": FOCUS,
        "template_fill": """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE 'generic' END AS name, CASE WHEN o_orderstatus = 'F'
  THEN 'First ' || CASE WHEN o_orderkey % 4 >= 1 THEN 'item_1' ELSE '{missing:item_1.id}' END || ', second ' || CASE WHEN o_orderkey % 4 >= 2 THEN CAST(2 * o_orderkey AS VARCHAR) ELSE '{missing:item_2.count}' END || ', of ' || o_orderkey || '. {missing:note}'
  ELSE 'Order ' || o_orderkey || ': ' || CASE WHEN o_orderkey % 5 = 0 THEN '{missing:customer.name}' WHEN o_orderkey % 3 = 0 THEN '' ELSE 'c ' || o_custkey END || ' (' || CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE '{missing:status}' END || ').' END AS text FROM orders""",
        "nested_facts": f"WITH {ORDERS} SELECT * FROM tree",
        "missing_facts": f"WITH {ORDERS} SELECT id, unnest(list_filter([CASE WHEN status_absent THEN 'status' END, CASE WHEN items_absent THEN 'items' END, CASE WHEN name_absent THEN 'customer.name' END, CASE WHEN key_absent THEN 'customer.key' END, 'note'], lambda x: x IS NOT NULL)) AS field FROM (SELECT id, coalesce(json_extract_string(json, '$.status'), '') = '' AS status_absent, json_array_length(json, '$.items') = 0 AS items_absent, coalesce(json_extract_string(json, '$.customer.name'), '') = '' AS name_absent, json_extract_string(json, '$.customer.key') IS NULL AS key_absent FROM facts)",
        "cited_facts": f"WITH {ORDERS} SELECT id, value AS evidence_id FROM tree WHERE regexp_full_match(path, 'items.[0-9]+..id')",
        "world_hashes": WORLDS,
        "ledger_replay": LEDGER,
        "event_tokens": f"WITH {WHOLE}, {edges('w', 'e')} SELECT case_id, event_id, text, array_to_string(tokens, ',') AS tokens, array_to_string(terms, ',') AS terms FROM e_x",
        "event_edges": f"WITH {WHOLE}, {edges('w', 'e')} SELECT case_id, a, b, type, reason, confidence, {REFS.format('evidence')} AS evidence FROM e",
        "blocked_inferences": f"WITH {WHOLE}, {edges('w', 'e')}, {blocked('e_x')} SELECT * FROM blocks",
        "causal_needed_info": f"WITH {WHOLE}, {edges('w', 'e')}, {blocked('e_x')} SELECT * FROM needed",
        "event_unknowns": f"WITH {WHOLE} {unknowns('w')}",
        "secret_conflicts": f"WITH {WHOLE}, {secrets('w', 's')} SELECT * REPLACE (array_to_string(states, ',') AS states), key || ' has conflicting states: ' || array_to_string(states, ', ') AS reason FROM s_torn",
        "evidenced_violations": f"WITH {WHOLE}, {edges('w', 'e')}, {violations('w', 'e', 'v')} SELECT {PLAIN} FROM v",
        "violation_changes": f"""WITH {WHOLE}, {NEWER}, {edges('w', 'e')}, {violations('w', 'e', 'v')}, {edges('nw', 'ne')}, {violations('nw', 'ne', 'nv')},
o AS (SELECT case_id, type, events, entities, max(reason) AS reason FROM (SELECT case_id, type, events, entities, reason FROM v EXCEPT SELECT case_id, type, events, entities, reason FROM nv) GROUP BY ALL),
n AS (SELECT case_id, type, events, entities, max(reason) AS reason FROM (SELECT case_id, type, events, entities, reason FROM nv EXCEPT SELECT case_id, type, events, entities, reason FROM v) GROUP BY ALL)
SELECT coalesce(o.case_id, n.case_id) AS case_id, CASE WHEN o.case_id IS NULL THEN 'added' WHEN n.case_id IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(o.type, n.type) AS type,
  array_to_string(coalesce(o.events, n.events), ',') AS events, array_to_string(coalesce(o.entities, n.entities), ',') AS entities, o.reason AS old_reason, n.reason AS new_reason
FROM o FULL JOIN n ON o.case_id = n.case_id AND o.type = n.type AND o.events = n.events AND o.entities = n.entities""",
        "claim_evidence": f"WITH RECURSIVE {CLAIM_REFS} SELECT claim_id, count(*) AS n_refs, min(ref) AS first_ref, max(ref) AS last_ref FROM held GROUP BY 1",
        "claim_scope_breaches": f"WITH RECURSIVE {CLAIM_REFS} SELECT claim_id, ref FROM held WHERE outside",
        "claim_verdicts": f"WITH RECURSIVE {CLAIM_REASONS} {VERDICTS}",
        "case_reasons": f"WITH RECURSIVE {CASE_REASONS} SELECT * FROM reasons",
        "case_required_info": f"WITH RECURSIVE {CASE_REASONS} SELECT DISTINCT ruleset_id, target, kind, ref FROM reasons WHERE code IN ('RULE_MIN_EVIDENCE', 'RULE_WORLD_UNKNOWNS_SECURITY', 'RULE_CAUSAL_NEEDS_INFO')",
        "case_verdicts": f"WITH RECURSIVE {CASE_REASONS} {VERDICTS}",
        "counterfactual_faults": f"WITH {REMOVED} SELECT * FROM bad",
        "counterfactual_events": f"WITH {REMOVED} SELECT case_id, event_id, array_to_string(actors, ',') AS actors, array_to_string(objects, ',') AS objects FROM rest",
        "counterfactual_relations": f"WITH {REMOVED} SELECT case_id, event_id AS from_id, to_id, CASE WHEN value = to_value THEN 'same_time' ELSE 'before' END AS relation FROM (SELECT case_id, event_id, value, lead(event_id) OVER o AS to_id, lead(value) OVER o AS to_value FROM rest WHERE kind <> 'unknown' WINDOW o AS (PARTITION BY case_id ORDER BY value, event_id)) WHERE to_id IS NOT NULL",
        "counterfactual_missing": f"WITH {REMOVED} {unknowns('rest')}",
        "counterfactual_conflicts": f"WITH {REMOVED}, {secrets('rest', 's')} SELECT case_id, entity_id, array_to_string(states, ',') AS states, n_events, first_event, last_event FROM s_torn",
    }
