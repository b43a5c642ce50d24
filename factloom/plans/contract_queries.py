"""Queries over contracts of several shapes, and DuckDB SQL that reads the same texts with its own patterns."""

from __future__ import annotations

from factloom.operators import contracts
from factloom.sources import records
from factloom.sources.shared import stored
from pyspark.sql import DataFrame


def texts(s, d) -> DataFrame:
    return stored(contracts.prepared(records.agreements(s, d)), "contracts")


def lines(s, d) -> DataFrame:
    return stored(contracts.matched_parties(texts(s, d)), "parties")


def contract_facts(s, d):
    return contracts.facts(records.agreements(s, d))


def contract_parties(s, d):
    return contracts.parties(lines(s, d))


def contract_aliases(s, d):
    return contracts.aliases(lines(s, d)).select("contract_id", "alias", "name")


def contract_duties(s, d):
    rows = texts(s, d)
    return contracts.duties(rows, stored(contracts.matched_parties(rows), "parties"))


def contract_terms(s, d):
    return contracts.terms(texts(s, d))


def contract_terminations(s, d):
    return contracts.terminations(texts(s, d))


ALL = [contract_facts, contract_parties, contract_aliases, contract_duties, contract_terms, contract_terminations]

_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_values = {
    "s": "'Supplier ' || (o_orderkey % 100)", "c": "'Customer ' || o_custkey", "a": "'Sup' || (o_orderkey % 100)", "b": "'Cus' || (o_custkey % 100)", "n": "n_name",
    "d": "strftime(o_orderdate, '%B %-d, %Y')", "e": "strftime(o_orderdate + INTERVAL 12 MONTH, '%B %-d, %Y')", "l": "lower(strftime(o_orderdate, '%B %-d, %Y'))",
}
_text = f"list_extract([{', '.join(map(_quoted, records.CONTRACTS))}], CAST(o_orderkey % {len(records.CONTRACTS)} AS BIGINT) + 1)"
for _key, _value in _values.items():
    _text = f"replace({_text}, '{{{_key}}}', {_value})"
_month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_date = _month + r"\s+\d{1,2},\s+\d{4}"
_name = r"[A-Z][A-Za-z0-9&.,''\- ]+?"
_role = "(licensor|licensee|buyer|seller|client|contractor|provider|customer|vendor|company|discloser|recipient)"
_party = rf"(?i)({_name}),\s+a[n]?\s+[^,\n]+?\(([^)]+)\)"
_pair = rf"(?i)\b({_name})\s+as\s+{_role}\s+and\s+({_name})\s+as\s+{_role}\b"
_term = rf"(?is)begin\s+on\s+((?:the\s+)?Effective Date|{_date}).{{0,120}}?continue\s+until\s+({_date}).{{0,80}}?for\s+([^.,]+)"
_means = r'(?i)"([A-Z][A-Za-z0-9 ]+)"\s+(?:means|shall mean)\s+([^.]+)\.'
_called = r'(?i)([A-Za-z0-9 ,\-]+?)\s+\(the\s+"([A-Z][A-Za-z0-9 ]+)"\)'
_clean = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g')"
_first = lambda pattern, group: f"list_extract(regexp_extract_all(text, '{pattern}', {group}), 1)"
_day = lambda x: rf"try_strptime(regexp_replace(nullif(regexp_extract({x}, '{_date}'), ''), '\s+', ' ', 'g'), '%B %d, %Y')"
_bad = lambda x: f"(regexp_extract({x}, '{_date}') <> '' AND {_day(x)} IS NULL)"
_effective = rf"(?i)(?:effective\s+date|entered\s+into\s+as\s+of)\W{{0,20}}({_date})"
TEXTS = rf"""raw AS (SELECT o_orderkey AS contract_id, {_text} AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
lf AS (SELECT contract_id, translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '“”‘’', chr(34) || chr(34) || chr(39) || chr(39)) AS text FROM raw),
texts AS MATERIALIZED (SELECT contract_id, array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {_clean('p')}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM lf),
pairs AS (SELECT contract_id, unnest(range(len(g))) AS i, unnest(g) AS l, unnest(regexp_extract_all(text, '{_pair}', 2)) AS lr, unnest(regexp_extract_all(text, '{_pair}', 3)) AS r, unnest(regexp_extract_all(text, '{_pair}', 4)) AS rr FROM (SELECT *, regexp_extract_all(text, '{_pair}', 1) AS g FROM texts)),
paired AS (SELECT contract_id, name, arg_max(role, i) AS role FROM (SELECT contract_id, 2 * i AS i, {_clean('l')} AS name, lower(lr) AS role FROM pairs UNION ALL SELECT contract_id, 2 * i + 1, {_clean('r')}, lower(rr) FROM pairs) GROUP BY contract_id, name),
found AS (SELECT contract_id, unnest(range(len(g))) AS place, unnest(g) AS raw_name, unnest(regexp_extract_all(text, '{_party}', 2)) AS raw_labels FROM (SELECT *, regexp_extract_all(text, '{_party}', 1) AS g FROM texts)),
labelled AS (SELECT contract_id, place, regexp_replace(regexp_replace({_clean('raw_name')}, ',+$', ''), '(?i)^(by and between|and)\s+', '') AS name, regexp_extract_all(raw_labels, '"([^"]+)"', 1) AS labels FROM found),
roled AS (SELECT l.*, coalesce(list_extract(list_filter(list_transform(list_reverse(labels), lambda x: lower(x)), lambda x: regexp_full_match(x, '{_role}')), 1), p.role) AS role FROM labelled l LEFT JOIN paired p ON p.contract_id = l.contract_id AND p.name = l.name),
settled AS (SELECT contract_id, name, min(place) AS place FROM roled WHERE role IS NOT NULL GROUP BY ALL),
lines AS MATERIALIZED (SELECT r.* FROM roled r LEFT JOIN settled s ON s.contract_id = r.contract_id AND s.name = r.name WHERE s.place IS NULL OR r.place <= s.place),
parties AS (SELECT contract_id, name, role FROM lines WHERE role IS NOT NULL),
aliases AS (SELECT contract_id, alias, arg_max(name, place * 1000 + k) AS name, min(place * 1000 + k) AS spot FROM (SELECT contract_id, name, place, unnest(range(len(labels))) AS k, unnest(labels) AS alias FROM lines) GROUP BY contract_id, alias),
subjects AS (SELECT contract_id, name AS subject, name, 0 AS p, name AS q, 0 AS spot FROM parties UNION ALL SELECT contract_id, alias, name, 1, '', spot FROM aliases UNION ALL SELECT contract_id, upper(role[1]) || role[2:], name, 2, name, 0 FROM parties),
pieces AS (SELECT contract_id, unnest(range(len(x))) AS k, unnest(x) AS piece FROM (SELECT contract_id, regexp_extract_all(text, '[^.!?]+[.!?]|[.!?]') AS x FROM texts)),
placed AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY contract_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spot FROM pieces),
said AS (SELECT contract_id, spot AS sentence_at, {_clean('piece')} AS sentence FROM placed WHERE length(piece) > 1 AND regexp_matches(piece, '(?i)\b(shall|must|agrees to|is required to|will)\b')),
hits AS (SELECT s.*, name, length(regexp_extract(sentence, '(?s)^(.*?)\b' || regexp_escape(subject) || '\b', 1)) AS hit, p, q, spot FROM said s JOIN subjects u ON u.contract_id = s.contract_id WHERE regexp_matches(sentence, '\b' || regexp_escape(subject) || '\b')),
duties AS (SELECT contract_id, sentence_at AS "offset", arg_min(name, {{'a': hit, 'b': p, 'c': q, 'd': spot}}) AS party, sentence FROM hits GROUP BY contract_id, sentence_at, sentence),
means AS (SELECT contract_id, 0 AS p, unnest(range(len(g))) AS i, unnest(g) AS term, unnest(regexp_extract_all(text, '{_means}', 2)) AS definition FROM (SELECT *, regexp_extract_all(text, '{_means}', 1) AS g FROM texts)
  UNION ALL SELECT contract_id, 1, unnest(range(len(g))), unnest(g), unnest(regexp_extract_all(text, '{_called}', 1)) FROM (SELECT *, regexp_extract_all(text, '{_called}', 2) AS g FROM texts)),
cleaned AS (SELECT contract_id, {_clean('term')} AS term, regexp_replace({_clean('definition')}, ',+$', '') AS definition, p * 1000000 + i AS spot FROM means),
terms AS (SELECT contract_id, term, arg_min(definition, spot) AS definition FROM cleaned GROUP BY contract_id, term),
clauses AS (SELECT contract_id, k, {_clean('c')} AS clause FROM (SELECT contract_id, unnest(range(len(x))) AS k, unnest(x) AS c FROM (SELECT contract_id, regexp_extract_all(text, '[^.]*\.') AS x FROM texts)) WHERE regexp_matches(c, '(?i)\bterminate(?:d|s)?\b')),
endings AS (SELECT contract_id, row_number() OVER (PARTITION BY contract_id ORDER BY k) - 1 AS position, clause FROM (SELECT contract_id, clause, min(k) AS k FROM clauses WHERE NOT starts_with(lower(clause), 'the term of this agreement') GROUP BY contract_id, clause)),
read AS (SELECT contract_id, {_first(_effective, 1)} AS eff, {_first(_term, 1)} AS begin_text, {_first(_term, 2)} AS end_text, {_clean(_first(_term, 3))} AS duration,
  {_clean(_first('(?i)This Agreement shall be governed by the laws of ([^.]+)[.]', 1))} AS jurisdiction, {_clean(_first('(?i)This Agreement shall be governed by the laws of [^.]+[.]', 0))} AS law_clause FROM texts),
dated AS (SELECT *, {_day('eff')} AS eff_day, {_day('end_text')} AS end_day, contains(lower(begin_text), 'effective date') AS by_effect, {_day('begin_text')} AS begin_day,
  coalesce({_bad('eff')}, false) OR coalesce({_bad('end_text')}, false) OR coalesce({_bad('begin_text')}, false) AS bad FROM read),
named AS (SELECT contract_id, string_agg(name || ':' || role, '; ' ORDER BY name || ':' || role) AS parties FROM parties GROUP BY 1),
whole AS (SELECT d.*, parties, coalesce(nd, 0) AS nd, coalesce(nt, 0) AS nt, coalesce(ne, 0) AS ne FROM dated d LEFT JOIN named USING (contract_id) LEFT JOIN (SELECT contract_id, count(*) AS nd FROM duties GROUP BY 1) USING (contract_id)
  LEFT JOIN (SELECT contract_id, count(*) AS nt FROM terms GROUP BY 1) USING (contract_id) LEFT JOIN (SELECT contract_id, count(*) AS ne FROM endings GROUP BY 1) USING (contract_id))"""
FACTS = f"""WITH {TEXTS} SELECT contract_id, CASE WHEN NOT bad THEN parties END AS parties, CASE WHEN NOT bad THEN strftime(eff_day, '%Y-%m-%d') END AS effective_date, CASE WHEN NOT bad THEN strftime(CASE WHEN begin_text IS NULL OR by_effect THEN eff_day ELSE begin_day END, '%Y-%m-%d') END AS term_start,
  CASE WHEN NOT bad THEN strftime(end_day, '%Y-%m-%d') END AS term_end, CASE WHEN NOT bad THEN duration END AS duration, CASE WHEN NOT bad THEN jurisdiction END AS jurisdiction, CASE WHEN NOT bad THEN law_clause END AS law_clause,
  CAST(CASE WHEN bad THEN 0 ELSE nd END AS BIGINT) AS n_duties, CAST(CASE WHEN bad THEN 0 ELSE nt END AS BIGINT) AS n_terms, CAST(CASE WHEN bad THEN 0 ELSE ne END AS BIGINT) AS n_terminations,
  CASE WHEN bad THEN 'structured_error: day is out of range for month' ELSE concat_ws(',', CASE WHEN parties IS NULL THEN 'parties_not_found' END, CASE WHEN eff_day IS NULL THEN 'effective_date_not_found' END, CASE WHEN end_day IS NULL THEN 'term_not_found' END, CASE WHEN nd = 0 THEN 'obligations_not_found' END,
    CASE WHEN nt = 0 THEN 'defined_terms_not_found' END, CASE WHEN law_clause IS NULL THEN 'governing_law_not_found' END, CASE WHEN ne = 0 THEN 'termination_conditions_not_found' END) END AS warnings FROM whole"""


def oracle_sql() -> dict[str, str]:
    parts = {"contract_parties": "parties", "contract_aliases": "(SELECT contract_id, alias, name FROM aliases)", "contract_duties": "duties", "contract_terms": "terms", "contract_terminations": "endings"}
    return {"contract_facts": FACTS} | {name: f"WITH {TEXTS} SELECT * FROM {source}" for name, source in parts.items()}
