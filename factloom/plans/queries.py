"""The registered queries: operators applied to whole tables, with scalars and strings as results."""

from __future__ import annotations

from collections.abc import Callable

from factloom.functions.text import rendered
from factloom.operators import claims, domains, evidence, extraction, graph, patches, proposal, reports, service, versions, world
from factloom.plans import causal_queries, contract_queries, domain_queries
from factloom.sources import records
from factloom.sources.shared import stored
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = ["the", "and"]
TOPK = 50
FOCUS_TOKENS, FOCUS_TYPES = ["deployment", "obj_1"], ["Deployment"]
CUTOFF = "2024-01-15 00:00:00"


def focused(s: SparkSession, d: str) -> DataFrame:
    return stored(world.focus(records.world_events(s, d), FOCUS_TOKENS, FOCUS_TYPES))


def newer_focused(s: SparkSession, d: str) -> DataFrame:
    return stored(world.focus(records.newer_world(records.world_events(s, d)), FOCUS_TOKENS, FOCUS_TYPES))


def arranged(events: DataFrame) -> DataFrame:
    return graph.arranged(events, world.typed_edges(events).where("type = 'before'"))


def cycles(events: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.cycles(events, edges.where("type = 'before'"))


def found_violations(events: DataFrame) -> DataFrame:
    return world.violations(events, world.typed_edges(events))


def doc_inventory(s, d):
    return evidence.inventory(records.documents(s, d))


def chunk_documents(s, d):
    return evidence.chunks(records.documents(s, d)).select("doc_id", "index", "offset_start", "offset_end", "chunk_id")


def chunks_keyword(s, d):
    return evidence.with_all_terms(evidence.chunks(records.documents(s, d)), KEYWORDS).select("doc_id", "index", "chunk_id")


def evidence_topk_chunks(s, d):
    return evidence.top_chunks(evidence.chunks(records.documents(s, d)), KEYWORDS, TOPK)


def claim_fingerprints(s, d):
    return claims.fingerprints(records.claims(s, d))


def claim_duplicates(s, d):
    return claims.duplicates(records.claims(s, d))


def claim_duplicate_groups(s, d):
    return claims.duplicate_groups(records.claims(s, d))


def claim_contradictions(s, d):
    return claims.contradictions(records.claims(s, d))


def claim_support_edges(s, d):
    return claims.support_edges(records.claims(s, d))


def bullet_claims(s, d):
    e = records.world_events(s, d)
    at = F.col("event_id") * 2
    heading = e.where("event_id % 5 = 0").select("case_id", at.alias("line_no"), F.concat(F.lit("# Log "), F.col("event_id").cast("string")).alias("line"))
    return claims.bullet_claims(heading.union(e.select("case_id", (at + 1).alias("line_no"), F.concat(F.lit("- "), "action").alias("line"))))


def claim_closure(s, d):
    return graph.closure(records.hierarchy_edges(s, d))


def support_tree(s, d):
    return graph.support_tree(records.hierarchy_edges(s, d), "R1")


def event_types(s, d):
    return world.type_counts(records.world_events(s, d))


def world_entities(s, d):
    return world.entities(records.world_events(s, d))


def world_relations(s, d):
    return world.relations(records.world_events(s, d))


def world_unknowns(s, d):
    return world.unknowns(records.world_events(s, d))


def world_state_conflicts(s, d):
    return world.state_conflicts(records.world_events(s, d))


def world_value_conflicts(s, d):
    return world.value_conflicts(records.world_events(s, d))


def event_focus_topk(s, d):
    return focused(s, d).select("case_id", "event_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"), "forced")


def causal_before_edges(s, d):
    return world.before_edges(focused(s, d))


def causal_fan_out(s, d):
    return world.fan_out(records.world_events(s, d))


def critical_events(s, d):
    return world.critical_events(records.world_events(s, d)).select("case_id", "event_id", "score", F.col("rank").cast("bigint").alias("rank"))


def causal_typed_edges(s, d):
    return world.typed_edges(focused(s, d))


def causal_cycle_nodes(s, d):
    events = focused(s, d)
    return cycles(events, stored(world.typed_edges(events), "edges"))


def causal_order(s, d):
    return arranged(focused(s, d)).where("part = 'order'").drop("part")


def critical_chain(s, d):
    return arranged(focused(s, d)).where("part = 'chain'").drop("part")


def constraint_violations(s, d):
    return found_violations(focused(s, d))


def constraint_counts(s, d):
    return world.violation_counts(found_violations(focused(s, d)))


def repair_hints(s, d):
    events = focused(s, d)
    return world.repair_hints(found_violations(events), events)


def verify_cases(s, d):
    events = focused(s, d)
    return verdicts_of(events, stored(world.typed_edges(events), "edges"))


def world_diff_events(s, d):
    old = records.world_events(s, d)
    return versions.diff_events(old, records.newer_world(old))


def world_diff_entities(s, d):
    old = records.world_events(s, d)
    newer = versions.without_object(records.newer_world(old), "OBJ_1")
    return versions.diff_entities(world.entities(old), world.entities(newer))


def world_diff_unknowns(s, d):
    old = records.world_events(s, d)
    return versions.diff_sets(world.unknowns(old), world.unknowns(records.newer_world(old)), ["case_id", "event_id", "unknown"])


def world_diff_conflicts(s, d):
    old = records.world_events(s, d)
    return versions.diff_sets(world.state_conflicts(old), world.state_conflicts(records.newer_world(old)), ["case_id", "object", "value", "states"])


def world_diff_relations(s, d):
    old = records.world_events(s, d)
    return versions.diff_sets(world.relations(old), world.relations(records.newer_world(old)), ["case_id", "from_id", "to_id", "relation"])


def constraint_diff(s, d):
    return versions.diff_violations(found_violations(focused(s, d)), found_violations(newer_focused(s, d)))


def counterfactual_unknowns(s, d):
    return world.unknowns(versions.without_object(records.world_events(s, d), "OBJ_1"))


def world_patch(s, d):
    e = records.world_events(s, d)
    key = ["case_id", "event_id"]
    made = versions.patched(e, e.where("event_id % 19 = 0").select(*key), e.where("event_id % 23 = 0").select(*key, F.lit("patched").alias("action")), e.where("event_id % 29 = 0").withColumn("event_id", F.col("event_id") + 2_000_000_000))
    return made.select("case_id", "event_id", "type", "action")


def world_enrich(s, d):
    e = records.world_events(s, d)
    patches = e.where("event_id % 4 = 0").select("case_id", "event_id", F.lit("2024-02-01").alias("value"), F.lit("auditor").alias("actor"))
    return versions.enriched(e, patches)


def proposed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = stored(records.notes(records.world_events(s, d)), "lines")  # read four times
    return stored(proposal.bullet_actions(lines), "actions"), stored(proposal.proposed_entities(lines), "entities")


def world_proposed_entities(s, d):
    return proposal.proposed_entities(stored(records.notes(records.world_events(s, d)), "lines"))


def world_proposed_events(s, d):
    events = proposal.proposed_events(*proposed(s, d))
    return events.select("case_id", "event_id", "type", "kind", "value", "action", F.size("objects").alias("n_objects"), "state", "n_evidence")


def world_mentions(s, d):
    return proposal.mentioned(*proposed(s, d)).select("case_id", "action", "entity_id")


def world_parts(s: SparkSession, d: str) -> list[DataFrame]:
    """Entities, events and relations of each case, and operations on them, all with ids as text."""
    e = records.world_events(s, d)
    entity_id = F.concat_ws(":", "type", "name").alias("id")
    entities = world.entities(e).select("case_id", entity_id, "type", "name")
    events = e.select("case_id", F.col("event_id").cast("string").alias("id"), "type", F.concat(F.lit("System:"), "object").alias("object"), "action")
    relations = world.relations(e).select("case_id", F.col("relation").alias("type"), F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"))
    return [stored(df, n) for df, n in ((entities, "entities"), (events, "events"), (relations, "relations"), (records.patch_operations(e), "operations"))]


def patch_faults(s, d):
    return patches.patch_faults(*world_parts(s, d))


def after_patch(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = world_parts(s, d)
    return patches.patched_world(*parts, stored(patches.patch_faults(*parts), "faults"))


def patched_entities(s, d):
    return after_patch(s, d)[0]


def patched_events(s, d):
    return after_patch(s, d)[1]


def patched_relations(s, d):
    return after_patch(s, d)[2]


def credit_decisions(s, d):
    return domains.credit_decisions(records.applicants(s, d))


def clinical_screen(s, d):
    return domains.clinical_screen(records.patients(s, d))


def clinical_symptoms(s, d):
    return domains.symptoms(records.patients(s, d))


def language_votes(s, d):
    return domains.language_votes(records.documents(s, d))


def nda_clauses(s, d):
    return domains.clauses(records.table(s, d, "documents").select("doc_id", "text", "lang"))


def contract_fields(s, d):
    return domains.contract_fields(records.contracts(s, d))


def contract_obligations(s, d):
    return domains.obligations(records.contracts(s, d))


def fact_validation(s, d):
    made = credit_decisions(s, d)
    said = F.concat(F.lit("decision = "), F.when(F.col("applicant_id") % 6 == 0, "denied").otherwise(F.upper("decision")), F.lit("; risk_tier: "), F.col("risk_tier"), F.lit(", dti: "), F.col("dti_percent") + F.when(F.col("applicant_id") % 7 == 0, 1).otherwise(0), F.lit(".0"), F.when(F.col("applicant_id") % 4 == 0, ", colour=blue").otherwise(""))
    facts = made.select(F.col("applicant_id").alias("id"), F.explode(F.create_map(F.lit("decision"), "decision", F.lit("risk_tier"), "risk_tier", F.lit("dti"), F.col("dti_percent").cast("string"))).alias("key", "value"))
    return domains.checked_answers(made.select(F.col("applicant_id").alias("id"), said.alias("answer")), facts)


def answer_faults(s, d):
    docs = records.documents(s, d)
    n = F.col("doc_id")
    answer = F.concat(F.lit("Evidence: s"), n % 5, F.when(n % 3 == 0, " cite #s1").otherwise(""), F.lit(". "), "text")
    must = F.array(F.concat(F.lit("s"), (n % 4).cast("string")), F.lit("s1"))
    return domains.answer_faults(docs.select(n.alias("id"), answer.alias("answer"), must.alias("must_cite"), F.array(F.lit("Password"), F.lit("THE")).alias("forbidden")))


def placeholder_render(s, d):
    a = domains.credit_decisions(records.applicants(s, d))
    collateral = F.when(F.col("applicant_id") % 2 == 0, F.lit("house"))
    values = {"applicant_id": F.col("applicant_id"), "decision": F.col("decision"), "collateral_type": collateral}
    return a.select("applicant_id", rendered("Applicant {applicant_id}: {decision}, collateral {collateral_type}.", values).alias("text"))


def seal_cases(s, d):
    return service.sealed(records.documents(s, d))


def replay_verify(s, d):
    docs = records.documents(s, d)
    now = docs.where("doc_id % 31 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    return service.replayed(service.sealed(docs), now)


def audit_page(s, d):
    return service.audit_page(records.requests(s, d), 1, 5, 20)


def retention_purge(s, d):
    return service.retention(records.requests(s, d), CUTOFF)


def rate_limit_admission(s, d):
    return service.admissions(records.requests(s, d))


def text_sentences(s, d):
    return extraction.sentences(records.documents(s, d))


def text_clauses(s, d):
    docs = records.documents(s, d)
    return extraction.clauses(docs, stored(extraction.sentences(docs)))


def placed(s, d, label: str, pattern: str, spans: DataFrame) -> DataFrame:
    return extraction.in_spans(extraction.find_all(records.documents(s, d), {label: pattern}), spans, "start")


def text_references(s, d):
    docs = records.documents(s, d)
    pronouns, mentions = (extraction.in_sentences(docs, {n: p}) for n, p in (("pronoun", extraction.PRONOUN), ("mention", extraction.MENTION)))
    return extraction.references(pronouns, mentions)


def text_frames(s, d):
    spans = stored(text_clauses(s, d))
    verbs, mentions = (placed(s, d, n, p, spans) for n, p in (("verb", extraction.VERB), ("mention", extraction.MENTION)))
    return extraction.frames(verbs, mentions)


def text_utterances(s, d):
    return extraction.utterances(records.documents(s, d))


def text_time_markers(s, d):
    docs = records.documents(s, d)
    return extraction.find_all(docs, {"time": extraction.TIME_MARKERS})


def verdicts_of(events: DataFrame, edges: DataFrame) -> DataFrame:
    return world.verify(events, world.violations(events, edges), cycles(events, edges))


def constraint_narrative(s, d):
    return reports.constraint_narrative(found_violations(focused(s, d)), max_lines=12)


def casefile_summary(s, d):
    events = focused(s, d)
    edges = stored(world.typed_edges(events), "edges")
    return reports.casefile(events, edges, world.violations(events, edges), stored(verdicts_of(events, edges)))


def repair_actions(s, d):
    events = focused(s, d)
    return reports.repair_actions(verdicts_of(events, stored(world.typed_edges(events), "edges")))


ALL = [doc_inventory, chunk_documents, chunks_keyword, evidence_topk_chunks, claim_fingerprints, claim_duplicates, claim_duplicate_groups, claim_contradictions, claim_support_edges, bullet_claims, claim_closure, support_tree]
ALL += [event_types, world_entities, world_relations, world_unknowns, world_state_conflicts, world_value_conflicts, event_focus_topk, causal_before_edges, causal_fan_out, critical_events, causal_typed_edges, causal_cycle_nodes, causal_order, critical_chain]
ALL += [constraint_violations, constraint_counts, repair_hints, verify_cases, world_diff_events, world_diff_entities, world_diff_unknowns, world_diff_conflicts, world_diff_relations, constraint_diff, counterfactual_unknowns, world_patch, world_enrich]
ALL += [world_proposed_entities, world_proposed_events, world_mentions, patch_faults, patched_entities, patched_events, patched_relations]
ALL += [credit_decisions, clinical_screen, clinical_symptoms, language_votes, nda_clauses, contract_fields, contract_obligations, fact_validation, answer_faults, placeholder_render, seal_cases, replay_verify, audit_page, retention_purge, rate_limit_admission]
ALL += [text_sentences, text_clauses, text_references, text_frames, text_utterances, text_time_markers, constraint_narrative, casefile_summary, repair_actions]
ALL += causal_queries.ALL + contract_queries.ALL + domain_queries.ALL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
