"""Records read from tables: documents, claims, world events, applicants, patients, contracts, requests.

A case is one evidence world; every record carries its case, so operators work on all cases at once.
"""

from __future__ import annotations

from functools import reduce

from factloom.functions.text import identity, proposition
from factloom.operators.world import event_type
from factloom.sources.inputs import text_files  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("relpath", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that is not blank is a claim of its document's source; a toxic label makes it a denial."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "object")).where(F.trim("object") != "")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = docs.join(labels, "doc_id", "left").withColumn("polarity", F.when(F.col("toxic") == 1, "deny").otherwise("affirm"))
    rows = rows.select("doc_id", "line_no", F.col("source").alias("subject"), F.lit("states").alias("predicate"), "object", "polarity", F.lit("assert").alias("modality"))
    key = [proposition(F.col(c)) for c in ("subject", "predicate", "object")]
    return rows.withColumn("claim_id", identity("claim", *[F.col(c) for c in ("subject", "predicate", "object", "polarity", "modality")])).withColumn("proposition", F.sha2(F.concat_ws("|", *key), 256))


#: The sentences of an event's action, and its states.
ACTIONS = [
    "{} must be never in source",
    "{} environment only",
    "rotated {} before deployment",
    "deployment of {} service",
    "{} committed to source repo",
    "access login for {}",
    "policy review of {}",
    "config change after rotation of {}",
]
STATES = ["active", "destroyed", "enabled", "disabled"]


def world_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One world for each user: events with a partly known time, an object, maybe an actor, an action and a state."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    obj = F.concat(F.lit("OBJ_"), (F.col("k") % 8).cast("string"))
    kind = F.when(F.col("event_id") % 10 == 0, "unknown").when(F.col("event_id") % 3 == 0, "date").otherwise("instant")
    instant = F.concat(F.translate(F.date_trunc("second", F.col("ts")).cast("string"), " ", "T"), F.lit("Z"))
    action = F.element_at(F.array(*[F.concat(F.lit(a.partition("{}")[0]), obj, F.lit(a.partition("{}")[2])) for a in ACTIONS]), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("case_id"),
        "event_id",
        event_type(action).alias("type"),
        kind.alias("kind"),
        F.when(kind == "date", F.to_date("ts").cast("string")).when(kind == "instant", instant).alias("value"),
        obj.alias("object"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("actor"),
        action.alias("action"),
        F.element_at(F.array(*map(F.lit, STATES)), ((F.col("event_id") + F.col("k")) % 4 + 1).cast("int")).alias("state"),
    )


def notes(events: DataFrame) -> DataFrame:
    """The events of each case as the lines of three Markdown texts: bullets with the time, if known, and headings; every other
    bullet has its object in backticks."""
    quoted = F.replace("action", "object", F.concat(F.lit("`"), "object", F.lit("`")))
    bullet = F.concat(F.lit("- "), F.coalesce(F.concat("value", F.lit(" ")), F.lit("")), F.when(F.col("event_id") % 2 == 0, quoted).otherwise(F.col("action")))
    heading = F.when(F.col("event_id") % 25 == 0, F.concat(F.lit("## Access Policy "), (F.col("event_id") % 4).cast("string"))).otherwise(F.concat(F.lit("# Log "), "object"))
    line = lambda rows, n, text: rows.select("case_id", (F.col("event_id") % 3).alias("source_id"), (F.col("event_id") * 2 + n).alias("line_no"), text.alias("line"))
    return line(events, 1, bullet).union(line(events.where("event_id % 5 = 0"), 0, heading))


def patch_operations(events: DataFrame) -> DataFrame:
    """A patch for most cases: operations of each kind, made from some events by fixed rules; some can't be carried out."""
    event_id, obj, nothing = F.col("event_id").cast("string"), F.concat(F.lit("System:"), "object"), F.lit(None).cast("string")

    def made(every: int, op: str, **said) -> DataFrame:
        rows = events.where(f"event_id % {every} = 0")
        columns = [said.get(c, nothing).alias(c) for c in ("id", "type", "name", "object", "action", "from_id", "to_id")]
        return rows.select("case_id", (F.col("event_id") * 100 + every).alias("op_no"), F.lit(op).alias("op"), *columns)

    new = F.concat(F.lit("new:"), event_id)
    ops = [
        made(97, "REMOVE_EVENT", id=event_id),
        made(41, "UPDATE_EVENT", id=event_id, action=F.lit("patched")),
        made(43, "ADD_EVENT", id=new, type=F.lit("Other"), object=obj, action=F.lit("added")),
        made(47, "ADD_ENTITY", id=F.concat(F.lit("Concept:"), event_id), type=F.lit("Concept"), name=event_id),
        made(53, "UPDATE_ENTITY", id=obj, name=F.lit("renamed")),
        made(89, "REMOVE_ENTITY", id=obj),
        made(43 * 2, "ADD_RELATION", type=F.lit("same_time"), from_id=event_id, to_id=new),
        made(83, "REMOVE_RELATION", type=F.lit("before"), from_id=event_id, to_id=event_id),
    ]
    return reduce(DataFrame.union, ops)


def newer_world(events: DataFrame) -> DataFrame:
    """A later version of a world: some events gone, some changed, some new."""
    stay = events.where("event_id % 11 <> 0").withColumn("action", F.when(F.col("event_id") % 13 == 0, F.concat("action", F.lit(" again"))).otherwise(F.col("action")))
    return stay.unionByName(events.where("event_id % 17 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000))


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim edges of bounded depth: customers support nations, nations regions, regions the world; suppliers imply nations and so on."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    customers, suppliers, nations = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    up = nations.select(name("N", "n_nationkey").alias("a"), name("R", "n_regionkey").alias("b"))
    top = nations.select(name("R", "n_regionkey").alias("a"), F.lit("W0").alias("b")).distinct()
    both = up.union(top)
    supports = customers.select(name("C", "c_custkey").alias("a"), name("N", "c_nationkey").alias("b")).union(both).select("a", "b", F.lit("supports").alias("type"))
    implies = suppliers.select(name("S", "s_suppkey").alias("a"), name("N", "s_nationkey").alias("b")).union(both).select("a", "b", F.lit("implies").alias("type"))
    return supports.union(implies)


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as credit applicants: whole monthly amounts from balances and orders."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("late"))
    c = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        F.col("c_custkey").alias("applicant_id"),
        F.when(F.col("c_custkey") % 9 != 0, F.abs(F.floor("c_acctbal")) + 1).cast("bigint").alias("income"),
        (F.coalesce("n", F.lit(0)) * 97).cast("bigint").alias("debt"),
        (F.col("c_custkey") * 37 % 400 + 450).cast("bigint").alias("score"),
        F.coalesce("late", F.lit(0)).cast("bigint").alias("delinquencies"),
        (F.col("c_custkey") % 60).cast("bigint").alias("employment_months"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    days = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" for "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" days")))
    return o.select(
        F.col("o_orderkey").alias("patient_id"),
        F.when(F.col("o_orderkey") % 21 != 0, F.to_date("o_orderdate").cast("string")).alias("encounter_date"),
        (F.col("o_orderkey") % 80 + 100).cast("bigint").alias("systolic"),
        (F.col("o_orderkey") * 7 % 50 + 60).cast("bigint").alias("diastolic"),
        (F.col("o_custkey") % 70 + 20).cast("bigint").alias("age"),
        (F.col("o_custkey") % 3 == 0).alias("family_history"),
        F.when(F.col("o_orderkey") % 15 == 0, "").otherwise(F.concat(F.lit("headache, dizziness"), days)).alias("complaint"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A licence contract for each order, between its customer and a supplier."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = o.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # a nation table has a few dozen rows by definition
    month = F.date_format("o_orderdate", "MMMM d, yyyy")
    supplier = F.concat(F.lit("Supplier "), (F.col("o_orderkey") % 100).cast("string"), F.lit(" Ltd"))
    customer = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" Inc"))
    text = F.concat(
        F.lit("This Agreement is entered into as of "), month, F.lit(" by and between "), supplier, F.lit(", a company (the Licensor), and "), customer, F.lit(", a company (the Licensee).\n"),
        F.lit("Licensor shall deliver the goods. Licensee must pay within thirty days. Both sides met twice.\n"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("This Agreement shall be governed by the laws of "), F.col("n_name"), F.lit(".\n"))).otherwise(""),
        F.when(F.col("o_orderkey") % 3 == 0, "Either party may terminate this Agreement on notice.\n").otherwise(""),
        F.lit('"Goods" means the ordered items.'),
    )
    return o.select(F.col("o_orderkey").alias("contract_id"), text.alias("text"), supplier.alias("licensor"), customer.alias("licensee"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant_id"), F.col("event_type").alias("endpoint"), "ts", "event_id")


#: What whole events say of their object; of none, they say it of `it`.
SAYINGS = [
    "{} must be never in source",
    "{} environment only",
    "rotated {} before deployment",
    "deployment of {} service",
    "{} committed to source repo",
    "access login for {}",
    "policy review of {}",
    "config change after rotation of {}",
    "{} reviewed, then access",
    "closed {} when deployment ended",
    "`{}` exposed prior to rotation",
    "environment set following policy change of {}",
]
REFERENCE = "struct<source_id:string,chunk_id:string,offset_start:bigint,offset_end:bigint,text_sha256:string>"


def whole_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worlds as world_events, with all that an event can have: several actors and objects or none, states by name, references to evidence. Dates are months."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    n = F.col("event_id")
    name, other = (F.concat(F.lit("OBJ_"), (x % 8).cast("string")) for x in (F.col("k"), F.col("k") * 3 + n))
    objects = F.when(n % 9 == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(F.when(n % 4 == 1, F.array(name, other)).otherwise(F.array(name)), lambda x: F.concat(F.lit("entity:"), x)))))
    about = F.when(n % 9 == 0, "it").otherwise(name)
    action = F.element_at(F.array(*[F.concat(F.lit(a.partition("{}")[0]), about, F.lit(a.partition("{}")[2])) for a in SAYINGS]), (n % 12 + 1).cast("int"))
    state_of = lambda x: F.element_at(F.array(*map(F.lit, STATES)), (x % 4 + 1).cast("int"))
    state = F.when(n % 15 == 0, F.create_map(name, state_of(n + F.col("k")), F.lit("mode"), state_of(n))).when(n % 4 != 0, F.create_map(name, state_of(n + F.col("k"))))
    kind = F.when(n % 10 == 0, "unknown").when(n % 3 == 0, "date").otherwise("instant")
    instant = F.concat(F.translate(F.date_trunc("second", F.col("ts")).cast("string"), " ", "T"), F.lit("Z"))
    user = F.concat(F.lit("entity:user_"), F.col("user_id").cast("string"))
    actors = F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 35 == 1, F.array(F.lit("entity:auditor"), user)).otherwise(F.array(user))
    reference = lambda at: F.struct(F.concat(F.lit("src:"), (n % 5).cast("string")).alias("source_id"), F.concat(F.lit("chunk:"), F.floor(n / 3).cast("string")).alias("chunk_id"), at.cast("bigint").alias("offset_start"), (at + 40).cast("bigint").alias("offset_end"), F.sha2("action", 256).alias("text_sha256"))
    evidence = F.when(n % 50 == 0, F.array().cast(f"array<{REFERENCE}>")).when(n % 6 == 0, F.array(reference(n % 400), reference(n % 400 + 500))).otherwise(F.array(reference(n % 400)))
    return e.withColumn("action", action).select(
        F.col("user_id").alias("case_id"), "event_id", event_type(F.col("action")).alias("type"), kind.alias("kind"),
        F.when(kind == "date", F.trunc("ts", "month").cast("string")).when(kind == "instant", instant).alias("value"),
        actors.alias("actors"), objects.alias("objects"), "action", state.alias("state"), evidence.alias("evidence"),
    )


def whole_entities(events: DataFrame) -> DataFrame:
    """The objects and actors of whole events: half of the objects are secrets."""
    named = events.select("case_id", F.explode(F.concat("objects", "actors")).alias("entity_id")).distinct()
    name = F.substring("entity_id", 8, 1 << 30)
    kind = F.when(name.rlike("^OBJ_[0-3]$"), "Secret").when(name.startswith("OBJ_"), "System").otherwise("Person")
    return named.select("case_id", "entity_id", kind.alias("type"), name.alias("name"))


def newer_events(events: DataFrame) -> DataFrame:
    """A later version of whole events: some gone, some with other times, those of every third case with other states."""
    stay = events.where("event_id % 11 <> 0")
    turned = F.when((F.col("case_id") % 3 == 0) & F.col("state").isNotNull(), F.transform_values("state", lambda k, v: F.when(v == "active", "enabled").when(v == "destroyed", "disabled").otherwise(v)))
    return stay.withColumn("state", F.coalesce(turned, F.col("state"))).withColumn("value", F.when(F.col("event_id") % 17 == 0, F.lit("2024-01-02")).otherwise(F.col("value"))).withColumn("kind", F.when(F.col("event_id") % 17 == 0, "date").otherwise(F.col("kind")))


def bundle(events: DataFrame) -> DataFrame:
    """The artifacts (case_id, source_id, chunk_id) that a case may rest on: all chunks of its events but every seventh."""
    refs = events.select("case_id", F.explode("evidence").alias("r")).select("case_id", "r.source_id", "r.chunk_id").distinct()
    return refs.where(F.substring("chunk_id", 7, 20).cast("bigint") % 7 != 0)


def claim_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the claims of hierarchy_edges: a customer's from its orders, every other supplier's own; many share one."""
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1")

    def made(rows: DataFrame, claim, n) -> DataFrame:
        chunk = F.concat(F.lit("chunk:"), (n % 200).cast("string"))
        ref = F.struct(F.concat(F.lit("src:"), (n % 20).cast("string")).alias("source_id"), chunk.alias("chunk_id"), (n % 7 * 100).cast("bigint").alias("offset_start"), (n % 7 * 100 + 40).cast("bigint").alias("offset_end"), F.sha2(chunk, 256).alias("text_sha256"))
        return rows.select(claim.alias("claim_id"), ref.alias("ref"))

    return made(o, F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.col("o_orderkey")).union(made(s, F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_suppkey")))


def claim_artifacts(refs: DataFrame) -> DataFrame:
    """The chunks that claims may rest on: all that are referred to but every seventeenth."""
    return refs.select("ref.source_id", "ref.chunk_id").distinct().where(F.substring("chunk_id", 7, 20).cast("bigint") % 17 != 0)


def claim_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers' claims that contradict each other."""
    key = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0")
    return pairs.select(F.concat(F.lit("C"), key.cast("string")).alias("claim_a"), F.concat(F.lit("C"), (key - 1).cast("string")).alias("claim_b"))


def removals(events: DataFrame) -> DataFrame:
    """What is to be taken out of worlds: an entity of some, single events, all events of an object; and some that isn't there."""
    op = lambda rows, name, target: rows.select("case_id", F.lit(name).alias("op"), target.cast("string").alias("target"))
    n = F.col("event_id")
    parts = [
        op(events.where("case_id % 4 = 0").select("case_id").distinct(), "REMOVE_ENTITY", F.lit("entity:OBJ_1")),
        op(events.where("event_id % 37 = 0"), "REMOVE_EVENT", n),
        op(events.where(F.array_contains("objects", "entity:OBJ_3") & (F.col("case_id") % 5 == 0)), "REMOVE_EVENT", n),
        op(events.where("case_id % 6 = 1 AND event_id % 2 = 0"), "REMOVE_EVENT", n),
        op(events.where("event_id % 41 = 0"), "REMOVE_EVENT", n + 1_000_000_000),
        op(events.where("event_id % 43 = 0"), "REMOVE_ENTITY", F.concat(F.lit("entity:"), n.cast("string"))),
    ]
    return reduce(DataFrame.union, parts).distinct()


#: Contracts of several shapes. {s} and {c} are the parties, {a} and {b} what they are called, {d} and {e} dates, {n} a nation.
CONTRACTS = [
    'This Agreement (the "Agreement") is entered into as of {d} (the "Effective Date"), by and between {s} LLC, a Delaware company ("{a}" or "Licensor"), and {c} Inc, an Oregon corporation ("{b}" or "Licensee").\n\n"Software" means the hosted platform, as amended. "Data" means records of {b}. {a} shall deliver the Software within thirty days! Must anyone wait? Licensee must pay {s} LLC on time.\n\nThe term of this Agreement will begin on the Effective Date and continue until {e} for one (1) year, unless terminated. Either party may terminate this Agreement on notice. This Agreement shall be governed by the laws of {n}.',
    '{s} Ltd as vendor and {c} Co as customer agree to what follows.\n{s} Ltd, a company of some size ("{a}")\n{c} Co, a firm ("{b}").\nEffective date: {d}. {b} is required to pay. {a} agrees to ship. Nobody will mind. Customer will return samples; Vendor shall inspect them.  If {b} fails, {a} may have it terminated. If {b} fails, {a} may have it terminated.',
    'Effective Date - {d}. The parties agree. This Agreement shall be governed by the laws of the state of {n}. Goods and spare parts, (the "Goods") are sold. All goods shall be sound.',
    'Between  {s}\tGmbH, a company (“Seller”),\r\nand {c} AG, a company (“{b}”, “Buyer”).\r\n\r\n\r\n\r\n{s} GmbH, an old firm (“Client”, “{a}”).\r\n“Price” shall mean the sum, \tin euro. Buyer’s agents must pay the Price to Seller. Seller will ship. {a} shall rest. It begins. It will begin on {d}, and\ncontinue until {e} for two years. Seller terminates it by letter.',
    'a memo of the ninth day. We met on monday. effective date: {l}. {c} Inc, a company (the buyer). Buyer will call.',
    'This Agreement is entered into as of February 30, 2023.\n{s} LLC, a company ("Provider"). Provider shall wait.',
    '',
]


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts (contract_id, text) of the shapes above, one for each order, between its customer and a supplier."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = o.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # a nation table has a few dozen rows by definition
    key = F.col("o_orderkey")
    values = {
        "s": F.concat(F.lit("Supplier "), (key % 100).cast("string")), "c": F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")),
        "a": F.concat(F.lit("Sup"), (key % 100).cast("string")), "b": F.concat(F.lit("Cus"), (F.col("o_custkey") % 100).cast("string")), "n": F.col("n_name"),
        "d": F.date_format("o_orderdate", "MMMM d, yyyy"), "e": F.date_format(F.add_months("o_orderdate", 12), "MMMM d, yyyy"), "l": F.lower(F.date_format("o_orderdate", "MMMM d, yyyy")),
    }
    text = F.element_at(F.array(*map(F.lit, CONTRACTS)), (key % len(CONTRACTS) + 1).cast("int"))
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value)
    return o.select(key.alias("contract_id"), text.alias("text"))


#: Sentences of agreements on secrecy, by language; the last of each meets no rule.
SECRECY = {
    "en": ["Each party shall keep it confidential.", "The term is two years.", "There is one exception.", "Return all copies!", "It is governed by local rules.", "Courts of the city have jurisdiction.", "Confidential information means drafts.", "This agreement is a law to each party."],
    "fr": ["La partie doit garder le secret confidentiel.", "La durée est de deux ans.", "Il y a une exception.", "Restituer ou détruire les copies.", "La loi applicable est locale.", "La juridiction est celle de la ville.", "Information confidentielle désigne les brouillons.", "Cet accord est la loi de chaque partie."],
    "de": ["Die Partei muss vertraulich handeln.", "Die Laufzeit ist kurz.", "Es gibt eine Ausnahme.", "Kopien vernichten!", "Es gilt deutsches Recht.", "Gerichtsstand ist die Stadt.", "Vertrauliche Informationen sind Entwürfe.", "Diese Vereinbarung ist Recht für jede Partei."],
    "es": ["La parte deberá mantenerlo confidencial.", "La vigencia es de dos años.", "Hay una excepcion.", "Devolver las copias.", "La ley aplicable es local.", "La jurisdicción es de la ciudad.", "Información confidencial significa borradores.", "Este acuerdo es ley para cada parte."],
}


def secrecy_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agreement (doc_id, text) for each order, in one of four languages: some of its sentences, with a line break or a blank between."""
    key = F.col("o_orderkey")
    by_lang = F.array(*[F.array(*map(F.lit, s)) for s in SECRECY.values()])
    chosen = F.filter(F.get(by_lang, (key % 4).cast("int")), lambda _, i: (F.call_function("shiftright", key * 37, i) % 2 == 1) | (i == 7))
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.when(key % 3 == 0, F.array_join(chosen, "\n\n")).otherwise(F.array_join(chosen, " ")).alias("text"))


def enrichments(events: DataFrame) -> DataFrame:
    """Enrichments of some whole events; those of some cases have faults."""
    n = F.col("event_id")
    texts, none = "array<string>", F.lit(None)
    actors = F.when(n % 8 == 0, F.array(F.lit("entity:auditor"), F.lit(""), F.lit("entity:auditor"))).when((n % 401 == 0), F.array(F.lit(""))).otherwise(none.cast(texts))
    objects = F.when(n % 6 == 0, F.array(F.lit("entity:OBJ_9"), F.lit("entity:OBJ_1"))).otherwise(none.cast(texts))
    kind = F.element_at(F.array(*map(F.lit, ["date", "datetime", "relative", "unknown"])), (n % 4 + 1).cast("int"))
    rows = events.where("event_id % 2 = 0 OR event_id % 401 = 0").select(
        "case_id", "event_id", actors.alias("actors"), objects.alias("objects"), F.when(n % 397 == 0, "instant").when(n % 10 < 7, kind).alias("time_kind"), F.when(kind == "date", "2024-02-01").when(kind == "datetime", "2024-02-01T00:00:00Z").alias("time_value")
    )
    return rows.union(rows.where("event_id % 398 = 0"))


#: Sentences of stories.
STORY = [
    "Jesus spoke to the disciples.", "He asked the woman of Samaria for water!", "It was noon.", "She answered him, and her jar stood there.", "They went away.", "Was it John?", "His words stayed with the Samaritan woman.",
    "Nobody saw its light.", "John and Jesus told them.", "The disciples and their friends left.", "He and she and they heard it.", "THEIR day ended.",
]


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story (doc_id, text) for each order: twelve sentences in an order of its own, some left out."""
    key = F.col("o_orderkey")
    places = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: (key * 31 + i * i) % 3 != 0)
    text = F.array_join(F.transform(places, lambda i: F.get(F.array(*map(F.lit, STORY)), ((i * 5 + key) % 12).cast("int"))), " ")
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), text.alias("text"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in packs of ten (pack_id, relpath, text), some with carriage returns, some with an accent apart from its letter."""
    n = F.col("doc_id")
    ends = F.when(n % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(n % 7 == 0, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    return documents(spark, sf_dir).select(F.floor(n / 10).alias("pack_id"), "relpath", F.concat(ends, F.when(n % 4 == 0, F.lit("\r\ncafe\u0301 \"x\" \\ \t")).otherwise("")).alias("text"))
