"""Facts from credit records, clinical records, contracts and multilingual agreements; validation of answers against facts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DTI_PERCENT, MIN_SCORE, MIN_MONTHS = 55, 640, 24
SYSTOLIC, DIASTOLIC, OLD, NEXT_DAYS = 140, 90, 50, 30
#: Words that vote for a language; ties go to the first.
VOTES = {
    "fr": "accord|confidentielle|juridiction|loi|partie",
    "de": "vereinbarung|vertraulich|gerichtsstand|recht|partei",
    "es": "acuerdo|confidencial|jurisdiccion|ley|parte",
    "en": "agreement|confidential|jurisdiction|law|party",
}
#: Patterns that a clause's sentence must all have, by language and clause.
CLAUSES = {
    "en": {
        "confidentiality_obligations": ["confidential", "(shall|must|agree)"],
        "term_duration": ["(term|duration)"],
        "exceptions": ["exception"],
        "return_or_destruction": ["(return|destroy)"],
        "governing_law": ["governed by"],
        "jurisdiction": ["jurisdiction"],
        "definition_of_confidential_information": ["confidential information", "means|includes"],
    },
    "fr": {
        "confidentialite": ["confidenti", "(doit|s'engage|obligation)"],
        "duree": ["(dur[ée]e|terme)"],
        "exceptions": ["exception"],
        "restitution": ["(restituer|d[ée]truire|retourner)"],
        "loi_applicable": ["loi applicable|r[ée]gie par"],
        "juridiction": ["juridiction|tribunaux comp[ée]tents"],
        "definition_information_confidentielle": ["information confidentielle", "(d[ée]signe|s'entend|signifie)"],
    },
    "de": {
        "vertraulichkeitspflichten": ["vertraulich", "(muss|verpflichtet|pflicht)"],
        "laufzeit": ["laufzeit|dauer"],
        "ausnahmen": ["ausnahmen?"],
        "rueckgabe": ["(zur[üu]ckgeben|vernichten)"],
        "anwendbares_recht": ["(gilt .* recht|geltet .* recht|anwendbares recht)"],
        "gerichtsstand": ["gerichtsstand|zust[äa]ndige gerichte"],
        "definition_vertrauliche_informationen": ["vertrauliche informationen", "(bedeutet|umfasst|sind)"],
    },
    "es": {
        "obligaciones_confidencialidad": ["confidencial", "(deber[aá]|obligaci[oó]n|se compromete)"],
        "vigencia": ["vigencia|duraci[oó]n"],
        "excepciones": ["excepciones?"],
        "devolucion": ["(devolver|destruir)"],
        "ley_aplicable": ["ley aplicable|regir[aá]"],
        "jurisdiccion": ["jurisdicci[oó]n|tribunales competentes"],
        "definicion_informacion_confidencial": ["informaci[oó]n confidencial", "(significa|incluye|se entiende)"],
    },
}

#: Fixed values of the answer checks.
CLAIM = r"([A-Za-z_][A-Za-z0-9_.\[\]-]*)\s*[=:]\s*([^,\n;]+)"
CITATION = r"(?i)(?:evidence|cite)\s*[:#]\s*([A-Za-z0-9_-]+)"
TOLERANCE = 1e-6


def rounded_percent(ratio: str) -> Column:
    """A ratio (double, not negative, below 2^40) in whole percent, by the value that its bits have: what is written as a half may lie above or below it.
    True halves go to the even percent.

    Halves between percents are (2n + 1) / 200. The double next to that is equal to the ratio or decides already; if equal, its bits as an integer m, which is the
    double times 2^k, are compared as 200 m with (2n + 1) 2^k, both below 2^63."""
    low = F.floor(F.col(ratio) * 100) - 1

    def above(n: Column) -> Column:
        half = (2 * n + 1).cast("double") / 200
        k = 53 - F.floor(F.log2(half)).cast("int")
        bits, written = (half * F.pow(F.lit(2.0), k)).cast("bigint") * 200, (2 * n + 1).cast("bigint") * F.pow(F.lit(2.0), k).cast("bigint")
        tie = F.when(bits != written, bits > written).otherwise(F.pmod(n, F.lit(2)) == 1)
        return F.when(n < 0, 1).when(F.col(ratio) != half, (F.col(ratio) > half).cast("int")).otherwise(tie.cast("int"))

    return (low + above(low) + above(low + 1) + above(low + 2)).cast("bigint")


def credit_decisions(applicants: DataFrame) -> DataFrame:
    """Debt to income in whole percent, signals, tier, decision and rate. Missing numbers count as 0; without income the ratio is 0."""
    numbers = ["income", "debt", "score", "delinquencies", "employment_months"]
    rows = applicants.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    ratio = F.when(F.col("income") != 0, F.col("debt").cast("double") / F.col("income")).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).withColumn("dti_percent", rounded_percent("ratio"))
    low = F.col("score") < MIN_SCORE
    return rows.select(
        "applicant_id",
        "dti_percent",
        F.when(F.col("dti_percent") <= MAX_DTI_PERCENT, "pass").otherwise("fail").alias("dti_status"),
        F.when(F.col("delinquencies") > 0, "caution").otherwise("pass").alias("delinquency_status"),
        F.when(low, "caution").otherwise("pass").alias("score_status"),
        F.when(F.col("employment_months") >= MIN_MONTHS, "pass").otherwise("caution").alias("employment_status"),
        F.when(low, "subprime_tier3").otherwise("prime_tier1").alias("risk_tier"),
        F.when(F.col("dti_percent") <= MAX_DTI_PERCENT, "approved_conditional").otherwise("denied").alias("decision"),
        F.when(low, "0.089").otherwise("0.049").alias("rate"),
    )


def clinical_screen(patients: DataFrame) -> DataFrame:
    """Status of vitals, risk categories, the screen, and the date of the next assessment."""
    high = (F.col("systolic") >= SYSTOLIC) | (F.col("diastolic") >= DIASTOLIC)
    return patients.select(
        "patient_id",
        F.when(F.col("systolic") >= SYSTOLIC, "elevated").otherwise("normal").alias("systolic_status"),
        F.when(F.col("diastolic") >= DIASTOLIC, "elevated").otherwise("normal").alias("diastolic_status"),
        F.when(F.col("age") >= OLD, "moderate_risk").otherwise("low_risk").alias("age_risk"),
        F.when(F.col("family_history"), "high_risk").otherwise("low_risk").alias("family_risk"),
        F.when(high, "positive_screen_hypertension").otherwise("negative_screen").alias("assessment"),
        F.coalesce(F.date_add(F.try_to_date("encounter_date", "yyyy-MM-dd"), NEXT_DAYS).cast("string"), F.lit("{missing:next_assessment_date}")).alias("next_assessment"),
        F.format_string("BP %d/%d mmHg", "systolic", "diastolic").alias("bp_text"),
    )


def symptoms(patients: DataFrame) -> DataFrame:
    """Symptoms of a complaint; the duration is looked for in the whole complaint."""
    parts = F.filter(F.transform(F.split("complaint", ","), lambda p: F.trim(p)), lambda p: p != "")
    days = F.regexp_extract("complaint", r"([0-9]+)\s*days", 1).try_cast("bigint")
    rows = patients.select("patient_id", F.posexplode(parts).alias("position", "part"), days.alias("duration_days"))
    return rows.select("patient_id", F.col("position").cast("bigint").alias("position"), F.trim(F.split_part("part", F.lit(" for "), F.lit(1))).alias("symptom"), "duration_days")


def with_language(rows: DataFrame) -> DataFrame:
    """rows with the votes for each language (n_fr and so on) and the language that has most of them. Words that vote are found in one pass over a text."""
    other, words = r"[\p{L}\p{N}_]", "|".join(VOTES.values())
    said = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"(?<!{other})(?:{words})(?!{other})"), 0)
    rows = rows.withColumn("said", said)
    votes = lambda p: F.size(F.filter("said", lambda w: w.isin(p.split("|")))).cast("bigint")
    rows = rows.withColumns({f"n_{k}": votes(p) for k, p in VOTES.items()}).drop("said")
    best = F.greatest(*[F.col(f"n_{k}") for k in VOTES])
    pick = F.when(best == 0, "en")
    for k in VOTES:
        pick = pick.when(F.col(f"n_{k}") == best, k)
    return rows.withColumn("language", pick)


def language_votes(docs: DataFrame) -> DataFrame:
    """The language with most keyword hits; ties to the first of fr, de, es, en; without a hit en."""
    return with_language(docs.select("doc_id", "text")).drop("text")


def all_patterns(patterns: list[str]):
    def meets(sentence):
        return reduce(and_, [sentence.rlike(p) for p in patterns])

    return meets


def with_sentences(docs: DataFrame) -> DataFrame:
    split = F.filter(F.split("text", r"(?<=[.!?])\s+|\n\n+"), lambda s: F.trim(s) != "")
    return docs.select("doc_id", "lang", split.alias("sentences")).withColumn("low", F.transform("sentences", lambda s: F.lower(s)))


def met_clauses() -> Column:
    """The clauses of a document's language that some of its sentences (low) meets, with the first such one's place."""
    place = lambda patterns: F.array_position(F.transform("low", all_patterns(patterns)), True).cast("bigint").alias("sentence")
    by_lang = [F.when(F.col("lang") == lang, F.array(*[F.struct(F.lit(name).alias("clause"), place(p)) for name, p in rules.items()])) for lang, rules in CLAUSES.items()]
    return F.filter(F.coalesce(*by_lang), lambda c: c["sentence"] > 0)


def clauses(docs: DataFrame) -> DataFrame:
    """For each document of a language with rules: the clauses that some sentence meets, with the first such sentence's place."""
    return with_sentences(docs).select("doc_id", "lang", F.inline(met_clauses()))


def clause_texts(docs: DataFrame) -> DataFrame:
    """clauses() with the first sentence's text as it is written, trimmed. A document has all that it takes, so nothing is shuffled."""
    text = lambda k: F.regexp_replace(F.get("sentences", (k - 1).cast("int")), r"(?U)^\s+|\s+$", "").alias("text")
    told = F.transform(met_clauses(), lambda c: F.struct(c["clause"].alias("clause"), c["sentence"].alias("sentence"), text(c["sentence"])))
    return with_sentences(docs).select("doc_id", "lang", F.inline(told))


MONTH_DAY_YEAR = r"((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},\s+[0-9]{4})"


def contract_fields(contracts: DataFrame) -> DataFrame:
    """Effective date, governing law, termination clause, defined terms and warnings of contract texts."""
    found = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    rows = contracts.select(
        "contract_id",
        F.try_to_date(F.initcap(F.regexp_replace(found(rf"(?i)(?:effective\s+date|entered\s+into\s+as\s+of)\W{{0,20}}{MONTH_DAY_YEAR}"), r"\s+", " ")), "MMMM d, yyyy").cast("string").alias("effective_date"),
        found(r"(?i)This Agreement shall be governed by the laws of ([^.]+)\.").alias("jurisdiction"),
        F.get(F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[^.]*\."), 0), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c.rlike(r"(?i)\bterminate[ds]?\b")), 0).alias("termination"),
        F.size(F.regexp_extract_all("text", F.lit(r'(?i)"([A-Z][A-Za-z0-9 ]+)"\s+(?:means|shall mean)\s+[^.]+\.'), 1)).cast("bigint").alias("n_terms"),
    )
    warn = {"effective_date": "effective_date_not_found", "jurisdiction": "governing_law_not_found", "termination": "termination_conditions_not_found"}
    return rows.withColumn("warnings", F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(w)) for c, w in warn.items()])), ","))


def obligations(contracts: DataFrame) -> DataFrame:
    """Sentences with an obligation, and the party that is named first in each; sentences without a party are left out."""
    sentences = F.transform(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]"), 0), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    rows = contracts.select("contract_id", "licensor", "licensee", F.posexplode(sentences).alias("position", "sentence")).where(F.col("sentence").rlike(r"(?i)\b(shall|must|agrees to|is required to|will)\b"))
    at = lambda *names: F.least(*[F.nullif(F.instr("sentence", n) if isinstance(n, str) else F.expr(f"instr(sentence, {n[0]})"), F.lit(0)) for n in names])
    left, right = at("Licensor", ["licensor"]), at("Licensee", ["licensee"])
    party = F.when(right.isNull() | (left < right), F.col("licensor")).when(right.isNotNull(), F.col("licensee"))
    party = F.when(left.isNull() & right.isNull(), F.lit(None)).otherwise(party)
    return rows.select("contract_id", F.col("position").cast("bigint").alias("position"), party.alias("party"), "sentence").where("party is not null")


def checked_answers(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims of answers (id, answer), key = value or key: value up to a comma, semicolon or line end, against facts (id, key, value).

    The last claim of a key counts. Verdicts: unknown key; for two numbers, ok within TOLERANCE; a number against no number is not
    judged and ok; other values are equal in any case of letters, or a mismatch.
    """
    claims = answers.select("id", F.posexplode(F.regexp_extract_all("answer", F.lit(CLAIM), 0)).alias("position", "claim"))
    part = lambda group: F.regexp_extract("claim", CLAIM, group)
    claims = claims.select("id", part(1).alias("key"), "position", F.regexp_replace(F.trim(part(2)), "^\"+|\"+$|^'+|'+$", "").alias("claimed"))
    last = claims.groupBy("id", "key").agg(F.max_by("claimed", "position").alias("claimed"))
    said, known = F.expr("try_cast(claimed AS double)"), F.expr("try_cast(value AS double)")
    same = F.when(said.isNotNull() & known.isNotNull(), F.abs(said - known) <= TOLERANCE).when(said.isNotNull() | known.isNotNull(), True).otherwise(F.lower("value") == F.lower("claimed"))
    verdict = F.when(F.col("value").isNull(), "unknown").when(same, "ok").otherwise("mismatch")
    return last.join(facts, ["id", "key"], "left").select("id", "key", "claimed", verdict.alias("verdict"))


def answer_faults(answers: DataFrame) -> DataFrame:
    """(id, fault, item) for answers (id, answer, must_cite, forbidden: arrays): citations that are missing, or extra (told, but no
    failure), and forbidden topics that the answer names in any case of letters. Null answers and arrays are empty."""
    empty = F.array().cast("array<string>")
    must, topics = (F.coalesce(c, empty) for c in ("must_cite", "forbidden"))
    answer = F.coalesce("answer", F.lit(""))
    cited = F.regexp_extract_all(answer, F.lit(CITATION), 1)
    named = F.filter(topics, lambda t: (t != "") & F.contains(F.lower(answer), F.lower(t)))
    faults = {"missing_citation": F.array_except(must, cited), "extra_citation": F.array_except(cited, must), "forbidden_topic": F.array_distinct(named)}
    labelled = lambda name, found: F.transform(found, lambda x: F.struct(F.lit(name).alias("fault"), x.alias("item")))
    items = F.concat(*[labelled(name, found) for name, found in faults.items()])
    return answers.select("id", F.explode(items).alias("f")).select("id", "f.fault", "f.item")
