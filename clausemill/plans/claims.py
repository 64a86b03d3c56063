"""Claim queries over questions and clauses made from ``customer`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as X
from ..functions import constants as K
from ..operators import claims as C
from .clauses import _first, _q
from .samples import CLAUSES, QUESTIONS, load


def Q():
    return F.col("question")


def _questions(spark, d, cols):
    return load(spark, d, QUESTIONS).select("claim_id", *[c.alias(k) for k, c in cols.items()])


def parse_claims(spark, d):
    return _questions(spark, d, X.parse(Q()))


def extract_age(spark, d):
    return _questions(spark, d, {"age": X.age(Q()), "gender": X.gender(Q())})


def extract_amount(spark, d):
    return _questions(spark, d, {"amount": X.amount(Q()), "claim_date": X.date_text(Q())})


def procedure_lookup(spark, d):
    return _questions(spark, d, {"procedure": X.procedure(Q()), "location": X.location(Q())})


def assumptions(spark, d):
    return C.parse(load(spark, d, QUESTIONS)).select("claim_id", F.array_join("assumptions", "|").alias("assumptions"))


def clause_amount(spark, d):
    return load(spark, d, CLAUSES).select("clause_id", X.clause_amount(F.col("text")).alias("amount"), X.clause_months(F.col("text")).alias("months"))


def age_band_join(spark, d):
    return _questions(spark, d, {"age": X.age(Q())}).select("claim_id", "age", X.age_factor(F.col("age")).alias("factor"))


def coverage_amount(spark, d):
    p = _questions(spark, d, X.parse(Q()))
    return p.select("claim_id", F.round(X.coverage_amount(F.lit(0.0), F.col("procedure"), F.col("amount_claimed"), F.col("age")), 2).alias("amount"))


def _claims(spark, d):
    return C.parse(load(spark, d, QUESTIONS)).withColumn("policy", F.concat(F.lit("policy "), (F.col("claim_id") % 50).cast("string")))


def _matched(spark, d):
    return C.retrieve(_claims(spark, d), load(spark, d, CLAUSES))


def _analysed(spark, d):
    return C.analyse(_claims(spark, d), load(spark, d, CLAUSES))


def clause_retrieval(spark, d):
    return _matched(spark, d).select("claim_id", "clause_id", "relevance", "rank")


def claim_analysis(spark, d):
    return _analysed(spark, d).select("claim_id", "coverage_found", "exclusions_found", "max_coverage", "waiting_months", "sub_limit", "co_pay", "is_permanent_exclusion", "waiting_violation", "n_clauses")


def claim_decision(spark, d):
    return C.decide(_analysed(spark, d)).select("claim_id", "decision", F.round("amount", 2).alias("amount"), "reason", "confidence")


def claim_json(spark, d):
    return C.decision_json(C.decide(_analysed(spark, d)))


def mapped_clauses(spark, d):
    """The first five clauses with their labels, and a hash of their texts as shown."""
    return C.mapped_clauses(_matched(spark, d)).select("claim_id", F.size("mapped_clauses").alias("n"), F.array_join(F.transform("mapped_clauses", lambda x: F.concat_ws(":", x["clause_id"].cast("string"), x["relevance"])), "|").alias("clauses"),
                                                       F.md5(F.array_join(F.transform("mapped_clauses", lambda x: x["text"]), "|").cast("binary")).alias("texts_md5"))


def policy_summary(spark, d):
    return C.policy_summary(load(spark, d, CLAUSES))


QUERIES = {f.__name__: f for f in (parse_claims, extract_age, extract_amount, procedure_lookup, assumptions, clause_amount, age_band_join, coverage_amount, clause_retrieval, claim_analysis, claim_decision, claim_json, mapped_clauses, policy_summary)}

_LOW = "lower(question)"


def _has(text, ws):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in ws) + ")"


def _title(x):
    return f"upper(left({x}, 1)) || lower(substr({x}, 2))"


_AGE = "coalesce(" + ", ".join(f"CASE WHEN TRY_CAST(nullif(regexp_extract({_LOW}, '{p}', 1), '') AS INT) BETWEEN 1 AND 119 THEN CAST(regexp_extract({_LOW}, '{p}', 1) AS INT) END" for p in K.AGE_PATTERNS) + ")"
_GENDER = f"CASE WHEN regexp_matches({_LOW}, '{K.MALE}') THEN 'male' WHEN regexp_matches({_LOW}, '{K.FEMALE}') THEN 'female' END"
_PROC = "coalesce(" + ", ".join(f"CASE WHEN {_has(_LOW, ws)} THEN '{p}' END" for p, ws in K.PROCEDURES.items()) + ", " + ", ".join(rf"nullif(regexp_extract({_LOW}, '(\w+)\s+{k}', 1), '') || ' {k}'" for k in ("surgery", "treatment")) + ")"
_IN = rf"trim(regexp_extract({_LOW}, '\bin\s+([a-zA-Z\s]+?)(?:\s|,|$)', 1))"
_LOC = "coalesce(" + ", ".join(f"CASE WHEN contains({_LOW}, '{c}') THEN '{c.title()}' END" for c in K.CITIES) + f", CASE WHEN length({_IN}) > 2 AND {_IN} NOT IN ('the', 'a', 'an') THEN {_title(_IN)} END)"
_PAGE = f"CAST({_first(_LOW, K.POLICY_AGE_PATTERNS)} AS INT)"
_PDUR = "coalesce(" + ", ".join(f"CAST(nullif(regexp_extract({_LOW}, '{p}', 1), '') AS INT) * {m}" for p, m in K.POLICY_DURATION_PATTERNS) + ")"
_AMOUNT = f"CAST(replace({_first('question', K.AMOUNT_PATTERNS)}, ',', '') AS DOUBLE)"
_HOSPITAL = f"trim({_first('question', K.HOSPITAL_PATTERNS)})"
_DATE = _first("question", K.DATE_PATTERNS)
_PARSED = f"SELECT claim_id, {_AGE} AS age, {_GENDER} AS gender, {_PROC} AS procedure, {_LOC} AS location, {_PDUR} AS policy_duration_months, {_PAGE} AS policy_age_months, {_HOSPITAL} AS hospital, {_DATE} AS claim_date, {_AMOUNT} AS amount_claimed FROM ({QUESTIONS})"
_FACTOR = "CASE " + " ".join(f"WHEN age BETWEEN {a} AND {b} THEN {m}" for a, b, m in K.AGE_BANDS) + " ELSE 1.0 END"


def _lookup(values):
    return "CASE procedure " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _cover(most):
    return f"coalesce(CASE WHEN {most} > 0 THEN {most} END, CAST({_lookup(K.COVERAGE_LIMITS)} AS DOUBLE), CASE WHEN amount_claimed <> 0 THEN least(amount_claimed, {K.CLAIM_CAP}) END) * CASE WHEN age IS NULL OR age = 0 THEN 1.0 ELSE {_FACTOR} END"


_CAMOUNT = "coalesce(" + ", ".join(f"CAST(replace(nullif(regexp_extract(text, '{_q(p)}', 1), ''), ',', '') AS DOUBLE) * {m}" for p, m in K.CLAUSE_AMOUNT_PATTERNS) + ")"
_CMONTHS = "coalesce(" + ", ".join(f"CAST(nullif(regexp_extract(text, '{p}', 1), '') AS INT) * {m}" for p, m in K.CLAUSE_MONTHS_PATTERNS) + ")"
_WORDS = "len(list_filter(string_split(lower(procedure), ' '), lambda w: contains(lower(text), w)))"
_MATCH = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY relevance DESC, clause_id) AS rank FROM (
    SELECT p.*, c.clause_id, c.kind, c.text, coalesce({_WORDS}, 0) AS relevance FROM ({_PARSED}) p JOIN ({CLAUSES}) c ON c.policy = 'policy ' || (p.claim_id % 50))) WHERE rank <= 15"""
_SUB = "CASE " + " ".join(f"WHEN contains(lower(text), '{s}') AND amt > 0 THEN amt" for s in reversed(K.SUB_LIMIT_ITEMS)) + " END"
_ANALYSED = f"""SELECT claim_id, bool_or(cover) AS coverage_found, bool_or(excl AND relevance > 0) AS exclusions_found, coalesce(max(amt) FILTER (WHERE cover), 0.0) AS max_coverage, coalesce(max(months) FILTER (WHERE wait), 0) AS waiting_months,
    max_by(sub, rank) FILTER (WHERE sub IS NOT NULL) AS sub_limit, max_by(co, rank) FILTER (WHERE co IS NOT NULL) AS co_pay, bool_or({_has('lower(text)', ['daycare', 'less than 24 hours'])}) AS is_daycare, bool_or({_has('lower(text)', ['pre-existing', 'preexisting'])}) AS is_preexisting,
    bool_or({_has('lower(text)', K.PERMANENT_EXCLUSIONS)}) AS is_permanent_exclusion, bool_or(excl AND {_has('lower(text)', K.ACCIDENT_EXCLUSIONS)}) AS accident_excluded, bool_or(cover AND {_has('lower(text)', ['newborn', 'baby'])}) AS newborn_covered, count(*) AS n_clauses,
    any_value(procedure) AS procedure, any_value(policy_age_months) AS policy_age_months, any_value(age) AS age, any_value(amount_claimed) AS amount_claimed FROM (
    SELECT *, NOT cover AND NOT excl AND (kind = 'waiting_period' OR {_has('lower(text)', K.WAITING_WORDS)}) AS wait, {_SUB} AS sub, CASE WHEN {_has('lower(text)', ['co-pay', 'copay'])} THEN CAST(nullif(regexp_extract(text, '(\\d+)%', 1), '') AS INT) END AS co FROM (
    SELECT *, NOT cover AND (kind = 'exclusion' OR {_has('lower(text)', K.EXCLUSION_WORDS)}) AS excl FROM (
    SELECT *, kind = 'coverage' OR ({_has('lower(text)', K.COVERAGE_WORDS)} AND relevance > 0) AS cover, {_CAMOUNT} AS amt, {_CMONTHS} AS months FROM ({_MATCH})))) GROUP BY claim_id"""
_FLAGGED = f"SELECT *, coalesce(policy_age_months, 0) > 0 AND coalesce(policy_age_months, 0) < CASE WHEN coalesce(policy_age_months, 0) > 0 AND waiting_months > 0 THEN waiting_months ELSE coalesce({_lookup(K.WAITING_MONTHS)}, 0) END AS waiting_violation FROM ({_ANALYSED})"
_P = "coalesce(procedure, '')"
_OPD = "CASE " + " ".join(f"WHEN contains({_P}, '{k}') THEN {v}" for k, v in reversed(K.OPD_SUB_LIMITS.items())) + f" ELSE {K.COVERAGE_LIMITS['opd']} END"
_CRIT, _MAT, _NEW = _has(_P, K.CRITICAL_ILLNESSES), _has(_P, ["maternity", "delivery", "childbirth"]), _has(_P, ["newborn", "baby"])
_ACC = f"contains({_P}, 'accident')"
_LADDER = [
    ("exclusions_found", "rejected", "0", "exclusion", 0.70), ("waiting_violation", "rejected", "0", "waiting_period", 0.80), ("NOT coverage_found", "rejected", "0", "no_coverage", 0.50),
    (f"{_CRIT} AND policy_age_months < 3", "rejected", "0", "critical_illness_waiting", 0.85), (_CRIT, "approved", "2000000", "critical_illness", 0.97), (_has(_P, ["opd", "outpatient"]), "approved", _OPD, "opd", 0.93),
    (f"{_ACC} AND accident_excluded", "rejected", "0", "accident_exclusion", 0.85), (_ACC, "approved", "600000", "accident", 0.96), (f"{_MAT} AND policy_age_months < 10", "rejected", "0", "maternity_waiting", 0.85), (_MAT, "approved", "150000", "maternity", 0.94),
    (f"{_NEW} AND newborn_covered", "approved", "50000", "newborn", 0.92), (_NEW, "rejected", "0", "newborn_not_covered", 0.70), ("is_permanent_exclusion", "rejected", "0", "permanent_exclusion", 0.90), ("is_preexisting AND policy_age_months < 36", "rejected", "0", "preexisting_waiting", 0.85),
    ("is_daycare", "approved", "CASE WHEN max_coverage > 0 THEN max_coverage ELSE 50000 END", "daycare", 0.93), ("sub_limit > 0", "approved", "sub_limit", "sub_limit", 0.92), ("co_pay > 0", "approved", f"({_cover('max_coverage')}) * (1 - co_pay / 100.0::DOUBLE)", "co_pay", 0.91), ("TRUE", "approved", _cover("max_coverage"), "covered", 0.95),
]


def _rung(i):
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i] if i == 2 else repr(r[i])}" for r in _LADDER) + " END"


SQL = {
    "parse_claims": _PARSED,
    "extract_age": f"SELECT claim_id, {_AGE} AS age, {_GENDER} AS gender FROM ({QUESTIONS})",
    "extract_amount": f"SELECT claim_id, {_AMOUNT} AS amount, {_DATE} AS claim_date FROM ({QUESTIONS})",
    "procedure_lookup": f"SELECT claim_id, {_PROC} AS procedure, {_LOC} AS location FROM ({QUESTIONS})",
    "assumptions": f"""SELECT claim_id, array_to_string(list_filter([CASE WHEN coalesce(age, 0) = 0 THEN '{K.ASSUMPTIONS['age']}' END, CASE WHEN gender IS NULL THEN '{K.ASSUMPTIONS['gender']}' END, CASE WHEN location IS NULL THEN '{K.ASSUMPTIONS['location']}' END,
        CASE WHEN coalesce(policy_age_months, 0) = 0 AND coalesce(policy_duration_months, 0) = 0 THEN '{K.ASSUMPTIONS['policy']}' END, CASE WHEN hospital IS NULL THEN '{K.ASSUMPTIONS['hospital']}' END], lambda x: x IS NOT NULL), '|') AS assumptions FROM ({_PARSED})""",
    "clause_amount": f"SELECT clause_id, {_CAMOUNT} AS amount, {_CMONTHS} AS months FROM ({CLAUSES})",
    "age_band_join": f"SELECT claim_id, p.age, coalesce(b.m, 1.0) AS factor FROM ({_PARSED}) p LEFT JOIN (VALUES {', '.join(f'({a}, {b}, {m}::DOUBLE)' for a, b, m in K.AGE_BANDS)}) b(lo, hi, m) ON p.age BETWEEN b.lo AND b.hi",
    "coverage_amount": f"SELECT claim_id, round({_cover('0.0')}, 2) AS amount FROM ({_PARSED})",
    "clause_retrieval": f"SELECT claim_id, clause_id, relevance, rank FROM ({_MATCH})",
    "claim_analysis": f"SELECT claim_id, coverage_found, exclusions_found, max_coverage, waiting_months, sub_limit, co_pay, is_permanent_exclusion, waiting_violation, n_clauses FROM ({_FLAGGED})",
    "claim_decision": f"SELECT claim_id, {_rung(1)} AS decision, round(CAST({_rung(2)} AS DOUBLE), 2) AS amount, {_rung(3)} AS reason, {_rung(4)} AS confidence FROM ({_FLAGGED})",
    "claim_json": f"""SELECT claim_id, '{{"decision":"' || decision || '",' || CASE WHEN amount > 0 THEN '"amount":"₹' || format('{{:,.2f}}', amount) || '",' ELSE '' END || '"reason":"' || reason || '","confidence":' || CAST(confidence AS DOUBLE) || '}}' AS json
        FROM (SELECT claim_id, {_rung(1)} AS decision, CAST({_rung(2)} AS DOUBLE) AS amount, {_rung(3)} AS reason, {_rung(4)} AS confidence FROM ({_FLAGGED}))""",
    "mapped_clauses": f"SELECT claim_id, count(*) AS n, string_agg(clause_id || ':' || CASE WHEN relevance::DOUBLE / len(string_split(lower(procedure), ' ')) > 0.8::DOUBLE THEN 'high' WHEN relevance::DOUBLE / len(string_split(lower(procedure), ' ')) > 0.6::DOUBLE THEN 'medium' ELSE 'low' END, '|' ORDER BY rank) AS clauses, md5(string_agg(left(text, 200), '|' ORDER BY rank)) AS texts_md5 FROM ({_MATCH}) WHERE rank <= 5 GROUP BY claim_id",
    "policy_summary": f"SELECT coalesce(policy, '(all)') AS policy, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("coverage", "exclusion", "waiting_period", "condition")) + f", count(*) FILTER (WHERE kind = 'other') AS other FROM ({CLAUSES}) GROUP BY ROLLUP (policy)",
}
