"""Claims: parse questions, retrieve clauses, fold them into flags, decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims as X
from ..functions import constants as K


def parse(questions: DataFrame) -> DataFrame:
    """The question's columns and what it says."""
    out = questions.withColumns(X.parse(F.col("question")))
    cols = {c: F.col(c) for c in ("age", "gender", "location", "policy_age_months", "policy_duration_months", "hospital")}
    return out.withColumn("assumptions", X.assumptions(cols))


def best_clauses(claims: DataFrame, clauses: DataFrame, k: int = 15) -> DataFrame:
    """(policy, procedure, rank, relevance, clause_id, kind, text): the ``k`` clauses of a policy
    that name most words of a procedure; ties by clause id, which names one clause.

    Ranks depend on the policy and the procedure alone, so they are made for distinct pairs and
    not for claims. Ids and scores are cut to ``k`` in each task before they are shuffled; texts
    meet the few that are left.
    """
    wanted = claims.select("policy", "procedure").distinct().withColumn("words", F.split(F.lower("procedure"), " "))
    low = clauses.select("policy", "clause_id", F.lower("text").alias("low"))
    named = F.coalesce(F.size(F.filter("words", lambda w: F.contains(F.col("low"), w))), F.lit(0))
    scored = low.join(wanted, "policy").select("policy", "procedure", "clause_id", named.alias("relevance"))
    w = Window.partitionBy("policy", "procedure").orderBy(F.desc("relevance"), "clause_id")
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(clauses.select("clause_id", "kind", "text"), "clause_id")


def _for_claims(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """The claims with the rows of their policy and procedure (which may be null)."""
    rows = rows.withColumnsRenamed({"policy": "_policy", "procedure": "_procedure"})
    return claims.join(rows, (F.col("policy") == F.col("_policy")) & F.col("procedure").eqNullSafe(F.col("_procedure"))).drop("_policy", "_procedure")


def retrieve(claims: DataFrame, clauses: DataFrame, k: int = 15) -> DataFrame:
    """The best clauses of each claim, a row each, with relevance and rank."""
    return _for_claims(claims, best_clauses(claims, clauses, k))


def analyse(claims: DataFrame, clauses: DataFrame, k: int = 15) -> DataFrame:
    """One row a claim: flags and amounts over its best clauses, in rank order. A clause is
    coverage, exclusion, waiting period or condition, the first that fits. All of it is settled for
    policy and procedure before claims are joined."""
    any_in = lambda ws: X.any_in(F.col("low"), ws)
    kind = lambda k: F.col("kind") == k
    rows = best_clauses(claims, clauses, k).withColumns({"low": F.lower("text"), "amount": X.clause_amount(F.col("text")), "months": X.clause_months(F.col("text"))})
    rows = rows.withColumn("mentions", F.col("relevance") > 0).withColumn("cover", kind("coverage") | (any_in(K.COVERAGE_WORDS) & F.col("mentions")))
    rows = rows.withColumn("exclude", ~F.col("cover") & (kind("exclusion") | any_in(K.EXCLUSION_WORDS)))
    rows = rows.withColumn("wait", ~F.col("cover") & ~F.col("exclude") & (kind("waiting_period") | any_in(K.WAITING_WORDS)))
    sub = F.coalesce(*reversed([F.when(any_in([s]) & (F.col("amount") > 0), F.col("amount")) for s in K.SUB_LIMIT_ITEMS]))
    copay = F.when(any_in(["co-pay", "copay"]), F.nullif(F.regexp_extract("text", r"(\d+)%", 1), F.lit("")).cast("int"))
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    last = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col("rank")))
    found = rows.withColumns({"sub": sub, "copay": copay}).groupBy("policy", "procedure").agg(
        flag(F.col("cover")).alias("coverage_found"), flag(F.col("exclude") & F.col("mentions")).alias("exclusions_found"), F.coalesce(F.max(F.when(F.col("cover"), F.col("amount"))), F.lit(0.0)).alias("max_coverage"),
        F.coalesce(F.max(F.when(F.col("wait"), F.col("months"))), F.lit(0)).alias("waiting_months"), last("sub").alias("sub_limit"), last("copay").alias("co_pay"),
        flag(any_in(["daycare", "less than 24 hours"])).alias("is_daycare"), flag(any_in(["pre-existing", "preexisting"])).alias("is_preexisting"),
        flag(any_in(K.PERMANENT_EXCLUSIONS)).alias("is_permanent_exclusion"), flag(F.col("exclude") & any_in(K.ACCIDENT_EXCLUSIONS)).alias("accident_excluded"),
        flag(F.col("cover") & any_in(["newborn", "baby"])).alias("newborn_covered"), F.count(F.lit(1)).alias("n_clauses"))
    out = _for_claims(claims.select("claim_id", "policy", "procedure", "policy_age_months", "age", "amount_claimed"), found)
    months, own = F.coalesce("policy_age_months", F.lit(0)), F.coalesce(X.by_procedure(F.col("procedure"), K.WAITING_MONTHS), F.lit(0))
    due = F.when((months > 0) & (F.col("waiting_months") > 0), F.col("waiting_months")).otherwise(own)
    return out.withColumn("waiting_violation", (months > 0) & (months < due))


def decide(a: DataFrame) -> DataFrame:
    """claim_id, decision, amount, reason, confidence: a ladder whose first true rung counts."""
    p = F.coalesce("procedure", F.lit(""))
    has = lambda *ws: X.any_in(p, list(ws))
    months = F.col("policy_age_months")
    under = lambda n: F.coalesce(months < n, F.lit(False))
    opd = has("opd", "outpatient")
    opd_limit = F.coalesce(*[F.when(has(k), float(v)) for k, v in reversed(K.OPD_SUB_LIMITS.items())], F.lit(float(K.COVERAGE_LIMITS["opd"])))
    cover = X.coverage_amount(F.col("max_coverage"), F.col("procedure"), F.col("amount_claimed"), F.col("age"))
    critical, maternity, newborn = has(*K.CRITICAL_ILLNESSES), has("maternity", "delivery", "childbirth"), has("newborn", "baby")
    rungs = [
        (F.col("exclusions_found"), "rejected", F.lit(0.0), "exclusion", 0.70),
        (F.col("waiting_violation"), "rejected", F.lit(0.0), "waiting_period", 0.80),
        (~F.col("coverage_found"), "rejected", F.lit(0.0), "no_coverage", 0.50),
        (critical & under(K.WAITING_MONTHS["critical illness"]), "rejected", F.lit(0.0), "critical_illness_waiting", 0.85),
        (critical, "approved", F.lit(float(K.COVERAGE_LIMITS["critical illness"])), "critical_illness", 0.97),
        (opd, "approved", opd_limit, "opd", 0.93),
        (has("accident") & F.col("accident_excluded"), "rejected", F.lit(0.0), "accident_exclusion", 0.85),
        (has("accident"), "approved", F.lit(2.0 * K.COVERAGE_LIMITS["accident"]), "accident", 0.96),
        (maternity & under(K.WAITING_MONTHS["maternity"]), "rejected", F.lit(0.0), "maternity_waiting", 0.85),
        (maternity, "approved", F.lit(float(K.COVERAGE_LIMITS["maternity"])), "maternity", 0.94),
        (newborn & F.col("newborn_covered"), "approved", F.lit(float(K.NEWBORN_LIMIT)), "newborn", 0.92),
        (newborn, "rejected", F.lit(0.0), "newborn_not_covered", 0.70),
        (F.col("is_permanent_exclusion"), "rejected", F.lit(0.0), "permanent_exclusion", 0.90),
        (F.col("is_preexisting") & under(36), "rejected", F.lit(0.0), "preexisting_waiting", 0.85),
        (F.col("is_daycare"), "approved", F.when(F.col("max_coverage") > 0, F.col("max_coverage")).otherwise(float(K.DAYCARE_LIMIT)), "daycare", 0.93),
        (F.coalesce(F.col("sub_limit") > 0, F.lit(False)), "approved", F.col("sub_limit"), "sub_limit", 0.92),
        (F.coalesce(F.col("co_pay") > 0, F.lit(False)), "approved", cover * (1 - F.col("co_pay") / 100), "co_pay", 0.91),
        (F.lit(True), "approved", cover, "covered", 0.95),
    ]
    rung = reduce(lambda rest, r: F.when(r[0], F.struct(F.lit(r[1]).alias("decision"), r[2].cast("double").alias("amount"), F.lit(r[3]).alias("reason"), F.lit(r[4]).alias("confidence"))).otherwise(rest), reversed(rungs), F.lit(None))
    return a.select("claim_id", rung.alias("d")).select("claim_id", "d.*")


def decision_json(decisions: DataFrame) -> DataFrame:
    """The decision as JSON: amounts as rupees with two digits, null where there is none."""
    shown = F.when(F.col("amount") > 0, F.concat(F.lit("₹"), F.format_number("amount", 2)))
    return decisions.select("claim_id", F.to_json(F.struct("decision", shown.alias("amount"), "reason", F.round("confidence", 2).alias("confidence"))).alias("json"))


def mapped_clauses(matched: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` clauses of each claim, cut at 200 characters, with a label of the share of
    the procedure's words that they name: above 0.8 high, above 0.6 medium, else low."""
    share = F.coalesce(F.col("relevance") / F.size(F.split(F.lower("procedure"), " ")), F.lit(0.0))
    label = F.when(share > 0.8, "high").when(share > 0.6, "medium").otherwise("low")
    rows = matched.filter(F.col("rank") <= n).select("claim_id", "rank", "clause_id", F.left("text", F.lit(200)).alias("text"), label.alias("relevance"))
    return rows.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "clause_id", "text", "relevance"))).alias("mapped_clauses"))


def policy_summary(clauses: DataFrame) -> DataFrame:
    """Clauses by policy and kind, kinds that have no column under ``other``, and a total row."""
    kinds = ["coverage", "exclusion", "waiting_period", "condition"]
    n = lambda c: F.sum(c.cast("long"))
    return clauses.rollup("policy").agg(F.count(F.lit(1)).alias("total"), *[n(F.col("kind") == k).alias(k) for k in kinds], n(~F.col("kind").isin(kinds)).alias("other")).withColumn("policy", F.coalesce("policy", F.lit("(all)")))
