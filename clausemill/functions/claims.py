"""Column functions on claim questions and policy clauses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .clauses import first_of


def any_in(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def age(q: Column) -> Column:
    """The first pattern whose number is an age."""
    found = [F.nullif(F.regexp_extract(F.lower(q), p, 1), F.lit("")).try_cast("int") for p in K.AGE_PATTERNS]
    return F.coalesce(*[F.when((a > 0) & (a < 120), a) for a in found])


def gender(q: Column) -> Column:
    return F.when(F.lower(q).rlike(K.MALE), "male").when(F.lower(q).rlike(K.FEMALE), "female")


def procedure(q: Column) -> Column:
    """The first procedure, as listed, with a keyword in the question; else the word before
    'surgery' or 'treatment'."""
    low = F.lower(q)
    listed = F.coalesce(*[F.when(any_in(low, ws), p) for p, ws in K.PROCEDURES.items()])
    other = [F.when(w != "", F.concat(w, F.lit(f" {kind}"))) for kind in ("surgery", "treatment") for w in [F.regexp_extract(low, rf"(\w+)\s+{kind}", 1)]]
    return F.coalesce(listed, *other)


def location(q: Column) -> Column:
    low = F.lower(q)
    city = F.coalesce(*[F.when(F.contains(low, F.lit(c)), F.initcap(F.lit(c))) for c in K.CITIES])
    word = F.trim(F.regexp_extract(low, r"\bin\s+([a-zA-Z\s]+?)(?:\s|,|$)", 1))
    return F.coalesce(city, F.when((F.length(word) > 2) & ~word.isin("the", "a", "an"), F.initcap(word)))


def policy_age(q: Column) -> Column:
    return first_of(F.lower(q), K.POLICY_AGE_PATTERNS).try_cast("int")


def policy_duration(q: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(q), p, 1), F.lit("")).try_cast("int") * m for p, m in K.POLICY_DURATION_PATTERNS])


def hospital(q: Column) -> Column:
    return F.trim(first_of(q, K.HOSPITAL_PATTERNS))


def date_text(q: Column) -> Column:
    return first_of(q, K.DATE_PATTERNS)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def amount(q: Column) -> Column:
    return _number(first_of(q, K.AMOUNT_PATTERNS))


def clause_amount(text: Column) -> Column:
    """The first amount pattern; lakh and crore multiply."""
    return F.coalesce(*[_number(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) * float(m) for p, m in K.CLAUSE_AMOUNT_PATTERNS])


def clause_months(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int") * m for p, m in K.CLAUSE_MONTHS_PATTERNS])


def parse(q: Column) -> dict[str, Column]:
    return {"age": age(q), "gender": gender(q), "procedure": procedure(q), "location": location(q), "policy_duration_months": policy_duration(q), "policy_age_months": policy_age(q), "hospital": hospital(q), "claim_date": date_text(q), "amount_claimed": amount(q)}


def assumptions(c: dict[str, Column]) -> Column:
    """What is assumed for what a parsed question leaves open."""
    no = lambda x: F.coalesce(x == 0, F.lit(True))
    tests = {"age": no(c["age"]), "gender": c["gender"].isNull(), "location": c["location"].isNull(), "policy": no(c["policy_age_months"]) & no(c["policy_duration_months"]), "hospital": c["hospital"].isNull()}
    return F.array_compact(F.array(*[F.when(t, K.ASSUMPTIONS[k]) for k, t in tests.items()]))


def age_factor(a: Column) -> Column:
    out = F.lit(None).cast("double")
    for lo, hi, m in reversed(K.AGE_BANDS):
        out = F.when(a.between(lo, hi), m).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def by_procedure(p: Column, values: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), F.coalesce(p, F.lit("")))


def coverage_amount(max_amount: Column, proc: Column, claimed: Column, a: Column) -> Column:
    """Largest amount in the clauses, else the procedure's limit, else the claim up to a cap;
    times the age factor."""
    base = F.coalesce(F.when(max_amount > 0, max_amount), by_procedure(proc, K.COVERAGE_LIMITS).cast("double"), F.least(F.nullif(claimed, F.lit(0.0)), F.lit(float(K.CLAIM_CAP))))
    return base * F.when(a.isNull() | (a == 0), 1.0).otherwise(age_factor(a))


def complies(clause: Column, a: Column, city: Column) -> Column:
    """Whether a claim meets a clause's condition on age (above or below a number) or on a network
    city; true where neither is set."""
    low = F.lower(clause)
    limit = F.nullif(F.regexp_extract(low, r"age[^\n]*?(\d+)", 1), F.lit("")).try_cast("int")
    aged = limit.isNotNull() & (F.coalesce(a, F.lit(0)) != 0)
    network = city.isNotNull() & F.contains(low, F.lit("network"))
    return (F.when(aged & any_in(low, ["above", "over"]), a > limit).when(aged & any_in(low, ["below", "under"]), a < limit)
            .when(network, F.lower(city).isin(K.NETWORK_CITIES)).otherwise(True))
