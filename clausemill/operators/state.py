"""Time-based state over event tables: rate windows, expiry, eviction, usage, prices, prompts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(events: DataFrame, group: Column, rates: dict[str, float] | None = None) -> DataFrame:
    """Calls, failures, tokens, cost (tokens in thousands at the provider's rate, 0 if it has
    none) and mean latency of successes, by provider."""
    ok = F.col("event_type") != "error"
    tokens = F.floor(F.abs("value")).cast("long")
    out = events.groupBy(group.alias("provider")).agg(F.count(F.lit(1)).alias("calls"), F.sum((~ok).cast("long")).alias("failures"), F.sum(F.when(ok, tokens).otherwise(0)).alias("tokens"), F.avg(F.when(ok, F.col("value"))).alias("mean_latency"))
    rate = F.create_map(*[F.lit(x) for kv in (rates or {"": 0.0}).items() for x in kv])
    return out.withColumn("cost", F.col("tokens") / 1000 * F.coalesce(F.try_element_at(rate, F.coalesce("provider", F.lit(""))), F.lit(0.0)))


def total_cost(used: DataFrame) -> DataFrame:
    """Cost, tokens and calls over all providers."""
    return used.agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def call_stats(calls: DataFrame, group: str, amount: Column, hit: Column) -> DataFrame:
    """Calls, summed and mean amount and share of hits by group; no mean where nothing was called."""
    sums = calls.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"), F.count(amount).alias("_n"), F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias("_hits"))
    return sums.select(group, "n", "total", F.try_divide("total", F.col("_n")).alias("mean"), F.try_divide("_hits", F.col("n")).alias("hit_rate"))


def running_usage(events: DataFrame) -> DataFrame:
    """The mean value of each user's events up to each one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.avg("value").over(w).alias("mean"))


def expired(entries: DataFrame, now: dt.datetime, ttl_seconds: int = 3600) -> DataFrame:
    return entries.filter(F.col("ts") < F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def least_recent(events: DataFrame, keep: int, key: str = "user_id") -> DataFrame:
    """The entries that eviction drops when only the ``keep`` last used may stay. The cut needs
    only the ``keep``-th newest access, which a bounded top-k finds."""
    last = events.groupBy(key).agg(F.max(F.struct("ts", "event_id")).alias("last"))
    kept = last.orderBy(F.desc("last")).limit(keep).select(F.col(key).alias("k"))
    return last.join(kept, last[key] == kept["k"], "left_anti").select(key, "last.ts")


def over_size(entries: DataFrame, cap: float, size: Column, order: list[str]) -> DataFrame:
    """Oldest entries that go until the rest is within ``cap``: those whose younger entries and
    they themselves sum to more. Sums go by day, then by minute within the day, then by entry
    within the minute, so no task sees all rows, or a day's, in one window."""
    rows = entries.select("*", size.alias("size"), F.date_trunc("MINUTE", "ts").alias("_minute"))
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = rows.groupBy("_minute", F.to_date("_minute").alias("_day")).agg(F.sum("size").alias("n"))
    days = minutes.groupBy("_day").agg(F.sum("n").alias("n"))
    days = days.select("_day", above(Window.orderBy(F.desc("_day"))).alias("_days"))
    minutes = minutes.withColumn("_minutes", above(Window.partitionBy("_day").orderBy(F.desc("_minute")))).join(days, "_day")
    later = minutes.select("_minute", (F.col("_days") + F.col("_minutes")).alias("_later"))
    inside = F.sum("size").over(Window.partitionBy("_minute").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(later, "_minute").filter(F.col("_later") + F.col("_inside") > cap).drop("_inside", "_later", "_minute")


def rate_window(events: DataFrame, seconds: int = 3600, limit: int = 3) -> DataFrame:
    """Events of the same user within the last ``seconds``, each one counted itself."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count(F.lit(1)).over(w)
    return events.select("event_id", n.alias("n_recent"), (n <= limit).alias("within"))


def token_cost(texts: DataFrame, model: Column, prices: DataFrame, default: str) -> DataFrame:
    """Tokens (a quarter of the length) times the price per thousand; unknown models pay the
    default's price, and nothing is charged if that has none either. ``prices`` (model, rate) is a
    catalogue."""
    base = prices.filter(F.col("model") == default).select("rate").first()
    tokens = F.floor(F.length("text") / 4)
    # texts end here, and the catalogue goes to where rows lie: few models would take all rows to few tasks
    rows = texts.select("doc_id", model.alias("model"), tokens.alias("tokens")).join(F.broadcast(prices), "model", "left")
    tokens = F.col("tokens")
    return rows.select("doc_id", "model", "tokens", (tokens / 1000 * F.coalesce("rate", F.lit(float(base[0]) if base else 0.0))).alias("cost"))


def render(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced; doubled braces stand for single ones."""
    out = F.replace(F.replace(template, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def missing_variables(template: Column, given: list[str]) -> Column:
    """Names in {braces} that ``given`` lacks, sorted."""
    return F.array_sort(F.array_except(F.regexp_extract_all(template, F.lit(r"\{([a-z_]+)\}"), F.lit(1)), F.array(*[F.lit(g) for g in given])))


TEMPLATES = [
    ("document_analysis", "Describe what kind of document this is and who it is for: {text}"),
    ("content_structuring", "List the parts of this {kind} in order: {text}"),
    ("clause_extraction", "Give each clause of the {kind} below as {{\"type\": ..., \"text\": ...}}: {text}"),
    ("section_identification", "Name the sections of: {text}"),
    ("metadata_extraction", "Find title, parties and dates in: {text}"),
    ("content_summarization", "Sum up in {limit} words: {text}"),
    ("question_answering", "Answer {question} from: {text}"),
]


DOCUMENT_KINDS = ["pdf", "docx", "email"]
#: (template, kind) pairs that don't go together.
UNFIT = {("clause_extraction", "email")}


def template(name: str) -> Column:
    """A template of the catalogue as a literal."""
    return F.lit(dict(TEMPLATES)[name])


def templates(spark) -> DataFrame:
    """The catalogue of prompt templates, with the kinds of document that each is for."""
    rows = [(name, text, [k for k in DOCUMENT_KINDS if (name, k) not in UNFIT]) for name, text in TEMPLATES]
    return spark.createDataFrame(rows, "name string, template string, kinds array<string>")


def without_template(catalogue: DataFrame, name: str) -> DataFrame:
    return catalogue.filter(F.col("name") != name)


def with_template(catalogue: DataFrame, name: str, text: str, kinds: list[str]) -> DataFrame:
    """The catalogue with a template, which takes the place of one of the same name."""
    added = catalogue.sparkSession.createDataFrame([(name, text, kinds)], "name string, template string, kinds array<string>")
    return without_template(catalogue, name).unionByName(added)


def templates_for(catalogue: DataFrame, kind: str) -> DataFrame:
    return catalogue.filter(F.array_contains("kinds", kind))


def template_info(catalogue: DataFrame) -> DataFrame:
    """A row for each template: its kinds, the variables that it wants and its length."""
    return catalogue.select("name", F.array_join("kinds", ",").alias("kinds"), F.array_join(missing_variables(F.col("template"), [""]), ",").alias("variables"), F.length("template").alias("n_chars"))


def offered(docs: DataFrame, kind: Column, catalogue: DataFrame) -> DataFrame:
    """Each document with the sorted names of the templates for its kind; the catalogue is gathered
    to a row a kind first, so documents aren't repeated, nor shuffled while Spark finds those rows small
    enough to broadcast."""
    by_kind = catalogue.select(F.explode("kinds").alias("_kind"), "name").groupBy("_kind").agg(F.array_sort(F.collect_set("name")).alias("_names"))
    none = F.array().cast("array<string>")
    return docs.withColumn("_kind", kind).join(by_kind, "_kind", "left").withColumn("templates", F.coalesce("_names", none)).drop("_kind", "_names")
