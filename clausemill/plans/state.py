"""Queries on operational state over ``events`` and on prompts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import state as S
from ..sources import sinks
from ..sources.tables import table
from ..streaming import stateful

NOW = dt.datetime(2024, 1, 20, 12, 0, 0)


def _events(spark, d):
    return table(spark, d, "events")


def usage_stats(spark, d):
    return _usage(spark, d).withColumn("mean_latency", F.round("mean_latency", 6)).withColumn("cost", F.round("cost", 6))


def _usage(spark, d):
    return S.usage(_events(spark, d), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")), {"p0": 0.03, "p1": 0.002, "p2": 0.01})


def usage_cost(spark, d):
    return S.total_cost(_usage(spark, d)).withColumn("cost", F.round("cost", 6))


def running_usage(spark, d):
    return S.running_usage(_events(spark, d)).withColumn("mean", F.round("mean", 6))


def ttl_expired(spark, d):
    return S.expired(_events(spark, d), NOW).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def lru_evict(spark, d):
    return S.least_recent(_events(spark, d), 50).select("user_id")


def size_evict(spark, d):
    return S.over_size(_events(spark, d), 5000, F.floor(F.abs("value")).cast("long") % 10 + 1, ["ts", "event_id"]).select("event_id", "size")


def rate_window(spark, d):
    return S.rate_window(_events(spark, d))


def rate_limit(spark, d):
    """What the limiter allows when only allowed events count (5 an hour)."""
    return stateful.rate_limit_batch(_events(spark, d), 5, 3600.0)


def circuit_breaker(spark, d):
    return stateful.circuit_breaker_batch(_events(spark, d), 3, 86400.0)


def token_cost(spark, d):
    prices = spark.createDataFrame([("m0", 0.03), ("m1", 0.002), ("m2", 0.01)], "model string, rate double")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return S.token_cost(docs, F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")), prices, "m0").withColumn("cost", F.round("cost", 6))


def render_prompt(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    prompt = S.render(S.template("clause_extraction"), {"kind": F.coalesce("lang", F.lit("?")), "text": F.coalesce("text", F.lit(""))})
    rows = docs.select("doc_id", prompt.alias("prompt"), F.array_join(S.missing_variables(S.template("clause_extraction"), ["text"]), ",").alias("missing"))
    return rows.select("doc_id", F.length("prompt").alias("n_chars"), F.sha2(F.col("prompt").cast("binary"), 256).alias("sha"), "missing")


def template_choice(spark, d):
    """The templates on offer for each document, after one was added and one taken away."""
    catalogue = S.without_template(S.with_template(S.templates(spark), "risk_review", "Name the risks in: {text}", ["docx"]), "question_answering")
    docs = table(spark, d, "documents").select("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("pdf", "docx", "email", "text")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return S.offered(docs, kind, catalogue).select("doc_id", F.size("templates").alias("n_templates"), F.array_join("templates", ",").alias("templates"))


def conversation_summary(spark, d):
    """Turns, roles and characters by conversation."""
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum((F.col("role") == "user").cast("long")).alias("n_user"), F.sum(F.length("text")).alias("n_chars"), F.max_by("role", "turn").alias("last_role"))


def cache_reads(spark, d):
    """Reads of a cache with a life of six hours, in order of time."""
    return stateful.cache_batch(_events(spark, d), 6 * 3600.0).withColumn("age_seconds", F.round("age_seconds", 3))


def _cache(docs):
    """A third of the documents, made a minute apart before ``NOW``."""
    at = F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")
    made = F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00' - make_dt_interval(0, 0, CAST(doc_id % 90 AS INT), 0)")
    own = docs.filter("doc_id % 3 = 0 AND trim(text) <> ''").groupBy("text").agg(F.min(F.col("doc_id") % 90).alias("doc_id"))
    return own.select(sinks.cache_key(F.col("text"), "m").alias("cache_key"), F.length("text").alias("value"), made.alias("created_at"), F.lit(0).cast("long").alias("access_count"), made.alias("last_accessed")), at


def cache_split(spark, d):
    """Texts found in the cache, those it lacks or that have expired, and blank ones."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache, now = _cache(docs)
    got = sinks.looked_up(docs, cache, "m", now)
    return got.select("doc_id", F.col("cache_key").isNull().alias("blank"), "hit", F.col("value").isNotNull().alias("has_value"), F.coalesce(F.col("access_count"), F.lit(0).cast("long")).alias("access_count"))


def cache_after(spark, d):
    """What the cache holds after that batch: all texts, by how often they were read."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache, now = _cache(docs)
    reads = sinks.looked_up(docs, cache, "m", now)
    made = reads.filter("NOT hit AND cache_key IS NOT NULL").select("cache_key", F.length("text").alias("value"))
    return sinks.refreshed(cache, reads, made, now).groupBy("access_count").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("n_chars"), F.sum((F.col("last_accessed") == now).cast("long")).alias("n_touched"))


QUERIES = {f.__name__: f for f in (cache_reads, cache_split, cache_after, usage_stats, usage_cost, running_usage, ttl_expired, lru_evict, size_evict, rate_window, rate_limit, circuit_breaker, token_cost, render_prompt, template_choice, conversation_summary)}

SQL = {
    "usage_stats": "SELECT 'p' || (user_id % 4) AS provider, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures, sum(CASE WHEN event_type <> 'error' THEN CAST(floor(abs(value)) AS BIGINT) ELSE 0 END) AS tokens, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean_latency, round(sum(CASE WHEN event_type <> 'error' THEN CAST(floor(abs(value)) AS BIGINT) ELSE 0 END)::DOUBLE / 1000 * CASE user_id % 4 WHEN 0 THEN 0.03 WHEN 1 THEN 0.002 WHEN 2 THEN 0.01 ELSE 0 END, 6) AS cost FROM events GROUP BY provider, user_id % 4",
    "usage_cost": "SELECT count(*) AS calls, sum(t) AS tokens, round(sum(t * CASE user_id % 4 WHEN 0 THEN 0.03 WHEN 1 THEN 0.002 WHEN 2 THEN 0.01 ELSE 0 END)::DOUBLE / 1000, 6) AS cost FROM (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(floor(abs(value)) AS BIGINT) ELSE 0 END AS t FROM events)",
    "running_usage": "SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "cache_reads": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        c(user_id, event_id, t, k, made, n) AS (
          SELECT user_id, event_id, t, k, t, 0::BIGINT FROM e WHERE k = 1
          UNION ALL SELECT e.user_id, e.event_id, e.t, e.k, CASE WHEN e.t - c.made < 21600000000 THEN c.made ELSE e.t END, CASE WHEN e.t - c.made < 21600000000 THEN c.n + 1 ELSE 0 END
          FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
        SELECT user_id, event_id, n > 0 AS hit, n AS accesses, round((t - made) / 1e6, 3) AS age_seconds FROM c""",
    "cache_split": f"""WITH c AS (SELECT text, min(doc_id % 90) AS least FROM documents WHERE doc_id % 3 = 0 AND trim(text, ' ') <> '' GROUP BY text)
        SELECT doc_id, coalesce(trim(documents.text, ' '), '') = '' AS blank, c.text IS NOT NULL AND least < 60 AS hit, c.text IS NOT NULL AND least < 60 AS has_value, (c.text IS NOT NULL AND least < 60)::BIGINT AS access_count
        FROM documents LEFT JOIN c ON c.text = documents.text""",
    "cache_after": f"""WITH c AS (SELECT text, min(doc_id % 90) AS age FROM documents WHERE doc_id % 3 = 0 AND trim(text, ' ') <> '' GROUP BY text),
        a AS (SELECT d.text, CASE WHEN any_value(c.age) < 60 THEN count(*) ELSE 0 END AS access_count FROM documents d LEFT JOIN c ON c.text = d.text WHERE trim(d.text, ' ') <> '' GROUP BY d.text)
        SELECT access_count, count(*) AS n, sum(length(text))::BIGINT AS n_chars, count(*) AS n_touched FROM a GROUP BY access_count""",
    "ttl_expired": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE ts < TIMESTAMP '2024-01-20 11:00:00' GROUP BY 1",
    "lru_evict": "SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY max(struct_pack(a := ts, b := event_id)) DESC) AS r FROM events GROUP BY user_id) WHERE r > 50",
    "size_evict": "SELECT event_id, size FROM (SELECT event_id, CAST(floor(abs(value)) AS BIGINT) % 10 + 1 AS size, sum(CAST(floor(abs(value)) AS BIGINT) % 10 + 1) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s > 5000",
    "rate_window": "SELECT event_id, count(*) OVER w AS n_recent, count(*) OVER w <= 3 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW)",
    "token_cost": "SELECT doc_id, 'm' || (doc_id % 4) AS model, CAST(floor(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, round(floor(length(coalesce(text, '')) / 4.0) / 1000 * CASE doc_id % 4 WHEN 1 THEN 0.002 WHEN 2 THEN 0.01 ELSE 0.03 END, 6) AS cost FROM documents",
    "render_prompt": "SELECT doc_id, length(p) AS n_chars, sha256(p) AS sha, 'kind' AS missing FROM (SELECT doc_id, 'Give each clause of the ' || coalesce(lang, '?') || ' below as {\"type\": ..., \"text\": ...}: ' || coalesce(text, '') AS p FROM documents)",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        r AS (SELECT user_id, rn, event_id, TRUE AS allowed, 0.0::DOUBLE AS wait_seconds, [tm] AS times FROM e WHERE rn = 1
        UNION ALL SELECT user_id, rn, event_id, len(open) < 5, CASE WHEN len(open) < 5 THEN 0.0 ELSE 3600.0 - (tm - open[1]) END, CASE WHEN len(open) < 5 THEN list_append(open, tm) ELSE open END
        FROM (SELECT e.*, list_filter(r.times, lambda t: t > e.tm - 3600.0) AS open FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
        SELECT user_id, event_id, allowed, wait_seconds FROM r""",
    "circuit_breaker": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm, coalesce(event_type = 'error', FALSE) AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        r AS (SELECT user_id, 0 AS rn, NULL::BIGINT AS event_id, 'closed' AS state, TRUE AS passed, 0 AS failures, 0.0::DOUBLE AS last FROM e WHERE rn = 1
        UNION ALL SELECT user_id, rn, event_id, CASE WHEN s = 'open' THEN 'open' WHEN bad AND (s = 'half_open' OR failures + 1 >= 3) THEN 'open' WHEN NOT bad AND s = 'half_open' THEN 'closed' ELSE s END, s <> 'open',
        CASE WHEN s = 'open' THEN failures WHEN bad THEN failures + 1 WHEN s = 'half_open' THEN 0 ELSE failures END, CASE WHEN s <> 'open' AND bad THEN tm ELSE last END
        FROM (SELECT e.*, r.failures, r.last, CASE WHEN r.state = 'open' AND e.tm - r.last >= 86400.0 THEN 'half_open' ELSE r.state END AS s FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
        SELECT user_id, event_id, state, passed FROM r WHERE rn > 0""",
    "template_choice": """SELECT doc_id, len(t) AS n_templates, array_to_string(t, ',') AS templates FROM (SELECT doc_id, list_sort(list_filter([CASE WHEN k < 2 THEN 'clause_extraction' END, CASE WHEN k = 1 THEN 'risk_review' END,
        CASE WHEN k < 3 THEN 'content_structuring' END, CASE WHEN k < 3 THEN 'content_summarization' END, CASE WHEN k < 3 THEN 'document_analysis' END, CASE WHEN k < 3 THEN 'metadata_extraction' END, CASE WHEN k < 3 THEN 'section_identification' END], lambda x: x IS NOT NULL)) AS t
        FROM (SELECT doc_id, doc_id % 4 AS k FROM documents))""",
    "conversation_summary": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user, sum(length(text)) AS n_chars, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id",
}
