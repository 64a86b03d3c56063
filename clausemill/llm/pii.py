"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Entities found by fixed patterns are the seeds. The words around them, in several widths, and the
shapes of their digits are lexical patterns; a graph of patterns and the identifier-like values
that have them is scored in rounds: a pattern by the share of its values that are known, a value by
its patterns. Values of good patterns are identifiers that the fixed patterns don't know.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, row_key

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in forms that take linear time and no deep recursion on long texts.
#
# In an email's host a dot counts only before a label's character; other dots are turned into
# '%' first, which local parts admit and hosts don't, so that the host is one character class.
# A match starts where a run of local-part characters does, or where the match before it ended.
# In a card a separator counts only between digits; others become 'x'. Runs of under 13 digits
# can't be cards, so leaving them out changes no other match.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
_EMAIL_DOT = r"\.(?![A-Za-z0-9-])"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][ -])(?=(?:[ -]?[0-9]){13})[0-9][0-9 -]++"
_CARD_GAP = r"[ -](?![0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Identifier-like: a white-space separated token with a digit or '@'.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: Neighbouring tokens with digits, joined by blanks: one identifier written in groups.
_GROUP = r"[^\s0-9@,;:!?]*+[0-9][^\s@,;:!?]*+"
_RUN = rf"(?<!\S){_GROUP}(?: {_GROUP})++(?=[,;:!?]*+(?:\s|$))"

_SPAN = "array<struct<s: int, e: int>>"
_NONE = f"cast(array() AS {_SPAN})"


def spans_of(text: Column, pattern: str) -> Column:
    """(s, e) code-point spans of all matches: the texts between matches and the matches, laid
    end to end, give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    sizes = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("out"))

    def step(acc, x):
        s = acc["at"] + x["g"]
        e = s + x["h"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _when(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(F.expr(_NONE))


def _cut(text: Column, x: Column) -> Column:
    return F.substring(text, x["s"] + 1, x["e"] - x["s"])


def _ip_ok(value: Column) -> Column:
    small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, "\\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(_digits(value))
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the four base kinds in a text that isn't null."""
    email = _when(F.contains(text, F.lit("@")), spans_of(F.regexp_replace(text, _EMAIL_DOT, "%"), _EMAIL))
    ip = _when(text.rlike("[0-9]\\.[0-9]"), F.filter(spans_of(text, _IP), lambda x: _ip_ok(_cut(text, x))))
    card = _when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), F.filter(spans_of(F.regexp_replace(text, _CARD_GAP, "x"), _CARD), lambda x: _luhn(_cut(text, x))))
    phone = _when(F.contains(text, F.lit("+")), F.filter(spans_of(text, _PHONE), lambda x: F.length(_digits(_cut(text, x))).between(9, 15)))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def _with_kind(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _contexts(text: Column, x: Column) -> Column:
    """The lexical patterns of a span, in several widths: the three and the two words before it in
    its line, the words on either side, the two words after it; and those of its own form
    (``_forms``). Words are what stands within 80 code points, lower-cased, digits as 0; '^' stands
    for the start of a line."""
    plain = lambda c: F.regexp_replace(lower_ascii(c), "[0-9]", "0")
    left = F.substring(text, F.greatest(x["s"] - 79, F.lit(1)), F.least(x["s"], F.lit(80)))
    left = plain(F.when((x["s"] < 80) | F.contains(left, F.lit("\n")), F.concat(F.lit("^ "), F.substring_index(left, "\n", -1))).otherwise(left))
    right = plain(F.substring_index(F.substring(text, x["e"] + 1, F.lit(80)), "\n", 1))
    before = lambda n: F.regexp_extract(left, r"(?:^|\s)(" + r"\s++".join([r"\S++"] * n) + r")\s*+$", 1)
    after = lambda n: F.regexp_extract(right, r"^\s*+(" + r"\s++".join([r"\S++"] * n) + ")", 1)
    named = lambda kind, c: F.when(c != "", F.concat(F.lit(kind), c))
    around = F.when((before(1) != "") & (after(1) != ""), F.concat(F.lit("around:"), before(1), F.lit("|"), after(1)))
    return F.array_compact(F.concat(F.array(named("before:", before(3)), named("before:", before(2)), around, named("after:", after(2))), _forms(_cut(text, x))))


def _forms(value: Column) -> Column:
    """Patterns of a value's own form. Without letters: its digit shape, the shape without a leading
    +country code, and for card-like lengths how many digits it has however they are grouped. With
    an @: the host, digits as 9."""
    n = F.length(_digits(value))
    shape = F.regexp_replace(value, "[0-9]", "9")
    numeric = (n >= 7) & value.rlike(r"^[0-9+() ./-]+$")
    return F.array(F.when(numeric, F.concat(F.lit("shape:"), shape)), F.when(numeric, F.concat(F.lit("core:"), F.regexp_replace(shape, r"^\+9{1,3}[ .-]?", ""))), F.when(numeric & (n >= 13), F.concat(F.lit("digits:"), n.cast("string"))),
                   F.when(F.contains(value, F.lit("@")), F.concat(F.lit("host:"), F.regexp_replace(lower_ascii(F.substring_index(value, "@", -1)), "[0-9]", "9"))))


def plausible(kind: Column, value: Column) -> Column:
    """Whether a value may be of a kind at all, whatever surrounds it: what a base pattern's test
    has refused no context brings back."""
    n = F.length(_digits(value))
    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    ip = (F.size(groups) == 4) & _ip_ok(F.array_join(groups, "."))
    return F.when(kind == "email", F.contains(value, F.lit("@"))).when(kind == "ip", ip).when(kind == "card", _luhn(value)).otherwise(n.between(7, 15) & ~value.rlike(r"\p{L}"))


def _identifier_like(value: Column, min_digits: int) -> Column:
    return (F.length(_digits(value)) >= min_digits) | F.contains(value, F.lit("@"))


def find_base(docs: DataFrame, min_digits: int = 5) -> DataFrame:
    """doc_id, rk1, rk2 (row identity), the four kinds' spans, and ``seen``: every entity or other
    identifier-like token with kind (null if unknown), span, value and contexts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), text.alias("text"))
    rows = rows.withColumns(base_spans(F.col("text")))
    text = F.col("text")
    rows = rows.withColumn("known", F.concat(*map(_with_kind, KINDS)))
    trim = lambda x: F.struct((x["s"] + F.length(F.regexp_extract(_cut(text, x), r"^[^\p{L}\p{N}+]*+", 0))).alias("s"), (x["e"] - F.length(F.regexp_extract(F.reverse(_cut(text, x)), r"^[^\p{L}\p{N}]*+", 0))).alias("e"))
    tokens = F.transform(spans_of(text, _TOKEN), trim)
    open_ = lambda x: F.struct((x["s"] + F.length(F.regexp_extract(_cut(text, x), r"^[^\p{L}\p{N}+(]*+", 0))).alias("s"), trim(x)["e"].alias("e"))
    # A run whose first token is a candidate has that token's context already.
    runs = F.filter(F.transform(spans_of(text, _RUN), open_), lambda x: F.length(_digits(F.regexp_extract(_cut(text, x), r"^\S+", 0))) < min_digits)
    free = F.filter(F.concat(tokens, runs), lambda x: (x["s"] < x["e"]) & _identifier_like(_cut(text, x), min_digits) & ~F.exists("known", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    other = F.when(text.rlike("[0-9@]"), F.transform(free, lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))).otherwise(F.expr("cast(array() AS array<struct<kind: string, s: int, e: int>>)"))
    seen = F.transform(F.concat("known", other), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _cut(text, x).alias("value"), _contexts(text, x).alias("contexts")))
    return rows.select("doc_id", "rk1", "rk2", *KINDS, seen.alias("seen"))


def bootstrap(seen: DataFrame, min_support: int = 3, min_pattern: float = 0.8, min_value: float = 0.8, may_be: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(value, kind, score) of identifiers that patterns discover.

    ``seen``: kind (null if unknown), value, contexts. In each round a pattern's confidence for a
    kind is the summed score of its known values of that kind over the number of its distinct
    values that may be of it; it counts from ``min_pattern`` on with a sum of at least ``min_support``. A value's
    score joins its patterns' confidences by noisy-or and counts from ``min_value`` on. Values
    with a known kind keep it, found ones as well; scores only rise. ``may_be`` (kind, value) keeps
    out values that can't be of a kind. The rounds end when one adds neither a value nor a pattern. Edges are distinct pairs, so common values weigh once.
    """
    may = F.array_compact(F.array(*[F.when(may_be(F.lit(k), F.col("value")) if may_be else F.lit(True), k) for k in KINDS]))
    edges = materialise(seen.withColumn("may", may).select("value", "may", F.explode("contexts").alias("pattern")).distinct(), "pii-edges")
    totals = edges.select("pattern", F.explode("may").alias("kind")).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= min_support)
    seeds = materialise(seen.filter("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)), "pii-seeds")
    known, size = seeds, None
    while True:
        patterns = (edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("hits")).filter(F.col("hits") >= min_support)
                    .join(totals, ["pattern", "kind"]).withColumn("confidence", F.col("hits") / F.col("total")).filter(F.col("confidence") >= min_pattern))
        patterns = materialise(patterns.select("pattern", "kind", "confidence"), "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        found = edges.join(patterns, "pattern").filter(F.array_contains("may", F.col("kind"))).join(seeds.select("value"), "value", "left_anti").groupBy("value", "kind").agg((1 - doubt).alias("score")).filter(F.col("score") >= min_value)
        both = known.select("value", "kind", "score", F.lit(1).alias("old")).unionByName(found.withColumn("old", F.lit(0)))
        both = both.groupBy("value", "kind").agg(F.max("score").alias("score"), F.max("old").alias("old"))
        best = both.groupBy("value").agg(F.max(F.struct("old", "score", "kind")).alias("b"))
        known = materialise(best.select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")), "pii-known")
        last, size = size, (known.count(), patterns.count())
        if size == last or size[0] == 0 or size[1] == 0:
            break
    return known.join(seeds.select("value"), "value", "left_anti")


def _listed(spans: Column) -> Column:
    """kind:start:end of (kind, s, e) structs by kind as listed, then start."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.array_distinct(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def held_back(docs: DataFrame, part: int = 5, **options) -> DataFrame:
    """How much the bootstrap finds again: (kind, n_hidden, n_found, n_right), where one in ``part``
    of the known values, by hash, is given to it as unknown; n_right of those it names have their
    own kind. So much smaller is the share that a pattern's known values can have, and the bounds
    are lowered by that."""
    options = {"min_pattern": 0.8 * (1 - 1 / part), "min_value": 0.8 * (1 - 1 / part)} | options
    found = materialise(find_base(docs.select("doc_id", "text")), "pii")
    seen = found.select(F.explode("seen").alias("x")).select("x.kind", "x.value", "x.contexts")
    hidden = F.pmod(F.xxhash64("value"), F.lit(part)) == 0
    got = bootstrap(seen.select(F.when(~hidden, F.col("kind")).alias("kind"), "value", "contexts"), may_be=plausible, **options)
    truth = seen.filter(hidden & F.col("kind").isNotNull()).groupBy("value").agg(F.min("kind").alias("kind"))
    rows = truth.join(got.select("value", F.col("kind").alias("named")), "value", "left")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_hidden"), F.count("named").alias("n_found"), F.sum((F.col("named") == F.col("kind")).cast("long")).alias("n_right"))


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text).

    Columns: doc_id, the base spans by kind (email, ip, card, phone; arrays of s, e in code
    points, end exclusive), base and spans (kind:start:end lists; spans has what the bootstrap
    adds as well). Texts are read once; what follows works on the entities and identifier-like
    tokens found in them, and added spans meet their documents by row identity.

    Null text is the empty text. Repeated rows get equal results. A table without entities gets
    no patterns, an empty table gives no rows, and columns other than doc_id and text are ignored.
    """
    found = materialise(find_base(docs.select("doc_id", "text")), "pii")
    seen = found.select("rk1", "rk2", F.explode("seen").alias("x")).select("rk1", "rk2", "x.*")
    values = bootstrap(seen.select("kind", "value", "contexts"), may_be=plausible, **options)
    added = seen.filter("kind IS NULL").select("rk1", "rk2", "s", "e", "value").join(values.select("value", "kind"), "value")
    added = added.groupBy("rk1", "rk2").agg(F.collect_set(F.struct("kind", "s", "e")).alias("added"))
    base = F.concat(*map(_with_kind, KINDS))
    inner = lambda x: F.exists("added", lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["e"] - y["s"] > x["e"] - x["s"]))
    added = added.withColumn("added", F.filter("added", lambda x: ~inner(x)))
    out = found.drop("seen").withColumn("b", base).join(added, ["rk1", "rk2"], "left")
    none = F.expr("cast(array() AS array<struct<kind: string, s: int, e: int>>)")
    return out.select("doc_id", *KINDS, _listed(F.col("b")).alias("base"), _listed(F.concat("b", F.coalesce("added", none))).alias("spans"))
