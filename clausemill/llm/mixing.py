"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Stands between the source keys of a pattern, and what it and the mark itself are in a name.
SEP, MARK = "\x1f", "\x1e"


def share_targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Targets by source: sources in code-point order (null last) take the weights in turn and
    share ``share`` of all sizes; none gets more than ``cap`` times its size, and what exceeds
    that is shared again by weight among the others until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] > cap * sizes[s] * total]
        if not above:
            return {s: out.get(s, left * weight[s] / total) for s in names}
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return {s: float(out[s]) for s in names}


def route(patterns: dict[str, tuple[Sequence, int]], targets: dict, max_repeats: int = 2) -> list[tuple[str, int, object, int]]:
    """Min-cost flow from patterns to source quotas: (pattern, repeat, source, words) rows.

    ``patterns`` maps a key to its sources and its words. The r-th use of a pattern's words costs
    r * r a word, so costs are convex and no words repeat while others that the source may take
    are unused. Successive shortest paths, by connected component; a pattern of one source alone
    needs no search.
    """
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for key, (sources, _) in patterns.items():
        for s in sources:
            parent[root(("s", s))] = root(("p", key))
    groups = defaultdict(list)
    for key, (sources, words) in sorted(patterns.items()):
        if sources and words:
            groups[root(("p", key))].append(key)
    out: list[tuple[str, int, object, int]] = []
    for keys in groups.values():
        out += _flow({k: patterns[k] for k in keys}, targets, max_repeats)
    return out


def _flow(patterns: dict, targets: dict, max_repeats: int) -> list[tuple]:
    sources = list(dict.fromkeys(s for ss, _ in patterns.values() for s in ss))
    ids = {("p", k): i + 2 for i, k in enumerate(patterns)}
    ids |= {("s", s): len(ids) + 2 + i for i, s in enumerate(sources)}
    heads, caps, costs, start = [], [], [], defaultdict(list)

    def arc(a, b, cap, cost):
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            start[u].append(len(heads))
            heads.append(v)
            caps.append(c)
            costs.append(w)
        return len(heads) - 2

    use, move = {}, {}
    for k, (ss, words) in patterns.items():
        for r in range(1, max_repeats + 1):
            use[k, r] = arc(0, ids["p", k], words, r * r)
        for s in ss:
            move[k, s] = arc(ids["p", k], ids["s", s], 1 << 62, 0)
    for s in sources:
        arc(ids["s", s], 1, int(targets.get(s, 0)), 0)
    height: dict[int, int] = defaultdict(int)
    while True:
        dist, via, queue = {0: 0}, {}, [(0, 0)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in start[u]:
                v = heads[e]
                if caps[e] and (c := d + costs[e] + height[u] - height[v]) < dist.get(v, 1 << 62):
                    dist[v], via[v] = c, e
                    heapq.heappush(queue, (c, v))
        if 1 not in dist:
            break
        most = max(dist.values())
        for v in [*ids.values(), 0, 1]:
            height[v] += dist.get(v, most)
        path, v = [], 1
        while v:
            path.append(via[v])
            v = heads[via[v] ^ 1]
        by = min(caps[e] for e in path)
        for e in path:
            caps[e] -= by
            caps[e ^ 1] += by
    out = []
    for k, (ss, _) in patterns.items():  # a pattern's first uses go to its sources in turn, then the second
        owed = [[s, caps[move[k, s] ^ 1]] for s in ss]
        for r in range(1, max_repeats + 1):
            room = caps[use[k, r] ^ 1]
            for o in owed:
                if take := min(room, o[1]):
                    out.append((k, r, o[0], take))
                    room -= take
                    o[1] -= take
    return out


def _source_key(s: str | None) -> str:
    """Null and any string stay apart, and no key holds the separator."""
    return "~" if s is None else "=" + s.replace(MARK, MARK + "0").replace(SEP, MARK + "1")


def _source_name(key: str) -> str | None:
    return None if key == "~" else key[1:].replace(MARK + "1", SEP).replace(MARK + "0", MARK)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, seed: int = 42, keep: Sequence[str] = (), hash_buckets: int = 4096, max_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """How often a mix to target weights takes each document, and the quotas.

    ``docs``: doc_id, size (words, not negative), sources (array of the sources that hold the
    document) and the columns named in ``keep``. Returns (rows, quotas): rows has doc_id, size,
    pattern, repeats, taken (size * repeats) and the kept columns; quotas has source_key,
    source_size and target, where source_key is '=' and the source's name, or '~' for null (the
    pattern of a document of one source is that key); in names \\x1e is written \\x1e0 and \\x1f \\x1e1.

    Words are summed by membership pattern; the sums, at most ``max_patterns`` of them (else an
    error: the caller then merges rare patterns), are routed to the quotas on the driver. Within
    a pattern documents stand in seeded hash order; a quota takes those that lie wholly in its
    range. What that leaves open is filled with documents that fit and are free for another use:
    first as many as fit in hash order, then as many as fit largest first, until none fits; each
    pass of the latter more than halves a gap or uses up what was offered for it. At last a gap
    takes the one document that overshoots it least, if that comes nearer. Positions in an order
    are sums over ``hash_buckets`` hash ranges plus a sum inside one range, so no source, however
    large, meets in one task.

    Rows with null or empty sources take nothing; repeated rows are documents of their own;
    documents of size 0 take nothing; an empty table gives no rows. Reruns over the same rows
    take the same documents. Columns of ``docs`` that are not named are ignored; names in ``keep``
    must not be this operator's own (an error says which).
    """
    spark = docs.sparkSession
    if clash := {"doc_id", "size", "sources", "pattern", "h", "rid", "bucket", "takers", "ranges", "before", "inside", "repeats", "more", "taken"} & set(keep):
        raise ValueError(f"columns to keep must have other names: {sorted(clash)}")
    marks = F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("="), F.replace(F.replace(s, F.lit(MARK), F.lit(MARK + "0")), F.lit(SEP), F.lit(MARK + "1"))), F.lit("~")))
    base = materialise(docs.select("doc_id", F.col("size").cast("long").alias("size"), F.array_join(F.array_sort(F.array_distinct(marks)), SEP).alias("pattern"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")).alias("h"), F.monotonically_increasing_id().alias("rid"), *keep)
                       .withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(hash_buckets))), "mix")
    found = base.groupBy("pattern").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {r["pattern"]: (r["pattern"].split(SEP) if r["pattern"] else [], r["n"]) for r in found}
    sizes: dict[str, int] = defaultdict(int)
    for sources, n in patterns.values():
        for s in sources:
            sizes[s] += n
    named = share_targets({_source_name(k): n for k, n in sizes.items()}, weights, share, float(max_repeats))
    targets = {_source_key(s): t for s, t in named.items()}

    ranges: dict[str, list] = defaultdict(list)
    at: dict[tuple, int] = defaultdict(int)
    for k, r, s, n in route(patterns, targets, max_repeats):
        ranges[k].append((at[k, r], at[k, r] + n, s))
        at[k, r] += n
    segments = spark.createDataFrame(list(ranges.items()), "pattern string, ranges array<struct<lo: long, hi: long, source: string>>")
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    before = base.groupBy("pattern", "bucket").agg(F.sum("size").alias("n")).select("pattern", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    hi = F.col("before") + F.col("inside")
    takers = F.transform(F.filter("ranges", lambda r: (r["lo"] <= hi - F.col("size")) & (hi <= r["hi"]) & (F.col("size") > 0)), lambda r: r["source"])
    placed = materialise(base.withColumn("inside", F.sum("size").over(inside)).join(before, ["pattern", "bucket"]).join(segments, "pattern", "left")
                         .select("rid", "doc_id", "size", "pattern", "h", "bucket", F.coalesce(takers, F.array().cast("array<string>")).alias("takers"), *keep), "mix")

    took = {r["s"]: r["n"] for r in placed.select("size", F.explode("takers").alias("s")).groupBy("s").agg(F.sum("size").alias("n")).collect()}
    picks: list[DataFrame] = []  # rid and source of further uses, a table for each pass
    turn = 0
    while gaps := [(s, int(t) - took.get(s, 0)) for s, t in targets.items() if int(t) > took.get(s, 0)]:
        # As many gaps as quotas, which this driver holds: small enough to hand to every task.
        open_ = F.broadcast(spark.createDataFrame(gaps, "source string, gap long"))
        free = _with_more(placed, picks).filter((F.col("repeats") < max_repeats) & (F.col("size") > 0)).select("rid", "doc_id", "size", "repeats", "h", "bucket", F.explode(F.split("pattern", SEP)).alias("source")).join(open_, "source")
        new = materialise(_fitting(free.filter(F.col("size") <= F.col("gap")), largest_first=turn > 0), "fill")
        got = new.groupBy("source").agg(F.sum("size").alias("n")).collect()
        if not got and turn:
            break
        for r in got:
            took[r["source"]] = took.get(r["source"], 0) + r["n"]
        picks.append(new.select("rid"))
        turn += 1
    if gaps:
        best = (free.filter(F.col("size") < 2 * F.col("gap")).groupBy("source").agg(F.max(F.struct(-F.col("size"), -F.col("repeats"), "h", "rid")).alias("b")).collect())
        picks.append(spark.createDataFrame([(rid,) for rid in sorted({r["b"]["rid"] for r in best})], "rid long"))
    rows = _with_more(placed, picks).select("doc_id", "size", "pattern", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), *keep)
    quotas = spark.createDataFrame([(k, sizes[k], float(t)) for k, t in targets.items()], "source_key string, source_size long, target double")
    return rows, quotas


def _fitting(free: DataFrame, largest_first: bool) -> DataFrame:
    """rid, size and source of as many ``free`` documents as fit into the gap of their source, by
    seeded hash order, unrepeated ones first. A document of several sources is offered to the one
    with the largest gap. Sums by level (size, if largest first), then by hash range and inside one
    range; what lies wholly behind the gap's end is left out at each step."""
    level = -F.col("size") if largest_first else F.lit(0).cast("long")
    only = free.groupBy("rid").agg(F.max(F.struct("gap", "source", "size", "repeats", "doc_id", "h", "bucket")).alias("x")).select("rid", "x.*")
    only = only.withColumn("level", level)
    upto = lambda part, *order: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    by_level, by_range = ["source", "level"], ["source", "level", "repeats", "bucket"]
    levels = only.groupBy("gap", *by_level).agg(F.sum("size").alias("n")).withColumn("lo", before(upto(["source"], "level"))).filter("lo < gap").select(*by_level, "lo")
    ranges = only.join(levels, by_level).groupBy("gap", "lo", *by_range).agg(F.sum("size").alias("n"))
    ranges = ranges.select("gap", *by_range, (F.col("lo") + before(upto(by_level, "repeats", "bucket"))).alias("lo")).filter("lo < gap").select(*by_range, "lo")
    inside = Window.partitionBy(*by_range).orderBy("h", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    return only.join(ranges, by_range).withColumn("hi", F.col("lo") + F.sum("size").over(inside)).filter("hi <= gap").select("rid", "size", "source")


def _with_more(placed: DataFrame, picks: list[DataFrame]) -> DataFrame:
    extra = placed.sparkSession.createDataFrame([], "rid long")
    for p in picks:
        extra = extra.unionByName(p)
    extra = extra.groupBy("rid").agg(F.count(F.lit(1)).alias("more"))
    return placed.join(extra, "rid", "left").withColumn("repeats", (F.size("takers") + F.coalesce("more", F.lit(0))).cast("long"))
