"""Set-similarity join of documents on word shingles: rare-first prefix filtering with length,
positional and suffix filters, and the connected components of its links."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, release, tidy
from .shingles import shingle_set, words_by_text

_NO_ID = -(1 << 63)


def _class_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set; equal sets are one class and one node."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(d[:, 0]), pa.array(d[:, 1])


def shingle_sketch(docs: DataFrame, n: int, bits: int, chunk: int = 2_000_000) -> np.ndarray:
    """log2 of how many documents hold a shingle, by the hash's first ``bits`` bits.

    Tasks count within chunks of their documents and pass on what occurs at least twice, so the
    sum sees every document and leaves out only what is rare everywhere. The table's size is
    fixed (2**bits bytes); it only orders shingles, and any order gives the same links.
    """
    shift = np.uint64(64 - bits)

    def run(batches):
        held, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            b, inv = np.unique(h >> shift, return_inverse=True)
            most = np.zeros(len(b), np.int64)
            np.maximum.at(most, inv, c)
            return pa.record_batch([pa.array(b.astype(np.int64)), pa.array(most)], names=["bucket", "n"])

        for batch in batches:
            for _, words in words_by_text(batch.column("text")):
                held.append(shingle_set(words, n))
                size += len(held[-1])
                if size >= chunk:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.filter(F.col("n") >= 4).select(F.col("bucket").cast("int").alias("bucket"), F.least(F.log2("n"), F.lit(31)).cast("tinyint").alias("level")).toPandas()
    table = np.zeros(1 << bits, np.uint8)
    table[found["bucket"].to_numpy(np.int64)] = found["level"].to_numpy(np.uint8)
    return table


def shingle_prefixes(docs: DataFrame, n: int, percent: int, sketch: np.ndarray, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n (set size), class (c1, c2), how common its shingles are, and the prefix: the
    rarest size - ceil(percent% of size) + 1 shingles, rare first, and its odd cells. Within a task
    a class's prefix and odd cells are given once. The columns ``keep`` are passed on."""
    bits = int(len(sketch)).bit_length() - 1
    shift, table = np.uint64(64 - bits), docs.sparkSession.sparkContext.broadcast(sketch)
    names = ["doc_id", *keep]

    def run(batches):
        level, seen = table.value, set()
        for batch in batches:
            rows, prefixes, odd, first = [], [], [], 0
            for i, words in words_by_text(batch.column("text")):
                s = shingle_set(words, n)
                size, cls = len(s), _class_of(s)
                prefix, cells, central = None, None, 0
                if size and cls not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(cls)
                    common = level[(s >> shift).astype(np.int64)]
                    central = int(common.mean() * 4)
                    p = size - (percent * size + 99) // 100 + 1
                    prefix = s[np.lexsort((s, common))[:p]].view(np.int64)
                    cells = odd_cells(s)
                rows.append((size, cls, central))
                prefixes.append(prefix)
                odd.append(cells)
                if len(rows) >= 2000:
                    yield _set_batch(batch.select(names).slice(first, len(rows)), rows, prefixes, odd)
                    rows, prefixes, odd, first = [], [], [], i + 1
            if rows:
                yield _set_batch(batch.select(names).slice(first, len(rows)), rows, prefixes, odd)

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *keep, docs["text"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in keep)
    return chosen.mapInArrow(tidy(run), f"doc_id long, {kept + ', ' if kept else ''}n long, c1 long, c2 long, central long, prefix array<long>, odd array<long>")


def _set_batch(ids: pa.RecordBatch, rows, prefixes, odd):
    size, cls, central = zip(*rows)
    return pa.record_batch([*ids.columns, pa.array(size, pa.int64()), *_halves(cls), pa.array(central, pa.int64()), _lists(prefixes), _lists(odd)], names=[*ids.schema.names, "n", "c1", "c2", "central", "prefix", "odd"])


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """The arrays as lists of longs; empty for None."""
    off = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([0 if a is None else len(a) for a in arrays], out=off[1:])
    flat = [a for a in arrays if a is not None]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))


_ODD = 8
_EARLIER = 6


def odd_cells(s: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * 8 cells of the hash range: whether a set has an odd number there."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * _ODD - 1), minlength=64 * _ODD) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def _may_differ(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether two sets may be as alike as asked by their odd cells: where these differ, some member
    of the one isn't in the other."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(_ODD)))
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


# A prefix entry's number: how common (7 bits), set size (28 bits), position (28 bits).
def _pack(central: Column, n: Column, pos: Column) -> Column:
    return F.shiftleft(F.least(central, F.lit(127)), 56) + F.shiftleft(n, 28) + pos


def _size(packed: Column) -> Column:
    return F.shiftright(packed, 28).bitwiseAND(F.lit((1 << 28) - 1))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << 28) - 1))


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Length and positional filter on two entries of one shingle. Two sets that link must pass
    at the first shingle of the common order that both hold, where nothing before it is shared:
    they share at most that shingle and what follows it. It is in both prefixes, so a pair that
    fails at every shingle it meets at can't link."""
    na, nb, i, j = _size(a), _size(b), _place(a), _place(b)
    most = F.least(na - i, nb - j)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (most * (100 + percent) >= percent * (na + nb))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of classes, the smaller first."""
    x, y = F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2"))
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def cell_counts(s: np.ndarray) -> bytes:
    """How many members a set has in each cell of the hash range, a byte each; about two members
    a cell, so 64 to 65,536 cells by size. Empty where a count is too large for its byte."""
    bits = min(16, max(6, int(len(s)).bit_length() - 1))
    c = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else b""


def may_reach(a: bytes, b: bytes, percent: int) -> bool:
    """Suffix filter: what two sets share is at most what they share cell by cell. Finer cells are
    summed to the coarser ones of the other set."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    x, y = x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)
    return bool((100 + percent) * np.minimum(x, y).sum() >= percent * (x.sum() + y.sum()))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return (100 + percent) * int((b[at] == a).sum()) >= percent * (len(a) + len(b))


#: Cells of the bitmaps that keep rows out of joins: 2**22 bits, 512 KB, at every size of input.
_CELLS = 1 << 22


def _sieve(rows: DataFrame, cell: Column, wanted: DataFrame, wanted_cell: Column, run=None, schema: str | None = None) -> DataFrame:
    """The rows whose cell is one of ``wanted``'s: all that a join with it needs, and few others.
    What is let through wrongly the join takes out. ``run`` works on the batches that are left."""
    cells = wanted.select(wanted_cell.alias("cell")).distinct().toPandas()["cell"].to_numpy()
    bitmap = np.zeros(_CELLS, bool)
    bitmap[cells] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def pick(batches):
        for batch in batches:
            i = batch.column(0).to_numpy(zero_copy_only=False)
            left = batch.filter(pa.array((shared.value[i >> 3] >> (7 - (i & 7))) & 1 == 1)).select(batch.schema.names[1:])
            if run is None:
                yield left
            elif len(left):
                yield from run(left)

    return rows.select(cell.alias("cell"), *rows.columns).mapInArrow(tidy(pick), schema or rows.schema)


def _hashed_cell(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(_CELLS)).cast("int")


def class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(c, s, cells): the sorted shingle set of each wanted class and its cell counts, as bytes,
    one or more rows a class. ``wanted``: d (smallest doc_id of the class) and c."""
    def run(batch):
        out, size = [], 0
        for _, w in words_by_text(batch.column("text")):
            s = shingle_set(w, n)
            out.append((_class_of(s), s.tobytes(), cell_counts(s)))
            size += s.nbytes
            if size > 1 << 20:
                yield rows(out)
                out, size = [], 0
        if out:
            yield rows(out)

    def rows(out):
        cls, s, cells = zip(*out)
        return pa.record_batch([*_halves(cls), pa.array(s, pa.binary()), pa.array(cells, pa.binary())], names=["c1", "c2", "s", "cells"])

    d = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID))
    found = _sieve(docs.select("doc_id", "text"), _hashed_cell(d), wanted, _hashed_cell(F.col("d")), run, "c1 long, c2 long, s binary, cells binary")
    return found.select(F.struct("c1", "c2").alias("c"), "s", "cells")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the similarity. Cell counts go to all pairs first; the sets, which
    weigh far more, only to those left, and each of these is looked at once."""
    def with_column(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
        one = of.select("c", name).dropDuplicates(["c"])
        for end in ("a", "b"):
            rows = rows.join(one.select(F.col("c").alias(end), F.col(name).alias(f"s{end}")), end)
        return rows.select("a", "b", "sa", "sb")

    def keep(batches, test):
        for batch in batches:
            x, y = batch.column("sa"), batch.column("sb")
            yield batch.select(["a", "b"]).filter(pa.array([test(x[i], y[i]) for i in range(len(batch))], pa.bool_()))

    def near(batches):
        return keep(batches, lambda x, y: may_reach(x.as_py(), y.as_py(), percent))

    def exact(batches):
        return keep(batches, lambda x, y: linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))

    left = materialise(with_column(pairs, sets, "cells").mapInArrow(tidy(near), pairs.schema), "pairs")
    cell = lambda c: F.pmod(c, F.lit(_CELLS)).cast("int")
    ends = left.select(F.explode(F.array("a.c1", "b.c1")).alias("c1"))
    needed = _sieve(sets.select("c", "s"), cell(F.col("c.c1")), ends, cell(F.col("c1")))
    links = materialise(with_column(left, needed, "s").mapInArrow(tidy(exact), pairs.schema), "links")
    release(left)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``edges`` (a, b).

    Each round takes the smallest label among neighbours, hands it to the node's old label as well
    (so whole trees hook onto smaller ones), then takes the label's own label. Labels only fall
    and a round without a change means that neighbours agree, so the loop ends and is exact;
    shuffled chains of 1,000 nodes take 13 rounds, of 100,000 nodes 21. Labels are written to the
    shared folder every round.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    kept = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = F.struct("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = F.struct(F.col("label").alias("node"), F.lit(None).alias("old"), F.col("near").alias("label"))
        offers = labels.join(near, "node").select(F.explode(F.when(F.col("near") < F.col("label"), F.array(own, root)).otherwise(F.array(own))).alias("x")).select("x.*")
        step = offers.groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        release(kept)
        kept, labels = new, new.select("node", "label")
        if new.filter(F.col("old") != F.col("label")).isEmpty():
            release(both)
            return labels


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, sketch_bits: int = 22, keep: Sequence[str] = ()) -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles and component_id (smallest doc_id reachable).

    Documents link when 100 * |A and B| >= ``percent`` * |A or B| for their sets of ``n``-word
    shingles (64-bit hashes of words with A-Z lower-cased). Equal sets are one node, so copies
    make no pairs. Nodes that share a prefix shingle first meet the most typical node of that
    shingle (a star, not all pairs); pairs that still stand in different components then meet
    each other, so no link between components is missed and none within one is spent.

    Documents with fewer than ``n`` words have one shingle, their whole sequence; null, empty and
    blank texts have none, link with nothing and are their own component (null doc_id: null). Null ids
    are no candidates for a group's smallest; only groups of null ids alone have a null component.
    Rows that repeat a doc_id share its node if their texts do. An empty table gives no rows;
    columns other than doc_id and text are ignored, but those named in ``keep`` are passed on,
    along with ``component``, which names a row's component whatever its doc_id is (null for
    rows without shingles). Names in ``keep`` must not be this operator's own (doc_id, n, c1, c2,
    central, prefix, odd).
    """
    bound_batches(docs.sparkSession)
    if clash := {"doc_id", "n", "c1", "c2", "central", "prefix", "odd"} & set(keep):
        raise ValueError(f"columns to keep must have other names: {sorted(clash)}")
    docs = docs.select("doc_id", "text", *keep)
    sets = materialise(shingle_prefixes(docs, n, percent, shingle_sketch(docs, n, sketch_bits), keep), "prefixes")
    docs = docs.select("doc_id", "text")
    ids = sets.select("doc_id", *keep, "n", "c1", "c2")
    entries = sets.select("c1", "c2", "central", "n", F.posexplode("prefix").alias("pos", "tok"))
    entries = entries.select("tok", "c1", "c2", _pack(F.col("central"), F.col("n"), F.col("pos").cast("long")).alias("p"))
    whole = Window.partitionBy("tok")
    shared = entries.select("*", F.count(F.lit(1)).over(whole).alias("k"), F.max(F.struct("p", "c1", "c2")).over(whole).alias("head")).filter("k > 1").drop("k")
    nodes = F.count(F.lit(1)).over(whole).alias("k")
    blocks = materialise(shared.dropDuplicates(["tok", "c1", "c2"]).select("*", nodes).filter("k > 1"), "blocks")
    ids = materialise(ids, "ids")
    odd = materialise(sets.filter(F.size("prefix") > 0).select(F.struct("c1", "c2").alias("node"), "odd").dropDuplicates(["node"]), "odd")
    release(sets)
    classes = ids.filter(F.col("n") > 0).groupBy("c1", "c2").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("d"), F.min("doc_id").alias("least"))

    meet = blocks.select(F.col("head.c1").alias("a1"), F.col("head.c2").alias("a2"), F.col("head.p").alias("pa"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("p").alias("pb"))
    star = materialise(_pairs(meet.filter(((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))) & _may_link(F.col("pa"), F.col("pb"), percent))), "pairs")
    edges = _edges(star, docs, classes, n, percent)
    labels = components(edges)

    # Two nodes of one shingle have met already.
    node = blocks.filter("k > 2").select("tok", "p", F.struct("c1", "c2").alias("node")).join(labels, "node", "left")
    # The shared shingles just before each in a node's order: two nodes with one of them in common
    # have met there, where they pass if they pass here, so that pairs are made about once.
    earlier = Window.partitionBy("node").orderBy(_place(F.col("p"))).rowsBetween(-_EARLIER, -1)
    node = node.select("tok", "p", "node", F.coalesce("label", "node").alias("label"), F.collect_list("tok").over(earlier).alias("earlier"))
    node = materialise(node, "blocks")
    release(blocks)
    # Only shingles whose block holds several components go on; most blocks hold one by now.
    parted = node.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("tok")
    mixed = materialise(node.join(parted, "tok", "left_semi").join(odd, "node"), "mixed")
    release(node)
    release(odd)
    most = mixed.groupBy("tok", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("tok").agg(F.max(F.struct("k", "label")).alias("most")).select("tok", F.col("most.label").alias("most"))
    few = mixed.join(most, "tok").filter(F.col("label") != F.col("most")).select("tok", F.col("p").alias("pa"), F.col("node").alias("na"), F.col("label").alias("la"), F.col("odd").alias("oa"), F.col("earlier").alias("ea"))
    near = _may_link(F.col("pa"), F.col("p"), percent) & _may_differ(F.col("oa"), F.col("odd"), _size(F.col("pa")), _size(F.col("p")), percent)
    cross = few.join(mixed, "tok").filter((F.col("la") != F.col("label")) & near & ~F.arrays_overlap("ea", "earlier"))
    cross = _pairs(cross.select(F.col("na.c1").alias("a1"), F.col("na.c2").alias("a2"), F.col("node.c1").alias("b1"), F.col("node.c2").alias("b2")))
    rest = materialise(cross.join(star, ["a", "b"], "left_anti"), "pairs")
    release(mixed)
    release(star)
    late = _edges(rest, docs, classes, n, percent)
    release(rest)
    if not late.isEmpty():
        labels = components(edges.unionByName(late))

    # The label is the smallest class; the answer is the smallest doc_id of its classes.
    named = classes.select("c1", "c2", "least", F.struct("c1", "c2").alias("node")).join(labels, "node", "left").select("c1", "c2", "least", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(least, "label").select("c1", "c2", "component_id", F.col("label").alias("component"))
    out = ids.join(found, ["c1", "c2"], "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), *([*keep, "component"] if keep else []))


def _edges(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = classes.select("d", F.struct("c1", "c2").alias("c")).join(ends, "c", "left_semi")
    sets = materialise(class_sets(docs, wanted, n), "sets")
    links = _verify(pairs, sets, percent)
    release(sets)
    return links
