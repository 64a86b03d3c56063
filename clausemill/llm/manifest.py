"""A Merkle manifest of a dataset: digests of rows, a tree for each source, one over the sources.

Positions come from one shuffle by range. Nodes then meet in aligned blocks of ``fanout**levels``:
a task holds a block's digests as a contiguous matrix of 64-byte hex rows, reshapes it to runs of
``fanout``, hashes the runs, and goes on with the next level; whose siblings are whose is index
arithmetic. Block roots are the nodes of the next round, so a source of any size is spread over
many tasks, and a few rounds reach the root. Paths come back down the same blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<at:int,run:string>>"
_ARROW_PATH = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.string())]))


def leaf_digest(*fields: Column) -> Column:
    """sha256 over the fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


def hash_runs(digests: np.ndarray, fanout: int) -> np.ndarray:
    """The next level of an (n, 64) matrix of hex digests: every ``fanout`` rows make one, the
    last run may be shorter."""
    whole = len(digests) // fanout
    rows = digests[: whole * fanout].reshape(whole, 64 * fanout)
    out = [sha256(r.data).hexdigest() for r in rows]
    if whole * fanout < len(digests):
        out.append(sha256(digests[whole * fanout :].data).hexdigest())
    return np.frombuffer("".join(out).encode(), np.uint8).reshape(-1, 64)


def block_levels(digests: np.ndarray, size: int, fanout: int, levels: int) -> list[np.ndarray]:
    """The levels of a block, from its nodes up: ``levels`` of them, fewer where a group of
    ``size`` nodes has come to one before."""
    out = [digests]
    while len(out) <= levels and size > 1:
        out.append(hash_runs(out[-1], fanout))
        size = -(-size // fanout)
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _runs(levels: list[np.ndarray]) -> list[bytes]:
    """Levels that have a parent, as bytes: run r is the slice of 64 * fanout bytes from there on."""
    return [m.tobytes() for m in levels[:-1]]


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place in the group ``g`` by ``order`` from 0, and ``n``, its size.
    Rows are dealt by range, a large group to many tasks, and only sums per group and task meet."""
    given = rows.withColumn("_given", F.monotonically_increasing_id())  # rows that are alike are dealt apart
    dealt = given.repartitionByRange("g", *order, "_given").sortWithinPartitions("g", *order).drop("_given")
    held = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    sums = held.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("g", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_n").over(Window.partitionBy("g")).alias("n"))
    return held.join(bases, ["g", "_part"]).withColumn("pos", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")


def climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of nodes (g, pos, n, digest), the given ones first; in the last each group has one."""
    block = fanout**levels

    def run(table: pa.Table) -> pa.Table:
        t = _in_order(table)
        n = t["n"][0].as_py()
        top = block_levels(_matrix(t["digest"]), n, fanout, levels)[-1]
        return pa.table({"g": t["g"][:1], "pos": pa.array([t["pos"][0].as_py() // block]), "n": pa.array([-(-n // block)]), "digest": pa.array([top[0].tobytes().decode()])})

    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        blocks = rounds[-1].select("g", "pos", "n", "digest").withColumn("b", F.floor(F.col("pos") / block))
        rounds.append(materialise(blocks.groupBy("g", "b").applyInArrow(run, "g string, pos long, n long, digest string"), "nodes"))
        most = -(-most // block)
    return rounds


def descend(nodes: DataFrame, paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(g, pos, path) of nodes, from the paths (g, b, path) of their blocks. A path holds each
    level's whole run and the node's place in it, lowest level first."""
    block = fanout**levels

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = _in_order(left)
        runs, upper, width = _runs(block_levels(_matrix(t["digest"]), t["n"][0].as_py(), fanout, levels)), right["path"][0].as_py(), 64 * fanout
        out = []
        for i in range(len(t)):
            path = []
            for r in runs:
                path.append({"at": i % fanout, "run": r[i // fanout * width : (i // fanout + 1) * width].decode()})
                i //= fanout
            out.append(path + upper)
        return pa.table({"g": t["g"], "pos": t["pos"], "path": pa.array(out, _ARROW_PATH)})

    left = nodes.select("g", "pos", "n", "digest", F.floor(F.col("pos") / block).alias("b"))
    return left.groupBy("g", "b").cogroup(paths.groupBy("g", "b")).applyInArrow(run, f"g string, pos long, path {_PATH}")


def _down(rounds: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Paths (g, b, path) of the blocks of the first round, from those of the last round's nodes."""
    paths = top
    for nodes in reversed(rounds[1:-1]):
        paths = descend(nodes, paths, fanout, levels).withColumnRenamed("pos", "b")
    return paths


@dataclass
class Manifest:
    """``leaves``: doc_id, g, pos, n, digest and ``other`` (the digest to check, null: the same).
    ``paths``: (g, b, path, subroot) of their blocks. ``root`` is None for a table without rows."""

    leaves: DataFrame
    paths: DataFrame
    root: str | None
    fanout: int
    levels: int


def build(docs: DataFrame, tampered: Column | None = None, fanout: int = 16, levels: int = 3) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored).
    ``tampered``, if given, is the text whose digest ``verify`` folds in place of the leaf's own.

    Leaves of a source ascend by doc_id, null first, ties by digest, so that repeated rows are leaves
    of their own whose order makes no difference. A null source is a source; sources are ordered by
    UTF-8, null first. Null and empty fields differ. Texts are hashed before anything is shuffled.
    """
    spark = docs.sparkSession
    one = [docs[c] for c in FIELDS]
    leaf, other = leaf_digest(*one), F.lit(None).cast("string")
    if tampered is not None:
        same = leaf_digest(*one[:-1], tampered)
        other = F.when(~tampered.eqNullSafe(docs["text"]), same)
    g = F.coalesce(F.concat(F.lit("+"), docs["source"].cast("string")), F.lit("!"))  # "!" sorts before "+"
    leaves = numbered(docs.select(docs["doc_id"], g.alias("g"), leaf.alias("digest"), other.alias("other")), "doc_id", "digest")
    rounds = climb(leaves, fanout, levels)
    tops = rounds[-1].select("g", "digest")
    subroots = materialise(numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("label"), "digest"), "label"), "subroots")
    over = climb(subroots, fanout, levels)
    roots = over[-1].select("digest").take(1)
    nothing = F.lit([]).cast(_PATH)
    block = fanout**levels
    if len(over) > 1:
        blocks = _down(over, over[-1].select("g", F.lit(0).cast("long").alias("b"), nothing.alias("path")), fanout, levels)
        found = descend(subroots, blocks, fanout, levels).join(subroots.select("pos", "label"), "pos").select(F.col("label").alias("g"), "path")
    else:
        found = subroots.select(F.col("label").alias("g"), nothing.alias("path"))
    top = materialise(found, "source-paths").select("g", F.lit(0).cast("long").alias("b"), "path")
    paths = _down(rounds, top, fanout, levels) if len(rounds) > 1 else top
    return Manifest(leaves, paths.join(tops.select("g", F.col("digest").alias("subroot")), "g"), roots[0][0] if roots else None, fanout, levels)


def verify(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (over the siblings of each level up to the root),
    folded_root (from ``other`` or the leaf and the siblings) and verified, a row for each leaf."""
    fanout, levels, root = m.fanout, m.levels, m.root
    block, width = fanout**levels, 64 * fanout
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = _in_order(left)
        runs = _runs(block_levels(_matrix(t["digest"]), t["n"][0].as_py(), fanout, levels))
        upper = [(x["at"] * 64, x["run"].encode()) for x in right["path"][0].as_py()]
        proofs, folded = [], []
        for i, (own, other) in enumerate(zip(t["digest"].to_pylist(), t["other"].to_pylist())):
            node, proof = (other or own).encode(), sha256()
            steps = []
            for r in runs:
                steps.append((i % fanout * 64, r[i // fanout * width : (i // fanout + 1) * width]))
                i //= fanout
            for at, whole in [*steps, *upper]:
                before, after = whole[:at], whole[at + 64 :]
                proof.update(before + after)
                node = sha256(before + node + after).hexdigest().encode()
            proofs.append(proof.hexdigest())
            folded.append(node.decode())
        n = len(t)
        return pa.table([t["doc_id"], t["digest"], pa.array([right["subroot"][0].as_py()] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], names=names)

    schema = T.StructType([m.leaves.schema["doc_id"], *[T.StructField(c, T.StringType()) for c in names[1:-1]], T.StructField("verified", T.BooleanType())])
    left = m.leaves.withColumn("b", F.floor(F.col("pos") / block))
    return left.groupBy("g", "b").cogroup(m.paths.groupBy("g", "b")).applyInArrow(run, schema)
