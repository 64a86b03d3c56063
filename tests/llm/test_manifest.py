import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import manifest
from clausemill.llm.common import fold_remainder, lower_ascii

from .odd import documents, empty


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def lower(text):
    return text and "".join(c.lower() if c.isascii() else c for c in text)


def plain(rows, fanout):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    trees, order = {}, sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s, members in by_source.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in members], fanout)
    top = tree([trees[s][-1][0] for s in order], fanout)
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, r in enumerate(by_source[s]):
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node, proof = leaf(r, lower(r["text"]) if touched else r["text"]), []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // fanout * fanout :][:fanout]
                    proof += run[: at % fanout] + run[at % fanout + 1 :]
                    node = h(*run[: at % fanout], node, *run[at % fanout + 1 :])
                    at //= fanout
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], root, h(*proof), node, node == root))
    return sorted(out, key=str)


def checked(docs, **kw):
    touched = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    m = manifest.build(docs, tampered=F.when(touched, lower_ascii(F.col("text"))).otherwise(F.col("text")), **kw)
    return sorted(map(tuple, manifest.verify(m).collect()), key=str)


@pytest.mark.parametrize("fanout, levels", [(16, 3), (2, 1), (2, 2), (3, 1)])
def test_odd_rows(spark, fanout, levels):
    docs = documents(spark)
    got = checked(docs, fanout=fanout, levels=levels)
    assert got == plain([r.asDict() for r in docs.collect()], fanout)
    assert {r[-1] for r in got} == {True, False}
    assert checked(empty(spark)) == []


@pytest.mark.parametrize("levels", [1, 2])
def test_many_blocks_and_many_sources(spark, levels):
    """A hot source over many blocks and rounds, sources of one to a few rows, more of them than a run."""
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i}", i) for i in range(400)] + [(900, "A", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert checked(docs, fanout=4, levels=levels) == plain([r.asDict() for r in docs.collect()], 4)


def test_one_row_alone(spark):
    docs = spark.createDataFrame([(4, "Same text, no siblings", "en", "a", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = checked(docs)
    assert row[1] == row[2] == row[3] == row[5] or not row[-1]
    assert row[4] == sha256(b"").hexdigest()


def test_levels_of_a_block():
    nodes = np.frombuffer("".join(h(str(i)) for i in range(37)).encode(), np.uint8).reshape(-1, 64)
    got = manifest.block_levels(nodes, 37, 16, 3)
    assert [len(x) for x in got] == [37, 3, 1] and got[1][2].tobytes().decode() == h(*[h(str(i)) for i in range(32, 37)])
    assert [len(x) for x in manifest.block_levels(nodes[:1], 4097, 16, 3)] == [1, 1, 1, 1]  # a last block alone in its runs
    assert len(manifest.block_levels(nodes[:1], 1, 16, 3)) == 1
