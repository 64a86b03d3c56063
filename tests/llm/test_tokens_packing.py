import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausemill.llm import packing, tokenfile, tokens
from clausemill.llm.common import scratch_dir

from .odd import TEXTS, documents, empty


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@pytest.fixture(scope="module")
def coder():
    return tokens.WordIds(tokens.default_path(), max_words=50)


def ids_of(library, text, *end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, *end], "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c'stredvml.,!-09aAéÉßÿ<|>\x1c\x85µªİΣ"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_cache_gives_the_librarys_ids(library, coder, text):
    assert coder.encode([text, text]) == [ids_of(library, text)] * 2


def test_special_tokens_and_long_words(library, coder):
    for t in ["a<|endoftext|>b <|startoftext|>", "x" * 500 + " y", "don't I'LL we'Ve", None, ""]:
        assert coder.encode([t]) == [ids_of(library, t)]


def test_the_cache_stays_small_within_a_batch(library):
    coder = tokens.WordIds(tokens.default_path(), max_words=50)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}, d'é{i % 7}" for i in range(600))
    assert coder.encode([text] * 2) == [ids_of(library, text)] * 2
    assert len(coder._known) + len(getattr(coder._known, "_old", ())) <= 50


def test_other_tasks_drop_the_encoder(spark):
    from clausemill.llm.common import kept, tidy

    here = tokens.encoder(tokens.default_path())
    list(tidy(iter, "tokens")([]))
    assert tokens.encoder(tokens.default_path()) is here
    list(tidy(iter)([]))
    assert not kept("tokens")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 6))
def test_windows_keep_every_id_once(sizes, k):
    box = packing.OpenWindows(16, k, 0)
    docs = [np.arange(100 * i, 100 * i + n, dtype="<u4").tobytes() for i, n in enumerate(sizes)]
    rows = [r for i, d in enumerate(docs) for r in box.add(i, d)] + list(box.finish())
    got, fill = defaultdict(dict), defaultdict(int)
    for doc, start, n, ids, total, seq, offset in rows:
        assert n == len(ids) // 4 and total == sizes[doc] and offset == fill[seq]
        fill[seq] += n
        got[doc][start] = ids
    assert all(n <= 16 for n in fill.values())
    assert [b"".join(v for _, v in sorted(got[i].items())) for i in range(len(docs))] == docs


def test_leftovers_need_no_padding():
    box = packing.OpenWindows(16, 8, 0)
    rows = [r for i in range(5) for r in box.add(i, bytes(4 * 7))] + list(box.finish())
    fill = defaultdict(int)
    for r in rows:
        fill[r[5]] += r[2]
    assert sorted(fill.values()) == [1, 2, 16, 16]


def test_packing_of_odd_documents(spark, library):
    rows = packing.pack_documents(documents(spark).coalesce(1), open_windows=4).collect()
    want = sorted(ids_of(library, t, 1) for _, t, _, _ in TEXTS)
    parts = defaultdict(list)
    fill = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill[r.sequence_id] == r.offset
        fill[r.sequence_id] += r.length
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    assert sum(len(w) for w in want) == 4 * sum(fill.values()) and max(fill.values()) <= 2048
    assert b"".join(b for _, b in sorted(parts[5])) == ids_of(library, TEXTS[4][1], 1)
    assert len(parts[9]) == 2 and len(parts[None]) == 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_padding_is_small(spark, sf):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    sizes = [r.n for r in rows]
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding <= 0.02 * sum(sizes)


def test_token_files(spark, library):
    path = scratch_dir(spark, "orc") + "/t"
    tokenfile.write_token_files(tokenfile.encode_sorted(documents(spark), partitions=3), path)
    files = tokenfile.read_token_files(spark, path)
    got = {(r.doc_id, r.start): r for r in tokenfile.describe_files(files).collect()}
    at = 0
    for doc, text, _, _ in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = ids_of(library, text, 2)
        r = got[(doc, at)]
        assert (r.n_tokens, r.ids_crc32) == (len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert len(got) == len(TEXTS)
    assert [r.doc_id for r in tokenfile.lookup(spark, path, [7, 999]).collect()] == [7]


def test_token_files_prune_by_id(spark, sf):
    path = scratch_dir(spark, "orc") + "/t"
    tokenfile.write_token_files(tokenfile.encode_sorted(spark.read.parquet(f"{sf}/documents.parquet"), partitions=2), path)
    plan = tokenfile.lookup(spark, path, [3])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1][:80]


def test_empty_token_files(spark):
    path = scratch_dir(spark, "orc") + "/t"
    tokenfile.write_token_files(tokenfile.encode_sorted(empty(spark)), path)
    assert tokenfile.describe_files(tokenfile.read_token_files(spark, path)).count() == 0
