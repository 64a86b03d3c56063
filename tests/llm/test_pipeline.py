import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from clausemill.llm import mixing, tokens
from clausemill.llm.common import materialise

from .odd import documents, empty
from .test_lines_mixing import brute_lines
from .test_ngram_join import brute


def words(text):
    for b in "\t\n\x0b\x0c\r":
        text = text.replace(b, " ")
    return len([w for w in text.split(" ") if w])


@pytest.fixture(scope="module")
def kept(spark, sf):
    """(rows before, rows after) of each stage over a table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in P.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf), "test")
        out[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
    return out


def test_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mix", "packing"]


def test_language_stage(kept):
    before, after = kept["language_id"]
    stay = Counter((r.doc_id, r.text) for r in after)
    lettered = Counter((r.doc_id, r.text) for r in before if any(map(str.isalpha, r.text or "")))
    assert not stay - lettered and (lettered - stay).total() < 0.02 * len(before)


def test_line_stage(kept):
    before, after = kept["line_dedup"]
    want = {r.doc_id: w[0] for r, w in zip(before, brute_lines([r.text for r in before], 10))}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_near_duplicate_stage(kept):
    before, after = kept["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, (_, c) in zip(before, groups) if r.doc_id == c)


def test_near_duplicates_of_rows_that_share_an_id(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, b + " end"), (None, a + " more"), (None, ""), (4, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in P.near_duplicate_stage(spark, docs, sf).collect())
    assert got == Counter([(None, a + " more"), (1, b), (None, ""), (4, ""), (4, None)])


def test_mix_stage(kept):
    before, after = kept["source_mix"]
    n = Counter((r.doc_id, r.text, r.source) for r in after)
    assert set(n.values()) <= {1, 2} and set(n) <= {(r.doc_id, r.text, r.source) for r in before}
    sizes, longest, taken = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    for (_, text, source), k in n.items():
        taken[source] += k * words(text)
    # Documents are taken whole: what is missing is less than a document that would still fit.
    assert all(abs(taken[s] - t) <= max(longest[s], 1) for s, t in mixing.share_targets(dict(sizes)).items())


def check_packed(before, after):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    ids = {t: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in {r.text for r in before}}
    want = Counter((r.doc_id, len(ids[r.text])) for r in before)
    assert Counter((r.doc_id, r.doc_tokens) for r in after if r.start == 0) == want
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    texts = defaultdict(list)
    for r in before:
        texts[r.doc_id].append(ids[r.text])
    fill, spans = defaultdict(list), Counter()
    for r in after:
        assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 and len(x) == r.doc_tokens for x in texts[r.doc_id])
        fill[r.sequence_id].append((r.offset, r.length))
        spans[r.doc_id] += r.length
    assert spans == {d: sum(map(len, x)) for d, x in texts.items()}
    for pieces in fill.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    return sum(2048 - sum(n for _, n in p) for p in fill.values() if (k := sum(n for _, n in p)) & (k - 1)) / max(1, sum(spans.values()))


def test_packing_stage(kept):
    assert check_packed(*kept["packing"]) < 0.05


def test_stages_on_odd_and_empty_tables(spark, sf):
    docs = documents(spark)
    for name, stage in P.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf), "test")
        if name == "language_id":  # no letter, no text, no row
            assert {r.doc_id for r in docs.collect()} <= {1, 5, 6, 7, 8, 9, 10, 11, 12, 13, None}
        if name == "near_duplicates":
            ids = [r.doc_id for r in docs.collect()]
            assert ids.count(9) <= 1 and not {7, 8} & set(ids) or 6 not in {r.doc_id for r in before.collect()}
    check_packed(before.collect(), docs.collect())
    docs = empty(spark)
    for _, stage in P.STAGES:
        docs = materialise(stage(spark, docs, sf), "test")
        assert docs.count() == 0


def test_run(spark, sf, kept):
    rows = P.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = lambda rs: Counter((r.doc_id, r.doc_tokens) for r in rs if r.start == 0)
    assert whole(rows.collect()) == whole(kept["packing"][1])
