import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from clausemill.llm import divergence

from .odd import TEXTS, documents, empty


def terms(text):
    import re

    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain(rows, min_docs, top):
    """The audit by definition, in whole numbers without a bound."""
    df, n, groups = defaultdict(Counter), defaultdict(Counter), {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        got = terms(text)
        df[lang].update(set(got))
        n[lang, source].update(got)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]

        def shares(counts):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (size + len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            more = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if n[lang, s][t] > 0 and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def audited(df, **kw):
    return sorted(map(tuple, divergence.audit_sources(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("min_docs", [1, 3])
def test_odd_rows(spark, min_docs):
    got = audited(documents(spark), min_docs=min_docs)
    assert got == plain([(t, lang, s) for _, t, lang, s in TEXTS], min_docs, 200) and got
    assert audited(empty(spark)) == []


def test_small_chunks_ties_and_flushes(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Ab", "é", "zz", "文字", "a\U0001f600", "ab", "É", *[f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(60)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["x", "y", "z", None, ""])) for _ in range(150)]
    monkeypatch.setattr(divergence, "_CELLS", 12)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    counts = divergence.count_terms(df, max_entries=20)
    assert counts.count() > counts.select("lang", "source", "term").distinct().count()
    assert audited(df, min_docs=2, top=5) == plain(rows, 2, 5)


def test_batches_cut_inside_a_term(spark):
    rows = [(f"same words again {'x' * (i % 3)}", "en", f"s{i % 40}") for i in range(200)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        assert audited(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=3) == plain(rows, 3, 200)
    finally:
        spark.conf.set(key, old)


def test_long_texts_go_in_pieces_and_no_term_is_cut():
    text = " ".join(f"Word{i % 977}é" for i in range(5000)).encode()
    whole = [t for p in divergence.terms_of(text, piece=100) for t in p]
    assert whole == next(divergence.terms_of(text)) and len(list(divergence.terms_of(text, 100))) > 100


def test_shares_beyond_64_bits():
    big = np.array([10**11, 5, 0], np.int64)
    assert divergence.share(big, 10**11 + 5, 3).tolist() == [1 + 10**9 * (int(c) + 1) // (10**11 + 8) for c in big]
