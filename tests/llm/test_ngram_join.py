import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from clausemill.llm import ngram_join, shingles

from .odd import TEXTS, documents, empty


def word_set(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in "\t\n\x0b\x0c\r":
        w = w.replace(b, " ")
    w = [x for x in w.split(" ") if x]
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, percent=75):
    """(n_shingles, component_id) of each row."""
    sets = [word_set(t) for _, t in rows]
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    common = Counter((a, b) for h in held.values() for j, b in enumerate(h) for a in h[:j])
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(len(s), least[root(i)]) for i, s in enumerate(sets)]


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, **options).collect()}
    assert got == dict(zip([r[0] for r in rows], brute(rows, options.get("percent", 75))))


def test_groups_of_copies_chains_and_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choices(vocabulary, k=120) for _ in range(6)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    for i in range(260):
        w = list(base[i % 6])
        kind = i % 5
        if kind == 1:  # near copies of one text
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 2:  # a chain: each text a little further along
            w = w[i // 10 :] + base[(i + 1) % 6][: i // 10]
        elif kind == 3:  # a passage that many share
            w = rng.choices(vocabulary, k=rng.randint(5, 400)) + [passage]
        elif kind == 4:
            w = rng.choices(vocabulary, k=rng.randint(1, 30))
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, rows[i % 3][1].upper()) for i in range(30)]
    check(spark, rows)


@pytest.mark.parametrize("percent", [60, 90])
def test_other_thresholds(spark, percent):
    rng = random.Random(percent)
    rows = []
    for i in range(80):
        w = [f"v{j}" for j in range(40)]
        for _ in range(i % 4):
            w[rng.randrange(40)] = f"u{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    check(spark, rows, percent=percent)


def test_odd_documents(spark):
    got = ngram_join.jaccard_components(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    want = Counter()
    for (doc, text, _, _), (n, c) in zip([t for t in TEXTS if t[0] is not None], brute([t[:2] for t in TEXTS if t[0] is not None])):
        want[doc, n, c] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
    assert [(r.n_shingles > 0, r.component_id) for r in got if r.doc_id is None] == [(True, None)]
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_a_hub_joins_copies_that_do_not_meet_each_other(spark):
    hub = [f"h{i}" for i in range(200)]
    rows = [(0, " ".join(hub))]
    for i in range(12):
        w = list(hub)
        w[15 * i + 2 : 15 * i + 16] = [f"x{i}_{j}" for j in range(14)]
        rows.append((i + 1, " ".join(w)))
    assert len({c for _, c in brute(rows)}) == 1
    check(spark, rows)


def test_long_chains_in_random_order(spark):
    rng = random.Random(7)
    words = [f"c{i}" for i in range(4 * 300 + 44)]
    ids = rng.sample(range(10_000), 300)
    check(spark, [(d, " ".join(words[4 * i : 4 * i + 44])) for i, d in enumerate(ids)])
    order = rng.sample(range(2000), 2000)
    cut = set(range(99, 2000, 700))
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(1999) if i not in cut], "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(edges).collect()}
    starts = [0, *(i + 1 for i in sorted(cut)), 2000]
    assert got == {x: min(order[lo:hi]) for lo, hi in zip(starts, starts[1:]) for x in order[lo:hi]}


def test_linked_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 50), replace=False)) for _ in range(2))
        o = len(np.intersect1d(a, b))
        want = 100 * o >= 40 * (len(a) + len(b) - o)
        assert ngram_join.linked(a, b, 40) == want
        assert ngram_join.may_reach(ngram_join.cell_counts(a), ngram_join.cell_counts(b), 40) or not want
    assert ngram_join.may_reach(b"", ngram_join.cell_counts(a), 75)


def test_odd_cells_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 250), replace=False)) for _ in range(2))
        apart = np.unpackbits(ngram_join.odd_cells(a).view(np.uint8) ^ ngram_join.odd_cells(b).view(np.uint8)).sum()
        assert apart <= len(np.setxor1d(a, b)) and not np.any(ngram_join.odd_cells(a) ^ ngram_join.odd_cells(a))


def test_copies_without_a_centre(spark):
    """Texts edited at three places each, without the text they come from: few link, all are like."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(150), 2 if i % 10 == 0 else 4):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_long_texts_hash_as_short_ones(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"word{i % 700}" for i in range(3000)) + " " + "y" * 5000 + " end"
    whole = list(shingles.words_by_text(pa.array(["a b", text, None, ""])))
    monkeypatch.setattr(shingles, "_BLOCK", 1000)
    cut = list(shingles.words_by_text(pa.array(["a b", text, None, ""])))
    assert [(i, w.tolist()) for i, w in whole] == [(i, w.tolist()) for i, w in cut]
    assert [len(w) for _, w in whole] == [2, 3002, 0, 0]


def test_null_ids_are_no_smallest(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(None, words), (5, words + " x"), (7, words + " y"), (None, "quite another text of seven words"), (9, "one two"), (9, "one two"), (-(1 << 63), "a b c d e f"), (3, "a b c d e f")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 5), (5, 5), (7, 5), (None, None), (9, 9), (9, 9), (-(1 << 63), -(1 << 63)), (3, -(1 << 63))], key=str)
