import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausemill.llm import tokencount

from .odd import TEXTS, documents, empty


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokencount.default_path())


@pytest.fixture(scope="module")
def machine():
    return tokencount.TokenCounter(tokencount.default_path())


def sizes(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


ODD = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x85 　'strevmlld.,!-09aAéß²٣<|>_aaee  "), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_counts_equal_the_library(library, machine, texts):
    assert machine.counts(texts).tolist() == sizes(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinorst", max_size=60), st.integers(1, 40))
def test_merges_across_long_words(library, machine, word, n):
    texts = [word, word * n, "a" * n, " " * n + word, word + "\n" * n]
    assert machine.counts(texts).tolist() == sizes(library, texts)


def test_special_strings_and_contractions(library, machine):
    texts = ["a  <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endo", "ftext|>", "don't I'LL we've 'r 're 'rx ''s !'s 's't", " 's", "\n's", None, "", "x<|endoftext|>'s<|endoftext|>\n\n"]
    assert machine.counts(texts).tolist() == sizes(library, texts)
    assert machine.counts([]).tolist() == []


def test_every_token_is_one_token_of_itself(machine):
    """The property that makes the states exact: merging the bytes of a token gives that token."""
    c = machine._counter
    for t in range(256, 50_256, 97):
        parts, todo = [], [t]
        while todo:
            x = todo.pop()
            (todo.extend(reversed(c._parts[x])) if x in c._parts else parts.append(x))
        assert len(parts) >= 2 and not c._stay_apart(*c._parts[t])


def test_long_pieces_and_long_texts(library, machine):
    rng = np.random.default_rng(1)
    letters = "".join(rng.choice(list("etaoinshr"), 40_000))
    texts = [letters, "word and word. " * 60_000, "é" * 5000, "-" * 3000 + " " * 3000 + "x"]
    assert machine.counts(texts).tolist() == sizes(library, texts)


def test_few_states_are_kept(library):
    small = tokencount.TokenCounter(tokencount.default_path())
    small._counter._max = 50
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(200)) for _ in range(6)]
    got = [int(small.counts([t])[0]) for t in texts]
    assert got == sizes(library, texts) and len(small._counter._states) < 4000


def test_scan_gives_the_states_of_one_reading(machine):
    s = machine._splitter
    classes = np.random.default_rng(4).integers(0, 12, (16, 37)).astype(np.uint8)
    state, want = 0, []
    for chunk in classes.T:
        want.append(state)
        for c in chunk:
            state = int(s._next[state * 12 + c])
    assert s.entries(classes).tolist() == want


def test_rows(spark, library):
    got = tokencount.count_tokens(documents(spark), limit=5)
    want = [(i, len((t or "").encode()), k, k > 5) for (i, t, *_), k in zip(TEXTS, sizes(library, [t for _, t, *_ in TEXTS]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(empty(spark)).count() == 0 and got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_registered_query(spark, sf, library):
    from clausemill.llm.queries import op12_token_counts

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in op12_token_counts(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, n in zip(docs, sizes(library, docs.values())):
        assert tuple(got[i])[1:] == (len((docs[i] or "").encode()), n, n > 1024)
    assert op12_token_counts(spark, sf).filter(F.col("over_limit")).count() > 0
