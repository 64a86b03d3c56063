"""Documents with nulls, empty and blank texts, a long text, repeated rows, ties, odd characters,
and columns whose names clash with the operators' own."""

LONG = "\n".join(f"Line {i % 97} of a long text with some words, and more of them." for i in range(3000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
NEAR = " ".join(WORDS * 3)
TEXTS = [
    (1, "Plain words here, for the first document of them all.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "en", "b"), (5, LONG, "en", "b"),
    (6, NEAR, "en", "a"), (7, NEAR, "en", "c"), (8, NEAR + " omega", "en", "c"), (9, "one two", "fr", "b"), (9, "one two", "fr", "b"), (10, "ONE two", None, "b"),
    (11, "é 文字 \U0001f600 x\x85y\x1cz", "de", "d"), (12, "Same line\nSAME LINE \n\nlast", "en", "a"), (None, "no id at all, but words", "en", "a"), (13, "<|endoftext|> it's", "en", "~"), (14, "1234 $$$ ###", "en", "="),
]


def documents(spark):
    """The rows above, with extra columns of clashing names."""
    rows = [(i, t, lang, s, len(t or ""), 7, "x", "y", 1) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rk1 int, score string, gone string, n_lines int")


def empty(spark):
    return documents(spark).limit(0)
