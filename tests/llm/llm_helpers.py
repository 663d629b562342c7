"""Rows that every operator must handle, and small helpers."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
PASSAGE = " ".join(f"w{i}" for i in range(60))


def edge_rows():
    """(doc_id, text): NULLs, empty and blank texts, long texts, ties, repeats."""
    base = " ".join(WORDS[i % 12] + str(i % 17) for i in range(80))
    return [
        (0, base), (1, base), (2, base + " more"), (3, base.upper()), (4, None), (5, ""), (6, " \t\n\x0b "),
        (7, "one"), (8, "one two"), (9, "two  one"), (10, PASSAGE + "\n" + base), (11, PASSAGE), (11, PASSAGE),
        (None, PASSAGE), (None, None), (12, "é à ü ß — 日本語 \U0001F600 " * 30), (13, "x" * 300_000),
        (14, "long words " * 20_000), (15, "a\nb\na\nb\n" + PASSAGE + "\n" + PASSAGE), (16, "nbsp\u00a0kept"),
        (17, "!!! *** ### $$$ %%% " * 20), (18, "<|endoftext|> twice <|endoftext|>"), (19, "0" * 50 + "\n" + "1" * 50),
    ]


CLASHING = ["key", "uid", "h", "size", "node", "n", "label", "kept", "sha", "root", "_doc", "score", "target", "gone"]


def rows_of(df, *columns):
    """Sorted row texts of some columns."""
    return sorted(str(tuple(r)) for r in (df.select(*columns) if columns else df).collect())
