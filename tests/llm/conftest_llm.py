"""Rows that the tests of the text operators share."""

WORDS = "the of and red blue stone river house light table green night paper cloud window garden".split()
# Columns whose names the operators use inside.
CLASH = ("id", "key", "words", "prints", "component", "place", "cut", "lines", "level", "own", "hits", "url_", "at")


def make_docs(spark, rows, extra=True):
    """(doc_id, text[, lang, source]) rows as a documents table with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        full = [(*r, *("x",) * len(CLASH)) for r in full]
        names += "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame(full, names)


def prose(rng, words):
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") if rng.random() < 0.7 else "") for _ in range(words))


# Null, empty and blank texts, null ids, repeated rows and ids, controls, and a text without any space.
ODD = [(None, "a text without an id and with some words"), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (4, "one"), (4, "another text of the same id"),
       (5, "x" * 5000), (6, "é " * 300), (7, "\n\n\n"), (8, "a,b;c"), (None, None)]
