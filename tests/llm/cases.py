"""Documents with every odd shape the operators promise to handle."""

import random

#: Extra columns with names that the operators may use themselves, and their values.
CLASHES = {
    "key string": "clash", "ids array<int>": [1], "n long": 5, "lines string": "l", "name string": None, "row long": 6, "_h long": 7, "_copy int": 8, "_cut string": "c", "_row long": 9,
    "_pieces string": "p", "_id long": 10, "_score double": 0.5, "_q0 string": "q", "_Q1 int": 11, "size long": 12, "bucket int": 13, "n_worded int": 14,
}
DOCS = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *CLASHES])


def odd_documents(spark, extra=()):
    """Nulls, empty and long texts, repeated rows, ties, and columns with clashing names."""
    random.seed(7)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    base = text(120)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace(" ", "\n", 3), None, "b"),
        (4, None, "en", "b"),
        (5, "", "en", None),
        (5, "", "en", None),
        (6, "one two", "en", "c"),
        (7, text(20000), "en", "c"),
        (8, "x" * 30000, "en", "a"),
        (None, text(50), "en", "a"),
        (9, base + " tail", "en", "c"),
        (9, "é ß\x1c日本 🙂  \n\n l'été", "fr", "c"),
        *extra,
    ]
    return spark.createDataFrame([(*r, None, *CLASHES.values()) for r in rows], DOCS)


def kept_clashes(rows):
    """Whether the extra columns have come through as they were."""
    names = [c.split()[0] for c in CLASHES]
    return all([r[c] for c in names] == list(CLASHES.values()) for r in rows)
