import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from texts or (doc_id, text[, source]) rows."""

    def make(rows, extra=False):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source = (i, row, "s") if not isinstance(row, tuple) else (*row, "s")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that the operators use inside
            for name in ("raw", "words", "size", "h", "gate", "base", "found", "rep", "n", "digest", "row", "taken_", "c1", "label", "x"):
                df = df.selectExpr("*", f"1 AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences."""

    def make(seed, n):
        r = random.Random(seed)
        out = ["".join(r.choice(("ta", "ro", "mi", "len", "su", "ko", "é")) for _ in range(r.randint(1, 3))) for _ in range(n)]
        for i in range(9, n, 10):
            out[i] += "." if i % 20 != 9 else ".\n"
        return " ".join(out)

    return make


#: Texts that no operator may stumble over.
ODD = [None, "", " ", "\n\n", "a", "  ", "word " * 30_000, "x" * 200_000, "ÀÉ\U0001f600 \x00 ends", "\n".join(["same line here."] * 400), "\\x27 ' \" % $ { } [ ] ( ) * + ? ^ |"]
