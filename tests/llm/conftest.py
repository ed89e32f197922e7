from __future__ import annotations

import pytest

LONG = "wide word " * 30_000
#: Null and empty texts, blanks, ties and repeated rows, one very long text, odd characters, a null id.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the quiet river bank today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the quiet river bank today.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n", "de", "b"),
    (6, "Éan Éan Éan Éan 日本 <|endoftext|> \u0000 x\x85y", "fr", "c"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund am stillen Fluss heute.", "de", "a"),
    (8, LONG, "en", "a"),
    (8, LONG, "en", "a"),
    (None, "no id at all but some words that nobody else has", "en", "zz"),
    (9, "and then: The quick brown fox jumps over the lazy dog near the quiet river bank today. Ende", "en", None),
]
EXTRA = "fp long, score double, grp int, rate double, copies long, ids string, t long, doc string, _doc long, size int, media binary, word string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all odd kinds, with extra columns whose names operators use themselves."""
    names = [f.split()[0] for f in EXTRA.split(", ")]
    rows = [(d, t, la, s, None if t is None else len(t), *[None] * len(names)) for d, t, la, s in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture
def folder(tmp_path):
    """Writes frames as the tables of a folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
