from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Nulls in any column, empty and very long texts, repeated rows, copies, ties, odd white space and names."""
    words = [f"w{i % 97}x{i % 13}" for i in range(30_000)]
    rows = [(1, "one two three", "en", "src0"), (2, None, "en", "src1"), (3, "", None, "src1"), (4, " \t\n ", "en", None),
            (5, "one two three", "de", "src2"), (5, "one two three", "de", "src2"), (7, " ".join(words), "en", "src0"),
            (8, "a" * 50_000, "en", "src3"), (9, "tabs\tand\x0bfeeds\r\nü ö  two  spaces ", "fr", "src3"),
            (10, "<|endoftext|> is text", "en", "src10"), (11, "em space and more​", "en", "src2"),
            (12, "İstanbul ﬁ é 日本語 😀 don't WE'LL", "tr", None), (13, "end.\nNext, line; here: yes! no?", "es", "src2"),
            (None, "no id", "en", "src4"), (None, "no id", "en", "src4")]
    rows += [(100 + i, f"copy {i % 5} " + "filler text here " * (i % 40), "en", "src0") for i in range(60)]
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows above, with extra columns that clash with names used inside the operators."""
    from pyspark.sql import functions as F
    extra = {c: F.lit(i) for i, c in enumerate(["_row", "size", "part", "ids", "shard", "n_tokens", "_key", "_g", "text_key", "kept", "score"])}
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3).withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
