from __future__ import annotations

import pytest

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def text(n: int, start: int = 0) -> str:
    return " ".join(WORDS[(start + i * i) % len(WORDS)] + str((start * 7 + i) % 13) for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows and extra columns with clashing names."""
    rows = [(1, text(40), "en", "src1", 5, "x"), (2, text(40), "en", "src2", 5, "x"), (3, None, None, None, None, None), (4, "", "de", "src1", 0, "y"), (5, " \n\t ", "fr", "src0", 4, "z")]
    rows += [(6, text(30_000, 3), "en", "src0", 1, "x"), (7, "one", "de", "src3", 3, "x"), (7, "one", "de", "src3", 3, "x"), (None, "no id here", "en", "src9", 1, "x"), (8, "Ünï cöde ß \x00 ñ 中文", "es", "bad", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").withColumnRenamed("fp", "row")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
