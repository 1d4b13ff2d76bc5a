import pytest

WORDS = "river stone cloud lamp green paper north water field glass table horse window garden bridge market letter summer winter silver copper forest island valley castle".split()


def prose(seed: int, n: int) -> str:
    """Words by a fixed rule; different seeds share few runs of five."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, prose(1, 40), "en", "src0", 5, 0.5), (2, None, "en", "src1", None, None), (3, "", None, None, 0, 1.0), (None, prose(2, 30), "fr", "src0", 1, 0.1), (4, prose(1, 40), "en", "src0", 5, 0.5),
        (5, prose(3, 6000), "de", "src2", 9, 0.2), (6, "Licensed under CC BY 4.0. All rights reserved.", "en", "src2", 3, 0.3), (6, "Licensed under CC BY 4.0. All rights reserved.", "en", "src2", 3, 0.3),
        (7, "1234 5678 !!", "en", "src9", 2, 0.4), (8, "été à la forêt, ŒUVRE ﬁn \U0001f600", "fr", "nowhere", 2, 0.4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score double").withColumnRenamed("n", "n_chars").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
