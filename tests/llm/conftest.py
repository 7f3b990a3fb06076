import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, blanks, ties, repeats, near copies, long texts, and text beyond ASCII."""
    base, long = words(1, 200), words(2, 30_000)
    near = base.split()
    near[100] = "changed"
    texts = [base, base.upper(), " ".join(near), base, "", None, " \t\n\x0b\x0c\r ", "one", "two words", "a b c d", "a b c d e", long, long + " tail", "été ñandú — 漢字\u00a0x\u2003y " * 30, words(3, 49), words(3, 50), "x " + words(3, 50), "\x1c \x1f a\x85b", words(4, 120), words(4, 120)]
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 4 else f"s{i % 4}", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[2], rows[11], (None, base, "en", "s1", 5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    """df with extra columns of these names."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(n) for n in names])
