import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the red fox ran over a lazy dog and then some more words came by to fill this text with enough of them so that sets differ".split()


def passage(seed: int, n: int = 40) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows and clashing column names."""
    base = passage(1, 80)
    near = base.replace(base.split()[40], "changed")
    texts = [base, base, near, passage(2), passage(2) + " " + passage(3), None, "", "   ", "é" * 60, "日本語 " * 30, "x" * 120_000, passage(4, 3000), "a b c", "A B C", "\\### <|turn|> \\0 <\\1", "1 2 3", passage(3) + passage(5)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2], None if t is None or i == 4 else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], (None, passage(2), "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
