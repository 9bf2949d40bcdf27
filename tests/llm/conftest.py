import random

import pytest

#: Columns of ``documents`` and some whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid bigint, norm string, n int, key string, text_hash string, kept string"


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def cases():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, exact and near copies, shared passages."""
    rng = random.Random(3)
    base = words(rng, 120, 10_000)
    near = base.split()
    near[50] = "changed"
    passage = words(rng, 70, 10_000)
    texts = [
        None, "", " \t\n ", "Hello  world", "Hello world", "hello world", "Hello\nworld", base, base, " ".join(near), base.replace(" ", "\n", 3),
        words(rng, 60, 9_000) + " " + passage + " " + words(rng, 30, 9_000), words(rng, 40, 9_000) + " " + passage, "é" * 300, "é" * 300, "word " * 400, "a b c", "A B c",
        "the same line of twenty and more\nx", "The same line of twenty and more  \ny", "z\n the same line of twenty and more", words(rng, 3000, 400), "\n".join(["dup line that is long enough"] * 5 + ["other"] * 2),
    ]
    rows = list(enumerate(texts))
    return [*rows, rows[7], rows[7], (None, "no id here at all"), (None, "no id here at all"), (None, None), (3, "Hello  world"), (3, "another text of doc three")]


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, None if i == 4 else "en", None if i == 5 else f"src{(i or 0) % 3}", None, 1, "x", 2, "k", "h", "no") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
