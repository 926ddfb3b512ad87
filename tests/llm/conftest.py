import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "st", "r") for c in ("a", "o", "ing", "ed")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empties, ties, repeated rows, one very long text, and extra columns whose
    names are those that operators use inside."""
    long_text = prose(1, 60_000)
    rows = [
        (1, "a plain text of some words", "x"), (2, None, None), (3, "", "x"), (4, "   \n\t ", "x"),
        (5, "a plain text of some words", None), (5, "a plain text of some words", "y"), (6, long_text, "z"),
        (None, "text without an id but words enough", "n"), (None, None, None), (7, "short", "x"),
        (8, "a\x0bplain  text of\tsome\nwords", "w"), (9, "x" * 50_000, "one word"),
    ]
    kinds = "doc_id long, text string, _file string, score double, node string, digest string, word long, `n` long, `odd name.x` string"
    return spark.createDataFrame([(i, t, f, 0.5, f, f, 1, 2, f) for i, t, f in rows], kinds)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plain(df):
    """Rows as tuples, in an order that nulls don't disturb."""
    return sorted((tuple(r) for r in df.collect()), key=str)
