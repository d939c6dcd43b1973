import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, k int, id string, root string, __pm_k string, __PM_nth string"


def prose(seed, words):
    rng = random.Random(seed)
    stems = ["ana", "bel", "cor", "dun", "eri", "fol", "gam", "hes", "iru", "jol", "kem", "lun"]
    out = []
    for i in range(words):
        word = "".join(rng.choice(stems) for _ in range(rng.randint(1, 3)))
        out.append(word + ("." if rng.random() < 0.1 or i == words - 1 else ""))
    return " ".join(out)


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "h", 1, "id", "root", "key", "x")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows, columns whose names clash with inner ones."""
    base = prose(1, 300)
    long_ = prose(2, 60_000)
    return [
        row(1, base),
        row(2, None),
        row(3, ""),
        row(4, " \n\t "),
        row(5, long_),
        row(6, base),
        row(6, base),
        row(None, base),
        row(None, None, None, None),
        row(7, prose(3, 80), None, None),
        row(8, "x" * 50_000),
        row(9, "é  中文 \U0001f600 \x1f!\x00?"),
        row(10, "de " * 3000),
        row(11, "Word"),
        row(12, base.replace("ana", "anb", 3)),
        (None, None, None, None, None, None, None, None, None, None, None),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
