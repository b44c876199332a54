import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns named like those that operators use or add
CLASH = "row string, k long, id long, key string, uid long, n string, p string, size long, shard int, score double, words string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'abc'[r.randrange(3)]}" for _ in range(n))


def docs_of(spark, rows, clash=False):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *(("en", "s")[len(r) - 2:] if len(r) < 4 else ()), len(r[1] or "")) for r in rows]
    schema = SCHEMA
    if clash:
        extra = ("x", 7, 7, "x", 7, "x", "x", 7, 7, 0.5, "x")
        full, schema = [(*r, *extra) for r in full], f"{SCHEMA}, {CLASH}"
    return spark.createDataFrame(full, schema)


#: nulls everywhere, empty and blank texts, repeated rows, a long text, one letter, signs only
AWKWARD = [(1, prose(1, 60)), (1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, " \t\n"), (6, "a"),
           (None, prose(2, 50)), (None, None), (7, prose(3, 30_000, 5000), None, None), (8, "!!! 123 ###"), (9, "É ß ñ 漢字 🙂 " * 20, "", "")]


@pytest.fixture()
def awkward(spark):
    return docs_of(spark, AWKWARD, clash=True)


@pytest.fixture()
def no_docs(spark):
    return docs_of(spark, [], clash=True)
