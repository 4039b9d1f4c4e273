import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=1, n=60):
    """Texts with copies, shared passages, nulls, empty and long ones, repeated rows and a hot source."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Ünï", "É", "the", "a"]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    out = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 5, 30, 80]))]
        if i % 7 == 0 and out:
            words = (out[-1][1] or "").split()
        if i % 5 == 0:
            at = rnd.randint(0, len(words))
            words[at:at] = passage[: rnd.choice([12, 13, 14, 40])]
        out.append([i, rnd.choice([" ", "\n", "  ", "\t"]).join(words), rnd.choice(["en", "de"]), "hot" if i % 3 else rnd.choice(["a", "B", None, "ü"]), 0])
    out += [[n, None, None, None, None], [n + 1, "", "en", "a", 0], [n + 2, " \n\t ", "en", "a", 3], [n + 3, " ".join(rnd.choice(vocabulary) for _ in range(5000)), "en", "hot", 1]]
    out.append([n + 4, out[-1][1][:-3], "en", "hot", 1])
    out += [list(out[3]), list(out[3])]
    return [tuple(r) for r in out]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Further columns with names that operators use themselves."""
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["fp", "size", "_block", "value", "n_words", "kept", "_row", "component_id", "score", "rate", "copies", "u", "root"])])
