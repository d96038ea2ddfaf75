import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, found string, hit string, "
          "fingerprint string, chunk string")


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ordinary texts, copies, near copies, shared passages, nulls, empty, blank, repeated and very long ones."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(1, 160), 4000) for _ in range(40)]
    passage = words(rng, 60, 9000)
    near = base[3].split()
    out = list(enumerate(base))
    out += [(100, base[0]), (101, base[0]), (100, base[0]), (102, " ".join(near[:-1] + ["other"])),
            (103, base[5] + "\n" + passage + "\n" + base[6]), (104, passage), (105, base[7] + " " + passage),
            (106, None), (107, ""), (108, " \t\n "), (None, base[8]), (None, None), (109, "é ü ß 中文 😀 " + base[9]),
            (110, words(rng, 6000, 50)), (111, "a " * 900), (112, "aaaaaaaaaa" * 60), (113, "x" * 3000), (114, "one two")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with further columns whose names the operators use inside."""
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), "r", "f", "h", "p", "c") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
