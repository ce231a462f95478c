import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near(rng, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty texts, copies, near copies, shared passages, shared lines, a hot source, a long text, repeated rows."""
    rng = random.Random(7)
    texts: list = [None, "", " \t\n ", "one", "One two three four", "é É ß ß", "a" * 3000]
    base = [" ".join(words(rng, rng.randrange(20, 120))) for _ in range(12)]
    passage = " ".join(words(rng, 30))
    for b in base:
        texts += [b, b, near(rng, b, 1), near(rng, b, 6), b + " " + passage, passage + " " + near(rng, b, 20)]
    lines = ["First shared line of text", "Second shared line", "Third one"]
    texts += ["\n".join([*lines, f"own line {k}", *lines[: k % 3]]) for k in range(8)]
    texts += ["\n".join(["x" * 220, f"only {k}"]) for k in range(3)] + ["\n\n".join(lines)] * 2
    texts.append(" ".join(words(rng, 5000, 3000)))
    out = [(i, t, ("en", "fr", None)[i % 3], "hot" if i % 3 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[8], out[8], (None, base[0], "en", None, 5), (10**12, base[1], "", "é", 7)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
