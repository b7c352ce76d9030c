import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, component_id string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and long texts, ties, exact and near copies, shared passages; ids distinct or null."""
    rng = random.Random(5)
    base, shared = sentence(rng, 120), sentence(rng, 70)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), None, "", " \t\n", "one", "one", "two words", "a b c d e", "A B C D E", sentence(rng, 30),
        sentence(rng, 40) + "\n" + shared + "\n" + sentence(rng, 40), shared + " " + sentence(rng, 20), sentence(rng, 60) + " " + shared,
        "é ü ß " * 40, "x" * 5000, sentence(rng, 20_000), "\x1c odd\x1dspaces here " * 30,
    ]
    texts += [sentence(rng, rng.randint(1, 150)) for _ in range(30)]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    return [*rows, (None, base), (None, None)]


@pytest.fixture
def odd_docs(spark, odd_rows):
    langs, sources = ["en", "de", None], ["src0", "src0", "src1", None]
    full = [(i, t, langs[n % 3], sources[n % 4], len(t or ""), 7, "clash", "clash") for n, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(full, DOCS).repartition(5)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
