import random

import pytest

WORDS = ["the", "of", "and", "in", "to", "thation", "ering", "haly", "ouand", "tion", "nder", "esth", "Bletion", "é", "ñandú", "über"]


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "\n"]) + str(r.randint(0, 400)) * (r.random() < 0.5) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def corpus(prose):
    """Rows with nulls, empty and very long texts, copies, near copies, shared passages, ties and repeated rows."""
    base = prose(120, 1)
    words = base.split()
    shared = prose(60, 2)
    texts = [base, base, " ".join(words[:-1]), " ".join(["x1", *words]), prose(80, 3) + " " + shared + " " + prose(40, 4),
             shared, prose(30, 5) + "\n" + shared, None, "", "  \n\t ", "one", "one", "One two three four", "one two three four five",
             "a b c d e f g h i j " * 60, prose(6000, 6), prose(6000, 6) + " end", "Àé" * 40 + " " + "Àé" * 40, "z" * 500, "z" * 500,
             "x" * 49, "y" * 50, "y" * 51, "# * $ % & | < > " * 30, shared.upper()]
    texts += [prose(50, 100 + i) for i in range(40)]
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], "src0" if i % 2 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return rows


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["batch", "part", "kept", "class", "n", "note", "row", "hits", "host", "component", "doc", "spans", "_key", "_clean", "_q_x", "words"]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    df = spark.createDataFrame(corpus, COLUMNS)
    return df.select("*", *(df["doc_id"].cast("string").alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Repeated rows and null ids on top."""
    more = [corpus[0], corpus[0], corpus[4], (None, corpus[0][1], None, None, None), (None, None, None, None, None), (None, "one", "en", "s", 3)]
    return spark.createDataFrame(corpus + more, COLUMNS)
