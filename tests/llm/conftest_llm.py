import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(seed=5, n=120):
    """Texts with copies, near copies, shared lines and passages, and odd ones."""
    own = random.Random(seed)
    word = lambda: "".join(own.choice("abcdefghé") for _ in range(own.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    text = lambda k: " ".join(own.choice(vocabulary) for _ in range(k))
    line, passage = text(12), text(70)
    out = [None, "", " \n\t", "one", "two words", "One", "Two  words", text(4000)]
    while len(out) < n:
        kind, body = own.random(), text(own.randint(3, 150))
        if kind < 0.1 and out[-1]:
            out.append(own.choice([x for x in out if x]))
        elif kind < 0.35 and len(out) > 10:
            base = own.choice([x for x in out if x and len(x) > 300] or [text(80)]).split(" ")
            for _ in range(own.randint(1, 4)):
                base[own.randrange(len(base))] = word()
            out.append(" ".join(base))
        elif kind < 0.5:
            out.append(body + "\n " + line.upper() + "\t\n" + text(5) + "\r\n")
        elif kind < 0.65:
            out.append(text(own.randint(0, 9)) + " " + passage + "\n" + body)
        else:
            out.append(body)
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, corpus())


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, repeated rows, repeated ids, and columns whose names clash."""
    from pyspark.sql import functions as F

    rows = [(None, "alpha beta gamma delta", None, None, None), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 3000, "en", "s", 1), (4, "dup text here now", "de", "s", 1), (4, "dup text here now", "de", "s", 1), (5, "dup text here now", "de", "t", 1), (5, "another text altogether", "de", "t", 1)]
    clash = ["id", "a", "b", "key", "keys", "rep", "component", "n", "hits", "items", "edge", "part", "kept", "n_words", "__ul_x"]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
