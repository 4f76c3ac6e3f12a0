import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Random texts with copies, near copies, shared passages, a very long one, blanks and nulls."""
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = prose(rng, 40)
    out += [prose(rng, 10) + " " + passage + " " + prose(rng, 10) for _ in range(8)]
    out += [out[3], out[3], out[3].upper(), out[7] + " tail"]
    words = prose(rng, 200).split()
    for i in range(6):
        w = list(words)
        w[10 * i] = "changed"
        out.append(" ".join(w))
    out += ["la " * 3000, "", None, " \n\t ", "é" * 150 + " ü" * 90, "x", prose(rng, 6000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names an operator might use itself."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    from pyspark.sql import functions as F

    extra = ["key", "s", "e", "doc", "node", "f0", "part", "size", "target", "copies", "curve", "rank", "score", "spans", "component_id", "fetched"]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("extra") for c in extra})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
