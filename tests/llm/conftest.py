import os

import pytest

# Python workers import the package by name.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SHAPE = "doc_id long, text string, lang string, source string, n_chars int, size long, key string, node string, id long, score double, shard int, slot long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, columns whose names the operators use."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[(i * i + i // 7) % 12] + str(i % 977) for i in range(6000))
    passage = ". ".join(" ".join(words[(i + j * 5) % 12] + str(j * 40 + i) for i in range(9)) for j in range(8)) + "."
    rows = [
        (1, passage, "en", "a"), (2, "Intro words here.\n" + passage + "\nOutro.", "en", "a"), (3, passage, None, None),
        (3, passage, None, None), (4, None, "en", "b"), (None, "short text", "en", None), (5, "", None, "b"), (6, " \t\n", "en", "b"),
        (7, long, "en", "c"), (8, long + " end", "en", "c"), (None, None, None, None), (9, "!!! ### $$$", "en", "a"), (5, "other text under a used id", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, "k", "n", 1, 0.5, 3, 9) for r in rows], SHAPE).repartition(4)
