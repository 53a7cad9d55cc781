"""Small inputs with every awkward row."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, spans string"


def awkward(spark, texts=()):
    """Nulls in every column, empty and long texts, repeated rows, columns named like results."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(30000))
    rows = [(None, None, None, None, None, None, None, None), (1, None, "en", "s", 0, 0.5, 1, "x"), (2, "", "en", "s", 0, 0.5, 1, "x")]
    rows += [(3, " \n\t ", None, None, None, None, None, None), (4, long, "en", "s", len(long), 0.1, 0, "y")]
    rows += [(5, "same row", "en", "s", 8, 0.1, 0, "y")] * 2 + [(None, "no id here", "fr", "s", 10, 0.2, 1, "z")]
    rows += [(100 + k, t, "en", "s", len(t), 0.3, 0, "w") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
