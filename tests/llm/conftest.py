import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, host string, key string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows by (id, text[, lang, source]) with columns whose names clash with inner ones."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        data = [(i, t, lang, s, None if t is None else len(t), "r", "i", "h", "k") for i, t, lang, s in full]
        return spark.createDataFrame(data, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, odd white space, repeated rows."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 8))) for _ in range(30000))
    texts = [None, "", " ", "\n \n", "a", "Ab c", "tab\tand\x0bmore\x0c", "日本語 text é", "x" * 50000, long,
             "same words here again", "same words here again", "<|endoftext|> it's 12\n\n 3", " em space  two"]
    return [(k, t) for k, t in enumerate(texts)] + [(10, "same words here again"), (None, "no id"), (None, None)]
