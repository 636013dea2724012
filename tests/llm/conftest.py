import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, h1 long, size string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "stone", "river", "cloud", "walks", "green", "seven", "under", "light", "houses"]) + rng.choice(["", "", "s", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and long texts, copies, near copies, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(8)]
    shared = prose(rng, 40)
    texts = {0: base[0], 1: base[0], 2: None, 3: "", 4: "  \n\t ", 5: base[1] + "\n" + shared, 6: base[2] + " " + shared + " " + base[3], 7: base[1].replace("stone", "stones", 1) + "\n" + shared}
    texts |= {8: "é" * 120 + " naïve", 9: "a" * 500, 10: "word", 11: base[4] + "\n" + base[4], 12: "\x0bvertical\x0cfeed\rreturn", 13: prose(rng, 30000), 14: "12 34 !!", 15: "\U0001f600 smile \U0001f600 " * 30}
    texts |= {20 + i: prose(rng, rng.randint(1, 200)) for i in range(30)}
    rows = [(k, t, [None, "xx", "yy"][k % 3], [None, "s1", "s2", "s1"][k % 4], None, "w", 1, "z") for k, t in texts.items()]
    rows += [rows[0], rows[5], (None, base[5], None, None, None, None, None, None), (None, base[6], "xx", "s1", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
