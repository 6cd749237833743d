import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASHING = ("n_shingles", "digest", "keys", "key", "text_hash", "score", "lang_pred", "label", "count", "group", "place", "start", "spans", "topic", "weight", "tokens", "probability", "own", "next", "_part", "low", "held", "places", "detections", "g_lang", "turns", "tie", "n_words", "first", "doc")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empties, ties, repeated rows, copies, near copies, shared passages, one very long text."""
    base = words(60, 1)
    edited = base.replace(base.split()[30], "changed", 1)
    passage = words(50, 2)
    rows = [
        (5, base, "en", "a", len(base)), (3, base, "en", "a", len(base)), (9, base.upper(), "en", "b", len(base)), (4, edited, "fr", "b", len(edited)),
        (10, None, None, None, None), (11, "", "en", None, 0), (12, " \n\t ", None, "a", 4), (13, "one two", "en", "a", 7), (14, "one two", "en", "a", 7), (15, "one two", "de", "c", 7),
        (15, "one two", "de", "c", 7), (None, base, None, "a", 1), (None, words(40, 3), "en", "a", 1), (None, None, None, None, None),
        (20, words(30, 4) + " " + passage + " " + words(30, 5), "en", "a", 9), (21, passage + " " + words(40, 6), "en", "a", 9), (22, words(40, 7) + "\n" + passage, "de", "b", 9),
        (23, words(20, 8) * 2, "en", "a", 9), (24, "é" * 150 + words(10, 9) + "é" * 150, "fr", "a", 9), (25, "x" * 450, "en", "a", 450), (26, "\U0001f600 ünïcode ñ 中文 text", "es", "c", 9),
        (30, (words(3000, 10) + "\n") * 40 + words(200_000, 11), "en", "a", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["lang"], t["source"], strict=True))
