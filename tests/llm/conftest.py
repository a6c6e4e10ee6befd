import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, md string, size long, key long, words string, slot int, root string, _score double, block string, piece int"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows, ties, near copies, a very long text, and columns with clashing names."""
    base = words(1, 120)
    near = base.split()
    near[60] = "other"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "!!! ???"), (7, words(2, 60_000, 3000)), (8, "Ünïcode ßtraße ﬁ 12³ \U0001f600 é\r\n\t x"), (8, "Ünïcode ßtraße ﬁ 12³ \U0001f600 é\r\n\t x"),
        (None, words(3, 40)), (None, None), (9, words(4, 90)), (10, words(4, 90) + " extra"), (11, "one two"), (12, "ONE two!"), (13, "a" * 3000), (-5, words(5, 30)),
    ]
    return [(i, t, None, "s", None, "h", "md", 1, 2, "w", 3, "r", 0.5, "b", 7) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i):
    return zlib.crc32(str(i).encode())
