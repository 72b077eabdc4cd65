import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh nook oasis pines quarry ridge slope tarn".split()


def sentence(seed: int, n: int) -> str:
    """Words chosen by a small recurrence; other seeds give other texts."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7))
    return " ".join(out)


#: Nulls, empties, ties, repeated rows, one long text, control signs and texts of one word.
ODD = [
    (1, sentence(1, 60), "en", "a", 10), (1, sentence(1, 60), "en", "a", 10), (2, sentence(1, 60), "en", "a", 10), (3, None, None, None, None), (4, "", "en", None, 0), (None, sentence(2, 40), "de", "b", 5),
    (None, None, None, "b", None), (5, " \n\t\x0b ", "xx", "c", 4), (6, "one", "en", "c", 3), (7, sentence(3, 30_000), "en", "a", 1), (8, "é ß 日本 😀 İΣ ́x\n\né ß", "fr", "d", 9), (9, "A" * 5000, "en", "d", 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"kept": F.lit("mine"), "node": F.lit(1), "key": F.lit(None).cast("string"), "probability": F.lit(2)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
