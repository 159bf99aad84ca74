import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents with every awkward case: null ids, texts and labels, empty, very long, repeated, tied, clashing columns."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [(1, "The cat sat on the mat with a hat and a bat today.", "en", 5), (2, None, "en", None), (3, "", None, 0), (None, "No id here, only words in a row.", "en", 1),
            (4, long, "en", 2), (5, long + " tail", "en", 3), (6, "The cat sat on the mat with a hat and a bat today.", "fr", 4), (6, "The cat sat on the mat with a hat and a bat today.", "fr", 4),
            (7, "\n\t  \r\n", "en", 4), (8, "üß 中文 😀 é", "de", 4), (9, "one two", "en", 4), (10, "ONE two", "en", 4)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_tokens", T.LongType())])
    return spark.createDataFrame(rows, schema)
