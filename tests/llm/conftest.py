import random

import pytest
from pyspark.sql import types as T

from texts import prose

@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that operators use inside
                     T.StructField("fp", T.StringType()), T.StructField("key", T.LongType()), T.StructField("id", T.StringType()),
                     T.StructField("h", T.LongType()), T.StructField("bad", T.StringType()), T.StructField("n_lines", T.StringType()),
                     T.StructField("block", T.StringType()), T.StructField("host", T.StringType()), T.StructField("spans", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang, source]) with further columns of clashing names."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""),
                 "x", 1, "y", 2, "z", "q", "b", "h", "p") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def awkward(rng):
    """Null ids and texts, empty, blank, very long, repeated and near-equal texts."""
    base = prose(rng, 300)
    return [(1, base), (2, base), (2, base), (3, base.replace("the", "The", 1)), (4, None), (5, ""), (6, " \n\t "), (None, base),
            (None, None), (7, "one"), (8, prose(rng, 20_000)), (9, "a" * 70_000), (10, prose(rng, 120)), (11, prose(rng, 120)),
            (12, "x y 中文 \U0001d49c <|endoftext|> don't I'LL 12.5"), (13, "one")]
