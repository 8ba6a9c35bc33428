import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_llm import ODD  # noqa: E402

@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text[, source]) rows to a documents table with clashing extra columns."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
         T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
         T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in (
            "size", "hash", "block", "row", "gone", "node", "score", "curve", "label", "id",
            "target", "copies", "which", "bucket", "taken", "key")])

    def make(rows):
        out = []
        for r in rows:
            doc_id, text, source = (*r, "web")[:3] if len(r) < 3 else r
            out.append((doc_id, text, None, source, None if text is None else len(text),
                        *["x"] * 16))
        return spark.createDataFrame(out, schema)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)
