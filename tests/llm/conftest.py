import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The awkward corpus as a stored table."""
    from llm_corpus import corpus
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    corpus(spark).write.parquet(path)
    return spark.read.parquet(path)
