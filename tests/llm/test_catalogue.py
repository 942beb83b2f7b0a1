"""The registered queries: names, columns and SQL twins."""

import pytest

import __spark_entry__ as entry
from glossa.llm import catalogue
from llm_corpus import SF
from oracle import compare, connect

COLUMNS = {
    1: {"doc_id", "n_shingles", "component_id"}, 2: {"doc_id", "start", "n_tokens", "ids_crc32"},
    3: {"doc_id", "n_words", "n_removed", "kept_sha256"},
    4: {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, 5: {"page_id", "host"},
    6: {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, 7: {"query_id", "doc_id"},
    8: {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    9: {"doc_id", "size", "source_size", "target", "taken"}, 10: {"doc_id", "held_out", "score", "predicted"},
    11: {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    12: {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    13: {"doc_id", "n_bytes", "n_tokens", "over_limit"},
}


def test_one_query_per_operator():
    names = list(catalogue.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(entry.queries())
    assert set(catalogue.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql_twins(spark, name):
    compare(catalogue.QUERIES[name](spark, SF), connect(SF), catalogue.SQL[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL and not n.startswith("op10")])
def test_columns(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert COLUMNS[int(name[2:].split("_")[0])] <= set(df.columns)
