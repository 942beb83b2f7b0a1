"""The pipeline: every stage on its own input, against the operators' plain
statements where they are cheap, and the query end to end."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glossa.llm.tokens import tokenizer_path
from llm_corpus import SF, corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Each stage's stored result on the given documents."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def test_stages_in_order(spark, results):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mixing", "packing"]
    seen = {}
    for name, out in results.items():
        if name != "packing":
            assert out.dtypes == first.dtypes
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 or name == "mixing"
        seen[name] = out
        docs = out
    assert 0 < seen["near_copies"].count() < seen["lines"].count() == seen["quality"].count() < first.count()
    # mixing: the words of a source come near its share, no document above three times
    words = lambda df: [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()]
    before, after = words(seen["near_copies"]), words(seen["mixing"])
    size, taken = defaultdict(int), defaultdict(int)
    for d, _, n in before:
        size[d] += n
    for d, _, n in after:
        taken[d] += n
    assert all(taken[d] <= 3 * size[d] for d in taken)
    assert abs(sum(taken.values()) - sum(size.values())) <= 0.05 * sum(size.values())
    # packing: every row's tokens, once
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in seen["mixing"].collect():
        x = np.asarray(tok.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
        want += [(r["doc_id"], k, zlib.crc32(x[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(x), 4096))]
    got = [(r["doc_id"], r["piece"], r["ids_crc32"]) for r in seen["packing"].collect()]
    assert sorted(got) == sorted(want)


def test_run_equals_the_stages(spark, results):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(results["packing"])
    assert corpus_pipeline.ORACLE_SQL is None


def test_awkward_rows_and_clashing_names(spark, tmp_path):
    """Null and repeated rows, empty texts, and columns named like those the
    operators use, through all stages; then an empty table."""
    docs = corpus(spark)
    for c in ("_doc_id", "_t0", "m_doc_id", "t0", "h", "stays", "_row", "rows", "smallest"):
        docs = docs.withColumn(c, F.lit(1))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0 and (name == "packing" or docs.columns == names)
    assert corpus_pipeline.near_copies(spark, corpus(spark).filter("doc_id = -999999"), SF).count() == 0
