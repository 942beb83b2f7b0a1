"""Corpus pipeline over ``documents``: quality rules, line dedup, n-gram
Jaccard join, mixing to target weights, best-fit packing.

Every stage works on all rows that its predecessor kept and is written as
Parquet in the shared folder before the next one reads it, so a lost
executor costs one stage at most.  The tables that a stage made on its way
are removed by the next one, whose input is that result.  All stages but the
last return the columns of ``documents``; the last returns the place of
every piece in the packed sequences.

* quality: documents that fail the base rules or a certified cutoff go;
* lines: boilerplate lines of a source leave the texts (a document whose
  lines all go keeps its row with an empty text);
* near_copies: of each group of linked documents one row of the smallest id
  stays;
* mixing: rows repeat, or hold part of their words, as the mix draws their
  blocks; documents without a word are not drawn;
* packing: token pieces of all rows are packed into sequences.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from glossa.llm.op1_ngrams import one_per_group
from glossa.llm.op5_lines import clean_documents
from glossa.llm.op6_packing import pack_documents
from glossa.llm.op8_quality import keep_good
from glossa.llm.op9_mixing import mix_documents
from glossa.llm.stages import noted_paths, remove, store, table
from glossa.llm.tokens import tokenizer_path


_MADE: dict[str, list[str]] = {}        # stage -> tables of its last call, not yet removed


def _after(before: str | None):
    """A stage that reads the stored result of ``before``: the tables made
    there are not read again."""
    def wrap(stage):
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            remove(spark, *_MADE.pop(before, []))
            with noted_paths() as made:
                out = stage(spark, docs, sf_dir)
            _MADE[stage.__name__] = made
            return out
        return run_stage
    return wrap


@_after(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


@_after("quality")
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


@_after("lines")
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


@_after("near_copies")
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


@_after("mixing")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: No SQL: near copies need a transitive closure and mixing its keyed hash;
#: tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path, after = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            remove(spark, last)         # the result before this one
        docs, last = after, path
    return STAGES[-1][1](spark, docs, sf_dir)
