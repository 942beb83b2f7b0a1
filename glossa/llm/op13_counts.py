"""Operator 13: token counts through a digest cache.

The cache is a table in a folder: one row per tokenizer version and content
digest with the stored count.  A version is the SHA-256 of the tokenizer's
file, library, library release and options, so another file, release or
option never meets old counts; it is the partition column.  The content
digest is the SHA-256 of the normalised text.

1. Keys: one scan writes (id, digest, bytes), no text.
2. Distinct digests with one document each that holds them (grouped with
   map-side combine, so copies cost nothing) are joined with the cache; what
   is missing there is a miss.
3. Only texts of misses are encoded: documents meet the misses on (digest,
   id), so the copies of one text spread over their ids and all but one go;
   rows repeated within a task leave before that shuffle.
4. The counts found are appended to the cache, and every document takes its
   count from there; digests of more than one in a thousand rows are
   broadcast, all others join by a shuffle.

A run that is lost between the append and the result only finds more in the
cache next time; two runs that append the same digest store the same count,
and readers take one row per digest.

Normalisation may join only texts of equal count.  The default takes null as
empty and leaves all else, which holds for every tokenizer; give another
expression for a tokenizer known to fold more.

Defined cases: null or empty texts are counted once as the empty text (0
tokens unless the tokenizer says otherwise); texts of any length are encoded
whole; null and equal ids keep one row each; an empty table gives no rows
and leaves the cache as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.spread import attach
from glossa.llm.stages import remove, small_batches, stage_path, store, table
from glossa.llm.tokens import tokenizer_path

TOKEN_LIMIT = 4096
CALL_CHARS = 1 << 18        # characters handed to the tokenizer at once
RECENT = 20_000             # (id, digest) pairs a task remembers
CACHE = "digest binary, n_tokens long"


class TokenCounter:
    """Counts of whole texts by the file's own library: ``.model`` by
    sentencepiece, ``.json`` by tokenizers; no begin, end or added special
    tokens, no truncation or padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1, add_bos=False, add_eos=False)
        else:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._ids = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CALL_CHARS):
                chars += len(texts[end])
                end += 1
            out += map(len, self._ids(texts[at:end]))
            at = end
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def tokenizer_version(path: str) -> str:
    """Digest of everything that fixes a count but the text."""
    import importlib.metadata
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {importlib.metadata.version(library)} plain ids\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def null_as_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` stored under a tokenizer version, one row each."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(str(path)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _drop_recent(batches):
    """Rows whose (id, digest) this task saw lately go."""
    young, old = set(), set()
    for batch in batches:
        keep = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keep.append(key not in young and key not in old)
            young.add(key)
        if len(young) > RECENT:
            young, old = set(), young
        yield batch.filter(pa.array(keep))


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """``(digest, text)`` -> ``(digest, n_tokens)``; equal neighbours are
    encoded once."""
    def run(batches):
        counter, last, n = _counter(path), None, 0
        for batch in batches:
            digests, rows = batch.column(0).to_pylist(), batch.column(1)
            fresh = [i for i, d in enumerate(digests) if d != (digests[i - 1] if i else last)]
            found = dict(zip(fresh, counter.counts(rows.take(pa.array(fresh, pa.int64())).to_pylist())))
            out = []
            for i in range(len(digests)):
                n = found.get(i, n)
                out.append(n)
            last = digests[-1] if digests else last
            yield pa.RecordBatch.from_pydict({"digest": batch.column(0), "n_tokens": pa.array(out, pa.int64())})
    return texts.select("digest", "text").mapInArrow(run, CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
                 normalise: Callable[[Column], Column] = null_as_empty) -> DataFrame:
    """``(doc_id, digest, n_bytes, n_tokens)`` of every row; counts that
    ``cache`` lacks are encoded and appended to it."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    content = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw"),
                          normalise(F.col(text_col)).alias("text")) \
        .withColumn("digest", F.unhex(F.sha2("text", 256)))
    _, keys = store(content.select("doc_id", "digest", F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long")
                                   .alias("n_bytes")), "count-keys")
    group_path, groups = store(keys.groupBy("digest").agg(F.min("doc_id").alias("holder"),
                                                          F.count(F.lit(1)).alias("n_rows")), "count-digests")
    miss_path, misses = store(groups.join(cached_counts(spark, cache, version), "digest", "left_anti"), "count-misses")
    with small_batches(spark, 256):
        texts = (content.select("doc_id", "digest", "text").mapInArrow(_drop_recent, "doc_id " + _type(content) +
                                                                       ", digest binary, text string").alias("t")
                 .join(misses.alias("m"), (F.col("t.digest") == F.col("m.digest"))
                       & F.col("t.doc_id").eqNullSafe(F.col("m.holder")), "left_semi"))
        found = encode_misses(texts, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        found.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    total = keys.count()
    _, counts = store(groups.join(cached_counts(spark, cache, version), "digest", "left")
                      .select("digest", "n_rows", F.coalesce("n_tokens", F.raise_error(F.lit("a digest without a count"))
                                                             .cast("long")).alias("n_tokens")), "count-found")
    remove(spark, group_path, miss_path)
    return attach(keys, counts, "digest", "n_rows", total)


def _type(content: DataFrame) -> str:
    return content.schema["doc_id"].dataType.simpleString()


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of ``documents`` by the piece vocabulary, over a cache
    that starts empty (every distinct text is a miss once)."""
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"),
                          stage_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
