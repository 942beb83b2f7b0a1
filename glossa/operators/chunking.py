"""Chunking of texts into pieces of bounded token length.

* long texts (> max tokens) are cut into ``n = ceil(len / max)`` equal
  pieces of ``ceil(len / n)`` tokens (a generator, no shuffle);
* pieces shorter than ``min`` tokens are merged in input order, inside
  batches of about ``batch_records`` input records: a chunk grows until it
  has ``min`` tokens or the next piece would take it over ``max``.  A record's
  batch is its position in the order of ``id_hash`` inside the batch keys;
  positions come from counts per hash value and prefix sums, so rows of one
  id are spread over as many batches as they fill.  Chunk starts are a fold
  over the lengths (``aggregate``), and chunks are slices of the array.

Tokens come from ``tokenizer``, an expression from a text column to an array
of tokens (default: white space; pieces are tokens joined by one space), or
from ``spans``, a factory of character spans (``encoder.FileSpans`` for a
subword vocabulary): then pieces are slices of the text itself, and
together they are the text.  Texts are tokenised once: the pieces are
written as a stage table and both branches read that.  Ids keep their type.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.text import tokens
from glossa.operators.encoder import _get
from glossa.session import materialize

# Fixed values of the method.
TARGET_MIN = 250           # shortest chunk aimed at
TARGET_MAX = 510           # longest chunk (512 minus two special tokens)
MODEL_MAX = 512
BATCH_RECORDS = 2000       # records per merge batch
SPECIAL_TOKENS = 2         # that the model adds to every text


def id_hash(id_col) -> Column:
    """A uniform 32-bit number of an id: the first 8 hex digits of
    ``md5(id)`` (the same in any engine that has md5)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def with_batches(short: DataFrame, records: DataFrame, batch_keys: Sequence[str],
                 batch_records: int = BATCH_RECORDS) -> DataFrame:
    """``short`` pieces with ``batch``, the number of their record's batch
    inside ``batch_keys``.  ``records`` has one row per input record.  Both
    have ``doc_id``, the keys and ``_row``, a number of the record.

    Records are counted per (keys, id hash), so a record costs nothing that
    grows with the rows of its id; a hash value's first position is the count
    before it, found inside equal ranges of the hash and then over them.
    Records of one hash value take places in its stretch by a hash of
    ``_row``."""
    keys = list(batch_keys)
    n = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = (records.groupBy(*keys, id_hash("doc_id").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_bkt", F.floor(F.col("_h") * n / F.lit(1 << 32)).cast("int")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_in", F.coalesce(F.sum("_n").over(
        before(Window.partitionBy(*keys, "_bkt").orderBy("_h"))), F.lit(0)))
    totals = counts.groupBy(*keys, "_bkt").agg(F.sum("_n").alias("_t")).select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_bkt").alias("_c_bkt"),
        F.coalesce(F.sum("_t").over(before(Window.partitionBy(*keys).orderBy("_bkt"))), F.lit(0)).alias("_off"))
    same = F.col("_bkt") == F.col("_c_bkt")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    places = inside.join(totals, same).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_h").alias("_k_h"), F.col("_n"),
        (F.col("_in") + F.col("_off")).alias("_first"))
    same = F.col("_h") == F.col("_k_h")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    at = F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_n"))
    return (short.withColumn("_h", id_hash("doc_id")).join(places, same)
            .withColumn("batch", F.floor(at / F.lit(batch_records)).cast("long"))
            .drop("_h", "_k_h", "_n", "_first", *[f"_k_{k}" for k in keys]))


def split_long(df: DataFrame, text_col: str = "text", max_len: int = TARGET_MAX,
               tokenizer: Callable = tokens, model_max: int | None = None) -> DataFrame:
    """One row per piece: ``piece`` (0-based), ``n_tokens``, ``text``
    (tokens joined by one space).  Texts of at most ``max_len`` tokens give
    one piece; an empty text gives one empty piece.  With ``model_max`` every
    piece is tokenised again and cut where it and the special tokens would
    exceed it (P6): subwords can grow when a text is cut."""
    # tokenise once; every later expression reads the materialised column
    with_toks = df.withColumn("_toks", tokenizer(F.col(text_col)))
    n = F.size("_toks")
    n_splits = F.ceil(n / F.lit(max_len))
    piece_len = F.when(n > max_len, F.ceil(n / n_splits)).otherwise(n).cast("int")
    sized = with_toks.withColumn("_plen", piece_len).withColumn("_n", n)
    starts = F.when(F.col("_n") > max_len, F.sequence(F.lit(0), F.col("_n") - 1, F.col("_plen"))) \
        .otherwise(F.array(F.lit(0)))
    out = sized.select("*", F.posexplode(starts).alias("piece", "_start"))
    out = out.withColumn("_pt", F.slice(F.col("_toks"), F.col("_start") + 1, F.col("_plen")))
    if model_max is not None:
        out = out.withColumn("_pt", F.slice(tokenizer(F.array_join("_pt", " ")), 1, model_max - SPECIAL_TOKENS))
    return (out.withColumn(text_col, F.array_join("_pt", " "))
            .withColumn("n_tokens", F.size("_pt"))
            .drop("_toks", "_plen", "_start", "_pt", "_n"))


def split_spans(df: DataFrame, spans: Callable, text_col: str = "text", max_len: int = TARGET_MAX) -> DataFrame:
    """C1 with a span tokenizer: one row per piece: ``piece``, ``n_tokens``
    and the slice of the text from the piece's first token up to the next
    piece's (the first begins with the text, the last ends with it), so the
    pieces of a text joined are the text.  A token that is part of a
    character belongs to the piece that the character falls to."""
    keep = [f for f in df.schema.fields if f.name not in (text_col, "piece", "n_tokens")]
    schema = T.StructType([*keep, T.StructField("piece", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()),
                           T.StructField(text_col, T.StringType())])

    def run(batches):
        cut = _get(spans)
        for rb in batches:
            for at in range(0, rb.num_rows, 256):
                part = rb.slice(at, 256)
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                rows, pieces, lengths, out = [], [], [], []
                for i, (text, found) in enumerate(zip(texts, cut(texts))):
                    n = len(found)
                    size = -(-n // -(-n // max_len)) if n > max_len else max(n, 1)
                    starts = list(range(0, max(n, 1), size))
                    chars = [0, *(int(found[s, 0]) for s in starts[1:]), len(text)]
                    rows += [i] * len(starts)
                    pieces += range(len(starts))
                    lengths += [min(size, n - s) for s in starts]
                    out += [text[a:b] for a, b in zip(chars, chars[1:])]
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name).take(take) for f in keep), pa.array(pieces, pa.int32()),
                     pa.array(lengths, pa.int32()), pa.array(out, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def cut_to_model(df: DataFrame, spans: Callable, model_max: int = MODEL_MAX, text_col: str = "text",
                 count_col: str = "n_tokens") -> DataFrame:
    """P6 for stored chunks: every chunk is tokenised again, and one that the
    model could not take with its special tokens ends before the first token
    too many; ``n_tokens`` is what it has then."""
    names = df.columns
    limit = model_max - spans.special_tokens

    def run(batches):
        cut = _get(spans)
        for rb in batches:
            for at in range(0, rb.num_rows, 256):
                part = rb.slice(at, 256)
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                counts, out = [], []
                for text, found in zip(texts, cut(texts)):
                    out.append(text if len(found) <= limit else text[:int(found[limit, 0])])
                    counts.append(min(len(found), limit))
                new = {text_col: pa.array(out, pa.string()), count_col: pa.array(counts, pa.int32())}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names=names)

    return df.mapInArrow(run, df.withColumn(count_col, F.col(count_col).cast("int")).schema)


def pieces_of(docs: DataFrame, max_len: int = TARGET_MAX, tokenizer: Callable = tokens,
              model_max: int | None = None, spans: Callable | None = None) -> DataFrame:
    """The pieces of all texts as a stage table (C1, tokenised here and
    nowhere else), with ``_row``, a number of the input record."""
    rows = docs.select("doc_id", "text", "language", "source", F.monotonically_increasing_id().alias("_row"))
    found = split_spans(rows, spans, max_len=max_len) if spans else split_long(rows, "text", max_len, tokenizer, model_max)
    return materialize(found.select("doc_id", F.col("piece").cast("int").alias("piece"),
                                    F.col("n_tokens").cast("int").alias("n_tokens"), "language", "source", "_row", "text"),
                       "pieces")


def _chunk_starts(items: Column, min_len: int, max_len: int) -> Column:
    """1-based positions at which a chunk starts, from the lengths ``n`` of
    the pieces in order."""
    def step(s: Column, p: Column) -> Column:
        opens = (s["size"] >= min_len) | (s["size"] + p["n"] > max_len)
        return F.struct(
            F.when(opens, p["n"]).otherwise(s["size"] + p["n"]).alias("size"), (s["at"] + 1).alias("at"),
            F.when(opens, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"))
    zero = F.struct(F.lit(0).alias("size"), F.lit(1).alias("at"), F.array(F.lit(1)).alias("starts"))
    return F.aggregate(items, zero, step, lambda s: s["starts"])


def merge_short(pieces: DataFrame, batch_keys: Sequence[str], min_len: int = TARGET_MIN,
                max_len: int = TARGET_MAX, batch_records: int = BATCH_RECORDS, joiner: str = " ") -> DataFrame:
    """Merge pieces (``pieces_of``) of fewer than ``min_len`` tokens, per
    batch, in (doc_id, piece) order.  Output: first fragment's (doc_id, piece), the
    last fragment's language, sorted distinct sources joined by ',',
    ``n_tokens``, ``n_fragments`` and the joined text; chunks without any
    token are dropped."""
    batched = with_batches(pieces.filter(F.col("n_tokens") < min_len), pieces.filter("piece = 0"), batch_keys, batch_records)
    keys = [F.col(k).alias(f"_k_{k}") for k in batch_keys]
    item = F.struct("doc_id", F.col("piece").cast("int").alias("piece"), F.col("n_tokens").cast("int").alias("n"),
                    "language", "source", "text")
    batches = (batched.groupBy(*keys, F.col("batch").cast("long").alias("batch"))
               .agg(F.array_sort(F.collect_list(item)).alias("_items")))
    starts = batches.withColumn("_starts", _chunk_starts(F.col("_items"), min_len, max_len))
    chunks = starts.select("batch", "_items", "_starts", F.posexplode("_starts").alias("_i", "_from"))
    upto = F.coalesce(F.get("_starts", F.col("_i") + 1), F.size("_items") + 1)
    frags = chunks.select("batch", F.slice("_items", F.col("_from"), upto - F.col("_from")).alias("f"))
    total = F.aggregate("f", F.lit(0), lambda a, x: a + x["n"])
    return frags.select(
        F.col("f")[0]["doc_id"].alias("doc_id"), F.col("f")[0]["piece"].alias("piece"),
        F.element_at("f", -1)["language"].alias("language"),
        F.array_join(F.array_sort(F.array_distinct(F.col("f.source"))), ",").alias("source"),
        "batch", total.alias("n_tokens"), F.size("f").alias("n_fragments"),
        F.array_join(F.filter(F.col("f.text"), lambda t: t != ""), joiner).alias("text")).filter("n_tokens > 0")


def smart_chunk(docs: DataFrame, batch_keys: Sequence[str] = ("language", "source"),
                min_len: int = TARGET_MIN, max_len: int = TARGET_MAX,
                batch_records: int = BATCH_RECORDS, tokenizer: Callable = tokens,
                model_max: int | None = None, spans: Callable | None = None) -> DataFrame:
    """``(doc_id, piece, language, source, batch, n_tokens, n_fragments,
    text)``: pieces of ``min_len..max_len`` tokens pass through (no batch),
    long texts are split (C1) and short pieces merged (C2; slices of texts
    are joined as they are).  With ``spans`` and ``model_max`` every chunk is
    checked against the model (``cut_to_model``).  ``docs`` has doc_id (any
    type), text, language, source."""
    pieces = pieces_of(docs, max_len, tokenizer, model_max, spans)
    direct = (pieces.filter(F.col("n_tokens") >= min_len)
              .select("doc_id", "piece", "language", "source", F.lit(None).cast("long").alias("batch"),
                      "n_tokens", F.lit(1).alias("n_fragments"), "text"))
    chunks = direct.unionByName(merge_short(pieces, batch_keys, min_len, max_len, batch_records, "" if spans else " "))
    return cut_to_model(chunks, spans, model_max) if spans and model_max else chunks


def chunk_estimate(docs: DataFrame, min_len: int = TARGET_MIN, max_len: int = TARGET_MAX,
                   tokenizer: Callable = tokens) -> DataFrame:
    """Per language ``total_items`` and ``estimated``, the number of
    chunks (sources chunked together), counted exactly at every size."""
    totals = docs.groupBy("language").agg(F.count(F.lit(1)).alias("total_items"))
    counts = (smart_chunk(docs, ["language"], min_len, max_len, tokenizer=tokenizer)
              .groupBy("language").agg(F.count(F.lit(1)).alias("estimated")))
    return totals.join(counts, "language", "left").fillna(0, ["estimated"])
