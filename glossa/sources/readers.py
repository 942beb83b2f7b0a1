"""Readers (S1-S10).

Line-oriented inputs are first turned into a *line table* with a column
``value`` (the line) and a column ``line_key`` that orders lines as they
appear in the input (file path, block start and position inside the
split).  Every parser below takes such a table, so the same code reads
files and lines derived from other tables.  Where the input format says
"the last one wins", the winner is ``max_by(..., line_key)``.

JSON lines are read by the type of the parsed value, never by how a text
begins.  A malformed line, or one of another shape than the format has,
fails the job with the line in the message (``malformed="fail"``); with
``"skip"`` it is left out and ``rejects`` lists it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.text import doc_text, strip

PASSAGE_SCHEMA = T.StructType([
    T.StructField("docid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
])

_OBJECT = "map<string,variant>"


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _object(v: Column) -> Column:
    """Fields of an object, null for every other type."""
    return F.when(_kind(v) == "OBJECT", v.cast(_OBJECT))


def _scalar(v: Column) -> Column:
    """Text of a value: a string as it is, null for null."""
    return v.cast("string")


def _printed(v: Column) -> Column:
    """Text of an array item that is no object, as printed: None, True,
    False, numbers and strings."""
    return (F.when(F.is_variant_null(v) | v.isNull(), F.lit("None"))
            .when(_kind(v) == "BOOLEAN", F.initcap(v.cast("string"))).otherwise(_scalar(v)))


def _well_formed(objects: bool) -> Column:
    """Whether the parsed line ``v`` is JSON (an object where one is due)."""
    v = F.col("v")
    return v.isNotNull() & (F.coalesce(_kind(v) == "OBJECT", F.lit(False)) if objects else F.lit(True))


def _values(lines: DataFrame) -> DataFrame:
    return lines.filter(~_is_blank(F.col("value"))).withColumn("v", F.try_parse_json(strip(F.col("value"))))


def rejects(lines: DataFrame, objects: bool = False) -> DataFrame:
    """The lines that are not blank and no JSON; with ``objects`` also those
    that are JSON but no object, which the readers of labelled texts,
    queries, corpora and judgments cannot use (S2, S7-S9)."""
    return _values(lines).filter(~_well_formed(objects)).drop("v")


def _parsed(lines: DataFrame, malformed: str, objects: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``*by, line_key, v``: the parsed lines (blank ones are skipped)."""
    if malformed not in ("fail", "skip"):
        raise ValueError(f"malformed: {malformed}")
    body = _values(lines)
    if malformed == "skip":
        return body.filter(_well_formed(objects)).select(*by, "line_key", "v")
    bad = F.raise_error(F.concat(F.lit("malformed JSON line: "), F.substring("value", 1, 200)))
    return body.select(*by, "line_key", F.when(_well_formed(objects), F.col("v")).otherwise(bad.cast("variant")).alias("v"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files -> ``(line_key, value)``.  ``line_key`` =
    (file path, split start, position in the task), which follows the line
    order of every file; splitting large files stays parallel."""
    df = spark.read.text(path)
    return df.select(
        F.struct(F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("pos")).alias("line_key"),
        "value")


def _is_blank(col: Column) -> Column:
    return strip(F.coalesce(col, F.lit(""))) == ""


# S1 ------------------------------------------------------------------------

def _records(values: DataFrame, text_column: str) -> DataFrame:
    """``line_key, v`` -> ``line_key, item, text``: an object gives its
    ``text_column`` (missing or null -> ''), an array one row per item."""
    items = values.select("line_key", F.posexplode(
        F.when(_kind(F.col("v")) == "ARRAY", F.col("v").cast("array<variant>")).otherwise(F.array("v"))).alias("item", "x"))
    return items.select("line_key", "item", F.when(
        _kind(F.col("x")) == "OBJECT", F.coalesce(_scalar(_object(F.col("x"))[text_column]), F.lit("")))
        .otherwise(_printed(F.col("x"))).alias("text"))


def parse_text_records(lines: DataFrame, text_column: str = "text", malformed: str = "fail") -> DataFrame:
    """S1 (JSONL): ``(line_key, item, text)``.  An object line gives its
    ``text_column`` (missing -> ''); an array line gives one row per item
    (object -> its field, anything else as printed); blank lines are
    skipped."""
    return _records(_parsed(lines, malformed), text_column)


def first_n(records: DataFrame, n: int | None, order_cols=("line_key", "item")) -> DataFrame:
    """L1: the first ``n`` records in input order (``None``: all)."""
    if n is None:
        return records
    return records.orderBy(*order_cols).limit(int(n))


def read_json_records(spark: SparkSession, path: str, text_column: str = "text",
                      malformed: str = "fail") -> DataFrame:
    """S1 (JSON): files that each hold one array (of objects or scalars) or
    one object; ``(line_key, item, text)`` with the file as the line key."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("line_key"), "value")
    return _records(_parsed(files, malformed), text_column)


# S2 ------------------------------------------------------------------------

def parse_labelled(lines: DataFrame, text_column: str = "text", language_column: str = "language",
                   drop_empty: bool = True, malformed: str = "fail") -> DataFrame:
    """``(line_key, text, language)``; missing language -> 'unknown',
    missing text -> ''; empty texts dropped unless ``drop_empty`` is False."""
    m = _object(F.col("v"))
    out = _parsed(lines, malformed, objects=True).select(
        "line_key",
        F.coalesce(_scalar(m[text_column]), F.lit("")).alias("text"),
        F.coalesce(_scalar(m[language_column]), F.lit("unknown")).alias("language"))
    return out.filter(F.length("text") > 0) if drop_empty else out


# S3 ------------------------------------------------------------------------

def parse_plain(lines: DataFrame) -> DataFrame:
    """S3: one text per line, stripped; blank lines dropped."""
    return (lines.select("line_key", strip(F.col("value")).alias("text"))
            .filter(F.col("text") != ""))


# S4 / S5 -------------------------------------------------------------------

def _fields(value: Column) -> Column:
    # rstrip the line, then split on tabs
    return F.split(F.regexp_replace(value, r"\s+$", ""), "\t")


def parse_lookup(lines: DataFrame) -> DataFrame:
    """``id<TAB>text`` -> ``(id, text)``; lines with fewer than two
    fields are dropped; a repeated id keeps its last line."""
    p = lines.select("line_key", _fields(F.col("value")).alias("f")).filter(F.size("f") >= 2)
    return (p.select("line_key", F.col("f")[0].alias("id"), F.col("f")[1].alias("text"))
            .groupBy("id").agg(F.max_by("text", "line_key").alias("text")))


def parse_triples(lines: DataFrame) -> DataFrame:
    """Exactly three tab-separated fields ``(qid, pid, nid)``, else dropped."""
    p = lines.select(_fields(F.col("value")).alias("f")).filter(F.size("f") == 3)
    return p.select(F.col("f")[0].alias("qid"), F.col("f")[1].alias("pid"),
                    F.col("f")[2].alias("nid"))


# S6 ------------------------------------------------------------------------

def read_passages(spark: SparkSession, path_glob: str, num_partitions: int | None = None) -> DataFrame:
    """Sharded (gz) JSONL passages with a fixed schema.  A glob matching
    nothing gives an empty table.  Gzip is not splittable: one task per
    shard, so the rows are spread again when asked."""
    try:
        df = spark.read.schema(PASSAGE_SCHEMA).json(path_glob)
    except Exception as e:  # path does not exist
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], PASSAGE_SCHEMA)
    return df.repartition(num_partitions) if num_partitions else df


# ``by`` names further columns of the lines (a dataset) that ids
# are told apart by ----------------------------------------------------------------

def parse_queries(lines: DataFrame, malformed: str = "fail", by: Sequence[str] = ()) -> DataFrame:
    """``{_id, text}`` or ``{qid: text}`` or ``{qid: {text}}`` ->
    ``(qid, text)``; a repeated id keeps its last line."""
    m = _parsed(lines, malformed, objects=True, by=by).select(*by, "line_key", _object(F.col("v")).alias("m"))
    is_flat = F.col("m")["_id"].isNotNull() & F.col("m")["text"].isNotNull()
    flat = m.filter(is_flat).select(*by, "line_key", _scalar(F.col("m")["_id"]).alias("qid"),
                                    _scalar(F.col("m")["text"]).alias("text"))
    raw = F.col("raw")
    other = (m.filter(~is_flat).select(*by, "line_key", F.explode("m").alias("qid", "raw"))
             .select(*by, "line_key", "qid", F.when(_kind(raw) == "OBJECT", _scalar(_object(raw)["text"]))
                     .when(_kind(raw) == "STRING", _scalar(raw)).alias("text"))
             .filter(F.col("text").isNotNull()))
    return (flat.unionByName(other).groupBy(*by, "qid")
            .agg(F.max_by("text", "line_key").alias("text")))


def parse_corpus(lines: DataFrame, malformed: str = "fail", by: Sequence[str] = ()) -> DataFrame:
    """``{_id, title, text}`` or ``{doc_id: {title, text}}`` (several ids
    per line allowed) -> ``(doc_id, title, body, text)`` with text =
    P5(title, body); a repeated id keeps its last line, values that are no
    objects are skipped."""
    m = _parsed(lines, malformed, objects=True, by=by).select(*by, "line_key", _object(F.col("v")).alias("m"))

    def parts(d: Column):
        return [F.coalesce(_scalar(d["title"]), F.lit("")).alias("title"),
                F.coalesce(_scalar(d["text"]), F.lit("")).alias("body")]
    flat = m.filter(F.col("m")["_id"].isNotNull()).select(
        *by, "line_key", _scalar(F.col("m")["_id"]).alias("doc_id"), *parts(F.col("m")))
    nested = (m.filter(F.col("m")["_id"].isNull())
              .select(*by, "line_key", F.explode("m").alias("doc_id", "raw"))
              .select(*by, "line_key", "doc_id", _object(F.col("raw")).alias("d")).filter(F.col("d").isNotNull())
              .select(*by, "line_key", "doc_id", *parts(F.col("d"))))
    return (flat.unionByName(nested).groupBy(*by, "doc_id")
            .agg(F.max_by(F.struct("title", "body"), "line_key").alias("d"))
            .select(*by, "doc_id", "d.title", "d.body", doc_text(F.col("d.title"), F.col("d.body")).alias("text")))


def parse_qrels(lines: DataFrame, malformed: str = "fail", by: Sequence[str] = ()) -> DataFrame:
    """Flat ``{query-id, corpus-id, score}`` or nested
    ``{qid: {doc_id: rel}}`` -> ``(qid, doc_id, rel INT)``; entries merge per
    qid and a repeated (qid, doc_id) keeps its last line."""
    m = _parsed(lines, malformed, objects=True, by=by).select(*by, "line_key", _object(F.col("v")).alias("m"))
    is_flat = F.col("m")["query-id"].isNotNull() & F.col("m")["corpus-id"].isNotNull()
    whole = lambda v: _scalar(v).cast("double").cast("int")
    flat = m.filter(is_flat).select(
        *by, "line_key", _scalar(F.col("m")["query-id"]).alias("qid"), _scalar(F.col("m")["corpus-id"]).alias("doc_id"),
        whole(F.col("m")["score"]).alias("rel"))
    nested = (m.filter(~is_flat)
              .select(*by, "line_key", F.explode("m").alias("qid", "raw"))
              .select(*by, "line_key", "qid", F.explode(_object(F.col("raw"))).alias("doc_id", "s"))
              .select(*by, "line_key", "qid", "doc_id", whole(F.col("s")).alias("rel")))
    return (flat.unionByName(nested).groupBy(*by, "qid", "doc_id")
            .agg(F.max_by("rel", "line_key").alias("rel")))


# S10 -----------------------------------------------------------------------

def read_embeddings(spark: SparkSession, path: str, id_col: str = "id",
                    vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """An embeddings Parquet table keyed by an explicit id; with
    ``dim`` the vector size is checked (fails on any other size)."""
    from glossa.operators.sae import assert_dimension
    df = spark.read.parquet(path)
    if dim is not None:
        assert_dimension(df, dim, vec_col)
    return df
