"""Sinks written and read back (K1-K5, S6): each query writes derived rows
in the sink's format under the shared folder and returns what a reader
finds there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossa.plans.fixtures import ATOM_LIMIT, f4_atoms, f5_vectors
from glossa.plans.registry import query
from glossa.session import ensure_checkpoint_dir
from glossa.sources import readers, sinks
from glossa.sources.tables import table


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"


# Passages written as gzipped JSON lines, read by the shard reader.
@query("read_passages", """
SELECT CAST(page_id AS VARCHAR) AS docid, md5(url) AS title_md5, md5(html) AS text_md5 FROM pages""")
def read_passages(spark, sf_dir):
    path = _folder(spark, "passages")
    (table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("docid"), F.col("url").alias("title"),
                                          F.col("html").alias("text"))
     .write.option("compression", "gzip").json(path))
    p = readers.read_passages(spark, f"{path}/*.json.gz")
    return p.select("docid", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"))


# K1: one JSON object per line, unescaped.
@query("write_jsonl", "SELECT doc_id, lang AS language, md5(text) AS text_md5 FROM documents")
def write_jsonl(spark, sf_dir):
    path = _folder(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language")),
                      path, ["doc_id"])
    back = spark.read.schema("doc_id long, text string, language string").json(path)
    return back.select("doc_id", "language", F.md5("text").alias("text_md5"))


# K2: nested statistics per language as JSON documents.
@query("write_statistics", """
SELECT lang AS language, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang""")
def write_statistics(spark, sf_dir):
    path = _folder(spark, "statistics")
    stats = (table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language"))
             .agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")).alias("size")))
    sinks.write_statistics(stats, path)
    back = spark.read.schema("language string, size struct<n: long, n_chars: long>").json(path)
    return back.select("language", "size.n", "size.n_chars")


# K3: vectors by id, partitioned by language; written twice, the second write
# replaces the first as a whole.
@query("write_embeddings", """
SELECT vec_id, CAST(label AS VARCHAR) AS language, CAST(i - 1 AS BIGINT) AS dim, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""")
def write_embeddings(spark, sf_dir):
    path = _folder(spark, "embeddings")
    v = f5_vectors(spark, sf_dir)
    sinks.write_embeddings(v.withColumn("language", F.concat(F.lit("old"), "language")), path, ["language"])
    sinks.write_embeddings(v, path, ["language"])
    back = spark.read.schema(v.schema).parquet(path)
    return back.select("vec_id", "language", F.posexplode("embedding").alias("dim", "x")).select(
        "vec_id", "language", F.col("dim").cast("long").alias("dim"), (F.round(F.col("x").cast("double"), 6) + 0.0).alias("value"))


# K4: results of two runs; the second run adds only what the first lacks.
@query("write_results", """
SELECT lang AS dataset, CASE WHEN lang IN ('en', 'fr') THEN 'first' ELSE 'second' END AS run, CAST(count(*) AS BIGINT) AS n
FROM documents GROUP BY lang""")
def write_results(spark, sf_dir):
    path = _folder(spark, "results")
    n = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_results(spark, n.filter(F.col("dataset").isin("en", "fr")).withColumn("run", F.lit("first")), path, ["dataset"])
    sinks.write_results(spark, n.withColumn("run", F.lit("second")), path, ["dataset"])
    return spark.read.parquet(path).select("dataset", "run", "n")


# K5: the dictionary and its metadata.
@query("write_model", f"""
SELECT CAST(vec_id AS INTEGER) AS feature, CAST(64 AS BIGINT) AS input_dim,
       (SELECT count(*) FROM embeddings WHERE vec_id < {ATOM_LIMIT}) AS dict_size,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) + 0.0 AS enc_norm2
FROM embeddings WHERE vec_id < {ATOM_LIMIT}""")
def write_model(spark, sf_dir):
    path = _folder(spark, "model")
    atoms = f4_atoms(spark, sf_dir)
    n = atoms.count()
    sinks.write_model(spark, atoms, {"input_dim": 64, "dict_size": n, "expansion_factor": n / 64, "sparsity": 16}, path)
    back, meta = sinks.read_model(spark, path)
    norm = F.aggregate("enc", F.lit(0.0), lambda a, x: a + x * x)
    return back.select("feature", F.lit(meta["input_dim"]).cast("long").alias("input_dim"),
                       F.lit(meta["dict_size"]).cast("long").alias("dict_size"), (F.round(norm, 6) + 0.0).alias("enc_norm2"))
