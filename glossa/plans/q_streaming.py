"""Streaming queries over F10 (the embeddings table rewritten as four
Parquet files in the session's shared checkpoint folder, consumed with
``trigger(availableNow=True)``); their rows must equal the batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossa.functions.numeric import r6
from glossa.operators import encoder, sae
from glossa.plans.fixtures import F4_SQL, F5_SQL, f4_model, f5_vectors, with_ctes
from glossa.plans.q_sae import EXCL_SQL, exclusive_features
from glossa.plans.q_embed import DIM, _tvec_sql
from glossa.plans.registry import query
from glossa.session import ensure_checkpoint_dir
from glossa.sources.tables import table
from glossa.streaming import jobs


def _stage(spark, sf_dir, name):
    """Write F10: the vectors as four files under a fresh folder."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    vecs = f5_vectors(spark, sf_dir)
    vecs.repartitionByRange(4, "vec_id").write.parquet(f"{base}/in")
    return base, vecs.schema


@query("stream_features", with_ctes(F4_SQL, F5_SQL, EXCL_SQL, body="""
SELECT vec_id, CAST(rnk AS BIGINT) AS rank, feature, round(value, 6) + 0.0 AS value FROM topk_m"""))
def stream_features(spark, sf_dir):
    model = f4_model(spark, sf_dir)
    mask = exclusive_features(spark, sf_dir, model)
    base, schema = _stage(spark, sf_dir, "stream-features")
    q = jobs.stream_agnostic(spark, f"{base}/in", schema, model, mask, f"{base}/out",
                             f"{base}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("vec_id", F.explode(F.arrays_zip(sae.FEAT_RANK, sae.FEAT_IDX, sae.FEAT_VAL)).alias("f")).select(
        "vec_id", F.col(f"f.{sae.FEAT_RANK}").cast("long").alias("rank"),
        F.col(f"f.{sae.FEAT_IDX}").alias("feature"), r6(F.col(f"f.{sae.FEAT_VAL}")).alias("value"))


@query("stream_firing", with_ctes(F4_SQL, F5_SQL, body="""
SELECT language, feature, CAST(n AS BIGINT) AS n FROM fired"""))
def stream_firing(spark, sf_dir):
    model = f4_model(spark, sf_dir)
    base, schema = _stage(spark, sf_dir, "stream-firing")
    q = jobs.stream_firing_counts(spark, f"{base}/in", schema, model, f"{base}/out",
                                  f"{base}/ckpt", max_files=2)
    q.awaitTermination()
    return jobs.latest_firing_counts(spark, f"{base}/out").select(
        "language", "feature", F.col("n").cast("long").alias("n"))


# Texts arrive as files in two rounds; the second run of the stream only
# embeds what the checkpoint has not seen.
@query("stream_embed", with_ctes(_tvec_sql("ev", "ed"), body="""
SELECT e.id AS doc_id, CAST(e.dim AS BIGINT) AS dim, round(e.v, 6) + 0.0 AS value FROM ev_f e
""").replace("WITH ", "WITH ed AS (SELECT doc_id AS id, text AS t FROM documents), ", 1))
def stream_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-embed-{uuid.uuid4().hex}"
    for part in (0, 1):
        docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).write.mode("append").parquet(f"{base}/in")
        jobs.stream_embed(spark, f"{base}/in", docs.schema, encoder.HashedBagOfWords(DIM), f"{base}/out",
                          f"{base}/ckpt").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("doc_id", F.posexplode("embedding").alias("dim", "x")).filter("x <> 0").select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value"))
