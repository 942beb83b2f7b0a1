"""Streams (R1-R3) give the batch results; a restarted stream resumes."""

import os
import tempfile

from pyspark.sql import functions as F

from glossa.operators import encoder, sae
from glossa.plans.fixtures import f4_model, f5_vectors
from glossa.streaming import jobs
from paths import SF_SMALL


def test_stream_embed_only_new_files(spark):
    base = tempfile.mkdtemp(prefix="glossa-stream-")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs.filter(F.col("doc_id") < 100).write.parquet(f"{base}/in/part1")
    schema = docs.schema
    q = jobs.stream_embed(spark, f"{base}/in/*", schema, encoder.HashedBagOfWords(16),
                          f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == 100
    docs.filter(F.col("doc_id") >= 100).write.parquet(f"{base}/in/part2")
    q = jobs.stream_embed(spark, f"{base}/in/*", schema, encoder.HashedBagOfWords(16),
                          f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == docs.count()
    assert out.select("doc_id").distinct().count() == docs.count()
    assert out.select(F.size("embedding")).distinct().collect()[0][0] == 16


def test_stream_reconstruction_equals_batch(spark):
    model = f4_model(spark, SF_SMALL)
    vecs = f5_vectors(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="glossa-stream-")
    vecs.repartition(3).write.parquet(f"{base}/in")
    q = jobs.stream_agnostic(spark, f"{base}/in", vecs.schema, model, [1, 2, 3],
                             f"{base}/out", f"{base}/ckpt", decode=True, max_files=1)
    q.awaitTermination()
    # BLAS sums in an order that depends on the batch shape: compare at 1e-9
    r9 = F.transform(sae.RECON, lambda v: F.round(v, 9) + F.lit(0.0)).alias("r")
    streamed = spark.read.parquet(f"{base}/out").select("vec_id", r9)
    batch = sae.decode(sae.encode_topk(vecs, model, mask_features=[1, 2, 3]), model) \
        .select("vec_id", r9)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_counts_by_committed_versions(spark):
    import uuid
    model = f4_model(spark, SF_SMALL)
    vecs = f5_vectors(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="glossa-stream-")
    out, ckpt = f"{base}/out", f"{base}/ckpt"
    run = lambda c=ckpt: jobs.stream_firing_counts(
        spark, f"{base}/in", vecs.schema, model, out, c, max_files=1).awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("language", "feature", "n").collect()))
    vecs.filter("vec_id < 300").repartition(3).write.parquet(f"{base}/in")
    run()
    log = jobs.VersionLog(spark, out)
    assert log.versions() == [2, 3]                     # three micro-batches, the oldest version went
    assert len(os.listdir(f"{out}/data")) == 2
    assert rows(jobs.latest_firing_counts(spark, out)) == rows(sae.firing_counts(vecs.filter("vec_id < 300"), model))
    # files of a version that never was committed are not read
    spark.createDataFrame([("xx", 1, 99)], "language string, feature int, n long") \
        .write.parquet(f"{out}/data/{uuid.uuid4().hex}")
    assert rows(jobs.latest_firing_counts(spark, out)) == rows(sae.firing_counts(vecs.filter("vec_id < 300"), model))
    # a restart reads new files only and adds to the newest version
    vecs.filter("vec_id >= 300").coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    assert rows(jobs.latest_firing_counts(spark, out)) == rows(sae.firing_counts(vecs, model))
    # a micro-batch that is run again after its commit adds nothing
    entry = log.newest()
    commits = f"{ckpt}/commits/{entry['epoch']}"
    for f in (commits, f"{ckpt}/commits/.{entry['epoch']}.crc"):
        if os.path.exists(f):
            os.remove(f)
    run()
    assert log.newest() == entry
    assert rows(jobs.latest_firing_counts(spark, out)) == rows(sae.firing_counts(vecs, model))
    # another stream over the same files starts from zero
    run(f"{base}/ckpt2")
    assert rows(jobs.latest_firing_counts(spark, out)) == rows(sae.firing_counts(vecs, model))
