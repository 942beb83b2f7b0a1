from pyspark.sql import functions as F

from glossa.operators import pooling
from glossa.plans.q_embed import f8
from paths import SF_SMALL


def _long_form(tokens):
    """The same pooling by built-in expressions, a row per dimension."""
    x = tokens.select("doc", F.col("mask").cast("double").alias("m"), F.posexplode("hidden").alias("dim", "h"))
    return x.groupBy("doc", "dim").agg((F.sum(F.col("h").cast("double") * F.col("m"))
                                        / F.greatest(F.sum("m"), F.lit(pooling.POOL_EPS))).alias("value"))


def test_vector_and_long_forms_agree_and_zero_mask(spark):
    tok = f8(spark, SF_SMALL)
    # one synthetic document whose every token is masked out
    extra = tok.limit(3).withColumn("doc", F.lit(-1).cast("long")).withColumn("mask", F.lit(0))
    tok = tok.unionByName(extra).repartition(3)
    vec = pooling.mean_pool(tok, "doc", "mask", "hidden")
    a = vec.select("doc", F.posexplode("embedding").alias("dim", "value")) \
        .select("doc", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value"))
    b = _long_form(tok) \
        .select("doc", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value"))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    zero = vec.filter(F.col("doc") == -1).first()["embedding"]
    assert all(v == 0.0 for v in zero)


def test_documents_across_batches_and_null_keys(spark):
    rows = [(d, 1, [float(d or 0), float(i)]) for i in range(400) for d in (1, 2, None)] + [(3, 1, None), (3, 1, [1.0])]
    tok = spark.createDataFrame(rows, "doc long, mask int, hidden array<double>").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["doc"]: r["embedding"] for r in pooling.mean_pool(tok).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: [1.0, 199.5], 2: [2.0, 199.5], None: [0.0, 199.5], 3: [0.0, 0.0]}
    assert "Generate" not in pooling.mean_pool(tok)._jdf.queryExecution().executedPlan().toString()
