"""Properties: results independent of partitioning; quota rule against a
search over all ways to take the rows."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glossa.operators import chunking, corpus, sae
from glossa.plans.fixtures import f4_model, f5_vectors
from paths import SF_SMALL


def test_firing_counts_do_not_depend_on_partitioning(spark):
    model = f4_model(spark, SF_SMALL)
    vecs = f5_vectors(spark, SF_SMALL)
    a = sae.firing_counts(vecs, model)
    b = sae.firing_counts(vecs.repartition(7), model)
    c = sae.firing_counts(vecs.coalesce(1), model)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(c).count() == 0
    assert a.count() == b.count() == c.count()


def test_chunks_do_not_depend_on_partitioning(spark):
    from glossa.plans.q_corpus import f1
    docs = f1(spark, SF_SMALL)
    cols = ["doc_id", "piece", "language", "source", "n_tokens", "n_fragments", "text"]
    a = chunking.smart_chunk(docs).select(*cols)
    b = chunking.smart_chunk(docs.repartition(5)).select(*cols)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def _best_quota(a, b, m):
    """Of all ways to take ``min(m, a + b)`` rows: the one nearest to half
    each, the odd row from the second source."""
    total = min(m, a + b)
    ways = [(x, total - x) for x in range(max(0, total - b), min(a, total) + 1)]
    return min(ways, key=lambda w: abs(w[0] - m // 2))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(0, 80)),
                min_size=1, max_size=30))
def test_two_source_quota(spark, cases):
    df = spark.createDataFrame(cases, "a long, b long, m long")
    ua, ub = corpus.two_source_quota(F.col("a"), F.col("b"), F.col("m"))
    got = [(r[0], r[1]) for r in df.select(ua, ub).collect()]
    assert got == [_best_quota(a, b, m) for a, b, m in cases]
