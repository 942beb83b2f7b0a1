"""Embedding queries: A16 over F8 (conversation turns as token states),
U1/U2 + D11 and J8/R3 over F1 documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.numeric import r6
from glossa.operators import encoder, pooling, sae
from glossa.plans.fixtures import F4_SQL, F5_SQL, f4_model, with_ctes
from glossa.plans.q_sae import exclusive_features
from glossa.plans.registry import query
from glossa.sources.tables import table

DIM = 64


def f8(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t = c.withColumn("vec_id", (F.col("conv_id") * 8 + F.col("turn")) % 500)
    return t.join(e, "vec_id").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("pos"),
        F.when(F.col("role") == "system", 0).otherwise(1).alias("mask"),
        F.col("embedding").alias("hidden"))


@query("mean_pool", """
SELECT doc, CAST(dim AS BIGINT) AS dim,
       round(sum(h * m) / greatest(sum(m), 1e-9), 6) + 0.0 AS value
FROM (SELECT c.conv_id AS doc, CASE WHEN c.role = 'system' THEN 0.0 ELSE 1.0 END AS m,
             CAST(unnest(e.embedding) AS DOUBLE) AS h, generate_subscripts(e.embedding, 1) - 1 AS dim
      FROM conversations c JOIN embeddings e ON e.vec_id = (c.conv_id * 8 + c.turn) % 500)
GROUP BY doc, dim""")
def mean_pool(spark, sf_dir):
    pooled = pooling.mean_pool(f8(spark, sf_dir), "doc", "mask", "hidden")
    return pooled.select("doc", F.posexplode("embedding").alias("dim", "value")).select(
        "doc", F.col("dim").cast("long").alias("dim"), r6(F.col("value")).alias("value"))


def _tvec_sql(name: str, src: str) -> str:
    """SQL twin of the default encoder followed by the in-task L2
    normalisation of the retrieval kernel: (id, dim, value)."""
    return rf"""
{name}_tok AS (SELECT id, unnest(regexp_split_to_array(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+')) AS tok
               FROM {src} WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''),
{name}_bk AS (SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS dim,
                     CAST(count(*) AS DOUBLE) AS c FROM {name}_tok GROUP BY id, dim),
{name}_f AS (SELECT b.id, b.dim, CAST(CAST(b.c / sqrt(sum(b.c * b.c) OVER (PARTITION BY b.id)) AS FLOAT) AS DOUBLE) AS v
             FROM {name}_bk b),
{name} AS (SELECT id, dim, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12) AS v FROM {name}_f)"""


# J8 + R3: documents with doc_id % 3 = 0 already have vectors; only the
# others are embedded.
@query("embed_pending", with_ctes(_tvec_sql("pv", "pd"), body="""
SELECT id AS doc_id, CAST(dim AS BIGINT) AS dim, round(v, 6) + 0.0 AS value FROM pv_f""")
    .replace("WITH ", "WITH pd AS (SELECT doc_id AS id, text AS t FROM documents WHERE doc_id % 3 <> 0), ", 1))
def embed_pending(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    done = d.filter(F.col("doc_id") % 3 == 0).select("doc_id")
    out = encoder.embed_pending(d, done, encoder.HashedBagOfWords(DIM))
    return out.select("doc_id", F.posexplode("embedding").alias("dim", "x")).filter("x <> 0").select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value"))


TEXT_SQL = r"""
dtok AS (SELECT doc_id, unnest(regexp_split_to_array(
                  regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS tok
         FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
bk AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS dim,
              CAST(count(*) AS DOUBLE) AS c FROM dtok GROUP BY doc_id, dim),
nrm AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM bk GROUP BY doc_id),
tv AS (SELECT bk.doc_id, bk.dim, CAST(CAST(bk.c / nrm.n AS FLOAT) AS DOUBLE) AS v
       FROM bk JOIN nrm USING (doc_id)),
traw AS (SELECT tv.doc_id, d.feature, greatest(sum(tv.v * d.w), 0.0) AS value
         FROM tv JOIN atom_dims d USING (dim) GROUP BY tv.doc_id, d.feature),
tsel AS (SELECT doc_id, feature, value FROM (
           SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(value, 12) DESC, feature) AS rnk
           FROM traw) WHERE rnk <= 16 AND value > 0),
texcl AS (SELECT feature FROM masks WHERE threshold = 0.55
          GROUP BY feature HAVING count(DISTINCT language) = 1)"""


# Text -> default encoder (64 md5 buckets) -> dictionary F4 -> top-16
# -> exclusive 55 % mask removed.
@query("text_to_agnostic", with_ctes(F4_SQL, F5_SQL, TEXT_SQL, body="""
SELECT d.doc_id, CAST(count(s.feature) AS BIGINT) AS n_features,
       round(coalesce(sum(s.value), 0.0), 6) + 0.0 AS total
FROM documents d LEFT JOIN (SELECT * FROM tsel WHERE feature NOT IN (SELECT feature FROM texcl)) s
  USING (doc_id)
GROUP BY d.doc_id"""))
def text_to_agnostic(spark, sf_dir):
    model = f4_model(spark, sf_dir)
    mask = exclusive_features(spark, sf_dir, model)
    d = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    vecs = encoder.encode_texts(d, encoder.HashedBagOfWords(DIM), keep=("doc_id",))
    feats = sae.encode_topk(vecs, model, mask_features=mask)
    return feats.select("doc_id", F.size(sae.FEAT_IDX).cast("long").alias("n_features"),
                        r6(F.aggregate(sae.FEAT_VAL, F.lit(0.0), lambda a, x: a + x)).alias("total"))


RETRIEVE_TEXT_SQL = """
qt AS (SELECT conv_id * 100 + turn AS id, 'query: ' || text AS t FROM conversations WHERE role = 'user'),
dt AS (SELECT conv_id * 100 + turn AS id, 'passage: ' || text AS t FROM conversations WHERE role = 'assistant'),""" \
    + _tvec_sql("qv", "qt") + "," + _tvec_sql("dv", "dt") + """,
pairs AS (SELECT q.id AS qid, d.id AS doc_id, sum(q.v * d.v) AS score
          FROM qv q JOIN dv d USING (dim) GROUP BY q.id, d.id),
allp AS (SELECT q.id AS qid, d.id AS doc_id, coalesce(p.score, 0.0) AS score
         FROM (SELECT DISTINCT id FROM qt) q CROSS JOIN (SELECT DISTINCT id FROM dt) d
         LEFT JOIN pairs p ON p.qid = q.id AND p.doc_id = d.id),
rk AS (SELECT qid, doc_id, score,
              row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS rnk FROM allp)"""

MODEL = "intfloat/multilingual-e5-large"


# D8 on texts: P3/P4 prefixes for an e5 model -> default encoder (U1) ->
# cosine top 10 (P9, J4, L4) -> self matches removed (J5).  Queries are
# user turns, documents assistant turns.
@query("retrieve_text", with_ctes(RETRIEVE_TEXT_SQL, body="""
SELECT qid, CAST(rnk AS BIGINT) AS rank, doc_id, round(score, 6) + 0.0 AS score
FROM rk WHERE rnk <= 10"""))
def retrieve_text(spark, sf_dir):
    from glossa.functions import text as tx
    from glossa.operators import retrieval
    c = table(spark, sf_dir, "conversations")
    tid = (F.col("conv_id") * 100 + F.col("turn")).alias("id")
    q = c.filter(F.col("role") == "user").select(
        tid, tx.with_query_prefix("text", F.lit(MODEL)).alias("text"))
    d = c.filter(F.col("role") == "assistant").select(
        tid, tx.with_passage_prefix(F.lit(""), "text", F.lit(MODEL)).alias("text"))
    enc = encoder.HashedBagOfWords(DIM)
    qv = encoder.encode_texts(q, enc, keep=("id",)).withColumnRenamed("id", "qid")
    dv = encoder.encode_texts(d, enc, keep=("id",)).withColumnRenamed("id", "doc_id")
    run = retrieval.exclude_self(retrieval.score_topk(qv, dv, 10))
    return run.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id",
                      r6(F.col("score")).alias("score"))
