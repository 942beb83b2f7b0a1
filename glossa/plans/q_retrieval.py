"""Retrieval queries over F6: every vector is a query and every vector a
document (so self matches exist), judgments: rel 2 for a
same-label document with an even id, 1 for another same-label document,
the self pair unjudged.  P9, J4-J6, L4, L7, A28, D8, D9, K4, J8."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.numeric import r6
from glossa.operators import ranking, retrieval, sae
from glossa.plans.fixtures import F4_SQL, F5_SQL, f4_model, with_ctes
from glossa.plans.q_sae import EXCL_SQL, exclusive_features
from glossa.plans.registry import query
from glossa.sources.tables import table

TOP_K = 10
RUN_K = 1000          # the SAE evaluation path keeps 1000 per query


def f6(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    queries = emb.select(
        F.col("vec_id").alias("qid"), "label", "embedding")
    docs = emb.select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    return queries, docs


def f6_labels(docs):
    """``labels`` of all rows of a document id."""
    return docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct("label")).alias("labels"))


def f6_judged(run, queries, docs):
    """F6 judgments are a rule, so they are evaluated on the retrieved rows
    only (no table of all same-label pairs): rel = 2 for a same-label
    document with an even id, 1 for another same-label document, 0 else;
    the self pair is not judged.  The ideal lists come from counts of
    (label, parity) minus the query itself."""
    if "labels" not in run.columns:     # else they came along with the documents
        run = run.join(f6_labels(docs), "doc_id")
    q = queries.select("qid", F.col("label").alias("q_label"))
    same = (F.col("d.label") == F.col("q_label")) & (F.col("doc_id") != F.col("qid"))
    judged = (run.withColumn("d", F.explode("labels")).drop("labels").join(q, "qid")
              .withColumn("rel", F.when(same, F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1))
                          .otherwise(0)))
    par = docs.groupBy(F.col("label").alias("q_label"),
                       (F.col("doc_id") % 2 == 0).alias("even")).agg(F.count(F.lit(1)).alias("cnt"))
    grades = (q.join(par, "q_label")
              .select("qid", F.when(F.col("even"), 2).otherwise(1).alias("rel"),
                      (F.col("cnt") - F.when((F.col("qid") % 2 == 0) == F.col("even"), 1)
                       .otherwise(0)).alias("n")))
    return judged, grades


F6_SQL = """
q AS (SELECT vec_id AS qid, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
qrels AS (SELECT q.qid, d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 2 ELSE 1 END AS rel
          FROM q JOIN d USING (label) WHERE d.doc_id <> q.qid),
qn AS (SELECT qid, list_transform(v, lambda e: e / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM q),
dn AS (SELECT doc_id, list_transform(v, lambda e: e / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM d),
scored AS (SELECT qn.qid, dn.doc_id, list_inner_product(qn.v, dn.v) AS score FROM qn, dn),
ranked AS (SELECT qid, doc_id, score,
                  row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS rnk
           FROM scored)"""


@query("cosine_topk", with_ctes(F6_SQL, body="""
SELECT qid, CAST(rnk AS BIGINT) AS rank, doc_id, round(score, 6) + 0.0 AS score
FROM ranked WHERE rnk <= 10"""))
def cosine_topk(spark, sf_dir):
    q, d = f6(spark, sf_dir)
    run = retrieval.score_topk(q, d, TOP_K)
    return run.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id",
                      r6(F.col("score")).alias("score"))


@query("self_excluded", with_ctes(F6_SQL, body="""
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rnk) AS BIGINT) AS rank, doc_id
FROM ranked WHERE rnk <= 10 AND doc_id <> qid"""))
def self_excluded(spark, sf_dir):
    q, d = f6(spark, sf_dir)
    run = retrieval.exclude_self(retrieval.score_topk(q, d, TOP_K))
    return run.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id")


METRIC_SQL = """
run AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rnk) AS rank
        FROM ranked WHERE rnk <= 1000 AND doc_id <> qid),
judged AS (SELECT r.qid, r.doc_id, r.rank, coalesce(j.rel, 0) AS rel FROM run r
           LEFT JOIN qrels j USING (qid, doc_id)),
judged2 AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits
            FROM judged),
ks AS (SELECT unnest([1, 3, 5, 10, 20, 100, 1000]) AS k),
perq AS (SELECT j.qid, ks.k,
                sum(CASE WHEN j.rank <= ks.k THEN j.rel / log2(j.rank + 1.0) ELSE 0.0 END) AS dcg,
                sum(CASE WHEN j.rank <= ks.k AND j.rel > 0 THEN 1 ELSE 0 END) AS hit,
                sum(CASE WHEN j.rank <= ks.k AND j.rel > 0 THEN j.hits / j.rank ELSE 0.0 END) AS ap
         FROM judged2 j, ks GROUP BY j.qid, ks.k),
ideal0 AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS irank
           FROM qrels WHERE rel > 0),
ideal AS (SELECT i.qid, ks.k, count(*) AS n_rel_all,
                 sum(CASE WHEN i.irank <= ks.k THEN i.rel / log2(i.irank + 1.0) ELSE 0.0 END) AS idcg
          FROM ideal0 i, ks GROUP BY i.qid, ks.k),
metrics AS (SELECT p.qid, p.k, p.dcg / i.idcg AS ndcg, p.ap / i.n_rel_all AS map,
                   p.hit / i.n_rel_all AS recall, p.hit / p.k AS prec
            FROM perq p JOIN ideal i USING (qid, k))"""


@query("retrieval_metrics", with_ctes(F6_SQL, METRIC_SQL, body="""
SELECT metric, CAST(k AS INTEGER) AS k, round(value, 6) + 0.0 AS value FROM (
  SELECT 'NDCG' AS metric, k, avg(ndcg) AS value FROM metrics GROUP BY k
  UNION ALL SELECT 'MAP', k, avg(map) FROM metrics GROUP BY k
  UNION ALL SELECT 'Recall', k, avg(recall) FROM metrics GROUP BY k
  UNION ALL SELECT 'P', k, avg(prec) FROM metrics GROUP BY k)"""))
def retrieval_metrics(spark, sf_dir):
    q, d = f6(spark, sf_dir)
    labelled = d.join(f6_labels(d), "doc_id", "left")
    run = retrieval.exclude_self(retrieval.score_topk(q, labelled, RUN_K, carry=["labels"]).drop("score"))
    judged, grades = f6_judged(run, q, d)
    ks = retrieval.K_VALUES
    m = retrieval.metrics_from_judged(judged, retrieval.ideal_from_grades(grades, ["qid"], ks), ks)
    return m.select("metric", F.col("k").cast("int").alias("k"), r6(F.col("value")).alias("value"))


# Canonical order of query and document ids (position in id order),
# numbered with the range-partitioned row number (no single-task window).
@query("canonical_ids", """
SELECT 'query' AS kind, vec_id AS id,
       CAST(row_number() OVER (ORDER BY vec_id) AS BIGINT) AS position
FROM embeddings
UNION ALL
SELECT 'doc', vec_id, CAST(row_number() OVER (ORDER BY vec_id) AS BIGINT) FROM embeddings""")
def canonical_ids(spark, sf_dir):
    q, d = f6(spark, sf_dir)
    both = (q.select(F.lit("query").alias("kind"), F.col("qid").alias("id"))
            .unionByName(d.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"))))
    return ranking.row_number_scalable(both, ["kind"], ["id"], out_col="position")


# Retrieval over language-agnostic vectors: D5 reconstruction with the
# exclusive 55 % mask, then P9 + J4 + L4 (top 10) + J5.
RETRIEVE_SQL = """
rv AS (SELECT vec_id, list(r ORDER BY dim) AS v FROM (
         SELECT x.vec_id, g.dim, coalesce(m.r, 0.0) AS r
         FROM x CROSS JOIN (SELECT DISTINCT dim FROM atom_dims) g
         LEFT JOIN recon_m m ON m.vec_id = x.vec_id AND m.dim = g.dim) GROUP BY vec_id),
rn AS (SELECT vec_id, list_transform(v, lambda e: e / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM rv),
sc AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, list_inner_product(a.v, b.v) AS score
       FROM rn a, rn b),
rk AS (SELECT qid, doc_id, score,
              row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS rnk FROM sc)"""


@query("retrieve", with_ctes(F4_SQL, F5_SQL, EXCL_SQL, RETRIEVE_SQL, body="""
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rnk) AS BIGINT) AS rank, doc_id
FROM rk WHERE rnk <= 10 AND doc_id <> qid"""))
def retrieve(spark, sf_dir):
    model = f4_model(spark, sf_dir)
    mask = exclusive_features(spark, sf_dir, model)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    agn = sae.reconstruct_masked(emb, model, mask_features=mask)
    vecs = agn.select("vec_id", F.col(sae.RECON_MASKED).alias("embedding"))
    q = vecs.withColumnRenamed("vec_id", "qid")
    d = vecs.withColumnRenamed("vec_id", "doc_id")
    run = retrieval.exclude_self(retrieval.score_topk(q, d, TOP_K))
    return run.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id")


# K4 + J8: results keyed by (dataset, threshold); a dataset is a label
# group of queries.  Existing results are the even labels at 0.55; only
# the rest is computed.
@query("results_pending", """
WITH req AS (SELECT DISTINCT 'label_' || CAST(label AS VARCHAR) AS dataset, t.threshold
             FROM embeddings, (SELECT unnest([0.55, 0.60, 0.65]::DOUBLE[]) AS threshold) t),
     have AS (SELECT DISTINCT 'label_' || CAST(label AS VARCHAR) AS dataset, 0.55::DOUBLE AS threshold
              FROM embeddings WHERE label % 2 = 0)
SELECT dataset, threshold FROM req
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.dataset = req.dataset
                  AND h.threshold = req.threshold)""")
def results_pending(spark, sf_dir):
    q, _ = f6(spark, sf_dir)
    ds = q.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("dataset"),
                  "label").distinct()
    req = ds.select("dataset", F.explode(F.array(*[F.lit(t) for t in (0.55, 0.60, 0.65)]))
                    .alias("threshold"))
    have = ds.filter(F.col("label") % 2 == 0).select("dataset", F.lit(0.55).alias("threshold"))
    return retrieval.pending(req, have, ["dataset", "threshold"])


# D9 end to end from lines: two datasets of queries, corpus and judgments
# with string ids such as "q1" and "12#3".  "turns": flat lines, a user turn
# asks for the assistant's answer (grade 2) and its next answer (grade 1).
# "items": nested lines, benchmark texts ask for themselves.
EVAL_MODEL = "intfloat/multilingual-e5-large"
EVAL_SQL = r"""
eq AS (SELECT 'turns' AS ds, 'q' || (conv_id * 100 + turn) AS id, 'query: ' || text AS t FROM conversations WHERE role = 'user'
       UNION ALL SELECT 'items', 'q' || item_id, 'query: ' || text FROM benchmark),
ed AS (SELECT 'turns' AS ds, conv_id || '#' || turn AS id, 'passage: ' || text AS t FROM conversations WHERE role = 'assistant'
       UNION ALL SELECT 'items', item_id || '#0', 'passage: ' || text FROM benchmark),
qrels AS (SELECT 'turns' AS ds, 'q' || (u.conv_id * 100 + u.turn) AS qid, a.conv_id || '#' || a.turn AS doc_id,
                 CASE WHEN a.turn = u.turn + 1 THEN 2 ELSE 1 END AS rel
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn IN (u.turn + 1, u.turn + 3)
          WHERE u.role = 'user' AND a.role = 'assistant'
          UNION ALL SELECT 'items', 'q' || item_id, item_id || '#0', 1 FROM benchmark),
et AS (SELECT 'q' AS side, * FROM eq UNION ALL SELECT 'd', * FROM ed),
tk AS (SELECT side, ds, id, unnest(regexp_split_to_array(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+')) AS tok FROM et),
bk AS (SELECT side, ds, id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS dim, CAST(count(*) AS DOUBLE) AS c
       FROM tk GROUP BY ALL),
f AS (SELECT side, ds, id, dim, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY side, ds, id)) AS FLOAT) AS DOUBLE) AS v FROM bk),
n AS (SELECT side, ds, id, dim, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY side, ds, id)), 1e-12) AS v FROM f),
score AS (SELECT q.ds, q.id AS qid, d.id AS doc_id, sum(q.v * d.v) AS score
          FROM n q JOIN n d ON q.side = 'q' AND d.side = 'd' AND d.ds = q.ds AND d.dim = q.dim GROUP BY ALL),
run AS (SELECT q.ds, q.id AS qid, d.id AS doc_id, row_number() OVER (
            PARTITION BY q.ds, q.id ORDER BY round(coalesce(s.score, 0), 12) DESC, d.id) AS rank
        FROM eq q JOIN ed d ON d.ds = q.ds LEFT JOIN score s ON s.ds = q.ds AND s.qid = q.id AND s.doc_id = d.id
        QUALIFY rank <= 20),
judged AS (SELECT r.ds, r.qid, r.rank, coalesce(j.rel, 0) AS rel FROM run r LEFT JOIN qrels j USING (ds, qid, doc_id)),
judged2 AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (
                PARTITION BY ds, qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM judged),
ks AS (SELECT unnest([1, 5, 20]) AS k),
perq AS (SELECT j.ds, j.qid, ks.k, sum(CASE WHEN j.rank <= ks.k THEN j.rel / log2(j.rank + 1.0) ELSE 0.0 END) AS dcg,
                sum(CASE WHEN j.rank <= ks.k AND j.rel > 0 THEN 1 ELSE 0 END) AS hit,
                sum(CASE WHEN j.rank <= ks.k AND j.rel > 0 THEN j.hits / j.rank ELSE 0.0 END) AS ap
         FROM judged2 j, ks GROUP BY ALL),
ideal0 AS (SELECT ds, qid, rel, row_number() OVER (PARTITION BY ds, qid ORDER BY rel DESC, doc_id) AS irank FROM qrels),
ideal AS (SELECT i.ds, i.qid, ks.k, count(*) AS n_rel, sum(CASE WHEN i.irank <= ks.k THEN i.rel / log2(i.irank + 1.0) ELSE 0.0 END) AS idcg
          FROM ideal0 i, ks GROUP BY ALL),
m AS (SELECT p.ds, p.k, p.dcg / i.idcg AS ndcg, p.ap / i.n_rel AS map, p.hit / i.n_rel AS recall, p.hit / p.k AS prec
      FROM perq p JOIN ideal i USING (ds, qid, k))"""


def _eval_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    qid, did = F.concat(F.lit("q"), key.cast("string")), F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    users, answers = c.filter(F.col("role") == "user"), c.filter(F.col("role") == "assistant")
    pairs = users.select("conv_id", F.col("turn").alias("asked"), qid.alias("qid")).join(
        answers.select("conv_id", "turn", did.alias("doc_id")), "conv_id").filter(
        (F.col("turn") == F.col("asked") + 1) | (F.col("turn") == F.col("asked") + 3))
    line = lambda df, k, *cols: df.select(k.alias("line_key"), F.to_json(F.struct(*cols)).alias("value"))
    turns = (line(users, key, qid.alias("_id"), "text"),
             line(answers, key, did.alias("_id"), F.lit("").alias("title"), "text"),
             line(pairs, F.col("turn"), F.col("qid").alias("query-id"), F.col("doc_id").alias("corpus-id"),
                  F.when(F.col("turn") == F.col("asked") + 1, 2).otherwise(1).alias("score")))
    b = table(spark, sf_dir, "benchmark")
    bq, bd = F.concat(F.lit("q"), F.col("item_id").cast("string")), F.concat(F.col("item_id").cast("string"), F.lit("#0"))
    nested = lambda *cols: b.select(F.col("item_id").alias("line_key"), F.to_json(F.create_map(*cols)).alias("value"))
    items = (nested(bq, F.col("text")), nested(bd, F.struct(F.lit("").alias("title"), "text")),
             nested(bq, F.create_map(bd, F.lit(1))))
    return {"turns": turns, "items": items}


@query("evaluate_datasets", with_ctes(EVAL_SQL, body="""
SELECT ds AS dataset, metric, CAST(k AS INTEGER) AS k, round(value, 6) + 0.0 AS value FROM (
  SELECT ds, 'NDCG' AS metric, k, avg(ndcg) AS value FROM m GROUP BY ds, k
  UNION ALL SELECT ds, 'MAP', k, avg(map) FROM m GROUP BY ds, k
  UNION ALL SELECT ds, 'Recall', k, avg(recall) FROM m GROUP BY ds, k
  UNION ALL SELECT ds, 'P', k, avg(prec) FROM m GROUP BY ds, k)"""))
def evaluate_datasets(spark, sf_dir):
    from glossa.operators.encoder import HashedBagOfWords
    out = retrieval.evaluate_datasets(spark, _eval_lines(spark, sf_dir), HashedBagOfWords(64), EVAL_MODEL, [1, 5, 20])
    return out.select("dataset", "metric", F.col("k").cast("int").alias("k"), r6(F.col("value")).alias("value"))
