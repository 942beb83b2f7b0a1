"""SAE queries over F4 (dictionary = first 256 vectors, k = 16):
D1-D6, W1, W2, P10, A17-A23, S10."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.numeric import r6
from glossa.operators import masks, sae
from glossa.plans.fixtures import (
    AUX_COEFF, AUX_TARGET, F4_SQL, F5_SQL, MASK_THRESHOLD, SPARSITY, f4_model, f5_vectors, with_ctes,
)
from glossa.plans.registry import query
from glossa.sources.tables import table

# SQL pieces shared by the reconstruction queries.
RECON_SQL = """
xd AS (SELECT vec_id, unnest(v) AS xv, generate_subscripts(v, 1) - 1 AS dim FROM x),
recon AS (SELECT t.vec_id, d.dim, sum(t.value * d.w) AS r
          FROM topk t JOIN atom_dims d USING (feature) GROUP BY t.vec_id, d.dim),
res AS (SELECT xd.vec_id, xd.dim, xd.xv, coalesce(recon.r, 0.0) AS r
        FROM xd LEFT JOIN recon USING (vec_id, dim))"""

EXCL_SQL = """
excl AS (SELECT feature FROM masks WHERE threshold = 0.55
         GROUP BY feature HAVING count(DISTINCT language) = 1),
topk_m AS (SELECT * FROM topk WHERE feature NOT IN (SELECT feature FROM excl)),
recon_m AS (SELECT t.vec_id, d.dim, sum(t.value * d.w) AS r
            FROM topk_m t JOIN atom_dims d USING (feature) GROUP BY t.vec_id, d.dim)"""


def _encoded(spark, sf_dir, mask=None):
    model = f4_model(spark, sf_dir)
    vecs = f5_vectors(spark, sf_dir).select("vec_id", "embedding")
    return model, sae.encode_topk(vecs, model, mask_features=mask)


def _explode_feats(df):
    return df.select("vec_id", F.posexplode(F.arrays_zip(sae.FEAT_IDX, sae.FEAT_VAL))
                     .alias("pos", "f")).select(
        "vec_id", (F.col("pos") + 1).cast("long").alias("rank"),
        F.col(f"f.{sae.FEAT_IDX}").alias("feature"),
        r6(F.col(f"f.{sae.FEAT_VAL}")).alias("value"))


def _explode_vec(df, col, alias):
    return df.select("vec_id", F.posexplode(col).alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), r6(F.col("v")).alias(alias))


def exclusive_features(spark, sf_dir, model=None):
    """The default combined mask at 55 % as a feature list (bounded by the
    dictionary size)."""
    vecs = f5_vectors(spark, sf_dir)
    model = model or f4_model(spark, sf_dir)
    counts = sae.firing_counts(vecs, model, language_col="language")
    m = masks.language_masks(
        masks.firing_rates(counts, masks.language_totals(vecs, "language")), [MASK_THRESHOLD])
    return [r["feature"] for r in masks.exclusive_mask(m).select("feature").collect()]


@query("sae_topk", with_ctes(F4_SQL, F5_SQL, body="""
SELECT vec_id, CAST(rnk AS BIGINT) AS rank, feature, round(value, 6) + 0.0 AS value FROM topk"""))
def sae_topk(spark, sf_dir):
    _, enc = _encoded(spark, sf_dir)
    return _explode_feats(enc)


@query("sae_threshold", with_ctes(F4_SQL, F5_SQL, body="""
SELECT vec_id, round(kth_value, 6) + 0.0 AS kth_value,
       CAST((SELECT count(*) FROM topk t WHERE t.vec_id = kth.vec_id) AS BIGINT) AS n_active
FROM kth"""))
def sae_threshold(spark, sf_dir):
    _, enc = _encoded(spark, sf_dir)
    return enc.select("vec_id", r6(F.col(sae.KTH)).alias("kth_value"),
                      F.size(sae.FEAT_IDX).cast("long").alias("n_active"))


@query("sae_decode", with_ctes(F4_SQL, F5_SQL, RECON_SQL, body="""
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(r, 6) + 0.0 AS recon FROM res"""))
def sae_decode(spark, sf_dir):
    model, enc = _encoded(spark, sf_dir)
    return _explode_vec(sae.decode(enc, model), sae.RECON, "recon")


@query("agnostic_features", with_ctes(F4_SQL, F5_SQL, EXCL_SQL, body="""
SELECT vec_id, CAST(rnk AS BIGINT) AS rank, feature, round(value, 6) + 0.0 AS value
FROM topk_m"""))
def agnostic_features(spark, sf_dir):
    model = f4_model(spark, sf_dir)
    mask = exclusive_features(spark, sf_dir, model)
    vecs = f5_vectors(spark, sf_dir).select("vec_id", "embedding")
    # rank stays the rank before masking (the cut happens first)
    enc = sae.encode_topk(vecs, model, mask_features=mask, ranks=True)
    return enc.select("vec_id", F.explode(F.arrays_zip(sae.FEAT_RANK, sae.FEAT_IDX, sae.FEAT_VAL)).alias("f")).select(
        "vec_id", F.col(f"f.{sae.FEAT_RANK}").cast("long").alias("rank"),
        F.col(f"f.{sae.FEAT_IDX}").alias("feature"), r6(F.col(f"f.{sae.FEAT_VAL}")).alias("value"))


@query("agnostic_recon", with_ctes(F4_SQL, F5_SQL, RECON_SQL, EXCL_SQL, body="""
SELECT res.vec_id, CAST(res.dim AS BIGINT) AS dim, round(res.r, 6) + 0.0 AS recon,
       round(coalesce(recon_m.r, 0.0), 6) + 0.0 AS recon_agnostic
FROM res LEFT JOIN recon_m USING (vec_id, dim)"""))
def agnostic_recon(spark, sf_dir):
    model = f4_model(spark, sf_dir)
    mask = exclusive_features(spark, sf_dir, model)
    vecs = f5_vectors(spark, sf_dir).select("vec_id", "embedding")
    both = sae.reconstruct(vecs, model, mask_features=mask)
    return both.select("vec_id", F.posexplode(
        F.arrays_zip(F.col(sae.RECON).alias("a"), F.col(sae.RECON_MASKED).alias("b")))
        .alias("dim", "p")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"),
        r6(F.col("p.a")).alias("recon"), r6(F.col("p.b")).alias("recon_agnostic"))


METRICS_SQL = RECON_SQL + """,
stats AS (SELECT avg((r - xv) * (r - xv)) AS mse_loss FROM res),
dimmean AS (SELECT dim, avg(xv) AS mu FROM xd GROUP BY dim),
var AS (SELECT avg((xd.xv - dm.mu) * (xd.xv - dm.mu)) AS v FROM xd JOIN dimmean dm USING (dim)),
nrows AS (SELECT count(*) AS n FROM x),
usage AS (SELECT raw.feature,
                 avg(CASE WHEN (raw.value - k.kth_value) * 10000.0 >= 0
                          THEN 1.0 / (1.0 + exp(-(raw.value - k.kth_value) * 10000.0))
                          ELSE exp((raw.value - k.kth_value) * 10000.0)
                               / (1.0 + exp((raw.value - k.kth_value) * 10000.0)) END) AS u
          FROM raw JOIN kth k USING (vec_id) GROUP BY raw.feature),
aux AS (SELECT avg(greatest(0.02 - u, 0.0) * greatest(0.02 - u, 0.0)) * 1.0 AS aux_loss FROM usage),
l1 AS (SELECT sum(value) / ((SELECT n FROM nrows) * 256.0) AS l1_mean FROM topk),
l0 AS (SELECT count(*) / (SELECT n FROM nrows) AS l0,
              1.0 - count(DISTINCT feature) / 256.0 AS dead_features FROM topk)"""


@query("sae_mse_fvu", with_ctes(F4_SQL, F5_SQL, METRICS_SQL, body="""
SELECT round(mse_loss, 6) + 0.0 AS mse_loss,
       round(1.0 - ((v - mse_loss) / (v + 1e-8)), 6) + 0.0 AS fvu
FROM stats, var"""))
def sae_mse_fvu(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select(r6(F.col("mse_loss")).alias("mse_loss"), r6(F.col("fvu")).alias("fvu"))


@query("sae_l0_dead", with_ctes(F4_SQL, F5_SQL, METRICS_SQL, body="""
SELECT round(l0, 6) + 0.0 AS l0, round(dead_features, 6) + 0.0 AS dead_features FROM l0"""))
def sae_l0_dead(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select(r6(F.col("l0")).alias("l0"), r6(F.col("dead_features")).alias("dead_features"))


@query("sae_l1_aux", with_ctes(F4_SQL, F5_SQL, METRICS_SQL, body="""
SELECT round(l1_mean, 6) + 0.0 AS l1_mean, round(aux_loss, 8) + 0.0 AS aux_loss FROM l1, aux"""))
def sae_l1_aux(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select(r6(F.col("l1_mean")).alias("l1_mean"),
                    (F.round(F.col("aux_loss"), 8) + F.lit(0.0)).alias("aux_loss"))


@query("sae_report", with_ctes(F4_SQL, F5_SQL, METRICS_SQL, body="""
SELECT CAST((SELECT n FROM nrows) AS BIGINT) AS n_rows,
       round(mse_loss, 6) + 0.0 AS mse_loss,
       round(1.0 - ((v - mse_loss) / (v + 1e-8)), 6) + 0.0 AS fvu,
       round(l0, 6) + 0.0 AS l0, round(dead_features, 6) + 0.0 AS dead_features,
       round(aux_loss, 8) + 0.0 AS aux_loss,
       round(mse_loss + aux_loss, 6) + 0.0 AS loss
FROM stats, var, l0, aux"""))
def sae_report(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select(F.col("n_rows").cast("long").alias("n_rows"),
                    *[r6(F.col(c)).alias(c) for c in ("mse_loss", "fvu", "l0", "dead_features")],
                    (F.round(F.col("aux_loss"), 8) + F.lit(0.0)).alias("aux_loss"),
                    r6(F.col("loss")).alias("loss"))


def _metrics(spark, sf_dir, group_col=None):
    model = f4_model(spark, sf_dir)
    vecs = f5_vectors(spark, sf_dir)
    if group_col == "batch":
        vecs = vecs.withColumn("batch", (F.col("vec_id") / 100).cast("long"))
    return sae.evaluate(vecs, model, group_col=group_col,
                        aux_coeff=AUX_COEFF, aux_target=AUX_TARGET)


# Validation metrics computed per batch of 100 ids (vec_id / 100),
# weighted by batch size.
BATCH_SQL = """
bres AS (SELECT vec_id // 100 AS batch, dim, xv, r FROM res),
bmean AS (SELECT batch, dim, avg(xv) AS mu FROM bres GROUP BY batch, dim),
bstat AS (SELECT b.batch, count(*) / 64 AS n, avg((b.r - b.xv) * (b.r - b.xv)) AS mse,
                 avg((b.xv - m.mu) * (b.xv - m.mu)) AS v
          FROM bres b JOIN bmean m USING (batch, dim) GROUP BY b.batch),
bdead AS (SELECT x.vec_id // 100 AS batch,
                 1.0 - count(DISTINCT t.feature) / 256.0 AS dead,
                 count(t.feature) / count(DISTINCT x.vec_id) AS l0
          FROM x LEFT JOIN topk t USING (vec_id) GROUP BY 1),
per AS (SELECT s.batch, s.n, s.mse, 1.0 - ((s.v - s.mse) / (s.v + 1e-8)) AS fvu, d.dead, d.l0
        FROM bstat s JOIN bdead d USING (batch))"""


@query("sae_batch_weighted", with_ctes(F4_SQL, F5_SQL, RECON_SQL, BATCH_SQL, body="""
SELECT CAST(sum(n) AS BIGINT) AS n_rows,
       round(sum(mse * n) / sum(n), 6) + 0.0 AS mse_loss,
       round(sum(fvu * n) / sum(n), 6) + 0.0 AS fvu,
       round(sum(dead * n) / sum(n), 6) + 0.0 AS dead_features,
       round(sum(l0 * n) / sum(n), 6) + 0.0 AS l0
FROM per"""))
def sae_batch_weighted(spark, sf_dir):
    per = _metrics(spark, sf_dir, group_col="batch")
    w = sae.batch_weighted(per, metrics=("mse_loss", "fvu", "dead_features", "l0"))
    return w.select(F.col("n_rows").cast("long").alias("n_rows"),
                    *[r6(F.col(c)).alias(c) for c in ("mse_loss", "fvu", "dead_features", "l0")])


@query("embedding_check", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(min(len(embedding)) AS BIGINT) AS min_dim,
       CAST(max(len(embedding)) AS BIGINT) AS max_dim,
       CAST(count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS BIGINT) AS n_bad
FROM embeddings""")
def embedding_check(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return sae.dimension_check(emb, 64).select(
        *[F.col(c).cast("long").alias(c) for c in ("n_rows", "min_dim", "max_dim", "n_bad")])


# Fit a 128-atom dictionary (k = 16) to the vectors for a few Adam steps
# from hash-made weights; one row per step with the loss before its update.
FIT_ATOMS, FIT_STEPS, FIT_LR = 128, 6, 1e-2


def _fit_sql(atoms: int, k: int, steps: int, lr: float, dim: int = 64) -> str:
    """The same optimisation in long form, one step per turn of the
    recursion: activations, cut, residuals, usage, gradients of both weights
    and the Adam update; the losses before an update travel with its rows."""
    return with_ctes(f"""
x AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS xv, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
nn AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM embeddings),
w AS MATERIALIZED (SELECT f.feature, j.dim, (('0x' || substr(md5('42:' || f.feature || ':' || j.dim), 1, 8))::BIGINT / 4294967296.0 * 2 - 1)
      * (1.0 / sqrt({dim}::DOUBLE)) AS e
      FROM (SELECT unnest(range({atoms})) AS feature) f, (SELECT unnest(range({dim})) AS dim) j),
st AS (
SELECT 1 AS step, feature, dim, e, e AS d, 0.0::DOUBLE AS me, 0.0::DOUBLE AS ve, 0.0::DOUBLE AS md, 0.0::DOUBLE AS vd,
       0.0::DOUBLE AS mse, 0.0::DOUBLE AS aux FROM w
UNION ALL
SELECT * FROM (
WITH s AS MATERIALIZED (SELECT * FROM st WHERE step <= {steps}),
z AS MATERIALIZED (SELECT x.vec_id, s.feature, sum(x.xv * s.e) AS z FROM x JOIN s USING (dim) GROUP BY ALL),
r AS MATERIALIZED (SELECT vec_id, feature, z, greatest(z, 0.0) AS v, row_number() OVER (
       PARTITION BY vec_id ORDER BY round(greatest(z, 0.0), 12) DESC, feature) AS rnk FROM z),
kth AS MATERIALIZED (SELECT vec_id, v AS kth FROM r WHERE rnk = {k}),
f AS MATERIALIZED (SELECT vec_id, feature, v FROM r WHERE rnk <= {k} AND v > 0),
c AS MATERIALIZED (SELECT f.vec_id, s.dim, sum(f.v * s.d) AS r FROM f JOIN s USING (feature) GROUP BY ALL),
q AS MATERIALIZED (SELECT x.vec_id, x.dim, coalesce(c.r, 0.0) - x.xv AS res FROM x LEFT JOIN c USING (vec_id, dim)),
g AS MATERIALIZED (SELECT r.vec_id, r.feature, r.z, CASE WHEN (r.v - kth.kth) * 10000.0 >= 0
       THEN 1.0 / (1.0 + exp(-(r.v - kth.kth) * 10000.0))
       ELSE exp((r.v - kth.kth) * 10000.0) / (1.0 + exp((r.v - kth.kth) * 10000.0)) END AS sig FROM r JOIN kth USING (vec_id)),
u AS MATERIALIZED (SELECT feature, greatest({AUX_TARGET} - avg(sig), 0.0) AS deficit FROM g GROUP BY feature),
l AS MATERIALIZED (SELECT (SELECT avg(res * res) FROM q) AS mse, (SELECT {AUX_COEFF} * avg(deficit * deficit) FROM u) AS aux),
p AS MATERIALIZED (SELECT f.vec_id, f.feature, f.v, q.dim, q.res FROM f JOIN q USING (vec_id)),
gf AS MATERIALIZED (SELECT p.vec_id, p.feature, sum(p.res * s.d) * 2.0 / {dim} AS gz FROM p JOIN s USING (feature, dim) GROUP BY ALL),
gz AS MATERIALIZED (SELECT g.vec_id, g.feature, coalesce(gf.gz, 0.0)
       - 2.0 * {AUX_COEFF} / {atoms} * u.deficit * g.sig * (1.0 - g.sig) * 10000.0 AS gz
       FROM g JOIN u USING (feature) LEFT JOIN gf USING (vec_id, feature) WHERE g.z > 0),
ge AS MATERIALIZED (SELECT gz.feature, x.dim, sum(gz.gz * x.xv) / (SELECT n FROM nn) AS ge FROM gz JOIN x USING (vec_id)
       WHERE gz.gz <> 0 GROUP BY ALL),
gd AS MATERIALIZED (SELECT feature, dim, sum(v * res) * 2.0 / {dim} / (SELECT n FROM nn) AS gd FROM p GROUP BY ALL),
m AS MATERIALIZED (SELECT s.step, s.feature, s.dim, s.e, s.d,
       0.9 * s.me + 0.1 * coalesce(ge, 0.0) AS me, 0.999 * s.ve + 0.001 * coalesce(ge, 0.0) ** 2 AS ve,
       0.9 * s.md + 0.1 * coalesce(gd, 0.0) AS md, 0.999 * s.vd + 0.001 * coalesce(gd, 0.0) ** 2 AS vd
       FROM s LEFT JOIN ge USING (feature, dim) LEFT JOIN gd USING (feature, dim))
SELECT step + 1, feature, dim, e - {lr} * (me / (1 - 0.9 ** step)) / (sqrt(ve / (1 - 0.999 ** step)) + 1e-8),
       d - {lr} * (md / (1 - 0.9 ** step)) / (sqrt(vd / (1 - 0.999 ** step)) + 1e-8), me, ve, md, vd, l.mse, l.aux FROM m, l))""",
                     recursive=True, body="""
SELECT CAST(step - 1 AS BIGINT) AS step, (SELECT CAST(n AS BIGINT) FROM nn) AS n_rows, round(max(mse), 6) + 0.0 AS mse_loss,
       round(max(aux), 6) + 0.0 AS aux_loss, round(max(mse + aux), 6) + 0.0 AS loss
FROM st WHERE step > 1 GROUP BY step""")


@query("fit_sae_loss", _fit_sql(FIT_ATOMS, SPARSITY, FIT_STEPS, FIT_LR))
def fit_sae_loss(spark, sf_dir):
    from glossa.operators.training import fit_sae
    vecs = table(spark, sf_dir, "embeddings").select("embedding")
    res = fit_sae(vecs, dict_size=FIT_ATOMS, sparsity=SPARSITY, steps=FIT_STEPS, lr=FIT_LR, aux_coeff=AUX_COEFF,
                  aux_target=AUX_TARGET)
    return spark.createDataFrame(res.history).select(
        F.col("step").cast("long"), F.col("n_rows").cast("long"),
        *[r6(F.col(c)).alias(c) for c in ("mse_loss", "aux_loss", "loss")])
