"""Language analysis queries (A1, A3-A11, T2, T3, J2, J3+P8, J7, J9, D10)
over F4 (dictionary) + F5 (language label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import masks, sae
from glossa.plans.fixtures import (
    F4_SQL, F5_SQL, MASK_THRESHOLD, THRESHOLDS, f4_model, f5_vectors, with_ctes,
)
from glossa.plans.registry import query
from glossa.sources.tables import table


def _counts(spark, sf_dir):
    vecs = f5_vectors(spark, sf_dir)
    model = f4_model(spark, sf_dir)
    counts = sae.firing_counts(vecs, model, language_col="language")
    totals = masks.language_totals(vecs, "language")
    return model, counts, totals


def _with_quiet(spark, sf_dir, totals):
    """The totals and a language in which no feature ever fires."""
    quiet = table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("total")).select(F.lit("quiet").alias("language"), "total")
    return totals.unionByName(quiet)


QUIET_SQL = """
totals_q AS (SELECT * FROM totals UNION ALL SELECT 'quiet', (SELECT count(*) FROM nation))"""


def _masks(spark, sf_dir, thresholds=THRESHOLDS):
    model, counts, totals = _counts(spark, sf_dir)
    return model, masks.language_masks(masks.firing_rates(counts, totals), thresholds)


@query("firing_counts", with_ctes(F4_SQL, F5_SQL, body="""
SELECT language, feature, CAST(n AS BIGINT) AS n FROM fired"""))
def firing_counts(spark, sf_dir):
    _, counts, _ = _counts(spark, sf_dir)
    return counts.select("language", "feature", F.col("n").cast("long").alias("n"))


@query("firing_rates", with_ctes(F4_SQL, F5_SQL, body="""
SELECT language, feature, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total,
       round(rate_pct, 6) AS rate_pct
FROM rates"""))
def firing_rates(spark, sf_dir):
    _, counts, totals = _counts(spark, sf_dir)
    r = masks.firing_rates(counts, totals)
    return r.select("language", "feature", F.col("n").cast("long").alias("n"),
                    F.col("total").cast("long").alias("total"),
                    F.round("rate_pct", 6).alias("rate_pct"))


@query("lang_counts_vectors", with_ctes(F4_SQL, F5_SQL, body="""
SELECT language, CAST(total AS BIGINT) AS total FROM totals"""))
def lang_counts_vectors(spark, sf_dir):
    return masks.language_totals(f5_vectors(spark, sf_dir), "language").select(
        "language", F.col("total").cast("long").alias("total"))


@query("lang_masks", with_ctes(F4_SQL, F5_SQL, body="""
SELECT language, feature FROM masks WHERE threshold = 0.55"""))
def lang_masks(spark, sf_dir):
    _, m = _masks(spark, sf_dir, [MASK_THRESHOLD])
    return m.select("language", "feature")


@query("mask_grid", with_ctes(F4_SQL, F5_SQL, body="""
SELECT threshold, language, CAST(count(*) AS BIGINT) AS n_features
FROM masks GROUP BY threshold, language"""))
def mask_grid(spark, sf_dir):
    _, m = _masks(spark, sf_dir)
    return m.groupBy("threshold", "language").agg(
        F.count(F.lit(1)).cast("long").alias("n_features"))


@query("mask_index", with_ctes(F4_SQL, F5_SQL, body="""
SELECT threshold, feature, CAST(count(DISTINCT language) AS BIGINT) AS n_languages
FROM masks GROUP BY threshold, feature"""))
def mask_index(spark, sf_dir):
    _, m = _masks(spark, sf_dir)
    return masks.combined_index(m).select(
        "threshold", "feature", F.col("n_languages").cast("long").alias("n_languages"))


@query("mask_exclusive", with_ctes(F4_SQL, F5_SQL, body="""
SELECT threshold, feature, min(language) AS language
FROM masks GROUP BY threshold, feature HAVING count(DISTINCT language) = 1"""))
def mask_exclusive(spark, sf_dir):
    _, m = _masks(spark, sf_dir)
    return masks.exclusive_mask(m)


@query("mask_union", with_ctes(F4_SQL, F5_SQL, body="""
SELECT DISTINCT threshold, feature FROM masks"""))
def mask_union(spark, sf_dir):
    _, m = _masks(spark, sf_dir)
    return masks.union_mask(m)


@query("mask_overlap", with_ctes(F4_SQL, F5_SQL, body="""
SELECT threshold, feature, CAST(count(DISTINCT language) AS BIGINT) AS n_languages
FROM masks GROUP BY threshold, feature HAVING count(DISTINCT language) > 1"""))
def mask_overlap(spark, sf_dir):
    _, m = _masks(spark, sf_dir)
    return masks.overlap_features(m).select(
        "threshold", "feature", F.col("n_languages").cast("long").alias("n_languages"))


@query("mask_summary", with_ctes(F4_SQL, F5_SQL, body="""
SELECT threshold, CAST(count(feature) AS BIGINT) AS num_features,
       CAST(count(*) FILTER (WHERE nl = 1) AS BIGINT) AS unique_count,
       CAST(count(*) FILTER (WHERE nl > 1) AS BIGINT) AS overlapping_count
FROM ths LEFT JOIN (SELECT threshold, feature, count(DISTINCT language) AS nl FROM masks
                    GROUP BY threshold, feature) USING (threshold) GROUP BY threshold"""))
def mask_summary(spark, sf_dir):
    _, m = _masks(spark, sf_dir)
    return masks.mask_summary(m, THRESHOLDS).select(
        "threshold", *[F.col(c).cast("long").alias(c)
                       for c in ("num_features", "unique_count", "overlapping_count")])


# J7 + A10: languages "0", "3" and "7" are requested; one whose features all
# stay below the thresholds has an empty mask, one without rows is an error.
@query("mask_selected", with_ctes(F4_SQL, F5_SQL, body="""
SELECT DISTINCT threshold, feature FROM masks WHERE language IN ('0', '3', '7')"""))
def mask_selected(spark, sf_dir):
    _, counts, totals = _counts(spark, sf_dir)
    m = masks.language_masks(masks.firing_rates(counts, totals), THRESHOLDS)
    return masks.mask_for_languages(m, ["0", "3", "7"], known=totals)


@query("mask_coverage", with_ctes(F4_SQL, F5_SQL, body="""
SELECT threshold, CAST(count(feature) AS BIGINT) AS n_masked,
       round(count(feature) / 256.0 * 100.0, 6) AS coverage_pct
FROM ths LEFT JOIN (SELECT threshold, feature FROM masks GROUP BY threshold, feature
                    HAVING count(DISTINCT language) = 1) USING (threshold) GROUP BY threshold"""))
def mask_coverage(spark, sf_dir):
    model, m = _masks(spark, sf_dir)
    cov = masks.mask_coverage(masks.exclusive_mask(m), model.dict_size, THRESHOLDS)
    return cov.select("threshold", F.col("n_masked").cast("long").alias("n_masked"),
                      F.round("coverage_pct", 6).alias("coverage_pct"))


@query("feature_report", with_ctes(F4_SQL, F5_SQL, QUIET_SQL, body="""
SELECT t.language, CAST(r.rnk AS BIGINT) AS rank, r.feature, CAST(r.n AS BIGINT) AS n,
       round(r.rate_pct, 6) AS rate_pct, CAST(t.total AS BIGINT) AS total_samples,
       CAST(coalesce(p.unique_features, 0) AS BIGINT) AS unique_features,
       CAST(coalesce(p.features_above_threshold, 0) AS BIGINT) AS features_above_threshold,
       round(0.55::DOUBLE * 100.0, 6) AS threshold_percentage
FROM totals_q t
LEFT JOIN (SELECT language, count(*) AS unique_features,
                  count(*) FILTER (WHERE n / total * 100.0 >= 0.55::DOUBLE * 100.0) AS features_above_threshold
           FROM rates GROUP BY language) p USING (language)
LEFT JOIN (SELECT language, feature, n, rate_pct,
                  row_number() OVER (PARTITION BY language ORDER BY n DESC, feature) AS rnk
           FROM rates WHERE n / total * 100.0 >= 0.55::DOUBLE * 100.0) r USING (language)"""))
def feature_report(spark, sf_dir):
    _, counts, totals = _counts(spark, sf_dir)
    rep = masks.feature_report(counts, _with_quiet(spark, sf_dir, totals), MASK_THRESHOLD)
    return rep.select(
        "language", F.col("rank").cast("long").alias("rank"), "feature",
        F.col("n").cast("long").alias("n"), F.round("rate_pct", 6).alias("rate_pct"),
        *[F.col(c).cast("long").alias(c) for c in
          ("total_samples", "unique_features", "features_above_threshold")],
        F.round("threshold_percentage", 6).alias("threshold_percentage"))


@query("raw_activations", with_ctes(F4_SQL, F5_SQL, body="""
SELECT vec_id, CAST(count(*) FILTER (WHERE abs(value) > 1e-6) AS BIGINT) AS n_fired,
       round(sum(value), 6) AS raw_sum, round(max(value), 6) AS raw_max
FROM raw GROUP BY vec_id"""))
def raw_activations(spark, sf_dir):
    vecs = f5_vectors(spark, sf_dir)
    st = sae.raw_activation_stats(vecs.select("vec_id", "embedding"), f4_model(spark, sf_dir))
    return st.select("vec_id", F.col("n_fired").cast("long").alias("n_fired"),
                     F.round("raw_sum", 6).alias("raw_sum"),
                     F.round("raw_max", 6).alias("raw_max"))


# The language label comes from a separate keyed table, never by position.
@query("label_join", """
WITH v AS (SELECT vec_id, embedding FROM embeddings),
     l AS (SELECT vec_id, CAST(label AS VARCHAR) AS language FROM embeddings)
SELECT l.language, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(len(v.embedding)) AS BIGINT) AS n_values
FROM v JOIN l USING (vec_id) GROUP BY l.language""")
def label_join(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    v = emb.select("vec_id", "embedding")
    lab = emb.select("vec_id", F.col("label").cast("string").alias("language"))
    return (v.join(lab, "vec_id").groupBy("language")
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                 F.sum(F.size("embedding")).cast("long").alias("n_values")))


# The whole analysis; one row per (threshold, language) with the report
# numbers and the sizes of the combined masks, zeros where nothing fires.
@query("language_analysis", with_ctes(F4_SQL, F5_SQL, QUIET_SQL, body="""
SELECT th.threshold, t.language, CAST(count(m.feature) AS BIGINT) AS features_above_threshold,
       CAST(count(*) FILTER (WHERE c.nl = 1) AS BIGINT) AS exclusive_features,
       CAST(max(t.total) AS BIGINT) AS total_samples
FROM ths th CROSS JOIN totals_q t
LEFT JOIN masks m ON m.threshold = th.threshold AND m.language = t.language
LEFT JOIN (SELECT threshold, feature, count(DISTINCT language) AS nl FROM masks
           GROUP BY threshold, feature) c ON c.threshold = m.threshold AND c.feature = m.feature
GROUP BY th.threshold, t.language"""))
def language_analysis(spark, sf_dir):
    _, counts, totals = _counts(spark, sf_dir)
    return masks.language_analysis(counts, _with_quiet(spark, sf_dir, totals), THRESHOLDS)
