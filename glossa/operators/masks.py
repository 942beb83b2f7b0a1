"""Language analysis: firing rates, per-language masks, combined masks.

All inputs are small tables derived from the firing counts
``(language, feature, n)`` (at most languages x dictionary rows) and the
per-language totals; thresholds are attached with ``explode`` of a literal
array so that one pass serves every threshold (J9, A6).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def language_totals(df: DataFrame, language_col: str = "language") -> DataFrame:
    """A1: ``(language, total)`` rows per language."""
    return (df.groupBy(F.col(language_col).alias("language"))
            .agg(F.count(F.lit(1)).alias("total")))


def firing_rates(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """A4: ``(language, feature, n, total, rate_pct)`` with
    ``rate_pct = n / total * 100``.  Both inputs are small (languages x dict)."""
    return (counts.join(totals, "language")
            .withColumn("rate_pct", F.col("n") / F.col("total") * F.lit(100.0)))


def _with_thresholds(rates: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    ts = [float(t) for t in thresholds]
    if not ts:
        raise ValueError("at least one threshold is required")
    return rates.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in ts])))


def _passes(threshold_col="threshold"):
    # Fixed rule: the rate in percent is compared with threshold * 100 as a
    # double, with ">=" (a rate exactly at the threshold is masked).
    return (F.col("n") / F.col("total") * F.lit(100.0)
            >= F.col(threshold_col).cast("double") * F.lit(100.0))


def language_masks(rates: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    """``(threshold, language, feature)`` for every feature whose
    firing rate in the language reaches the threshold; many thresholds in
    one pass."""
    return (_with_thresholds(rates, thresholds).filter(_passes())
            .select("threshold", "language", "feature"))


def combined_index(masks: DataFrame) -> DataFrame:
    """Features masked in at least one language, per threshold,
    with the number of languages that mask them."""
    return (masks.groupBy("threshold", "feature")
            .agg(F.count_distinct("language").alias("n_languages")))


def exclusive_mask(masks: DataFrame) -> DataFrame:
    """Features masked in exactly one language (the default combined
    mask), with that language."""
    return (masks.groupBy("threshold", "feature")
            .agg(F.count_distinct("language").alias("n_languages"),
                 F.min("language").alias("language"))
            .filter(F.col("n_languages") == 1)
            .select("threshold", "feature", "language"))


def union_mask(masks: DataFrame) -> DataFrame:
    """Features masked in any language."""
    return masks.select("threshold", "feature").distinct()


def overlap_features(masks: DataFrame) -> DataFrame:
    """Features masked by more than one language."""
    return (combined_index(masks).filter(F.col("n_languages") > 1))


def _thresholds(df: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")


def mask_summary(masks: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    """Per threshold: union size, exclusive count and overlapping count; a
    threshold that no feature reaches has zeros."""
    idx = combined_index(masks)
    found = idx.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("num_features"),
        F.count_if(F.col("n_languages") == 1).alias("unique_count"),
        F.count_if(F.col("n_languages") > 1).alias("overlapping_count"))
    return _thresholds(masks, thresholds).join(found, "threshold", "left").fillna(0)


def unknown_languages(known: DataFrame, languages: Iterable[str]) -> DataFrame:
    """Requested languages that are not in ``known`` (must be empty)."""
    spark = known.sparkSession
    req = spark.createDataFrame([(str(x),) for x in languages], "language string")
    have = known.select("language").distinct()
    return req.join(have, "language", "left_anti")


def mask_for_languages(masks: DataFrame, languages: Iterable[str],
                       check: bool = True, known: DataFrame | None = None) -> DataFrame:
    """A10: OR of the masks of the requested languages; an unknown language is
    an error (J7).  ``known`` (a table with ``language``, such as the totals)
    names all analysed languages: one of them without a feature at any
    threshold has an empty mask.  Default: the languages in ``masks``."""
    langs = [str(x) for x in languages]
    if check:
        missing = [r["language"] for r in unknown_languages(masks if known is None else known, langs).collect()]
        if missing:
            raise ValueError(f"no mask for languages: {sorted(missing)}")
    return (masks.filter(F.col("language").isin(langs))
            .select("threshold", "feature").distinct())


def mask_coverage(mask: DataFrame, dict_size: int, thresholds: Iterable[float]) -> DataFrame:
    """Masked features and their share of the dictionary, per threshold
    (zero where nothing is masked)."""
    found = mask.groupBy("threshold").agg(F.count_distinct("feature").alias("n_masked"))
    return (_thresholds(mask, thresholds).join(found, "threshold", "left").fillna(0)
            .withColumn("coverage_pct", F.col("n_masked") / F.lit(float(dict_size)) * 100.0))


def feature_report(counts: DataFrame, totals: DataFrame, threshold: float) -> DataFrame:
    """A5 + W3: per language ``total_samples``, ``unique_features`` (fired at
    least once), ``features_above_threshold`` and ``threshold_percentage``;
    joined to the ranked features above the threshold (rank by count desc,
    then feature id).  A language without any feature above the threshold,
    or without any firing feature, has one row with a null rank."""
    rates = _with_thresholds(firing_rates(counts, totals), [threshold])
    w = Window.partitionBy("language").orderBy(F.col("n").desc(), F.col("feature"))
    ranked = rates.withColumn("above", _passes())
    fired = ranked.groupBy("language").agg(
        F.count(F.lit(1)).alias("unique_features"),
        F.count_if("above").alias("features_above_threshold"))
    per_lang = (totals.withColumnRenamed("total", "total_samples").join(fired, "language", "left")
                .fillna(0, ["unique_features", "features_above_threshold"]))
    top = (ranked.filter("above").withColumn("rank", F.row_number().over(w))
           .select("language", "rank", "feature", "n", "rate_pct"))
    return (per_lang.join(top, "language", "left")
            .withColumn("threshold_percentage", F.lit(float(threshold)) * F.lit(100.0)))


def language_analysis(counts: DataFrame, totals: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    """One row per (threshold, language of ``totals``): features at or
    above the threshold, those masked in this language only, and the
    language's rows; zeros where no feature reaches the threshold."""
    m = language_masks(firing_rates(counts, totals), thresholds)
    found = (m.join(combined_index(m), ["threshold", "feature"]).groupBy("threshold", "language").agg(
        F.count(F.lit(1)).alias("features_above_threshold"),
        F.count_if(F.col("n_languages") == 1).alias("exclusive_features")))
    every = _with_thresholds(totals, thresholds).withColumnRenamed("total", "total_samples")
    return (every.join(found, ["threshold", "language"], "left")
            .fillna(0, ["features_above_threshold", "exclusive_features"])
            .select("threshold", "language", "features_above_threshold", "exclusive_features",
                    F.col("total_samples").cast("long").alias("total_samples")))
