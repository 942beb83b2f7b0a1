import pytest
from pyspark.sql import functions as F

from glossa.operators import masks
from glossa.plans.q_analysis import _counts
from paths import SF_MID


def test_mask_properties(spark):
    model, counts, totals = _counts(spark, SF_MID)
    rates = masks.firing_rates(counts, totals)
    m = masks.language_masks(rates, [0.55, 0.6])
    excl = masks.exclusive_mask(m).select("threshold", "feature")
    union = masks.union_mask(m)
    assert excl.exceptAll(union).count() == 0
    low = m.filter(F.col("threshold") == 0.55).select("language", "feature")
    high = m.filter(F.col("threshold") == 0.6).select("language", "feature")
    assert high.exceptAll(low).count() == 0
    with pytest.raises(ValueError):
        masks.mask_for_languages(m, ["0", "nope"])
    # one language only: every masked feature is exclusive
    one = m.filter(F.col("language") == "0")
    assert masks.exclusive_mask(one).count() == masks.union_mask(one).count()


def test_language_without_masked_feature_has_an_empty_mask(spark):
    """A language whose features stay below every threshold, or never fire,
    adds nothing; one that was not analysed is still an error."""
    counts = spark.createDataFrame([("a", 1, 9), ("a", 2, 1), ("b", 1, 1)], "language string, feature int, n long")
    totals = spark.createDataFrame([("a", 10), ("b", 10), ("quiet", 10)], "language string, total long")
    m = masks.language_masks(masks.firing_rates(counts, totals), [0.5, 0.95])
    got = masks.mask_for_languages(m, ["a", "b", "quiet"], known=totals)
    assert [tuple(r) for r in got.collect()] == [(0.5, 1)]
    assert masks.mask_for_languages(m, ["b", "quiet"], known=totals).count() == 0
    with pytest.raises(ValueError):
        masks.mask_for_languages(m, ["a", "nope"], known=totals)
