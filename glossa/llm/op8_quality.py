"""Operator 8: quality rules with risk-controlled thresholds (DataFrame
functions only).

Every rule rejects a document whose ratio lies above a cutoff.  Per stratum
(language) and rule the cutoff is certified on labelled documents that the
base rules pass:

* the cutoffs of a rule are a fixed list, tested from lenient to strict, and
  the test stops at the first that fails (fixed-sequence testing needs no
  correction inside the list);
* a cutoff passes if, were the false rejection rate ``risk / rules`` or
  more, so few rejected good documents had probability at most
  ``doubt / (rules x strata)`` (exact binomial tail, Bonferroni over rules
  and strata).  So with probability ``1 - doubt`` no stratum loses more than
  ``risk`` of its good documents to the rules;
* of the certified cutoffs the one is taken that rejects most bad documents
  net of ``GOOD_WEIGHT`` times the share of good ones, the most lenient on
  ties; a rule without a certified, useful cutoff rejects nothing there.

Strata without enough labels therefore keep their documents.

The counts per (stratum, rule, step) are bounded by strata x rules x list
length; texts never leave the scan and the shuffles carry a few numbers per
document.

Defined cases: null or empty text has zero counts and fails the base rules;
null stratum is a stratum; labels that are null, or of absent documents, are
ignored, and of several labels of one id the lowest counts; repeated rows
are judged each, but as labelled trials the rows of one id count once, and
so do ids of one text; without labels only the base rules reject; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.sqltext import GAP, text_or_empty, word_array
from glossa.llm.stages import staged

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
RISK = 0.05           # of good documents lost to all rules of a stratum
DOUBT = 0.05          # that any stratum loses more
GOOD_WEIGHT = 10.0

#: rule -> (numerator, denominator, cutoffs from lenient to strict)
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05)),
    "marks": ("n_marks", "n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "capitals": ("n_capitals", "word_chars", (0.8, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1)),
    "lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "repeats": ("n_repeat_words", "n_words", (0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05)),
}


def _matches(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in a one-character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _pairs(a: Column, n: Column) -> Column:
    """Neighbours of an array as structs ``(x, y)``."""
    return F.arrays_zip(F.slice(a, F.lit(1), n - 1).alias("x"), F.slice(a, F.lit(2), n - 1).alias("y"))


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use (prefix-free names win
    over clashing input columns, so select what you need first)."""
    d = docs.withColumn("_t", text_or_empty(F.col(text_col)))
    d = d.withColumn("_words", word_array(F.col("_t")))
    d = d.withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("_h").cast("long"))
    count = (F.col("n_words") - (WINDOW - 1)).cast("int")
    windows = F.transform(F.arrays_zip(*[F.slice("_h", F.lit(k + 1), count).alias(f"w{k}") for k in range(WINDOW)]),
                          lambda x: F.xxhash64(x))
    d = d.withColumn("_win", F.when(count > 0, windows).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_n", F.size("_win")).withColumn("_rep", F.size(F.array_distinct("_win")) < F.col("_n"))
    # windows in order of their hash: equal neighbours are repeats
    placed = F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.col("_rep"), placed))
    same = F.filter(_pairs(F.col("_s"), F.col("_n")), lambda p: p["x"]["h"] == p["y"]["h"])
    d = d.withColumn("_at", F.when(F.col("_rep"), F.sort_array(F.array_distinct(F.flatten(F.transform(
        same, lambda p: F.array(p["x"]["i"], p["y"]["i"])))))))
    covered = F.aggregate(_pairs(F.col("_at"), F.size("_at")), F.lit(WINDOW).cast("long"),
                          lambda acc, p: acc + F.least(F.lit(WINDOW), p["y"] - p["x"]))
    d = d.withColumn("n_repeat_words", F.when(F.col("_rep"), covered).otherwise(F.lit(0).cast("long")))
    lines = F.filter(F.split("_t", "\n"), lambda x: ~x.rlike(r"^[\x20\x09-\x0D]*$"))
    d = d.withColumn("_lines", lines).withColumn("n_lines", F.size("_lines").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    d = (d.withColumn("word_chars", F.length(F.regexp_replace("_t", GAP, "")).cast("long"))
         .withColumn("n_symbols", _matches(F.col("_t"), SYMBOLS))
         .withColumn("n_marks", _matches(F.col("_t"), "!")).withColumn("n_capitals", _matches(F.col("_t"), "[A-Z]")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", base).withColumn("text_hash", F.xxhash64("_t")).drop("_t", "_words", "_h", "_win", "_n", "_rep", "_s", "_at", "_lines")


def _ratio(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.coalesce(F.col(top) / F.col(bottom), F.lit(0.0))


def _log_tail(k: Column, n: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), summed term by term in logarithms; only
    valid for k below the mean (above it the bound fails anyway)."""
    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"),
                        (high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"))
    first = n.cast("double") * math.log(1 - p)
    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
                       F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"])


def certified_cutoffs(metrics: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """One row per stratum that has a useful certified cutoff, with one
    column ``cut_<rule>`` (null: none).  ``metrics``: ``doc_id``,
    ``stratum``, ``text_hash`` and the counts; ``labels``: ``doc_id``, ``quality``."""
    good = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.size(F.array_compact(F.array(*[
        F.when(_ratio(r) > c, F.lit(1)) for c in RULES[r][2]]))).alias("hit")) for r in RULES])
    # a document is one trial however many rows repeat it, and so are
    # documents of the same text: one row per id, then one per text, the
    # lowest label counting (only labelled rows, partly combined before they
    # are shuffled)
    one = F.min(F.struct("text_hash", "q", steps.alias("s"))).alias("r")
    trials = (metrics.filter("not base_failed").join(good, "doc_id").groupBy("stratum", "doc_id").agg(one)
              .groupBy("stratum", F.col("r.text_hash").alias("text_hash")).agg(F.min(F.struct("r.q", "r.s")).alias("r")))
    # the cutoffs fall, so a value above `hit` of them is above the last ones:
    # it is rejected by every cutoff from number `len - hit` on
    seen = (trials.select("stratum", "r.q", F.explode("r.s").alias("s"))
            .groupBy("stratum", F.col("s.rule").alias("rule"), F.col("s.hit").alias("hit"))
            .agg(F.sum(F.when(F.col("q") == 1, 1).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("q") == 0, 1).otherwise(0)).alias("bad")))
    cut = F.create_map(*[x for r in RULES for x in (F.lit(r), F.array(*map(F.lit, RULES[r][2])))])
    of = Window.partitionBy("stratum", "rule")
    totals = seen.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
                                                 F.collect_list(F.struct("hit", "good", "bad")).alias("hits"))
    strata = F.size(F.collect_set(F.to_json(F.struct("stratum"))).over(Window.partitionBy()))
    totals = totals.withColumn("strata", strata)
    grid = totals.select("stratum", "rule", "n_good", "n_bad", "strata", "hits",
                         F.posexplode(cut[F.col("rule")]).alias("step", "cutoff"),
                         F.size(cut[F.col("rule")]).alias("len"))
    above = F.filter("hits", lambda h: h["hit"] >= F.col("len") - F.col("step"))
    total = lambda name: F.aggregate(above, F.lit(0).cast("long"), lambda a, h: a + h[name])
    grid = grid.withColumn("k", total("good")).withColumn("rejected", total("bad")).drop("hits")
    share = risk / len(RULES)
    limit = F.log(F.lit(doubt) / (F.lit(len(RULES)) * F.col("strata")))
    passes = (F.col("k") < F.col("n_good") * share) & (_log_tail(F.col("k"), F.col("n_good"), share) <= limit)
    grid = grid.withColumn("passes", F.coalesce(passes, F.lit(False)))
    so_far = of.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumn("certified", F.min("passes").over(so_far))
    gain = F.col("rejected") / F.greatest(F.col("n_bad"), F.lit(1)) - GOOD_WEIGHT * F.col("k") / F.greatest(F.col("n_good"), F.lit(1))
    best = (grid.filter("certified").withColumn("gain", gain).filter("gain > 0")
            .groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff")))
    return best.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judged(metrics: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``metrics`` with ``kept``."""
    c = cutoffs.withColumnRenamed("stratum", "_stratum")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(_ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    j = metrics.join(c, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return j.withColumn("kept", ~F.col("base_failed") & ~rejected) \
        .drop("_stratum", *[f"cut_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang") -> DataFrame:
    """Counts and verdict of every document."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("_text"))
    metrics = staged(with_metrics(picked, "_text").drop("_text"), "quality")
    return judged(metrics, staged(certified_cutoffs(metrics, labels), "cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` that the rules keep, as they are: each row is staged
    as a struct beside its counts, so nothing is measured twice or joined
    back, and the cutoffs read the counts alone."""
    picked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"),
                         F.col(text_col).alias("_text"))
    measured = staged(with_metrics(picked, "_text").drop("_text"), "quality")
    # stored, so that its size is known and the rows are not shuffled for it
    cutoffs = staged(certified_cutoffs(measured.drop("_row"), labels), "cutoffs")
    return judged(measured, cutoffs).filter("kept").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
