"""Corpus jobs: seeded order, two-source quotas, balancing, interleaving,
splits and accounting (L1-L3, L6, W4, W5, T1, C4-C8, A1, A2, A12-A14).

Every ranking is a row number inside a key (language, source, ...) made
with ``row_number_scalable``: a language that holds a third of the corpus
is spread over a third of the tasks instead of one.  Per-group counts and
quotas are tables of (languages x sources) rows and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from glossa.functions.text import split_sources
from glossa.operators.ranking import row_number_scalable

DEFAULT_SEED = 42
TRAIN_RATIO = 0.8


def seeded_key(id_col, seed: int = DEFAULT_SEED) -> Column:
    """L2: a reproducible shuffle key, ``md5('<id>:<seed>')`` (the same in
    any engine that has md5)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(":"), F.lit(str(seed))))


def seeded_rank(df: DataFrame, group_cols: Sequence[str], id_cols: Sequence[str],
                seed: int = DEFAULT_SEED, out_col: str = "pos") -> DataFrame:
    """L2 + W4: 1-based position inside ``group_cols`` in seeded order
    (ties on the md5 key broken by the ids)."""
    key = seeded_key(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols]), seed)
    # the first 8 hex digits of the md5 key are uniform over [0, 2^32):
    # equal-width buckets, no quantile pass
    prefix = F.conv(F.substring(F.col("_sk"), 1, 8), 16, 10).cast("double")
    return row_number_scalable(df.withColumn("_sk", key), list(group_cols),
                               ["_sk", *id_cols], out_col=out_col, bucket_key=prefix,
                               key_range=(0.0, float(2 ** 32))).drop("_sk")


def language_counts(df: DataFrame, language_col: str = "language") -> DataFrame:
    """A1: ``(language, n)``."""
    return df.groupBy(F.col(language_col).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def balance_target(counts: DataFrame, languages: Sequence[str] | None = None) -> int:
    """A2: the smallest language count; a configured language without rows
    counts as 0 and is an error."""
    if languages is not None:       # only the configured languages reach the driver
        counts = counts.filter(F.col("language").isin(list(languages)))
    rows = {r["language"]: r["n"] for r in counts.collect()}   # one row per language
    langs = list(languages) if languages is not None else sorted(rows)
    missing = [lang for lang in langs if rows.get(lang, 0) == 0]
    if missing:
        raise ValueError(f"languages without rows: {missing}")
    return int(min(rows[lang] for lang in langs))


def two_source_quota(avail_a: Column, avail_b: Column, max_items) -> tuple[Column, Column]:
    """Rows used from source a and source b for ``max_items`` per
    language: half from a (rounded down) and the rest from b, and what one
    source lacks comes from the other."""
    m = max_items if isinstance(max_items, Column) else F.lit(max_items)
    used_b = F.least(avail_b, m - F.least(avail_a, F.floor(m / 2)))
    return F.least(avail_a, m - used_b).cast("long"), used_b.cast("long")


def source_quotas(chunks: DataFrame, first_source: str, second_source: str,
                  max_items: int | None = None) -> DataFrame:
    """A15 + A2 + L6 per language: ``(language, available_a, available_b,
    used_a, used_b)``.  The quota of a language is the number of chunks of
    the language that has fewest, or ``max_items`` if given and lower."""
    c = chunks.groupBy("language").agg(
        F.count_if(F.col("source") == first_source).alias("available_a"),
        F.count_if(F.col("source") == second_source).alias("available_b"))
    quota = F.min(F.col("available_a") + F.col("available_b")).over(Window.partitionBy())   # a row per language
    if max_items is not None:
        quota = F.least(quota, F.lit(int(max_items)))
    c = c.withColumn("_quota", quota)
    ua, ub = two_source_quota(F.col("available_a"), F.col("available_b"), F.col("_quota"))
    return c.withColumn("used_a", ua).withColumn("used_b", ub).drop("_quota")


def quota_select(chunks: DataFrame, quotas: DataFrame, first_source: str,
                 second_source: str, id_cols: Sequence[str] = ("doc_id", "piece"),
                 seed: int = DEFAULT_SEED) -> DataFrame:
    """W5 + T1: the first ``used_*`` rows of each source in seeded order,
    both sources in one table (bag union by construction)."""
    ranked = seeded_rank(chunks, ["language", "source"], list(id_cols), seed, out_col="_src_pos")
    q = quotas.select("language", "used_a", "used_b")
    quota = (F.when(F.col("source") == first_source, F.col("used_a"))
             .when(F.col("source") == second_source, F.col("used_b")).otherwise(F.lit(0)))
    return (ranked.join(q, "language")
            .filter(F.col("_src_pos") <= quota).drop("used_a", "used_b", "_src_pos"))


def build_language(chunks: DataFrame, first_source: str, second_source: str,
                   max_items: int | None = None, id_cols: Sequence[str] = ("doc_id", "piece"),
                   seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """C4 for all languages at once: quotas (L6), per-source selection (W5),
    union (T1) and a seeded order of the union per language (``pos``).
    Returns (rows, quotas); rows carry the keys only (``language``,
    ``source``, ids, ``pos``): ranking never moves texts, which are joined
    back once by ``with_text`` where the output needs them."""
    keys = chunks.select("language", "source", *id_cols)
    quotas = source_quotas(keys, first_source, second_source, max_items)
    chosen = quota_select(keys, quotas, first_source, second_source, id_cols, seed)
    ordered = seeded_rank(chosen, ["language"], list(id_cols), seed + 1, out_col="pos")
    return ordered, quotas


def with_text(rows: DataFrame, chunks: DataFrame,
              id_cols: Sequence[str] = ("doc_id", "piece")) -> DataFrame:
    """Attach the chunk columns to selected keys (one shuffle join on the ids)."""
    return rows.join(chunks.drop("language", "source"), list(id_cols), "inner")


def interleave(rows: DataFrame, languages: DataFrame, min_count: int,
               pos_col: str = "pos") -> DataFrame:
    """L3 + W4 (C5): keep the first ``min_count`` rows of every language and
    number sets: ``set_id = pos - 1``; output order (set_id, lang_ord) is
    applied by the sink.  ``languages`` is ``(language, lang_ord)``."""
    return (rows.filter(F.col(pos_col) <= min_count)
            .join(F.broadcast(languages), "language")
            .withColumn("set_id", (F.col(pos_col) - 1).cast("long")))


def balance_and_interleave(rows: DataFrame, languages: DataFrame,
                           train_ratio: float = TRAIN_RATIO) -> tuple[DataFrame, int]:
    """C5 + C6: the balance target (A2) needs one action on the ranked rows,
    so the rows (keys only, no texts) are first written as a table in the
    shared checkpoint folder; trimming, set numbering and the split then
    read them again without recomputing the ranking.  Returns (sets,
    n_sets)."""
    from glossa.session import materialize
    rows = materialize(rows, "ranked-rows")
    langs = [r["language"] for r in languages.select("language").collect()]  # configured list
    min_count = balance_target(language_counts(rows), langs)
    sets = interleave(rows, languages, min_count)
    return split_sets(sets, min_count, train_ratio), min_count


def split_sets(sets: DataFrame, n_sets: int, train_ratio: float = TRAIN_RATIO) -> DataFrame:
    """Whole sets only; the first ``int(n_sets * ratio)`` sets train,
    the rest validation, and at least one validation set."""
    train_sets = int(n_sets * train_ratio)
    if n_sets - train_sets == 0:
        train_sets = n_sets - 1
    return sets.withColumn("split", F.when(F.col("set_id") < train_sets, F.lit("train"))
                           .otherwise(F.lit("val")))


def exact_split(df: DataFrame, id_col: str, fraction: float, seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``int(n * fraction)`` rows go to validation, chosen by a
    seeded hash rank (``randomSplit`` is only approximate)."""
    n = df.count()
    n_val = int(n * fraction)
    ranked = seeded_rank(df, [], [id_col], seed, out_col="_r")
    return (ranked.withColumn("split", F.when(F.col("_r") <= n_val, F.lit("val"))
                              .otherwise(F.lit("train"))).drop("_r"))


def sample_with_replacement(df: DataFrame, order_col: str, epoch: int, n: int | None = None,
                            seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``n`` draws with replacement (default: one per row),
    ``(draw, *columns)``.  Draw ``i`` of an epoch takes the row at position
    ``md5(seed:epoch:i) mod rows`` in ``order_col`` order, so draws depend
    neither on the partitioning nor on the run; an empty table gives none."""
    rows = df.count()
    draws = df.sparkSession.range((rows if n is None else n) if rows else 0)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("id").cast("string")))
    at = F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % F.lit(max(rows, 1))
    placed = row_number_scalable(df, [], [order_col], out_col="_at")
    return (draws.select(F.col("id").alias("draw"), (at + 1).alias("_at"))
            .join(placed, "_at").drop("_at"))


def source_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per source, a merged row counting once for each of its
    sources; plus ``_merged_fragments`` = rows with more than one source."""
    s = rows.withColumn("_srcs", split_sources(F.col("source")))
    per = (s.select(*by, F.explode("_srcs").alias("source"))
           .groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n")))
    merged = (s.groupBy(*by).agg(F.count_if(F.size("_srcs") > 1).alias("n"))
              .withColumn("source", F.lit("_merged_fragments")))
    return per.unionByName(merged)


def source_rollup(rows: DataFrame) -> DataFrame:
    """Counts by (split, source) and by source over both splits
    (split = 'total'): GROUPING SETS ((split, source), (source))."""
    s = rows.select("split", F.explode(split_sources(F.col("source"))).alias("source"))
    g = s.rollup("source", "split").agg(F.count(F.lit(1)).alias("n"),
                                        F.grouping_id().alias("_g"))
    return (g.filter(F.col("source").isNotNull())
            .select(F.coalesce(F.col("split"), F.lit("total")).alias("split"), "source", "n"))


def language_accounting(quotas: DataFrame, final_rows: DataFrame, first_source: str,
                        second_source: str) -> DataFrame:
    """Per language: available / used / unused per source after the
    recount of the final rows, final train / val / total and the source
    shares in percent (2 decimals, zero-safe)."""
    fin = final_rows.groupBy("language").agg(
        F.count_if(F.col("source").contains(first_source)).alias("final_a"),
        F.count_if(F.col("source").contains(second_source)).alias("final_b"),
        F.count(F.lit(1)).alias("final_total"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "val").alias("val"))
    q = quotas.join(fin, "language", "left").fillna(0)
    denom = F.greatest(F.col("final_total"), F.lit(1))
    return q.select(
        "language", "available_a", "available_b",
        (F.col("available_a") + F.col("available_b")).alias("available_total"),
        F.col("final_a").alias("used_a"), F.col("final_b").alias("used_b"),
        F.col("final_total").alias("used_total"),
        F.greatest(F.lit(0), F.col("available_a") - F.col("final_a")).alias("unused_a"),
        F.greatest(F.lit(0), F.col("available_b") - F.col("final_b")).alias("unused_b"),
        "train", "val", (F.col("train") + F.col("val")).alias("final_total"),
        F.round(F.lit(100.0) * F.col("final_a") / denom, 2).alias("a_percent"),
        F.round(F.lit(100.0) * F.col("final_b") / denom, 2).alias("b_percent"))


def languages_table(spark: SparkSession, codes: Sequence[str]) -> DataFrame:
    """The configured languages and their fixed order."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(codes)],
                                 "language string, lang_ord int")


def statistics(accounting: DataFrame) -> DataFrame:
    """K2 body: one row per language with the nested statistics object
    (available / used / unused / final_dataset / source_distribution) as a
    JSON string; written by ``sinks.write_statistics``."""
    doc = F.struct(
        F.struct(F.col("available_a").alias("a"), F.col("available_b").alias("b"),
                 F.col("available_total").alias("total")).alias("available"),
        F.struct(F.col("used_a").alias("a"), F.col("used_b").alias("b"),
                 F.col("used_total").alias("total")).alias("used"),
        F.struct(F.col("unused_a").alias("a"), F.col("unused_b").alias("b"),
                 (F.col("unused_a") + F.col("unused_b")).alias("total")).alias("unused"),
        F.struct("train", "val", F.col("final_total").alias("total")).alias("final_dataset"),
        F.struct("a_percent", "b_percent").alias("source_distribution"))
    return accounting.select("language", F.to_json(doc).alias("statistics"))
