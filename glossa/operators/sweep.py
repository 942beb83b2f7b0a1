"""Sweep report over a table of training runs.

Inputs: ``runs`` (one row per run: run id, parameter columns, metric
columns).  Everything is a grouped aggregate or a window over the run
table (runs are few; metric logs are long and only meet windows
partitioned by run and metric).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _unpivot(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str], name: str,
             value: str) -> DataFrame:
    return df.unpivot(list(id_cols), list(cols), name, value)


def summary(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric: mean, std (sample), min, max over runs."""
    long = _unpivot(runs.select("run", *[F.col(m).cast("double") for m in metrics]),
                    ["run"], metrics, "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("n_runs"))


def param_effects(runs: DataFrame, params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per (metric, parameter): Pearson correlation over runs and the
    best / worst parameter value by mean metric (lower is better; ties go to
    the smaller value)."""
    p_long = _unpivot(runs.select("run", *[F.col(p).cast("double") for p in params]),
                      ["run"], params, "param", "pvalue")
    m_long = _unpivot(runs.select("run", *[F.col(m).cast("double") for m in metrics]),
                      ["run"], metrics, "metric", "value")
    both = p_long.join(m_long, "run")
    corr = both.groupBy("metric", "param").agg(F.corr("pvalue", "value").alias("correlation"))
    means = both.groupBy("metric", "param", "pvalue").agg(F.avg("value").alias("mean"))
    best = means.groupBy("metric", "param").agg(
        F.min_by("pvalue", F.struct("mean", "pvalue")).alias("best_value"),
        F.min("mean").alias("best_mean"),
        F.max_by("pvalue", F.struct("mean", F.col("pvalue") * -1)).alias("worst_value"),
        F.max("mean").alias("worst_mean"))
    return corr.join(best, ["metric", "param"])


def per_value(runs: DataFrame, param: str, metrics: Sequence[str]) -> DataFrame:
    """Per value of one parameter: runs, mean and best (min) of each metric."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.min(m).alias(f"best_{m}")]
    return runs.groupBy(F.col(param).alias("value")).agg(*aggs)


def leaderboards(runs: DataFrame, dead: str, fvu: str, n: int = 10) -> DataFrame:
    """Top ``n`` runs by lowest ``dead``, by lowest ``fvu`` and by the
    balanced score ``minmax(dead) + minmax(fvu)`` (min and max over all
    runs); ties go to the smaller run id.  ``(board, rank, run, score)``."""
    stats = runs.agg(F.min(dead).alias("d0"), F.max(dead).alias("d1"),
                     F.min(fvu).alias("f0"), F.max(fvu).alias("f1"))
    # one-row statistics attached with a broadcast join on a constant key
    scored = (runs.withColumn("_one", F.lit(1))
              .join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")
              .withColumn("balanced",
                          (F.col(dead) - F.col("d0")) / F.greatest(F.col("d1") - F.col("d0"), F.lit(1e-12))
                          + (F.col(fvu) - F.col("f0")) / F.greatest(F.col("f1") - F.col("f0"), F.lit(1e-12))))
    boards = scored.select("run", F.explode(F.array(
        F.struct(F.lit("dead").alias("board"), F.col(dead).cast("double").alias("score")),
        F.struct(F.lit("fvu").alias("board"), F.col(fvu).cast("double").alias("score")),
        F.struct(F.lit("balanced").alias("board"), F.col("balanced").alias("score")),
    )).alias("b")).select("run", "b.*")
    w = Window.partitionBy("board").orderBy("score", "run")
    return boards.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def modal_params(runs: DataFrame, top_runs: DataFrame, params: Sequence[str]) -> DataFrame:
    """The most common value of each parameter among ``top_runs``
    (ties: the smaller value)."""
    sel = runs.join(top_runs.select("run"), "run")
    long = _unpivot(sel.select("run", *[F.col(p).cast("double") for p in params]),
                    ["run"], params, "param", "value")
    counts = long.groupBy("param", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("param").agg(
        F.min_by("value", F.struct(F.col("n") * -1, F.col("value"))).alias("value"))


def trailing_mean(log: DataFrame, log_steps: int, epoch_steps: int) -> DataFrame:
    """Per (run, metric), the mean of the last ``log_steps`` values
    (fewer at the start of an epoch: the buffer restarts every
    ``epoch_steps`` steps), reported at steps divisible by ``log_steps``.
    ``log`` is ``(run, metric, step, value)`` with 1-based steps."""
    epoch = ((F.col("step") - 1) / epoch_steps).cast("long")
    w = (Window.partitionBy("run", "metric", "epoch").orderBy("step")
         .rowsBetween(-(log_steps - 1), 0))
    return (log.withColumn("epoch", epoch)
            .withColumn("trailing_mean", F.avg("value").over(w))
            .filter(F.col("step") % log_steps == 0))
