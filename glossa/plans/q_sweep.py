"""Sweep-report queries over F7 (events as a run log): run = user_id, step =
position by (ts, event_id) in a run, metric = event_type.  Run parameters:
expansion = 32 * 2^(user_id % 3), k = 1024 * (1 + user_id % 4),
lr = 1e-4 * (1 + user_id % 5), aux coefficient (0, 0.1, 0.5, 1) by
(user_id / 4) % 4, aux target (0.01, 0.02, 0.05) by (user_id / 3) % 3.
A run's metric is its last value of that type; 'error' stands for the
dead-feature share and 'view' for the FVU in the leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from glossa.functions import runs as rf
from glossa.functions.numeric import r6
from glossa.operators import sweep
from glossa.plans.fixtures import with_ctes
from glossa.plans.registry import query
from glossa.sources.tables import table

METRICS = ("click", "error", "purchase", "signup", "view")
PARAMS = ("expansion", "k", "lr", "aux", "target")
DEAD, FVU = "error", "view"
INPUT_DIM = 1024
SPARSITY_RATIOS = (0.015, 0.02, 0.025, 0.03)
CHECKPOINTS = ("final", "step_50")
THRESHOLDS = (0.95, 0.98, 0.995)
LOG_STEPS, EPOCH_STEPS = 5, 20


def _params(uid):
    aux_i = (uid / 4).cast("long") % 4
    tgt_i = (uid / 3).cast("long") % 3
    return {
        "expansion": (F.lit(32) * F.pow(F.lit(2), uid % 3)).cast("long"),
        "k": (F.lit(1024) * (uid % 4 + 1)).cast("long"),
        "lr": F.lit(1e-4) * (uid % 5 + 1),
        "aux": F.when(aux_i == 0, 0.0).when(aux_i == 1, 0.1).when(aux_i == 2, 0.5).otherwise(1.0),
        "target": F.when(tgt_i == 0, 0.01).when(tgt_i == 1, 0.02).otherwise(0.05),
    }


def f7_runs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    last = ev.groupBy("user_id").pivot("event_type", list(METRICS)).agg(
        F.max_by("value", F.struct("ts", "event_id")))
    p = _params(F.col("user_id"))
    return last.select(F.col("user_id").alias("run"), *[p[k].alias(k) for k in PARAMS],
                       *METRICS)


F7_SQL = """
ev AS (SELECT * FROM events),
lastv AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM ev
          GROUP BY user_id, event_type),
runs AS (SELECT user_id AS run,
                CAST(32 * pow(2, user_id % 3) AS BIGINT) AS expansion,
                CAST(1024 * (user_id % 4 + 1) AS BIGINT) AS k,
                1e-4 * (user_id % 5 + 1) AS lr,
                CASE (user_id // 4) % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS aux,
                CASE (user_id // 3) % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.02 ELSE 0.05 END::DOUBLE AS target,
                max(v) FILTER (WHERE event_type = 'click') AS click,
                max(v) FILTER (WHERE event_type = 'error') AS error,
                max(v) FILTER (WHERE event_type = 'purchase') AS purchase,
                max(v) FILTER (WHERE event_type = 'signup') AS signup,
                max(v) FILTER (WHERE event_type = 'view') AS view
         FROM lastv GROUP BY user_id),
runs_long AS (UNPIVOT runs ON click, error, purchase, signup, view INTO NAME metric VALUE value),
params_long AS (UNPIVOT (SELECT run, CAST(expansion AS DOUBLE) AS expansion, CAST(k AS DOUBLE) AS k,
                                lr, aux, target FROM runs)
                ON expansion, k, lr, aux, target INTO NAME param VALUE pvalue)"""


def _name_sql(col_lr="lr", col_aux="aux", col_tgt="target"):
    return (f"'exp' || expansion || '_k' || k || '_lr' || printf('%.0e', {col_lr}) || "
            f"CASE WHEN {col_aux} = 0 THEN '_noaux' ELSE '_aux' || printf('%.0e', {col_aux}) "
            f"|| '_tgt' || printf('%.0e', {col_tgt}) END")


@query("run_names", with_ctes(F7_SQL, body=f"""
SELECT run, name,
       CAST(regexp_extract(name, 'exp(\\d+)', 1) AS BIGINT) AS expansion,
       CAST(regexp_extract(name, '_k(\\d+)', 1) AS BIGINT) AS k,
       CAST(nullif(regexp_extract(name, '_lr([0-9.]+e[-+]\\d+)', 1), '') AS DOUBLE) AS lr,
       CAST(nullif(regexp_extract(name, '_aux([0-9.]+e[-+]\\d+)', 1), '') AS DOUBLE) AS aux,
       CAST(nullif(regexp_extract(name, '_tgt([0-9.]+e[-+]\\d+)', 1), '') AS DOUBLE) AS target
FROM (SELECT run, {_name_sql()} AS name FROM runs)"""))
def run_names(spark, sf_dir):
    runs = f7_runs(spark, sf_dir)
    named = runs.select("run", rf.run_name("expansion", "k", rf.sci("lr"), rf.sci("aux"),
                                           rf.sci("target")).alias("name"))
    p = rf.parse_run("name")
    return named.select("run", "name", *[p[c].alias(c) for c in PARAMS])


@query("sparsity_grid", with_ctes(F7_SQL, body="""
SELECT DISTINCT expansion,
       least(greatest(1024, CAST(ceil(floor(1024 * expansion * r) / 1024) AS BIGINT) * 1024),
             1024 * expansion) AS k
FROM (SELECT DISTINCT expansion FROM runs),
     (SELECT unnest([0.015, 0.02, 0.025, 0.03]::DOUBLE[]) AS r)"""))
def sparsity_grid(spark, sf_dir):
    ef = f7_runs(spark, sf_dir).select("expansion").distinct()
    grid = ef.select("expansion", F.explode(F.array(*[F.lit(r) for r in SPARSITY_RATIOS])).alias("r"))
    dsz = F.col("expansion") * INPUT_DIM
    return grid.select("expansion", rf.sparsity_for(dsz, F.col("r")).alias("k")).distinct()


@query("analysis_key", with_ctes(F7_SQL, body=f"""
SELECT run, c AS checkpoint, t AS threshold,
       name || '_' || c || '_mask' || replace(CAST(t AS VARCHAR), '.', '_') AS key
FROM (SELECT run, {_name_sql()} AS name FROM runs),
     (SELECT unnest(['final', 'step_50']) AS c), (SELECT unnest([0.95, 0.98, 0.995]::DOUBLE[]) AS t)"""))
def analysis_key(spark, sf_dir):
    # P12 over the J9 grid (checkpoints x thresholds), attached by explode
    runs = f7_runs(spark, sf_dir)
    named = runs.select("run", rf.run_name("expansion", "k", rf.sci("lr"), rf.sci("aux"),
                                           rf.sci("target")).alias("name"))
    g = (named.withColumn("checkpoint", F.explode(F.array(*[F.lit(c) for c in CHECKPOINTS])))
         .withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS]))))
    return g.select("run", "checkpoint", "threshold",
                    rf.analysis_key("name", "checkpoint", "threshold").alias("key"))


@query("sweep_summary", with_ctes(F7_SQL, body="""
SELECT metric, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std,
       round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max,
       CAST(count(value) AS BIGINT) AS n_runs
FROM runs_long GROUP BY metric"""))
def sweep_summary(spark, sf_dir):
    s = sweep.summary(f7_runs(spark, sf_dir), METRICS)
    return s.select("metric", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
                    F.col("n_runs").cast("long").alias("n_runs"))


@query("param_effects", with_ctes(F7_SQL, body="""
SELECT c.metric, c.param, round(c.correlation, 6) + 0.0 AS correlation,
       b.best_value, round(b.best_mean, 6) + 0.0 AS best_mean,
       b.worst_value, round(b.worst_mean, 6) + 0.0 AS worst_mean
FROM (SELECT metric, param, corr(pvalue, value) AS correlation
      FROM params_long JOIN runs_long USING (run) GROUP BY metric, param) c
JOIN (SELECT metric, param, arg_min(pvalue, (mean, pvalue)) AS best_value, min(mean) AS best_mean,
             arg_max(pvalue, (mean, -pvalue)) AS worst_value, max(mean) AS worst_mean
      FROM (SELECT metric, param, pvalue, avg(value) AS mean
            FROM params_long JOIN runs_long USING (run) GROUP BY metric, param, pvalue)
      GROUP BY metric, param) b USING (metric, param)"""))
def param_effects(spark, sf_dir):
    e = sweep.param_effects(f7_runs(spark, sf_dir), PARAMS, METRICS)
    return e.select("metric", "param", r6(F.col("correlation")).alias("correlation"),
                    "best_value", r6(F.col("best_mean")).alias("best_mean"),
                    "worst_value", r6(F.col("worst_mean")).alias("worst_mean"))


@query("per_value", with_ctes(F7_SQL, body="""
SELECT expansion AS value, CAST(count(*) AS BIGINT) AS n_runs,
       round(avg(error), 6) + 0.0 AS mean_error, round(min(error), 6) + 0.0 AS best_error,
       round(avg(view), 6) + 0.0 AS mean_view, round(min(view), 6) + 0.0 AS best_view
FROM runs GROUP BY expansion"""))
def per_value(spark, sf_dir):
    t = sweep.per_value(f7_runs(spark, sf_dir), "expansion", [DEAD, FVU])
    return t.select("value", F.col("n_runs").cast("long").alias("n_runs"),
                    *[r6(F.col(c)).alias(c) for c in ("mean_error", "best_error", "mean_view", "best_view")])


@query("aux_effect", with_ctes(F7_SQL, body="""
SELECT aux > 0 AS with_aux, CAST(count(*) AS BIGINT) AS n_runs,
       round(avg(error), 6) + 0.0 AS mean_error, round(avg(view), 6) + 0.0 AS mean_view
FROM runs GROUP BY 1"""))
def aux_effect(spark, sf_dir):
    runs = f7_runs(spark, sf_dir).withColumn("with_aux", F.col("aux") > 0)
    return runs.groupBy("with_aux").agg(F.count(F.lit(1)).cast("long").alias("n_runs"),
                                        r6(F.avg(DEAD)).alias("mean_error"),
                                        r6(F.avg(FVU)).alias("mean_view"))


LEADER_SQL = """
mm AS (SELECT min(error) AS d0, max(error) AS d1, min(view) AS f0, max(view) AS f1 FROM runs),
boards AS (SELECT run, 'dead' AS board, error AS score FROM runs
           UNION ALL SELECT run, 'fvu', view FROM runs
           UNION ALL SELECT run, 'balanced', (error - d0) / greatest(d1 - d0, 1e-12)
                                           + (view - f0) / greatest(f1 - f0, 1e-12) FROM runs, mm),
ranked AS (SELECT board, run, score, row_number() OVER (PARTITION BY board ORDER BY score, run) AS rank
           FROM boards)"""


@query("leaderboard", with_ctes(F7_SQL, LEADER_SQL, body="""
SELECT board, CAST(rank AS BIGINT) AS rank, run, round(score, 6) + 0.0 AS score
FROM ranked WHERE rank <= 10"""))
def leaderboard(spark, sf_dir):
    lb = sweep.leaderboards(f7_runs(spark, sf_dir), DEAD, FVU, 10)
    return lb.select("board", F.col("rank").cast("long").alias("rank"), "run",
                     r6(F.col("score")).alias("score"))


@query("modal_params", with_ctes(F7_SQL, LEADER_SQL, body="""
SELECT param, arg_min(pvalue, (-n, pvalue)) AS value FROM (
  SELECT param, pvalue, count(*) AS n FROM params_long
  WHERE run IN (SELECT run FROM ranked WHERE board = 'balanced' AND rank <= 5)
  GROUP BY param, pvalue) GROUP BY param"""))
def modal_params(spark, sf_dir):
    runs = f7_runs(spark, sf_dir)
    top = sweep.leaderboards(runs, DEAD, FVU, 5).filter(F.col("board") == "balanced")
    return sweep.modal_params(runs, top, PARAMS)


@query("trailing_mean", f"""
SELECT user_id AS run, event_type AS metric, CAST(step AS BIGINT) AS step,
       round(avg(value) OVER (PARTITION BY user_id, event_type, (step - 1) // {EPOCH_STEPS}
                              ORDER BY step ROWS BETWEEN {LOG_STEPS - 1} PRECEDING AND CURRENT ROW), 6) + 0.0
         AS trailing_mean
FROM (SELECT user_id, event_type, value,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step
      FROM events)
QUALIFY step % {LOG_STEPS} = 0""")
def trailing_mean(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    # runs are many and small: a plain window numbers their steps
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    log = ev.select("user_id", "event_type", "value", F.row_number().over(order).alias("step"))
    log = log.select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"),
                     "step", "value")
    t = sweep.trailing_mean(log, LOG_STEPS, EPOCH_STEPS)
    return t.select("run", "metric", F.col("step").cast("long").alias("step"),
                    r6(F.col("trailing_mean")).alias("trailing_mean"))
