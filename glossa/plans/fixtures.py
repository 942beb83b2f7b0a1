"""Stand-in inputs built from the test tables (F1..F10).

Each stand-in is written the same way in Spark (here) and in SQL (the
``*_SQL`` snippets, used as CTEs by the oracles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import sae
from glossa.sources.tables import table

# Fixed parameters of the stand-ins.
ATOM_LIMIT = 256          # F4: the stand-in model's atoms are embeddings with vec_id < 256
                          # (a model of fixed size; the data side is always read whole)
SPARSITY = 16             # F4: top-k
MASK_THRESHOLD = 0.55     # masks at 55 % (0.8 gives an empty mask on this data)
THRESHOLDS = (0.55, 0.60, 0.65, 0.99)      # no feature reaches the last
AUX_COEFF = 1.0
AUX_TARGET = 0.02


# dictionary model -------------------------------------------------------

def f4_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.filter(F.col("vec_id") < ATOM_LIMIT).select(
        F.col("vec_id").cast("int").alias("feature"),
        F.col("embedding").cast("array<double>").alias("enc"),
        F.col("embedding").cast("array<double>").alias("dec"))


def f4_model(spark: SparkSession, sf_dir: str, sparsity: int = SPARSITY) -> sae.SaeModel:
    return sae.load_model(f4_atoms(spark, sf_dir), sparsity)


F4_SQL = """
atoms AS (SELECT CAST(vec_id AS INTEGER) AS feature,
                 CAST(embedding AS DOUBLE[]) AS enc
          FROM embeddings WHERE vec_id < 256),
atom_dims AS (SELECT feature, unnest(enc) AS w, generate_subscripts(enc, 1) - 1 AS dim
              FROM atoms)"""


# language label of a vector ------------------------------------------------

def f5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.col("label").cast("string").alias("language"), "embedding")


F5_SQL = """
x AS (SELECT vec_id, CAST(label AS VARCHAR) AS language,
             CAST(embedding AS DOUBLE[]) AS v
      FROM embeddings),
raw AS (SELECT x.vec_id, x.language, a.feature,
               greatest(list_inner_product(x.v, a.enc), 0.0) AS value
        FROM x, atoms a),
totals AS (SELECT language, count(*) AS total FROM x GROUP BY language),
fired AS (SELECT language, feature, count(*) AS n FROM raw
          WHERE abs(value) > 1e-6 GROUP BY language, feature),
rates AS (SELECT f.language, f.feature, f.n, t.total,
                 f.n / t.total * 100.0 AS rate_pct
          FROM fired f JOIN totals t USING (language)),
ths AS (SELECT unnest([0.55, 0.60, 0.65, 0.99]::DOUBLE[]) AS threshold),
masks AS (SELECT th.threshold, r.language, r.feature FROM rates r, ths th
          WHERE r.n / r.total * 100.0 >= th.threshold * 100.0),
topk_all AS (SELECT vec_id, language, feature, value,
                    row_number() OVER (PARTITION BY vec_id ORDER BY round(value, 12) DESC, feature) AS rnk
             FROM raw),
topk AS (SELECT * FROM topk_all WHERE rnk <= 16 AND value > 0),
kth AS (SELECT vec_id, max(CASE WHEN rnk = 16 THEN value END) AS kth_value
        FROM topk_all GROUP BY vec_id)"""


def with_ctes(*parts: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(p.strip("\n") for p in parts) + "\n" + body
