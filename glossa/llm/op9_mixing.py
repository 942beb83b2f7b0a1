"""Operator 9: mix sources to target weights (DataFrame functions only).

The words of a source, in a fixed order of its documents, are one stream cut
into blocks of ``BLOCK_WORDS`` words.  The mix is a list of slots in output
shards of ``SHARD_SLOTS``:

1. every slot draws its source by the target shares (a hash of its number
   gives the uniform variate), so the source counts of a shard are
   multinomial;
2. the r-th slot of a source takes the block ``permutation(r mod blocks)`` of
   round ``r div blocks`` (a swap-or-not shuffle keyed by source and round:
   a bijection for any number of blocks, no table needed);
3. draws beyond a source's share (sampling noise, a square root of the
   draws) are dealt again to the sources that are short, so that totals meet
   the targets within a block and no block is taken more than three times;
4. slots and blocks are joined by (source, block index).

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and
share all words; a target stops at three times its source's size and the
rest is shared again by weight (the closed form of that repetition).

Documents are placed in their source's stream by hash buckets and prefix
sums, so a source that holds a third of all rows is never ordered in one
task.  Everything is a function of the rows and ``SEED``: reruns agree.

Defined cases: null text has size 0, null source is a source of its own;
repeated rows and ids are placed each; with no words at all every target
and every ``taken`` is 0; an empty table gives no rows; other columns may
have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.sqltext import word_array, word_count
from glossa.llm.stages import staged

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
CELLS = 1 << 16
ROUNDS = 24
MOST = 3              # times a source, and so a block, may be taken
SEED = 20240917


def _uniform(*parts) -> Column:
    """A uniform variate in [0, 1) from a hash of ``parts``."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not shuffle: a bijection of 0 .. n - 1 for every key."""
    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - at, n)
        swap = F.pmod(F.xxhash64(F.lit(SEED + 1), r, *key, F.greatest(at, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(at)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(sizes: DataFrame, block_words: int) -> DataFrame:
    """Per source (``source``, ``source_size``): number, weight, target,
    blocks and the slots it should get."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = (sizes.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
         .withColumn("weight", (F.col("sid") % 3 + 1).cast("long")))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0))
    level = ((F.sum("source_size").over(whole) - MOST * before("source_size")).cast("double")
             / (F.sum("weight").over(whole) - before("weight")))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    s = s.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    want = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    return s.withColumn("want", F.when(F.col("source_size") > 0, F.least(want, MOST * F.col("blocks")))
                        .otherwise(F.lit(0).cast("long"))).drop("level")


def draw_blocks(sources: DataFrame) -> DataFrame:
    """The drawn slots: ``slot``, ``shard``, ``sid``, ``round``, ``block``."""
    spark = sources.sparkSession
    slots = int(sources.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0])
    up_to = Window.orderBy("sid")
    bounds = sources.filter("want > 0").withColumn("hi", F.sum("want").over(up_to)) \
        .withColumn("lo", F.col("hi") - F.col("want"))
    scale = float(CELLS) / max(slots, 1)
    cells = bounds.select("sid", "blocks", "want", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * scale), F.floor((F.col("hi") - 1e-9) * scale))).alias("cell"))
    drawn = (spark.range(slots).select(
                 F.col("id").alias("slot"), F.floor(F.col("id") / SHARD_SLOTS).alias("shard"),
                 (_uniform(F.col("id")) * slots).alias("u"))
             .withColumn("cell", F.floor(F.col("u") * scale))
             .join(cells, "cell").filter("u >= lo and u < hi")
             .select("slot", "shard", "sid", "blocks", "want"))
    drawn = staged(drawn, "slots")
    counts = drawn.groupBy("shard", "sid", "blocks", "want").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "sid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    in_shard = Window.partitionBy("shard", "sid").orderBy("slot")
    ranked = (drawn.withColumn("k", F.row_number().over(in_shard) - 1)
              .join(bases, ["shard", "sid"]).withColumn("r", F.col("base") + F.col("k")))
    # surplus draws, numbered through all sources, go to the sources in need
    got = (sources.filter("want > 0").select("sid", "blocks", "want")
           .join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left")
           .withColumn("n", F.coalesce("n", F.lit(0))))
    over = got.withColumn("extra", F.greatest(F.col("n") - F.col("want"), F.lit(0)))
    over = over.withColumn("from_extra", F.sum("extra").over(up_to) - F.col("extra")) \
        .withColumn("need", F.greatest(F.col("want") - F.col("n"), F.lit(0)))
    over = over.withColumn("from_need", F.sum("need").over(up_to) - F.col("need"))
    dealt = (over.filter("need > 0")
             .select(F.col("sid").alias("to_sid"), F.col("blocks").alias("to_blocks"), F.col("n").alias("to_n"),
                     "from_need", F.explode(F.sequence(F.col("from_need"), F.col("from_need") + F.col("need") - 1)).alias("e"))
             .select("e", "to_sid", "to_blocks", (F.col("to_n") + F.col("e") - F.col("from_need")).alias("to_r")))
    kept = ranked.filter("r < want").select("slot", "shard", "sid", "blocks", "r")
    again = (ranked.filter("r >= want").join(over.select("sid", "from_extra"), "sid")
             .withColumn("e", F.col("from_extra") + F.col("r") - F.col("want"))
             .join(dealt, "e")
             .select("slot", "shard", F.col("to_sid").alias("sid"), F.col("to_blocks").alias("blocks"),
                     F.col("to_r").alias("r")))
    out = kept.unionByName(again).withColumn("round", F.floor(F.col("r") / F.col("blocks")))
    return out.select("slot", "shard", "sid", "round", permuted(
        F.col("r") % F.col("blocks"), F.col("blocks"), F.col("sid"), F.col("round")).alias("block"))


def place_documents(docs: DataFrame, sources_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                    block_words: int = BLOCK_WORDS, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their place ``at`` in their source's stream, sources,
    stage table).  ``keep``: the stage table holds each whole row as the
    struct ``row`` under a number ``uid``, which the placed keys carry."""
    spark = docs.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text_hash = F.xxhash64(F.col(text_col))
    sized = staged(docs.select(
        F.col(id_col).alias("doc_id"), F.col(sources_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), text_hash.alias("th"),
        F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col), text_hash), F.lit(buckets)).alias("bucket"),
        *([F.monotonically_increasing_id().alias("uid"),
           F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else [])), "sized")
    stage, sized = sized, sized.drop("row")
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sources = staged(source_targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), block_words),
                     "sources")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "th", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))) \
        .withColumn("at", F.col("at") + F.col("base")).drop("s", "b", "base", "bucket", "th")
    named = sources.select(F.col("source").alias("s"), "sid", "source_size", "target")
    return placed.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s"), sources, stage


def taken_blocks(placed: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each block of each document with ``words`` of it in the block and the
    rounds that drew it as a bit mask (0: none)."""
    drawn = draw_blocks(sources).groupBy("sid", "block").agg(
        F.bit_or(F.expr("shiftleft(1, cast(round as int))")).alias("rounds"))
    blocks = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    first = F.greatest(F.col("at"), F.col("block") * block_words)
    last = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    return (blocks.join(drawn, ["sid", "block"], "left")
            .withColumn("first", first - F.col("at")).withColumn("words", last - first)
            .withColumn("rounds", F.coalesce("rounds", F.lit(0))))


def mix_sizes(docs: DataFrame, sources_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words of every document that the mix takes."""
    placed, sources, _ = place_documents(docs, sources_col, id_col, text_col, block_words)
    columns = ["doc_id", "size", "source_size", "target"]
    some = (taken_blocks(placed, sources, block_words)
            .groupBy("sid", "at", *columns).agg(F.sum(F.col("words") * F.bit_count("rounds")).alias("taken")))
    none = placed.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return some.select(*columns, "taken").unionByName(none)


def mix_documents(docs: DataFrame, sources_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                  chars_col: str | None = "n_chars", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of ``docs``: for each round, a document whose blocks
    were all drawn as it is, one drawn in part with the drawn words only
    (joined by single spaces), one not drawn not at all."""
    placed, sources, stage = place_documents(docs, sources_col, id_col, text_col, block_words, keep=True)
    per_doc = (taken_blocks(placed, sources, block_words)
               .groupBy("uid", "at").agg(F.array_sort(F.collect_list(F.struct("first", "rounds"))).alias("b"))
               .select("uid", "at", F.col("b.rounds").alias("drawn")))
    rows = stage.select("uid", "row").join(per_doc, "uid")     # the one shuffle of texts
    some = F.expr(f"filter(sequence(0, {MOST - 1}), e -> exists(drawn, r -> (shiftright(r, e) & 1) = 1))")
    rows = rows.select("row", "at", "drawn", F.explode(some).alias("e"))
    text = F.col("row")[text_col]
    whole = F.expr("forall(drawn, r -> (shiftright(r, e) & 1) = 1)")

    def is_drawn(word: Column, i: Column) -> Column:
        # the i-th word lies in block (at + i) div block_words of the source
        block = F.floor((F.col("at") + i) / block_words) - F.floor(F.col("at") / block_words)
        return F.pmod(F.floor(F.get("drawn", block.cast("int")) / F.pow(F.lit(2), F.col("e"))), F.lit(2)) == 1

    rows = rows.withColumn("text_out", F.when(whole, text).otherwise(
        F.array_join(F.filter(word_array(text), is_drawn), " ")))
    values = {text_col: F.col("text_out")}
    if chars_col in docs.columns:
        values[chars_col] = F.length("text_out").cast(docs.schema[chars_col].dataType)
    return rows.select(*[values.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
