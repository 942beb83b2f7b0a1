import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators.ranking import row_number_scalable


def test_matches_window_with_a_hot_group(spark):
    random.seed(1)
    rows = [("hot" if random.random() < 0.4 else f"g{random.randint(0, 9)}", i,
             random.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, key int")
    got = row_number_scalable(df, ["g"], ["key", "id"], num_buckets=7)
    w = Window.partitionBy("g").orderBy("key", "id")
    want = df.withColumn("rn", F.row_number().over(w).cast("long"))
    assert got.select("g", "id", "rn").exceptAll(want.select("g", "id", "rn")).count() == 0
    assert got.count() == 3000


def test_global_numbering(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "x")
    got = row_number_scalable(df, [], ["x"], out_col="pos", num_buckets=5)
    assert sorted(r["pos"] - r["x"] for r in got.collect()) == [1] * 1000


def test_string_and_timestamp_keys_and_null_group(spark):
    import datetime as dt
    rows = [(None if i % 7 == 0 else f"g{i % 3}", f"k{(i * 37) % 101:03d}", i,
             dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(i * 13) % 500)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, key string, id long, ts timestamp")
    for order in (["key", "id"], ["ts", "id"]):
        got = row_number_scalable(df, ["g"], order, num_buckets=6)
        w = Window.partitionBy("g").orderBy(*order)
        want = df.withColumn("rn", F.row_number().over(w).cast("long"))
        assert got.count() == 400
        assert got.select("g", "id", "rn").exceptAll(want.select("g", "id", "rn")).count() == 0


def test_many_buckets_use_the_same_numbers(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 5000).alias("k"))
    a = row_number_scalable(df, ["g"], ["k"], num_buckets=200)
    b = row_number_scalable(df, ["g"], ["k"], num_buckets=8)
    assert a.count() == 5000 and a.exceptAll(b).count() == 0


def test_long_shared_prefixes_are_split(spark):
    df = spark.range(0, 4000).select(F.concat(F.lit("https://example.org/a/very/long/path/"),
                                              F.lpad(F.col("id").cast("string"), 8, "0")).alias("url"))
    got = row_number_scalable(df, [], ["url"], num_buckets=16)
    assert got.filter(F.col("rn") - 1 != F.substring("url", -8, 8).cast("long")).count() == 0
    ranges = df.repartitionByRange(16, "url").groupBy(F.spark_partition_id().alias("p")).count()
    assert ranges.count() > 8


def test_nan_null_and_local_timestamps(spark):
    import datetime as dt
    rows = [(i, float("nan") if i % 5 == 0 else None if i % 7 == 0 else float(i % 11),
             dt.datetime(2024, 3, 10) + dt.timedelta(minutes=7 * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for order in (["x", "id"], ["ts", "id"]):
            want = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))
            for n in (8, 200):
                got = row_number_scalable(df, [], order, num_buckets=n)
                assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
