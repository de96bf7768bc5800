"""Samples: exact sizes and rows, few rows at a group's end, repeated keys, no shuffle of the result."""

from helpers import as_set
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadcast.functions.noise import hash_number
from loadcast.operators import sample
from loadcast.operators.sample import sample_per_group


def readings(spark, n):
    """One series holds about half of all rows, one has a single row, one has no name."""
    series = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") == 1, "single").when(F.col("id") % 3 > 0, "cold")
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    return spark.range(n).select(when.alias("datetime"), series.alias("country"), F.col("id").alias("n"))


def plain(df, fraction, key):
    """The same rows by one window over each whole group."""
    whole = Window.partitionBy("country")
    order = Window.partitionBy("country").orderBy(hash_number(F.concat_ws("|", *[sample._part(c) for c in key]), 42), *key)
    ranked = df.withColumns({"_r": F.row_number().over(order), "_all": F.count(F.lit(1)).over(whole)})
    return ranked.where(F.col("_r") <= F.bround(F.col("_all").cast("double") * fraction, 0)).drop("_r", "_all")


def test_samples_are_those_of_a_plain_ranking(spark):
    df = readings(spark, 20_000)
    for fraction in (0.0, 0.00005, 0.1, 0.5, 0.999, 1.0):
        for key in (["n"], ["country", "datetime"]):
            got = sample_per_group(df.repartition(5), fraction, key)
            assert got.columns == df.columns
            assert as_set(got) == as_set(plain(df, fraction, key)), (fraction, key)
    assert sample_per_group(df.limit(0), 0.5, ["n"]).count() == 0


def test_a_repeated_key_at_the_end_is_counted_out(spark):
    df = spark.range(3000).select(F.lit(None).cast("string").alias("country"), (F.col("id") % 3).alias("k"), F.lit(1).alias("_rest"))
    for fraction, size in ((0.1, 300), (0.5, 1500), (1 / 3, 1000), (0.9, 2700)):
        got = sample_per_group(df, fraction, ["k"])
        assert got.count() == size and got.columns == df.columns
    nameless = df.withColumn("k", F.lit(None).cast("long"))
    assert sample_per_group(nameless, 0.25, ["k"]).count() == 750


def test_slots_rise_with_the_hash_and_the_last_one_is_small(spark):
    hashed = readings(spark, 200_000).select("country", hash_number(F.col("n"), 42).alias("_hash"))
    slotted = hashed.withColumn("_slot", sample._slot("_hash", 0.3))
    before = F.lag("_slot").over(Window.partitionBy("country").orderBy("_hash"))
    assert slotted.withColumn("_before", before).where(F.col("_before") > F.col("_slot")).count() == 0
    assert slotted.select("_slot").distinct().count() < 800
    hot = slotted.where("country = 'hot'").groupBy("_slot").count().orderBy("_slot").collect()
    seen = 0
    for r in hot:
        seen += r["count"]
        if seen >= 30_000:
            assert r["count"] < 1000
            break
    corner = spark.createDataFrame([(h,) for h in (0, 1, 2, (1 << 48) - 1)], "_hash long").select(sample._slot("_hash", 0.0).alias("a"), sample._slot("_hash", 1.0).alias("b"))
    rows = corner.collect()
    assert [r.a for r in rows] == sorted(r.a for r in rows) and [r.b for r in rows] == sorted(r.b for r in rows)


def test_the_result_is_a_filter(spark):
    plan = sample_per_group(readings(spark, 5000), 0.2, ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
