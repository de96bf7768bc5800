"""Selections and dictionaries where one timestamp or one prefix holds nearly everything."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadcast.operators import positions
from loadcast.operators.encode import label_encode, label_fit
from loadcast.operators.positions import row_boundaries, with_buckets
from loadcast.operators.split import head_fraction, max_samples

V = "quantity_MW"


def one_timestamp(spark, n):
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    return spark.range(n).select(
        F.lit(1_700_000_000).cast("timestamp").alias("datetime"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), (mixed % 5).cast("string"))).alias("country"),
        F.when(F.col("id") % 7 > 0, mixed).alias("key"),
        F.col("id").alias("n"),
    )


def test_a_rank_inside_one_timestamp(spark):
    n = 50_000
    df = one_timestamp(spark, n).unionByName(one_timestamp(spark, 100).withColumn("datetime", F.lit(1_600_000_000).cast("timestamp")))
    order = ["country", "key", "n"]
    along = Window.orderBy("datetime", *[F.col(c).asc_nulls_first() for c in order])
    ranked = df.withColumn("rank", F.row_number().over(along))
    for rank in (1, 100, 101, 7777, n + 100):
        found = row_boundaries(df, [F.lit(rank)], order, rank_rows=2000)[0]
        row = ranked.where(F.col("rank") == rank).first()
        ties = spark.range(1).select(*[v.alias(c) for c, v in found["ties"].items()]).first()
        assert [ties[c] for c in order] == [row[c] for c in order]


def test_buckets_inside_one_timestamp_are_small(spark):
    df = one_timestamp(spark, 50_000).withColumn("_us", F.unix_micros("datetime"))
    cut = with_buckets(df, [], None, ["_us", "country", "key", "n"], "_b", 2000, 0, nulls_last=False)
    sizes = [r["count"] for r in cut.groupBy("_b").count().collect()]
    assert max(sizes) <= 2000 and sum(sizes) == 50_000


def test_heads_of_one_timestamp(spark, monkeypatch):
    monkeypatch.setattr(positions.row_boundaries, "__defaults__", ("datetime", 2000))
    df = one_timestamp(spark, 50_000)
    order = ["country", "key", "n"]
    along = [F.col(c).asc_nulls_first() for c in order]
    want = {r.n for r in df.orderBy("datetime", *along).limit(12_345).collect()}
    assert {r.n for r in max_samples(df, 12_345, order=order).collect()} == want
    assert head_fraction(df, 0.25).count() == 12_500


def test_labels_with_one_prefix_are_ranked_in_many_tasks(spark):
    n = 60_000
    label = F.concat(F.lit("the same long prefix "), F.lpad((F.col("id") * 7919 % n).cast("string"), 9, "0"))
    df = spark.range(n).select(label.alias("country"), (F.col("id") % 3).alias("year"))
    ranges = with_buckets(df.select(F.lit("country").alias("col"), F.col("country").alias("label")), ["col"], None, ["label"], "_b", 3000, 0)
    sizes = [r["count"] for r in ranges.groupBy("_b").count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 3000
    dictionary = label_fit(df, ["country", "year"], rows=3000, local_rows=100)
    local = label_fit(df, ["country", "year"], local_rows=10**6)
    assert dictionary.exceptAll(local).count() == 0 and dictionary.count() == local.count() == n + 1 + 3 + 1
    codes = label_encode(df, dictionary, ["country"]).agg(F.min("country"), F.max("country"), F.count_distinct("country")).first()
    assert tuple(codes) == (0, n - 1, n)
