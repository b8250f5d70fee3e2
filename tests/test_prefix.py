import random

from pyspark.sql import functions as F

from shardloom.operators.prefix import ordered_index, prefix_agg


def test_prefix_aggregates_match_a_walk(spark):
    rng = random.Random(1)
    rows = [("hot", k, rng.randint(0, 50)) for k in rng.sample(range(5_000), 600)]
    rows += [(f"g{i}", k, rng.randint(0, 50)) for i in range(5) for k in rng.sample(range(200), 20)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    aggs = {"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}
    for fan, levels in ((16, 2), (8, 3), (1 << 20, 2), (16, 1)):
        got = {(r.g, r.k): (r.total, r.low, r.high) for r in prefix_agg(df, ["g"], "k", aggs, fan, levels).collect()}
        want = {}
        for group in {g for g, _, _ in rows}:
            seen = []
            for _, k, v in sorted(r for r in rows if r[0] == group):
                want[group, k] = (sum(seen), min(seen, default=None), max(seen, default=None))
                seen.append(v)
        assert got == want


def test_ordered_index_ranks_each_group(spark, stager):
    df = spark.range(1_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.md5(F.col("id").cast("string")).alias("k"),
    )
    rows = ordered_index(df, ["g"], ["k"], "place", stager).collect()
    for group in {r.g for r in rows}:
        ordered = sorted((r for r in rows if r.g == group), key=lambda r: r.k)
        assert [r.place for r in ordered] == list(range(len(ordered)))


def test_ordered_index_without_groups(spark, stager):
    rows = ordered_index(spark.range(100).select((F.col("id") * 37 % 101).alias("k")), [], ["k"], "place", stager).collect()
    assert [r.place for r in sorted(rows, key=lambda r: r.k)] == list(range(100))
