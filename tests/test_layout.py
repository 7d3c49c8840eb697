import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.functions.ids import seeded_hex
from poolsift.operators import layout, sampling


def test_ordinals_within_a_hot_group(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 5 < 4, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        seeded_hex(1, F.col("id")).alias("h"),
    )
    got = layout.ordinals(df.repartition(9), layout.hex_bucket(F.col("h"), 2), ["h"], within=["g"])
    rows = got.toPandas().sort_values(["g", "h"])
    for _, part in rows.groupby("g"):
        assert part["ordinal"].tolist() == list(range(len(part)))


def test_running_sums_across_buckets(spark):
    rng = random.Random(0)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(10**6), 500)]
    df = spark.createDataFrame(rows, "shard_id long, size long").repartition(6)
    got = {r.shard_id: (r.data_start, r.all) for r in layout.exclusive_running_sum(df, "shard_id", "size", "data_start", total="all").collect()}
    start, total = 0, sum(s for _, s in rows)
    for shard, size in sorted(rows):
        assert got[shard] == (start, total)
        start += size


def test_ten_million_buckets_of_one_row(spark):
    sizes = spark.range(10_000_000).selectExpr("id * 70000 AS shard_id", "id % 7 AS size")
    got = layout.shard_offsets(sizes).selectExpr("shard_id div 70000 AS i", "data_start")
    assert got.where("data_start <> (i div 7) * 21 + (i % 7) * (i % 7 - 1) div 2").count() == 0


def test_no_window_over_a_whole_table(spark):
    rows = spark.range(50).selectExpr("md5(cast(id AS string)) AS h", "id AS shard_id", "1L AS size", "concat(id, '.tar') AS name", "id % 3 AS w")
    for df in (
        layout.shard_offsets(rows),
        layout.balanced_buckets(rows, 3),
        layout.assign_shards(rows, "h", 7),
        layout.assign_shards_by_size(rows, "w", ["h"], "size", 5, 100),
        layout.renumber_shards(rows),
        layout.ordinals(rows, layout.range_bucket(F.col("shard_id"), 4), ["shard_id"]),
    ):
        plan = df._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan or "Window" not in plan.split("SinglePartition")[0].rsplit("Exchange", 1)[0][-300:]
        df.collect()


@pytest.mark.parametrize("most, most_bytes", [(3, 1e9), (100, 50), (4, 30), (1, 1), (5, 0)])
def test_roll_over_agrees_with_a_loop(spark, most, most_bytes):
    rng = random.Random(most)
    rows = [(w, i, rng.choice([0, 1, 10, 40])) for w in range(5) for i in range(rng.choice([1, 30, 60]))]
    want, shard = {}, -1
    for w in range(5):
        count = None
        for _, i, size in [r for r in rows if r[0] == w]:
            if count is None or count >= most or filled >= most_bytes:
                shard, count, filled = shard + 1, 0, 0
            count, filled = count + 1, filled + size
            want[w, i] = shard
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = layout.assign_shards_by_size(spark.createDataFrame(rows, "w long, i long, size long").repartition(4), "w", ["i"], "size", most, most_bytes)
        assert {(r.w, r.i): r.shard_id for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bucket_border_goes_right(spark):
    sizes = spark.createDataFrame([(i, 5) for i in range(4)], "shard_id long, size long")
    got = {r.shard_id: r.bucket for r in layout.balanced_buckets(sizes, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


@pytest.mark.parametrize("k", [1, 3, 7])
def test_buckets_match_a_search_over_starts(spark, k):
    rng = np.random.default_rng(k)
    size = rng.integers(1, 50, 30)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = int(size.sum())
    cuts = [int(np.searchsorted(start, i)) for i in range(0, total, -(-total // k))] + [len(size)]
    want = {s: b for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) for s in range(lo, hi)}
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(size)], "shard_id long, size long")
    assert {r.shard_id: r.bucket for r in layout.balanced_buckets(df, k).collect()} == want


def test_assign_shards_fills_in_key_order(spark):
    df = spark.range(1005).select(seeded_hex(3, F.col("id")).alias("h"))
    rows = layout.assign_shards(df, "h", 100).toPandas().sort_values("h")
    assert rows["shard_id"].tolist() == [i // 100 for i in range(1005)]
    assert rows["position"].tolist() == [i % 100 for i in range(1005)]
    stats = {r.shard_id: r.successes for r in layout.shard_stats(layout.assign_shards(df, "h", 100)).collect()}
    assert stats == {**{i: 100 for i in range(10)}, 10: 5}


def test_byte_rule_rolls_like_a_writer(spark):
    rng = random.Random(5)
    rows = [(w, i, rng.choice([1, 10, 400, 900])) for w in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "w long, i long, b long").repartition(5)
    want, shard = {}, -1
    for w in range(4):
        count = filled = None
        for i, b in ((i, b) for ww, i, b in rows if ww == w):
            if count is None or count >= 7 or filled >= 1000:
                shard, count, filled = shard + 1, 0, 0
            count, filled = count + 1, filled + b
            want[w, i] = shard
    got = layout.assign_shards_by_size(df, "w", ["i"], "b", max_count=7, max_bytes=1000)
    assert {(r.w, r.i): r.shard_id for r in got.collect()} == want


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
def test_islands_are_stitched_over_ranges(spark, width):
    rng = random.Random(width)
    rows = [(s, i, rng.choice("aab")) for s in ("x", "y") for i in sorted(rng.sample(range(100), 40))]
    want = {}
    for s in ("x", "y"):
        island, last = -1, None
        for _, i, p in (r for r in rows if r[0] == s):
            island, last = island + (p != last), p
            want[s, i] = island
    df = spark.createDataFrame(rows, "shard string, member_idx long, prefix string").repartition(4)
    assert {(r.shard, r.member_idx): r.island for r in layout.member_islands(df, width=width).collect()} == want


def test_catalogue_helpers(spark):
    cached = spark.createDataFrame([("a.tar", 5)], "shard_name string, size long")
    side = spark.createDataFrame([("a.tar", 9), ("b.tar", 2)], "shard_name string, size long")
    assert {tuple(r) for r in layout.shard_sizes(cached, side).collect()} == {("a.tar", 5), ("b.tar", 2)}
    found = spark.createDataFrame([(3,), (5,), (9,)], "shard_id long")
    assert sorted(r[0] for r in layout.missing_shards(found, 3, 4).collect()) == [4, 6]
    names = spark.createDataFrame([("d/s007.tar",), ("d/s012.tar",), ("e0001.tar",), ("x.txt",), ("nonum.tar",)], "name string")
    assert {r.shard_range for r in layout.shard_ranges(names).collect()} == {"d/s{000..012}.tar", "e{0000..0001}.tar"}
    manifest = spark.createDataFrame([(13,)], "output_shard_count long")
    assert layout.manifest_range(manifest).first()[0] == "{00000000..00000012}.tar"
    old = spark.createDataFrame([(f"{i:08d}.tar",) for i in (7, 3, 20000, 1999)], "name string")
    assert {r.name: r.new_name for r in layout.renumber_shards(old).collect()} == {
        "00000003.tar": "00000000.tar", "00000007.tar": "00000001.tar",
        "00001999.tar": "00000002.tar", "00020000.tar": "00000003.tar",
    }


def test_sampling_is_exact_and_reproducible(spark):
    df = spark.range(900).select(
        seeded_hex(0, F.col("id")).alias("uid"),
        F.when(F.col("id") < 600, "big").when(F.col("id") < 897, "mid").otherwise("tiny").alias("source"),
    )
    got = sampling.sample_with_replacement(df.repartition(7), "source", 0.3, seed=1)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert counts == {"big": 180, "mid": 89}  # int(3 * 0.3) is 0, that group vanishes
    again = sampling.sample_with_replacement(df.coalesce(1), "source", 0.3, seed=1)
    key = lambda d: sorted((r.source, r.draw, r.uid) for r in d.collect())
    assert key(got) == key(again)
    assert key(got) != key(sampling.sample_with_replacement(df, "source", 0.3, seed=2))
    assert sampling.sample_with_replacement(df, "source", 0.0, seed=1).count() == 900
    mixed = sampling.mix_sources(df, "source", {"big": 1.0, "tiny": 3.0, "gone": 9.0}, 10_001, seed=1)
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == {"big": 2500, "tiny": 7500}
    assert sampling.sample_to_budget(df, 5000, seed=1).count() == 5000
    shuffled = [r.uid for r in sampling.seeded_shuffle(df, 4).collect()]
    assert shuffled == [r.uid for r in sampling.seeded_shuffle(df.repartition(3), 4).collect()]
    assert sorted(shuffled) == sorted(r.uid for r in df.collect()) != shuffled
