from collections import Counter

from pyspark.sql import functions as F

from poolsift.operators import metadata, subsets


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "uid string")


def bag(df):
    return Counter(r.uid for r in df.collect())


def test_expand_repeats_every_pool_row(spark):
    pool = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "uid string, row int")
    got = subsets.expand_subset(pool, ids(spark, ["a", "a", "a", "b", "z"])).collect()
    assert Counter((r.row, r.copy) for r in got) == Counter([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0)])
    assert {r.sample_key for r in got if r.row == 3} == {"b-0"}


def test_a_hot_id_unfolds_in_blocks(spark):
    n = 3 * subsets.COPY_BLOCK + 7
    hot = spark.range(n).select(F.lit("a").alias("uid"))
    pool = ids(spark, ["a", "b"])
    got = subsets.expand_subset(pool, hot)
    row = got.agg(F.count(F.lit(1)), F.countDistinct("copy"), F.min("copy"), F.max("copy")).first()
    assert tuple(row) == (n, n, 0, n - 1)
    assert subsets.expand_subset(pool, hot).count() == pool.join(hot, "uid").count()


def test_a_salted_id_keeps_all_copies(spark):
    n = 5 * subsets.COPY_BLOCK + 11
    wanted = spark.range(n).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("uid"))
    pool = wanted.distinct().unionAll(ids(spark, ["hot", "unasked"])).withColumn("row", F.monotonically_increasing_id())
    got = subsets.expand_subset(pool, wanted, hot_copies=subsets.COPY_BLOCK)
    hot = got.filter("uid = 'hot'").groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m")).collect()
    copies = wanted.filter("uid = 'hot'").count()
    assert [(r.n, r.d, r.m) for r in hot] == [(copies, copies, copies - 1)] * 2
    assert got.count() == pool.join(wanted, "uid").count()


def test_sorted_subset_spreads_a_hot_id(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit("7" * 32)).otherwise(F.md5(F.col("id").cast("string"))).alias("uid"))
    got = [r.uid for r in subsets.sorted_subset(rows).collect()]
    assert got == sorted(r.uid for r in rows.collect())


def test_multiset_algebra(spark):
    a, b = ["x", "x", "x", "y", "z"], ["x", "x", "z", "z", "w"]
    left, right = ids(spark, a), ids(spark, b)
    assert bag(subsets.intersect_subsets(left, right)) == Counter("xz")
    assert bag(subsets.intersect_subsets(left, right, multiset=True)) == Counter(a) & Counter(b)
    assert bag(subsets.subtract_subset(left, right)) == Counter("y")
    assert bag(subsets.subtract_subset(left, right, multiset=True)) == Counter(a) - Counter(b)
    assert bag(subsets.unite_subsets(left, right)) == Counter("xyzw")
    assert bag(subsets.unite_subsets(left, right, distinct=False)) == Counter(a) + Counter(b)


def test_audit_counts(spark):
    pool, wanted = ids(spark, ["a", "a", "b", "c"]), ids(spark, ["a", "a", "b", "z", "z"])
    row = subsets.subset_audit(pool, wanted).first()
    assert (row.processed, row.requested, row.output, row.unmatched_ids) == (4, 5, 5, 1)
    assert {tuple(r) for r in subsets.subset_unmatched(wanted, pool).collect()} == {("z", 2)}


def test_sorted_subset_is_canonical(spark):
    got = [r.uid for r in subsets.sorted_subset(ids(spark, ["F" * 31, "1" + "0" * 31, "0" + "f" * 31])).collect()]
    assert got == ["0" + "f" * 31, "0" + "f" * 31, "1" + "0" * 31]


def test_left_join_fans_out_and_counts(spark):
    rows = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2")], "uid string, text string")
    meta = spark.createDataFrame([("a", "m1"), ("a", "m2"), ("d", "m3")], "uid string, text string")
    assert metadata.reduce_metadata(meta, rows).count() == 2
    joined = metadata.join_metadata(rows, meta)
    got = {(r.uid, r.meta_uid, r.meta_text, r.matched) for r in joined.collect()}
    assert got == {("a", "a", "m1", True), ("a", "a", "m2", True), ("b", None, None, False), ("c", None, None, False)}
    rate = metadata.match_rate(joined).first()
    assert (rate.total_rows, rate.matched_rows, rate.matched_percent) == (4, 2, 50.0)
    assert metadata.match_rate(joined.limit(0)).first().matched_percent is None


def test_positional_join_reports_uneven_files(spark):
    meta = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("g", 0, "c")], "file_stem string, row_idx long, uid string")
    vecs = spark.createDataFrame([("f", 0, 1.0), ("g", 0, 2.0)], "file_stem string, row_idx long, v double")
    assert {(r.uid, r.v) for r in metadata.join_by_position(meta, vecs).collect()} == {("a", 1.0), ("c", 2.0)}
    assert [tuple(r) for r in metadata.position_mismatch(meta, vecs).collect()] == [("f", 2, 1)]


def test_boxes_are_attached_and_written(spark):
    samples = spark.createDataFrame(
        [("a", '{"uid":"a","n":[1,{"k":2.50}],"face_bboxes":[]}'), ("b", '{"uid":"b"}'), ("c", '{"uid":"c"}')],
        "uid string, json string",
    )
    boxes = spark.createDataFrame([("a", [[0.5, 1.0]]), ("b", [])], "uid string, face_bboxes array<array<double>>")
    joined = metadata.attach_boxes(samples, boxes)
    flags = {r.uid: (r.box_missing, r.face_bboxes) for r in joined.collect()}
    assert flags == {"a": (False, [[0.5, 1.0]]), "b": (False, None), "c": (True, None)}
    import json

    texts = {r.uid: json.loads(r.json) for r in metadata.inject_boxes(joined).collect()}
    assert texts["a"] == {"uid": "a", "n": [1, {"k": 2.5}], "face_bboxes": [[0.5, 1.0]]}
    assert texts["b"] == {"uid": "b"} and texts["c"] == {"uid": "c"}


def test_blur_map_last_entry_wins(spark):
    text = '{"1": {"parquet": "p1", "shards": ["in/a.tar", "other/b.tar"]}, "2": {"parquet": "p2", "shards": ["in/a.tar", "in/c.tar"]}}'
    df = spark.createDataFrame([(text,)], "value string")
    got = {tuple(r) for r in metadata.invert_blur_map(df, input_dir="in/").collect()}
    assert got == {("a.tar", "p2"), ("c.tar", "p2")}
    assert metadata.invert_blur_map(df).count() == 3
