import shutil

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import CATALOG
from poolsift.operators.filters import clip_threshold
from poolsift.streaming import incremental
from poolsift.streaming.key_store import KeyStore

SCHEMA = T.StructType(
    [T.StructField("uid", T.StringType()), T.StructField("clip_b32_similarity_score", T.DoubleType())]
)


def add(spark, folder, start, stop):
    rows = spark.range(start, stop).select(
        F.format_string("%032x", "id").alias("uid"), (F.col("id") % 10 / 10).alias("clip_b32_similarity_score")
    )
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_files_are_filtered_once_over_restarts(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    keep = lambda df: clip_threshold(df, "b32", 0.5)
    run = lambda: incremental.filter_new_files(
        incremental.read_pool_stream(spark, source, SCHEMA, files_per_batch=1), keep, out, check
    )
    add(spark, source, 0, 50)
    run()
    add(spark, source, 50, 100)
    run()
    run()
    got = sorted(r.uid for r in spark.read.parquet(out).collect())
    assert got == sorted(r.uid for r in keep(spark.read.parquet(source)).collect()) and len(got) == 50


def test_keys_are_worked_on_once(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    work = lambda df: df.select("uid", F.lit(1).alias("done"))
    run = lambda: incremental.process_once_per_key(
        incremental.read_pool_stream(spark, source, SCHEMA, files_per_batch=1), "uid", work, out, check
    )
    add(spark, source, 0, 40)
    add(spark, source, 20, 60)  # overlaps the first file
    run()
    add(spark, source, 50, 80)
    run()
    uids = [r.uid for r in spark.read.parquet(out).collect()]
    assert len(uids) == len(set(uids)) == 80


def keys_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "uid long")


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    sizes, files = [], []
    for batch in range(12):
        store = KeyStore(spark, str(tmp_path / "keys"), T.LongType(), per_bucket=20, most_files=3, first_buckets=16)
        rows = keys_of(spark, *range(batch * 100, batch * 100 + 100))
        asked = rows.where("uid % 100 < 4").unionAll(keys_of(spark, 0, 1))  # few keys, two of them old
        left = sorted(r.uid for r in store.without_seen(asked.distinct(), "uid", batch).collect())
        assert left == ([0, 1, 2, 3] if batch == 0 else [batch * 100 + i for i in range(4)])
        sizes.append(store.bytes_read)
        store.add(rows, batch)
        files.append(store.layout["buckets"])
    # the keys grow twelvefold, what six keys read does not
    assert max(sizes[8:]) <= 2 * max(sizes[3:6]) and files[-1] > files[0]
    total = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "keys"))
    assert total.select("key").distinct().count() == 1200
    assert len(list((tmp_path / "keys").glob("gen=*"))) == 1


def test_replays_and_merges_change_nothing(spark, tmp_path):
    make = lambda: KeyStore(spark, str(tmp_path / "keys"), T.LongType(), most_files=2, first_buckets=1)
    for batch in range(5):
        make().add(keys_of(spark, batch), batch)
        make().add(keys_of(spark, batch), batch)  # replayed
    store = make()
    assert store.without_seen(keys_of(spark, 3, 4, 9), "uid", 4).orderBy("uid").collect() == [(4,), (9,)]  # only earlier batches count
    assert len([f for f in (tmp_path / "keys").rglob("*.parquet")]) == 1
    assert make().without_seen(keys_of(spark, 3, 4, 9), "uid", 5).collect() == [(9,)]
    assert make().without_seen(keys_of(spark), "uid", 5).collect() == []


def documents(spark, folder, files):
    rows = spark.range(900).select(
        F.col("id").alias("doc_id"), F.expr("repeat('some words ', 1 + cast(id % 50 as int))").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")
    )
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).repartition(files)
    rows.write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id for r in rows.collect()}


def test_the_filter_reads_a_table_that_is_a_folder_of_files_or_one_file(spark, tmp_path):
    documents(spark, tmp_path / "many", 3)
    documents(spark, tmp_path / "one", 1)
    (part,) = (tmp_path / "one" / "documents.parquet").glob("*.parquet")
    (tmp_path / "file").mkdir()
    shutil.copyfile(part, tmp_path / "file" / "documents.parquet")
    many, one = (sorted(tuple(r) for r in CATALOG["stream_filter"].run(spark, str(tmp_path / name)).collect()) for name in ("many", "file"))
    assert many == one and len(many) > 0


def test_resuming_writes_as_many_files_as_the_table_has_parts(spark, tmp_path, monkeypatch):
    want = documents(spark, tmp_path, 12)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # so each file is a part, as large ones are
    monkeypatch.setattr("checks.sources.run_dir", lambda spark, name: str(tmp_path / name))
    try:
        got = CATALOG["stream_resume"].run(spark, str(tmp_path))
        parts = spark.read.parquet(str(tmp_path / "documents.parquet")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want
    assert parts >= 12 and len(list((tmp_path / "resume" / "in").glob("*.parquet"))) == 2 * parts
    assert len(list((tmp_path / "resume" / "out").glob("batch_id=*"))) == 4
