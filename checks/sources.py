"""Files: tar shards, CSV, checksums, and the streaming forms."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import check
from checks.captions import STATUS_SQL, outcomes
from checks.filters import BASIC_SQL
from checks.views import boxes, centroids, doc_uid, pool, shard_rows, subset, table
from poolsift.functions.text import path_stem
from poolsift.operators.filters import basic_filter
from poolsift.operators.layout import assign_shards
from poolsift.operators.metadata import join_metadata
from poolsift.operators.metrics.rollup import latest_results
from poolsift.plans.resharding import reshard
from poolsift.session import run_dir
from poolsift.sources import audit, csv_files, images, tables, tars
from poolsift.sources.images import classify_images
from poolsift.sources.storage import atomic_output, write_text
from poolsift.sources.vector_files import embed_with, write_vectors
from poolsift.streaming import incremental

SHARD_SIZE = 500


def write_pool_shards(spark, sf) -> str:
    """The whole pool as tar shards: a JSON member and the text of each document."""
    rows = pool(spark, sf).select("uid", "doc_id", "text")
    placed = assign_shards(rows, "uid", SHARD_SIZE)
    samples = placed.select(
        "shard_id",
        "position",
        F.format_string("%05d%04d", "shard_id", "position").alias("key"),
        F.create_map(
            F.lit("json"),
            F.encode(F.to_json(F.struct("uid", "doc_id")), "utf-8"),
            F.lit("txt"),
            F.encode("text", "utf-8"),
        ).alias("members"),
    )
    folder = run_dir(spark, "shards")
    tars.write_samples(samples, folder, shards=1 + rows.count() // SHARD_SIZE)
    return folder


@check(
    "tar_members",
    f"""
    SELECT uid, shard, suffix, size FROM (
        SELECT uid, lpad(CAST(CAST(floor((row_number() OVER (ORDER BY uid) - 1) / {SHARD_SIZE}) AS BIGINT) AS VARCHAR), 8, '0') || '.tar' AS shard,
            octet_length(encode(text)) AS size, 'txt' AS suffix FROM pool)
    """,
)
def tar_members(spark, sf):
    members = tars.read_members(spark, write_pool_shards(spark, sf))
    ids = members.filter("suffix = 'json'").select(
        "prefix", "shard", F.get_json_object(F.decode("data", "utf-8"), "$.uid").alias("uid")
    )
    texts = members.filter("suffix = 'txt'").select("prefix", "shard", "suffix", F.octet_length("data").cast("bigint").alias("size"))
    return texts.join(ids, ["shard", "prefix"]).select("uid", "shard", "suffix", "size")


@check(
    "tar_samples",
    "SELECT uid, doc_id, md5(text) AS text_md5, CAST(2 AS INTEGER) AS members FROM pool",
)
def tar_samples(spark, sf):
    samples = tars.read_samples(spark, write_pool_shards(spark, sf))
    fields = F.decode(F.col("members")["json"], "utf-8")
    return samples.select(
        F.get_json_object(fields, "$.uid").alias("uid"),
        F.get_json_object(fields, "$.doc_id").cast("bigint").alias("doc_id"),
        F.md5(F.col("members")["txt"]).alias("text_md5"),
        F.size("members").alias("members"),
    )


@check(
    "tar_reshard",
    """
    SELECT p.uid, p.uid || '-' || CAST(c.copy AS VARCHAR) AS key, md5(p.text) AS text_md5,
        CASE WHEN len(b.face_bboxes) > 0 THEN b.face_bboxes[1][1] END AS x
    FROM pool p JOIN (SELECT uid, row_number() OVER (PARTITION BY uid) - 1 AS copy FROM subset) c ON p.uid = c.uid
    LEFT JOIN boxes b ON p.uid = b.uid
    """,
)
def tar_reshard(spark, sf):
    """Shards, subset and boxes to new shards, over those of a larger run, read back."""
    folder = run_dir(spark, "resharded")
    shards = write_pool_shards(spark, sf)
    reshard(spark, shards, subset(spark, sf).unionAll(subset(spark, sf)), folder, SHARD_SIZE)
    reshard(spark, shards, subset(spark, sf), folder, SHARD_SIZE, boxes=boxes(spark, sf), overwrite=True)
    samples = tars.read_samples(spark, folder)
    fields = F.decode(F.col("members")["json"], "utf-8")
    return samples.select(
        F.get_json_object(fields, "$.uid").alias("uid"),
        "key",
        F.md5(F.col("members")["txt"]).alias("text_md5"),
        F.get_json_object(fields, "$.face_bboxes[0][0]").cast("double").alias("x"),
    )


@check("csv_roundtrip", "SELECT page_id, url, length(html) AS chars FROM pages")
def csv_roundtrip(spark, sf):
    """Pages as CSV (with quotes and line breaks inside of fields), read in ranges of 64 KB."""
    rows = table(spark, sf, "pages").select("page_id", "url", "html")
    folder = run_dir(spark, "csv")
    tables.write_csv(rows, folder)
    back = csv_files.read_csv(spark, folder, rows.schema, range_bytes=1 << 16)
    return back.select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@check("csv_rejects", "SELECT count(*) AS rejected, CAST(sum(length(url)) AS BIGINT) AS chars FROM pages WHERE page_id % 5 = 0")
def csv_rejects(spark, sf):
    """Every fifth page written with a number that is none: rejected with its text."""
    bad = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("no. "), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string"))
    rows = table(spark, sf, "pages").select(bad.alias("page_id"), "url")
    folder = run_dir(spark, "csv")
    tables.write_csv(rows, folder)
    found = csv_files.rejected(spark, folder, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())]), 1 << 16)
    url = F.regexp_extract("record", r'^"no[.] [0-9]+","(.*)"$', 1)
    return found.agg(F.count(F.lit(1)).alias("rejected"), F.sum(F.length(url)).cast("bigint").alias("chars"))


@check(
    "file_audit",
    """
    WITH files AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents),
    manifest AS (
        SELECT 'doc/' || CAST(l.doc_id AS VARCHAR) AS path, d.n_chars AS size, sha256(d.text) AS sha256 FROM labels l JOIN documents d USING (doc_id)
        UNION ALL SELECT 'item/' || CAST(item_id AS VARCHAR), length(text), sha256(text) FROM benchmark)
    SELECT coalesce(f.path, m.path) AS path, f.size, CASE WHEN m.path IS NULL THEN 'unexpected' WHEN f.path IS NULL THEN 'missing'
        WHEN f.size <> m.size THEN 'size_mismatch' WHEN f.sha256 <> m.sha256 THEN 'hash_mismatch' ELSE 'ok' END AS status
    FROM files f FULL JOIN manifest m ON f.path = m.path
    """,
)
def file_audit(spark, sf):
    """Texts written as files and hashed there; a manifest that counts characters instead of bytes."""
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")
    sha = F.sha2("text", 256).alias("sha256")
    folder = run_dir(spark, "files")

    def write(batches):
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                write_text(f"{folder}/{name}", text)
            yield batch.select([0])

    names = docs.select(path, "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    names.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    files = audit.checksums(spark, folder).withColumn("path", F.substring_index("path", "/", -2))
    listed = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").select(path, F.col("n_chars").alias("size"), sha)
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("path"), F.length("text").cast("bigint").alias("size"), sha
    )
    return audit.audit_files(files, listed.unionByName(items))


@check(
    "folder_sizes",
    "SELECT source AS dir, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source",
)
def folder_sizes(spark, sf):
    files = table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "doc_id").alias("path"), F.octet_length("text").cast("bigint").alias("size")
    )
    return audit.folder_sizes(files)


@check(
    "image_listing",
    """
    SELECT 'img/' || source || '/' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.JPG' WHEN 'fr' THEN '.webp' ELSE '.txt' END AS path,
        n_chars * 4096 AS length, 'img/' || source AS dir, CAST(doc_id AS VARCHAR) AS stem,
        CASE WHEN n_chars * 4096 <= 20971520 THEN 'ok' ELSE 'too_large' END AS status
    FROM documents WHERE lang IN ('en', 'fr')
    """,
)
def image_listing(spark, sf):
    """A listing of files named and sized after the documents."""
    suffix = F.when(F.col("lang") == "en", ".JPG").when(F.col("lang") == "fr", ".webp").otherwise(".txt")
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("img/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        (F.col("n_chars") * 4096).alias("length"),
    )
    return classify_images(files)


DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def _with_sides(df):
    chars = F.col("n_chars")
    return df.withColumns(
        {
            "uid": doc_uid(),
            "original_width": F.when(chars >= 20, 64 + (chars * 37) % 1000).cast("int"),
            "original_height": (64 + (chars * 53) % 800).cast("int"),
        }
    )


@check("stream_filter", f"SELECT uid, doc_id FROM pool WHERE {BASIC_SQL}")
def stream_filter(spark, sf):
    """The basic filter over newly arrived files."""
    folder = run_dir(spark, "stream")
    # a table is one file or a folder of files of any name; a stream takes a file only by a pattern
    stream = incremental.read_pool_stream(spark, f"{sf}/documents.parque[t]", DOCUMENTS, glob="*")
    incremental.filter_new_files(
        stream,
        lambda df: basic_filter(_with_sides(df)).select("uid", "doc_id"),
        f"{folder}/out",
        f"{folder}/checkpoint",
    )
    return spark.read.schema("uid string, doc_id bigint").parquet(f"{folder}/out")


@check("stream_resume", "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents")
def stream_resume(spark, sf):
    """Work once per key, over batches and runs whose files share keys."""
    folder = run_dir(spark, "resume")
    docs = table(spark, sf, "documents")
    for half in (docs.where("doc_id % 3 < 2"), docs.where("doc_id % 3 > 0")):
        # as many files as the table has parts, so none grows with it; two batches a run
        files = max(2, half.rdd.getNumPartitions())
        half.repartition(files).write.mode("append").parquet(f"{folder}/in")
        stream = incremental.read_pool_stream(spark, f"{folder}/in", DOCUMENTS, files_per_batch=(files + 1) // 2)
        incremental.process_once_per_key(
            stream,
            "doc_id",
            lambda df: df.select("doc_id", F.length("text").alias("chars")),
            f"{folder}/out",
            f"{folder}/checkpoint",
        )
    return spark.read.parquet(f"{folder}/out").select("doc_id", "chars")


@check("boxes_file", "SELECT uid, len(face_bboxes) AS n, face_bboxes[1][1] AS x FROM boxes")
def boxes_file(spark, sf):
    """Face boxes under ids in capitals, written and read with canonical ids."""
    folder = run_dir(spark, "boxes")
    boxes(spark, sf).withColumn("uid", F.upper("uid")).write.parquet(folder)
    back = tables.read_boxes(spark, folder)
    return back.select("uid", F.size("face_bboxes").cast("bigint").alias("n"), F.get(F.get("face_bboxes", F.lit(0)), F.lit(0)).alias("x"))


@check("word_list", "SELECT DISTINCT lang || '-' || source AS value FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def word_list(spark, sf):
    """A list with blanks at the ends and empty lines, as text files."""
    folder = run_dir(spark, "words")
    value = F.concat(F.lit("  "), "lang", F.lit("-"), "source", F.lit(" \n"))
    table(spark, sf, "documents").select(value.alias("value")).distinct().dropna().write.text(folder)
    return tables.read_lines(spark, folder)


@check("entity_ids", "SELECT CAST(item_id AS INTEGER) AS synset_offset FROM benchmark")
def entity_ids(spark, sf):
    folder = run_dir(spark, "entities")
    table(spark, sf, "benchmark").select(F.format_string("n%08d", "item_id").alias("value")).write.text(folder)
    return tables.read_entity_ids(spark, folder)


@check("lines_in_files", "SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n FROM benchmark")
def lines_in_files(spark, sf):
    """Lines per text file, added up over the files."""
    folder = run_dir(spark, "lines")
    table(spark, sf, "benchmark").select("text").repartition(3).write.text(folder)
    return tables.lines_per_file(spark, folder).agg(F.sum("n").alias("n"))


@check("sidecar_texts", "SELECT CAST(item_id AS VARCHAR) AS stem, length(trim(text)) AS chars FROM benchmark")
def sidecar_texts(spark, sf):
    """Texts next to images: every second one in Latin-1 where it can be."""
    folder = run_dir(spark, "sidecars")

    def write(batches):
        for batch in batches:
            for number, text in zip(*(c.to_pylist() for c in batch.columns)):
                latin = number % 2 and text.encode("latin-1", "replace").decode("latin-1") == text
                with atomic_output(f"{folder}/{number % 10}/{number}.txt") as out:
                    out.write(text.encode("latin-1" if latin else "utf-8"))
            yield batch.select([0])

    rows = table(spark, sf, "benchmark").select("item_id", "text").repartition(4)
    rows.mapInArrow(write, "item_id long").write.format("noop").mode("overwrite").save()
    texts = images.read_sidecars(spark, folder)
    return texts.select(path_stem(F.col("path")).alias("stem"), F.length("alt_text").cast("bigint").alias("chars"))


@check("results_appended", "SELECT 'd' || CAST(item_id AS VARCHAR) AS dataset, item_id / 8.0::DOUBLE AS acc1 FROM benchmark")
def results_appended(spark, sf):
    """Result lines appended twice; the later ones count."""
    folder = run_dir(spark, "results")
    rows = table(spark, sf, "benchmark").select(
        F.lit("k").alias("key"), F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("dataset"), (F.col("item_id") / 8).alias("acc1")
    )
    for value in (F.lit(0.0), F.col("acc1")):
        tables.append_results(rows.select("key", "dataset", F.create_map(F.lit("acc1"), value, F.lit("acc5"), F.lit(None).cast("double")).alias("metrics")), folder)
    latest = latest_results(tables.read_results(spark, folder))
    return latest.select("dataset", F.try_element_at("metrics", F.lit("acc1")).alias("acc1"))


@check("failed_file", f"SELECT event_id, status FROM ({STATUS_SQL}) WHERE status = 'failed'")
def failed_file(spark, sf):
    """The error side file, written and read back."""
    folder = run_dir(spark, "failed")
    rows = outcomes(spark, sf).select("event_id", "status")
    tables.write_failed(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@check(
    "joined_shards",
    """
    SELECT s.uid, s.shard, p.lang, p.uid IS NOT NULL AS matched FROM shard_rows s LEFT JOIN pool p ON s.uid = p.uid
    """,
)
def joined_shards(spark, sf):
    """Shards joined with their metadata, one folder per shard, read back as one table."""
    folder = run_dir(spark, "joined")
    rows = shard_rows(spark, sf)
    tables.write_joined_shards(join_metadata(rows, pool(spark, sf).select("uid", "lang")), folder)
    return spark.read.parquet(folder).select("uid", "shard", "lang", "matched")


@check(
    "vector_file",
    "SELECT centroid_id, round(list_sum(centroid), 5) AS total FROM centroids",
)
def vector_file(spark, sf):
    """Centroids as the file every operator reads."""
    folder = run_dir(spark, "centroids")
    write_vectors(centroids(spark, sf), folder)
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(folder).select("centroid_id", F.round(total, 5).alias("total"))


@check("user_model", "SELECT doc_id, length(text)::DOUBLE AS chars, len(string_split(text, ' '))::DOUBLE AS words FROM documents WHERE text IS NOT NULL")
def user_model(spark, sf):
    """A user's function over batches: two figures per text in place of a model's vector."""

    def model(frames):
        for frame in frames:
            frame["vec"] = [[float(len(t)), float(len(t.split(" ")))] for t in frame.pop("text")]
            yield frame

    texts = table(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL")
    rows = embed_with(texts, model, "doc_id long, vec array<double>")
    return rows.select("doc_id", F.get("vec", F.lit(0)).alias("chars"), F.get("vec", F.lit(1)).alias("words"))
