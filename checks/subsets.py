"""Subset algebra and metadata joins."""

from pyspark.sql import functions as F

from checks.base import check
from checks.views import boxes, foreign_ids, labelled, pool, shard_rows, subset, table
from poolsift.operators import metadata, subsets
from poolsift.session import run_dir
from poolsift.sources.subset_files import read_subset, write_subset
from poolsift.sources.tables import union_sources


@check(
    "subset_expand",
    """
    SELECT p.uid, p.source, c.copy, p.uid || '-' || CAST(c.copy AS VARCHAR) AS sample_key
    FROM pool p JOIN (SELECT uid, row_number() OVER (PARTITION BY uid) - 1 AS copy FROM subset) c ON p.uid = c.uid
    """,
)
def subset_expand(spark, sf):
    rows = pool(spark, sf).select("uid", "source")
    return subsets.expand_subset(rows, subset(spark, sf))


@check("subset_roundtrip", "SELECT uid FROM subset")
def subset_roundtrip(spark, sf):
    """Written as packed 16-byte records over a larger subset, and read back."""
    folder = run_dir(spark, "subset")
    write_subset(subset(spark, sf).unionAll(subset(spark, sf)), folder)
    write_subset(subset(spark, sf), folder)
    return read_subset(spark, folder)


@check("subset_intersect", "SELECT uid FROM subset INTERSECT SELECT uid FROM pool")
def subset_intersect(spark, sf):
    return subsets.intersect_subsets(subset(spark, sf), pool(spark, sf))


@check("subset_intersect_all", "SELECT uid FROM subset INTERSECT ALL (SELECT uid FROM pool UNION ALL SELECT uid FROM labelled)")
def subset_intersect_all(spark, sf):
    other = subsets.unite_subsets(pool(spark, sf), labelled(spark, sf), distinct=False)
    return subsets.intersect_subsets(subset(spark, sf), other, multiset=True)


@check("subset_difference", "SELECT uid FROM subset EXCEPT ALL SELECT uid FROM labelled")
def subset_difference(spark, sf):
    return subsets.subtract_subset(subset(spark, sf), labelled(spark, sf), multiset=True)


@check("subset_unmatched", "SELECT uid, count(*) AS copies FROM subset WHERE uid NOT IN (SELECT uid FROM pool) GROUP BY uid")
def subset_unmatched(spark, sf):
    return subsets.subset_unmatched(subset(spark, sf), pool(spark, sf))


@check(
    "reshard_audit",
    """
    SELECT (SELECT count(*) FROM pool) AS processed, (SELECT count(*) FROM subset) AS requested,
        (SELECT count(*) FROM subset JOIN pool USING (uid)) AS output,
        (SELECT count(DISTINCT uid) FROM subset WHERE uid NOT IN (SELECT uid FROM pool)) AS unmatched_ids
    """,
)
def reshard_audit(spark, sf):
    return subsets.subset_audit(pool(spark, sf), subset(spark, sf))


@check("distinct_uids", "SELECT uid FROM shard_rows UNION SELECT uid FROM subset")
def distinct_uids(spark, sf):
    return metadata.distinct_uids(shard_rows(spark, sf), subset(spark, sf))


@check("meta_semi", "SELECT uid, lang, source FROM pool WHERE uid IN (SELECT uid FROM shard_rows)")
def meta_semi(spark, sf):
    return metadata.reduce_metadata(pool(spark, sf), shard_rows(spark, sf)).select("uid", "lang", "source")


@check(
    "shard_meta_join",
    """
    SELECT s.uid, s.shard, p.uid AS meta_uid, p.lang, p.clip_b32_similarity_score, p.uid IS NOT NULL AS matched
    FROM shard_rows s LEFT JOIN pool p ON s.uid = p.uid
    """,
)
def shard_meta_join(spark, sf):
    rows = shard_rows(spark, sf)
    slim = pool(spark, sf).select("uid", "lang", "clip_b32_similarity_score")
    return metadata.join_metadata(rows, metadata.reduce_metadata(slim, rows))


@check(
    "match_rate",
    """
    SELECT count(*) AS total_rows, count(p.uid) AS matched_rows, round(100.0::DOUBLE * count(p.uid) / count(*), 6) AS matched_percent
    FROM shard_rows s LEFT JOIN pool p ON s.uid = p.uid
    """,
)
def match_rate(spark, sf):
    rate = metadata.match_rate(metadata.join_metadata(shard_rows(spark, sf), pool(spark, sf).select("uid")))
    return rate.withColumn("matched_percent", F.round("matched_percent", 6))


@check(
    "bbox_attach",
    """
    SELECT p.uid, b.uid IS NULL AS box_missing, CAST(CASE WHEN len(face_bboxes) > 0 THEN len(face_bboxes) END AS INTEGER) AS n_boxes,
        CASE WHEN len(face_bboxes) > 0 THEN face_bboxes[1][1] END AS x
    FROM pool p LEFT JOIN boxes b ON p.uid = b.uid
    """,
)
def bbox_attach(spark, sf):
    rows = metadata.attach_boxes(pool(spark, sf).select("uid"), boxes(spark, sf))
    return rows.select(
        "uid",
        "box_missing",
        F.when(F.col("face_bboxes").isNotNull(), F.size("face_bboxes")).alias("n_boxes"),
        F.get(F.get("face_bboxes", F.lit(0)), F.lit(0)).alias("x"),
    )


@check(
    "bbox_inject",
    """
    SELECT p.uid, p.uid AS json_uid, p.doc_id AS json_doc,
        CASE WHEN len(face_bboxes) > 0 THEN face_bboxes[1][1] END AS x, coalesce(len(face_bboxes), 0) > 1 AS more
    FROM pool p LEFT JOIN boxes b ON p.uid = b.uid
    """,
)
def bbox_inject(spark, sf):
    rows = pool(spark, sf).select("uid", F.to_json(F.struct("uid", "doc_id", "text")).alias("json"))
    written = metadata.inject_boxes(metadata.attach_boxes(rows, boxes(spark, sf)))
    field = lambda path: F.get_json_object("json", path)
    return written.select(
        "uid",
        field("$.uid").alias("json_uid"),
        field("$.doc_id").cast("bigint").alias("json_doc"),
        field("$.face_bboxes[0][0]").cast("double").alias("x"),
        field("$.face_bboxes[1]").isNotNull().alias("more"),
    )


@check(
    "blur_map_invert",
    """
    SELECT 'p' || CAST(partkey AS VARCHAR) || '.tar' AS shard_name, 'part/' || CAST(max(suppkey) AS VARCHAR) || '.parquet' AS parquet
    FROM (SELECT l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem) GROUP BY partkey
    """,
)
def blur_map_invert(spark, sf):
    """Suppliers as parquet files that list their parts as shards; the highest number wins."""
    listed = (
        table(spark, sf, "lineitem")
        .select(
            F.format_string("%012d", "l_suppkey").alias("entry"),
            F.concat(F.lit("in/p"), F.col("l_partkey").cast("string"), F.lit(".tar")).alias("path"),
            F.concat(F.lit("part/"), F.col("l_suppkey").cast("string"), F.lit(".parquet")).alias("parquet"),
        )
    )
    return metadata.invert_blur_entries(listed, input_dir="in")


@check(
    "multi_source_union",
    "SELECT 'labelled' AS source, uid FROM labelled UNION ALL SELECT 'foreign' AS source, uid FROM foreign_ids",
)
def multi_source_union(spark, sf):
    return union_sources({"labelled": labelled(spark, sf).select("uid"), "foreign": foreign_ids(spark, sf)}).select("source", "uid")
