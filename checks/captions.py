"""Caption tables and image files."""

from pyspark.sql import functions as F

from checks.base import check
from checks.views import caption_rows, conversations, images, sidecars, table
from poolsift.operators import captions


@check(
    "caption_match",
    """
    SELECT path, CAST(conv_id AS VARCHAR) AS stem, alt_text, caption, uid,
        CASE WHEN hit THEN 'matched' ELSE 'no_caption_match' END AS status FROM matched_captions
    """,
)
def caption_match(spark, sf):
    return captions.match_captions(images(spark, sf), caption_rows(spark, sf), sidecars(spark, sf))


@check(
    "caption_merge",
    """
    SELECT c.filename, c.caption, f.new_caption FROM (
        SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '.png' AS filename, text AS caption FROM conversations WHERE role = 'assistant') c
    LEFT JOIN (SELECT conv_id, text AS new_caption FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations WHERE role = 'system') WHERE place = 1) f
        ON c.conv_id = f.conv_id
    """,
)
def caption_merge(spark, sf):
    fresh = conversations(spark, sf).filter("role = 'system'").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".png")).alias("filename"),
        F.col("text").alias("new_caption"),
        F.col("turn").alias("seq"),
    )
    merged = captions.merge_captions(caption_rows(spark, sf), fresh)
    return merged.select("filename", "caption", "new_caption")


@check(
    "resume_anti",
    """
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
    """,
)
def resume_anti(spark, sf):
    done = table(spark, sf, "labels").withColumn("result", F.when(F.col("quality") == 1, F.lit("done")))
    return captions.remaining_work(table(spark, sf, "documents").select("doc_id"), done, "doc_id", "result")


STATUS_SQL = """
    SELECT CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed'
        WHEN 'view' THEN 'missing_image' ELSE 'no_caption_match' END AS status, event_id FROM events
"""


def outcomes(spark, sf):
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("purchase", "click"), "succeeded").when(kind == "error", "failed")
        .when(kind == "view", "missing_image").otherwise("no_caption_match")
    )
    return table(spark, sf, "events").select("event_id", status.alias("status"))


@check(
    "processing_stats",
    f"""
    SELECT count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status = 'missing_image') AS missing_image, count(*) FILTER (status = 'invalid_image') AS invalid_image,
        count(*) FILTER (status = 'no_caption_match') AS no_caption_match,
        round(count(*) FILTER (status = 'succeeded')::DOUBLE / count(*), 6) AS success_rate FROM ({STATUS_SQL})
    """,
)
def processing_stats(spark, sf):
    rows = captions.processing_stats(outcomes(spark, sf))
    return rows.withColumn("success_rate", F.round("success_rate", 6))


@check("failed_items", f"SELECT event_id, status FROM ({STATUS_SQL}) WHERE status = 'failed'")
def failed_items(spark, sf):
    return captions.failed_items(outcomes(spark, sf))
