"""Shard catalogue, numbering and layout."""

from pyspark.sql import functions as F

from checks.base import check, sql_view
from checks.views import pool, shards, table
from poolsift.operators import layout

sql_view(
    "offsets",
    """
    SELECT shard_id, size, CAST(coalesce(sum(size) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
        AS data_start FROM shards
    """,
)


@check("shard_offsets", "SELECT shard_id, size, data_start FROM offsets")
def shard_offsets(spark, sf):
    return layout.shard_offsets(shards(spark, sf))


@check("shard_totals", "SELECT count(*) AS shards, CAST(sum(size) AS BIGINT) AS samples FROM shards")
def shard_totals(spark, sf):
    return layout.shard_totals(shards(spark, sf))


@check(
    "balanced_buckets",
    """
    SELECT shard_id, size, data_start, CAST(floor(data_start / ceil((SELECT max(data_start + size) FROM offsets) / 6::DOUBLE)) AS BIGINT)
        AS bucket FROM offsets
    """,
)
def balanced_buckets(spark, sf):
    return layout.balanced_buckets(shards(spark, sf), 6)


@check(
    "shard_assign",
    """
    SELECT uid, CAST(floor((row_number() OVER (ORDER BY uid) - 1) / 100) AS BIGINT) AS shard_id,
        CAST((row_number() OVER (ORDER BY uid) - 1) % 100 AS INTEGER) AS position FROM pool
    """,
)
def shard_assign(spark, sf):
    return layout.assign_shards(pool(spark, sf).select("uid"), "uid", 100)


@check(
    "shard_stats",
    """
    SELECT shard_id, count(*) AS successes FROM (
        SELECT CAST(floor((row_number() OVER (ORDER BY uid) - 1) / 100) AS BIGINT) AS shard_id FROM pool) GROUP BY shard_id
    """,
)
def shard_stats(spark, sf):
    return layout.shard_stats(layout.assign_shards(pool(spark, sf).select("uid"), "uid", 100))


@check(
    "shard_assign_bytes",
    """
    WITH RECURSIVE base AS (
        SELECT uid, CAST(floor(o / 100) AS BIGINT) AS writer, o % 100 AS place, n_bytes FROM (
            SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS o, octet_length(encode(text)) AS n_bytes FROM pool)),
    walk AS (
        SELECT uid, writer, place, 0 AS local, 1 AS n, n_bytes AS filled FROM base WHERE place = 0
        UNION ALL
        SELECT b.uid, b.writer, b.place, CASE WHEN w.n >= 40 OR w.filled >= 60000 THEN w.local + 1 ELSE w.local END,
            CASE WHEN w.n >= 40 OR w.filled >= 60000 THEN 1 ELSE w.n + 1 END,
            CASE WHEN w.n >= 40 OR w.filled >= 60000 THEN b.n_bytes ELSE w.filled + b.n_bytes END
        FROM walk w JOIN base b ON b.writer = w.writer AND b.place = w.place + 1)
    SELECT uid, CAST(local + (SELECT coalesce(sum(m), 0) FROM (SELECT writer AS v, max(local) + 1 AS m FROM walk GROUP BY writer)
        WHERE v < walk.writer) AS BIGINT) AS shard_id FROM walk
    """,
)
def shard_assign_bytes(spark, sf):
    """Greedy roll-over by count and bytes inside runs of 100 samples."""
    rows = pool(spark, sf).select("uid", F.octet_length("text").cast("bigint").alias("bytes"))
    numbered = layout.ordinals(rows, layout.hex_bucket(F.col("uid")), ["uid"])
    writers = numbered.withColumn("writer", F.floor(F.col("ordinal") / F.lit(100)))
    placed = layout.assign_shards_by_size(writers, "writer", ["uid"], "bytes", 40, 60_000)
    return placed.select("uid", "shard_id")


@check(
    "member_islands",
    """
    SELECT event_id, user_id, event_type, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island
    FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type THEN 1 ELSE 0 END AS brk FROM events)
    """,
)
def member_islands(spark, sf):
    """Each user's events as the members of a shard; equal neighbours form one sample."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return layout.member_islands(rows, "user_id", "event_id", "event_type")


@check(
    "shard_sizes",
    """
    SELECT 'c' || CAST(c_custkey AS VARCHAR) AS shard_name, CAST(coalesce(o.n, p.n) AS BIGINT) AS size
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) p ON p.k = c_custkey
    WHERE coalesce(o.n, p.n) IS NOT NULL
    """,
)
def shard_sizes(spark, sf):
    """Open orders per customer as the cached sizes, all orders as the side files."""
    orders = table(spark, sf, "orders").withColumn("shard_name", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    per = lambda df: df.groupBy("shard_name").agg(F.count(F.lit(1)).alias("size"))
    return layout.shard_sizes(per(orders.filter("o_orderstatus = 'O'")), per(orders))


@check(
    "missing_shards",
    "SELECT doc_id AS shard_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def missing_shards(spark, sf):
    """Documents are numbered without gaps; those without a label are the missing shards."""
    found = table(spark, sf, "labels").select(F.col("doc_id").alias("shard_id"))
    span = table(spark, sf, "documents").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).first()
    return layout.missing_shards(found, span.first, span.n)


@check("shard_range", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey BETWEEN 10 AND 29")
def shard_range(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return layout.shard_range(rows, 10, 20, "l_suppkey")


@check(
    "shard_ranges",
    """
    SELECT c_mktsegment || '-' AS prefix, c_mktsegment || '-{' || lpad('0', 9, '0') || '..' || lpad(CAST(max(c_custkey) AS VARCHAR), 9, '0') || '}.tar'
        AS shard_range FROM customer GROUP BY c_mktsegment
    """,
)
def shard_ranges(spark, sf):
    names = table(spark, sf, "customer").select(
        F.concat("c_mktsegment", F.lit("-"), F.format_string("%09d", "c_custkey"), F.lit(".tar")).alias("name")
    )
    return layout.shard_ranges(names)


@check(
    "shard_renumber",
    """
    SELECT name, row_number() OVER (ORDER BY name) - 1 AS new_id, lpad(CAST(row_number() OVER (ORDER BY name) - 1 AS VARCHAR), 8, '0') || '.tar' AS new_name
    FROM (SELECT DISTINCT lpad(CAST(l_partkey * 7 AS VARCHAR), 8, '0') || '.tar' AS name FROM lineitem)
    """,
)
def shard_renumber(spark, sf):
    names = table(spark, sf, "lineitem").select(
        F.format_string("%08d.tar", F.col("l_partkey") * 7).alias("name")
    ).distinct()
    return layout.renumber_shards(names)
