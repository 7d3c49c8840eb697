"""Sampling and mixing."""

from pyspark.sql import functions as F

from checks.base import check
from checks.views import pool, table
from poolsift.operators import sampling

DRAW = "CAST(CAST('0x' || substr(md5({key}), 1, 15) AS UBIGINT) % n AS BIGINT)"
NUMBERED = "SELECT uid, source, row_number() OVER (PARTITION BY source ORDER BY uid) - 1 AS ordinal FROM pool"


@check(
    "sample_with_replacement",
    f"""
    WITH sizes AS (SELECT source, count(*) AS n FROM pool GROUP BY source),
    draws AS (SELECT source, n, unnest(range(CAST(floor(n * 0.3::DOUBLE) AS BIGINT))) AS draw FROM sizes),
    placed AS (SELECT source, draw, {DRAW.format(key="'7:' || source || ':' || CAST(draw AS VARCHAR)")} AS ordinal FROM draws),
    numbered AS ({NUMBERED})
    SELECT p.source, p.draw, u.uid FROM placed p JOIN numbered u ON p.source = u.source AND p.ordinal = u.ordinal
    """,
)
def sample_with_replacement(spark, sf):
    rows = pool(spark, sf).select("uid", "source")
    return sampling.sample_with_replacement(rows, "source", 0.3, seed=7).select("source", "draw", "uid")


@check(
    "mix_sources",
    f"""
    WITH sizes AS (SELECT source, count(*) AS n FROM pool GROUP BY source),
    weights AS (SELECT 'src' || CAST(s_suppkey AS VARCHAR) AS source, CAST(s_suppkey + 1 AS DOUBLE) AS weight FROM supplier),
    both_ AS (SELECT source, n, weight FROM sizes JOIN weights USING (source)),
    quotas AS (SELECT source, n, CAST(floor(weight / (SELECT sum(weight) FROM both_) * (SELECT CAST(count(*) AS DOUBLE) FROM pool)) AS BIGINT) AS wanted FROM both_),
    draws AS (SELECT source, n, unnest(range(wanted)) AS draw FROM quotas),
    placed AS (SELECT source, draw, {DRAW.format(key="'3:' || source || ':' || CAST(draw AS VARCHAR)")} AS ordinal FROM draws),
    numbered AS ({NUMBERED})
    SELECT p.source, p.draw, u.uid FROM placed p JOIN numbered u ON p.source = u.source AND p.ordinal = u.ordinal
    """,
)
def mix_sources(spark, sf):
    """Sources weighted by number; as many draws as the pool has rows."""
    rows = pool(spark, sf).select("uid", "source")
    weights = table(spark, sf, "supplier").select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"),
        (F.col("s_suppkey") + 1).cast("double").alias("weight"),
    )
    budget = rows.count()
    return sampling.mix_sources(rows, "source", weights, budget, seed=3).select("source", "draw", "uid")


@check(
    "sample_to_budget",
    f"""
    WITH sizes AS (SELECT count(*) AS n FROM pool), draws AS (SELECT n, unnest(range(n)) AS draw FROM sizes),
    placed AS (SELECT draw, {DRAW.format(key="'11:all:' || CAST(draw AS VARCHAR)")} AS ordinal FROM draws),
    numbered AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS ordinal FROM pool)
    SELECT p.draw, u.uid FROM placed p JOIN numbered u ON p.ordinal = u.ordinal
    """,
)
def sample_to_budget(spark, sf):
    rows = pool(spark, sf).select("uid")
    return sampling.sample_to_budget(rows, None, seed=11).select("draw", "uid")


@check("seeded_shuffle", "SELECT uid, source FROM pool ORDER BY md5('5:' || uid)")
def seeded_shuffle(spark, sf):
    return sampling.seeded_shuffle(pool(spark, sf).select("uid", "source"), seed=5)
