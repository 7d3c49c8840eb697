"""Reproducible sampling and mixing. Every draw is a hash of the seed and its number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.functions.ids import hex_prefix_number, seeded_hex
from poolsift.operators.layout import coarse_hex, hex_bucket, ordinals
from poolsift.operators.sizing import spread

#: Draws that unfold from one row.
DRAW_BLOCK = 1 << 12
#: Hex digits of a draw; 60 bits leave no visible bias for any table size.
DRAW_DIGITS = 15


def _draws(quotas: DataFrame, group: str, seed: int) -> DataFrame:
    """``group, draw, ordinal``: ``wanted`` draws per group, uniform over its ``n`` rows.

    Draws are made in blocks which are spread over all tasks before they unfold, so
    one group with most of the draws is not one task.
    """
    blocks = quotas.filter("wanted > 0 AND n > 0").select(
        group,
        "n",
        "wanted",
        F.explode(
            F.sequence(F.lit(0), F.floor((F.col("wanted") - 1) / F.lit(DRAW_BLOCK)))
        ).alias("_block"),
    )
    low = F.col("_block") * DRAW_BLOCK
    high = F.least(F.col("wanted"), low + DRAW_BLOCK) - 1
    drawn = spread(blocks, group, "_block").withColumn("draw", F.explode(F.sequence(low, high)))
    number = hex_prefix_number(seeded_hex(seed, F.col(group), F.col("draw")), DRAW_DIGITS)
    return drawn.select(group, "draw", F.pmod(number, F.col("n")).alias("ordinal"))


def _numbered(df: DataFrame, group: str, order_hex: str) -> DataFrame:
    return ordinals(df, hex_bucket(F.col(order_hex), 3), [order_hex], within=[group], coarse=coarse_hex)


def sample_with_replacement(
    df: DataFrame, group: str, ratio: float, seed: int, order_hex: str = "uid"
) -> DataFrame:
    """Exactly ``int(n * ratio)`` rows of each group, drawn with replacement, with ``draw``.

    ``ratio`` <= 0 switches sampling off. Groups too small for one draw vanish.
    Rows are numbered by ``order_hex`` (a unique, evenly spread hex key), so the sample
    depends on the seed and the data only, never on files or partitions.
    """
    if ratio <= 0:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    quotas = sizes.withColumn("wanted", F.floor(F.col("n") * F.lit(float(ratio))))
    draws = _draws(quotas, group, seed)
    return draws.join(_numbered(df, group, order_hex), [group, "ordinal"]).drop("ordinal")


def mix_sources(
    df: DataFrame,
    source: str,
    weights: Mapping[str, float] | DataFrame,
    budget: int,
    seed: int,
    order_hex: str = "uid",
) -> DataFrame:
    """``floor(budget * w / sum(w))`` draws with replacement from each source.

    ``weights`` is a mapping, or a table ``source, weight`` with one row per source. Sources
    without a weight, and weights without rows, are left out before the sum.
    """
    spark = df.sparkSession
    if isinstance(weights, Mapping):
        weights = spark.createDataFrame(list(weights.items()), f"{source} string, weight double")
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).join(weights, source)
    total = sizes.agg(F.sum(F.col("weight").cast("double"))).first()[0]
    share = F.col("weight").cast("double") / F.lit(total)
    quotas = sizes.withColumn("wanted", F.floor(share * F.lit(float(budget))))
    draws = _draws(quotas.select(source, "n", "wanted"), source, seed)
    return draws.join(_numbered(df, source, order_hex), [source, "ordinal"]).drop("ordinal")


def sample_to_budget(df: DataFrame, budget: int | None, seed: int, order_hex: str = "uid") -> DataFrame:
    """Exactly ``budget`` draws with replacement from the whole table (``None``: its row count)."""
    grouped = df.withColumn("_all", F.lit("all"))
    sizes = grouped.groupBy("_all").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.col("n") if budget is None else F.lit(budget).cast("bigint")
    draws = _draws(sizes.withColumn("wanted", wanted), "_all", seed)
    return draws.join(_numbered(grouped, "_all", order_hex), ["_all", "ordinal"]).drop(
        "_all", "ordinal"
    )


def seeded_shuffle(df: DataFrame, seed: int, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Rows in an order that depends on the seed and the keys only (a range-partitioned sort).

    ``keys`` should tell rows apart (id and copy, say): rows that share them stay together.
    """
    return (
        df.withColumn("_order", seeded_hex(seed, *[F.col(c) for c in keys]))
        .orderBy("_order", *keys)
        .drop("_order")
    )
