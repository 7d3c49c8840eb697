"""SimHash fingerprints and a search within a Hamming radius, with built-in expressions only.

The terms of a text are its pairs of neighbouring words (a single word stands alone); a
term weighs as much as it has characters (31 at most), since long terms are rare ones. Each
term is hashed to 128 bits and votes with its weight for or against each bit. Votes are plain
sums of longs that hold several counters each.

Fingerprints within a radius are found by permuted block tables: the bits are cut into
``blocks`` blocks, and two fingerprints that differ in at most ``radius`` bits agree in at
least ``blocks - radius`` of them. So there is a table for every choice of that many blocks,
keyed by their bits, and fingerprints that share a key are compared.

Null texts count as empty; a text without words has the fingerprint 0. Equal texts have equal
fingerprints. Repeated rows stay and get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsift.llm.common import saved, tasks, whole

BITS = 128
#: Terms of a block, and the most a term weighs: a counter of a block stays below 2**15.
BLOCK_TERMS = 1 << 10
MOST_WEIGHT = 31
#: Lowest bits of four counters in a long, and the fields of two.
FOUR = (1 << 48) | (1 << 32) | (1 << 16) | 1
TWO_FIELDS = (0xFFFF << 32) | 0xFFFF

#: Bits that may differ, and the number of blocks (28 tables keyed by 32 bits).
RADIUS = 6
BLOCKS = 8
#: Fingerprints of a bucket that one row holds when they are compared.
CHUNK = 512


def _block_votes() -> list[Column]:
    """Sums over the terms of a block: the weight, and the counters of bits k, k + 16, k + 32, k + 48."""
    votes = [f"sum(_w * (shiftrightunsigned({name}, {k}) & {FOUR}L)) AS {name}{k}" for name in ("_l", "_h") for k in range(16)]
    return [F.expr(e) for e in ["sum(_w) AS _weight", *votes]]


def _text_votes() -> list[Column]:
    """Sums over the blocks of a text, with two counters of 32 bits in a long."""
    votes = [
        f"sum(shiftrightunsigned({name}{k}, {low}) & {TWO_FIELDS}L) AS {name}{k}_{low}"
        for name in ("_l", "_h")
        for k in range(16)
        for low in (0, 16)
    ]
    return [F.expr(e) for e in ["sum(_weight) AS _weight", *votes]]


def _majority(name: str) -> Column:
    """64 bits: one where more than half of the weight voted for it."""
    bits = []
    for k in range(16):
        for low in (0, 16):
            pair = f"{name}{k}_{low}"
            for bit, ones in ((k + low, f"({pair} & 4294967295L)"), (k + low + 32, f"shiftrightunsigned({pair}, 32)")):
                bits.append(f"if({ones} * 2 > _weight, shiftleft(1L, {bit}), 0L)")
    return F.expr(" | ".join(bits))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with the fingerprint of ``text`` as two longs, ``high`` and ``low``.

    Rows with equal keys must have equal texts. The votes are counted where the rows are, before
    anything is shuffled: per block of :data:`BLOCK_TERMS` terms with four counters in a long,
    then per text with two.
    """
    words = F.split(whole(F.col(text)), r"\s+")
    terms = texts.select(*keys, words.alias("_words"))
    terms = terms.select(*keys, "_words", F.posexplode("_words").alias("_i", "_first"))
    size = F.size("_words")
    terms = terms.where((F.col("_i") + 1 < size) | (size == 1))
    terms = terms.select(*keys, F.shiftright("_i", 10).alias("_block"), "_first", F.get("_words", F.col("_i") + 1).alias("_second"))
    length = F.length("_first") + F.coalesce(F.length("_second"), F.lit(0))
    weight = F.least(length, F.lit(MOST_WEIGHT)).cast("bigint")
    terms = terms.select(*keys, "_block", weight.alias("_w"), F.xxhash64("_first", "_second").alias("_l"))
    terms = terms.withColumn("_h", F.xxhash64("_l"))
    votes = terms.groupBy(*keys, "_block").agg(*_block_votes()).groupBy(*keys).agg(*_text_votes())
    return votes.select(*keys, _majority("_h").alias("high"), _majority("_l").alias("low"))


def hexadecimal(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (F.lit(1.0) - distance(a, b) / F.lit(float(BITS))).cast("double")


def _block(row: str, block: int) -> str:
    """SQL for the bits of one of :data:`BLOCKS` blocks of a row's fingerprint."""
    width = BITS // BLOCKS
    word, at = ("low", block * width) if block * width < 64 else ("high", block * width - 64)
    return f"(shiftrightunsigned({row}{word}, {at}) & {(1 << width) - 1}L)"


def _first_shared(table_of: list[tuple[int, ...]]) -> str:
    """SQL for the number of the first table in which ``m`` and ``o`` have the same key."""
    cases = []
    for number, blocks in enumerate(table_of):
        same = " AND ".join(f"{_block('m.', i)} = {_block('o.', i)}" for i in blocks)
        cases.append(f"WHEN {same} THEN {number}")
    return f"CASE {' '.join(cases)} END"


def near_counts(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """For each row ``(high, low, copies)`` of distinct fingerprints: rows within the radius.

    ``n_near`` counts the copies of the other fingerprints that differ in at most ``radius``
    bits. Buckets with a single fingerprint go at once. Others are cut into chunks that are
    compared chunk by chunk, so a bucket of any size is many small rows, and no pair of
    fingerprints becomes a row. A pair counts in the first table that holds it.
    """
    if not 0 < radius < BLOCKS:
        raise ValueError(f"radius must be from 1 to {BLOCKS - 1}")
    table_of = list(combinations(range(BLOCKS), BLOCKS - radius))
    tables = ", ".join(
        f"named_struct('table', {number}S, 'key', xxhash64({', '.join(_block('', i) for i in blocks)}))"
        for number, blocks in enumerate(table_of)
    )
    rows = prints.select("high", "low", "copies", F.expr(f"inline(array({tables}))"))
    full = (
        rows.groupBy("table", "key")
        .agg(F.count(F.lit(1)).alias("members"))
        .where("members > 1")
        .withColumn("chunks", F.ceil(F.col("members") / chunk).cast("int"))
    )
    member = F.struct("high", "low", "copies")
    chunks = (
        rows.join(full, ["table", "key"])
        .withColumn("chunk", F.pmod(F.xxhash64("high", "low"), F.col("chunks")).cast("int"))
        .groupBy("table", "key", "chunk")
        .agg(F.collect_list(member).alias("members"), F.max("chunks").alias("chunks"))
    )
    mine = chunks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    theirs = chunks.select("table", "key", F.col("chunk").alias("other"), F.col("members").alias("others"))
    pairs = mine.join(theirs, ["table", "key", "other"])

    apart = "(bit_count(m.high ^ o.high) + bit_count(m.low ^ o.low))"
    near = f"{apart} BETWEEN 1 AND {radius} AND {_first_shared(table_of)} = `table`"
    copies = f"aggregate(filter(others, o -> {near}), 0L, (n, o) -> n + o.copies)"
    counted = f"transform(members, m -> named_struct('high', m.high, 'low', m.low, 'n', {copies}))"
    found = pairs.select(F.expr(f"inline(filter({counted}, c -> c.n > 0))"))
    return found.groupBy("high", "low").agg(F.sum("n").alias("n_near"))


#: Widths of id ranges: about this many rows each, and never more ranges than this.
ROWS_PER_RANGE = 2_000
MOST_RANGES = 1 << 16


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in ranges of ids, each with its place, followed by a copy of what comes next.

    Order: descending ``doc_id`` (null last), then text; after the last row comes the first. A
    range gets the first rows of the range behind it as rows with ``border`` 1, so a window per
    range sees every row's successor, and no window spans the table.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("bigint")))
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, high = (0, 0) if low is None else (low, high)
    ranges = max(1, min(MOST_RANGES, max(8 * tasks(spark), count // ROWS_PER_RANGE)))
    width = max(1, -(-(high - low + 1) // ranges))
    place = F.floor((F.col("doc_id").cast("decimal(20,0)") - low) / width).cast("int")
    rows = rows.withColumn("_range", F.coalesce(place, F.lit(-1)))
    heads = sorted(((r[0], r[1]) for r in rows.groupBy("_range").agg(F.max("_id")).collect()), reverse=True)
    turn = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    borders = spark.createDataFrame(turn, "_id bigint, _to int")
    border = rows.join(F.broadcast(borders), "_id").select("doc_id", "text", "_id", F.col("_to").alias("_range"), F.lit(1).alias("border"))
    return rows.select("doc_id", "text", "_id", "_range", F.lit(0).alias("border")).unionByName(border)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and edited texts, their likeness, and rows within the radius.

    The edited text has its last ``n_chars // 2`` code points replaced by the first as many of
    the next document's. ``n_near`` counts the other rows whose fingerprint is within
    :data:`RADIUS` bits, rows with the same fingerprint included.
    """
    order = [F.col("border"), F.col("_id").desc(), F.col("text")]
    by_range = Window.partitionBy("_range").orderBy(*order)
    rows = with_next(docs).withColumns({"_at": F.row_number().over(by_range), "_next": F.lead("text").over(by_range)})
    n_chars = F.length("text").cast("bigint")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)
    )
    keys = ["_range", "_at", "border", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select("_range", "_at", "border", "doc_id", n_chars.alias("n_chars"), "text", edited.alias("_edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("body")))
    variants = rows.select(*keys, F.inline(both)).where("border = 0 OR kind = 0")
    prints = fingerprints(variants, [*keys, "kind"], "body")

    def of(kind: int, word: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(word)))

    prints = prints.groupBy(*keys).agg(
        of(0, "high").alias("high"), of(0, "low").alias("low"), of(1, "high").alias("_eh"), of(1, "low").alias("_el")
    )
    following = Window.partitionBy("_range").orderBy("_at")
    prints = prints.withColumns({"_nh": F.lead("high").over(following), "_nl": F.lead("low").over(following)}).where("border = 0")
    own = (F.col("high"), F.col("low"))
    prints = saved(
        prints.select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "high",
            "low",
            hexadecimal(*own).alias("fingerprint"),
            hexadecimal(F.col("_eh"), F.col("_el")).alias("edited_fingerprint"),
            likeness(own, (F.col("_eh"), F.col("_el"))).alias("near_edited"),
            likeness(own, (F.col("_nh"), F.col("_nl"))).alias("near_next"),
        ),
        "fingerprints",
    )
    distinct = prints.groupBy("high", "low").agg(F.count(F.lit(1)).alias("copies"))
    distinct = saved(distinct, "distinct-fingerprints")
    near = near_counts(distinct)
    counts = distinct.join(near, ["high", "low"], "left").select(
        "high", "low", (F.col("copies") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near")
    )
    # written before the join, so that Spark can split the rows of a frequent fingerprint
    return prints.join(saved(counts, "near-counts"), ["high", "low"]).drop("high", "low")
