"""Jaccard self-join on word n-grams, by MinHash banding with exact verification.

1. Every text becomes its set of hashed n-grams (five words; a shorter text is one n-gram of all
   its words) and a MinHash signature, cut into bands. Texts with equal sets are one class.
2. Classes that share the hash of a band are candidates; each is linked to the least class of the
   bucket, and connected links form a family. Bands and rows are chosen for the recall wanted at
   the threshold.
3. Families are cut into chunks of bounded size. A row holds two chunks of a family that share a
   bucket, with the full n-gram sets of their members; a task counts the pairs at or over the
   threshold there, so no pair becomes a row, however large a family is. A family of one chunk has
   all its pairs tried; one that is split only those of chunks that share a bucket, so a link that
   the bands miss can count in the one and not in the other.
4. Verified links are counted per class, and connected classes form a group.

Null and empty texts have no n-grams: they share one class (their sets are equal) and link to
nothing else. Rows with equal texts share a class. Ids may be null or repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsift.llm.common import lean, saved, tasks, whole
from poolsift.llm.components import components
from poolsift.llm.pieces import BASE, mixed
from poolsift.operators.sizing import broadcast_if_small

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Hash functions at most.
MOST_HASHES = 144
#: N-grams of a chunk at most (a single larger text is a chunk of its own), and texts.
CHUNK_GRAMS = 1_000_000
CHUNK_TEXTS = 1_024
#: Largest list of rows that is shipped to the texts; a longer one is joined by shuffle.
MOST_BROADCAST = 16 << 20
#: Above every name of a class.
NO_NAME = np.iinfo(np.int64).max
#: N-grams worked on together in a task.
BATCH_GRAMS = 400_000
#: N-grams whose occurrences are multiplied together, and rows of a batch unpacked together.
BLOCK_GRAMS = 2_048
UNPACKED = 128


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands, at ``recall``, need at most ``most`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def gram_sets(words: np.ndarray, counts: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text in a row, sorted, and how many each has."""
    words = mixed(words.view(np.uint64))
    ends = np.cumsum(counts)
    begins = ends - counts
    grams = np.zeros(len(words), np.uint64)
    for i in range(n):
        part = np.zeros(len(words), np.uint64)
        part[: len(words) - i] = words[i:] if i else words
        grams = grams * BASE + part
    usable = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), usable)
    at = np.arange(int(usable.sum())) - np.repeat(np.cumsum(usable) - usable, usable) + begins[text]
    values = mixed(grams[at])
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        whole_text = np.full(1, counts[i], np.uint64)
        for at_word in range(begins[i], ends[i]):
            whole_text = mixed(whole_text * BASE + words[at_word])
        values, text = np.append(values, whole_text), np.append(text, i)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.bincount(text[fresh], minlength=len(counts))


def signatures(values: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signatures (texts x hashes) of the sets; texts without n-grams get the largest value."""
    draw = np.random.Generator(np.random.PCG64(20))
    factors = draw.integers(1 << 62, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(counts), hashes), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    high = np.empty(len(values), np.uint64)
    for i, factor in enumerate(factors):
        np.multiply(values, factor, out=high)
        np.right_shift(high, np.uint64(32), out=high)
        out[full, i] = np.minimum.reduceat(high, starts)
    return out


def _band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per text and band; the band's number is part of it."""
    out = np.empty((len(signature), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(signature), band + 1, np.uint64)
        for i in range(rows):
            value = mixed(value * BASE + signature[:, band * rows + i].astype(np.uint64))
        out[:, band] = value
    return out


def _set_names(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: two sums over its members."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for salt in (0x1B873593, 0x85EBCA6B):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values + np.uint64(salt)), dtype=np.uint64)])
        out.append(mixed(sums[ends[1:]] - sums[ends[:-1]] + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _word_hashes(text: str) -> Column:
    return F.expr(f"transform(filter(split({text}, '\\\\s+'), w -> w <> ''), w -> xxhash64(w))")


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id``, two hashes that name the row, and the text."""
    text = whole(F.col("text"))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("row1"), F.hash(text).alias("row2"), text.alias("_text"))


def _parts(batch: pa.RecordBatch, place: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch in parts of bounded size, with their n-gram sets."""
    column = batch.column(place)
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BATCH_GRAMS, side="right")) - 1)
        yield start, end, *gram_sets(flat[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1]))
        start = end


def signed_sets(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Per row of ``docs``: its names, the class (``c1``, ``c2``), the size of its set, and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, values, sizes in _parts(batch, 3):
                signature = signatures(values, sizes, bands * rows)
                one, two = _set_names(values, sizes)
                hashes = _band_hashes(signature, bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(start, end - start) for i in range(3)),
                        pa.array(one),
                        pa.array(two),
                        pa.array(sizes.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(hashes.reshape(-1))),
                    ],
                    ["doc_id", "row1", "row2", "c1", "c2", "size", "bands"],
                )

    schema = "doc_id bigint, row1 bigint, row2 int, c1 bigint, c2 bigint, size bigint, bands array<bigint>"
    return _named(docs).select("doc_id", "row1", "row2", _word_hashes("_text").alias("words")).mapInArrow(lean(run), schema)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class_id``, ``grams``: the n-gram sets, as bytes, of the rows that ``wanted (row1, row2, class_id)`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, values, sizes in _parts(batch, 1):
                cuts = np.concatenate([[0], np.cumsum(sizes)]) * 8
                raw = values.tobytes()
                grams = pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), grams], ["class_id", "grams"])

    found = _named(docs).join(broadcast_if_small(wanted, MOST_BROADCAST), ["row1", "row2"])
    return found.select("class_id", _word_hashes("_text").alias("words")).mapInArrow(lean(run), "class_id bigint, grams binary")


def _links_between(first: list[np.ndarray], second: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Matrix of which sets of ``first`` and ``second`` (None: the same) reach the threshold."""
    same = second is None
    sets = first if same else first + second
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    del order
    head = np.ones(len(values), bool)
    head[1:] = values[1:] != values[:-1]
    del values
    # an n-gram of one set alone is in no pair
    kept = ~(head & np.append(head[1:], True))
    owner, column = owner[kept], np.cumsum(head[kept], dtype=np.int32) - 1
    rows = len(first)
    common = np.zeros((rows, rows if same else len(sets) - rows), np.float32)
    block = np.empty((len(sets), BLOCK_GRAMS), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_GRAMS):
        low, high = np.searchsorted(column, (start, start + BLOCK_GRAMS))
        block[:] = 0
        block[owner[low:high], column[low:high] - start] = 1
        common += block[:rows] @ (block if same else block[rows:]).T
    a, b = sizes[:rows, None], (sizes if same else sizes[rows:])[None, :]
    linked = common >= threshold * (a + b - common) - 1e-4
    linked &= common > 0
    if same:
        np.fill_diagonal(linked, False)
    return linked


def block_links(names: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], cut: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a block the copies it links to, and the least name of its connected part.

    Sets up to ``cut`` are one chunk, the others a second one; the links are those between the
    two, or those inside the chunk if it stands alone.
    """
    if cut == len(sets):
        linked = _links_between(sets, None, threshold)
        counts = linked @ copies
        sides = [(slice(None), slice(None), linked)]
    else:
        linked = _links_between(sets[:cut], sets[cut:], threshold)
        counts = np.concatenate([linked @ copies[cut:], linked.T @ copies[:cut]])
        sides = [(slice(cut), slice(cut, None), linked), (slice(cut, None), slice(cut), linked.T)]
    least = names.copy()
    while True:
        before = least.copy()
        for mine, theirs, links in sides:
            reached = np.where(links, least[theirs][None, :], NO_NAME).min(1, initial=NO_NAME)
            least[mine] = np.minimum(least[mine], reached)
        if (least == before).all():
            return counts, least


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, chunk_texts: int = CHUNK_TEXTS) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links``, ``group_id`` of every row.

    ``class_id`` is the least id of the rows with the same n-gram set, ``n_links`` counts the other rows whose set reaches the
    threshold (rows of the same class included), ``group_id`` is the least id of the rows that are
    connected through links.
    """
    spark = docs.sparkSession
    bands, rows = band_shape(threshold, recall)
    signed = saved(signed_sets(docs, bands, rows), "signed-sets")
    classes = signed.groupBy("c1", "c2").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("least"),
        F.min(F.struct("row1", "row2")).alias("row"),
        F.first("bands").alias("bands"),
        F.max("size").alias("size"),
    )
    classes = saved(classes.withColumn("class_id", F.xxhash64("c1", "c2")), "classes")

    # buckets of two classes and more; a hub per bucket
    buckets = classes.where("size > 0").select("class_id", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min("class_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = saved(buckets.join(saved(hubs, "hubs"), "band"), "buckets")
    families = saved(components(shared.select(F.col("class_id").alias("a"), F.col("hub").alias("b"))), "families")

    # chunks: families in parts of bounded size
    members = families.select(F.col("id").alias("class_id"), F.col("root").alias("family"))
    members = members.join(classes.select("class_id", "row", "size", "copies"), "class_id")
    totals = members.groupBy("family").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("grams"))
    parts = F.greatest(F.ceil(F.col("texts") / chunk_texts), F.ceil(F.col("grams") / CHUNK_GRAMS)).cast("int")
    members = members.join(totals.select("family", parts.alias("parts")), "family")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("class_id", F.lit(7)), F.col("parts")).cast("int"))
    members = saved(members, "members")
    split = members.where("parts > 1").select("class_id", "family", "chunk")
    met = shared.join(split, "class_id").groupBy("family", "band").agg(F.collect_set("chunk").alias("chunks"))
    pairs = met.select("family", F.explode("chunks").alias("one"), "chunks").select("family", "one", F.explode("chunks").alias("two"))
    pairs = pairs.where("one <= two").distinct()
    alone = members.where("parts = 1").select("family", F.lit(0).alias("one"), F.lit(0).alias("two")).distinct()
    # a block is two chunks; a chunk goes to every block it is in
    blocks = pairs.union(alone).withColumn("block", F.xxhash64("family", "one", "two"))
    sides = blocks.select("family", F.col("one").alias("chunk"), "block", F.lit(0).alias("side")).union(
        blocks.where("one < two").select("family", F.col("two").alias("chunk"), "block", F.lit(1).alias("side"))
    )
    needed = members.select("class_id", "family", "chunk", "copies").join(sides, ["family", "chunk"])
    sets = sets_of(docs, members.select("row.row1", "row.row2", "class_id"))
    work = needed.join(sets, "class_id").select("block", "side", "class_id", "copies", "grams")
    work = work.repartition(4 * tasks(spark), "block").sortWithinPartitions("block", "side", "class_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            cut = sum(r[0] == 0 for r in rows)
            names = np.array([r[1] for r in rows], np.int64)
            copies = np.array([r[2] for r in rows], np.int64)
            counts, least = block_links(names, copies, [np.frombuffer(r[3], np.uint64) for r in rows], cut, threshold)
            hit = counts > 0
            return pa.RecordBatch.from_arrays([pa.array(names[hit]), pa.array(counts[hit]), pa.array(least[hit])], ["class_id", "n", "near"])

        current, rows = None, []
        parts = (batch.slice(at, UNPACKED) for batch in batches for at in range(0, batch.num_rows, UNPACKED))
        for part in parts:
            for block, side, name, copies, grams in zip(*(c.to_pylist() for c in part.columns)):
                if block != current:
                    if len(rows) > 1:
                        yield finish(rows)
                    current, rows = block, []
                if not rows or rows[-1][1] != name:  # rows equal in id and text come more than once
                    rows.append((side, name, copies, grams))
        if len(rows) > 1:
            yield finish(rows)

    found = saved(work.mapInArrow(lean(verify), "class_id bigint, n bigint, near bigint"), "links")
    # a class comes with the least one of its part in every block, so the parts connect through the blocks
    counts = found.groupBy("class_id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("class_id").alias("a"), F.col("near").alias("b")))
    groups = groups.select(F.col("id").alias("class_id"), "root")
    named = classes.select("c1", "c2", "class_id", "copies", "least").join(groups, "class_id", "left").join(counts, "class_id", "left")
    named = named.withColumn("root", F.coalesce("root", "class_id"))
    first = named.groupBy("root").agg(F.min("least").alias("group_id"))
    named = named.join(first, "root").select(
        "c1", "c2", F.col("least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "group_id"
    )
    return signed.select("doc_id", "c1", "c2").join(named, ["c1", "c2"]).select("doc_id", "class_id", "n_links", "group_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of near copies, whatever the rows' ids."""
    key = F.xxhash64("doc_id", "text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    groups = jaccard_groups(docs.select(key.alias("doc_id"), "text"))
    stay = groups.where("doc_id = group_id").select(F.col("doc_id").alias("_key")).distinct()
    rows = docs.select(row, key.alias("_key"))
    # the rows that go are few as a rule: then the texts need not move
    leave = saved(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).join(stay.withColumn("_stay", F.lit(True)), "_key", "left"), "kept-keys")
    once = leave.where("_stay AND _n > 1").select("_key")
    repeated = rows.join(broadcast_if_small(once, MOST_BROADCAST), "_key")
    repeated = repeated.withColumn("_i", F.row_number().over(Window.partitionBy("_key").orderBy("_key"))).where("_i = 1").drop("_i")
    others = leave.where("_stay IS NULL OR _n > 1").select("_key")
    rows = rows.join(broadcast_if_small(others, MOST_BROADCAST), "_key", "left_anti").unionByName(repeated)
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
