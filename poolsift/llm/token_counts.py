"""Token counts of documents from the counts of their distinct pre-tokens.

A tokenizer never merges across the pieces its pattern cuts, so a document has as many tokens as its
pieces have together. Documents are read in batches: each batch has a word list (its distinct pieces) and,
per document, which words it holds how often. The word lists are dealt out by a checksum of the word, so that one task
has all batches that ask for a piece and the tokenizer counts every distinct piece of the corpus once. The
counts go back to the batches that asked, which add up. Ids are never kept, a piece crosses the network once per
batch that holds it, and no group is larger than a batch.

Special tokens of the vocabulary count as one token where their string stands in a text, as the library does
by default. Null and empty texts have no bytes and no tokens. Repeated rows, null ids and ties are
rows of their own, other columns are left out, an empty table gives no rows. A very long text is cut into
parts where the pattern must cut, whatever stands on either side.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.llm.common import lean, saved, tasks, text_parts
from poolsift.llm.pieces import BLANK, DIGIT, LETTER, Splitter, class_table, mixed
from poolsift.llm.varint import from_steps, joined, packed, split, steps, unpacked

#: Bytes of text split together.
PART_BYTES = 2_000_000
#: Code points of a long text split together, up to the next place that is sure to be a cut.
PART_CHARS = 1_000_000
#: A batch of documents ends at so many bytes of text or distinct pieces.
BATCH_BYTES = 32_000_000
BATCH_WORDS = 400_000
#: Parts that the words of the corpus are dealt into; a task holds the distinct words of one part at a time.
BUCKETS = 4_096
#: Pieces the tokenizer counts at a time.
COUNTED = 20_000


def special_pattern(tokenizer) -> regex.Pattern | None:
    """Matches the strings that the library takes out of a text before it is cut into pieces."""
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("only special tokens that match literally are supported")
    strings = sorted((t.content for t in added), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, strings))) if strings else None


def safe_parts(text: str, classes: np.ndarray, most: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``most`` code points, cut only where pieces end in any context.

    That is before a blank that follows none, and where letters or digits end.
    """
    start = 0
    while len(text) - start > most:
        at, cut = start + most, len(text)
        while at < len(text):
            kind = classes[np.frombuffer(text[at - 1 : at + 65_536].encode("utf-32-le", "surrogatepass"), np.uint32)]
            before, after = kind[:-1], kind[1:]
            word = (before == LETTER) | (before == DIGIT)
            found = np.flatnonzero((before != after) & (word | (after == BLANK)))
            if len(found):
                cut = at + int(found[0])
                break
            at += 65_536
        yield text[start:cut]
        start = cut
    yield text[start:]


class WordList:
    """Numbers of distinct pieces, in the order they come up.

    Pieces are told apart by a 64-bit name; a second name of other make must agree whenever the first does.
    If it ever does not, :meth:`numbers` says so and the list starts again with other multipliers.
    """

    def __init__(self) -> None:
        self.salt = 0
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.proof = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.known)

    def numbers(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[str]] | None:
        """The number of each piece, and the pieces that are new, in the order of their numbers."""
        lengths = np.diff(np.append(starts, len(codes)))
        within = np.arange(len(codes), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        terms = mixed(codes.astype(np.uint64) + np.uint64(1))
        name = self._name(terms, within, starts, lengths, 2 * self.salt)
        proof = self._name(terms, within, starts, lengths, 2 * self.salt + 1)
        distinct, first, back = np.unique(name, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == distinct[old]
        if (proof[first][back] != proof).any() or (self.proof[at[old]] != proof[first[old]]).any():
            self.salt += 1
            return None
        number = np.empty(len(distinct), np.int64)
        number[old] = self.place[at[old]]
        fresh = np.flatnonzero(~old)
        number[fresh] = len(self.known) + np.arange(len(fresh))
        ends = np.append(starts, len(codes))
        raw = codes.tobytes()
        pieces = [raw[4 * ends[i] : 4 * ends[i + 1]].decode("utf-32-le", "surrogatepass") for i in first[fresh]]
        self.place = np.insert(self.place, at[fresh], number[fresh])
        self.proof = np.insert(self.proof, at[fresh], proof[first[fresh]])
        self.known = np.insert(self.known, at[fresh], distinct[fresh])
        return number[back.reshape(-1)], pieces

    @staticmethod
    def _name(terms, within, starts, lengths, which: int) -> np.ndarray:
        base = mixed(np.array([which + 1], np.uint64))[0] | np.uint64(1)
        weight = np.full(int(lengths.max()), base, np.uint64)
        weight[0] = 1
        np.multiply.accumulate(weight, out=weight)
        return mixed(np.add.reduceat(terms * weight[within], starts) + lengths.astype(np.uint64) * base)


def frequencies(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Rows of documents and of the word lists of their batches.

    A document has the numbers of its pieces (``number``: increasing, as distances, twice over and one more where the piece
    occurs several times) and how often these occur (``times``, from 2 on). A word list has a ``bucket``, numbers
    (distances), and the pieces themselves (``words`` end to end, with their ``sizes``). All lists are packed
    (:mod:`poolsift.llm.varint`). ``docs`` has ``doc_id`` and ``text``.
    """
    schema = docs.select(
        F.lit(0).cast("bigint").alias("batch"), "doc_id", F.lit(0).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("specials"),
        *[F.lit(b"").alias(c) for c in ("number", "times")], F.lit(0).alias("bucket"), *[F.lit(b"").alias(c) for c in ("words", "sizes")],
    ).schema
    for field in schema.fields:
        field.nullable = True
    names = schema.names
    classes = docs.sparkSession.sparkContext.broadcast(class_table(pattern))  # a byte per code point

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        splitter, special = Splitter(pattern, classes.value), special_pattern(Tokenizer.from_file(tokenizer))
        words, fresh, batch, held = WordList(), [], TaskContext.get().partitionId() << 32, 0

        def segments(text: str) -> Iterator[str]:
            for part in special.split(text) if special and special.search(text) else [text]:
                yield from safe_parts(part, splitter.classes)

        def parts(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
            """Segments with the places of their texts, as many as are split together."""
            owners, group, size = [], [], 0
            for i, text in enumerate(texts):
                for segment in segments(text):
                    if size + len(segment) > PART_BYTES and group:
                        yield owners, group
                        owners, group, size = [], [], 0
                    owners.append(i)
                    group.append(segment)
                    size += len(segment)
            yield owners, group

        def numbered(texts: list[str]) -> np.ndarray | None:
            """Place of its text and number of each piece as one number, sorted; new pieces are listed."""
            nonlocal fresh
            owner, number, new = [], [], []
            for owners, group in parts(texts):
                codes, starts, counts = splitter.cuts(group)
                if len(starts):
                    found = words.numbers(codes, starts)
                    if found is None:
                        return None
                    owner.append(np.repeat(np.array(owners, np.int64), counts))
                    number.append(found[0])
                    new += found[1]
            fresh += new
            width = max(1, len(words))
            return np.sort(np.concatenate([o * width + n for o, n in zip(owner, number)])) if owner else np.zeros(0, np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            """The word list of the batch, by bucket; the next batch starts."""
            nonlocal fresh, batch, held
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in fresh), np.int64, len(fresh))
            order = np.argsort(bucket, kind="stable")
            used, sizes = np.unique(bucket, return_counts=True)
            ends, rows = np.cumsum(sizes), len(used)
            listed = joined([fresh[i].encode("utf-8", "surrogatepass") for i in order], ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, batch)),
                    pa.nulls(rows, id_type),
                    *[pa.nulls(rows, pa.int64())] * 2,
                    packed(steps(order, ends), ends),
                    pa.nulls(rows, pa.binary()),
                    pa.array(used.astype(np.int32)),
                    *listed,
                ],
                names,
            )
            words.clear()
            fresh, batch, held = [], batch + 1, 0

        id_type = pa.int64()
        for arrow in batches:
            ids = arrow.column(arrow.schema.get_field_index("doc_id"))
            id_type = ids.type
            for low, high, texts in text_parts(arrow, arrow.schema.get_field_index("text"), PART_BYTES):
                texts = [t or "" for t in texts]
                if held > BATCH_BYTES or len(words) > BATCH_WORDS:
                    yield from close()
                pieces = numbered(texts)
                while pieces is None:  # two pieces of one name: the names change, in a batch of its own
                    yield from close()
                    pieces = numbered(texts)
                width, rows = max(1, len(words)), len(texts)
                pieces, times = np.unique(pieces, return_counts=True)
                owner, number = pieces // width, pieces % width
                ends = np.cumsum(np.bincount(owner, minlength=rows))
                several = times > 1
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                held += sum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, batch)),
                        ids.slice(low, rows),
                        pa.array(sizes, pa.int64()),
                        pa.array([len(special.findall(t)) if special else 0 for t in texts], pa.int64()),
                        packed(2 * steps(number, ends) + several, ends),
                        packed(times[several] - 2, np.concatenate([[0], np.cumsum(several)])[ends]),
                        pa.nulls(rows, pa.int32()),
                        *[pa.nulls(rows, pa.binary())] * 2,
                    ],
                    names,
                )
        if fresh:
            yield from close()

    return docs.select("doc_id", "text").mapInArrow(lean(read), schema)


def count_pieces(lists: DataFrame, tokenizer: str) -> DataFrame:
    """``of`` (a batch), ``number`` and ``n``: the tokens of the pieces that are not one token, from rows of word lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library, bucket, known = Tokenizer.from_file(tokenizer), None, {}
        for batch in batches:
            distances, ends = unpacked(batch.column(2))
            numbers = from_steps(distances, ends)
            asked = [w.decode("utf-8", "surrogatepass") for w in split(batch.column(3), unpacked(batch.column(4))[0])]
            n = np.empty(len(numbers), np.int64)
            low = 0
            for now, high in zip(batch.column(1).to_pylist(), ends.tolist()):
                if now != bucket:
                    bucket, known = now, {}
                row = asked[low:high]
                new = [w for w in row if w not in known]
                for at in range(0, len(new), COUNTED):
                    part = new[at : at + COUNTED]
                    known.update(zip(part, map(len, library.encode_batch_fast(part, add_special_tokens=False))))
                n[low:high] = [known[w] for w in row]
                low = high
            some = np.flatnonzero(n != 1)
            ends = np.searchsorted(some, ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(steps(numbers[some], ends), ends), packed(n[some], ends)], ["of", "number", "n"])

    dealt = lists.select("batch", "bucket", "number", "words", "sizes").repartition(tasks(lists.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(run), "of bigint, number binary, n binary")


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs (doc_id, text)``.

    ``tokenizer`` is a byte-level vocabulary file of the ``tokenizers`` library whose texts are cut by ``pattern``.
    """
    rows = saved(frequencies(docs.select("doc_id", "text"), tokenizer, pattern), "piece-frequencies")
    counted = count_pieces(rows.where("bucket IS NOT NULL"), tokenizer)
    held = rows.where("bucket IS NULL").select("batch", "doc_id", "n_bytes", "specials", "number", "times")

    def column(table: pa.Table, name: str) -> pa.BinaryArray:
        return pa.chunked_array(table[name].chunks, pa.binary()).combine_chunks()

    def add_up(held: pa.Table, known: pa.Table) -> pa.Table:
        codes, ends = unpacked(column(held, "number"))
        number, several = from_steps(codes >> 1, ends), codes & 1 > 0
        times = np.ones(len(number), np.int64)
        times[several] = unpacked(column(held, "times"))[0] + 2
        asked = from_steps(*unpacked(column(known, "number")))
        n = np.ones(int(max(number.max(initial=0), asked.max(initial=0))) + 1, np.int64)
        n[asked] = unpacked(column(known, "n"))[0]
        ends = np.concatenate([[0], ends])
        sums = np.concatenate([[0], np.cumsum(n[number] * times)])
        tokens = sums[ends[1:]] - sums[ends[:-1]] + held["specials"].to_numpy()
        return pa.table([held["doc_id"], held["n_bytes"], pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.groupBy("batch").cogroup(counted.groupBy("of")).applyInArrow(add_up, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
