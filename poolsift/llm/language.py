"""Language identification by cross-parsing.

For each language a suffix automaton is built of a bounded sample of labelled text. A text
is parsed against each automaton into longest matches; every match that cannot go on starts a
new phrase. The number of phrases times ``log2`` of the sample's length, per character, is
the cross entropy with that language, and the least one wins.

Parsing walks one character per step for thousands of pieces of text and all languages at
once: the automaton is a table (state, character class) whose entries hold the next state
and the phrases that end there. All letters of the samples are told apart, and each language has
columns for those of its own sample; where that is a large alphabet, the moves stand in a sorted
list instead. Texts are cut into pieces of :data:`PIECE` characters, so
a long text is many lanes and none of it is left out; a phrase ends where a piece ends.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language that
comes first by name. Without any labelled text everything is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsift.llm.common import lean, text_parts

#: Bound of the training sample: texts per language, and characters of each.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 384
#: Classes of a parse table, unless its language needs another number.
ALPHABET = 64
#: Entries of a parse table; a language with more states x classes is parsed by a list of its moves, with the same result.
DENSE = 1 << 22
#: Characters parsed in one lane.
PIECE = 1024
#: Bytes of texts parsed together.
BATCH_BYTES = 2_000_000

UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, characters) of at most :data:`SAMPLE_TEXTS` texts per language, by hash of id.

    The choice is a rank per language; Spark keeps only the first ranks of every task before it
    shuffles, so a language with most of the rows costs no more than a rare one.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    first = F.substring("text", 1, SAMPLE_CHARS)
    rows = rows.select("lang", first.alias("sample"), F.xxhash64("doc_id").alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw", "sample")
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_TEXTS)
    parts = kept.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "sample"))).alias("parts"))
    return [(r.lang, "\n".join(p.sample for p in r.parts)) for r in parts.orderBy("lang").collect()]


def _folded(c: str) -> str:
    """The letter in lower case, itself where that is more than one."""
    lower = c.lower()
    return lower if len(lower) == 1 else c


def character_classes(samples: list[str]) -> np.ndarray:
    """Class of every code point: 0 letters that no sample holds, 1 anything but a letter, 2 and more the letters."""
    counts: dict[str, int] = {}
    for sample in samples:
        for c in sample:
            if c.isalpha():
                c = _folded(c)
                counts[c] = counts.get(c, 0) + 1
    known = sorted(counts, key=lambda c: (-counts[c], c))
    number = {c: i + 2 for i, c in enumerate(known)}
    letters = letter_table()
    classes = np.where(letters, 0, 1).astype(np.min_scalar_type(len(known) + 2))
    for code in np.flatnonzero(letters):
        classes[code] = number.get(_folded(chr(code)), 0)
    return classes


def letter_table() -> np.ndarray:
    """True for code points of the Unicode categories L*."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            target = moves[at][c]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[new] = copy
                while at >= 0 and moves[at].get(c) == target:
                    moves[at][c] = copy
                    at = link[at]
        last = new
    return moves


def compact(moves: list[dict[int, int]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of states, and the moves as three arrays: from, class, to."""
    count = sum(map(len, moves))
    start = np.fromiter((s for s, m in enumerate(moves) for _ in m), np.int32, count)
    code = np.fromiter((c for m in moves for c in m), np.int32, count)
    to = np.fromiter((t for m in moves for t in m.values()), np.int32, count)
    return len(moves), start, code, to


def parse_table(states: int, start: np.ndarray, code: np.ndarray, to: np.ndarray, width: int = ALPHABET) -> np.ndarray:
    """Flat table over (state, class): next state's row times 4, plus the phrases that end.

    A missing move ends the phrase and the character begins the next one; a character that the
    sample does not hold is a phrase of its own.
    """
    first = np.full(width, -1, np.int64)
    root = start == 0
    first[code[root]] = to[root]
    restart = np.where(first >= 0, first * width * 4 + 1, 2)
    table = np.empty((states, width), np.int32)
    table[:] = restart
    table[0] = np.where(first >= 0, first * width * 4, 1)
    table[start, code] = to.astype(np.int64) * (width * 4)
    return table.reshape(-1)


def count_phrases(table: np.ndarray, steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each lane; ``steps`` holds one row of classes per step, lanes longest first."""
    lanes = steps.shape[1]
    state = np.zeros(lanes, np.int32)
    phrases = np.zeros(lanes, np.int32)
    live = np.searchsorted(-lengths, -np.arange(steps.shape[0]), side="left")
    place = np.empty(lanes, np.int32)
    found = np.empty(lanes, np.int32)
    for at in range(steps.shape[0]):
        n = live[at]
        s, p, f = state[:n], place[:n], found[:n]
        np.add(s, steps[at, :n], out=p)
        np.take(table, p, out=f, mode="clip")
        np.right_shift(f, 2, out=s)
        np.bitwise_and(f, 3, out=f)
        np.add(phrases[:n], f, out=phrases[:n])
    return phrases + (state > 0)


def move_list(states: int, start: np.ndarray, code: np.ndarray, to: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The moves sorted by state and class: their numbers, where they lead, and the move of each class from the start."""
    keys = start.astype(np.int64) * width + code
    order = np.argsort(keys)
    first = np.full(width, -1, np.int64)
    first[code[start == 0]] = to[start == 0]
    return keys[order], to[order].astype(np.int64), first


def count_phrases_by_list(moves: tuple[np.ndarray, np.ndarray, np.ndarray], steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What :func:`count_phrases` counts, for an automaton too wide for a table."""
    keys, to, first = moves
    state = np.zeros(steps.shape[1], np.int64)
    phrases = np.zeros(steps.shape[1], np.int32)
    live = np.searchsorted(-lengths, -np.arange(steps.shape[0]), side="left")
    for at in range(steps.shape[0]):
        n = live[at]
        s, c = state[:n], steps[at, :n]
        wanted = s * len(first) + c
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        goes = keys[place] == wanted
        begins = first[c]
        phrases[:n] += np.where(goes, 0, np.where(s > 0, 1, 0) + (begins < 0))
        state[:n] = np.where(goes, to[place], np.maximum(begins, 0))
    return phrases + (state > 0)


def learn(samples: list[tuple[str, str]]) -> dict:
    """What tasks need, as plain arrays: classes of characters and one automaton per language."""
    classes = character_classes([text for _, text in samples])
    coded, own = [], []
    for _, text in samples:
        held, codes = np.unique(classes[_codes(text)], return_inverse=True)
        coded.append((codes + 1).tolist())
        own.append(held)
    known = np.flatnonzero(classes > 1)
    return {
        "languages": [name for name, _ in samples],
        "letters": letter_table(),
        "known": known,
        "known_class": classes[known],
        "own": own,
        "automata": [compact(suffix_automaton(codes)) for codes in coded],
        "bits": np.array([np.log2(max(2, len(codes))) for codes in coded]),
    }


def unfold(model: dict) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Classes of code points, which of them are letters, and per language its columns by class and its parser.

    Column 0 of a language stands for all that its sample does not hold.
    """
    letters = model["letters"]
    classes = np.where(letters, 0, 1).astype(model["known_class"].dtype)
    classes[model["known"]] = model["known_class"]
    most = int(classes.max()) + 1
    tables = []
    for automaton, own in zip(model["automata"], model["own"]):
        width = len(own) + 1
        columns = np.zeros(most, np.min_scalar_type(width))
        columns[own] = np.arange(1, width)
        if automaton[0] * width <= DENSE:
            tables.append((columns, count_phrases, parse_table(*automaton, width)))
        else:
            tables.append((columns, count_phrases_by_list, move_list(*automaton, width)))
    return classes, letters, tables


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def entropies(texts: list[str], classes: np.ndarray, tables: list[tuple], bits: np.ndarray) -> np.ndarray:
    """Bits per character of each (non-empty) text under each language."""
    flat = classes[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pieces = np.maximum(1, -(-size // PIECE))
    owner = np.repeat(np.arange(len(texts)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(size) - size, pieces) + within * PIECE
    length = np.minimum(PIECE, size[owner] - within * PIECE)
    order = np.argsort(-length, kind="stable")
    begin, length, owner = begin[order], length[order], owner[order]
    flat = np.concatenate([flat, np.zeros(PIECE, flat.dtype)])
    steps = np.lib.stride_tricks.sliding_window_view(flat, PIECE)[begin][:, : length[0]].T.copy()
    found = np.empty((len(texts), len(tables)))
    for i, (columns, count, parser) in enumerate(tables):
        phrases = count(parser, columns[steps], length)
        found[:, i] = np.bincount(owner, phrases, len(texts)) * bits[i]
    return found / np.maximum(size, 1)[:, None]


def identify(docs: DataFrame, samples: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of these names.

    The score is 1 minus the ratio of the least to the second least entropy, set off to lie
    between 0.5 (a tie) and 1; with a single language it is 1. ``samples`` are the labelled
    texts to learn from; by default a bounded sample of ``docs``.
    """
    samples = training_sample(docs) if samples is None else samples
    model = docs.sparkSession.sparkContext.broadcast(learn(samples))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[f"`{c}`" for c in kept])
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def predicted(texts: list[str | None], classes, letters, tables, m: dict) -> tuple[list[str], np.ndarray]:
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not tables:
            return labels, scores
        at = [i for i, t in enumerate(texts) if t and letters[_codes(t)].any()]
        if not at:
            return labels, scores
        bits = entropies([texts[i] for i in at], classes, tables, m["bits"])
        best = bits.argmin(1)
        ordered = np.sort(bits, 1)
        second = ordered[:, 1] if bits.shape[1] > 1 else np.full(len(at), np.inf)
        scores[at] = 1 - 0.5 * ordered[:, 0] / second
        for i, b in zip(at, best):
            labels[i] = m["languages"][b]
        return labels, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        ready = unfold(m)
        for batch in batches:
            for start, end, texts in text_parts(batch, batch.schema.get_field_index("text"), BATCH_BYTES):
                labels, scores = predicted(texts, *ready, m)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                    [*part.schema.names, "lang_pred", "score"],
                )

    return docs.mapInArrow(lean(run), schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is ``und``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = identify(docs.select(row, "text"), training_sample(docs)).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, whether it was held out of learning, prediction and score."""
    found = identify(docs.select("doc_id", "text"), training_sample(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
