"""Splitting texts into the pieces of a byte-level vocabulary's pattern, for many texts at once.

The pattern cuts a text where the class of characters changes (letters, digits, blanks, the
rest); one space joins the piece that follows it. That rule needs no regular expression: the
cuts of a whole batch are found with a few array operations over its code points. The
``'s``-like endings of the pattern are rare, so texts that hold one go through the regular
expression itself.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
import tiktoken

LETTER, DIGIT, BLANK, OTHER = 0, 1, 2, 3
#: Odd multiplier of the polynomial that names pieces.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Code points that Unicode counts as white space (fixed values).
BLANKS = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def class_table(pattern: str) -> np.ndarray:
    """Class of every code point, as the tokenizer library sees it.

    Python's Unicode tables are older than the library's, those of ``regex`` newer: code points that
    they disagree on are tried out with the library.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    unassigned = []
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            table[code] = LETTER
        elif kind[0] == "N":
            table[code] = DIGIT
        elif kind == "Cn":
            unassigned.append(chr(code))
    new = regex.findall(r"[\p{L}\p{N}]", "".join(unassigned))
    ranks = {bytes([b]): b for b in range(256)}
    for before in "x1":
        for c in new:
            ranks[before.encode() + c.encode()] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for c in new:
        if len(probe.encode_ordinary("x" + c)) == 1:
            table[ord(c)] = LETTER
        elif len(probe.encode_ordinary("1" + c)) == 1:
            table[ord(c)] = DIGIT
    table[list(BLANKS)] = BLANK
    return table


class Splitter:
    """Cuts texts by ``pattern``, the pattern of ``public_tokenizers``.

    ``classes`` is the :func:`class_table` of the pattern, where it is known already.
    """

    def __init__(self, pattern: str, classes: np.ndarray | None = None) -> None:
        self.classes = class_table(pattern) if classes is None else classes
        self.slow = regex.compile(pattern)
        self.ending = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")

    def cuts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts in a row, where pieces start, and how many each text has."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(size) - size
        total = len(codes)
        if not total:
            return codes, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.classes[codes]
        head = np.zeros(total + 1, bool)
        head[first[size > 0]] = True
        head[total] = True
        start = np.empty(total, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= head[:-1]
        # the last blank of a run goes with what follows it if it is a space, else it stands alone
        blank = kind == BLANK
        last = blank[:-1] & ~blank[1:] & ~head[1:-1]
        at = np.flatnonzero(last)
        start[at] = True
        joined = at[codes[at] == 0x20]
        start[joined + 1] = False
        starts = np.flatnonzero(start)
        quoted = [i for i, t in enumerate(texts) if "'" in t and self.ending.search(t)]
        if quoted:
            starts = self._by_pattern(texts, quoted, first, size, starts)
        counts = np.diff(np.searchsorted(starts, np.append(first, total)))
        counts[size == 0] = 0
        return codes, starts, counts

    def _by_pattern(self, texts, quoted, first, size, starts):
        parts, done = [], 0
        for i in quoted:
            low, high = np.searchsorted(starts, (first[i], first[i] + size[i]))
            parts.append(starts[done:low])
            parts.append(np.array([m.start() for m in self.slow.finditer(texts[i])], np.int64) + first[i])
            done = high
        parts.append(starts[done:])
        return np.concatenate(parts)


def powers(count: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** (count - 1), modulo 2 ** 64."""
    out = np.ones(count, np.uint64)
    if count > 1:
        out[1:] = BASE
        np.multiply.accumulate(out, out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the input spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def names(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each piece, equal for equal pieces."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(codes)))
    within = np.arange(len(codes)) - np.repeat(starts, lengths)
    weight = powers(int(lengths.max()))
    terms = mixed(codes.astype(np.uint64) + np.uint64(1)) * weight[within]
    return mixed(np.add.reduceat(terms, starts) + lengths.astype(np.uint64) * BASE)


class PieceIds:
    """Token ids of pieces, worked out once per distinct piece and kept in flat arrays.

    ``encode`` turns a list of distinct pieces into their ids. The store is emptied when it holds
    over ``most`` pieces, so memory is bounded whatever the text.
    """

    def __init__(self, encode, most: int = 500_000) -> None:
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def lookup(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its place in :attr:`start`; and the number of its ids."""
        name = names(codes, starts)
        distinct, first, back = np.unique(name, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            ends = np.append(starts, len(codes))
            raw = codes.tobytes()
            pieces = [raw[4 * ends[i] : 4 * ends[i + 1]].decode("utf-32-le", "surrogatepass") for i in first[new]]
            ids, counts = self.encode(pieces)
            slots = len(self.start) - 1 + np.arange(len(pieces))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.known = np.insert(self.known, at[new], distinct[new])
            self.slot = np.insert(self.slot, at[new], slots)
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at][back.reshape(-1)]
        return slot, self.start[slot + 1] - self.start[slot]

    def gather(self, slot: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of the pieces in a row."""
        total = int(counts.sum())
        shift = np.repeat(self.start[slot] - (np.cumsum(counts) - counts), counts)
        return self.ids[shift + np.arange(total)]
