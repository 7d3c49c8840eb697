"""Caption and file-name expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words when a caption is split on blanks (the Unicode white
# space of ``(?U)\s`` plus four control characters, 29 code points in all), and the
# characters that count as part of a word for keyword borders.
BLANK = r"[\s\x1c-\x1f]"
NO_BLANK = r"[^\s\x1c-\x1f]"
WORD_CHARACTERS = r"\p{L}\p{N}_"


def single_line(text: Column) -> Column:
    """Line feeds become spaces (what a line-based language detector needs)."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def words(text: Column) -> Column:
    """Words of ``text``, split on runs of blanks, no empty strings."""
    return F.array_remove(F.split(text, f"(?U){BLANK}+"), "")


def word_count(text: Column) -> Column:
    """Number of words; NULL stays NULL."""
    return F.size(words(text))


def first_words_count(text: Column, most: int) -> Column:
    """Number of words, or ``most`` where there are more; the rest of a long text is not split."""
    start = F.regexp_replace(text, rf"(?U)\A{BLANK}+", "")
    return F.least(F.size(F.array_remove(F.split(start, f"(?U){BLANK}+", most + 1), "")), F.lit(most))


def has_words(text: Column, least: int) -> Column:
    """True when ``text`` has at least ``least`` words.

    One anchored match that stops at the ``least``-th word, so a long caption is
    not split just to learn that it is long enough.
    """
    more = f"(?:{NO_BLANK}++{BLANK}++){{{least - 1}}}" if least > 1 else ""
    return text.rlike(rf"(?U)\A{BLANK}*+{more}{NO_BLANK}")


def char_count(text: Column) -> Column:
    """Number of code points."""
    return F.length(text)


def truncate_words(text: Column, limit: int) -> Column:
    """The first ``limit`` words joined by one space."""
    return F.concat_ws(" ", F.slice(words(text), 1, limit))


def keyword_pattern(terms: Sequence[str]) -> str:
    """One case-insensitive pattern that matches any of ``terms`` as whole words.

    A border is a change between word and non-word character, so a term that
    itself starts or ends with punctuation needs a word character outside it.
    """
    if not terms:
        raise ValueError("at least one keyword is needed")

    def is_word(ch: str) -> bool:
        return ch == "_" or ch.isalnum()

    shapes: dict[tuple[bool, bool], list[str]] = {}
    for term in terms:
        escaped = re.sub(r"([^\w])", r"\\\1", term)
        shapes.setdefault((is_word(term[0]), is_word(term[-1])), []).append(escaped)
    parts = []
    for (starts, ends), group in shapes.items():
        before = f"(?<![{WORD_CHARACTERS}])" if starts else f"(?<=[{WORD_CHARACTERS}])"
        after = f"(?![{WORD_CHARACTERS}])" if ends else f"(?=[{WORD_CHARACTERS}])"
        parts.append(f"{before}(?:{'|'.join(group)}){after}")
    return "(?iu)" + "|".join(parts)


def matches_keywords(text: Column, terms: Sequence[str]) -> Column:
    """True when any keyword occurs; NULL text is no match."""
    return F.coalesce(text.rlike(keyword_pattern(terms)), F.lit(False))


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_stem(path: Column) -> Column:
    """Last component without its final extension; a leading dot is part of the stem."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def path_suffix(path: Column) -> Column:
    """Final extension in lower case, with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def parent_dir(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def member_prefix(name: Column) -> Column:
    """Sample key of an archive member: directory part plus base name up to its first dot."""
    return F.regexp_extract(name, r"^((?:.*/|)[^.]+)[.]([^/]*)$", 1)


def member_suffix(name: Column) -> Column:
    """Member kind: everything after the first dot of the base name, in lower case."""
    return F.lower(F.regexp_extract(name, r"^((?:.*/|)[^.]+)[.]([^/]*)$", 2))


def shard_name(shard_id: Column, template: str = "%08d.tar") -> Column:
    """Zero-padded shard file name."""
    return F.format_string(template, shard_id)


def shard_number(name: Column) -> Column:
    """Number at the end of a shard name, extension ignored; NULL when there is none."""
    digits = F.regexp_extract(name, r"(\d+)(?:\.[^./]+)?$", 1)
    return F.when(digits != "", digits).cast("bigint")


def split_objective(tagged: Column) -> tuple[Column, Column]:
    """``objective:label`` split at the first colon only."""
    pieces = F.split(tagged, ":", 2)
    return F.try_element_at(pieces, F.lit(1)), F.try_element_at(pieces, F.lit(2))


def percent_text(fraction: Column, decimals: int = 1) -> Column:
    """``0.1234`` -> ``12.3``."""
    return F.format_string(f"%.{decimals}f", F.round(fraction * 100.0, decimals))


def number_or_null(value: Column) -> Column:
    """Numeric value of a string column, NULL where it is not a number."""
    return value.try_cast("double")
