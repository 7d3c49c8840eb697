"""Prompt texts built from caption columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUIDED_PROMPT = (
    "This picture was published with the alternative text: %s.\n"
    "An earlier automatic caption reads: %s.\n"
    "Using both as hints, say in at most thirty words what the picture shows; "
    "leave out whatever is not certain."
)
PLAIN_PROMPT = "Say briefly what the picture shows; leave out whatever is not certain."
ABSENT = "(none)"


def _present(value: Column) -> Column:
    return F.coalesce(F.length(value) > 0, F.lit(False))


def caption_prompt(
    alt_text: Column, caption: Column, guided: str = GUIDED_PROMPT, plain: str = PLAIN_PROMPT
) -> Column:
    """Guided prompt when either hint exists (the other shown as ``(none)``), else the plain one."""
    shown = lambda c: F.when(_present(c), c).otherwise(F.lit(ABSENT))
    return F.when(
        _present(alt_text) | _present(caption),
        F.format_string(guided, shown(alt_text), shown(caption)),
    ).otherwise(F.lit(plain))


def cue_prompt(item: Column) -> Column:
    """``A <item>`` or ``An <item>``, lower-cased, chosen by the first letter."""
    lowered = F.lower(item)
    article = F.when(lowered.rlike("^[aeiou]"), F.lit("An ")).otherwise(F.lit("A "))
    return F.concat(article, lowered)
