"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Unicode counts as white space, as a character class.
# Java's own \s covers ASCII only.
WHITESPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
TAG = r"<[^>]+>"
# Fixed value: letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]"


def strip_text(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def clean_html(c: Column) -> Column:
    """Tags out, white space runs to one blank, trimmed. Entities such as ``&amp;`` stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, TAG, ""), f"{WHITESPACE}+", " "))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def non_empty(*candidates: Column) -> Column:
    """The first candidate that is neither null nor ``''``; else ``''``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def article_text(df, max_chars: int | None = None, body: str = "summary") -> Column:
    """``title`` and ``body`` joined by a blank, optionally cut."""
    text = F.concat_ws(" ", F.coalesce(df["title"], F.lit("")), F.coalesce(df[body], F.lit("")))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def iso_or_empty(c: Column) -> Column:
    """A timestamp as ISO-8601 text with its offset, a missing one as ``''``."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit(""))


def sorted_set(c: Column) -> Column:
    """Aggregate: the distinct non-null values in order, so that the result repeats."""
    return F.sort_array(F.collect_set(c))
