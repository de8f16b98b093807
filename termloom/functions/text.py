"""Column expressions for tokens and n-grams; all of them stay in the JVM and keep a document in its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, numbers of any kind, underscores.
WORD = r"[\p{L}\p{N}_]+"
#: White space around a chunk, Unicode spaces included.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"


def once(value: Column) -> Column:
    """A generator of one row that holds ``value``.

    Projections are merged, which would evaluate an expression again wherever a later lambda names
    it (per element of an array). A generator is not merged, so what it yields is computed once.
    """
    return F.explode(F.array(value))


def words(text: Column) -> Column:
    """The words of the lower-cased text; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def span_words(text: Column, spans: Column) -> Column:
    """The text under each ``(start, end)`` span, case kept.

    Offsets are code points, half-open. A span is clipped to the text; one that is null, reversed or
    wholly outside gives an empty word. Null spans or text give an empty array.
    """
    def cut(span: Column) -> Column:
        start = F.greatest(F.coalesce(span["start"], F.lit(0)), F.lit(0))
        length = F.greatest(F.coalesce(span["end"], F.lit(0)) - start, F.lit(0))
        return F.substring(text, start + 1, length)

    return F.coalesce(F.transform(F.when(text.isNotNull(), spans), cut), F.array().cast("array<string>"))


def ngrams(tokens: str, n: int) -> Column:
    """All 1..n-grams of an array column, by start and then length, words joined by a space."""
    return F.expr(
        f"flatten(transform({tokens}, (x, i) -> transform(sequence(1, least({int(n)}, size({tokens}) - i)),"
        f" l -> array_join(slice({tokens}, i + 1, l), ' '))))"
    )


def ngrams_with_offsets(tokens: str, spans: str, n: int) -> Column:
    """The same as structs ``(term, start, end)``: the start of the first word, the end of the last."""
    return F.expr(
        f"flatten(transform({tokens}, (x, i) -> transform(sequence(1, least({int(n)}, size({tokens}) - i)),"
        f" l -> struct(array_join(slice({tokens}, i + 1, l), ' ') as term, {spans}[i].start as start, {spans}[i + l - 1].end as end))))"
    )


def strip(text: Column) -> Column:
    """The text without white space of any kind around it."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def split_white(text: Column) -> Column:
    """The maximal runs of characters that are not white space."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0)), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """The text cut at white space after ``. ! ?``, without blank pieces."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: strip(s) != "")
