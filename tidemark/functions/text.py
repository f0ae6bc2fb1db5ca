"""Text expressions: cleaning, splitting, tokens, hashes. All are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import STOP_WORDS

#: Characters that a Java ``trim`` removes: all up to U+0020.
TRIMMED = "".join(map(chr, range(1, 33)))


def java_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def lowered(text: Column) -> Column:
    """Lower-cased character by character, as SQL does it: a capital I with a dot is one small i, without the combining dot that would part a term."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def alnum_spaced(text: Column) -> Column:
    """Lower-cased, every character but 0-9 and a-z a space."""
    return F.regexp_replace(lowered(text), "[^0-9a-z]", " ")


def alnum_only(text: Column) -> Column:
    """Every character but digits and ASCII letters removed."""
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def alnum_or_space(text: Column) -> Column:
    """Lower-cased; characters but digits, ASCII letters and white space removed."""
    return F.regexp_replace(F.lower(text), r"[^\s0-9A-Za-z]", "")


def drop_trailing_empty(parts: Column) -> Column:
    """Without the empty strings at an array's end."""
    last = F.aggregate(
        F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)
    )
    return F.slice(parts, F.lit(1), last)


def raw_tokens(text: Column) -> Column:
    """White-space split of the cleaned text (see `alnum_spaced`), empty strings included: one pass, as runs of what is cleaned away part the tokens."""
    return F.split(lowered(text), "[^0-9a-z]+")


def tokens(text: Column) -> Column:
    """Terms of a text: cleaned, split at white space, no empty ones. Null: no terms."""
    return F.array_remove(F.coalesce(raw_tokens(text), F.array().cast("array<string>")), "")


def without_stop_words(terms: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.filter(terms, lambda t: ~t.isin(list(stop_words))) if stop_words else terms


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens that are no stop words."""
    return without_stop_words(tokens(text), stop_words)


def leading_terms(text: Column, most: int = 10, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The first ``most`` terms; a leading empty token counts as a term."""
    return F.slice(without_stop_words(raw_tokens(text), stop_words), 1, most)


def java_hash(text: Column) -> Column:
    """The 32-bit string hash h = 31 h + c over characters, as a signed long."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    wide = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide)


def half_toward_zero(value: Column) -> Column:
    """Integer halves, rounded toward zero."""
    return F.when(value < 0, F.ceil(value / 2)).otherwise(F.floor(value / 2))


def concat_title(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", title, description)


def item_line(*fields: Column) -> Column:
    """Fields joined by a comma and a space, as items are archived."""
    return F.concat_ws(", ", *fields)


def sorted_listing(words: Column) -> Column:
    """Comma-joined, sorted."""
    return F.array_join(F.array_sort(words), ",")


def same_item(a: Column, b: Column) -> Column:
    """Items are the same when the trimmed title of one equals the other's."""
    return java_trim(a) == b
