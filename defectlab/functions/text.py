"""Text cleaning and tokenising as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode blanks, not only those of ASCII.
BLANKS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
CONTROLS = r"[\x00-\x1f\x7f]"
NON_WORD = r"[^\p{L}\p{N}_]+"
SHORT_WORD = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{1,2}(?![\p{L}\p{N}_])"
BEYOND_LATIN1 = r"[^\x00-\xff]"
EQUAL_TERMS = r" ([^ ]++)(?: \1(?= |$))*+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def collapse_blanks(text: Column) -> Column:
    """Every run of blanks becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def clean_text(value: Column) -> Column:
    """NULL to '', numbers to text, lower case, single spaces."""
    return collapse_blanks(F.lower(F.coalesce(value.cast("string"), F.lit(""))))


def non_blank(value: Column) -> Column:
    """True where anything but blanks is left."""
    return F.coalesce(collapse_blanks(value) != "", F.lit(False))


def strip_comments(text: Column) -> Column:
    """Drop ``#`` to the end of its line, then ``/* */`` blocks over lines."""
    return F.regexp_replace(F.regexp_replace(text, r"#[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def drop_apostrophes(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit(""))


def blank_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, " ")


def blank_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, " ")


def trim_lower(text: Column) -> Column:
    return F.lower(F.trim(text))


def drop_short_words(text: Column) -> Column:
    """Remove words of one or two word characters."""
    return F.regexp_replace(text, SHORT_WORD, "")


def drop_beyond_latin1(text: Column) -> Column:
    return F.regexp_replace(text, BEYOND_LATIN1, "")


def normalize_script(text: Column, strip_punct: bool = False) -> Column:
    """All script cleaning steps in their order, without stemming."""
    step = drop_apostrophes(text)
    if strip_punct:
        step = blank_punctuation(step)
    step = trim_lower(blank_controls(step))
    return collapse_blanks(drop_beyond_latin1(drop_short_words(step)))


def words(text: Column) -> Column:
    """Blank-separated tokens; none for blank text."""
    return F.array_remove(F.split(collapse_blanks(text), " "), "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


def term_runs(text: Column) -> Column:
    """The terms in order, equal ones joined: ``[" a a", " b"]`` for "a b a".

    One string per distinct term, so term counts need neither a grouping nor a
    shuffle. Terms hold no blanks, and the pattern never steps back.
    """
    ordered = F.concat(F.lit(" "), F.array_join(F.sort_array(terms(text)), " "))
    return F.regexp_extract_all(ordered, F.lit(EQUAL_TERMS), F.lit(0))


def word_count(text: Column) -> Column:
    collapsed = collapse_blanks(text)
    return F.when(collapsed == "", 0).otherwise(F.size(F.split(collapsed, " ")))


def char_windows(text: Column, block: int = 512, stride: int | None = None, width: int | None = None) -> Column:
    """Windows over blank-collapsed text as an array of strings.

    Text of fewer than ``block - 2`` words stays whole. Otherwise a window of
    ``width`` characters starts every ``stride`` characters; ``width`` below
    ``stride`` leaves gaps, above it overlaps. One pass over the text.
    """
    stride = stride or block - 2
    width = width or stride
    collapsed = collapse_blanks(text)
    pieces = F.regexp_extract_all(collapsed, F.lit(f"(?s)(?=(.{{1,{width}}})).{{1,{stride}}}"), F.lit(1))
    return F.when(word_count(text) < block - 2, F.array(collapsed)).otherwise(pieces)


def fit_length(text: Column, max_len: int) -> Column:
    """Tokens cut to ``max_len`` with both end marks, padded, and the mask."""
    kept = F.concat(F.array(F.lit("<s>")), F.slice(words(text), 1, max_len - 2), F.array(F.lit("</s>")))
    padding = F.array_repeat(F.lit("<pad>"), F.lit(max_len) - F.size(kept))
    mask = F.concat(
        F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), F.lit(max_len) - F.size(kept))
    )
    return F.struct(F.concat(kept, padding).alias("tokens"), mask.alias("mask"))
