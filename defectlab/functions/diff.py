"""Unified-diff text to its deleted and added lines, inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEADING_BLANKS = r"\A[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def _check(mode: str) -> str:
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be strict or lenient, not {mode!r}")
    return mode


def patch_body(patch: Column, mode: str = "strict") -> Column:
    """The patch from its first hunk header on.

    Without any header, strict keeps all lines; lenient treats the first line
    as the header.
    """
    hunks = F.regexp_extract(patch, r"(?dms)^@@.*", 0)
    bare = patch if _check(mode) == "strict" else F.regexp_replace(patch, r"\A[^\n]*\n?", "")
    return F.when(F.startswith(patch, F.lit("@@")), patch).when(hunks == "", bare).otherwise(hunks)


def line_kind(line: Column, mode: str = "strict") -> Column:
    """'deleted', 'added', 'header', 'skipped' (lenient only) or 'context'."""
    sign = line if _check(mode) == "strict" else F.regexp_replace(line, LEADING_BLANKS, "")
    kind = F.when(F.startswith(line, F.lit("@@")), "header")
    if mode == "lenient":
        kind = kind.when(F.startswith(line, F.lit("!")), "skipped")
    return (
        kind.when(F.startswith(sign, F.lit("-")), "deleted")
        .when(F.startswith(sign, F.lit("+")), "added")
        .otherwise("context")
    )


def line_text(line: Column, mode: str = "strict") -> Column:
    """The line without its sign and without trailing carriage returns."""
    signed = line if _check(mode) == "strict" else F.regexp_replace(line, LEADING_BLANKS, "")
    return F.rtrim(F.substring(signed, 2, 2**31 - 1), F.lit("\r"))


def parse_patch(patch: Column, mode: str = "strict") -> Column:
    """struct(deleted array, added array); NULL arrays for a NULL patch.

    strict: the sign is the first character. lenient: leading blanks are
    skipped before the sign is read and lines starting with ``!`` are left out.
    """
    body = patch_body(patch, mode)
    before = "" if mode == "strict" else r"(?!!)[\s\p{Z}\x0b\x1c-\x1f\x85&&[^\n]]*"

    def side(sign: str) -> Column:
        signed_line = rf"(?dm)^{before}{sign}([^\n]*?)\r*$"
        return F.regexp_extract_all(body, F.lit(signed_line), F.lit(1))

    return F.struct(side("-").alias("deleted"), side(r"\+").alias("added"))


def joined_lines(lines: Column) -> Column:
    """One multi-line text; '' where the patch had no line list."""
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))
