"""File mode numbers and their ten-character text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# POSIX file type nibble -> letter.
TYPE_LETTERS = {0o01: "p", 0o02: "c", 0o04: "d", 0o06: "b", 0o10: "-", 0o12: "l", 0o14: "s"}
# Set-id or sticky bit of each permission triple and its letter.
SPECIALS = ((0o4000, "s"), (0o2000, "s"), (0o1000, "t"))


def _has(mode: Column, bit: int) -> Column:
    return mode.bitwiseAND(F.lit(bit)) != 0


def type_letter(mode: Column) -> Column:
    nibble = F.shiftright(mode, 12).bitwiseAND(F.lit(0o17))
    letter = F.lit("?")
    for code, char in TYPE_LETTERS.items():
        letter = F.when(nibble == code, F.lit(char)).otherwise(letter)
    return letter


def mode_to_text(mode: Column | str) -> Column:
    """33204 -> ``-rw-rw-r--``."""
    m = (F.col(mode) if isinstance(mode, str) else mode).cast("int")
    chars = [type_letter(m)]
    for i, (special, char) in enumerate(SPECIALS):
        shift = 6 - 3 * i
        execute = _has(m, 1 << shift)
        chars += [
            F.when(_has(m, 4 << shift), F.lit("r")).otherwise(F.lit("-")),
            F.when(_has(m, 2 << shift), F.lit("w")).otherwise(F.lit("-")),
            F.when(_has(m, special) & execute, F.lit(char))
            .when(_has(m, special), F.lit(char.upper()))
            .when(execute, F.lit("x"))
            .otherwise(F.lit("-")),
        ]
    return F.when(m.isNotNull(), F.concat(*chars))


def text_to_mode(text: Column | str) -> Column:
    """``-rwsr-xr-x`` -> 0o104755; null when the text is not a valid mode."""
    s = F.col(text) if isinstance(text, str) else text
    valid = F.rlike(s, F.lit("^[-dlcbsp]([-r][-w][-xsS]){2}[-r][-w][-xtT]$"))
    value = F.lit(0)
    for code, char in TYPE_LETTERS.items():
        value = F.when(F.substring(s, 1, 1) == char, F.lit(code << 12)).otherwise(value)
    for i, (special, char) in enumerate(SPECIALS):
        shift = 6 - 3 * i
        r, w, x = (F.substring(s, 2 + 3 * i + j, 1) for j in range(3))
        value = (
            value
            + F.when(r == "r", 4 << shift).otherwise(0)
            + F.when(w == "w", 2 << shift).otherwise(0)
            + F.when(x.isin("x", char), 1 << shift).otherwise(0)
            + F.when(x.isin(char, char.upper()), special).otherwise(0)
        )
    return F.when(valid, value.cast("int"))


def mode_first_char(text: Column | str) -> Column:
    return F.substring(F.col(text) if isinstance(text, str) else text, 1, 1)
