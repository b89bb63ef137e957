"""String expressions whose semantics follow Python and pandas rather than Java."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points that str.strip() removes, as a Java character class.
PY_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

PY_BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# The spellings that pandas reads as missing.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def py_strip(c: Column | str) -> Column:
    """Like ``str.strip()``. Only the ends are read, where an expression would try each blank of the text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(PY_BLANKS))


def strip_left(c: Column, char: str) -> Column:
    """Like ``str.lstrip(char)`` for one character."""
    return F.regexp_replace(c, rf"\A\Q{char}\E+", "")


def strip_right(c: Column, char: str) -> Column:
    """Like ``str.rstrip(char)`` for one character."""
    return F.regexp_replace(c, rf"\Q{char}\E+\z", "")


def stripped_int(s: Column) -> Column:
    """Like ``int(str)`` of a stripped string, with null for ValueError: a sign, single underscores. ASCII digits only."""
    return F.when(s.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), F.replace(s, F.lit("_"), F.lit("")).try_cast("int"))


def missing_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turns the missing-value spellings of pandas into nulls, in all string columns or those named."""
    names = columns or [n for n, t in df.dtypes if t == "string"]
    return df.withColumns({n: F.when(~F.col(n).isin(*NA_VALUES), F.col(n)) for n in names})


def preview(c: Column, most: int = 100) -> Column:
    """The value, cut to ``most`` characters with ``...`` if longer."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
