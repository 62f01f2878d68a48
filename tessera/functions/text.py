"""Text-cleaning column expressions.

All are built-in Spark expressions (no Python UDF); each has a SQL twin in the
oracle written with the same regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Python's str.strip() removes Unicode whitespace, including newline and
# NBSP; Spark's trim() removes only spaces, hence a regular expression.
STRIP_PATTERN = "^[\\s\u00a0]+|[\\s\u00a0]+$"
# Strings that count as "no answer" when a category is checked.
INVALID_TOKENS = ("nan", "None", "")
DIGITS_PATTERN = r"^[0-9]+$"
SIGNED_DIGITS_PATTERN = r"^-*[0-9]+$"
# --------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading/trailing whitespace including newline and NBSP."""
    return F.regexp_replace(_c(c), STRIP_PATTERN, "")


def is_digit_string(c, signed: bool = False) -> Column:
    """True for all-digit strings (question-number artefacts, X7)."""
    pat = SIGNED_DIGITS_PATTERN if signed else DIGITS_PATTERN
    return F.regexp_like(strip(_c(c)), F.lit(pat))


def digits_to_null(c) -> Column:
    """Null the all-digit artefacts, keep everything else unchanged."""
    col = _c(c)
    return F.when(~is_digit_string(col), col)


def is_valid_category(c) -> Column:
    """Not null, not 'nan'/'None'/'' after strip, not a signed digit string."""
    col = _c(c).cast("string")
    s = strip(col)
    return (col.isNotNull() & ~s.isin(*INVALID_TOKENS)
            & ~F.regexp_like(s, F.lit(SIGNED_DIGITS_PATTERN)))


def valid_category(c) -> Column:
    """The stripped category when valid, else null."""
    col = _c(c).cast("string")
    return F.when(is_valid_category(col), strip(col))


def contains_any(c, keywords) -> Column:
    """Substring test against a keyword list."""
    col = _c(c)
    out = F.lit(False)
    for k in keywords:
        out = out | col.contains(k)
    return out


def replace_map(c, mapping: dict) -> Column:
    """Value replacement with pass-through for unmapped values."""
    col = _c(c)
    if not mapping:
        return col
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col), col)


def truncate(c, n: int) -> Column:
    """First n characters (X11)."""
    return F.substring(_c(c), 1, n)
