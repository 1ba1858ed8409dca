"""Column helpers for text: Python-like strip, whitespace collapse, regex offsets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes Unicode white space and the separators \x1c-\x1f.
_WS = r"[\s\x{1c}-\x{1f}]"
_STRIP = rf"(?U)^{_WS}+|{_WS}+$"


def pystrip(c: Column | str) -> Column:
    """``str.strip()`` of Python: Unicode white space at both ends."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, _STRIP, "")


def collapse_ws(c: Column) -> Column:
    """``re.sub(r'\\s+', ' ', s)`` with Python's Unicode ``\\s``."""
    return F.regexp_replace(c, rf"(?U){_WS}+", " ")


def sq(s: str) -> str:
    """SQL string literal for a Python string (Spark dialect: backslash escapes)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


_MARK = "\u0001"


def _unmarked(c: Column) -> Column:
    # same length, same character classes
    return F.translate(c, _MARK, "\u001a")


def match_pieces(c: Column, pattern: str) -> Column:
    """The text cut at every match of ``pattern``: text at even, matches at odd indices, so
    offsets are running lengths.  A U+0001 of the text itself is read as U+001A."""
    return F.split(F.regexp_replace(_unmarked(c), pattern, _MARK + "$0" + _MARK), _MARK)


def cut_before(c: Column, pattern: str) -> Column:
    """The text cut before every match of ``pattern`` (U+0001 read as U+001A)."""
    return F.split(F.regexp_replace(_unmarked(c), pattern, _MARK + "$0"), _MARK)
