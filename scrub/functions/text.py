"""Text functions: decoding, lines, accents, word sequences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Longest part of a line that is looked at, in code points.
LINE_LIMIT = 5_000
#: Line ends: CR LF as one, and LF VT FF CR FS GS RS NEL LS PS.
LINE_END = "\\r\\n|[\\n\\u000B\\f\\r\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"
#: The same for Python code that passes over whole texts; other than ``split_lines`` it leaves an empty line at the end.
LINES = re.compile(LINE_END)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def to_text(content: Column) -> Column:
    """UTF-8 bytes as text; bytes that aren't valid become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def split_lines(text: Column) -> Column:
    """Array of lines; a line end at the very end makes no empty line. Null text gives no lines."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return bind(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def cut_line(line: Column) -> Column:
    return F.substring(line, 1, LINE_LIMIT)


def _fold(s: str | None) -> str | None:
    if s is None or s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks. Spark has no such function; one pass through Arrow."""
    return s.map(_fold)


@F.pandas_udf(StringType())
def norm_key(s: pd.Series) -> pd.Series:
    """Key that two spellings of one term share: no accents, no case, single blanks."""
    return s.map(lambda x: None if x is None else " ".join(_fold(x).casefold().split()))


_WORD = re.compile("[A-Z0-9]+")


def words_of(text: str) -> list[str]:
    """What ``normalize_words`` gives, for Python code that passes over whole texts."""
    return _WORD.findall(_fold(text).upper())


def normalize_words(text: Column) -> Column:
    """Array of upper-case words of A-Z and 0-9, without accents."""
    words = F.split(F.trim(F.regexp_replace(F.upper(fold_accents(text)), "[^A-Z0-9]+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def slugify(text: Column) -> Column:
    """Lower case, no accents, hyphens between words."""
    return F.lower(F.array_join(normalize_words(text), "-"))
