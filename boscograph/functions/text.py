"""Column expressions on names and free text, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-ins that say that a value is not known, folded.
STAND_INS = (
    "n/a", "na", "n.a.", "none", "(none)", "null", "nil", "nan", "unknown", "(unknown)", "not known", "not stated",
    "unspecified", "undefined", "missing", "tbd", "tba", "to be determined", "无", "未知", "待定", "不详", "不明", "暂无", "未定", "空",
)

# Categories that mean "other", folded.
OTHER = ("misc", "misc.", "miscellaneous", "other", "others", "其他", "其它", "杂项", "其余")


def fold(c: Column) -> Column:
    """Outer spaces dropped, runs of spaces made one, lower case; a space is U+0020 only."""
    return F.lower(F.regexp_replace(F.trim(c), " {2,}", " "))


def is_stated(c: Column) -> Column:
    """True where c is neither null, blank nor a stand-in. A text without any letter or digit says nothing either."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]") & ~fold(strip(c)).isin(*STAND_INS), F.lit(False))


def strip(c: Column) -> Column:
    """Outer white space of any kind dropped."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def n_tokens(c: Column) -> Column:
    """Size of a text in tokens of the byte-level tokenizer of ByT5: its UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
