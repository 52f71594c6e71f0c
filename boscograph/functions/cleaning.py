"""Cleaning and cutting of documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boscograph.functions import vocabulary as V

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_OUTER = r"^[ \t\r\n\f\x{0b}\x{a0}\x{3000}]+|[ \t\r\n\f\x{0b}\x{a0}\x{3000}]+$"


def outer(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, _OUTER, "")


def clean(c: Column) -> Column:
    """Control characters dropped, line ends evened out, at most one blank line, outer white space dropped."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x0c\x0e-\x1f]", "")
    c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    return outer(F.regexp_replace(c, "\n{3,}", "\n\n"))


def half_width(c: Column) -> Column:
    return F.translate(c, _WIDE, _NARROW)


def normalise(c: Column, strict_symbols: bool = False) -> Column:
    """Half width, runs of white space as one blank, no control characters; strict_symbols also drops unusual symbols."""
    c = F.regexp_replace(F.regexp_replace(half_width(c), r"[\s\x{a0}\x{3000}]+", " "), r"[\x00-\x1f\x7f-\x{9f}]", "")
    if strict_symbols:
        c = F.regexp_replace(c, r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9\s，。！？；：“”‘’（）()【】\[\]《》<>、·…—\-+=.,!?;:]", "")
    return F.trim(c)


def is_header(line: Column) -> Column:
    """Page header or footer by its form: 5 to 50 characters that fit a pattern or hold a word."""
    s = outer(line)
    fits = s.rlike("(?i)" + "|".join(f"(?:{p})" for p in V.HEADER_PATTERNS))
    for w in V.HEADER_WORDS:
        fits = fits | s.contains(w)
    return F.length(s).between(5, 50) & fits


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def drop_headers(ls: Column) -> Column:
    """Lines without headers, footers and blank ones."""
    return F.filter(ls, lambda x: ~is_header(x) & (outer(x) != ""))


def reference_start(ls: Column) -> Column:
    """Index of the first line of the references, searched in the last fifth; -1 if there is none."""
    n = F.size(ls)
    hits = F.transform(ls, lambda x, i: (i >= 0.8 * n) & (x.rlike(V.REFERENCE_PATTERN) | x.rlike("|".join(V.REFERENCE_WORDS))))
    return (F.coalesce(F.array_position(hits, True), F.lit(0)) - 1).cast("int")


def cut_references(ls: Column) -> Column:
    at = reference_start(ls)
    return F.when(at >= 0, F.slice(ls, F.lit(1), at)).otherwise(ls)


def sentences(c: Column, least: int = 5) -> Column:
    """Sentences by the punctuation at their end, followed by a blank; those under `least` characters are dropped."""
    parts = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?<=[。！？!?；;.])\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: F.length(s) >= least)


def basic_sentences(c: Column, least: int, most: int, stop_words: list[str] | None = None) -> Column:
    """Sentences also without a blank after Chinese marks; kept if their length fits, they aren't only digits, and not mostly stop words."""
    marked = F.regexp_replace(F.regexp_replace(c, "([。！？；])", "$1\u0001"), r"([.!?;])\s", "$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda x: normalise(x))
    keep = F.filter(parts, lambda s: F.length(s).between(least, most) & ~s.rlike(r"^[\d\s]+$"))
    if not stop_words:
        return keep
    stop = F.array(*(F.lit(w) for w in stop_words))

    def light(s: Column) -> Column:
        words = F.split(F.lower(s), r"\W+")
        return (F.size(words) < 3) | (F.size(F.filter(words, lambda w: F.array_contains(stop, w))) / F.size(words) <= 0.8)

    return F.filter(keep, light)


def windows(text: Column, size: int = 3000, step: int = 2700, least: int = 50) -> Column:
    """Overlapping windows of a text as an array of (no, text); those of `least` characters or fewer without outer blanks are dropped."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("no"), F.substring(text, s + 1, F.lit(size)).alias("text")))
    return F.filter(cut, lambda x: F.length(outer(x.text)) > least)


def snippets(text: Column, entity: Column, around: int = 100) -> Column:
    """The surroundings of each occurrence of entity, occurrences not overlapping."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), entity, F.lit(r"\E")))
    ends = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p))
    at = F.aggregate(ends, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + F.length(entity), F.lit(0)) + n)))
    return F.transform(at, lambda p: F.substring(text, F.greatest(p - around, F.lit(0)) + 1, p + F.length(entity) + around - F.greatest(p - around, F.lit(0))))


def table_sentences(header: Column, rows: Column) -> Column:
    """Rows of a table as sentences 'head为cell；head为cell。' for the cells that are filled."""
    def one(row: Column) -> Column:
        cells = F.filter(F.zip_with(header, row, lambda h, c: F.when((h != "") & (c != ""), F.concat(h, F.lit("为"), c))), lambda x: x.isNotNull())
        return F.when(F.size(cells) > 0, F.concat(F.array_join(cells, "；"), F.lit("。")))

    return F.filter(F.transform(rows, one), lambda x: x.isNotNull())


def has_chinese(c: Column) -> Column:
    return c.rlike("[\\x{4e00}-\\x{9fa5}]")


def paper_of(chunk_id: Column) -> Column:
    """The paper that a chunk id of the form {paper}_{counter} names."""
    return F.regexp_replace(chunk_id, "_[0-9]+$", "")


def sections(text: Column) -> Column:
    """Sections of a Markdown text: array of (level, title, content). Text before the first heading has level 0 and no title."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,6}\s+\S)")
    made = F.transform(parts, lambda p: F.struct(
        F.length(F.regexp_extract(p, r"^(#{1,6})\s", 1)).alias("level"),
        outer(F.regexp_extract(p, r"^#{1,6}\s+([^\n]*)", 1)).alias("title"),
        F.filter(F.transform(F.split(F.regexp_replace(p, r"^#{1,6}\s+[^\n]*", ""), "\n"), lambda x: outer(inline(x))), lambda x: x != "").alias("content")))
    return F.filter(made, lambda s: (s.level > 0) | (F.size(s.content) > 0))


def inline(c: Column) -> Column:
    """Links as their text; pictures (after links, so that their mark stays) and inline formulas dropped."""
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", ""), r"\$[^$]*\$", "")


def assemble(secs: Column) -> Column:
    """Sections put together again: without page furniture, cut at the references, headings marked by #."""
    kept = F.transform(secs, lambda s: F.struct(s.level.alias("level"), s.title.alias("title"), F.filter(s.content, lambda x: ~((s.level == 0) & s.title.startswith("Page") & x.rlike(r"(?i)^(?:第?\s*\d+\s*页$|Page\s+\d+|\d+\s*/\s*\d+$|\s*版权所有|\s*Copyright)"))).alias("content")))
    kept = F.filter(kept, lambda s: F.size(s.content) > 0)
    refs = F.transform(kept, lambda s: s.title.rlike("|".join(V.REFERENCE_WORDS)) | F.array_join(F.slice(s.content, 1, 2), " ").rlike("|".join(V.REFERENCE_WORDS)))
    at = F.array_position(refs, True).cast("int")
    kept = F.when(at > 0, F.slice(kept, F.lit(1), at - 1)).otherwise(kept)
    texts = F.flatten(F.transform(kept, lambda s: F.concat(F.when((s.level > 0) & (s.title != ""), F.array(F.concat(F.repeat(F.lit("#"), s.level), F.lit(" "), s.title))).otherwise(F.array().cast("array<string>")), s.content)))
    return clean(F.array_join(texts, "\n\n"))


def rewrite_table_text(c: Column) -> Column:
    """Text made of two or more parts 'X为Y；' or 'X为Y。' as 'X是Y，…。'; other text stays. Rows of a Markdown table and the mark before table text are dropped."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^\|.*\|$", ""), r"表格内容：\s*", "")
    pattern = F.lit("([^；。]+)为([^；。]+)[；。]")
    heads, cells = F.regexp_extract_all(c, pattern, 1), F.regexp_extract_all(c, pattern, 2)
    parts = F.filter(F.zip_with(heads, cells, lambda h, x: F.when((outer(h) != "") & (outer(x) != ""), F.concat(outer(h), F.lit("是"), outer(x)))), lambda x: x.isNotNull())
    return F.when((F.size(heads) > 1) & (F.size(parts) > 0), F.concat(F.array_join(parts, "，"), F.lit("。"))).otherwise(c)


def simplified(c: Column, traditional: str, simple: str) -> Column:
    """Characters of `traditional` as those at the same place in `simple`; the table is the caller's."""
    return F.translate(c, traditional, simple)


def markdown(text: Column) -> Column:
    """Markdown as plain lines: headings marked by 【标题】, rows of tables as their cells, links as their text; code, formulas, pictures, rules of tables and blank lines dropped."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(?:```|$)", ""), r"(?s)\$\$.*?\$\$", "")

    def line(x: Column) -> Column:
        x = outer(x)
        title = F.regexp_extract(x, r"^#{1,6}\s+(.*)$", 1)
        cells = F.filter(F.transform(F.split(x, r"\|"), outer), lambda c: c != "")
        row = x.startswith("|") & x.endswith("|") & (F.length(x) > 1)
        return F.when(title != "", F.concat(F.lit("【标题】"), outer(title))).when(row, F.when(~x.contains("-|"), F.array_join(cells, "，")).otherwise("")).otherwise(outer(inline(x)))

    return F.array_join(F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), line), lambda x: x != ""), "\n")
