"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscograph.functions.text import n_tokens

# Kinds of boundary from the most to the least natural, as patterns on UTF-8 that end where a cut may fall, and the penalty of a cut.
_END = rb"(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xef\xbc\x9b|\xe2\x80\xa6)(?:\xe2\x80\x9d|\xe2\x80\x99|\xef\xbc\x89|\xe3\x80\x8d)*[ \t]*"
KINDS = (
    ("paragraph", 0.0, re.compile(rb"(?:\r\n|\r|\n)(?:[ \t]*(?:\r\n|\r|\n))+")),
    ("line", 0.05, re.compile(rb"\r\n|\r|\n")),
    ("sentence", 0.2, re.compile(rb"[.!?]+[\"')\]]*[ \t]+|" + _END)),
    ("clause", 0.8, re.compile(rb"[,;:][ \t]+|\xef\xbc\x8c|\xe3\x80\x81|\xef\xbc\x9a")),
    ("word", 1.5, re.compile(rb"[ \t]+")),
    ("character", 4.0, re.compile(rb"[\x00-\x7f\xc0-\xff][\x80-\xbf]*")),
)
#: These are offered for every cut at first; the kinds after them only in stretches that these leave too long, or where they might make a better cut.
_FIRST = 3


def _positions(data: bytes, step: int, everywhere: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a cut may fall, with the kind of each; at most step apart. The first kinds are offered everywhere."""
    kind: dict[int, int] = {}
    for k in range(everywhere - 1, -1, -1):
        kind.update((m.end(), k) for m in KINDS[k][2].finditer(data))
    for k in range(everywhere, len(KINDS)):
        ends = [0, *sorted(kind), len(data)]
        wide = [(a, b) for a, b in zip(ends, ends[1:]) if b - a > step]
        if not wide:
            break
        for a, b in wide:
            for m in KINDS[k][2].finditer(data, a, b):
                kind.setdefault(m.end(), k)
    kind.pop(0, None)
    kind[len(data)] = 0
    at = np.fromiter(sorted(kind), dtype=np.int64, count=len(kind))
    return at, np.fromiter((kind[int(p)] for p in at), dtype=np.int64, count=len(kind))


def cuts(data: bytes, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of the pieces of data, by dynamic programming over the boundary positions.

    The cost of a way to cut is, over its pieces, 1 each, the penalty of the boundary at the end and the squared deviation of the
    length from the mean length of the fewest possible pieces, as a share of limit. A piece starts overlap bytes before the end
    of the one before, or up to 3 more where that would be inside a character.
    """
    n = len(data)
    if n <= limit:
        return [(0, n, "end")] if n else []
    fewest = -(-(n - overlap) // (limit - overlap))
    for everywhere in range(_FIRST, len(KINDS) - 1):
        cost, out = _cheapest(data, limit, overlap, fewest, everywhere)
        # A way with a cut of a later kind costs its penalty and a piece for each of the fewest possible, at least.
        if cost <= fewest + KINDS[everywhere][1]:
            break
    return out


def _cheapest(data: bytes, limit: int, overlap: int, fewest: int, everywhere: int) -> tuple[float, list[tuple[int, int, str]]]:
    n = len(data)
    at, kind = _positions(data, limit - overlap - 3, everywhere)
    starts = np.maximum(at - overlap, 0)
    raw = np.frombuffer(data, dtype=np.uint8)
    for _ in range(3):
        starts = np.where((raw[np.minimum(starts, n - 1)] & 0xC0) == 0x80, starts - 1, starts)
    ideal = (n + (fewest - 1) * overlap) / fewest
    # State 0 is the start of the text, state i the cut at at[i-1].
    begin = np.concatenate(([0], starts)).astype(np.float64)
    penalty = np.array([x[1] for x in KINDS])[kind] + 1.0
    cost, back = np.full(len(at) + 1, np.inf), np.zeros(len(at) + 1, dtype=np.int64)
    cost[0] = 0.0
    first = np.searchsorted(begin, at - limit)  # the earliest state whose piece may end here
    for i in range(1, len(at) + 1):
        low = first[i - 1]
        if low >= i:
            continue
        off = (at[i - 1] - begin[low:i] - ideal) / limit
        total = cost[low:i] + off * off
        best = int(total.argmin())
        cost[i], back[i] = total[best] + penalty[i - 1], low + best
    out, i = [], len(at)
    while i:
        j = int(back[i])
        out.append((int(begin[j]), int(at[i - 1]), "end" if i == len(at) else KINDS[kind[i - 1]][0]))
        i = j
    return float(cost[-1]), out[::-1]


def split(df: DataFrame, key: str, text: str, limit: int = 3000, overlap: int = 300) -> DataFrame:
    """Pieces of the items over limit tokens: key, piece_no (from 1), start, n_tokens, boundary (at the end), piece.

    A token is a UTF-8 byte; pieces hold whole characters, have at most limit tokens and share overlap tokens with the one before
    (up to 3 more where a character would be cut). Cuts fall between paragraphs, lines, sentences, clauses, words or characters, whichever way is cheapest
    by cuts(); clauses are only looked at where a bound on the cost doesn't rule them out, and words and characters only in stretches without any other end
    that are longer than a piece may advance. Items of limit tokens or
    fewer, null and empty ones give no row; null keys and repeated rows are split like others. No shuffle: only oversized rows
    reach Python, each on its own, so no grouping can be skewed.
    """
    if not 0 <= overlap < limit - 8:
        raise ValueError("overlap must leave room in a piece")
    big = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(n_tokens(F.col("t")) > limit)
    kind = dict(df.dtypes)[key]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                data = t.encode("utf-8", "surrogatepass")
                rows += [(k, no, a, b - a, what, data[a:b].decode("utf-8", "replace")) for no, (a, b, what) in enumerate(cuts(data, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=["k", "piece_no", "start", "n_tokens", "boundary", "piece"])

    out = big.mapInPandas(pieces, f"k {kind}, piece_no int, start long, n_tokens int, boundary string, piece string")
    return out.withColumnRenamed("k", key)
