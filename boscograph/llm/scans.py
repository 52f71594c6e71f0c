"""Noise in text from scanned pages."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscograph.session import cut_table

# What scanning makes of a letter (true, seen).
CONFUSED = (
    ("m", "rn"), ("n", "ri"), ("u", "ii"), ("w", "vv"), ("d", "cl"), ("e", "c"), ("r", "i"), ("i", "l"), ("l", "1"), ("l", "i"), ("i", "1"), ("o", "0"), ("a", "o"), ("t", "f"), ("f", "t"),
    ("h", "b"), ("b", "h"), ("s", "5"), ("g", "9"), ("b", "6"), ("c", "e"), ("o", "a"), ("n", "u"), ("u", "n"), ("1", "l"), ("0", "o"), ("5", "s"), ("6", "b"), ("9", "g"), ("z", "2"), ("2", "z"), ("8", "b"), ("b", "8"),
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d"),
)
# Chinese characters that scanning takes for one another.
CONFUSED_HAN = (
    "间问", "病痛", "干千", "菌茵", "木本", "人入", "数敷", "冠寇", "树村", "处外", "侧测", "株抹", "白自", "天夭", "枝技", "日曰", "土士", "未末", "大太", "己已", "王玉", "目日", "叶吐", "林材", "虫虽", "果杲", "体休", "区匹", "根恨", "折拆", "候侯", "今令", "鸟乌", "壳亮",
)
# The strokes that a letter is made of, alike for letters that are confused.
STROKES = str.maketrans({
    **dict.fromkeys("ril1|", "l"), **dict.fromkeys("nu", "ll"), "m": "lll", "w": "vv", "d": "cl", **dict.fromkeys("ce", "c"), **dict.fromkeys("o0a", "o"), **dict.fromkeys("s5", "s"),
    **dict.fromkeys("g9", "g"), **dict.fromkeys("b68h", "b"), **dict.fromkeys("tf", "t"), **dict.fromkeys("z2", "z"),
})

#: Log probability of one misread letter, on average over the confusions; each one's own is estimated from the corpus.
MISREAD = math.log(0.003)
_LONGEST_WORD = 40

WORD = re.compile(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*")
_MARK = "-‐‑–¬\xad"
_MARKS = frozenset(_MARK)
_CUT = re.compile(rf"[{_MARK}][^\S\n]*\n\s*")
_NUMBER = r"(?:[0-9lIOoSB]{1,4}|[ivxlc]{1,9})"
_PAGE = re.compile(rf"(?:(?:page|p\.|pp\.|pg\.?|p[ao]ge)\s*(?P<a>{_NUMBER})(?:\s*(?:of|/)\s*{_NUMBER})?|第\s*(?P<b>{_NUMBER})\s*页(?:\s*[/，,共]+\s*{_NUMBER}\s*页?)?|(?P<c>{_NUMBER})\s*/\s*{_NUMBER}|[-—–·•~\[(<|]+\s*(?P<d>{_NUMBER})\s*[-—–·•~\])>|]+)", re.I)
_BARE = re.compile(_NUMBER)
_TABLE = re.compile(r"(?:t[ao]b[l1i][ec]|fig(?:ure|\.)?|表|图)\s*[0-9lIO]{1,3}[.:：]?", re.I)
_HEADING = re.compile(r"(?:#+\s|[0-9lIO]{1,2}(?:\.[0-9]{1,2})*[.、．]\s*\S)")
_ENDED = re.compile(r"[.!?;,。！？；，、：:)）]['\"”」]*$")
_HAN = "一-鿿"
_LAST = re.compile(r"(?:[^\W_]+(?:[-'][^\W_]+)*)?$")
_NOT_LETTER = re.compile(rf"[^a-z0-9{_HAN}]+")
_ALONE = re.compile(r"(?<![a-z0-9])[0-9]+(?![a-z0-9])|^\W*[lio](?=\W)|(?<=\s)[lio]\W*$")
_ALT: dict[str, str] = {}
for _pair in CONFUSED_HAN:
    for _x, _y in (_pair, _pair[::-1]):
        _ALT[_x] = _ALT.get(_x, "") + _y
_RISKY = re.compile("[" + "".join(_ALT) + "]")
_AROUND = re.compile("(?=(..[" + "".join(_ALT) + "]..))", re.S)


def strokes(s: str) -> str:
    return s.translate(STROKES)


@lru_cache(200_000)
def misread(true: str, seen: str) -> tuple[tuple[str, str], ...] | None:
    """The fewest confusions that make `seen` of `true`, or None if there is no way."""
    best: dict[int, dict[int, tuple]] = {0: {0: ()}}

    def reach(i: int, j: int, way: tuple) -> None:
        to = best.setdefault(i, {})
        if j not in to or len(way) < len(to[j]):
            to[j] = way

    for i in range(len(true)):
        row = best.get(i, {})
        for j in sorted(row):
            if j < len(seen) and true[i] == seen[j]:
                reach(i + 1, j + 1, row[j])
            for a, b in _RULES.get(true[i], ()):
                if true.startswith(a, i) and seen.startswith(b, j):
                    reach(i + len(a), j + len(b), (*row[j], (a, b)))
    return best.get(len(true), {}).get(len(seen))


_RULES: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _a, _b in CONFUSED:
    _RULES[_a[0]].append((_a, _b))


def _ratio(word: str) -> float:
    """A word seen fewer times than this share of a look-alike's is taken for a misread one."""
    n = len(word)
    return 0.02 if n <= 2 else 0.04 if n == 3 else 0.08 if n == 4 else 0.2 if n <= 6 else 0.34


def _key(line: str) -> str:
    """Letters of a line in strokes; running headers have the same on every page."""
    return strokes(_NOT_LETTER.sub("", _ALONE.sub("", line.lower())))


def _width(lines: list[str]) -> int:
    n = sorted(len(x) for x in lines if x.strip())
    return n[int(0.8 * (len(n) - 1))] if n else 0


class Layout:
    """Lines of one text that don't belong to its paragraphs: page numbers, running headers, tables."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.width = _width(lines)
        self.keys: dict[int, str] = {}
        self.pages: dict[int, int | None] = {}
        self.tables: set[int] = set()
        self.short: list[int] = []
        bare, in_table = [], False
        room = max(12, 0.8 * self.width)
        for i, line in enumerate(lines):
            if len(line) > room:
                in_table = False
                continue
            s = line.strip()
            if not s:
                continue
            if _TABLE.fullmatch(s):
                in_table = True
                self.tables.add(i)
            elif m := _PAGE.fullmatch(s):
                self.pages[i] = _value(m["a"] or m["b"] or m["c"] or m["d"])
            elif _BARE.fullmatch(s):
                bare.append((i, s, in_table))
            else:
                if not _ENDED.search(s) and not _HEADING.match(s):
                    self.short.append(i)
                elif in_table:
                    in_table = False
        if bare:
            at = {i for i, _, _ in bare}
            row = lambda i: {i - 1, i + 1} <= at or {i - 2, i - 1} <= at or {i + 1, i + 2} <= at  # noqa: E731  three in a row are figures
            self._bare([(i, s, t or row(i)) for i, s, t in bare])

    def _bare(self, bare: list[tuple[int, str, bool]]) -> None:
        """Bare numbers are page numbers outside of tables, and in tables where they fit the pages around."""
        plain = any(not t for _, _, t in bare)
        bare = [(i, s, t and (s.isdigit() or s in "lIO")) for i, s, t in bare]  # a table has no Roman numerals
        for i, s, in_table in bare:
            if not in_table and _value(s) is not None:
                self.pages[i] = _value(s)
        if self.pages and not plain:
            self.tables.update(i for i, _, t in bare if t)  # another way of numbering is in use
            return
        sure = sorted((i, v) for i, v in self.pages.items() if v is not None)
        steps = [(b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(sure, sure[1:]) if b[1] > a[1]]
        step = sorted(steps)[len(steps) // 2] if steps else None
        short = set(self.short)
        for i, s, in_table in bare:
            if in_table:
                v, fits = _value(s), False
                if v is not None and sure:
                    near = min(sure, key=lambda x: abs(x[0] - i))
                    gap = step or 0
                    fits = bool(gap) and v != near[1] and abs((i - near[0]) - (v - near[1]) * gap) <= max(2, 0.15 * gap)
                    fits = fits or (not gap and i == len(self.lines) - 1 and v == near[1] + 1)
                    before = max((x for x in sure if x[0] < i), default=None)
                    after = min((x for x in sure if x[0] > i), default=None)
                    in_turn = (before is None or v == before[1] + 1) and (after is None or v == after[1] - 1)
                    fits = fits or (in_turn and any(j in short for j in (i - 1, i + 1)))  # beside what may be a header
                if fits:
                    self.pages[i] = v
                else:
                    self.tables.add(i)

    def key(self, i: int) -> str:
        if i not in self.keys:
            self.keys[i] = _key(self.lines[i])
        return self.keys[i]

    def beside_page(self, i: int) -> bool:
        for way in (-1, 1):
            j = i + way
            while 0 <= j < len(self.lines) and not self.lines[j].strip():
                j += way
            if j in self.pages:
                return True
        return False

    def headers(self, known: frozenset[str] | set[str]) -> set[int]:
        """Running headers: lines whose letters are those of a known header or of another short line of this text, and a repeated or cut title."""
        keys = {i: self.key(i) for i in self.short}
        times = Counter(keys.values())
        first = next((i for i, x in enumerate(self.lines) if x.strip()), 0)
        title = _key(self.lines[first].lstrip("# ")) if self.lines else ""
        out = set()
        start = self.lines[first].lstrip("# ")[:3].lower() if self.lines else ""
        most = len(self.lines[first]) + 16 if len(title) >= 5 else 0  # the title may be as long as a line of text; a page number may stand beside it
        for i, x in enumerate(self.lines):
            if len(x) <= most and i > first and x and i not in keys and (x[-1].isdigit() or x[0].isdigit() or x[-1] in "….|" or x[:3].lower() == start):
                k = self.key(i)
                if len(k) >= 5 and title.startswith(k):
                    out.add(i)
        for i, k in keys.items():
            if i == first and k not in known:
                continue
            if len(k) < 3:
                continue
            cut_title = len(k) >= 5 and title.startswith(k) and i != first
            if k in known or cut_title or (times[k] > 1 and (self.beside_page(i) or k == keys.get(first) or times[k] > 2)):
                out.add(i)
        return out


def _value(s: str) -> int | None:
    """The number that a page number says, misread digits and small Roman numerals included."""
    t = s.translate(str.maketrans("lIOoSB", "110058"))
    if t.isdigit():
        return int(t)
    s, total = s.lower(), 0
    if not re.fullmatch(r"[ivxlc]+", s):
        return None
    worth = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    for a, b in zip(s, s[1:] + " "):
        total += -worth[a] if b in worth and worth[a] < worth[b] else worth[a]
    return total


def _whole_words(text: str) -> str:
    """The text without words that the end of a line cuts."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        a = max(text.rfind(" ", at, m.start()), text.rfind("\n", at, m.start()), at - 1) + 1
        out.append(text[at:a])
        at = m.end()
        while at < len(text) and not text[at].isspace():
            at += 1
    return "".join([*out, text[at:]])


def _contexts(text: str) -> list[str]:
    """Two characters before and after each Chinese character that may be misread, lines run together."""
    return _AROUND.findall("  " + text.replace("\n", "").replace("\u3000", "") + "  ") if _RISKY.search(text) else []


class Counts:
    """Counts of some texts: pieces between blanks first, words only when they are given out."""

    def __init__(self):
        self.one: Counter = Counter()
        self.two: Counter = Counter()
        self.han: Counter = Counter()
        self.lines: Counter = Counter()

    def add(self, text: str) -> None:
        pieces = _whole_words(text).lower().split()
        self.one.update(pieces)
        self.two.update(zip(pieces, pieces[1:]))
        self.han.update(_contexts(text))
        layout = Layout(text.split("\n"))
        if layout.pages:
            self.lines.update({("h", k) for i in layout.short if layout.beside_page(i) and len(k := layout.key(i)) >= 3})
        self.lines.update({("s", layout.key(i)) for i in layout.short})

    def __len__(self) -> int:
        return len(self.one) + len(self.two) + len(self.han) + len(self.lines)

    def rows(self) -> pd.DataFrame:
        words = {t: [w for w in WORD.findall(t) if len(w) <= _LONGEST_WORD] for t in self.one}
        out: Counter = Counter()
        for t, n in self.one.items():
            for w in words[t]:
                out["1", w, ""] += n
        for (a, b), n in self.two.items():
            if words[a] and words[b]:
                out["2", words[a][-1], words[b][0]] += n
        for c, n in self.han.items():
            out["z", c, ""] += n
        for (kind, k), n in self.lines.items():
            out[kind, k, ""] += n
        keys = list(out)
        return pd.DataFrame({"kind": [k[0] for k in keys], "a": [k[1] for k in keys], "b": [k[2] for k in keys], "n": list(out.values())})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of a task, given out whenever they fill up."""
    counts = Counts()
    for pdf in batches:
        for text in pdf["t"]:
            counts.add(text)
            if len(counts) > 1_000_000:
                yield counts.rows()
                counts = Counts()
    if len(counts):
        yield counts.rows()


class Model:
    """Counts of the corpus, and what follows from them for one text. What takes a pass over all words is done once, in the driver, and travels as parts()."""

    def __init__(self, rows: list[tuple[str, str, str, int]], least: int):
        self.least = least
        self.one: dict[str, int] = {}
        self.two: dict[tuple[str, str], int] = {}
        self.han: dict[str, int] = {}
        beside, short = {}, {}
        for kind, a, b, n in rows:
            if kind == "1":
                self.one[a] = n
            elif kind == "2":
                self.two[a, b] = n
            elif kind == "z":
                for i in range(3):
                    self.han[a[i : i + 3]] = self.han.get(a[i : i + 3], 0) + n
            elif kind == "h":
                beside[a] = n
            else:
                short[a] = n
        self.known = {k for k, n in beside.items() if n >= 2 and n >= 0.3 * short.get(k, n)}
        self.total = max(1, sum(self.one.values()))
        self.like: dict[str, list[str]] = defaultdict(list)
        for w in self.one:
            if not w.isdigit():
                self.like[strokes(w)].append(w)
        self.like = {k: v for k, v in self.like.items() if len(v) > 1 or self.one[v[0]] > self.least}
        self.cost = dict.fromkeys(CONFUSED, MISREAD)
        better = {w: x for w in self.one if (x := self._better(w))}
        self.safe = set(self.one) - set(better)
        self._estimate(better)
        self._ready()

    def _estimate(self, better: dict[str, tuple[tuple[str, float], ...]], rounds: int = 3, prior: float = 2000.0) -> None:
        """Probability of each confusion by EM: words that may be misread ones are shared out over their look-alikes by frequency times confusions, and each confusion's part is set
        against the letters that it could have struck. The mean over all letters stays that of MISREAD, since only some texts are scans; one confusion keeps within a factor of ten of it."""
        could: Counter = Counter()
        for w, n in self.one.items():
            for r in {r for ch in set(w) for r in _RULES.get(ch, ())}:
                if k := w.count(r[0]):
                    could[r] += k * n
        ways = [(self.one[w], [(self.one[c], misread(c, w)) for c, _ in cs]) for w, cs in better.items()]
        for _ in range(rounds):
            got: Counter = Counter()
            for n, cs in ways:
                weight = [m * math.exp(sum(self.cost[r] for r in way)) for m, way in cs]
                whole = sum(weight)
                for x, (_, way) in zip(weight, cs):
                    for r in way:
                        got[r] += n * x / whole
            mean = (sum(got.values()) + 1e-9) / (sum(could.values()) + 1)
            rate = {r: (got[r] + prior * mean) / (could[r] + prior) / mean for r in CONFUSED}
            self.cost = {r: MISREAD + math.log(min(10.0, max(0.1, x))) for r, x in rate.items()}

    def parts(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("options", "judged", "fine", "fine_han")}

    @classmethod
    def of(cls, parts: dict) -> Model:
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        out._ready()
        return out

    def _ready(self) -> None:
        self.options = lru_cache(200_000)(self._better)
        self.judged = lru_cache(200_000)(self._judge_han)
        self.fine: set[str] = set()
        self.fine_han: set[str] = set()

    def doubtful(self, text: str) -> set[str]:
        """Words of the text that may be misread ones."""
        out = set()
        for piece in set(text.lower().split()) - self.fine:
            bad = [w for w in WORD.findall(piece) if w not in self.safe and self.options(w)]
            if bad:
                out.update(bad)
            elif len(self.fine) < 500_000 and len(piece) < 100:
                self.fine.add(piece)
        return out

    def doubtful_han(self, text: str) -> bool:
        """Whether a Chinese character of the text is likely misread."""
        out = False
        for c in set(_contexts(text)) - self.fine_han:
            if self.judged(c) != c[2]:
                out = True
            elif len(self.fine_han) < 500_000:
                self.fine_han.add(c)
        return out

    def _better(self, w: str) -> tuple[tuple[str, float], ...]:
        """Look-alikes so much more frequent than w that w may be one of them misread, with the log probability of the confusions that make w of them."""
        if w.isdigit() or len(w) > _LONGEST_WORD:
            return ()
        n = self.one.get(w, self.least - 1)
        out = []
        for c in self.like.get(strokes(w), ()):
            if c != w and n < _ratio(c) * self.one[c]:
                way = misread(c, w)
                if way is not None and len(way) <= max(1, len(c) // 2):
                    out.append((c, sum(self.cost[r] for r in way)))
        return tuple(out)

    def _log(self, a: str, b: str, seen: bool) -> float:
        """log P(b | a); seen: b is under suspicion and its own counts may be those of misread words."""
        n, one = self.two.get((a, b), 0), self.one.get(b, 0)
        if seen:
            most = max((self.two.get((a, c), 0) for c, _ in self.options(b)), default=0)
            n, one = max(0.0, n - 0.34 * most), 0.1
        times = self.one.get(a, 0)
        if a not in self.safe:  # as often as what it may be a misreading of
            times = max([times, *(self.one[c] for c, _ in self.options(a))])
        return math.log((n + 3 * (one + 0.1) / self.total) / (times + 3))

    def decode(self, words: list[str], last: str = "") -> list[str]:
        """The likeliest words of a line (Viterbi) after the word `last`; a word with no look-alike stands for itself."""
        states = [((w, 0), *self.options(w)) if w not in self.safe else ((w, 0),) for w in words]
        out: list[str] = list(words)
        i = 0
        while i < len(words):
            if len(states[i]) == 1:
                i += 1
                continue
            end = i
            while end < len(words) and len(states[end]) > 1:
                end += 1
            before = {out[i - 1] if i else last: (0.0, ())}
            for p in range(i, end):
                now = {}
                for c, k in states[p]:
                    now[c] = max((v + self._log(a, c, k == 0) + k, (*path, c)) for a, (v, path) in before.items())
                before = now
            after = words[end] if end < len(words) else ""
            best = max((v + (self._log(a, after, False) if after else 0.0), path) for a, (v, path) in before.items())[1]
            out[i:end] = best
            i = end
        return out

    def _judge_han(self, context: str) -> str:
        """The likeliest character in the middle of the context (two characters on either side), by Viterbi over the three trigrams that hold it: characters beside it that may be misread are chosen along with it."""
        seen = context[2]
        ways = [c + _ALT.get(c, "") for c in context]
        # A state holds the last two characters chosen; the trigrams ending at places 2, 3 and 4 are those with the middle in them.
        now = {(a, b): ((MISREAD / 2) * ((a != context[0]) + (b != context[1])), "") for a in ways[0] for b in ways[1]}
        for p in (2, 3, 4):
            step: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (v, mid) in now.items():
                top = max((self.han.get(a + b + c, 0) for c in _ALT.get(context[p], "")), default=0) if p == 2 else 0
                for c in ways[p]:
                    n = self.han.get(a + b + c, 0)
                    m = c if p == 2 else mid
                    if m == seen:  # its own counts may be those of misread characters
                        other = top if p == 2 else max((self.han.get((a + b + c).replace(seen, x), 0) for x in _ALT[seen]), default=0)
                        n = max(0.0, n - 0.1 * other)
                    w = v + math.log(n + 0.05) + (MISREAD / 2 if c != context[p] else 0.0)
                    if (b, c) not in step or w > step[b, c][0]:
                        step[b, c] = (w, m)
            now = step
        best = max(now.values(), key=lambda x: (x[0], x[1] == seen))
        return best[1]


class Repair:
    """Damage and repaired paragraphs of one text after another."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, text: str) -> tuple[str, list[tuple[int, str]]]:
        model, found = self.model, set()
        lines = text.split("\n")
        layout = Layout(lines)
        headers = layout.headers(model.known)
        aside = headers | set(layout.pages)
        found.update((i + 1, "header") for i in headers)
        found.update((i + 1, "page_no") for i in layout.pages if i not in headers)
        body = [i for i in range(len(lines)) if i not in aside]
        fixed = {i: lines[i] for i in body}

        # Words cut at the end of a line.
        joined: dict[int, int] = {}
        for p, i in enumerate(body):
            line = fixed[i].rstrip()
            if line[-1:] not in _MARKS or not line[-2:-1].isalnum():
                continue
            j = next((k for k in body[p + 1 :] if lines[k].strip() and k not in layout.tables), None)
            if j is None or not (t := re.match(r"\s*([^\W_]+(?:[-'][^\W_]+)*)", fixed[j])):
                continue
            piece = line[max(line.rfind(" "), line.rfind("\u3000")) + 1 : -1]
            head, tail = _LAST.search(piece[-2 * _LONGEST_WORD :])[0], t[1]
            if head and self._one_word(head, tail, line[-1]):
                found.add((i + 1, "break"))
                joined[i] = j
                true = self._whole(head + tail)
                if true.lower() != (head + tail).lower():
                    k = len(head)
                    wrong_head, wrong_tail = not true.lower().startswith(head.lower()), not true.lower().endswith(tail.lower())
                    if wrong_head or not wrong_tail:
                        found.add((i + 1, "misread"))
                    if wrong_tail:
                        found.add((j + 1, "misread"))
                fixed[i] = line[: len(line) - 1 - len(head)]
                fixed[j] = fixed[j][: t.start(1)] + "\0" + true + "\0" + fixed[j][t.end(1) :]

        # Misread characters.
        doubtful, han = model.doubtful("\n".join(fixed.values())), model.doubtful_han(text)
        last = ""
        for i in body if doubtful or han else ():
            line = fixed[i]
            if doubtful and line:
                words = WORD.findall(line)
                low = [w.lower() for w in words]
                before, last = last, low[-1] if low else last
                if not doubtful.isdisjoint(low):
                    true = model.decode(low, before)
                    if true != low:
                        fixed[i] = line = self._put(line, words, low, true)
                        found.add((i + 1, "misread"))
            if han:
                new = self._han(i, body, fixed)
                if new != line:
                    fixed[i] = new
                    found.add((i + 1, "misread"))
        return self._paragraphs(body, fixed, layout, joined), sorted(found)

    def _one_word(self, head: str, tail: str, mark: str) -> bool:
        """Whether head and tail are one word cut by the layout, rather than parts around a hyphen of its own."""
        one = self.model.one
        whole, parts = (head + tail).lower(), f"{head}-{tail}".lower()
        a, b = one.get(whole, 0), one.get(parts, 0)
        if not a and not b:
            a = max((one[c] for c, _ in self.model.options(whole)), default=0)
            b = max((one[c] for c, _ in self.model.options(parts)), default=0)
        if a or b:
            return a > b
        if any(ch.isdigit() for ch in head[-1:] + tail[:1]):
            return False
        return mark != "-" or not (one.get(head.lower(), 0) and one.get(tail.lower(), 0))

    def _whole(self, word: str) -> str:
        options = self.model.options(word.lower()) if word.lower() not in self.model.safe else ()
        if not options:
            return word
        best = max(options, key=lambda x: (self.model.one[x[0]] > 0, x[1] + math.log(self.model.one[x[0]])))[0]
        return _cased(word, best)

    @staticmethod
    def _put(line: str, words: list[str], low: list[str], true: list[str]) -> str:
        out, at = [], 0
        for w, a, b in zip(words, low, true):
            p = line.index(w, at)
            out += [line[at:p], w if a == b else _cased(w, b)]
            at = p + len(w)
        return "".join([*out, line[at:]])

    def _han(self, i: int, body: list[int], fixed: dict[int, str]) -> str:
        """Line i with its misread Chinese characters replaced; words run on over line ends."""
        line = fixed[i]
        before = fixed.get(i - 1, "")[-2:]
        after = fixed.get(i + 1, "").lstrip("\u3000 ")[:2]
        whole = before.rjust(2) + line + after.ljust(2)
        out = list(line)
        for m in _RISKY.finditer(line):
            context = whole[m.start() : m.start() + 5].replace("\u3000", " ")
            if context not in self.model.fine_han:
                out[m.start()] = self.model.judged(context)
        return "".join(out)

    @staticmethod
    def _paragraphs(body: list[int], fixed: dict[int, str], layout: Layout, joined: dict[int, int]) -> str:
        """Lines put together: a paragraph ends at a blank line, a heading, a figure, or a line that is ended and short."""
        longest = max((len(layout.lines[i]) for i in body), default=0)
        if layout.width > 200 or longest > 2 * layout.width + 40:  # not wrapped: a line is a paragraph
            return "\n\n".join(s for i in body if (s := fixed[i].strip().replace("\0", "")))
        out: list[str] = []
        open_at: int | None = None
        brief = 0.75 * layout.width
        for i in body:
            x = fixed[i]
            s = x.strip()
            if not s:
                if i not in joined:
                    open_at = None
                continue
            heading = s[0] in "#0123456789lIO" and _HEADING.match(s) is not None
            figure = i in layout.tables
            if open_at is None or heading or figure or x[0] in "\u3000\t":
                out.append(s)
            else:
                last = out[-1]
                if s[0] == "\0":
                    glue = "" if last[-1:] in ("(", "-", "/", "“") or not last else " "
                else:
                    glue = "" if last[-1] > "\u2e7f" or s[0] > "\u2e7f" or (last[-1] == "-" and last[-2:-1].isalnum()) else " "
                out[-1] = last + glue + s
            ended = heading or figure or (len(x) < brief and s[-1] in ".!?。！？")
            open_at = None if ended else i
        return "\n\n".join(out).replace("\0", "")


def _cased(seen: str, true: str) -> str:
    return true.upper() if len(seen) > 1 and seen.isupper() else true[:1].upper() + true[1:] if seen[:1].isupper() else true


def repair(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, repaired (paragraphs parted by a blank line) and damage, an array of (line_no, kind), of every row of df.

    Kinds: break, misread, header, page_no as TESTDATA.md says; a header line has no other kind. Null texts give null and no damage,
    empty ones an empty text; null keys and repeated rows are treated like others.

    One pass counts the words, pairs of words, trigrams around confusable Chinese characters and short lines of all texts, with counts
    combined in the task before the shuffle. The model holds every n-gram seen twice or more, in the driver and in
    each task, so memory bounds the corpus (a word left out is still checked, as one seen once). The probability of each letter confusion is estimated by EM over the words that look like more frequent ones. A second pass finds page numbers by their form and sequence, headers by
    what stands beside page numbers anywhere in the corpus and repeats, cut words by whether the corpus knows the
    whole or the hyphenated word, and decodes doubtful words by Viterbi: letter confusions times word pairs. Texts are never cut.
    """
    kind = dict(df.dtypes)[key]
    counts = df.select(F.col(text).alias("t")).where("t <> ''").mapInPandas(_count, "kind string, a string, b string, n long")
    counts = cut_table(counts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where("n > 1"))
    rows = [tuple(r) for r in counts.collect()]
    shared = df.sparkSession.sparkContext.broadcast(Model(rows, 2).parts())

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        do = Repair(Model.of(shared.value))
        for pdf in batches:
            got = [(None, []) if t is None else do(t) for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "repaired": [g[0] for g in got], "damage": [[{"line_no": n, "kind": w} for n, w in g[1]] for g in got]})

    own = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = own.mapInPandas(fix, f"k {kind}, repaired string, damage array<struct<line_no: int, kind: string>>")
    return out.withColumnRenamed("k", key)
