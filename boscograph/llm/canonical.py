"""Mapping free-entered values to a canonical list."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscograph.session import cut_table, widely

#: The reference list travels to every task; one of more entries is an error (it is a list people keep, not data that grows).
MOST_ENTRIES = 200_000
#: More kinds of words around names than this are an error.
MOST_FRAMES = 10_000
#: The index of the vocabulary is broadcast up to this many rows (16 bytes each); beyond, it is joined by shuffle.
MOST_KEYS = 2_000_000
#: Words around a name are taken for no part of it if they stand around two entries, and around this share of all entries that any words stand around.
FRAME_SHARE = 0.02

# Letters of other alphabets that look like Latin ones.
LOOKALIKE = str.maketrans("аеорсхуіѕјһԁкмтнвԛԝɡοαρνιυκτχ", "aeopcxyisjhdkmthbqwgoapviuktx")
# Shapes that scanning takes for one another, brought to one of them.
_SHAPES = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("|", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"))

_HAN = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"[a-z0-9|]+")
_RUN = re.compile(r"[㐀-鿿]+")


def _shape(t: str) -> str:
    for a, b in _SHAPES:
        t = t.replace(a, b)
    return t


def _plain(s: str) -> str:
    """Width, letter case, look-alike letters and accents evened out."""
    s = unicodedata.normalize("NFKC", s).lower().translate(LOOKALIKE)
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) from a to b, or most + 1 if there are more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, two = row, [i], before
        for j, y in enumerate(b, 1):
            v = last[j - 1] if x == y else 1 + min(last[j - 1], last[j], row[j - 1])
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


def _edits(length: int) -> int:
    return 0 if length < 3 else 1 if length < 5 else 2


#: Kinds of text looked up in the index: a word of a value, and a whole value without its blanks.
_WORD_KIND, _WHOLE_KIND = "w", "j"
_P = np.uint64(0x9E3779B97F4A7C15)


def _deletions(texts: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in texts, hash) of every text with up to `most` letters left out; texts of one length are hashed together."""
    at, out = [], []
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, t in enumerate(texts):
        by_length[len(t)].append(i)
    with np.errstate(over="ignore"):
        for n, places in by_length.items():
            if not n:
                continue
            codes = np.array([[ord(c) for c in texts[i]] for i in places], dtype=np.uint64)
            weight = np.cumprod(np.full(n, _P, dtype=np.uint64), dtype=np.uint64)
            for gone in range(min(most, n) + 1):
                for without in combinations(range(n), gone):
                    left = np.delete(np.arange(n), without)
                    h = (codes[:, left] * weight[: len(left)]).sum(axis=1, dtype=np.uint64)
                    at.append(np.asarray(places))
                    out.append(h ^ (h >> np.uint64(29)))
    return (np.concatenate(at), np.concatenate(out).view(np.int64)) if at else (np.array([], int), np.array([], np.int64))


def _keys(kind: str, texts: list[str], known: bool, longest: int) -> list[np.ndarray]:
    """The keys of each of texts of one kind: two texts within the edits allowed to both share a key. One too long to be near any word of the vocabulary has none."""
    shapes = [_shape(t) for t in texts]
    edits = [_edits(len(t) + (not known)) if kind == _WORD_KIND else 1 for t in texts]
    ways = [(i, x, e) for i, (x, e) in enumerate(zip(shapes, edits))]
    if kind == _WORD_KIND:
        ways += [(i, t, edits[i]) for i, t in enumerate(texts) if t != shapes[i]]
    at, key = [np.array([], int)], [np.array([], np.int64)]
    for most in (1, 2):
        pick = [(i, x) for i, x, e in ways if e == most and 0 < len(x) <= longest + 2]
        a, k = _deletions([x for _, x in pick], most)
        at.append(np.array([i for i, _ in pick], int)[a])
        key.append(k)
    at, key = np.concatenate(at), np.concatenate(key)
    if kind == _WHOLE_KIND:
        key = ~key
    order = np.argsort(at, kind="stable")
    return np.split(key[order], np.cumsum(np.bincount(at, minlength=len(texts)))[:-1]) if texts else []


def _like(kind: str, t: str, w: str) -> float:
    """How well t may be a slip of the vocabulary's w: 0 where it is too far off."""
    s, x = _shape(t), _shape(w)
    if kind == _WHOLE_KIND:
        d = distance(s, x, 2)
        return 0.98 - d / len(x) if d <= 2 else 0.0
    limit = min(_edits(len(t) + 1), _edits(len(w)))
    d = min(distance(s, x, limit), distance(t, w, limit))  # a slip may look like a shape
    v = 1 - d / max(len(s), len(w)) if d <= limit else 0.0
    return v if v > 0.55 else 0.0


class Entries:
    """The reference list, indexed. rows: (id, Latin name, other name, category)."""

    def __init__(self, rows: list[tuple[int, str | None, str | None, str | None]], least: float = 0.78):
        self.least = least
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.other: dict[str, set[int]] = defaultdict(set)
        self.category = {r[0]: r[3] for r in rows}
        forms: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for i, name, other, _ in rows:
            for x in (name, other):
                if x and x.strip():
                    self.exact[fold_name(x)].add(i)
                    if _HAN.search(x):
                        self.other["".join(_RUN.findall(_plain(x)))].add(i)
            if name and (words := tuple(_WORD.findall(_plain(name)))):
                forms[words].add(i)
        self.forms, self.ids = list(forms), list(forms.values())
        self.place = {f: k for k, f in enumerate(self.forms)}
        seen: dict[str, int] = defaultdict(int)
        for words in self.forms:
            for w in set(words):
                seen[w] += 1
        self.idf = {w: math.log(1 + len(self.forms) / n) for w, n in seen.items()}
        self.most = max((len(f) for f in self.forms), default=0)
        self.most_other = max((len(x) for x in self.other), default=0)
        self.whole: dict[str, list[int]] = defaultdict(list)
        #: Every form once, under its rarest word: a value that names the form holds (a slip of) that word.
        self.rarest: dict[str, list[int]] = defaultdict(list)
        #: Forms whose first word an initial may stand for: by the initial, then by the rarest of the other words.
        self.initial: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, words in enumerate(self.forms):
            self.whole["".join(words)].append(k)
            self.rarest[min(words, key=lambda w: (seen[w], w))].append(k)
            if len(words) > 1:
                rest = min(words[1:], key=lambda w: (seen[w], w))
                for n in range(1, min(4, len(words[0])) + 1):
                    self.initial[words[0][:n]][rest].append(k)

    def frames(self, words: list[str], han: str) -> list[tuple[str, int]]:
        """What stands around the entries that a value holds as they are spelt in the list: (frame, number of the entry's form)."""
        out = []
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + self.most) + 1):
                k = self.place.get(tuple(words[a:b])) if b - a < len(words) else None
                if k is not None:
                    out.append((" ".join(words[:a]) + "*" + " ".join(words[b:]), k))
        for a in range(len(han)):
            for b in range(a + 1, min(len(han), a + self.most_other) + 1):
                if b - a < len(han) and (ids := self.other.get(han[a:b])):
                    out.append((han[:a] + "*" + han[b:], min(ids)))
        return out

    def found(self, words: list[str], fixed: dict[str, dict[str, float]], whole: dict[str, dict[str, float]]) -> tuple[set[int], float]:
        """Entries of the best form all of whose words are found in words, each of which must be explained, with its soft TF-IDF score; those of all forms that score alike."""
        if not words:
            return set(), 0.0
        scores: dict[int, float] = {}
        if len(words) <= self.most:
            fixes = [{w: 1.0} if w in self.idf else fixed.get(w, {}) for w in words]
            forms = {f for c in fixes for w in c for f in self.rarest.get(w, ())}
            short = [q for q in range(len(words)) if len(words[q]) <= 4 and words[q] not in self.idf] if len(words) > 1 else []
            for q in short:
                starts = self.initial.get(words[q], {})
                forms |= {f for c in fixes for w in c for f in starts.get(w, ())}
            for f in forms:
                form, free, dot, size = self.forms[f], set(range(len(words))), 0.0, 0.0
                if len(form) != len(words):
                    continue
                for k, w in enumerate(form):
                    best, at = 0.0, -1
                    for q in free:
                        v = fixes[q].get(w, 0.0)
                        if not v and k == 0 and q in short and w.startswith(words[q]):
                            v = 0.9
                        if v > best:
                            best, at = v, q
                    if at < 0:
                        break
                    free.discard(at)
                    dot += best * self.idf[w] ** 2
                    size += self.idf[w] ** 2
                else:
                    scores[f] = dot / size
        if not scores:
            for x, v in whole.get("".join(words), {}).items():
                for f in self.whole[x]:
                    scores[f] = v
        top = max(scores.values(), default=0.0)
        if top < self.least:
            return set(), top
        return set().union(*(self.ids[f] for f, v in scores.items() if v > top - 0.01)), top


def fold_name(s: str) -> str:
    return re.sub(" {2,}", " ", s.strip(" ")).lower()


def _tokens(value: str) -> tuple[list[str], str]:
    s = _plain(value)
    return _WORD.findall(s), "".join(_RUN.findall(s))


class Frames:
    """Words that may stand before and after a name without being a part of it."""

    def __init__(self, learned: list[str]):
        split = [f.split("*", 1) for f in learned]
        self.before = [tuple(a.split()) for a, b in split if a and not _HAN.search(a)]
        self.after = [tuple(b.split()) for a, b in split if b and not _HAN.search(b)]
        self.han_before = [a for a, b in split if _HAN.search(a)]
        self.han_after = [b for a, b in split if _HAN.search(b)]
        self.most = max((len(x) for x in self.before), default=0) + max((len(x) for x in self.after), default=0)

    @staticmethod
    def _peeled(whole, before: list, after: list) -> list:
        out = [whole]
        for x in out:  # grows while it is read
            for y in [x[len(b) :] for b in before if x[: len(b)] == b] + [x[: -len(a)] for a in after if x[-len(a) :] == a]:
                if len(y) and y not in out:
                    out.append(y)
        return out

    def words(self, words: list[str]) -> list[list[str]]:
        """The words as they are, then with what stands around left out."""
        return [list(x) for x in self._peeled(tuple(words), self.before, self.after)]

    def han(self, han: str) -> list[str]:
        return self._peeled(han, self.han_before, self.han_after)


_MIXED = re.compile(r"[^a-z0-9]*[(/\[,;][^㐀-鿿]*|[^㐀-鿿]*[(/\[,;][^a-z0-9]*")


def named(entries: Entries, frames: Frames, value: str, fixed: dict[str, dict[str, float]], whole: dict[str, dict[str, float]]) -> tuple[tuple[int, ...], float]:
    """The entries that the value may name (several of them if it can't tell) and the score."""
    if hit := entries.exact.get(fold_name(value)):
        return tuple(sorted(hit)), 1.0
    words, han = _tokens(value)
    by_words: set[int] = set()
    score = 0.0
    if words and not (han and not _MIXED.fullmatch(_plain(value))):
        if len(words) <= entries.most + 2 * frames.most or len(words) == 1:
            for kept in frames.words(words):
                ids, v = entries.found(kept, fixed, whole)
                if v > score:
                    by_words, score = ids, v
                if by_words and kept == words:
                    break
    elif words:
        return (), 0.0
    if not han:
        return tuple(sorted(by_words)), score
    by_han = set().union(*(entries.other.get(x, set()) for x in frames.han(han))) if len(han) <= entries.most_other + 64 else set()
    both = by_han & by_words if by_han and by_words else by_han | by_words
    return tuple(sorted(both)), max(score, 0.95 if by_han else 0.0) if both else 0.0


_INDEX: dict[str, tuple] = {}


def _once(name: str, make):
    """What a Python worker has built before for this call; the last call's only."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = make()
    return _INDEX[name]


def canonicalise(df: DataFrame, reference: DataFrame, key: str, value: str, category: Column, ref_category: Column, frame_share: float = FRAME_SHARE) -> DataFrame:
    """key, value, term_id, score, exact, choice for every row of df; term_id is null where the value names no entry.

    reference has term_id, term, term_zh. Values are evened out (width, case, look-alike letters, accents, separators) and each distinct value is
    worked on once. Words around names ("suspected", 疑似) are learned: what stands around entries in values that hold an entry as it is spelt is no part of a
    name if it stands around two of them at least and around frame_share of all entries that have anything around them. Every distinct Latin token that is no word
    of the vocabulary is joined to the vocabulary of the reference within one or two edits by an index of letters left out; a whole value without its
    blanks likewise, for those written without any. Entries all of whose words are found are ranked by soft TF-IDF over the corrected tokens; a word that no
    word of the entry explains and that was not learned to stand around names rules the entry out. An initial may stand for a first word. Chinese names are looked
    up as they are. Candidates are the entries listed under their rarest word, so that no length of a list is ever cut. Where several entries fit
    alike (choice), the category tells, or else none is named. exact: the folded value is itself a name of an entry.

    Null and blank values name nothing; repeated rows are answered alike; an empty reference names nothing; texts of any length are read whole. Answers are
    joined back by value: a value held by very many rows meets one row, so AQE can split it.
    """
    spark = df.sparkSession
    rows = reference.select("term_id", "term", "term_zh", ref_category.alias("category")).where("term_id is not null").orderBy("term_id").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries in the reference list")
    rows = [tuple(r) for r in rows]
    here = Entries(rows)
    call = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(rows)
    entries = lambda: _once(call, lambda: Entries(shared.value))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = entries()
        for pdf in batches:
            both = [_tokens(v) for v in pdf["v"]]
            framed = [[] if fold_name(v) in known.exact else known.frames(*x) for v, x in zip(pdf["v"], both)]
            yield pd.DataFrame({"v": pdf["v"], "words": [x[0] for x in both], "frames": [[{"frame": f, "entry": k} for f, k in x] for x in framed]})

    values = df.select(F.col(value).alias("v")).where("v is not null").distinct()
    values = widely(values)  # few bytes, much work
    values = cut_table(values.mapInPandas(read, "v string, words array<string>, frames array<struct<frame: string, entry: int>>").select(F.monotonically_increasing_id().alias("id"), "*"))
    around = values.select(F.inline("frames")).distinct()
    n_framed = around.select("entry").distinct().count()
    learned = around.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, frame_share * n_framed)).orderBy("frame").limit(MOST_FRAMES + 1).collect()
    if len(learned) > MOST_FRAMES:
        raise ValueError(f"more than {MOST_FRAMES} kinds of words around names")
    frames = Frames([r["frame"] for r in learned])
    longest = {_WORD_KIND: max((max(len(w), len(_shape(w))) for w in here.idf), default=0), _WHOLE_KIND: max((len(_shape(x)) for x in here.whole), default=0)}

    # Distinct tokens joined to the vocabulary.
    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = entries()
        for pdf in batches:
            out = []
            for i, v, words in zip(pdf["id"], pdf["v"], pdf["words"]):
                if fold_name(v) in known.exact or (len(words) > known.most + 2 * frames.most and len(words) > 1):
                    continue
                ask = {(_WORD_KIND, w) for w in words if w not in known.idf and len(w) <= 2 * (longest[_WORD_KIND] + 2)}
                ask |= {(_WHOLE_KIND, x) for kept in frames.words(list(words)) if 8 <= len(x := "".join(kept)) <= 2 * (longest[_WHOLE_KIND] + 2)}
                out += [(i, k, t) for k, t in ask]
            yield pd.DataFrame(out, columns=["id", "kind", "token"])

    def keyed(known: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for kind, part in pdf.groupby("kind"):
                    texts = part["token"].tolist()
                    for a in range(0, len(texts), 5000):
                        yield pd.DataFrame({"kind": kind, "token": texts[a : a + 5000], "keys": pd.Series(_keys(kind, texts[a : a + 5000], known, longest[kind]), dtype=object)})

        return run

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["like"] = [_like(k, t, w) for k, t, w in zip(pdf["kind"], pdf["token"], pdf["word"])]
            yield pdf[pdf["like"] > 0]

    asks = cut_table(values.where(F.size("words") > 0).select("id", "v", "words").mapInPandas(asked, "id long, kind string, token string"))
    vocabulary = spark.createDataFrame([(_WORD_KIND, w) for w in here.idf] + [(_WHOLE_KIND, x) for x in here.whole], "kind string, token string")
    n_keys = sum(2 * (1 + len(w) + len(w) ** 2 // 2) for w in here.idf) + sum(1 + len(x) for x in here.whole)
    index = vocabulary.mapInPandas(keyed(True), "kind string, token string, keys array<long>").select("kind", F.explode("keys").alias("key"), F.col("token").alias("word"))
    probes = widely(asks.select("kind", "token").distinct()).mapInPandas(keyed(False), "kind string, token string, keys array<long>").select("kind", "token", F.explode("keys").alias("key"))
    pairs = probes.join(F.broadcast(index) if n_keys <= MOST_KEYS else index, ["kind", "key"]).select("kind", "token", "word").distinct()
    fixes = widely(pairs).mapInPandas(check, "kind string, token string, word string, like double")
    fixes = fixes.groupBy("kind", "token").agg(F.collect_list(F.struct("word", "like")).alias("fixes"))

    # Tokens combined to entries.
    held = asks.join(fixes, ["kind", "token"]).groupBy("id").agg(F.collect_list(F.struct("kind", "token", "fixes")).alias("held"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = entries()
        for pdf in batches:
            out = []
            for v, h in zip(pdf["v"], pdf["held"]):
                fixed: dict[str, dict[str, dict[str, float]]] = {_WORD_KIND: {}, _WHOLE_KIND: {}}
                for x in h if h is not None else ():
                    fixed[x["kind"]][x["token"]] = {y["word"]: y["like"] for y in x["fixes"]}
                ids, score = named(known, frames, v, fixed[_WORD_KIND], fixed[_WHOLE_KIND])
                if ids:
                    several = [{"i": i, "c": known.category[i]} for i in ids] if len(ids) > 1 else None
                    out.append((v, ids[0] if len(ids) == 1 else None, several, score, fold_name(v) in known.exact))
            yield pd.DataFrame(out, columns=["v", "one", "several", "score", "exact"]).astype({"one": "Int64"})

    answers = widely(values.select("id", "v").join(held, "id", "left")).mapInPandas(match, "v string, one long, several array<struct<i: long, c: string>>, score double, exact boolean")
    own = df.select(F.col(key).alias("k"), F.col(value).alias("v"), category.alias("cat"))
    fit = F.filter("several", lambda x: x.c == F.col("cat"))
    out = own.join(answers, "v", "left").select("*", F.when(F.size(fit) == 1, fit[0].i).alias("told"))
    return out.select(
        F.col("k").alias(key), F.col("v").alias(value), F.coalesce("one", "told").cast(dict(reference.dtypes)["term_id"]).alias("term_id"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("exact", F.lit(False)).alias("exact"), F.col("several").isNotNull().alias("choice"),
    )
