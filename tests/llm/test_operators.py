"""Edge cases and brute force of the training-data operators."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boscograph.llm import canonical, components, consensus, cooccurrence, mixing, neighbours, packing, scans, splitting, survivor
from boscograph.functions.text import is_stated, strip

EXTRA = {"k": "clash", "v": 1, "t": "clash", "n": 2, "container": 3, "a": "x", "b": "y", "p": 0.5}


def with_extra(df):
    """Columns named like the operators' own inner ones, where df has none of that name."""
    for c, v in EXTRA.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v))
    return df


# 3
M = "g long, keep string, c double, at timestamp, i long"


def best(df):
    keep = F.col("keep")
    return {r.g: r.keep for r in survivor.survive_by_field(with_extra(df), "g", {"keep": (strip(keep), is_stated(keep))}, "c", "at", "i").collect()}


def test_survivor(spark):
    from datetime import datetime

    d1, d2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [(1, " a ", 0.9, d1, 1), (1, "b", 0.9, d2, 2), (1, "?", 1.0, d2, 3), (2, "x", float("nan"), d2, 1), (2, "y", 0.1, None, 2), (3, None, 0.5, d1, 1), (3, " ", None, None, None), (None, "z", 1.0, d1, 1), (4, "p", None, None, 5), (4, "q", None, None, 5), (4, "q", None, None, 5)]
    df = spark.createDataFrame(rows, M)
    assert best(df) == {1: "b", 2: "y", 3: None, 4: "q"}
    assert best(df.limit(0)) == {}
    whole = survivor.survive_whole(with_extra(df), "g", ["keep"], "c", "at", "i").collect()
    assert {r.g: (r.keep, r.n_stated) for r in whole} == {1: ("b", 1), 2: ("y", 1), 3: (None, 0), 4: ("q", 1)}


def test_survivor_of_a_hot_group(spark):
    df = spark.range(20000).select(F.lit(7).cast("long").alias("g"), F.concat(F.lit("n"), F.col("id")).alias("keep"), (F.col("id") % 100).cast("double").alias("c"), F.lit(None).cast("timestamp").alias("at"), F.col("id").alias("i"))
    assert best(df) == {7: "n19999"}
    plan = survivor.survive_by_field(df, "g", {"keep": (F.col("keep"), F.lit(True))}, "c", "at", "i")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# 4
def components_of(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"e{rng.randrange(300)}", f"e{rng.randrange(300)}") for _ in range(180)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(60)] + [("hub", f"h{i}") for i in range(200)]
    pairs = [p for p in pairs if p[0] != p[1]]
    df = spark.createDataFrame(pairs + pairs[:9] + [(None, "e1"), ("e1", None), ("lone", "lone")], "x string, y string")
    assert {r.node: r.root for r in components.connected(with_extra(df), "x", "y").collect()} == components_of(pairs)
    assert components.connected(df.limit(0), "x", "y").collect() == []


def test_connected_rows(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["c", None, "d"],), (["x"],), (["y", "y"],), (None,), ([],)], "names array<string>")
    assert {r.node: r.root for r in components.connect_rows(df, F.col("names")).collect()} == dict.fromkeys("abcd", "a")


# 8
def test_best_fit_matches_a_plain_one():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    rooms, plain = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = min(fits)[1]
            rooms[i] -= s
        else:
            i = len(rooms)
            rooms.append(100 - s)
        plain.append((s, rooms[i]))
    got, left = packing.best_fit(sizes, 100), Counter()
    for s, b in zip(sizes, got):
        left[b] += s
    assert max(left.values()) <= 100 and len(left) == len(rooms)


def test_pack(spark):
    texts = [("d1", "x" * 25), ("d2", "y" * 6), ("d3", "中中"), ("d4", None), ("d5", ""), (None, "z" * 4), ("d2", "y" * 6), ("d6", "w" * 10)]
    df = with_extra(spark.createDataFrame(texts, "doc string, text string"))
    rows = packing.pack(df, "doc", "text", 10).collect()
    assert sum(r.n_tokens for r in rows) == 25 + 6 + 6 + 4 + 6 + 10
    room = Counter()
    for r in rows:
        room[r.container] += r.n_tokens
    assert max(room.values()) <= 10
    assert sorted((r.start, r.n_tokens) for r in rows if r.doc == "d1") == [(0, 10), (10, 10), (20, 5)]
    assert all(r.n_pieces == (3 if r.doc == "d1" else 1) for r in rows) and {r.doc for r in rows} == {"d1", "d2", "d3", None, "d6"}
    f = packing.fill(packing.pack(df, "doc", "text", 10), 10).first()
    assert f.containers == len(room) and f.tokens == 57
    assert packing.pack(df.limit(0), "doc", "text", 10).collect() == []
    assert packing.fill(packing.pack(df.limit(0), "doc", "text", 10), 10).first().containers == 0


# 9
def test_cut_points():
    for mean, most in ((0.3, 1), (1.4, 2), (0.01, 3), (2.9, 3)):
        assert most - sum(mixing._cut_points(mean, most)) == pytest.approx(mean, abs=1e-9)
    assert mixing._cut_points(5, 2) == [0.0, 0.0] and mixing._cut_points(0, 2) == [1.0, 1.0] and mixing._cut_points(1, 0) == []


def test_mix(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc"), F.when(F.col("id") % 3 == 0, " BIG ").when(F.col("id") % 30 == 1, "small").otherwise("other").alias("source"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, None), (-1, "big", None), (-2, "big", ""), (-2, "big", "")], "doc long, source string, text string"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("gone", 0.1, 4), (None, 0.1, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(with_extra(docs), targets, "doc", "source", "text")
    rep = {r.source: r for r in mix.report().collect()}
    assert {r.source for r in mix.fell_short().collect()} == {s for s, r in rep.items() if r.short}
    assert set(rep) == {"big", "small", "gone", "zero"} and rep["gone"].short and rep["small"].short and not rep["big"].short and not rep["zero"].short
    assert rep["small"].sampled_tokens == 2 * rep["small"].tokens and rep["small"].most_copies == 2
    assert rep["big"].sampled_tokens == pytest.approx(0.5 * mix.total, rel=0.06) and rep["big"].most_copies == 1
    rows = mix.sample().collect()
    assert [r.place for r in rows] == sorted(r.place for r in rows)
    assert max(Counter((r.doc, r.copy_no) for r in rows if r.doc != -2).values()) == 1
    assert {(r.doc, r.copy_no) for r in rows} == {(r.doc, r.copy_no) for r in mixing.Mix(docs, targets, "doc", "source", "text").sample().collect()}
    empty = mixing.Mix(docs.limit(0), targets, "doc", "source", "text")
    assert empty.sample().collect() == [] and [r.source for r in empty.report().where("short").collect()] == []
    assert mixing.Mix(docs, targets.limit(0), "doc", "source", "text").report().collect() == []


# 10
@pytest.mark.parametrize("text", ["a" * 1000, "中" * 400, "One. Two three, four. " * 40, "p\n\nq r s t u v w x y z" * 30, "é" * 7 + "word " * 200, "\n" * 500, "😀" * 200, " " * 333])
def test_pieces_give_back_the_text(text):
    data = text.encode()
    got = splitting.cuts(data, 100, 12)
    assert got[0][0] == 0 and got[-1][1] == len(data) and got[-1][2] == "end"
    back = bytearray()
    for a, b, _ in got:
        data[a:b].decode()
        assert 0 < b - a <= 100
        back[a:] = data[a:b]
    assert bytes(back) == data
    for (_, end, _), (start, stop, _) in zip(got, got[1:]):
        assert 12 <= end - start <= 15 and stop > end


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    text = "".join(rng.choice(["ab ", "cde. ", "f, ", "gh\n", "ij\n\n"]) for _ in range(60)).encode()
    limit, overlap = 50, 6
    at, kind = splitting._positions(text, limit - overlap - 3, 4)
    n = len(text)
    fewest = -(-(n - overlap) // (limit - overlap))
    ideal = (n + (fewest - 1) * overlap) / fewest
    cost = {0: 0.0}
    for p, k in zip(at.tolist(), kind.tolist()):
        starts = [(c + ((p - (max(0, q - overlap) if q else 0) - ideal) / limit) ** 2) for q, c in cost.items() if 0 < p - (max(0, q - overlap) if q else 0) <= limit and q < p]
        if starts:
            cost[p] = min(starts) + 1 + splitting.KINDS[k][1]
    got = splitting.cuts(text, limit, overlap)
    mine = sum(1 + (0 if b == n else dict((x[0], x[1]) for x in splitting.KINDS)[w]) + ((b - a - ideal) / limit) ** 2 for a, b, w in got)
    assert mine == pytest.approx(cost[n])


def test_a_clause_may_save_a_piece():
    text = (b"a" * 2000 + b". ") + b"".join(b"b" * 250 + b", " for _ in range(10)) + b"c. " + b"".join(b"d" * 300 + b", " for _ in range(3))
    assert [w for _, _, w in splitting.cuts(text, 3000, 300)] == ["clause", "end"]


def test_split(spark):
    df = spark.createDataFrame([("d", "x. " * 100), ("d", "x. " * 100), (None, "y" * 101), ("s", "z" * 100), ("n", None), ("e", "")], "doc string, text string")
    rows = splitting.split(with_extra(df), "doc", "text", 100, 10).collect()
    assert Counter(r.doc for r in rows if r.piece_no == 1) == {"d": 2, None: 1}
    assert splitting.split(df.limit(0), "doc", "text", 100, 10).collect() == []
    with pytest.raises(ValueError):
        splitting.split(df, "doc", "text", 100, 95)


# 2
def crowd(seed, items=150, users=9, labels="pqrs"):
    rng = random.Random(seed)
    skill = [0.95, 0.9, 0.85, 0.8, 0.6, 0.3, 0.25, 0.25, 0.25][:users]
    truth = {i: rng.choice(labels) for i in range(items)}
    rows = [("t", i, f"u{u}", truth[i] if rng.random() < skill[u] else rng.choice(labels)) for i in truth for u in range(users) if rng.random() < 0.8]
    return truth, rows


def test_consensus_beats_the_vote(spark):
    truth, rows = crowd(1)
    got = consensus.consensus(spark.createDataFrame(rows, "task string, item long, user string, label string"))
    label = {r.item: r.label for r in got.labels.collect()}
    by = {}
    for _, i, _, x in rows:
        by.setdefault(i, Counter())[x] += 1
    vote = {i: min(c, key=lambda x: (-c[x], x)) for i, c in by.items()}
    right = sum(label[i] == truth[i] for i in label)
    assert set(label) == set(by) and right >= sum(vote[i] == truth[i] for i in vote) and right / len(label) > 0.95
    users = {r.user: r for r in got.users.collect()}
    assert users["u0"].reliability > 0.85 > 0.5 > users["u7"].reliability and all(r.low <= r.reliability <= r.high for r in users.values())


def test_consensus_says_whether_it_settled(spark):
    _, rows = crowd(3, items=40)
    df = spark.createDataFrame(rows, "task string, item long, user string, label string")
    with pytest.warns(UserWarning, match="not settled in 2 rounds"):
        early = consensus.consensus(df, max_rounds=2)
    assert (early.rounds, early.settled) == (2, False)
    for most in (0, consensus.MOST_BROADCAST):
        with pytest.raises(RuntimeError, match="not settled"):
            consensus.consensus(df, max_rounds=2, strict=True, most_broadcast=most)
    by_array, by_join = consensus.consensus(df), consensus.consensus(df, most_broadcast=0)
    assert by_array.settled and by_join.settled and by_array.rounds == by_join.rounds
    a, b = ({r.item: (r.label, r.n_answers, round(r.probability, 9)) for r in x.labels.collect()} for x in (by_array, by_join))
    assert a == b
    a, b = ({r.user: (r.n_answers, round(r.reliability, 9), round(r.low, 9)) for r in x.users.collect()} for x in (by_array, by_join))
    assert a == b


def test_latest_and_edge_cases(spark):
    rows = [("t", 1, "u", "a", 1, 1), ("t", 1, "u", "b", 2, 1), ("t", 1, "u", "b", 2, 1), ("t", 1, "v", "c", 2, 1), ("t", 1, "v", "d", 2, 2), ("t", 1, None, "x", 9, 9), ("t", 1, "w", None, 9, 9), ("t", None, "w", "x", 9, 9), ("t", 2, "w", "a", None, None)]
    df = spark.createDataFrame(rows, "task string, item long, user string, label string, w int, tie int")
    a = consensus.latest(df, *(F.col(c) for c in df.columns))
    assert sorted((r.item, r.user, r.label) for r in a.collect()) == [(1, "u", "b"), (1, "v", "d"), (2, "w", "a")]
    assert {r.item for r in consensus.consensus(a).labels.collect()} == {1, 2}
    none = consensus.consensus(a.limit(0))
    assert none.labels.collect() == [] and none.users.collect() == [] and consensus.krippendorff(a.limit(0)).collect() == []
    tie = spark.createDataFrame([("t", 1, "u", "b"), ("t", 1, "v", "a")], "task string, item long, user string, label string")
    assert consensus.consensus(tie).labels.first().label == "a"


def test_digamma(spark):
    import math

    xs = [0.01, 0.2, 1.0, 2.5, 30.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(consensus.digamma(F.col("x"))).collect()]
    for x, v in zip(xs, got):
        h = 1e-5
        assert v == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), abs=1e-4) and v == pytest.approx(consensus._digamma(x), abs=1e-7)


# 5
def pairs_of(rows, least, lift):
    inc = {(r, i) for r, i in rows if r is not None and i is not None}
    recs = {r for r, _ in inc}
    has = Counter(i for _, i in inc)
    by = {}
    for r, i in inc:
        by.setdefault(r, set()).add(i)
    n = Counter((a, b) for s in by.values() for a in s for b in s if a < b)
    return {(a, b): c for (a, b), c in n.items() if c >= least and c * len(recs) >= lift * has[a] * has[b]}


@pytest.mark.parametrize("large, share", [(1000, 1 / 4096), (6, 1 / 40), (3, 1 / 4096), (6, 1.0)])
def test_cooccurrence(spark, monkeypatch, large, share):
    monkeypatch.setattr(cooccurrence, "LARGE", large)
    monkeypatch.setattr(cooccurrence, "HEAVY_SHARE", share)
    rng = random.Random(7)
    rows = [(f"r{rng.randrange(160)}", f"i{min(rng.randrange(40), rng.randrange(60))}") for _ in range(900)]
    rows += [(f"big{b}", f"i{i}") for b in range(10) for i in range(30) if rng.random() < 0.7] + [(f"r{j}", x) for j in range(0, 60, 5) for x in ("p", "q")]
    rows += [(None, "p"), ("r1", None)] + rows[:50]
    df = with_extra(spark.createDataFrame(rows, "rec string, item string"))
    got = {(r.item_a, r.item_b): r.n_together for r in cooccurrence.together(df, "rec", "item", 4, 2).collect()}
    assert got == pairs_of(rows, 4, 2) and ("p", "q") in got
    assert cooccurrence.together(df.limit(0), "rec", "item").collect() == []


# 7
def exact(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        out[ids[a]] = [ids[b] for b in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[200:240] = x[0] * rng.uniform(0.5, 2, size=(40, 1))  # copies up to their length
    x[240:290] = x[100:150] + 0.1 * rng.normal(size=(50, 16))
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [1.0] * 15), (903, [float("nan")] + [1.0] * 15), (None, [1.0] * 16), (904, [None] + [1.0] * 15)]
    df = with_extra(spark.createDataFrame(rows + bad, "id long, vec array<double>"))
    got = {}
    for r in neighbours.similar(df, "id", "vec", dim=16, k=5).orderBy("id", F.desc("cosine"), "other").collect():
        got.setdefault(r.id, []).append(r.other)
    true = exact(x, list(range(300)), 5)
    assert set(got) == set(true) and all(len(v) == 5 for v in got.values())
    assert all(got[i] == true[i] for i in [0, *range(200, 240)])
    hits = sum(len(set(got[i]) & set(true[i])) for i in true)
    assert hits / (5 * len(true)) >= 0.9
    assert neighbours.similar(df.limit(0), "id", "vec", dim=16).collect() == []
    one = neighbours.similar(df.where("id = 3"), "id", "vec", dim=16).collect()
    assert one == []


def test_full_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_IN_BUCKET", 20)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 16)) + 0.001 * rng.normal(size=(150, 16))  # all in one bucket, and not to be told apart by more hashing
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in neighbours.similar(df, "id", "vec", dim=16, k=3).collect():
        got.setdefault(r.id, set()).add(r.other)
    true = exact(x, list(range(150)), 3)
    assert sum(len(got[i] & set(true[i])) for i in true) / 450 > 0.9


# 6
TERMS = [(1, "Paroum avivamula", "棕垭丝孢菌", "pathogen"), (2, "ashen root rust", "霜湾锈皮病", "disease"), (3, "ashen root rust", "霜湾脂液外渗", "symptom"), (4, "kionoxmasthiaron", "黛渡唑嗪", "compound"), (5, "Paroum fimkapoosus", None, "host"), (6, None, "银渡山区", "location")]
CASES = {
    "Paroum  avivamula": (1, True), "PAROUM-AVIVAMULA": (1, False), "avivamula, paroum": (1, False), "p. avivamula": (1, False), "par. avivamula": (1, False), "parоum аvivаmula": (1, False), "Ｐａｒｏｕｍ　ａｖｉｖａｍｕｌａ": (1, False),
    "pároüm avivamula": (1, False), "paroumavivamula": (1, False), "paroum avvimula": (1, False), "the paroum avivamula": (1, False), "paroum avivamula isolate x7k2": (None, False), "paroum zzzzzz": (None, False), "avivamula": (None, False),
    "棕 垭 丝 孢 菌": (1, False), "疑似棕垭丝孢菌": (1, False), "棕垭丝孢菌等": (1, False), "棕垭丝孢菌(paroum avivamula)": (1, False), "棕垭锈孢菌": (None, False), "银渡山区6qj9sm号样地": (None, False), "银渡山区": (6, True),
    "kionoxrnasthiaron": (4, False), "ki0n0xmasthiar0n": (4, False), "": (None, False), "  ": (None, False), "unknown": (None, False), "x" * 100_000: (None, False), "ashen " * 5000: (None, False),
}


TERM = "term_id int, term string, term_zh string, category string"
AROUND = ["the kionoxmasthiaron", "疑似银渡山区", "银渡山区等", "疑似黛渡唑嗪", "黛渡唑嗪等", "the paroum fimkapoosus"]  # what "the", 疑似 and 等 are learned from


def mapped(spark, values, terms):
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(values)], "id long, name string, cat string")
    rows = canonical.canonicalise(df, spark.createDataFrame(terms, TERM), "id", "name", F.col("cat"), F.col("category")).collect()
    assert len(rows) == len(values)
    return {r.id: r for r in rows}


def test_matched_values(spark):
    got = mapped(spark, [(v, None) for v in [*CASES, *AROUND]], TERMS)
    for i, (value, (term, exact_)) in enumerate(CASES.items()):
        assert (got[i].term_id, got[i].exact) == (term, exact_), value[:60]
    got = mapped(spark, [("ashen root rust", "symptom"), ("ashen root rust", None), ("ashen root rust", "misc"), ("ashen rot rust", "disease"), (None, None)], TERMS)
    assert [got[i].term_id for i in range(5)] == [3, None, None, 2, None] and got[2].choice and not got[4].choice


def test_a_long_list_loses_no_entry(spark):
    """Candidates don't depend on how many entries share a word; an unexplained word rules an entry out."""
    terms = [(1, "red pine", None, "host"), (2, "prime", None, "host"), *((i, f"w{i:06d}q pine", None, "host") for i in range(10, 200_000 - 10))]
    got = mapped(spark, [("red pime", None), ("red pine x", None), ("redpine", None), ("w004321q pnie", None), ("pine", None)], terms)
    assert [got[i].term_id for i in range(5)] == [1, None, None, 4321, None]


def test_canonicalise(spark):
    df = spark.createDataFrame([(1, "p. avivamula", "x"), (1, "p. avivamula", "x"), (None, "ASHEN ROOT RUST", "disease"), (3, None, None), (4, "nothing like it", None)], "id long, name string, cat string")
    ref = spark.createDataFrame(TERMS, "term_id int, term string, term_zh string, category string")
    rows = canonical.canonicalise(with_extra(df), ref, "id", "name", F.col("cat"), F.col("category")).collect()
    assert sorted((r.id or 0, r.term_id or 0, r.exact) for r in rows) == [(0, 2, True), (1, 1, False), (1, 1, False), (3, 0, False), (4, 0, False)]
    assert canonical.canonicalise(df.limit(0), ref, "id", "name", F.col("cat"), F.col("category")).collect() == []
    assert all(r.term_id is None for r in canonical.canonicalise(df, ref.limit(0), "id", "name", F.col("cat"), F.col("category")).collect())


def test_distance():
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(9)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert canonical.distance(a, b, 3) == min(4, plain(a, b))


# 1
SENTENCES = ["According to the field books, the crews noted early resin loss on the lower stem.", "Residues were still measurable in the sapwood after many weeks of storage.", "The wind-borne spores settle mostly on mid-slope stands facing the valley.", "Trees carrying canker showed weeping branches within the second season."]
ZH = "两次调查之间的间隔过长，可能遗漏短期暴发的萎斑病。树干内侧白色菌丝的数量随海拔升高而减少。"


def scan():
    """A corpus, and a damaged paper with the damage that was put in."""
    clean = [(i, "# Title of it\n\n" + " ".join(random.Random(i).choices(SENTENCES, k=30)), "en") for i in range(40)] + [(100 + i, ZH * 5, "zh") for i in range(20)]
    page = ["Spread of dusky root blight", "", "According to the field books, the crews noted eorly resin loss on", "the lower stern. The wind-", "borne spores settle mostly on mid-slope stands facing the val-", "12", "Blight Watch", "ley. Residues were still measurable in the sapwood after many", "weeks of storage. Trees carrying canker showed weeping bran¬", "ches within the second season. Residues were still measurable in",
            "the sapwood after many weeks of storage.", "Table 1", "14", "52", "13", "Blight Watch", "The wind-borne spores settle mostly on mid-slope stands facing", "the valley.", "14", "Blight Watch"]
    found = {(3, "misread"), (4, "misread"), (5, "break"), (6, "page_no"), (7, "header"), (9, "break"), (15, "page_no"), (16, "header"), (19, "page_no"), (20, "header")}
    return clean, "\n".join(page), found


def test_scans(spark):
    clean, page, found = scan()
    zh = "　　两次调查之问的间隔过长，可能遗漏短期暴发的萎斑\n病。树干内侧自色菌丝的数量随海拔升高而减少。"
    rows = [(i, t) for i, t, _ in clean] + [(900, page), (901, page), (902, zh), (903, None), (904, ""), (None, "x\n" * 5), (905, "a" * 200_000), (906, "ab-\n" * 3000)]
    df = with_extra(spark.createDataFrame(rows, "id long, text string"))
    got = {r.id: r for r in scans.repair(df, "id", "text").collect()}
    assert {(d.line_no, d.kind) for d in got[900].damage} == found == {(d.line_no, d.kind) for d in got[901].damage}
    assert {(d.line_no, d.kind) for d in got[902].damage} == {(1, "misread"), (2, "misread")}
    assert "stands facing the valley. Residues were" in got[900].repaired and "noted early resin loss on the lower stem. The wind-borne spores" in got[900].repaired and "weeping branches within" in got[900].repaired and "Blight" not in got[900].repaired
    assert got[902].repaired == "两次调查之间的间隔过长，可能遗漏短期暴发的萎斑病。树干内侧白色菌丝的数量随海拔升高而减少。"
    assert got[903].repaired is None and got[903].damage == [] and got[904].repaired == "" and not any(got[i].damage for i, _, _ in clean)
    assert scans.repair(df.limit(0), "id", "text").collect() == []
    few = df.where("id = 0").repartition(5)  # tasks without rows
    assert scans.repair(few, "id", "text").count() == 1


def test_misreads():
    ways = [scans.misread(*x) for x in (("modern", "rnodern"), ("the", "tbe"), ("the", "xhe"), ("w", "vv"), ("", ""))]
    assert [w if w is None else len(w) for w in ways] == [1, 1, None, 1, 0] and ways[0] == (("m", "rn"),)


def test_confusions_are_estimated():
    words = [("1", w, "", 5000) for w in ("hollow", "modern", "seedling", "canker", "needle")]
    seen = [("1", "ho1low", "", 40), ("1", "hol1ow", "", 35), ("1", "seed1ing", "", 45), ("1", "rnodern", "", 2)]
    m = scans.Model(words + seen, 2)
    assert m.cost["l", "1"] > scans.MISREAD > m.cost["n", "ri"] and m.cost["l", "1"] > m.cost["m", "rn"]
    again = scans.Model.of(m.parts())
    assert again.options("ho1low") == m.options("ho1low") and again.decode(["the", "seed1ing"]) == ["the", "seedling"]
    assert scans.Model([], 2).decode(["word"]) == ["word"]


def test_neighbouring_characters_are_judged_together():
    text = "记录树干内侧白色菌丝"
    rows = Counter(c for _ in range(50) for c in scans._contexts(text))
    m = scans.Model([("z", c, "", n) for c, n in rows.items()], 2)
    wrong = "记录村千内侧白色菌丝"  # two misread characters side by side
    assert [m.judged(("  " + wrong + "  ")[i : i + 5]) for i, ch in enumerate(wrong) if ch in "村千"] == ["树", "干"]
    assert all(m.judged(c) == c[2] for c in rows)
