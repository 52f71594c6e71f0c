"""Consensus from several annotators' labels."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boscograph.session import cut, cut_table, widely

#: The table of annotators (a number for each annotator, label given and true class) goes to every task up to this many numbers (64 MB); beyond, it is joined by shuffle.
MOST_BROADCAST = 8_000_000
#: More labels of one task than this are an error: the labels are then free text, not a choice.
MOST_LABELS = 200


def _digammas(y: np.ndarray) -> np.ndarray:
    """Of positive numbers, to about 1e-9: six steps of the recurrence, then the asymptotic series."""
    out = np.zeros_like(y)
    for _ in range(6):
        out, y = out - 1 / y, y + 1
    z = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


@F.pandas_udf(T.DoubleType())
def digamma(x: pd.Series) -> pd.Series:
    """Only the small table of annotators goes through it; as a column expression it would hold its argument sixteen times over, and the plans of all rounds
    stay in the driver's memory."""
    return pd.Series(_digammas(x.to_numpy(dtype=float)))


@dataclass
class Consensus:
    """labels: task, item, label, probability, n_answers. users: task, user, n_answers, reliability, low, high. settled: whether the last round moved no
    expected count beyond the tolerance; rounds: how many there were."""

    labels: DataFrame
    users: DataFrame
    rounds: int
    settled: bool


def latest(df: DataFrame, task: Column, item: Column, user: Column, label: Column, when: Column, tie: Column) -> DataFrame:
    """One answer per task, item and user: the last by `when`, then by tie. Rows without item, user or answer are left out first.

    A group-by with map-side combine, so repeated answers to one item are no hot group; afterwards an item has at most one row per user.
    """
    own = df.select(task.alias("task"), item.alias("item"), user.alias("user"), label.alias("label"), F.struct(when.alias("w"), tie.alias("t"), label.alias("l")).alias("o"))
    own = own.where("task is not null and item is not null and user is not null and label is not null")
    return own.groupBy("task", "item", "user").agg(F.max_by("label", "o").alias("label"))


def consensus(answers: DataFrame, max_rounds: int = 200, tolerance: float = 1e-4, strength: float = 10.0, start: float = 0.7, strict: bool = False, most_broadcast: int = MOST_BROADCAST) -> Consensus:
    """Mean-field variational inference of a confusion model over answers (task, item, user, label) as latest() gives them.

    Classes of a task have a Dirichlet prior of 1 each; the row of an annotator for a true class has one of total weight
    `strength`, centred on the share of right answers the annotator shows over all items (beginning with `start`, refitted each
    round), the rest spread evenly over the wrong labels. A round scores the items by the expected log confusions of who answered
    what, then sums the class probabilities by annotator and label (a group-by with partial sums in the task) and takes digammas of the sums. Rounds end
    when no expected count of an annotator moves by more than `tolerance` of the annotator's answers (and one); should max_rounds not
    suffice, that is an error if strict, and else a warning and `settled` false.

    Answers are laid together by item once. While the table of annotators is within most_broadcast numbers it goes to every task as an array, so that a round shuffles
    partial sums only; beyond, it is joined by shuffle and the sums of each round are checkpointed.

    Ties of an item go to the smallest label. Null columns give no answer, repeated rows of one user and item must be merged before (latest()),
    an empty table gives empty results.
    """
    spark = answers.sparkSession
    known = [(r["task"], r["label"]) for r in answers.select("task", "label").distinct().orderBy("task", "label").limit(100 * MOST_LABELS).collect()]
    names: dict[str, list[str]] = {}
    for t, x in known:
        names.setdefault(t, []).append(x)
    width = max([len(v) for v in names.values()], default=1)
    if width > MOST_LABELS:
        raise ValueError(f"{width} labels in one task")
    ks = range(width)
    codes = F.broadcast(spark.createDataFrame([(t, x, i, len(v)) for t, v in names.items() for i, x in enumerate(v)], "task string, label string, code int, classes int"))
    rows = answers.join(codes, ["task", "label"]).select("task", "item", "user", "code", "classes")
    people = rows.select("task", "user").distinct()
    n_people = people.count()
    if n_people * width * width <= most_broadcast:
        return _by_arrays(rows, people, names, max_rounds, tolerance, strength, start, strict)
    rows = cut(rows.repartition("task", "item").sortWithinPartitions("task", "item"))

    pairs = rows.select("task", "user", "code", "classes").distinct()
    table = cut(pairs.select("*", *(F.lit(0.0).alias(f"n{k}") for k in ks)))
    classes = {t: [0.0] * len(v) for t, v in names.items()}
    item = W.partitionBy("task", "item")
    user = W.partitionBy("task", "user")

    def logs(n: DataFrame) -> DataFrame:
        """e0.. : expected log probability that the user gives the label where class k is true."""
        right = F.sum(sum((F.when(F.col("code") == k, F.col(f"n{k}")).otherwise(0.0) for k in ks), F.lit(0.0))).over(user)
        every = F.sum(sum((F.col(f"n{k}") for k in ks), F.lit(0.0))).over(user)
        n = n.withColumn("a", (right + 2 * start) / (every + 2))
        wrong = (1 - F.col("a")) / F.greatest(F.col("classes") - 1, F.lit(1))
        total = {k: F.sum(f"n{k}").over(user) for k in ks}
        n = n.select("*", *(total[k].alias(f"t{k}") for k in ks))
        e = (digamma(strength * F.when(F.col("code") == k, F.col("a")).otherwise(wrong) + F.col(f"n{k}") + 1e-3) - digamma(F.lit(strength + 1e-3) + F.col(f"t{k}")) for k in ks)
        return n.select("task", "user", "code", *(x.alias(f"e{k}") for k, x in enumerate(e)))

    def scored(n: DataFrame) -> DataFrame:
        """The rows with q0.., the probability of each class of their item, and m, its answers."""
        e = logs(n)
        joined = rows.join(e, ["task", "user", "code"])
        prior = {}
        for t, sums in classes.items():
            whole = sum(sums) + len(sums)
            prior[t] = [_digamma(1 + s) - _digamma(whole) for s in sums]
        table_of = F.broadcast(spark.createDataFrame([(t, *(p + [0.0] * (width - len(p)))) for t, p in prior.items()], "task string, " + ", ".join(f"p{k} double" for k in ks)))
        joined = joined.join(table_of, "task").select("*", F.count("*").over(item).alias("m"), *(F.when(F.col("classes") > k, F.sum(f"e{k}").over(item) + F.col(f"p{k}")).otherwise(-1e9).alias(f"s{k}") for k in ks))
        top = F.greatest(*(F.col(f"s{k}") for k in ks)) if width > 1 else F.col("s0")
        joined = joined.select("task", "item", "user", "code", "classes", "m", *(F.exp(F.col(f"s{k}") - top).alias(f"x{k}") for k in ks))
        whole = sum((F.col(f"x{k}") for k in ks), F.lit(0.0))
        return joined.select("task", "item", "user", "code", "classes", "m", *((F.col(f"x{k}") / whole).alias(f"q{k}") for k in ks))

    rounds, settled = 0, False
    while rounds < max_rounds and not settled:
        rounds += 1
        sums = scored(table).groupBy("task", "user", "code", "classes").agg(*(F.sum(f"q{k}").alias(f"n{k}") for k in ks), *(F.sum(F.col(f"q{k}") / F.col("m")).alias(f"c{k}") for k in ks), F.count("*").alias("answers"))
        sums = cut(sums)
        old = table.select("task", "user", "code", *(F.col(f"n{k}").alias(f"o{k}") for k in ks))
        moved = [F.abs(F.col(f"n{k}") - F.col(f"o{k}")) for k in ks]
        whole = F.sum("answers").over(user) + 1.0
        state = sums.join(old, ["task", "user", "code"]).withColumn("whole", whole).groupBy("task").agg(F.max(F.greatest(*moved, F.lit(0.0)) / F.col("whole")).alias("moved"), *(F.sum(f"c{k}").alias(f"c{k}") for k in ks)).collect()
        classes = {r["task"]: [r[f"c{k}"] for k in range(len(names[r["task"]]))] for r in state}
        table = sums.select("task", "user", "code", "classes", *(f"n{k}" for k in ks), "answers")
        settled = max([r["moved"] for r in state], default=0.0) <= tolerance
    _tell(rounds, settled, strict)

    final = scored(table.select("task", "user", "code", "classes", *(f"n{k}" for k in ks)))
    best = F.greatest(*(F.round(F.col(f"q{k}"), 12) for k in ks), F.lit(0.0))
    code = F.coalesce(*(F.when(F.round(F.col(f"q{k}"), 12) >= best, k) for k in ks))
    one = final.groupBy("task", "item").agg(*(F.first(f"q{k}").alias(f"q{k}") for k in ks), F.count("*").alias("n_answers"))
    one = one.select("task", "item", code.alias("code"), best.alias("probability"), "n_answers")
    labels = one.join(codes.select("task", "code", "label"), ["task", "code"]).select("task", "item", "label", "probability", "n_answers")

    n = table.withColumn("right", sum((F.when(F.col("code") == k, F.col(f"n{k}")).otherwise(0.0) for k in ks), F.lit(0.0)))
    users = n.groupBy("task", "user").agg(F.sum("right").alias("r"), F.sum(sum((F.col(f"n{k}") for k in ks), F.lit(0.0))).alias("n"))
    a, b = F.col("r") + 2 * start, F.col("n") - F.col("r") + 2 * (1 - start)
    mean = a / (a + b)
    half = 1.959964 * F.sqrt(mean * (1 - mean) / (a + b + 1))
    users = users.select("task", "user", F.round("n").cast("long").alias("n_answers"), mean.alias("reliability"), F.greatest(F.lit(0.0), mean - half).alias("low"), F.least(F.lit(1.0), mean + half).alias("high"))
    return Consensus(labels, users, rounds, settled)


def _tell(rounds: int, settled: bool, strict: bool) -> None:
    if not settled:
        if strict:
            raise RuntimeError(f"the consensus has not settled in {rounds} rounds")
        warnings.warn(f"the consensus has not settled in {rounds} rounds", stacklevel=3)


def _by_arrays(rows: DataFrame, people: DataFrame, names: dict[str, list[str]], max_rounds: int, tolerance: float, strength: float, start: float, strict: bool) -> Consensus:
    """consensus() with the table of annotators as an array: an annotator of a task has a number, an item one row with all of its answers."""
    spark = rows.sparkSession
    who = [(r["task"], r["user"]) for r in people.orderBy("task", "user").collect()]
    tasks = sorted(names)
    task_of = np.array([tasks.index(t) for t, _ in who], dtype=int)
    k = max([len(v) for v in names.values()], default=1)
    classes = np.array([len(names[t]) for t in tasks], dtype=int)
    open_ = np.arange(k)[None, :] < classes[:, None] if tasks else np.zeros((0, k), dtype=bool)
    kinds = dict(rows.dtypes)
    ids = spark.createDataFrame([(t, u, i) for i, (t, u) in enumerate(who)], f"task {kinds['task']}, user {kinds['user']}, uid int")
    numbers = spark.createDataFrame(list(zip(tasks, range(len(tasks)))), f"task {kinds['task']}, tid int")
    grouped = rows.join(F.broadcast(ids), ["task", "user"]).join(F.broadcast(numbers), "task").groupBy("tid", "item").agg(F.collect_list(F.struct("uid", "code")).alias("x"))
    items = cut_table(widely(grouped.select("tid", "item", F.col("x.uid").alias("uids"), F.col("x.code").alias("codes"))))
    counts, sums, answered = np.zeros((len(who), k, k)), np.zeros((len(tasks), k)), np.zeros(len(who))  # of annotator, label given, true class
    mine = np.eye(k, dtype=bool)

    def logs() -> tuple[np.ndarray, np.ndarray]:
        """Expected log confusions and log shares of the classes."""
        a = (counts[:, mine].sum(1) + 2 * start) / (counts.sum((1, 2)) + 2)
        wrong = (1 - a) / np.maximum(classes[task_of] - 1, 1)
        prior = strength * np.where(mine[None], a[:, None, None], wrong[:, None, None])
        e = _digammas(prior + counts + 1e-3) - _digammas(strength + 1e-3 + counts.sum(1))[:, None, :]
        return e, np.where(open_, _digammas(1 + sums) - _digammas((sums * open_).sum(1, keepdims=True) + classes[:, None]), -1e9)

    def scored(pdf: pd.DataFrame, e: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the classes of each item; annotator, label and item of each answer."""
        n = pdf["uids"].map(len).to_numpy()
        uid, code = np.concatenate(pdf["uids"].to_list()), np.concatenate(pdf["codes"].to_list())
        s = np.add.reduceat(e[uid, code], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) + p[pdf["tid"].to_numpy()]
        q = np.exp(s - s.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True), uid, code, np.repeat(np.arange(len(n)), n)

    def summing(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            e, p = shared.value
            n, c = np.zeros((len(e) * k, k)), np.zeros((len(p), k))
            for pdf in batches:
                if len(pdf):
                    q, uid, code, item = scored(pdf, e, p)
                    np.add.at(n, uid * k + code, q[item])
                    np.add.at(c, pdf["tid"].to_numpy(), q)
            at, ct = np.flatnonzero(n.any(axis=1)), np.flatnonzero(c.any(axis=1))
            yield pd.DataFrame({"at": np.concatenate((at, -1 - ct)), "n": pd.Series([*n[at], *c[ct]], dtype=object)})

        return run

    for t, n in rows.groupBy("task", "user").agg(F.count("*").alias("n")).join(F.broadcast(ids), ["task", "user"]).select("uid", "n").collect():
        answered[t] = n
    rounds, settled = 0, False
    while rounds < max_rounds and not settled:
        rounds += 1
        shared = spark.sparkContext.broadcast(logs())
        partial = items.select("tid", "uids", "codes").mapInPandas(summing(shared), "at long, n array<double>")
        new, sums = np.zeros((len(who) * k, k)), np.zeros((len(tasks), k))
        for r in partial.groupBy("at").agg(*(F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(k))).collect():
            (new if r["at"] >= 0 else sums)[r["at"] if r["at"] >= 0 else -1 - r["at"]] = r[1:]
        new = new.reshape(counts.shape)
        settled = bool((np.abs(new - counts) <= tolerance * (1 + answered)[:, None, None]).all())
        counts = new
        shared.unpersist()
    _tell(rounds, settled, strict)

    last = spark.sparkContext.broadcast(logs())

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, p = last.value
        for pdf in batches:
            if len(pdf):
                q = np.round(scored(pdf, e, p)[0], 12)
                best = q.argmax(axis=1)
                yield pd.DataFrame({"task": [tasks[t] for t in pdf["tid"]], "item": pdf["item"], "label": [names[tasks[t]][b] for t, b in zip(pdf["tid"], best)], "probability": q.max(axis=1), "n_answers": pdf["uids"].map(len)})

    labels = items.mapInPandas(label, f"task {kinds['task']}, item {kinds['item']}, label string, probability double, n_answers long")
    right, whole = counts[:, mine].sum(1), counts.sum((1, 2))
    a, b = right + 2 * start, whole - right + 2 * (1 - start)
    mean = a / (a + b)
    half = 1.959964 * np.sqrt(mean * (1 - mean) / (a + b + 1))
    users = [(t, u, int(round(n)), float(m), float(max(0.0, m - h)), float(min(1.0, m + h))) for (t, u), n, m, h in zip(who, whole, mean, half)]
    return Consensus(labels, spark.createDataFrame(users, f"task {kinds['task']}, user {kinds['user']}, n_answers long, reliability double, low double, high double"), rounds, settled)


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out, x = out - 1 / x, x + 1
    z = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z / 252))


def krippendorff(answers: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal labels by task: task, items (with two answers or more), answers, observed, expected and alpha.

    alpha is null where the answers hold fewer than two different labels. An empty table gives no row.
    """
    n = answers.groupBy("task", "item", "label").agg(F.count("*").alias("c"))
    items = n.groupBy("task", "item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s")).where("m > 1")
    seen = items.groupBy("task").agg(F.count("*").alias("items"), F.sum("m").alias("answers"), F.sum((F.col("m") * F.col("m") - F.col("s")) / (F.col("m") - 1)).alias("o"))
    label = n.join(items.select("task", "item"), ["task", "item"]).groupBy("task", "label").agg(F.sum("c").alias("c"))
    square = label.groupBy("task").agg(F.sum(F.col("c") * F.col("c")).alias("q"))
    one = seen.join(square, "task")
    observed = F.col("o") / F.col("answers")
    expected = (F.col("answers") * F.col("answers") - F.col("q")) / (F.col("answers") * (F.col("answers") - 1))
    return one.select("task", "items", "answers", observed.alias("observed"), expected.alias("expected"), F.when(expected > 0, 1 - observed / expected).alias("alpha"))
