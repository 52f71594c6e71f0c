"""From model answers and dictionaries to concepts and relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.operators.relations import clamp_importance

ANSWER = "concepts array<struct<entity: string, importance: string, category: string>>, relationships array<struct<node_1: string, node_2: string, edge: string>>"

# Categories and words of relations that the rule critic accepts.
VALID_CATEGORIES = ("pathogen", "host", "vector", "symptom", "treatment", "environment", "location", "mechanism", "compound")
VALID_RELATIONS = ("引起", "导致", "诱发", "传播", "携带", "扩散", "感染", "寄生于", "侵染", "防治", "控制", "抑制", "杀灭", "影响", "促进", "分布于", "发生于")


def with_retries(call: Callable[[str], str | None], texts: pd.Series, attempts: int = 3) -> list[str | None]:
    """Answers of an outside model, None where all attempts fail."""
    out: list[str | None] = []
    for t in texts:
        answer = None
        for _ in range(attempts):
            try:
                answer = call(t)
                break
            except Exception:  # noqa: BLE001  a provider may fail in any way
                continue
        out.append(answer)
    return out


def ask(chunks: DataFrame, call: Callable[[str], str | None], least: int = 20) -> DataFrame:
    """chunk_id, text, answer (a JSON text or null) of a provider, asked in batches; texts of fewer than `least` characters aren't asked."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=with_retries(call, pdf["text"]))

    own = chunks.select("chunk_id", "text").where(F.length(F.trim("text")) >= least)
    return own.mapInPandas(run, "chunk_id string, text string, answer string")


def concepts_of(answers: DataFrame, ord_: Column | None = None) -> DataFrame:
    """Concept rows of JSON answers (chunk_id, answer): bad JSON and nameless entries give none, importance is brought into 1..5, names are folded."""
    parsed = answers.select("chunk_id", F.from_json("answer", ANSWER).alias("a")).select("chunk_id", F.posexplode("a.concepts").alias("ord", "c"))
    parsed = parsed.where("c.entity is not null and trim(c.entity) <> ''")
    return parsed.select(F.lower(F.trim("c.entity")).alias("entity"), clamp_importance(F.col("c.importance")).alias("importance"), F.lower(F.coalesce("c.category", F.lit("misc"))).alias("category"), "chunk_id", F.lit("concept").alias("type"), F.col("ord").cast("long").alias("ord"))


def relations_of(answers: DataFrame) -> DataFrame:
    """Relationship rows of JSON answers; both ends are needed, the edge defaults to 'related to'."""
    parsed = answers.select("chunk_id", F.from_json("answer", ANSWER).alias("a")).select("chunk_id", F.explode("a.relationships").alias("r"))
    parsed = parsed.where("trim(coalesce(r.node_1, '')) <> '' and trim(coalesce(r.node_2, '')) <> ''")
    return parsed.select(F.lower(F.trim("r.node_1")).alias("node_1"), F.lower(F.trim("r.node_2")).alias("node_2"), F.coalesce("r.edge", F.lit("related to")).alias("edge"), F.lit(0.8).alias("weight"), "chunk_id", F.lit("llm").alias("source"))


def dictionary_mentions(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term) of the terms (term) that occur in a text, without case: the default extractor in place of a model. terms is a list that people keep; it travels to the tasks."""
    import ahocorasick

    rows = [r[0] for r in terms.select(F.lower("term")).where("term is not null").distinct().limit(200_001).collect()]
    if len(rows) > 200_000:
        raise ValueError("more than 200000 terms")
    shared = texts.sparkSession.sparkContext.broadcast(rows)
    kind = dict(texts.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = ahocorasick.Automaton()
        for t in shared.value:
            auto.add_word(t, t)
        if shared.value:
            auto.make_automaton()
        for pdf in batches:
            got = [(k, t) for k, s in zip(pdf["k"], pdf["t"]) if s and shared.value for t in sorted({t for _, t in auto.iter(s.lower())})]
            yield pd.DataFrame(got, columns=["k", "term"])

    out = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").mapInPandas(find, f"k {kind}, term string")
    return out.withColumnRenamed("k", key)


def context_window(concepts: DataFrame, size: int = 5, least: int = 4) -> DataFrame:
    """chunk_id, context: the important entities of earlier chunks of the paper, newest first, at most `size` (each once); exact sequential form.

    Needs paper, chunk_no, chunk_id, ord, entity, importance. Papers are independent and their chunks are taken in order; a paper whose concepts
    fill a task's memory would be an extraction fault.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        window: list[str] = []
        out = []
        for _, g in pdf.sort_values(["chunk_no", "ord"], kind="stable").groupby("chunk_no", sort=True):
            out.append((g["chunk_id"].iloc[0], list(window)))
            for e in g.loc[g["importance"] >= least, "entity"].head(size):
                if e not in window:
                    window.insert(0, e)
            del window[size:]
        return pd.DataFrame(out, columns=["chunk_id", "context"])

    own = concepts.select("paper", "chunk_no", "chunk_id", "ord", "entity", "importance").where("paper is not null and chunk_no is not null and entity is not null")
    return own.groupBy("paper").applyInPandas(one, "chunk_id string, context array<string>")


def recent_entities(concepts: DataFrame, chunks: int = 3, least: int = 4) -> DataFrame:
    """chunk_id, context: important entities of the `chunks` chunks before, sorted; the relational form of context_window()."""
    per = concepts.groupBy("paper", "chunk_no", "chunk_id").agg(F.collect_set(F.when(F.col("importance") >= least, F.col("entity"))).alias("e"))
    before = F.flatten(F.collect_list("e").over(W.partitionBy("paper").orderBy("chunk_no", "chunk_id").rowsBetween(-chunks, -1)))
    return per.select("chunk_id", F.array_join(F.array_sort(F.array_distinct(before)), "|").alias("context"))


def critic(concepts: DataFrame, relations: DataFrame, categories: tuple[str, ...] = VALID_CATEGORIES, words: tuple[str, ...] = VALID_RELATIONS) -> tuple[DataFrame, DataFrame]:
    """Both tables with `approved`: a known category; an edge that holds one of the words."""
    ok = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(F.col("edge"), F.lit("")), w))
    return concepts.withColumn("approved", F.coalesce(F.lower("category").isin(*categories), F.lit(False))), relations.withColumn("approved", ok)


def refine(concepts: DataFrame, relations: DataFrame, quality: float = 0.7, low: float = 0.6, high: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """The approved rows, if the quality lies in the range that is reviewed and below `high`; else all."""
    if low <= quality <= high and quality < high:
        return concepts.where("approved"), relations.where("approved")
    return concepts, relations


def illustrations(images: DataFrame, concepts: DataFrame, least: int = 10) -> DataFrame:
    """(concept, image_path, caption, relationship_type) of captions (image_path, caption, entity in it) whose entity is a known concept."""
    known = concepts.select(F.lower("entity").alias("_e")).distinct()
    own = images.where(F.length("caption") >= least)
    return own.join(known, F.lower("entity") == F.col("_e"), "left_semi").select(F.col("entity").alias("concept"), "image_path", "caption", F.lit("ILLUSTRATED_BY").alias("relationship_type"))


def images_for(links: DataFrame, concepts: list[str], per_concept: int = 3) -> DataFrame:
    """The first images (by image_path) of each asked concept, then each image once, in the order asked."""
    asked = links.sparkSession.createDataFrame([(c.lower(), i) for i, c in enumerate(concepts)], "c string, i int")
    j = links.join(F.broadcast(asked), F.lower("concept") == F.col("c"))  # what a caller typed
    top = j.withColumn("n", F.row_number().over(W.partitionBy("c").orderBy("image_path"))).where(F.col("n") <= per_concept)
    once = top.withColumn("k", F.row_number().over(W.partitionBy("image_path").orderBy("i", "n"))).where("k = 1")
    return once.orderBy("i", "n").select("concept", "image_path", "caption")
