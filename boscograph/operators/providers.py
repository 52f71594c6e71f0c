"""Steps that ask an outside model, with what holds where it says nothing. A provider is a callable; it runs in batches inside the tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscograph.operators.extract import with_retries

_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
CRITIQUE = "struct<quality: double, concepts: array<struct<entity: string, importance: string, category: string>>, relationships: array<struct<node_1: string, node_2: string, edge: string>>>"
SUMMARY = "struct<title: string, summary: string, core_concepts: array<string>, themes: array<string>>"


def answered(df: DataFrame, prompt: Column, call: Callable[[str], str | None], attempts: int = 3) -> DataFrame:
    """df with `answer`: what the provider says to the prompt, code fences taken off; null where it fails each time or the prompt is null."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ask = pdf["_prompt"].notna()
            got = pd.Series(None, index=pdf.index, dtype=object)
            got[ask] = pd.Series(with_retries(call, pdf.loc[ask, "_prompt"], attempts), index=pdf.index[ask], dtype=object)
            yield pdf.drop(columns="_prompt").assign(answer=[_FENCE.sub("", x) if isinstance(x, str) else None for x in got])

    return df.withColumn("_prompt", prompt).mapInPandas(run, f"{schema},answer:string")


def review_gate(confidence: Column, low: float = 0.6, high: float = 0.85) -> Column:
    """Whether an extraction is unsure enough to be looked at again, and sure enough to be worth it."""
    return (confidence >= low) & (confidence <= high)


def critique(extractions: DataFrame, call: Callable[[str], str | None], initial: float = 0.7, refine_below: float = 0.85, unchanged_from: float = 0.9) -> DataFrame:
    """Each extraction (chunk_id, text, answer) reviewed by a provider on its own: chunk_id, answer, quality, confidence, refined.

    Those in the gate are asked; an answer with a quality under refine_below brings its own concepts and relationships, which then replace the first ones (weight 0.9 is
    given by refined_weight()). From unchanged_from, and where the provider says nothing that can be read, the extraction stays. Confidence is min(1, quality + 0.1).
    """
    own = extractions.select("chunk_id", "text", F.col("answer").alias("first"))
    got = answered(own, F.when(review_gate(F.lit(initial)), F.to_json(F.struct("text", F.col("first").alias("answer")))), call)
    said = got.select("chunk_id", "first", F.from_json("answer", CRITIQUE).alias("s"))
    quality = F.col("s.quality")
    refined = F.coalesce((quality < refine_below) & (quality < unchanged_from) & F.col("s.concepts").isNotNull(), F.lit(False))
    return said.select(
        "chunk_id", F.when(refined, F.to_json(F.struct("s.concepts", "s.relationships"))).otherwise(F.col("first")).alias("answer"), quality.alias("quality"),
        F.when(quality.isNotNull(), F.least(F.lit(1.0), quality + 0.1)).otherwise(F.lit(initial)).alias("confidence"), refined.alias("refined"),
    )


def refined_weight(refined: Column, weight: Column) -> Column:
    return F.when(refined, F.lit(0.9)).otherwise(weight)


def describe_communities(summaries: DataFrame, call: Callable[[str], str | None]) -> DataFrame:
    """Summaries (community, title, core_concepts, theme, size) with title, summary and themes of a provider where its JSON can be read; else the title stays and the summary is made of the core."""
    got = answered(summaries, F.to_json(F.struct("title", "core_concepts", "theme", "size")), call).withColumn("s", F.from_json("answer", SUMMARY))
    return got.select("community", F.coalesce("s.title", "title").alias("title"), F.coalesce("s.summary", F.col("core_concepts")).alias("summary"), "core_concepts", F.coalesce("s.themes", F.array("theme")).alias("themes"), "size")


def adjudicate(issues: DataFrame, call: Callable[[str], str | None], prompt: Column) -> DataFrame:
    """Issues with keep: false only where the provider says no; a failure, or anything else, keeps the row."""
    got = answered(issues, prompt, call)
    no = F.lower(F.trim("answer")).rlike("^(no|false|否|不)")
    return got.withColumn("keep", F.coalesce(~no, F.lit(True))).drop("answer")


def embed(df: DataFrame, text: str, call: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """df with `vector` of a provider that takes a batch of texts; null texts, and batches that fail, have none."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            has = pdf[text].notna().tolist()
            got: list[list[float] | None] = [None] * len(pdf)
            if any(has):
                try:
                    given = iter([[float(x) for x in v] for v in call([t for t, h in zip(pdf[text], has) if h])])
                    got = [next(given) if h else None for h in has]
                except Exception:  # noqa: BLE001  a provider may fail in any way
                    got = [None] * len(pdf)
            yield pdf.assign(vector=pd.Series(got, index=pdf.index, dtype=object))

    return df.mapInPandas(run, f"{schema},vector:array<float>")


def node_index(vectors: DataFrame, name: str = "entity", order: str = "ord") -> DataFrame:
    """One vector a name, the last one; rows without a vector don't count."""
    own = vectors.where(F.col(name).isNotNull() & F.col("vector").isNotNull())
    return own.groupBy(name).agg(F.max_by("vector", order).alias("vector"))

