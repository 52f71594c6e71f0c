"""Papers as text: readers tried in turn, recognised text where a reader gives too little, table text and captions behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A reader of a file's bytes: its text, or None; it may fail in any way.
Reader = Callable[[bytes], str | None]
#: A reader of the tables in a file: rows of cells of each.
Tables = Callable[[bytes], list[list[list[str]]]]

CAPTIONS = "image_path string, caption string, source_pdf string, page_num int"


def _first(readers: list[tuple[str, Reader]], content: bytes) -> tuple[str | None, str | None, str | None]:
    """(reader, text, error) of the first that gives a text; the last error where none does."""
    error = None
    for name, read in readers:
        try:
            text = read(content)
        except Exception as e:  # noqa: BLE001  a provider may fail in any way
            error = f"{name}: {e}"
            continue
        if text and text.strip():
            return name, text, None
    return None, None, error


def table_text(tables: list[list[list[str]]]) -> str:
    """A section a table, its rows as lines of cells."""
    shown = ["\n".join(" | ".join(c or "" for c in row) for row in t) for t in tables]
    return "".join(f"\n\n[表格]\n{x}" for x in shown if x)


def read_papers(files: DataFrame, readers: list[tuple[str, Reader]], ocr: Reader | None = None, tables: Tables | None = None, least: int = 500) -> DataFrame:
    """name, text, method, error of files (name, content): the text of the first reader that gives one.

    Where that has fewer than `least` characters, `ocr` is asked too and counts if it gives more. Text of tables goes behind it. A provider that fails or is
    missing costs no row: text is then null and error says why. Null contents give null. Files are independent, so rows are only mapped.
    """

    def one(content: bytes | None) -> tuple[str | None, str | None, str | None]:
        if content is None:
            return None, None, None
        method, text, error = _first(readers, content)
        if ocr is not None and len(text or "") < least:
            name, seen, failed = _first([("ocr", ocr)], content)
            if len(seen or "") > len(text or ""):
                method, text, error = name, seen, None
            error = error or (failed if text is None else None)
        if tables is not None and text is not None:
            try:
                text += table_text(tables(content))
            except Exception as e:  # noqa: BLE001
                error = f"tables: {e}"
        return text, method, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(None if c is None else bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"name": pdf["name"], "text": [g[0] for g in got], "method": [g[1] for g in got], "error": [g[2] for g in got]}, dtype=object)

    return files.select("name", "content").mapInPandas(run, "name string, text string, method string, error string")


def save_texts(papers: DataFrame, path: str) -> None:
    """One folder a paper with its text in it."""
    papers.where("text is not null").select(F.regexp_replace("name", r"\.[^.]*$", "").alias("paper"), "text").write.mode("overwrite").partitionBy("paper").text(path)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """image_path, caption, source_pdf, page_num of a JSON file that holds a list; a missing path gives an empty table."""
    try:
        return spark.read.json(path, schema=CAPTIONS, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], CAPTIONS)


def save_images(images: DataFrame, links: DataFrame, path: str) -> None:
    """Pictures and their links to concepts as two tables of CSV."""
    images.write.csv(f"{path}/images", header=True, mode="overwrite")
    links.write.csv(f"{path}/image_relationships", header=True, mode="overwrite")


def caption_section(papers: DataFrame, captions: DataFrame) -> DataFrame:
    """Papers (name, text) with a section of their pictures' captions behind the text, by page and path; papers without any stay as they are.

    captions: image_path, caption, source_pdf, page_num. Captions that are null or blank are left out; the others are numbered from 1.
    """
    own = captions.where("trim(caption) <> ''").groupBy(F.col("source_pdf").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("page_num", "image_path", "caption"))).alias("c"))
    lines = F.transform("c", lambda x, i: F.format_string("**图%d**（第%d页）：%s", i + 1, F.coalesce(x.page_num, F.lit(0)), x.caption))
    section = F.concat(F.lit("\n\n## 图片说明\n\n"), F.array_join(lines, "\n\n"))
    return papers.join(own, papers["name"] == F.col("_p"), "left").withColumn("text", F.concat("text", F.coalesce(section, F.lit("")))).drop("_p", "c")


def image_chunks(captions: DataFrame) -> DataFrame:
    """chunk_id ({paper}_image_{place}), text of the captions of each paper's pictures, by page and path from 0."""
    stem = F.regexp_replace("source_pdf", r"\.[^.]*$", "")
    own = captions.where("trim(caption) <> '' and source_pdf is not null").groupBy(stem.alias("s")).agg(F.sort_array(F.collect_list(F.struct("page_num", "image_path", "caption"))).alias("c"))
    each = own.select("s", F.posexplode("c").alias("i", "x"))
    return each.select(F.concat("s", F.lit("_image_"), "i").alias("chunk_id"), F.col("x.caption").alias("text"))
